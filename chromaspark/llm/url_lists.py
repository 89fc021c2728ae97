"""URL filters by a temporal list join.

Dated list entries (added, removed, added again) become intervals in which a pattern is in force. Each
capture is matched with the patterns that could cover its URL, and of those with the interval that holds
its fetch date. Both sides meet on (pattern, period of time), so a host that is fetched all the time is
spread over the periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PERIOD_DAYS = 30
FAR = "9999-12-31"


def canonical(url: Column) -> Column:
    """Host and path of a URL in lower case, without scheme, user, port, query and fragment; a trailing slash goes."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://", ""), r"[?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(F.split_part(bare, F.lit("/"), F.lit(1)), r"^.*@", ""), r":\d*$", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"^[^/]*", ""), r"/+$", "")
    return F.concat(F.regexp_replace(host, r"\.+$", ""), path)


def host_of(url: Column) -> Column:
    return F.split_part(canonical(url), F.lit("/"), F.lit(1))


def patterns_of(bare: Column) -> Column:
    """All patterns that could cover a canonical URL: ``domain:`` for each suffix of the host, ``path:`` for each prefix of the path."""
    parts = F.split(bare, "/")
    labels = F.split(F.element_at(parts, 1), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    paths = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("path:"), F.array_join(F.slice(parts, F.lit(1), i), "/"))
    )
    return F.array_union(domains, paths)


def intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, list, since, until)``: when each pattern of each list was in force, the end excluded.

    ``entries`` is ``(list, pattern, day date, action)`` with the actions ``add`` and ``remove``. Rows with a
    null in any column or another action are not entries. On one day an ``add`` stands before a ``remove``
    (so the day ends without). Repeated and redundant entries change nothing.
    """
    dated = entries.select("list", "pattern", "day", "action").where(
        "list IS NOT NULL AND pattern IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')"
    ).groupBy("list", "pattern", "day").agg(F.max("action").alias("action"))
    in_order = Window.partitionBy("list", "pattern").orderBy("day")
    turns = dated.withColumn("was", F.lag("action").over(in_order)).where("was IS NULL OR was <> action")
    spans = turns.withColumn("until", F.coalesce(F.lead("day").over(in_order), F.lit(FAR).cast("date")))
    return spans.where("action = 'add'").select("pattern", "list", F.col("day").alias("since"), "until")


def _period(day: Column) -> Column:
    return F.floor(F.unix_date(day) / PERIOD_DAYS)


def verdicts(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched_on") -> DataFrame:
    """``(url, day, hits, list, pattern, since, until)`` for each distinct URL and fetch date.

    ``hits`` counts the list patterns in force on that date, the rest describes the first of them by
    (list, pattern); all null if there is none. A null URL or date has no hits.
    """
    # the bare URL is computed here once, in all tasks that read captures
    asked = captures.select(F.col(url).alias("url"), F.col(day).alias("day"), canonical(F.col(url)).alias("bare")).distinct()
    reach = asked.agg(F.min(_period(F.col("day"))).alias("lo"), F.max(_period(F.col("day"))).alias("hi"))
    spans = intervals(entries).crossJoin(F.broadcast(reach))  # one row
    spans = spans.where("lo IS NOT NULL").select(
        "pattern", "list", "since", "until", F.greatest(_period(F.col("since")), "lo").alias("a"),
        F.least(_period(F.date_sub("until", 1)), "hi").alias("b"),
    ).where("a <= b").select("pattern", "list", "since", "until", F.explode(F.sequence("a", "b")).alias("period"))
    wide = asked.where("url IS NOT NULL AND day IS NOT NULL").select(
        "url", "day", _period(F.col("day")).alias("period"), F.explode(patterns_of(F.col("bare"))).alias("pattern")
    )
    met = wide.join(spans, ["pattern", "period"]).where("day >= since AND day < until")
    first = F.min(F.struct("list", "pattern", "since", "until")).alias("m")
    found = met.groupBy("url", "day").agg(F.count(F.lit(1)).alias("hits"), first)
    both = asked.alias("a").join(found.alias("f"), F.col("a.url").eqNullSafe(F.col("f.url")) & F.col("a.day").eqNullSafe(F.col("f.day")), "left")
    return both.select(
        F.col("a.url").alias("url"), F.col("a.day").alias("day"), F.coalesce("f.hits", F.lit(0)).cast("bigint").alias("hits"),
        "f.m.list", "f.m.pattern", "f.m.since", "f.m.until",
    )


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched_on") -> DataFrame:
    """Every capture row with its verdict: struct ``verdict`` (hits, list, pattern, since, until) beside struct ``capture``.

    Repeated rows are returned as often as given. Both tables may be empty. The columns of ``captures``
    stay inside ``capture``, so they may have any name.
    """
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("capture"))
    v = verdicts(captures, entries, url, day)
    same = F.col("capture")[url].eqNullSafe(F.col("url")) & F.col("capture")[day].eqNullSafe(F.col("day"))
    return rows.join(v, same, "left").select(
        "capture", F.struct("hits", "list", "pattern", "since", "until").alias("verdict")
    )
