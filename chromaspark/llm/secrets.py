"""Secret scans: strong patterns, and weak parts of a credential that count only together.

An access identifier, a secret and an endpoint prove little alone: a run of forty letters may be anything.
Weak candidates are joined by intervals within a scope (a block of lines between blank ones): a candidate is reported
if the parts that complete it begin within ``REACH`` code points of it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chromaspark.llm.common import keep

REACH = 400  # code points between the starts of two parts of one credential, at the most

# Strong patterns, each with the words one of which must occur for it to match, the group whose length counts and the least length.
# Every letter of the first pattern's names may be of either case. Runs are matched from their first character on, so the length may stand in the pattern.
STRONG = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6,
     ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", re.compile("AKIA[A-Z0-9]{16,}"), 0, 20, ("akia",)),
    ("hex", re.compile("(?<![0-9a-f])[0-9a-f]{24,}"), 0, 24, ()),
)
# Weak candidates, which need company: kind, pattern, words one of which must occur.
_SECRET = "secret"
WEAK = (
    ("identifier", re.compile("(?<![A-Z0-9])(?:ASIA|AROA|AIDA|ABIA|ACCA)[A-Z0-9]{12,}"), ("asia", "aroa", "aida", "abia", "acca")),
    ("identifier", re.compile(r"""(?<![A-Za-z0-9])(?:client|account|access|user|key)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}""", re.I | re.A),
     ("client", "account", "access", "user", "key")),
    (_SECRET, re.compile("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}"), ()),
    ("endpoint", re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+"""), ("://",)),
    ("endpoint", re.compile(r"(?<![A-Za-z0-9./:-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|io|dev|cloud|internal|local)(?::[0-9]{2,5})?(?![A-Za-z0-9])"),
     (".com", ".net", ".org", ".io", ".dev", ".cloud", ".internal", ".local")),
)
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")  # order of spans with one start
ROLE = {"assign": "s", "hex": "s", "secret": "s", "access": "i", "identifier": "i", "endpoint": "e"}

_BLANK = re.compile(r"\n[\x20\t\r]*\n")


def strong_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """``(start, number of the kind, end)`` of the strong patterns, leftmost and without overlap within a kind; ``low`` is the text in lower case."""
    out = []
    for n, (_, pattern, group, least, words) in enumerate(STRONG):
        if not words or any(w in low for w in words):
            out += [(m.start(), n, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def _mixed(s: str) -> bool:
    """Random text has digits and letters of both cases; words, paths and numbers rarely have all three."""
    return any(c.isdigit() for c in s) and any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s)


def weak_spans(text: str, low: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that no strong span touches, as ``(start, number of the kind, end)``."""
    found = {
        (m.start(), KINDS.index(kind), m.end()) for kind, pattern, words in WEAK if not words or any(w in low for w in words)
        for m in pattern.finditer(text) if kind != _SECRET or _mixed(m.group())
    }
    starts, reach, far = [s for s, _, _ in strong], [], 0
    for _, _, e in strong:
        far = max(far, e)
        reach.append(far)

    def free(span: tuple[int, int, int]) -> bool:
        before = bisect_right(starts, span[2] - 1)
        return not before or reach[before - 1] <= span[0]

    return sorted(s for s in found if free(s))


def _scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(place, key, counts, base, parts)``: strong spans as text and, where weak candidates exist, all parts with scopes."""

    @F.arrow_udf("struct<n_assign: bigint, n_access: bigint, n_hex: bigint, base: array<struct<start: bigint, kind: int, end: bigint>>,"
                 " parts: array<struct<start: bigint, kind: int, end: bigint, scope: bigint>>>")
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            t = value.as_py() or ""
            low = t.lower()
            strong = strong_spans(t, low)
            weak = weak_spans(t, low, strong)
            parts: list[dict] = []
            # without both an identifier and a secret nothing of this text can be completed
            if weak and {"s", "i"} <= {ROLE[KINDS[k]] for _, k, _ in strong + weak}:
                breaks = [m.start() for m in _BLANK.finditer(t)]
                parts = [{"start": s, "kind": k, "end": e, "scope": bisect_right(breaks, s)} for s, k, e in strong + weak]
            count = [sum(k == n for _, k, _ in strong) for n in range(3)]
            out.append({
                "n_assign": count[0], "n_access": count[1], "n_hex": count[2],
                "base": [{"start": s, "kind": k, "end": e} for s, k, e in strong], "parts": parts,
            })
        span = [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]
        return pa.array(out, pa.struct([
            ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.list_(pa.struct(span))),
            ("parts", pa.list_(pa.struct([*span, ("scope", pa.int64())]))),
        ]))

    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(key).alias("key"), scan(F.col(text)).alias("s"))
    return rows.select("place", "key", "s.*")


def linked_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Rows of ``(place, scope, start, kind, end)`` whose kind is weak and whose credential is completed within the scope.

    An identifier needs a secret and a secret an identifier that begin within ``reach``; an endpoint needs both. The join is on
    windows of ``reach`` code points, each with the first and last start of every role: a part asks its own
    window and the two beside it, so no pairs of parts are formed however many there are.
    """
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1)
    cell = F.floor(F.col("start") / reach)
    dealt = parts.withColumn("role", role).withColumn("cell", cell)
    ends = [f(F.when(F.col("role") == r, F.col("start"))).alias(f"{name}_{r}") for r in "si" for name, f in (("first", F.min), ("last", F.max))]
    windows = dealt.groupBy("place", "scope", "cell").agg(*ends)
    weak = dealt.where(F.col("kind") >= len(STRONG))
    asking = weak.withColumn("at", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    met = asking.join(windows.withColumnRenamed("cell", "at"), ["place", "scope", "at"])

    def within(r: str) -> Column:
        return F.coalesce(F.max(
            F.when(F.col("at") == F.col("cell"), F.col(f"first_{r}").isNotNull())
            .when(F.col("at") < F.col("cell"), F.col("start") - F.col(f"last_{r}") <= reach)
            .otherwise(F.col(f"first_{r}") - F.col("start") <= reach)
        ), F.lit(False))

    told = met.groupBy("place", "scope", "start", "kind", "end", "role").agg(within("s").alias("s"), within("i").alias("i"))
    need = F.when(F.col("role") == "i", F.col("s")).when(F.col("role") == "s", F.col("i")).otherwise(F.col("s") & F.col("i"))
    return told.where(need).select("place", "scope", "start", "kind", "end")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """``(key, n_assign, n_access, n_hex, base, added)``: a row for each row of ``docs`` with its spans in order.

    A span is ``(start, kind, end)`` in code points, kind a number in ``KINDS``; ``base`` holds the strong patterns, ``added``
    the linked weak candidates. Null and empty texts have none; every row has its own result, repeated rows
    and null keys too. Other columns are not looked at; an empty table gives an empty one.
    """
    rows = keep(_scan(docs, key, text), "scanned")
    # a place of the weak spans is short: only rows with candidates move
    parts = rows.select("place", F.explode("parts").alias("p")).select("place", "p.*")
    added = linked_parts(parts, reach).groupBy("place").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    return rows.join(added, "place", "left").select(
        F.col("key").alias(key), "n_assign", "n_access", "n_hex", "base",
        F.coalesce("added", F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")).alias("added"),
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, checksum of the strong spans and all spans as text."""
    every = F.sort_array(F.concat("base", "added"))
    return scanned.select(
        key, "n_assign", "n_access", "n_hex", F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(every).alias("spans")
    )
