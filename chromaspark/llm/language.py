"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, languages by hash buckets. It is fitted from counts that
Spark sums per (language, bucket) over a bounded sample of labelled rows, goes to every task in blocks of
languages, and texts are scored in NumPy by adding up the matrix rows of their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chromaspark.llm.common import drop_kept, keep, slices

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
FIT_ROWS = 20_000  # sampled rows for each language, about; more change little
BLOCK = 256  # languages scored in one pass
MAX_BROADCAST_LABELS = 1_000_000
OPEN_LABELS = 400  # 0.2 GB of counts
PIECE = 1 << 18  # characters that are hashed at once: about 50 MB of arrays

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def _letters_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(_is_letter()[codes], codes, 0).astype(np.uint32)


def _single_blanks(codes: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """Which places stay if every run of blanks of one owner becomes one blank."""
    stay = np.ones(len(codes), dtype=bool)
    stay[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    if owner is not None:
        stay[1:] |= owner[1:] != owner[:-1]
    return stay


def _hashed(run: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of some ``(text, codes before, codes)``, and the text each belongs to.

    An n-gram counts where it ends, unless that is in the codes before.
    """
    flat = np.concatenate([x for _, head, body in run for x in (head, body)])
    owner = np.repeat(np.arange(len(run)), [len(head) + len(body) for _, head, body in run])
    fresh = np.concatenate([np.arange(len(head) + len(body)) >= len(head) for _, head, body in run])
    stay = _single_blanks(flat, owner)
    flat, owner, fresh = flat[stay], owner[stay], fresh[stay]
    of = np.array([i for i, _, _ in run])
    out, whose = [], []
    for n in ORDERS:
        m = len(flat) - n + 1
        if m < 1:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for i in range(n):
            h = (h ^ flat[i: i + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        own = (owner[:m] == owner[n - 1:]) & fresh[n - 1:]
        if n == 1:
            own &= flat != 0  # a lone blank says nothing
        out.append((h & np.uint32(BUCKETS - 1))[own])
        whose.append(of[owner[:m][own]])
    return (np.concatenate(out), np.concatenate(whose)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def grams(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of some texts, and the index of the text each belongs to, in groups of a bounded size.

    Letters are lower-cased; anything else counts as one blank between words, as do both ends of a text.
    A long text comes in pieces that carry on from the last codes of the piece before, so each n-gram is counted once.
    """
    run, size = [], 0
    for i, t in enumerate(texts):
        low = (t or "").lower()
        head = np.zeros(1, np.uint32)
        for s in range(0, max(1, len(low)), PIECE):
            body, last = _letters_of(low[s: s + PIECE]), s + PIECE >= len(low)
            if last:
                body = np.append(body, np.uint32(0))
            run.append((i, head, body))
            size += len(body)
            if not last:
                line = np.concatenate([head, body])
                head = line[_single_blanks(line)][1 - max(ORDERS):]
            if size >= PIECE:
                yield _hashed(run)
                run, size = [], 0
    if run:
        yield _hashed(run)


@dataclass
class LanguageModel:
    """Log probabilities of some of the languages; the priors are those among all."""

    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    prior: np.ndarray

    def predict(self, texts: list) -> tuple[list, np.ndarray, np.ndarray]:
        """Best language of each text, its log probability, and the sum over the languages of probabilities relative to it.

        Of equally probable languages the first by code point is taken. Null and letterless texts have no language.
        """
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for bucket, of in grams(texts):
            if len(bucket):
                order = np.argsort(of, kind="stable")
                bucket, of = bucket[order], of[order]
                who, first = np.unique(of, return_index=True)
                # sparse counts times the matrix: the rows of a text's n-grams, added up
                for j in range(len(self.languages)):
                    total[who, j] += np.add.reduceat(self.log_prob[:, j][bucket], first, dtype=np.float64)
                count[who] += np.diff(np.append(first, len(bucket)))
        total += self.prior
        best = total.argmax(axis=1)
        top = total[np.arange(len(texts)), best]
        with np.errstate(under="ignore"):
            mass = np.exp(total - top[:, None]).sum(axis=1)
        return [self.languages[b] if k else None for b, k in zip(best, count > 0)], top, mass


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, block: int = BLOCK,
) -> Iterator[LanguageModel]:
    """Fit on rows with a label; the model comes in blocks of about ``block`` languages. Of each language about ``fit_rows`` rows are taken, by a hash of their text.

    Rows with a null label or text are not used. No labelled rows give no block. Labels and counts are tables; only the
    block in hand is on the driver.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    seen = keep(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "labels")
    whole = seen.agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows")).first()
    if not whole["labels"]:
        return
    often = seen.where(F.col("n") > fit_rows)
    few = often.limit(MAX_BROADCAST_LABELS + 1).count() <= MAX_BROADCAST_LABELS
    share = often.select("lang", (F.lit(float(fit_rows)) / F.col("n")).alias("share"))
    unit = F.pmod(F.xxhash64("text", F.lit(10)), F.lit(1_000_000)) / 1_000_000
    chosen = rows.join(F.broadcast(share) if few else share, "lang", "left").where(unit < F.coalesce("share", F.lit(1.0))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for code, got in sums.items():
                used = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([code] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(got[used].astype(np.int64))],
                    ["lang", "bucket", "n"],
                )
            sums.clear()

        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1)
            at = 0
            for run in slices(texts.to_pylist(), PIECE):
                codes = {x: i for i, x in enumerate(dict.fromkeys(langs[at: at + len(run)]))}
                code_of = np.array([codes[x] for x in langs[at: at + len(run)]])
                for bucket, of in grams(run):
                    for x, i in codes.items():
                        got = np.bincount(bucket[code_of[of] == i], minlength=BUCKETS)
                        sums[x] = sums.get(x, 0) + got
                        if len(sums) > OPEN_LABELS:  # counts of many labels do not gather in a task
                            yield from out()
                at += len(run)
        yield from out()

    blocks = -(-whole["labels"] // block)
    part = F.pmod(F.xxhash64("lang", F.lit(11)), F.lit(blocks)).cast("int")
    # of few languages the sample is small, so a few partitions hold it and the counts stay few
    spread = chosen.repartition(16) if blocks == 1 else chosen
    sums = spread.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if blocks > 1:
        sums, seen = keep(sums.withColumn("part", part), "counts"), seen.withColumn("part", part)
    for number in range(blocks):
        names, counted = (seen, sums) if blocks == 1 else (seen.where(F.col("part") == number), sums.where(F.col("part") == number))
        own = sorted((r["lang"], r["n"]) for r in names.select("lang", "n").collect())  # about ``block`` rows
        if not own:
            continue
        counts = np.zeros((BUCKETS, len(own)))
        place = {x: i for i, (x, _) in enumerate(own)}
        for r in counted.toLocalIterator():  # at most languages of the block x buckets rows
            counts[r["bucket"], place[r["lang"]]] = r["n"]
        smooth = counts + 0.5
        prior = np.log(np.array([n for _, n in own], dtype=float) / whole["rows"])
        yield LanguageModel([x for x, _ in own], np.log(smooth / smooth.sum(axis=0)).astype(np.float32), prior)


def _scored(text, model: LanguageModel, spark):
    """Column ``struct<lang string, top double, mass double>`` of a text column, see :meth:`LanguageModel.predict`."""
    shared = spark.sparkContext.broadcast(model)  # buckets x languages floats: 256 KB a language, 64 MB a full block

    @F.arrow_udf("struct<lang: string, top: double, mass: double>")
    def language(texts: pa.Array) -> pa.Array:
        langs, tops, masses = [], [np.zeros(0)], [np.zeros(0)]
        for run in slices(texts.to_pylist()):
            got, top, mass = shared.value.predict(run)
            langs += got
            tops.append(top)
            masses.append(mass)
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate(tops)), pa.array(np.concatenate(masses))], ["lang", "top", "mass"])

    return language(text)


# two blocks' results in one: the more probable language, and both masses relative to it
_JOINED = """CASE WHEN p IS NULL OR p.lang IS NULL THEN q WHEN q.top > p.top OR (q.top = p.top AND q.lang < p.lang)
THEN named_struct('lang', q.lang, 'top', q.top, 'mass', q.mass + p.mass * exp(p.top - q.top))
ELSE named_struct('lang', p.lang, 'top', p.top, 'mass', p.mass + q.mass * exp(q.top - p.top)) END"""


def predicted(rows: DataFrame, text, models: Iterator[LanguageModel]) -> DataFrame:
    """``(row, lang, score)`` for each row: language and posterior probability, ``und`` and 0 if it has none.

    One block of languages is one pass without a table; with more, each pass scores all rows against one
    block and keeps them with the best so far, so labels are bounded by time alone.
    """
    spark = rows.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    state = rows.select(whole.alias("row"), text.alias("text"), F.lit(None).cast("struct<lang:string,top:double,mass:double>").alias("p"))
    ahead, kept = next(models, None), None
    while ahead is not None:
        model, ahead = ahead, next(models, None)
        scored = state.select("row", "text", "p", _scored(F.col("text"), model, spark).alias("q"))
        state = scored.select("row", "text", F.expr(_JOINED if kept else "q").alias("p"))
        if ahead is not None:
            before, kept = kept, keep(state, "languages")
            state = kept
            if before is not None:
                drop_kept(before)
    known = F.col("p.lang").isNotNull()
    return state.select(
        "row", F.coalesce("p.lang", F.lit(UNKNOWN)).alias("lang"), F.when(known, 1 / F.col("p.mass")).otherwise(F.lit(0.0)).alias("score"),
        known.alias("known"),
    )


def held_out(key: str, folds: int = 3, fold: int = 1):
    """True where the CRC-32 of the key as text falls into the fold left out of fitting (null: as an empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, block: int = BLOCK,
) -> DataFrame:
    """``(key, held_out, lang_pred, score)`` for each row; fitted on the rows of ``docs`` that are not held out.

    Null or letterless texts are ``und`` with score 0, as is everything if no row has a label. Repeated
    rows are scored as often as given, texts whole at any length; other columns are not looked at. Any number of
    labels is accepted: every ``block`` of them costs a pass. Of languages tied for a text the first by code point is named.
    """
    models = fit(docs.where(~held_out(key)), text, lang, fit_rows, block)
    out = predicted(docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text).alias("text")), F.col("text"), models)
    return out.select(F.col("row")[key].alias(key), F.col("row.held_out").alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def keep_known(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows whose text has a recognised language with a posterior of at least ``least``; columns as given.

    Without any labelled row there is no language to tell from another: then only null and letterless texts go.
    """
    models = fit(docs.where(~held_out(key)), text, lang)
    first = next(models, None)
    if first is None:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    both = predicted(docs, F.col(f"`{text}`"), chain([first], models))
    sure = both.where(F.col("known") & (F.col("score") >= least))
    return sure.select(*[F.col("row")[c].alias(c) for c in docs.columns])
