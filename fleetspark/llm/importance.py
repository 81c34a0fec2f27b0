r"""Target-distribution importance resampling over hashed word n-grams.

A text is lower-cased (A-Z only), its separators collapse to single spaces,
and an overlapped scan with boundary lookarounds emits the span of every run
of ``low`` to ``high`` consecutive words; the spans' UTF-8 bytes are counted
by crc32 modulo ``buckets``.  Each bucket's gain is the smoothed log ratio of
its share in the target texts and in all documents, a document's weight is
the floored mean of its gains, and the draw is the Gumbel top-k of weight
plus noise fixed by the document id.

Counts cover all documents and all target texts: every task adds up its
buckets before they are summed.  The table of gains has ``buckets`` entries,
whatever the input.  Ranks come from sampled ranges, so no task sees all
scores.

Defined cases: null and empty texts have no feature and weight 0; whole
texts are read; repeated rows count and are drawn each; equal scores go to
the smaller doc_id, a null id comes last of equals and draws the noise of
the text ``2024:``; rows equal in id and score stand by weight and number of
features; without target texts (or documents) the other side's counts alone
decide; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .registry import read, register
from .staging import stage

#: Words of a feature, at least and at most, and the number of buckets.
LOW, HIGH = 1, 1
BUCKETS = 10_000
SEED = 2024
#: Documents with fewer words are never drawn; percent of the others that are.
MIN_WORDS = 20
PERCENT = 10


def _word_bytes() -> bytes:
    """Byte -> itself for digits, small letters and bytes of other characters, small for capitals, a space otherwise."""
    out = bytearray(b" " * 256)
    for b in chain(range(48, 58), range(97, 123), range(128, 256)):
        out[b] = b
    for b in range(65, 91):
        out[b] = b + 32
    return bytes(out)


_TABLE = _word_bytes()


def collapsed(text: str) -> bytes:
    """The words of a text, lower-cased, joined by single spaces."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split())


def span_patterns(low: int = LOW, high: int = HIGH) -> list[regex.Pattern]:
    """One pattern per length: that many words between single spaces, from one boundary to another."""
    return [regex.compile(rb"(?<![^ ])" + b" ".join([b"[^ ]++"] * n) + rb"(?![^ ])") for n in range(low, high + 1)]


def feature_buckets(text: str, patterns: list[regex.Pattern], buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every feature of a text."""
    line, crc = collapsed(text), zlib.crc32
    spans = chain.from_iterable(p.finditer(line, overlapped=True) for p in patterns)
    return np.fromiter((crc(m[0]) for m in spans), np.uint32) % np.uint32(buckets)


def features(docs: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features`` and the distinct ``buckets`` of a text with their ``counts``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = span_patterns(low, high)
        for batch in batches:
            words, totals, keys, counts, ends = [], [], [], [], [0]
            for text in batch.column("text"):
                text = text.as_py() or ""
                found, n = np.unique(feature_buckets(text, patterns, buckets), return_counts=True)
                totals.append(int(n.sum()))
                words.append(totals[-1] if low == high == 1 else len(collapsed(text).split()))
                keys.append(found)
                counts.append(n)
                ends.append(ends[-1] + len(found))
            flat = [pa.array(np.concatenate(c) if c else [], pa.int32()) for c in (keys, counts)]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), c) for c in flat]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(totals, pa.int64()),
                                              *lists], ["doc_id", "n_words", "n_features", "buckets", "counts"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>")


def bucket_totals(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; each task sends one row per bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    per_task = featured.select("buckets", "counts").mapInArrow(run, "bucket int, n long")
    for r in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    share = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weighted(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain of a row's features, 0 without any."""
    shared = featured.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("buckets")
            part = shared.value[keys.flatten().to_numpy()] * batch.column("counts").flatten().to_numpy()
            upto = np.concatenate([[0], np.cumsum(part)])
            ends = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            n = batch.column("n_features").to_numpy()
            weight = np.where(n > 0, (upto[ends[1:]] - upto[ends[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")),
                                              pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return featured.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number fixed by seed and id, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, low: int = LOW, high: int = HIGH,
             buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs`` (``doc_id, text``).

    ``target`` has ``text``.  ``rank`` is null for rows not drawn.  Texts are
    scanned once: their bucket counts are staged and read twice.
    """
    found = stage(spark, features(docs, low, high, buckets), "importance-features")
    wanted = features(target.select(F.lit(0).alias("doc_id"), "text"), low, high, buckets)
    gain = gains(bucket_totals(found, buckets), bucket_totals(wanted, buckets))
    scored = weighted(found, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = stage(spark, scored, "importance-scores")
    entered = F.col("n_words") >= min_words
    columns = ["doc_id", "n_features", "weight", "score"]
    ordered = scored.where(entered).select(*columns, (-F.col("score")).alias("_lower"), F.col("doc_id").isNull().alias("_no_id"))
    placed = number_rows(ordered, ["_lower", "_no_id", "doc_id", "weight", "n_features"], name="rank")
    drawn = F.floor(F.lit(percent) * scored.where(entered).count() / 100).cast("long")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return placed.select(*columns, rank.alias("rank")).unionByName(
        scored.where(~entered).select(*columns, F.lit(None).cast("long").alias("rank")))


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{_WORDS}') AS ws FROM documents),
tw AS (SELECT unnest(regexp_extract_all({_LOWERED}, '{_WORDS}')) AS w FROM benchmark),
df AS (SELECT r, unnest(ws) AS w FROM dw),
dn AS (SELECT r, w, count(*) AS n FROM df GROUP BY ALL),
tn AS (SELECT w, count(*) AS n FROM tw GROUP BY ALL),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dn UNION SELECT w FROM tn)),
vb AS (
  SELECT w, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(x) / 2 AS BIGINT)),
           lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, tbl[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) AS BIGINT) % {BUCKETS} AS b
  FROM v, crc),
s AS (SELECT b, sum(n) AS s FROM dn JOIN vb USING (w) GROUP BY b),
t AS (SELECT b, sum(n) AS t FROM tn JOIN vb USING (w) GROUP BY b),
z AS (SELECT CAST((SELECT coalesce(sum(s), 0) FROM s) AS DOUBLE) AS big_s, CAST((SELECT coalesce(sum(t), 0) FROM t) AS DOUBLE) AS big_t),
g AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + {BUCKETS})
                                 / ((coalesce(s, 0)::DOUBLE + 1) * (big_t + {BUCKETS})))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (b), z),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM dn JOIN vb USING (w) JOIN g USING (b) GROUP BY r),
w AS (
  SELECT doc_id, coalesce(n, 0) AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
         CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM dw LEFT JOIN m USING (r)),
k AS (
  SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight,
         CAST(weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM w),
p AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS}
                               ORDER BY score DESC, doc_id ASC NULLS LAST, weight, n_features) AS place FROM k)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {MIN_WORDS} AND place <= {PERCENT} * (SELECT count(*) FROM k WHERE n_features >= {MIN_WORDS}) // 100
            THEN place END AS rank
FROM p
"""


@register("op13_importance_resampling", _SQL)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark texts, with the draw."""
    return resample(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
