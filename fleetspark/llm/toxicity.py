"""Toxicity from class-conditional Kneser-Ney models of word pairs.

Each class has a bigram model over its learnt texts, every text between two
borders.  A pair's count ``c`` is the number of distinct texts of the class
that hold it, so copies count no more than one.  With ``C(v)`` the sum and
``M(v)`` the number of the pairs that ``v`` begins there,

    P(w | v) = max(c(v, w) - 1, 0) / C(v)  +  M(v) / C(v) * P(w)

is the highest order (absolute discount 1; a word that begins no pair leaves
all to ``P(w)``).  ``P(w)`` comes from the class's continuation counts (the
distinct words before ``w``) at discount ``DISCOUNT`` and interpolates with
the same of both classes' pooled pairs, the shared backoff, which ends in one
share for all unknown words.

The log-likelihood difference of a text is a sum of weights of its words and
pairs: ``log P(w)`` and ``log M(v) / C(v)`` belong to words, what a pair's own
count adds to them to the pair.  A pair in at most one text of either class
adds exactly 0, so the table of weights holds all words and the other pairs.
The curve sees the whole difference by length and, by root of length, the
weights of a text's distinct words (an unknown word's taken off) and of its
distinct pairs, each summed in bands of how far (in standard deviations) the
counts differ between the classes; a logistic curve fitted on labelled rows
that gave no counts weighs them.

Counts come from every labelled row that may be learnt from, and weights grow
with the table: the ``HOT_TERMS`` most frequent are broadcast, texts are
joined with the rest.  Both give the same sums.  A word is its 32-bit hash.

Defined cases: null and empty texts are scored like any text, from no words;
rows without ``doc_id`` are scored, never learnt from; of labels that repeat
for an id the greatest counts; without labels of both classes every score is
the learnt share of label 1; texts of any length are read whole, in slices cut at
white space; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .folds import held_out, learnable
from .labelled import with_label
from .registry import read, register
from .slices import text_slices
from .staging import stage
from .word_hash import mix, word_hashes

#: Word codes: 0 marks a word's own term, 1 is the border of a text.
BORDER, FIRST_WORD = 1, 2
DISCOUNT = 0.75
#: Bands of the difference between the classes, in standard deviations; their sums are kept apart for words and pairs.
BANDS = (2.0, 4.0, 8.0)
SUMS = 2 * (len(BANDS) + 1) + 1
#: Terms that are broadcast (13 bytes each), and bits of the filter that spares the join terms without a weight.
HOT_TERMS = 1 << 22
FILTER_BITS = 28
#: One learnable row in so many gives no counts; at most so many of these fit the curve.
CALIBRATION_SHARE = 6
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.7


@dataclass
class Terms:
    """Broadcast: the frequent terms (ascending) with their sum and weight, an unknown word's weight, a filter for the rest."""

    term: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int8))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    unknown: float = 0.0
    rest: np.ndarray | None = None


@dataclass
class Model:
    """Weights (``rest``: ``term, place, weight`` of the terms that are not broadcast) and the curve."""

    terms: Broadcast
    rest: DataFrame | None = None
    offset: float = 0.0
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(SUMS + 1))


def _pairs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, pair)`` of all adjacent words of the texts, slice by slice; ascending rows, each text between two borders."""
    row, code = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for numbers, texts in text_slices(column):
        h, owner = word_hashes(texts)
        part_row = np.array(numbers, np.int64)
        begins = np.flatnonzero(np.diff(part_row, prepend=row[-1] if len(row) else -1))
        at = np.searchsorted(owner, begins)
        row = np.r_[row, np.insert(part_row[owner], at, part_row[begins])]
        code = np.r_[code, np.insert(np.maximum(h >> np.uint64(32), np.uint64(FIRST_WORD)), at, np.uint64(BORDER))]
        yield row[:-1], (code[:-1] << np.uint64(32) | code[1:]).view(np.int64)
        row, code = row[-1:], code[-1:]
    if len(row):
        yield row, (code << np.uint64(32) | np.uint64(BORDER)).view(np.int64)


def _counted(row: np.ndarray, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each ``row, term`` once, with the sum of its ``times``."""
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])][:len(row)])
    return row[first], term[first], np.add.reduceat(times[order], first) if len(first) else times


def text_pairs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, pair, times)`` with every pair of a text once; a text's pairs come together."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for row, pair in _pairs(column):
        held = _counted(np.r_[held[0], row], np.r_[held[1], pair], np.r_[held[2], np.ones(len(row), np.int64)])
        cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
        yield tuple(x[:cut] for x in held)
        held = tuple(x[cut:] for x in held)
    yield held


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, n_1, n_0``: distinct texts per word pair and class, from ``text, label``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            for row, pair, _ in text_pairs(batch.column("text")):
                label = labels[row]
                _, pair, n = _counted(np.zeros(len(row), np.int64), pair, label << 32 | 1 - label)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pair, n >> 32, n & 0xFFFFFFFF)], ["pair", "n_1", "n_0"])

    texts = rows.select(F.coalesce("text", F.lit("")).alias("text"), "label").distinct()
    return (texts.mapInArrow(run, "pair long, n_1 long, n_0 long")
            .groupBy("pair").agg(F.sum("n_1").alias("n_1"), F.sum("n_0").alias("n_0")))


def term_counts(pairs: DataFrame) -> DataFrame:
    """Counts of words and of pairs in two or more texts of a class, from ``pair, n_1, n_0``.

    ``before_c``, ``before``: distinct words before a word in class ``c``, in
    either; ``c_c``: a pair's texts, or the sum over the pairs that a word
    begins; ``m_c``: the number of those.
    """
    n_1, n_0, zero = F.col("n_1"), F.col("n_0"), F.lit(0).cast("long")
    in_1, in_0 = (n_1 > 0).cast("long"), (n_0 > 0).cast("long")
    names = ["term", "before_1", "before_0", "before", "c_1", "c_0", "m_1", "m_0"]

    def entry(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, names)])

    last, first = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("pair", 32)
    own = F.when((n_1 > 1) | (n_0 > 1), entry(F.col("pair"), zero, zero, zero, n_1, n_0, zero, zero))
    return (pairs.select(F.inline(F.array(entry(last, in_1, in_0, F.lit(1).cast("long"), zero, zero, zero, zero),
                                          entry(first, zero, zero, zero, n_1, n_0, in_1, in_0), own)))
            .where("term is not null").groupBy("term").agg(*[F.sum(n).alias(n) for n in names[1:]]))


def _band(n_1: Column, n_0: Column, share: float) -> Column:
    """Number of ``BANDS`` that the difference between the classes passes."""
    n = n_1 + n_0
    z = F.abs(n_1 - n * share) / F.sqrt(n * (share * (1 - share)) + F.lit(0.5))
    return sum((z > edge).cast("int") for edge in BANDS)


def term_weights(counts: DataFrame) -> tuple[DataFrame, float] | None:
    """``term, place, weight, texts`` and the weight of an unknown word, from ``term_counts``; None without both classes."""
    is_word = F.col("term").between(0, 0xFFFFFFFF)
    words, pairs = counts.where(is_word), counts.where(~is_word)
    t = words.agg(*[F.sum(c).alias(c) for c in ("before_1", "before_0", "before", "c_1", "c_0")], F.count("*").alias("words"),
                  F.sum((F.col("before_1") > 0).cast("long")).alias("words_1"),
                  F.sum((F.col("before_0") > 0).cast("long")).alias("words_0")).first()
    if not t["before_1"] or not t["before_0"]:
        return None
    shared = (F.col("before") - DISCOUNT + DISCOUNT * t["words"] / (t["words"] + 1)) / t["before"]
    left = {c: DISCOUNT * t[f"words_{c}"] / t[f"before_{c}"] for c in "10"}
    low = {c: F.greatest(F.col(f"before_{c}") - DISCOUNT, F.lit(0.0)) / t[f"before_{c}"] + shared * left[c] for c in "10"}
    backoff = {c: F.when(F.col(f"c_{c}") > 0, F.col(f"m_{c}") / F.col(f"c_{c}")).otherwise(1.0) for c in "10"}
    unknown = float(np.log(left["1"] / left["0"]))
    word_weights = words.select(
        "term", _band(F.col("before_1"), F.col("before_0"), t["before_1"] / (t["before_1"] + t["before_0"])).alias("place"),
        (F.log(low["1"] * backoff["1"]) - F.log(low["0"] * backoff["0"]) - unknown).alias("weight"),
        (F.col("c_1") + F.col("c_0")).alias("texts"))

    firsts = words.select(F.col("term").alias("first"), F.col("m_1").alias("first_1"), F.col("m_0").alias("first_0"))
    lasts = words.select(F.col("term").alias("last"), low["1"].alias("low_1"), low["0"].alias("low_0"))
    own = {c: F.when(F.col(f"c_{c}") > 1, F.log1p((F.col(f"c_{c}") - 1) / (F.col(f"first_{c}") * F.col(f"low_{c}")))).otherwise(0.0)
           for c in "10"}
    pair_weights = (
        pairs.select("term", "c_1", "c_0", F.shiftrightunsigned("term", 32).alias("first"),
                     F.col("term").bitwiseAND(F.lit(0xFFFFFFFF)).alias("last"))
        .join(firsts, "first").join(lasts, "last")
        .select("term", (_band(F.col("c_1"), F.col("c_0"), t["c_1"] / (t["c_1"] + t["c_0"])) + len(BANDS) + 1).alias("place"),
                (own["1"] - own["0"]).alias("weight"), (F.col("c_1") + F.col("c_0")).alias("texts")))
    return word_weights.unionByName(pair_weights).withColumn("weight", F.col("weight").cast("float")), unknown


def _slot(term: np.ndarray) -> np.ndarray:
    return mix(mix(term.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - FILTER_BITS)


def _filter(rest: DataFrame) -> np.ndarray:
    """Bits set at the slots of all terms of ``rest``, as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column("term").to_numpy())
            bits = np.uint64(1) << (slot & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).view(np.int64)), pa.array(bits.view(np.int64))],
                                             ["slot", "bits"])

    found = rest.select("term").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _hot(weights: DataFrame, unknown: float, most: int) -> tuple[Terms, DataFrame | None]:
    """The ``most`` most frequent of ``term, place, weight, texts`` to broadcast, and the rest."""
    sizes = sorted(weights.groupBy("texts").count().collect(), reverse=True)
    upto = np.cumsum([r["count"] for r in sizes])
    taken = int(np.searchsorted(upto, most, side="right"))
    least = sizes[taken - 1]["texts"] if taken else sizes[0]["texts"] + 1
    hot = weights.where(F.col("texts") >= least).select("term", F.col("place").cast("byte").alias("place"), "weight").toArrow().sort_by("term")
    terms = Terms(*[hot.column(c).to_numpy() for c in ("term", "place", "weight")], unknown)
    if taken == len(sizes):
        return terms, None
    rest = weights.where(F.col("texts") < least).select("term", "place", "weight")
    terms.rest = _filter(rest)
    return terms, rest


def _known(terms: Terms, row: np.ndarray, term: np.ndarray, times: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Adds the weights of the broadcast terms to ``sums``; which of the others the filter lets through."""
    known = np.zeros(len(term), bool)
    if len(terms.term) and len(term):
        at = np.minimum(np.searchsorted(terms.term, term), len(terms.term) - 1)
        known = terms.term[at] == term
        row, at, times = row[known], at[known], times[known]
        n, weight = len(sums), terms.weight[at].astype(float)
        sums[:, :-1] += np.bincount(row * (SUMS - 1) + terms.place[at], weight, n * (SUMS - 1)).reshape(n, -1)
        sums[:, -1] += np.bincount(row, weight * times, n)
    if terms.rest is None:
        return np.zeros(len(term), bool)
    slot = _slot(term)
    return ~known & (terms.rest[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def evidence(spark: SparkSession, docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """``keep`` and what the curve weighs, ``x_0``..., from ``text``: sums in bands by root of length, the whole by length, log length."""
    shared = model.terms
    joins = model.rest is not None
    sums = [f"s_{k}" for k in range(SUMS)]
    kept = ["row", *keep] if joins else keep
    docs = docs.withColumn("row", F.monotonically_increasing_id()) if joins else docs
    schema = StructType([*docs.select(*kept).schema.fields, StructField("length", LongType()), *[StructField(s, DoubleType()) for s in sums]])
    if joins:
        schema = schema.add("terms", ArrayType(LongType())).add("times", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in batches:
            n = batch.num_rows
            x, length, left = np.zeros((n, SUMS)), np.zeros(n, np.int64), []
            for row, pair, times in text_pairs(batch.column("text")):
                for rows, term, many in ((row, pair, times), _counted(row, pair & 0xFFFFFFFF, times)):
                    open_ = _known(terms, rows, term, many, x)
                    if joins:
                        left.append((rows[open_], term[open_], many[open_]))
                length += np.bincount(row, times, n).astype(np.int64)
            x[:, -1] += terms.unknown * length
            arrays = [*[batch.column(c) for c in kept], pa.array(length), *[pa.array(c) for c in x.T]]
            if joins:
                rows, term, many = (np.concatenate([part[k] for part in left]) for k in range(3))
                order = np.argsort(rows, kind="stable")
                offsets = pa.array(np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32))
                arrays += [pa.ListArray.from_arrays(offsets, pa.array(term[order])),
                           pa.ListArray.from_arrays(offsets, pa.array(many[order].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    out = docs.select(*kept, "text").mapInArrow(run, schema)
    if joins:
        out = stage(spark, out, "toxicity")
        found = (out.select("row", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("row", "t.terms", "t.times")
                 .join(model.rest, F.col("terms") == F.col("term")))
        more = found.groupBy("row").agg(*[F.sum(F.when(F.col("place") == k, F.col("weight").cast("double"))).alias(f"more_{k}") for k in range(SUMS - 1)],
                                        F.sum(F.col("weight").cast("double") * F.col("times")).alias(f"more_{SUMS - 1}"))
        out = out.drop("terms", "times").join(more, "row", "left").select(
            *keep, "length", *[(F.col(s) + F.coalesce(F.col(f"more_{k}"), F.lit(0.0))).alias(s) for k, s in enumerate(sums)])
    x = [F.col(s) / F.sqrt("length") for s in sums[:-1]] + [F.col(sums[-1]) / F.col("length"), F.log("length")]
    return out.select(*keep, *[c.alias(f"x_{k}") for k, c in enumerate(x)])


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 100) -> tuple[float, np.ndarray]:
    """Ridge logistic regression by damped Newton steps: offset and slopes; a constant column has slope 0."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, np.inf)
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), slope)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[1:] / scale
    return float(w[0] - slopes @ centre), slopes


def fit(rows: DataFrame, counts_from: Column, calibrate_on: Column, hot_terms: int = HOT_TERMS) -> Model:
    """A model from ``doc_id, text, label``; the two conditions are disjoint."""
    spark = rows.sparkSession
    found = term_weights(stage(spark, term_counts(pair_counts(rows.where(counts_from))), "toxicity"))
    terms, rest = _hot(stage(spark, found[0], "toxicity"), found[1], hot_terms) if found else (Terms(), None)
    model = Model(spark.sparkContext.broadcast(terms), rest)
    names = [f"x_{k}" for k in range(SUMS + 1)]
    sample = (evidence(spark, rows.where(calibrate_on).select("text", "label", F.xxhash64("doc_id").alias("h")), ["label", "h"], model)
              .orderBy("h", *names).limit(CALIBRATION_ROWS).toArrow())
    y = sample.column("label").to_numpy().astype(float)
    if found and 0 < y.sum() < len(y):
        model.offset, model.slopes = _curve(np.stack([sample.column(c).to_numpy() for c in names], axis=1), y)
    else:
        share = (y.sum() + 1) / (len(y) + 2)
        model.offset = float(np.log(share / (1 - share)))
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` from ``doc_id, held_out, text``."""
    at = sum((F.col(f"x_{k}") * float(w) for k, w in enumerate(model.slopes)), F.lit(model.offset))
    p = 1 / (1 + F.exp(-F.greatest(F.least(at, F.lit(30.0)), F.lit(-30.0))))
    return (evidence(spark, docs, ["doc_id", "held_out"], model).select("doc_id", "held_out", p.alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt outside the held-out third."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = read(spark, sf_dir, "labels")
    doc_id = F.col("doc_id")
    rows = with_label(docs, labels.where(learnable(doc_id, 3, 1)), "toxic")
    calibration = F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 3) % CALIBRATION_SHARE == 0
    model = fit(rows, ~calibration, calibration)
    return score(spark, docs.withColumn("held_out", held_out(doc_id, 3, 1)), model)
