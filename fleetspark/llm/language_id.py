"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased letters with every other character as a boundary;
features are the two- and three-letter groups inside a word and at its
edges, hashed to ``BITS`` bits whatever the input.  Counts per language and
bucket come from all rows that may be learnt from and are staged.  Languages
are scored in blocks of ``LANGUAGES``: a block's log-probability matrix (32 MB)
is broadcast, matrix rows are summed per document in numpy, and the best
language and the sum of likelihoods so far go on to the next block with the
row.  So the number of languages, however large, changes neither the features
nor what a driver or an executor holds; it costs a pass over the texts per
block.

Defined cases: a null text and a text without a letter give ``und`` with
score 0; with no language to learn from every row does; repeated rows are
learnt and scored each; rows without ``doc_id`` are scored, never learnt
from; texts of any length are read whole, in slices cut at white space; an
empty table gives an empty result; extra columns are ignored.  Equal
likelihoods go to the smallest language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .folds import held_out, learnable
from .registry import read, register
from .slices import text_slices

BITS = 16
#: Languages scored together.
LANGUAGES = 64
ALPHA = 0.5
#: Languages whose counts a worker holds before it sends them on.
_HELD = 32


@cache
def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, 0 for anything else."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            table[c] = ord(s.lower()[0])
    return table


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, text number, has a letter per text)`` of all n-grams of the texts."""
    joined = "\n".join(texts) + "\n"
    c = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    c = np.concatenate([np.zeros(2, np.uint32), c])  # c[i], c[i + 1], c[i + 2] end at text character i
    a, b, z = c[:-2], c[1:-1], c[2:]
    shift = np.uint32(32 - bits)
    pair = (b * np.uint32(0x9E3779B1) ^ z * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
    triple = (pair ^ a * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + np.uint32(1)
    in_pair = (b | z) != 0  # a letter with its neighbour or with an edge
    in_triple = (b != 0) & ((a | z) != 0)
    bucket = np.concatenate([pair[in_pair] >> shift, triple[in_triple] >> shift])
    seen = np.zeros(len(texts), bool)
    seen[owner[z != 0]] = True
    return bucket, np.concatenate([owner[in_pair], owner[in_triple]]), seen


def count_features(rows: DataFrame, bits: int) -> DataFrame:
    """``lang, bucket, n`` summed over all rows of ``lang, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                    ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for numbers, texts in text_slices(batch.column("text")):
                names = [langs[r] for r in numbers]
                distinct = {lang: i for i, lang in enumerate(dict.fromkeys(names))}
                own = np.array([distinct[lang] for lang in names])
                bucket, owner, _ = features(texts, bits)
                lang_of = own[owner]
                for lang, i in distinct.items():
                    if lang not in held and len(held) >= _HELD:
                        yield from send()
                    counts = np.bincount(bucket[lang_of == i] if len(distinct) > 1 else bucket, minlength=1 << bits)
                    held[lang] = held[lang] + counts if lang in held else counts
        yield from send()

    found = rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


#: A block of languages: names, log priors, buckets x languages log probabilities.
Model = tuple[list[str], np.ndarray, np.ndarray]


def fit(spark: SparkSession, rows: DataFrame, alpha: float = ALPHA, block: int = LANGUAGES) -> Iterator[Model]:
    """The model of ``lang, text`` block by block, languages in order."""
    counts = stored(spark, count_features(rows, BITS), "language-counts")
    priors = stored(spark, rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-priors")
    n_rows = priors.agg(F.sum("n")).first()[0]
    last = None
    while True:
        rest = priors if last is None else priors.where(F.col("lang") > F.lit(last))
        own = rest.orderBy("lang").limit(block).collect()
        if own:
            langs = [r["lang"] for r in own]
            found = counts.where(F.col("lang").isin(langs)).toArrow()  # at most 2^BITS rows a language
            at = {lang: i for i, lang in enumerate(langs)}
            cells = np.full((1 << BITS, len(langs)), alpha)
            column = np.array([at[lang] for lang in found.column("lang").to_pylist()], np.int64)
            cells[found.column("bucket").to_numpy(), column] += found.column("n").to_numpy()
            yield langs, np.log(np.array([r["n"] for r in own], float) / n_rows), np.log(cells / cells.sum(axis=0))
        if len(own) < block:
            return
        last = own[-1]["lang"]


def log_likelihoods(texts: pa.Array, prior: np.ndarray, log_p: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(texts x languages log likelihoods with priors, which texts have a letter)``."""
    n = len(texts)
    total, any_letter = np.tile(prior, (n, 1)), np.zeros(n, bool)
    for numbers, part in text_slices(texts):
        rows = np.array(numbers)
        bucket, owner, seen = features(part, bits)
        any_letter[rows[seen]] = True
        for i in range(len(prior)):
            np.add.at(total[:, i], rows, np.bincount(owner, weights=log_p[bucket, i], minlength=len(part)))
    return total, any_letter


def _scored(spark: SparkSession, rows: DataFrame, model: Model, last: bool) -> DataFrame:
    """``rows`` with ``lang, best, total`` brought up to date by one block; the text goes on unless it is the last."""
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in ("doc_id", "held_out", "text") if c != "text" or not last]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, log_p = shared.value
        for batch in batches:
            found, known = log_likelihoods(batch.column("text"), prior, log_p)
            at = found.argmax(axis=1)
            top = found.max(axis=1)
            here = np.exp(found - top[:, None]).sum(axis=1)  # likelihoods relative to the block's best
            best, total = batch.column("best").to_numpy(zero_copy_only=False), batch.column("total").to_numpy(zero_copy_only=False)
            new = np.maximum(best, top)
            lang = [langs[i] if k and better else old for i, k, better, old in
                    zip(at, known, top > best, batch.column("lang").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(lang, pa.string()), pa.array(new),
                 pa.array(total * np.exp(best - new) + here * np.exp(top - new))], [*kept, "lang", "best", "total"])

    types = {"doc_id": "long", "held_out": "boolean", "text": "string"}
    return rows.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), "lang string", "best double", "total double"]))


def predict(spark: SparkSession, docs: DataFrame, models: Iterator[Model]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` from ``doc_id, held_out, text``; the score is the posterior probability.

    Between two blocks the rows are checkpointed, so that one block's matrix
    is held at a time.
    """
    rows = docs.select("doc_id", "held_out", "text", F.lit(None).cast("string").alias("lang"),
                       F.lit(float("-inf")).alias("best"), F.lit(0.0).alias("total"))
    model = next(models, None)
    while model is not None:
        following = next(models, None)
        rows = _scored(spark, rows, model, following is None)
        if following is not None:
            rows = rows.checkpoint()
        model = following
    return rows.select("doc_id", "held_out", F.coalesce("lang", F.lit("und")).alias("lang_pred"),
                       F.when(F.col("lang").isNull(), 0.0).otherwise(1 / F.col("total")).alias("score"))


@register("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out third."""
    docs = read(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    models = fit(spark, docs.where(learnable(doc_id, 3, 1) & F.col("lang").isNotNull()).select("lang", "text"))
    return predict(spark, docs.select(doc_id.cast("long").alias("doc_id"), held_out(doc_id, 3, 1).alias("held_out"), "text"), models)
