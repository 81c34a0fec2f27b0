"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed groups of one to three character classes plus marks for
repeated words, weighted by root frequency and inverse document frequency.
A truncated singular value decomposition of a bounded labelled sample gives
the latent axes.  The sample's latent vectors (at most ``SAMPLE`` rows of
``AXES`` floats) are broadcast; every document is compared with all of them
in blocks of exact cosine products, and its ``NEIGHBOURS`` nearest vote with
their similarity as weight.

Document frequencies count all documents.  The labelled sample is the
``SAMPLE`` labelled ids of documents with the smallest hash, and of their
distinct texts the ``SAMPLE`` with the smallest hash, a documented bound of
the classifier; repeated labels and rows change nothing.

Defined cases: null and empty texts have the zero vector, are nearest to
nothing and get the sample's share of label 1; rows without ``doc_id`` are
scored, never learnt from; without labels every score is 0.5; texts of any
length are read whole, in slices cut at white space (repeats are counted over
all slices of a text, a group of characters across two slices is not); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import held_out, learnable
from .labelled import with_label
from .registry import read, register
from .slices import text_slices
from .word_hash import mix, word_hashes

TERM_BITS = 10
TERMS = (1 << TERM_BITS) + 2  # two more for repeated words and repeated word triples
AXES = 48
SAMPLE = 8192
NEIGHBOURS = 25
THRESHOLD = 0.7
#: Documents compared with the sample at once.
BLOCK = 512


@cache
def _classes() -> np.ndarray:
    """Code point -> class: lower, upper, other letter, digit, or the character itself for ASCII marks."""
    table = np.full(0x110000, 5, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if c < 128 and not s.isalnum():
            table[c] = 10 + c
        elif s.islower():
            table[c] = 1
        elif s.isupper():
            table[c] = 2
        elif s.isalpha():
            table[c] = 3
        elif s.isdigit():
            table[c] = 4
    return table


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``BLOCK`` rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            yield batch.slice(lo, BLOCK)


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term counts (texts x ``TERMS``) and the total of hashed terms and of words per text."""
    n = len(texts)
    counts, totals = np.zeros((n, TERMS), np.float32), np.zeros((n, 2))
    shift = np.uint32(32 - TERM_BITS)
    tail, tail_of, held = np.zeros(0, np.uint64), -1, []  # the last words and the triples of a text that may go on

    def count_held() -> None:
        if held:
            triples = np.sort(np.concatenate(held))
            counts[tail_of, -1] += np.count_nonzero(triples[1:] == triples[:-1])
            held.clear()

    for numbers, part in text_slices(texts):
        rows = np.array(numbers)
        joined = "\x00".join(part) + "\x00"
        c = _classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(rows, np.fromiter(map(len, part), np.int64, len(part)) + 1)
        inside = c != 10  # the class of the separator
        one = c * np.uint32(0x9E3779B1)
        two = one[1:] ^ (c[:-1] * np.uint32(0x85EBCA77))
        three = two[1:] ^ (c[:-2] * np.uint32(0xC2B2AE3D))
        ok2 = inside[1:] & inside[:-1]
        ok3 = ok2[1:] & inside[:-2]
        for h, ok, own in ((one, inside, owner), (two, ok2, owner[1:]), (three, ok3, owner[2:])):
            h = (h[ok] ^ (h[ok] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift
            cells = own[ok] * np.int64(TERMS) + h
            low = int(rows[0]) * TERMS
            got = np.bincount(cells - low, minlength=(int(rows[-1]) + 1) * TERMS - low)
            counts[rows[0]:rows[-1] + 1] += got.reshape(-1, TERMS)
            totals[:, 0] += np.bincount(own[ok], minlength=n)
        words, at = word_hashes(part)
        if rows[0] != tail_of:
            count_held()
            tail, tail_of = tail[:0], rows[0]
        totals[:, 1] += np.bincount(rows[at], minlength=n)
        words, of = np.r_[tail, words], np.r_[np.full(len(tail), tail_of), rows[at]]
        new = np.arange(len(words)) >= len(tail)
        same = np.r_[False, (words[1:] == words[:-1]) & (of[1:] == of[:-1])][:len(words)] & new
        counts[:, -2] += np.bincount(of[same], minlength=n)
        triple = mix(words[2:] ^ mix(words[1:-1] ^ mix(words[:-2])))
        whole = (of[2:] == of[:-2]) & new[2:]
        triple, own = triple[whole], of[2:][whole]
        held.append(triple[own == tail_of])
        if rows[-1] != tail_of:
            count_held()
            order = np.lexsort((triple, own))
            triple, own = triple[order], own[order]
            again = (triple[1:] == triple[:-1]) & (own[1:] == own[:-1]) & (own[1:] != tail_of) & (own[1:] != rows[-1])
            counts[:, -1] += np.bincount(own[1:][again], minlength=n)
            tail_of = rows[-1]
            held.append(triple[own == tail_of])
        tail = words[of == tail_of][-2:]
    count_held()
    return counts, totals


def weigh(counts: np.ndarray, totals: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Root frequencies times ``idf``, rows of length 1 (or 0 without terms)."""
    x = counts.copy()
    x[:, :-2] /= np.maximum(totals[:, :1], 1)
    x[:, -2:] /= np.maximum(totals[:, 1:], 1)
    x = np.sqrt(x) * idf
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0).astype(np.float32)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency per term, over all documents' ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(TERMS + 1, np.int64)
        for part in _blocks(batches):
            counts, _ = term_counts(part.column("text"))
            have[:-1] += (counts > 0).sum(axis=0)
            have[-1] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1, dtype=np.int32)), pa.array(have)], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    have = np.zeros(TERMS + 1)
    for r in found:
        have[r["term"]] = r["n"]
    return (np.log((1 + have[-1]) / (1 + have[:-1])) + 1).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # TERMS x AXES
    vectors: np.ndarray  # labelled rows x AXES, unit length
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def project(self, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        return _unit(weigh(counts, totals, self.idf) @ self.axes)


def fit(rows: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``doc_id, text, label`` rows (at most ``sample`` of the distinct ones) and all ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            counts, totals = term_counts(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("h"), part.column("doc_id"), part.column("label"), pa.FixedSizeListArray.from_arrays(counts.ravel(), TERMS).cast(pa.list_(pa.float32())),
                 pa.array(totals[:, 0]), pa.array(totals[:, 1])], ["h", "doc_id", "label", "counts", "n_terms", "n_words"])

    idf = inverse_frequencies(docs)
    found = (rows.groupBy("doc_id", "text").agg(F.max("label").alias("label"))  # an id may stand in several rows
             .select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text", "label")
             .mapInArrow(run, "h long, doc_id long, label int, counts array<float>, n_terms double, n_words double")
             .orderBy("h", "doc_id", "n_terms", "n_words").limit(sample).toArrow())
    if not found.num_rows:
        return Model(idf, np.zeros((TERMS, AXES), np.float32), np.zeros((0, AXES), np.float32), np.zeros(0, np.float32))
    counts = found.column("counts").combine_chunks().flatten().to_numpy().reshape(found.num_rows, TERMS)
    totals = np.stack([found.column(c).to_numpy() for c in ("n_terms", "n_words")], axis=1)
    x = weigh(counts, totals, idf)
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    top = axes[:, np.argsort(-values)[:AXES]].astype(np.float32)
    return Model(idf, top, _unit(x @ top), found.column("label").to_numpy().astype(np.float32))


def vote(vectors: np.ndarray, model: Model) -> np.ndarray:
    """Similarity-weighted share of label 1 among each row's nearest labelled rows."""
    n = len(model.labels)
    if not n:
        return np.full(len(vectors), 0.5)
    k, out = min(model.neighbours, n), np.empty(len(vectors))
    for lo in range(0, len(vectors), BLOCK):
        cosine = vectors[lo:lo + BLOCK] @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(cosine), 1))
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64)
        total = weight.sum(axis=1)
        share = (weight * model.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        out[lo:lo + BLOCK] = np.where(total > 0, share, model.labels.mean())
    return np.clip(out, 0, 1)


def score(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` from ``doc_id, held_out, text``."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            p = vote(shared.value.project(*term_counts(part.column("text"))), shared.value)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def sample_labels(labels: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, quality`` of the ``sample`` labelled ids of ``docs`` with the smallest hashes; the greatest label of an id."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    return (known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))


@register("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt outside the held-out quarter."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = read(spark, sf_dir, "labels").where(learnable(F.col("doc_id"), 4, 2) & F.col("quality").isin(0, 1))
    model = fit(with_label(docs, sample_labels(labels, docs), "quality"), docs)
    return score(spark, docs.withColumn("held_out", held_out(F.col("doc_id"), 4, 2)), model)
