r"""Periodic run detection: texts that repeat a phrase over and over.

The words of each text are sorted into an enhanced suffix array (see
``suffix_runs``), in groups of texts of bounded size; a run is a stretch of
words with smallest period q, at least ``max(LEAST, TIMES * q)`` long, that
no neighbouring word continues.  ``collapsed`` keeps the first q words of a
run and drops the rest.  One pass over the texts, no shuffle; a text is never
cut, so memory grows with the longest text (about 8 bytes a word and round of
doubling, the rounds being the logarithm of the longest repeat).

Defined cases: null and empty texts have no words and no run; whole texts are
read; repeated rows are handled each; ties between longest runs go to the
smallest start, then period; an empty table gives an empty result; extra
columns are ignored.  In the registered query a row without an id is never
rewritten.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .registry import read, register
from .suffix_runs import periodic_runs

#: Fewest words of a run, and fewest times its period.
LEAST, TIMES = 6, 4
#: Words sorted together; a longer text is sorted alone.
GROUP_WORDS = 1 << 18

Run = tuple[int, int, int]  # start, length, period


def split_words(text: str) -> list[bytes]:
    """The words between white space (space, tab to carriage return) as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def rewritten(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's test material: every tenth id, by checksum, goes on with its own words over and over."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs of each text, by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    numbered = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    found = periodic_runs(numbered.indices.to_numpy(), lengths, least, times)
    for text, *run in zip(*(c.tolist() for c in found)):
        out[text].append(tuple(run))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that stay when each run keeps its first period only."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, covered in zip(words, np.cumsum(change[:-1]).tolist()) if not covered]


def _row(words: list[bytes], runs: list[Run]) -> tuple:
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (len(runs), start, length, period, 1000 * length // period if runs else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())


_NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _groups(ids: list, texts: pa.Array, change) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of neighbouring rows, ``GROUP_WORDS`` or one text at a time."""
    group, words, total = [], [], 0
    for doc_id, text in zip(ids, texts):
        own = change(doc_id, split_words(text.as_py() or ""))
        if group and total + len(own) > GROUP_WORDS:
            yield group, words
            group, words, total = [], [], 0
        group.append(doc_id)
        words.append(own)
        total += len(own)
    if group:
        yield group, words


def detect(docs: DataFrame, change=lambda doc_id, words: words, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Runs and digests of ``doc_id, text``; ``change(doc_id, words)`` may replace a text's words first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _groups(batch.column("doc_id").to_pylist(), batch.column("text"), change):
                rows = zip(*map(_row, texts, runs_of(texts, least, times)))
                columns = [pa.array(list(c), pa.string() if name.endswith("sha256") else pa.int64())
                           for name, c in zip(_NAMES, rows)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], ["doc_id", *_NAMES])

    schema = ", ".join(f"{name} {'string' if name.endswith('sha256') else 'long'}" for name in _NAMES)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, f"doc_id long, {schema}")


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The rows with each run in ``text_col`` cut to its first period; only texts with a run change, others keep their white space."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, clean = batch.column(place), []
            for _, words in _groups([None] * batch.num_rows, texts, lambda _, own: own):
                for own, runs in zip(words, runs_of(words, least, times)):
                    old = texts[len(clean)].as_py()
                    clean.append(b" ".join(collapsed(own, runs)).decode("utf-8", "surrogatepass") if runs else old)
            columns = list(batch.columns)
            columns[place] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them rewritten as the contract says."""
    return detect(read(spark, sf_dir, "documents"), rewritten)
