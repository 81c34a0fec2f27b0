r"""Secret scan: fixed patterns plus formats inferred from labelled credentials.

Base spans come from three patterns (assignments, access keys, long hex).
Their values, gathered from all documents, are the labelled credentials: a
bounded sample per kind (``SAMPLE`` distinct values, by hash) trains one
probabilistic automaton per kind, and as large a sample of candidates trains
one automaton of ordinary text per sort of token (short or long; with or
without digits, small letters, capitals), so that common sorts do not crowd
out rare ones.  Candidates are the tokens of ``MIN_TOKEN``
characters or more, as short as a labelled value may be; base spans are cut
out of a token, and each part that remains is a candidate of its own, as it
is and without the marks at its ends.  A candidate is added as a span
``format`` where some credential automaton explains its characters better
than all of ordinary text by ``MARGIN`` nats.  Base spans always stay.

Defined cases: null and empty texts have no span; whole texts are read,
positions count code points; repeated rows are scanned each; with too few
labelled values no automaton is trained and only base spans remain; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.topk import top_k
from .grammar import Automaton, shape
from .registry import read, register

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Fewest characters of an assigned value, and so of a candidate.
MIN_TOKEN = 8
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_TOKEN)
_MARKS = "+/_.=-"
#: Ordinary tokens of this length or more are a sample of their own.
LONG_TOKEN = 16
_SORTS = [re.compile(p) for p in ("[0-9]", "[a-z]", "[A-Z]")]
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a shorter first match never hides a longer one of the same run
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Values per kind that train an automaton, and the fewest that do.
SAMPLE = 1500
FEWEST = 20
#: Characters of a value that training looks at.
TRAIN_CHARS = 128
MARGIN = 7.0

Span = tuple[int, int, int]  # start, kind number, end


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, str]], list[tuple[int, int]]]:
    """Base spans in order, labelled values ``(kind number, value)`` and the places of the candidates."""
    spans: list[Span] = []
    values: list[tuple[int, str]] = []
    lowered = text.lower()
    if any(w in lowered for w in _WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= MIN_TOKEN:
                spans.append((m.start(), 0, m.end()))
                values.append((0, m[2]))
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    for lo, hi in tokens:
        for kind, pattern in ((1, _ACCESS), (2, _HEX)):
            for m in pattern.finditer(text, lo, hi):
                spans.append((m.start(), kind, m.end()))
                values.append((kind, m[0]))
    spans.sort()
    if spans:
        tokens = _uncovered(tokens, spans)
    return spans, values, tokens


def _uncovered(tokens: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int]]:
    """The parts of the tokens that no span covers, of ``MIN_TOKEN`` characters or more; both lists are in order."""
    out, at, covered = [], 0, 0
    for lo, hi in tokens:
        while at < len(spans) and spans[at][0] < hi:  # covered: the furthest end of the spans so far
            start, _, end = spans[at]
            if start - max(lo, covered) >= MIN_TOKEN:
                out.append((max(lo, covered), start))
            covered = max(covered, end)
            at += 1
        if hi - max(lo, covered) >= MIN_TOKEN:
            out.append((max(lo, covered), hi))
    return out


def _ordinary(token: str) -> int:
    """Kind number of a candidate's sample: negative, by length and sorts of characters."""
    return -1 - sum(1 << i for i, p in enumerate(_SORTS) if p.search(token)) - 8 * (len(token) < LONG_TOKEN)


class Formats:
    """The trained automata; scores a token against ordinary text."""

    def __init__(self, values: dict[int, list[str]]):
        trained = {k: Automaton([shape(v[:TRAIN_CHARS]) for v in vs]) for k, vs in values.items() if len(vs) >= FEWEST}
        self.ordinary = [a for k, a in trained.items() if k < 0]
        self.kinds = [a for k, a in trained.items() if k >= 0] if self.ordinary else []

    def scorer(self):
        @lru_cache(maxsize=1 << 16)
        def gain(classes: str) -> float:
            return max(a.log_likelihood(classes) for a in self.kinds) - max(a.log_likelihood(classes) for a in self.ordinary)
        return (lambda token: gain(shape(token))) if self.kinds else (lambda token: float("-inf"))


def _explained(token: str, gain) -> bool:
    """True where the token, or what its end marks enclose, looks like a credential."""
    if gain(token) >= MARGIN:
        return True
    inner = token.strip(_MARKS)
    return MIN_TOKEN <= len(inner) < len(token) and gain(inner) >= MARGIN


def find_spans(text: str, gain) -> list[Span]:
    """All spans of a text, by start and kind."""
    spans, _, tokens = base_spans(text)
    found = [(lo, 3, hi) for lo, hi in tokens if _explained(text[lo:hi], gain)]
    return sorted(spans + found) if found else spans


def fit(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Automata from all documents' base matches; ``docs`` has ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                _, labelled, tokens = base_spans(text)
                for kind, value in labelled:
                    kinds.append(kind)
                    values.append(value[:TRAIN_CHARS])
                for lo, hi in tokens:
                    values.append(text[lo:min(hi, lo + TRAIN_CHARS)])
                    kinds.append(_ordinary(values[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string())], ["kind", "value"])

    found = docs.select("text").mapInArrow(run, "kind int, value string")
    # the values with the smallest hashes per kind, ranked per salt of a kind before a kind is in one task
    best = found.groupBy("kind", "value").agg(F.min(F.xxhash64("value", "kind")).alias("h"))
    values: dict[int, list[str]] = {}
    for r in top_k(best, ["kind"], [F.col("h"), F.col("value")], sample).select("kind", "value").collect():
        values.setdefault(r["kind"], []).append(r["value"])
    return Formats(values)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(spark: SparkSession, docs: DataFrame, formats: Formats) -> DataFrame:
    """``doc_id``, base counts and digest, and all spans of ``doc_id, text``."""
    shared = spark.sparkContext.broadcast(formats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.scorer()
        for batch in batches:
            counts, digests, joined = [[], [], []], [], []
            for text in batch.column("text"):
                spans = find_spans(text.as_py() or "", gain)
                base = [s for s in spans if s[1] < 3]
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
                 pa.array(joined, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MARK = "<secret>"


def redact(text: str, spans: list[Span]) -> str:
    """The text with every run of covered characters replaced by one mark."""
    out, at, open_until = [], 0, -1
    for start, _, end in spans:
        if start > open_until:
            if open_until >= 0:
                at = open_until
            out += [text[at:start], MARK]
        open_until = max(open_until, end)
    return "".join([*out, text[max(open_until, 0):]])


def redacted(spark: SparkSession, docs: DataFrame, formats: Formats, text_col: str = "text") -> DataFrame:
    """The rows with secrets replaced in ``text_col``; other columns unchanged, null texts stay null."""
    shared = spark.sparkContext.broadcast(formats)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.scorer()
        for batch in batches:
            texts = [None if t is None else redact(t, find_spans(t, gain)) for t in (v.as_py() for v in batch.column(place))]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


@register("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = read(spark, sf_dir, "documents")
    return scan(spark, docs, fit(docs))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, secrets redacted, ``n_chars`` brought up to date."""
    clean = redacted(spark, docs, fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
