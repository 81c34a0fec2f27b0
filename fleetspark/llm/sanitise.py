r"""Information-theoretic sanitisation of personal data.

Fixed patterns find the protected entities: every value (one address, one
number) and every kind.  Co-occurrence over the whole corpus then estimates
how strongly a term reveals an entity e: with N distinct passages, n(t) of
them holding the term, n(e) pieces of evidence for the entity and m of them
in a passage with the term,

    disclosure = PMI(e; t) / IC(e) = log2(m N / (n(e) n(t))) / log2(N / n(e)),

less what few observations cannot carry (factors m / (m + 1) and
k / (k + 1), k the smaller of n(e) and n(t)).  It is 1 where the term says as
much as the entity itself.  Evidence for a kind are its distinct values,
evidence for a value the distinct passages that hold it, so that copies count
once.  A term is a word; its more general form is its shape (digits kept one
by one, letters merged), which collects what single numbers are too rare to
show.  A term of which the disclosure reaches ``THRESHOLD`` for some entity
becomes a span ``term`` wherever it stands outside base spans: it is
generalised to its shape where that stays below the threshold, else removed.

The texts are read twice.  The first pass emits evidence with the terms of
passages that hold an entity, and the terms of every 16th passage by hash:
these give each term a certain lower bound of n(t), and only terms that may
still reach the threshold go on (nothing is lost, the bound is exact).  The
second pass counts those in all passages and remembers where they stand.  The
tasks know them by a bit table of fixed size, an equi-join tells them exactly.

Defined cases: null and empty texts have no span; whole texts are read,
positions count code points; repeated rows are scanned each, but are one
observation; without entities no term discloses; base spans always stay; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .personal_data import KINDS, Span, base_spans, value_of
from .registry import read, register
from .staging import numbered, stage
from .terms import Terms, term_blocks

THRESHOLD = 0.85
#: One passage in so many, by hash, gives the lower bound of a term's count.
SAMPLED = 16
#: Parts into which the rows of one key are dealt where they meet the one row that all of them look up.
SALTS = 32
#: Bits of the table that tells tasks which terms to remember (a broadcast of at most 4 MB).
TABLE_BITS = 22

_PASSAGE, _BOUND, _EVIDENCE = 0, 1, 2  # kinds of observations
_OBSERVED = "what byte, a long, b long, term long"


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _spans(texts: list[str]) -> list[list[Span]]:
    return [base_spans(t) for t in texts]


def _covered(found: Terms, spans: list[list[Span]], rows: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, Span, int, int]]:
    """``(row, span, lo, hi)``: the terms ``lo..hi`` of a block that a base span touches."""
    for row, lo, hi in zip(rows.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(found.row)]):
        for span in spans[row]:
            a = lo + int(np.searchsorted(found.end[lo:hi], span[0], side="right"))
            b = lo + int(np.searchsorted(found.start[lo:hi], span[2], side="left"))
            if a < b:
                yield row, span, a, b


def _observations(texts: list[str]) -> Iterator[np.ndarray]:
    """Rows of ``_OBSERVED`` for some texts, distinct per block."""
    spans = _spans(texts)
    for found in term_blocks(texts):
        if not len(found.row):
            continue
        passage = found.passage.view(np.int64)
        opens = np.flatnonzero(np.append(True, found.place[1:] != found.place[:-1]))
        closes = np.append(opens[1:], len(passage))
        rows = [np.stack([np.full(len(opens), _PASSAGE), passage[opens], np.zeros_like(opens), np.zeros_like(opens)], 1)]
        pick = found.passage % np.uint64(SAMPLED) == 0
        for hashes in (found.term[pick], found.shape[pick]):
            rows.append(np.stack([np.full(len(hashes), _BOUND), passage[pick], np.zeros(len(hashes), np.int64),
                                  hashes.view(np.int64)], 1))
        first = np.append(True, found.row[1:] != found.row[:-1])
        for row, span, a, b in _covered(found, spans, found.row[first], np.flatnonzero(first)):
            value = _hash(value_of(texts[row], span))
            for p in range(found.place[a], found.place[b - 1] + 1):
                at = int(np.searchsorted(found.place[opens], p))
                lo, hi = int(opens[at]), int(closes[at])
                terms = np.concatenate([found.term[lo:hi], found.shape[lo:hi], np.zeros(1, np.uint64)]).view(np.int64)
                for entity, evidence in ((span[1] + 1, value), (value, passage[lo])):
                    rows.append(np.stack([np.full(len(terms), _EVIDENCE), np.full(len(terms), entity),
                                          np.full(len(terms), evidence), terms], 1))
        seen = np.concatenate(rows)
        seen = seen[(seen[:, 3] != 0) | (seen[:, 0] != _BOUND)]
        by = np.lexsort(seen.T)
        seen = seen[by]
        yield seen[np.append(True, (seen[1:] != seen[:-1]).any(axis=1))]


def observe(docs: DataFrame) -> DataFrame:
    """Distinct observations of ``text``: passages, terms of sampled passages, terms beside evidence (0: the evidence itself)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seen in _observations([t.as_py() or "" for t in batch.column("text")]):
                yield pa.RecordBatch.from_arrays([pa.array(seen[:, 0], pa.int8()), *[pa.array(seen[:, i]) for i in (1, 2, 3)]],
                                                 [c.split()[0] for c in _OBSERVED.split(", ")])

    return docs.select("text").mapInArrow(run, _OBSERVED).distinct()


def _log2(x: Column) -> Column:
    return F.log2(x.cast("double"))


def _trust(n: Column) -> Column:
    return n / (n + 1)


def disclosure(m: Column, n_e: Column, n_t: Column, n: Column) -> Column:
    """Share of an entity's information that a term gives away, discounted; 0 for an entity in every passage."""
    m = F.least(m, n_t)
    pmi, ic = _log2(m * n / (n_e.cast("double") * n_t)), _log2(n / n_e)
    return F.when(n > n_e, _trust(m) * _trust(F.least(n_e, n_t)) * pmi / ic).otherwise(F.lit(0.0))


def _may_reach(m: Column, n_e: Column, least_t: Column, n: Column, threshold: float) -> Column:
    """False only where no count of the term from ``least_t`` on can bring the disclosure to the threshold."""
    pmi, ic = _log2(m * n / (n_e.cast("double") * F.greatest(m, least_t))), _log2(n / n_e)
    return (n > n_e) & (_trust(m) * _trust(n_e) * pmi / ic >= threshold)


def _looked_up(rows: DataFrame, table: DataFrame, key: str, by: Column) -> DataFrame:
    """``rows`` joined with the one row of ``table`` for their ``key``; a key's rows are split by ``by``."""
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(table, [key, "_salt"]).drop("_salt")


def candidates(observed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``term, entity, m, n_e, n`` of the pairs that may reach the threshold."""
    n = observed.where(F.col("what") == _PASSAGE).agg(F.count(F.lit(1)).alias("n"))
    evidence = observed.where(F.col("what") == _EVIDENCE).groupBy(F.col("a").alias("entity"), "term").agg(F.count(F.lit(1)).alias("m"))
    sizes = evidence.where("term = 0").select("entity", F.col("m").alias("n_e"))
    bound = observed.where(F.col("what") == _BOUND).groupBy("term").agg(F.count(F.lit(1)).alias("least_t"))
    # m alone decides for most pairs; a kind or a common value has many terms; n is one row
    pairs = _looked_up(evidence.where(F.col("term") != 0).where(_trust(F.col("m")) >= threshold),
                       sizes.where(_trust(F.col("n_e")) >= threshold), "entity", F.col("term"))
    pairs = pairs.join(bound, "term", "left").crossJoin(F.broadcast(n))
    least_t = F.coalesce("least_t", F.lit(1))
    return (pairs.where(_may_reach(F.col("m"), F.col("n_e"), least_t, F.col("n"), threshold))
            .select("term", "entity", "m", "n_e", "n"))


def bit_table(pairs: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """True for the low bits of every candidate; at most ``2**bits`` numbers reach the driver."""
    out = np.zeros(1 << bits, bool)
    low = pairs.select(F.col("term").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("low")).distinct()
    for batch in low.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = True
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_KEPT = [f"n_{k}" for k in KINDS] + ["base_sha256", "base"]
_SCANNED = ("row_id long, doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, base string, "
            "starts array<int>, ends array<int>, terms array<long>, shapes array<long>, passages array<long>, free array<boolean>")


def scan(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """Base spans of ``row_id, doc_id, text`` and the places of the terms in ``table``; ``free`` outside base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).view(bool)
        low = np.uint64(len(known) - 1)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            spans = _spans(texts)
            columns: list[list] = [[] for _ in range(7)]
            for found in term_blocks(texts):
                hit = np.stack([known[(h & low).astype(np.int64)] & (h != 0) for h in (found.term, found.shape)])
                free = np.ones(len(found.row), bool)
                first = np.append(True, found.row[1:] != found.row[:-1])[:len(found.row)]
                for _, _, a, b in _covered(found, spans, found.row[first], np.flatnonzero(first)):
                    free[a:b] = False
                at = np.flatnonzero(hit.any(axis=0))
                term, shape = np.where(hit, np.stack([found.term, found.shape]), np.uint64(0))[:, at].view(np.int64)
                for column, value in zip(columns, (found.row[at], found.start[at], found.end[at], term, shape,
                                                   found.passage[at].view(np.int64), free[at])):
                    column.append(value)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            ends = pa.array(np.searchsorted(flat[0], np.arange(len(texts) + 1)), pa.int32())
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c.astype(bool) if t == pa.bool_() else c, t))
                     for c, t in zip(flat[1:], kinds)]
            joined = [_joined(s) for s in spans]
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in spans], pa.int64()) for kind in range(len(KINDS))]
            digests = [hashlib.sha256(j.encode()).hexdigest() for j in joined]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(joined, pa.string()),
                 *lists], [c.split()[0] for c in _SCANNED.split(", ")])

    return docs.select("row_id", "doc_id", "text").mapInArrow(run, _SCANNED)


def _places(scanned: DataFrame) -> DataFrame:
    """A row per remembered word."""
    word = F.explode(F.arrays_zip("starts", "ends", "terms", "shapes", "passages", "free")).alias("w")
    return scanned.where(F.size("starts") > 0).select("row_id", word).select("row_id", "w.*")


def disclosing(scanned: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``term, disclosure`` of the terms (and shapes) that reach the threshold for some entity."""
    places = _places(scanned)
    held = places.select(F.col("terms").alias("term"), "passages").unionByName(
        places.select(F.col("shapes").alias("term"), "passages")).where("term <> 0").distinct()
    counts = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    d = disclosure(F.col("m"), F.col("n_e"), F.col("n_t"), F.col("n"))
    return pairs.join(counts, "term").groupBy("term").agg(F.max(d).alias("disclosure")).where(F.col("disclosure") >= threshold)


def find(spark: SparkSession, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``row_id, doc_id, text``: base counts and digest, ``base`` spans as text and ``found``.

    ``found`` is an array of ``start, end, general`` (true: generalised to
    the shape, false: removed) of the disclosing terms, by start.  A
    ``row_id`` must stand for the same row whenever ``rows`` is read.
    """
    pairs = stage(spark, candidates(stage(spark, observe(rows), "sanitise-observed"), threshold), "sanitise-pairs")
    scanned = stage(spark, scan(rows, bit_table(pairs)), "sanitise-scan")
    known = disclosing(scanned, pairs, threshold).select("term")
    words = _places(scanned).where("free").select("row_id", "starts", "ends", (F.col("shapes") != 0).alias("digits"), F.explode(F.array(
        F.struct(F.col("terms").alias("term"), F.lit(False).alias("by_shape")),
        F.struct(F.col("shapes").alias("term"), F.lit(True).alias("by_shape")))).alias("k"))
    words = words.select("row_id", "starts", "ends", "digits", "k.*").where("term <> 0")
    hits = _looked_up(words, known, "term", F.col("row_id")).groupBy("row_id", "starts", "ends").agg(
        (F.bool_and("digits") & ~F.bool_or("by_shape")).alias("general"))
    hits = hits.select("row_id", F.struct(F.col("starts").alias("start"), F.col("ends").alias("end"), "general").alias("f"))
    grouped = hits.groupBy("row_id").agg(F.array_sort(F.collect_list("f")).alias("found"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,general:boolean>>)")
    return scanned.select("row_id", "doc_id", *_KEPT).join(grouped, "row_id", "left").withColumn("found", F.coalesce("found", none))


def with_spans(found: DataFrame) -> DataFrame:
    """The query's columns: ``spans`` lists base spans and terms by start, and counts tell what happens to the terms."""
    parts = F.filter(F.split("base", ","), lambda s: s != "")
    listed = F.concat(
        F.transform(parts, lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("at"), _kind_number(F.split(s, ":")[0]).alias("k"), s.alias("s"))),
        F.transform("found", lambda f: F.struct(f["start"].alias("at"), F.lit(len(KINDS)).alias("k"),
                                                F.concat(F.lit("term:"), f["start"], F.lit(":"), f["end"]).alias("s"))))
    spans = F.array_join(F.transform(F.array_sort(listed), lambda x: x["s"]), ",")
    general = F.size(F.filter("found", lambda f: f["general"])).cast("long")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), general.alias("n_generalised"),
                        (F.size("found") - general).cast("long").alias("n_removed"))


def _kind_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), name).cast("int") - 1


def shape_of(word: str) -> str:
    """The more general form of a term: digits as 9, a run of letters as one a."""
    out: list[str] = []
    for c in word:
        g = "9" if "0" <= c <= "9" else "a" if c.isalpha() or c > "\x7f" else c
        if g != "a" or out[-1:] != ["a"]:
            out.append(g)
    return "".join(out)


def replaced(text: str, base: str, found: list[tuple[int, int, bool]]) -> str:
    """The text with entities named by kind, disclosing terms generalised or removed; overlapping spans become one."""
    named = [(int(a), int(b), f"<{k}>") for k, a, b in (s.split(":") for s in base.split(",") if s)]
    named += [(a, b, shape_of(text[a:b]) if general else "<removed>") for a, b, general in found]
    out, at = [], 0
    for a, b, mark in sorted(named):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitised(spark: SparkSession, docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with personal data replaced in ``text_col``; other columns unchanged, null texts stay null."""
    rows = numbered(spark, docs, "sanitise-rows")
    texts = rows.select("row_id", F.lit(None).cast("long").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"))
    found = find(spark, texts, threshold).where("base <> '' or size(found) > 0").select("row_id", "base", "found")
    joined = rows.join(found, "row_id", "left").select(*[F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)],
                                                       "base", "found")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, bases, terms = (batch.column(c).to_pylist() for c in (f"c{place}", "base", "found"))
            columns = list(batch.columns[:-2])
            columns[place] = pa.array([t if t is None or b is None else replaced(t, b, [(f["start"], f["end"], f["general"]) for f in own])
                                       for t, b, own in zip(texts, bases, terms)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return joined.mapInArrow(run, docs.schema)


@register("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = read(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return with_spans(find(spark, docs.withColumn("row_id", F.monotonically_increasing_id()), THRESHOLD))
