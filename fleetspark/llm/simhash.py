"""SimHash near-duplicates joined in a segment-popcount grid.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles.  Distinct fingerprints are embedded as the bit counts of 32
two-bit segments; the Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints.  Counts are written in unary (0, 01,
11), so that Manhattan distance is the number of differing bits of two
embeddings, and a grid cell is an embedding under a mask.

Range join: the segments form eight groups.  At distance ``r`` at most ``r``
groups differ, so two points within range share the cell of some choice of
``8 - r`` groups.  Points meet in those cells, the Manhattan bound drops most
pairs, and the rest is verified on the fingerprints.  A cell larger than
``CELL_ROWS`` is split into blocks and every pair of blocks is a task of its
own, so hot cells spread and nothing is capped.  Each task sends a spanning
forest of the links it found, not all pairs.

Defined cases: null or blank text has fingerprint zero and is linked like
any other; fewer words than a shingle give one shingle of them all; repeated
rows share a component; a component of rows without ``doc_id`` has a null
id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import component_labels
from .registry import read, register
from .staging import numbered, stage

SHINGLE = 4
MAX_BITS = 4
SEED = 42
GROUPS = 8
#: Rows of a cell compared in one block; larger cells are split into pairs of blocks.
CELL_ROWS = 4096
#: Links of a task held before they are reduced to a forest.
FOREST_LINKS = 1 << 17
#: Shingles hashed at once, so that very long texts take bounded memory.
_CHUNK = 1 << 16
_LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text, as an unsigned integer."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z only, splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    tails = ends[shingle - 1:] or ends[-1:]
    counts, total = np.zeros(64, np.int64), len(tails)
    for lo in range(0, total, _CHUNK):
        part = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[lo:lo + _CHUNK], tails[lo:lo + _CHUNK])]
        octets = np.array(part, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``row_id, doc_id, fp`` (fp as signed long) from ``row_id, doc_id, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), pa.array(fps.view(np.int64))], ["row_id", "doc_id", "fp"])
    return docs.select("row_id", "doc_id", "text").mapInArrow(run, "row_id long, doc_id long, fp long")


def embed(fp: Column) -> Column:
    """Unary bit counts of the 32 two-bit segments, packed in a long."""
    low, shifted = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(shifted).bitwiseAND(low)
    both = fp.bitwiseAND(shifted).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _embed(fp: np.ndarray) -> np.ndarray:
    low, shifted = np.uint64(_LOW), fp >> np.uint64(1)
    return ((fp | shifted) & low) | ((fp & shifted & low) << np.uint64(1))


def cell_masks(max_bits: int, groups: int = GROUPS) -> list[int]:
    """Signed masks of every choice of ``groups - max_bits`` groups of segments."""
    edges = [2 * round(32 * g / groups) for g in range(groups + 1)]
    spans = [((1 << edges[g + 1]) - 1) ^ ((1 << edges[g]) - 1) for g in range(groups)]
    masks = [sum(spans[g] for g in chosen) for chosen in combinations(range(groups), groups - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) with the components of ``a``-``b``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _links_in(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between rows of equal ``group`` (rows stand in order of group)."""
    grid = _embed(fp)
    i = np.arange(len(fp))
    held_a, held_b, held = [], [], 0
    shift = 1
    while i.size:
        i = i[i + shift < len(fp)]
        i = i[group[i] == group[i + shift]]
        near = i[np.bitwise_count(grid[i] ^ grid[i + shift]) <= max_bits]
        near = near[np.bitwise_count(fp[near] ^ fp[near + shift]) <= max_bits]
        held_a.append(fp[near])
        held_b.append(fp[near + shift])
        held += near.size
        if held > max(FOREST_LINKS, 4 * len(fp)):  # keep a forest, not all pairs
            a, b = spanning(np.concatenate(held_a), np.concatenate(held_b))
            held_a, held_b, held = [a], [b], 0
        shift += 1
    if not held_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return spanning(np.concatenate(held_a), np.concatenate(held_b))


def _link_batches(max_bits: int):
    keys = ["choice", "cell", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table) -> pa.RecordBatch:
            cols = [table.column(k).to_numpy() for k in keys]
            new = np.zeros(table.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            a, b = _links_in(np.cumsum(new), table.column("fp").to_numpy().view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[pa.RecordBatch] = []  # rows of the group that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            last = np.ones(table.num_rows, bool)
            for k in keys:
                c = table.column(k).to_numpy()
                last &= c == c[-1]
            cut = int(np.argmax(last))
            if cut:
                yield links(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).to_batches()
        if held:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return run


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS, groups: int = GROUPS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``fp`` within ``max_bits`` of each other."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("u").bitwiseAND(F.lit(m)).alias("cell"))
        for i, m in enumerate(cell_masks(max_bits, groups))])).alias("c")
    # few bytes become many rows: spread the nodes first, by another key than the one they are grouped by
    # (that exchange would be dropped) and to a number of tasks that adaptive execution does not merge
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = (nodes.select("fp", embed(F.col("fp")).alias("u")).repartition(n, "u")
              .select("fp", cells).select("fp", "c.choice", "c.cell"))
    shared = (points.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .select("choice", "cell", F.ceil(F.col("n") / F.lit(cell_rows)).cast("int").alias("blocks")))
    # both sides have up to a row per node and mask, but are sized as the nodes before the explode: never broadcast
    met = points.join(shared.hint("merge"), ["choice", "cell"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(F.col("own"), k).alias("lo"), F.greatest(F.col("own"), k).alias("hi"))))
    dealt = (met.withColumn("own", own).withColumn("p", pairs).select("choice", "cell", "p.lo", "p.hi", "fp")
             .repartition("choice", "cell", "lo", "hi").sortWithinPartitions("choice", "cell", "lo", "hi", "fp"))
    return dealt.mapInArrow(_link_batches(max_bits), "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``row_id, doc_id, fp, component_id, keeper``: every row with its group.

    ``docs`` has ``row_id, doc_id, text``.  ``keeper`` is the ``row_id`` of
    the group's first row by doc_id (rows without one last).
    """
    marked = stage(spark, fingerprints(docs, shingle), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row_id").alias("row")))
    nodes = marked.groupBy("fp").agg(first.alias("first"))
    labels = component_labels(spark, near_links(nodes, max_bits))
    named = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label"))
    groups = named.groupBy("label").agg(F.min("first").alias("f"))
    named = named.join(groups, "label").select("fp", F.col("f.id").alias("component_id"), F.col("f.row").alias("keeper"))
    # a row per document and one per fingerprint: small as files, not in the driver's memory
    return marked.join(named.hint("merge"), "fp").select("row_id", "doc_id", "fp", "component_id", "keeper")


def with_row_id(docs: DataFrame) -> DataFrame:
    """``row_id, doc_id, text`` of a documents table, repeated rows told apart."""
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


@register("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark, with_row_id(read(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Up to so many dropped rows are told by broadcast (8 bytes each); beyond that they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group."""
    rows = numbered(spark, docs, "simhash-rows")
    texts = rows.select("row_id", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    dropped = near_duplicates(spark, texts).where("row_id <> keeper").select("row_id")
    dropped = stage(spark, dropped, "simhash-dropped")
    few = dropped.limit(broadcast_ids + 1).count() <= broadcast_ids
    return rows.join(F.broadcast(dropped) if few else dropped, "row_id", "left_anti").select("row.*")
