"""Bytes covered by long strings that also start elsewhere, by suffix sorting.

Every string of ``length`` bytes (a window) has one anchor: its ``GRAM``-byte
group of least hash, the first of equals.  Equal windows have equal anchors
at equal offsets, so windows fall into runs of neighbours with one anchor,
and only runs whose anchor hash occurs twice in the corpus can hold repeats:

1. runs are hashed per document, anchors are counted, runs with an anchor of
   its own are done;
2. of the others, runs whose whole content occurs twice are repeated
   throughout, known from counts alone;
3. of the rest, one copy of each content is brought together by anchor, the
   suffixes of such a block are ordered by two-stage sorting, and adjacent
   suffixes with a common prefix of ``length`` mark the repeated windows.

An anchor with more than ``GROUP_RUNS`` contents is dealt over several
blocks; its windows that stayed single in their block are compared across
blocks by a 128-bit digest.  No group is ever whole in one task, no pair of
documents is formed.  Text travels once, to its spans.

Defined cases: null text is empty; a document shorter than ``length`` loses
nothing; repeated rows (same id and text) are documents of their own and
cover each other; a missing ``doc_id`` is allowed; documents of any length
are read whole, in overlapping slices; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import read, register
from .staging import stage
from .suffixes import common_prefixes, suffix_order
from .word_hash import _power, mix

LENGTH = 200
GRAM = 64
#: Contents of one anchor that are sorted in one block.
GROUP_RUNS = 2048
#: Bytes of text per block of the suffix sort.
BLOCK_BYTES = 1 << 19
#: Bytes hashed at once; positions inside take 20 bits.
_SLICE = 1 << 19
_PLACE_BITS = 20

_ALL, _OPEN, _FOUND = 0, 1, 2  # a candidate run, one that stage 3 decides, windows that it found

_rng = np.random.default_rng(200)
_BYTES = [_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]


def _prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    up, _ = _power(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[which][data] * up[:len(data)])])


def _between(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``lo`` to ``hi``, wherever they stand."""
    _, down = _power(len(total))
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def anchor_runs(pieces: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: piece, first window, windows, anchor hash, content hash."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    if len(data) < length:
        return None
    ends = np.cumsum(sizes)
    total = _prefix_hash(data)
    place = np.arange(len(data) - gram + 1)
    h = _between(total, place, place + gram)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    key = (h & ~low) | place.astype(np.uint64)  # least hash, then first place
    least, size, width = key, 1, length - gram + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(key) - width + 1
    least = np.minimum(least[:n], least[width - size:width - size + n])
    start = np.arange(n)
    of = np.searchsorted(ends, start, side="right")
    inside = start + length <= ends[of]
    start, of, anchor = start[inside], of[inside], (least[inside] & low).astype(np.int64)
    if not len(start):
        return None
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])]
    first = start[new]
    last = start[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]
    content = _between(total, first, last + length)
    return of[new], first - (ends - sizes)[of[new]], last - first + 1, h[anchor[new]], content


def _pieces(values: pa.Array, length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """``(rows, offsets, bytes)`` of bounded size; long texts come in parts that share ``length - 1`` bytes."""
    rows, offsets, out, held = [], [], [], 0
    part = _SLICE // 2
    for row, value in enumerate(values):
        text = (value.as_py() or "").encode("utf-8", "surrogatepass")
        for lo in range(0, max(1, len(text) - length + 1), part):
            piece = text[lo:lo + part + length - 1]
            if out and held + len(piece) > _SLICE:
                yield rows, offsets, out
                rows, offsets, out, held = [], [], [], 0
            rows.append(row)
            offsets.append(lo)
            out.append(piece)
            held += len(piece)
    if out:
        yield rows, offsets, out


def _code(lo: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
    """First window, number of windows (below 256) and kind in one long."""
    return (lo << 10) | (n << 2) | kind


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """``anchor, content, k1, k2, code`` of all runs of ``k1, k2, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for rows, offsets, pieces in _pieces(batch.column("text"), length):
                if (found := anchor_runs(pieces, length)) is None:
                    continue
                of, lo, n, anchor, content = found
                row, lo = np.array(rows)[of], lo + np.array(offsets)[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(k1[row]), pa.array(k2[row]),
                     pa.array(_code(lo, n, _ALL))], ["anchor", "content", "k1", "k2", "code"])
    return docs.select("k1", "k2", "text").mapInArrow(run, "anchor long, content long, k1 long, k2 long, code long")


def _contents(listed: DataFrame, length: int) -> DataFrame:
    """The bytes of the listed runs: ``anchor, block, blocks, k1, k2, lo, single, bytes``.

    Repeated rows list the same runs, so a task passes on the first of them
    only; what remains of a row, however often it is repeated, is one a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text, k1, k2, entries in zip(*(batch.column(c) for c in ("text", "k1", "k2", "entries"))):
                own = (k1.as_py(), k2.as_py())
                if own in seen:
                    continue
                seen.add(own)
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for e in entries.as_py():
                    lo, n = e["code"] >> 10, (e["code"] >> 2) & 255
                    for column, value in zip(out, (e["anchor"], e["block"], e["blocks"], k1.as_py(), k2.as_py(), lo,
                                                   e["single"], data[lo:lo + n + length - 1])):
                        column.append(value)
                if len(out[0]) > 4096:
                    yield _batch(out)
                    out = [[] for _ in range(8)]
            yield _batch(out)

    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    names = ["anchor", "block", "blocks", "k1", "k2", "lo", "single", "bytes"]

    def _batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return listed.mapInArrow(run, "anchor long, block int, blocks int, k1 long, k2 long, lo long, single boolean, bytes binary")


FOUND = "k1 long, k2 long, code long, d1 long, d2 long"


def sort_block(contents: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the contents in suffix order: content number, offset, class, class size, and the bytes' places."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    data = np.frombuffer(b"".join(contents), np.uint8)
    starts = np.cumsum(sizes) - sizes
    wanted = np.zeros(len(data) + 1, np.int32)
    np.add.at(wanted, starts, 1)
    np.add.at(wanted, starts + sizes - length + 1, -1)
    order = suffix_order(data, np.cumsum(wanted)[:-1] > 0, length)
    joined = common_prefixes(data, order, length) >= length
    cls = np.cumsum(np.r_[0, ~joined]) if len(order) else np.zeros(0, np.int64)
    size = np.bincount(cls)[cls] if len(order) else cls
    of = np.searchsorted(starts, order, side="right") - 1
    return of, order - starts[of], cls, size, order


def _sorted_blocks(contents: DataFrame, length: int) -> DataFrame:
    """Repeated windows per block, plus a digest per class of anchors with several blocks.

    Rows with a null digest are found windows; rows with a digest stand for a
    class of one block, with a place if its windows still wait for a partner.
    """
    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = table.column("bytes").to_pylist()
        k1, k2, lo = (table.column(c).to_numpy() for c in ("k1", "k2", "lo"))
        single = table.column("single").to_numpy(zero_copy_only=False)
        many = table.column("blocks").to_numpy() > 1
        of, offset, cls, size, order = sort_block(texts, length)
        hit = (size > 1) & single[of]
        row, at = of[hit], offset[hit]
        sort = np.lexsort((at, row))
        row, at = row[sort], at[sort]
        new = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)] if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        n = np.diff(np.r_[first, len(row)])
        none = pa.nulls(len(first), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1[row[first]]), pa.array(k2[row[first]]), pa.array(_code(lo[row[first]] + at[first], n, _FOUND)), none, none],
            ["k1", "k2", "code", "d1", "d2"])
        lead = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]] & many[of]) if len(of) else np.zeros(0, np.int64)
        if len(lead):
            data = np.frombuffer(b"".join(texts), np.uint8)
            digest = [_between(_prefix_hash(data, w), order[lead], order[lead] + length).view(np.int64) for w in (0, 1)]
            r = of[lead]
            waits = single[r] & (size[lead] == 1)
            code = _code(lo[r] + offset[lead], np.ones(len(r), np.int64), _FOUND)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[r]), pa.array(k2[r]), pa.array(code, mask=~waits), pa.array(digest[0]), pa.array(digest[1])],
                ["k1", "k2", "code", "d1", "d2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, block = batch.column("anchor").to_numpy(), batch.column("block").to_numpy()
            edges = np.flatnonzero((anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                before = held[-1] if held else None
                goes_on = before is not None and (before["anchor"][-1].as_py(), before["block"][-1].as_py()) == (
                    int(anchor[lo]), int(block[lo]))
                if held and not goes_on and size >= BLOCK_BYTES:
                    yield from solve(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(part)
                size += int(np.diff(np.frombuffer(part.column("bytes").buffers()[1], np.int32)[
                    part.column("bytes").offset:part.column("bytes").offset + part.num_rows + 1]).sum())
        if held:
            yield from solve(pa.Table.from_batches(held))

    dealt = contents.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    return dealt.select("anchor", "block", "blocks", "k1", "k2", "lo", "single", "bytes").mapInArrow(run, FOUND)


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """Result rows of ``doc_id, text, codes``."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text, codes in zip(*(batch.column(c) for c in ("doc_id", "text", "codes"))):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans = removed_spans(np.array(codes.as_py() or [], np.int64), length)
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                for column, value in zip(out, (doc_id.as_py(), len(data), sum(b - a for a, b in spans), len(spans),
                                               digest.hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.string())], names)

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed_spans(codes: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by a document's repeated windows."""
    kind, place = codes & 3, codes >> 2
    runs = place[(kind == _ALL) & ~np.isin(place, place[kind == _OPEN])]
    place = np.sort(np.concatenate([runs, place[kind == _FOUND]]))
    spans: list[list[int]] = []
    for lo, n in zip((place >> 8).tolist(), (place & 255).tolist()):
        end = lo + n - 1 + length
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([lo, end])
    return [(a, b) for a, b in spans]


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, text, codes``: each row of ``doc_id, text`` with its repeated windows (see ``removed_spans``)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(0).cast("long")).alias("k1"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("k2"))
    runs = _runs(keyed, length)
    # what is joined by anchor is staged first: only between plain exchanges can a hot anchor's rows be split
    twice = stage(spark, runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"),
                  "suffix-anchors")
    candidates = stage(spark, runs.join(twice, "anchor"), "suffix-candidates")
    contents = candidates.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "code")).alias("r"))
    contents = stage(spark, contents, "suffix-contents")
    groups = stage(spark, contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
                   .select("anchor", F.ceil(F.col("m") / F.lit(GROUP_RUNS)).cast("int").alias("blocks")), "suffix-groups")
    asked = contents.join(groups, "anchor").select(
        "r.k1", "r.k2", "r.code", "anchor", "blocks", (F.col("n") == 1).alias("single"),
        F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int").alias("block"))
    entry = F.struct("anchor", "block", "blocks", "code", "single")
    listed = keyed.join(asked.groupBy("k1", "k2").agg(F.collect_list(entry).alias("entries")), ["k1", "k2"])
    found = stage(spark, _sorted_blocks(_contents(listed.select("k1", "k2", "text", "entries"), length), length), "suffix-found")
    across = found.where("d1 is not null")
    partners = across.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2")
    late = across.where("code is not null").join(partners, ["d1", "d2"]).select("k1", "k2", "code")
    codes = (candidates.select("k1", "k2", "code")
             .unionByName(contents.where("n = 1").select("r.k1", "r.k2", F.col("r.code").bitwiseOR(F.lit(_OPEN)).alias("code")))
             .unionByName(found.where("d1 is null").select("k1", "k2", "code")).unionByName(late))
    return keyed.join(codes.groupBy("k1", "k2").agg(F.collect_set("code").alias("codes")), ["k1", "k2"], "left")


@register("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated strings of 200 bytes, and a digest of what stays."""
    return _cut(repeated_spans(spark, read(spark, sf_dir, "documents")).select("doc_id", "text", "codes"), LENGTH)
