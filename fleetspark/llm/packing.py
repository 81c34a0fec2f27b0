"""Order-preserving packing of documents into token windows.

The tokens of a partition's documents form one line.  Windows are cut where
a document ends (free), where a sentence ends (a small penalty) or, inside
long stretches without either, at evenly spaced places (a larger penalty).
Dynamic programming over these places minimises padding plus penalties.
Padding is ``capacity`` minus a difference of positions, so the best previous
cut is a sliding-window minimum kept in a monotone queue; windows of exactly
a power of two need no padding and are extra transitions.

The line is handled in blocks: of each block's best cuts all but the last few
windows are final, the next block goes on from there.  A partition's last
window is split at powers of two.  Nothing is shuffled, documents keep the
order of the table, and memory is bounded by the block.

Defined cases: null text is empty and packs as the end id alone; repeated
rows are packed each; very long texts are encoded slice by slice and packed
as they come; an empty table gives an empty result; extra columns are ignored.
The table should come from files or a staged copy, so that a repeated task
sees the same rows in the same order.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .registry import read, register
from .tokens import TOKENIZER, encode, slices, word_ids

CAPACITY = 4096
END_ID = 2
#: Costs in tokens of padding: a cut inside a document after a sentence, elsewhere, and each window.
SENTENCE_CUT = 6
HARD_CUT = 48
WINDOW_COST = 2
#: Places for hard cuts stand this far apart in stretches of more than ``LONG_STRETCH`` tokens without a sentence end.
HARD_STEP = 16
LONG_STRETCH = 128
#: Tokens per block of the dynamic programme, and windows of a block left open for the next.
BLOCK = 1 << 17
OPEN_WINDOWS = 4
#: Characters of texts that are encoded in one go.
GROUP_CHARS = 1 << 17

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def best_cuts(pos: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Positions (the last of ``pos`` included) that cut ``pos[0]..pos[-1]`` at least cost.

    ``pos`` ascends in steps of at most ``capacity``; ``penalty[j]`` is the
    cost of a cut at ``pos[j]``.
    """
    ends, starts = [], []  # pairs of places exactly a power of two apart
    length = 1
    while length <= capacity:
        i = np.searchsorted(pos, pos - length)
        j = np.flatnonzero((pos >= pos[0] + length) & (pos[i] == pos - length))
        ends.append(j)
        starts.append(i[j])
        length *= 2
    pairs = np.concatenate(ends)
    exact = np.concatenate(starts)[np.argsort(pairs, kind="stable")].tolist()
    upto = np.cumsum(np.bincount(pairs, minlength=len(pos))).tolist()
    paired = 0
    at, pen = pos.tolist(), penalty.tolist()
    best, back, key = [0] * len(at), [0] * len(at), [at[0]] * len(at)
    queue = deque([0])  # cut candidates by position, their key = best + position ascending
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0]] > capacity:
            queue.popleft()
        i = queue[0]
        cost = key[i] + capacity - here
        if upto[j] > paired:
            for e in exact[paired:upto[j]]:
                if best[e] < cost:
                    cost, i = best[e], e
            paired = upto[j]
        best[j] = cost = cost + pen[j] + WINDOW_COST
        back[j] = i
        key[j] = k = cost + here
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def _with_hard_cuts(ends: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds evenly spaced places in long stretches."""
    gaps = np.diff(ends)
    extra = [np.arange(ends[i] + HARD_STEP, ends[i + 1], HARD_STEP) for i in np.flatnonzero(gaps > LONG_STRETCH)]
    if not extra:
        return ends, penalty
    more = np.concatenate(extra)
    order = np.argsort(np.concatenate([ends, more]), kind="stable")
    return (np.concatenate([ends, more])[order],
            np.concatenate([penalty, np.full(len(more), HARD_CUT)])[order])


class Packer:
    """Packs one line of tokens; pieces come out once their document is complete."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.sequence = capacity, first_sequence
        self.base = 0  # tokens of the line that are packed
        self.ids = bytearray()  # tokens from ``base`` on
        self.places: list[np.ndarray] = []  # sentence ends, counted on the line
        self.docs: list[list] = []  # [doc_id, first token on the line, end or None]
        self.end = 0
        self.pieces: list[list] = []

    def add(self, doc_ids: list, ids: bytes, sentence_ends: np.ndarray, doc_ends: np.ndarray) -> None:
        """Tokens of some texts: the open one goes on first, the texts ``doc_ids`` begin, ``doc_ends`` tells where texts end."""
        ends = deque((self.end + doc_ends).tolist())
        start = self.end
        if self.docs and self.docs[-1][2] is None and ends:
            start = self.docs[-1][2] = ends.popleft()
        for doc_id in doc_ids:
            end = ends.popleft() if ends else None
            self.docs.append([doc_id, start, end])
            start = end
        self.places.append(self.end + sentence_ends)
        self.ids += ids
        self.end += len(ids) // 4
        if self.end - self.base >= BLOCK:
            self.pack(final=False)

    def pack(self, final: bool) -> None:
        if self.end == self.base:
            return
        sentence = np.unique(np.concatenate([*self.places, [self.end]]))
        doc_ends = np.array([d[2] for d in self.docs if d[2] is not None], np.int64)
        free = np.concatenate([[self.base], doc_ends[doc_ends > self.base]])
        pos = np.unique(np.concatenate([free, sentence[sentence > self.base]]))
        penalty = np.where(np.isin(pos, free), 0, SENTENCE_CUT)
        pos, penalty = _with_hard_cuts(pos, penalty)
        cuts = best_cuts(pos, penalty, self.capacity)
        if final:
            cuts = [*cuts[:-1], *self._powers(cuts[-2] if len(cuts) > 1 else self.base, cuts[-1])]
        else:
            cuts = cuts[:-OPEN_WINDOWS]
        self._emit(np.array(cuts, np.int64))

    def _powers(self, lo: int, hi: int) -> list[int]:
        """Cuts of the last window into powers of two, largest first."""
        out, left = [], hi - lo
        while left:
            step = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            lo, left = lo + step, left - step
            out.append(lo)
        return out

    def _emit(self, cuts: np.ndarray) -> None:
        if not len(cuts):
            return
        stop = int(cuts[-1])
        starts = np.array([d[1] for d in self.docs], np.int64)
        marks = np.unique(np.concatenate([[self.base], cuts, starts[(starts > self.base) & (starts < stop)]]))
        lo, hi = marks[:-1], marks[1:]
        doc = np.searchsorted(starts, lo, side="right") - 1
        window = np.searchsorted(cuts, lo, side="right")
        window_start = np.concatenate([[self.base], cuts])[window]
        view = memoryview(self.ids)
        for a, b, d, w, s in zip(lo.tolist(), hi.tolist(), doc.tolist(), window.tolist(), window_start.tolist()):
            crc = zlib.crc32(view[4 * (a - self.base):4 * (b - self.base)])
            self.pieces.append([self.docs[d], a - self.docs[d][1], b - a, crc, self.sequence + w, a - s])
        view.release()
        self.sequence += len(cuts)
        del self.ids[:4 * (stop - self.base)]
        self.base = stop
        rest = np.concatenate(self.places)
        self.places = [rest[rest > stop]]
        self.docs = [d for d in self.docs if d[2] is None or d[2] > stop]

    def take(self) -> pa.RecordBatch | None:
        """The pieces of complete documents."""
        done = [p for p in self.pieces if p[0][2] is not None]
        if not done:
            return None
        self.pieces = [p for p in self.pieces if p[0][2] is None]
        cols = [[p[0][0] for p in done], [p[1] for p in done], [p[2] for p in done], [p[3] for p in done],
                [p[0][2] - p[0][1] for p in done], [p[4] for p in done], [p[5] for p in done]]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str], list[bool]]]:
    """``(ids of the texts that begin, parts of texts, whether a part is its text's last)``, ``GROUP_CHARS`` or one part at a time."""
    ids, parts, closes, size = [], [], [], 0
    for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
        begins = True
        for part in slices(text.as_py() or ""):
            if not begins:
                closes[-1:] = [False]
            if parts and size + len(part) > GROUP_CHARS:
                yield ids, parts, closes
                ids, parts, closes, size = [], [], [], 0
            if begins:
                ids.append(doc_id.as_py())
            parts.append(part)
            closes.append(True)
            size += len(part)
            begins = False
    if parts:
        yield ids, parts, closes


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """The pieces of ``doc_id, text`` in windows; see ``SCHEMA``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer, end_id)
        packer = Packer(TaskContext.get().partitionId() << 33, capacity)
        for batch in batches:
            for ids, texts, closes in _groups(batch):
                packer.add(ids, *encode(texts, closes, table))
            if (out := packer.take()) is not None:
                yield out
        packer.pack(final=True)
        if (out := packer.take()) is not None:
            yield out

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


@register("op1_pack_documents")
def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 tokens."""
    return pack(read(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the training windows as pieces of documents."""
    return pack(docs)
