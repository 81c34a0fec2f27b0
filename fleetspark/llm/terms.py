"""The terms of many texts as hashes and places, by numpy over their bytes.

A term is a run of characters other than white space without the sentence
marks at its end, A-Z as a-z.  Its shape, the next more general term, keeps
digits as ``9`` one by one and other marks, and writes any run of letters as
one letter; only terms with a digit have one.  A passage is a stretch of up
to ``PASSAGE`` words of one line.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from .slices import parts
from .word_hash import _power, mix

#: Words of a passage.
PASSAGE = 32
#: Characters handled at once; a longer text comes in parts cut at white space.
BLOCK_CHARS = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_END_MARK = np.zeros(256, bool)
_END_MARK[list(b".,;:!?")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _odd(b: int) -> int:
    return (b + 1) * 0xD6E8FEB86659FD93 % (1 << 64) | 1


_VALUE = np.array([0 if _SPACE[b] else _odd(b + 32 if 65 <= b <= 90 else b) for b in range(256)], np.uint64)
_SHAPE_VALUE = np.array([_odd(57) if _DIGIT[b] else _odd(97) if _LETTER[b] else int(_VALUE[b]) for b in range(256)], np.uint64)
_SHAPE_SALT = np.uint64(0xA0761D6478BD642F)
_PASSAGE_SALT = np.uint64(0xE7037ED1A0B428DB)


class Terms(NamedTuple):
    """Columns with an entry per term, in order of the texts."""

    row: np.ndarray  # number of its text
    start: np.ndarray  # code points in its text
    end: np.ndarray
    term: np.ndarray  # 64-bit hashes
    shape: np.ndarray  # 0 without a digit
    passage: np.ndarray  # hash of the whole passage
    place: np.ndarray  # number of the passage within the block


def _hashes(total: np.ndarray, down: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the stretches ``first..last`` of the summed-up values."""
    return mix((total[last] - np.where(first > 0, total[first - 1], np.uint64(0))) * down[first])


def _block(rows: list[int], offsets: list[int], texts: list[str]) -> Terms:
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1)[:-1]])
    index = np.arange(len(data))
    space = _SPACE[data]
    edge = np.diff((~space).view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    solid = np.maximum.accumulate(np.where(space | _END_MARK[data], -1, index))
    last = solid[end - 1]
    line = np.cumsum(data == 10)[start]
    new = np.append(True, line[1:] != line[:-1]) if len(start) else np.zeros(0, bool)
    place = np.arange(len(start))
    within = place - np.maximum.accumulate(np.where(new, place, 0)) if len(start) else place
    opens = np.flatnonzero(new | (within % PASSAGE == 0))
    number = np.searchsorted(opens, place, side="right") - 1

    up, down = _power(len(data))
    total = np.cumsum(_VALUE[data] * up)
    closes = end[np.append(opens[1:], len(start)) - 1] - 1 if len(start) else place
    passage = _hashes(total, down, start[opens], closes) ^ _PASSAGE_SALT
    real = last >= start  # not only sentence marks
    start, last, number = start[real], last[real], number[real]
    term = _hashes(total, down, start, last)
    letter = _LETTER[data]
    kept = ~(letter & np.append(False, letter[:-1]))
    upto = np.cumsum(kept) - 1
    shaped = np.cumsum(_SHAPE_VALUE[data[kept]] * up[:int(upto[-1]) + 1])
    shape = _hashes(shaped, down, upto[start], upto[last]) ^ _SHAPE_SALT
    digits = np.cumsum(_DIGIT[data])
    shape[digits[last] - digits[start] + _DIGIT[data[start]] == 0] = 0

    point = np.cumsum((data & 0xC0) != 0x80) - 1  # code points before, in the whole block
    part = np.searchsorted(begins, start, side="right") - 1
    shift = np.array(offsets, np.int64)[part] - point[begins][part]
    return Terms(np.array(rows, np.int64)[part], point[start] + shift, point[last] + shift + 1, term, shape, passage[number], number)


def term_blocks(texts: list[str]) -> Iterator[Terms]:
    """The terms of the texts in blocks of bounded size, rows numbered as given."""
    rows, offsets, block, size = [], [], [], 0
    for row, text in enumerate(texts):
        offset = 0
        for part in parts(text, BLOCK_CHARS):
            if block and size + len(part) > BLOCK_CHARS:
                yield _block(rows, offsets, block)
                rows, offsets, block, size = [], [], [], 0
            rows.append(row)
            offsets.append(offset)
            block.append(part)
            size += len(part)
            offset += len(part)
    if block:
        yield _block(rows, offsets, block)


def term_hash(text: str) -> tuple[int, int]:
    """Hashes of one term and of its shape, as signed numbers."""
    found = _block([0], [0], [text])
    return int(found.term.view(np.int64)[0]), int(found.shape.view(np.int64)[0])
