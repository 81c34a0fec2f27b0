"""Token ids of whole texts, with the ids of repeated words remembered.

The vocabulary's normaliser lower-cases and its pre-tokeniser never looks
across a space, a line feed or the border of a letter and a mark, so the ids
of a text are the ids of its pieces in order.  Each Python worker keeps a
bounded table of pieces it has met; the new words of a slice are encoded in
one call and told apart by the vocabulary's end-of-word tokens.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np

TOKENIZER = "word_bpe_49k.json"
#: Pieces remembered by a worker (some 50 MB); beyond that the half in use most often stays.  Most pieces of a corpus
#: are rare, the frequent ones are met in nearly every group of texts.
CACHE_WORDS = 200_000
CACHE_IDS = 1_600_000
#: Longer pieces are encoded each time.
CACHE_WORD_CHARS = 64
#: Characters of a text handled at once.
SLICE_CHARS = 1 << 19

# a run of marks after a letter and before white space (the first mark is sought first, which is the rarer one);
# the apostrophe may belong to a contraction
_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[a-zà-öø-ÿ].)[!-&(-/:-@\[-`{-~]*(?=[ \n])", re.S)
_STOPS = frozenset(("\n", ".", "!", "?", "..."))
#: Stands for the end of a text among its pieces, which hold no space.
_END = " end"


class WordIds(dict):
    """Piece -> its number, filled on demand; arrays hold each number's ids, their count, whether a sentence or line ends, and its uses."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer
        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self._encode = tokenizer.encode
        self._encode_batch = tokenizer.encode_batch_fast
        self._specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        vocabulary = tokenizer.get_vocab()
        self._word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self._word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._end_id = end_id
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self._ids, self._first, self._count, self._stops = array("I"), array("q"), array("q"), array("b")
        self._uses = np.zeros(0, np.int32)
        self["\n"] = self._add([], True)
        self[""] = self._add([], False)
        self[_END] = self._add([self._end_id], False)

    def _add(self, ids, stops: bool) -> int:
        self._first.append(len(self._ids))
        self._count.append(len(ids))
        self._stops.append(stops)
        self._ids.extend(ids)
        return len(self._first) - 1

    def has_special(self, text: str) -> bool:
        """True if the text may hold one of the vocabulary's special strings."""
        return any(s[:2] in text for s in self._specials)

    def __missing__(self, piece: str) -> int:
        """The number of a new piece; that of a long one is not remembered."""
        known = self._add(self._encode(piece, add_special_tokens=False).ids, piece in _STOPS)
        if len(piece) <= CACHE_WORD_CHARS:
            self[piece] = known
        return known

    def make_room(self) -> None:
        """Keeps the pieces used most often when too much is remembered; numbers given out before no longer hold."""
        if len(self._first) < CACHE_WORDS and len(self._ids) < CACHE_IDS:
            return
        pieces, numbers = list(self), np.fromiter(self.values(), np.int64, len(self))
        uses = self._grown_uses()[numbers]
        order = np.argsort(-uses, kind="stable")[:CACHE_WORDS // 2]
        order = order[np.cumsum(np.frombuffer(self._count, np.int64)[numbers[order]]) <= CACHE_IDS // 2]
        order = order[numbers[order] > self[_END]]  # the three that every table begins with
        ids, ends, stops = self.lines(numbers[order])
        self._reset()
        self._append([pieces[i] for i in order.tolist()], ids, ends, stops)
        self._grown_uses()[-len(order):] = uses[order] >> 1

    def _grown_uses(self) -> np.ndarray:
        """In how many calls each number was used; numbers since the last call are added."""
        self._uses = np.concatenate([self._uses, np.zeros(len(self._first) - len(self._uses), np.int32)])
        return self._uses

    def _append(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> None:
        """New pieces with their ids one after another and the id counts after each."""
        numbers = range(len(self._first), len(self._first) + len(pieces))
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        self._first.frombytes((starts + len(self._ids)).tobytes())
        self._count.frombytes((ends - starts).tobytes())
        self._stops.frombytes(stops.astype(np.int8).tobytes())
        self._ids.frombytes(ids.astype(np.uint32, copy=False).tobytes())
        self.update(zip(pieces, numbers))

    def learn(self, pieces: set[str]) -> None:
        """Encodes the plain ones among new ``pieces`` in one call."""
        new = [w for w in pieces if w.isalpha() and len(w) <= CACHE_WORD_CHARS]
        if not new:
            return
        ids = np.array(self._encode_batch([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self._word_end[ids]) + 1
        if len(ends) == len(new):  # else they are encoded one by one
            self._append(new, ids, ends, np.zeros(len(new), bool))

    def lines(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the numbered pieces one after another, the id counts after each, and where a sentence or line ends."""
        self._grown_uses()[numbers] += 1
        first, count = np.frombuffer(self._first, np.int64)[numbers], np.frombuffer(self._count, np.int64)[numbers]
        ends = np.cumsum(count)
        where = np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
        return np.frombuffer(self._ids, np.uint32)[where].astype("<u4", copy=False), ends, np.frombuffer(self._stops, bool)[numbers]


_TABLES: dict[tuple[str, int], WordIds] = {}


def word_ids(name: str = TOKENIZER, end_id: int = 2) -> WordIds:
    """This worker's table for a vocabulary file of the public tokenizers."""
    import public_tokenizers
    key = public_tokenizers.path(name), end_id
    if key not in _TABLES:
        _TABLES[key] = WordIds(*key)
    return _TABLES[key]


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut after spaces or line feeds."""
    lo = 0
    while len(text) - lo > size:
        cut = max(text.rfind(" ", lo, lo + size), text.rfind("\n", lo, lo + size))
        if cut < lo:
            found = [p for p in (text.find(" ", lo + size), text.find("\n", lo + size)) if p >= 0]
            if not found:
                break
            cut = min(found)
        yield text[lo:cut + 1]
        lo = cut + 1
    yield text[lo:]


def _pieces(text: str, table: WordIds) -> list[str]:
    if not table.has_special(text):
        text = _MARKS.sub(r" \g<0>", text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    return text.replace("\n", " \n ").split(" ")


def encode(texts: list[str], closes: list[bool], table: WordIds) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Ids of texts one after another, the end id after each that ``closes``.

    Returns the ids (uint32 bytes), the id counts before which a sentence or
    line ends, and those at which each closing text ends.
    """
    table.make_room()
    pieces: list[str] = []
    last = []
    for text, ends in zip(texts, closes):
        pieces += _pieces(text, table)
        if ends:
            last.append(len(pieces))
            pieces.append(_END)
    numbers = np.fromiter(map(table.get, pieces, repeat(-1)), np.int64, len(pieces))
    unknown = np.flatnonzero(numbers < 0)
    if len(unknown):
        new = [pieces[i] for i in unknown.tolist()]
        table.learn(set(new))
        numbers[unknown] = np.fromiter(map(table.__getitem__, new), np.int64, len(new))
    ids, ends, stops = table.lines(numbers)
    stops = ends[stops]
    return ids.tobytes(), stops[np.diff(stops, prepend=-1) > 0], ends[last]
