"""Bounded slices of a text column for numpy work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Characters handled at once by the numpy kernels.
SLICE_CHARS = 1 << 20


def parts(text: str, size: int) -> Iterator[str]:
    """A text in parts of at most about ``size`` characters, cut at ASCII white space where there is any."""
    lo = 0
    while len(text) - lo > size:
        cut = max(text.rfind(c, lo + size // 2, lo + size) for c in " \n\t")
        cut = lo + size if cut < 0 else cut + 1
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


def text_slices(column: pa.Array, size: int = SLICE_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """``(row numbers, texts)`` with at most about ``size`` characters in all; long texts come in parts.

    Null texts come as empty ones, so every row occurs.
    """
    rows, texts, total = [], [], 0
    for row, value in enumerate(column):
        for part in parts(value.as_py() or "", size):
            if texts and total + len(part) > size:
                yield rows, texts
                rows, texts, total = [], [], 0
            rows.append(row)
            texts.append(part)
            total += len(part)
    if texts:
        yield rows, texts
