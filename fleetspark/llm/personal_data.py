r"""Patterns of personal data: e-mail addresses, IP addresses, payment cards, telephone numbers.

Matches of a kind are leftmost and do not overlap; a match that fails its
check (parts, digits, Luhn) is dropped and not tried again further in.  All
searches are linear in the length of the text.
"""

from __future__ import annotations

import re

# fixed values: the kinds in order, and what a match of each looks like
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a digit run is tried from its start only
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS = (14, 19)
PHONE_DIGITS = (10, 15)

_DIGIT = re.compile(r"[0-9]")
_OTHER = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind number, end (code points)


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        domain = _DOMAIN.match(text, at + 1) if lo < at else None
        if domain:
            done = domain.end()
            out.append((lo, 0, done))
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    """The check sum of card numbers: every second digit from the right counts double."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """All base spans of a text by start, then kind."""
    spans = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small_part, m[0].split(".")))]
        for kind, pattern, (least, most) in ((2, _CARD, CARD_DIGITS), (3, _PHONE, PHONE_DIGITS)):
            for m in pattern.finditer(text):
                if m.end() - m.start() >= least:
                    digits = _OTHER.sub("", m[0])
                    if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                        spans.append((m.start(), kind, m.end()))
    return sorted(spans)


def value_of(text: str, span: Span) -> str:
    """What a span says, spelt one way: small letters for addresses, the digits (and dots) of numbers."""
    found = text[span[0]:span[2]]
    return f"{KINDS[span[1]]}:{found.lower() if span[1] < 2 else _OTHER.sub('', found)}"
