"""Periodic runs against a search over all places and periods."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetspark.llm import periodic, registry
from fleetspark.llm.suffix_runs import periodic_runs

registry.load_all()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words, least=6, times=4):
    """Every stretch by definition: for each period the places that equal their successor, smallest periods only."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        equal = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, same in enumerate(equal):
            if same and start is None:
                start = i
            elif not same and start is not None:
                length = i + q - start
                smaller = any(all(words[t] == words[t + p] for t in range(start, i + q - p)) for p in range(1, q))
                if length >= max(least, times * q) and not smaller:
                    out.append((start, length, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    rng = random.Random(12)
    for _ in range(800):
        sequences = []
        for _ in range(rng.randint(1, 5)):
            n, letters = rng.randint(0, 45), rng.randint(1, 4)
            s = [rng.randrange(letters) for _ in range(n)]
            if rng.random() < 0.6 and n > 8:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                s = s[:a] + [s[a + (i - a) % p] for i in range(a, n)]
            sequences.append(s)
        flat = np.array([x for s in sequences for x in s], np.int64)
        got = [[] for _ in sequences]
        for q, *run in zip(*(c.tolist() for c in periodic_runs(flat, np.array([len(s) for s in sequences])))):
            got[q].append(tuple(run))
        assert got == [all_runs(s) for s in sequences]


@pytest.mark.parametrize("words, runs", [
    ([b"a"] * 50_000, [(0, 50_000, 1)]),
    ([b"x", *[b"a", b"b"] * 30_000, b"a", b"y"], [(1, 60_001, 2)]),
    ([b"a"] * 5, []), ([b"a"] * 6, [(0, 6, 1)]), ([b"a", b"b"] * 3, []), ([b"a", b"b"] * 4, [(0, 8, 2)])])
def test_long_and_short_runs(words, runs):
    assert periodic.runs_of([words]) == [runs]


def test_query(spark, sf, docs):
    rows = registry.QUERIES["op12_periodic_runs"](spark, sf).collect()
    expected, with_run = Counter(), 0
    for doc_id, text, *_ in docs:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = all_runs(words) if n < 1000 else periodic.runs_of([[w.encode() for w in words]])[0]
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        listed = "".join("%d,%d,%d\n" % r for r in runs)
        left = " ".join(w for i, w in enumerate(words) if i not in dropped)
        with_run += bool(runs)
        expected[(doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
                  hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())] += 1
    assert Counter(map(tuple, rows)) == expected and with_run >= 3


def test_collapse_keeps_other_texts(spark):
    texts = ["go  on\n", "na " * 9 + "end", None, "", "one two " * 5]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    got = {r.doc_id: (r.text, r.runs) for r in periodic.collapse_runs(df).collect()}
    assert [got[i][0] for i in range(5)] == ["go  on\n", "na end", None, "", "one two"] and got[0][1] == "k"
