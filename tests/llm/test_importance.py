"""Importance resampling against a plain loop over features."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetspark.llm import importance, registry

registry.load_all()


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _features(text, low, high):
    w = _words(text)
    return [" ".join(w[i:i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def _expected(docs, bench, low, high, buckets):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in _features(t, low, high))
    t = Counter(bucket(f) for x in bench for f in _features(x, low, high))
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        own = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
               for b in map(bucket, _features(text, low, high))]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(own), weight, score, len(_words(text))))
    entered = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = len(entered) * 10 // 100
    return Counter([(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(entered)]
                   + [(*r[:4], None) for r in rows if r[4] < 20])


def test_query(spark, sf, docs):
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = Counter(map(tuple, registry.QUERIES["op13_importance_resampling"](spark, sf).collect()))
    assert got == _expected([(d, t) for d, t, *_ in docs], bench, 1, 1, 10_000)


def test_longer_features(spark):
    docs = [(i, " ".join(f"w{(i * j) % 7}" for j in range(25 + i))) for i in range(30)] + [(None, "one two"), (99, None)]
    bench = ["w1 w2 w3 W4", "w0 w0 w0"]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([(b,) for b in bench], "text string")
    got = importance.resample(spark, df, target, low=1, high=3, buckets=64).collect()
    assert Counter(map(tuple, got)) == _expected(docs, bench, 1, 3, 64)


@pytest.mark.parametrize("text", ["", "a", "A bC-d", "x  y\t\tz 1é2 ß", "--- ..."])
def test_overlapped_spans_are_all_word_runs(text):
    for low, high in ((1, 1), (2, 2), (1, 4)):
        got = importance.feature_buckets(text, importance.span_patterns(low, high), 1 << 30)
        assert sorted(got) == sorted(zlib.crc32(f.encode()) % (1 << 30) for f in _features(text, low, high))


def test_benchmark_like_texts_weigh_more(spark):
    docs = [(i, " ".join(["common"] * 30 + [f"u{i}"])) for i in range(60)] + [(1000, "rare words of the exam " * 6)]
    got = importance.resample(spark, spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame([("rare words of the exam",)], "text string")).collect()
    weight = {r.doc_id: r.weight for r in got}
    assert weight[1000] > max(w for d, w in weight.items() if d != 1000) + 1000 and np.median(list(weight.values())) < 0
