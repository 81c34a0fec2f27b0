"""Kneser-Ney likelihoods of op5 against a plain version, the join beside the broadcast, and fixed expressions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.llm import toxicity


def _text(rng, n, words=40):
    return " ".join(f"w{min(int(rng.expovariate(0.08)), words)}" for _ in range(n))


def _pairs(text):
    words = ["#", *text.split(), "#"]
    return list(zip(words, words[1:]))


def _log_ratio(text, learnt):
    """Per pair of the text: log P(w | v) in class 1 less that in class 0."""
    c = {label: Counter(p for t, y in learnt if y == label for p in set(_pairs(t))) for label in (0, 1)}
    pooled = Counter(w for _, w in {*c[0], *c[1]})
    total, words, out = sum(pooled.values()), len(pooled), 0.0
    for v, w in _pairs(text):
        log_p = []
        for label in (1, 0):
            before = Counter(x for _, x in c[label])
            d = toxicity.DISCOUNT
            shared = (max(pooled[w] - d, 0) + d * words / (words + 1)) / total
            low = (max(before[w] - d, 0) + d * len(before) * shared) / sum(before.values())
            begun = [n for (x, _), n in c[label].items() if x == v]
            log_p.append(math.log(max(c[label][v, w] - 1, 0) / sum(begun) + len(begun) / sum(begun) * low if begun else low))
        out += log_p[0] - log_p[1]
    return out / len(_pairs(text))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    rows = []
    for i in range(60):
        text = _text(rng, rng.randint(3, 40)) + (" vile scum" if i % 3 == 0 else " scum vile" if i % 7 == 0 else "")
        rows.append((i, text, int(i % 3 == 0)))
    return [*rows, (60, rows[0][1], rows[0][2]), (61, "", 0), (62, "scum", 1)]


def _fitted(spark, rows, **more):
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    return toxicity.fit(frame, F.col("doc_id") % 4 != 0, F.col("doc_id") % 4 == 0, **more)


def _evidence(spark, docs, model):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    found = toxicity.evidence(spark, frame, ["doc_id"], model).collect()
    return {r.doc_id: np.array(r[1:]) for r in found}


def test_likelihoods_match_plain_kneser_ney(spark, rows):
    learnt = {(t, y) for i, t, y in rows if i % 4 != 0}
    docs = [(i, t) for i, t, _ in rows] + [(70, "unseen words only"), (71, None), (72, "w1 unseen w1 w2 w1 w2")]
    found = _evidence(spark, docs, _fitted(spark, rows))
    assert len(found) == len(docs)
    for i, text in docs:
        assert found[i][toxicity.SUMS - 1] == pytest.approx(_log_ratio(text or "", learnt), rel=1e-4, abs=1e-5), text


def test_joined_terms_give_the_same_sums(spark, rows):
    docs = [(i, t) for i, t, _ in rows] + [(70, "unseen words only"), (71, None)]
    whole, joined, none = (_fitted(spark, rows, hot_terms=n) for n in (1 << 20, 25, 0))
    assert whole.rest is None and joined.rest.count() > 0 and not len(none.terms.value.term)
    expected = _evidence(spark, docs, whole)
    for model in (joined, none):
        assert np.allclose(model.slopes, whole.slopes, atol=1e-4)
        found = _evidence(spark, docs, model)
        assert all(np.allclose(found[i], expected[i], atol=1e-6) for i in expected) and len(found) == len(expected)


def test_long_texts_are_read_across_slices(monkeypatch):
    import pyarrow as pa

    from fleetspark.llm import slices
    rng = random.Random(2)
    texts = pa.array([_text(rng, 300), None, "", _text(rng, 5), _text(rng, 700), "one"])

    def found():
        out = defaultdict(Counter)
        for row, pair, times in toxicity.text_pairs(texts):
            for r, p, n in zip(row.tolist(), pair.tolist(), times.tolist()):
                assert p not in out[r]
                out[r][p] = n
        return out

    whole = found()
    assert [sum(whole[r].values()) for r in range(6)] == [301, 1, 1, 6, 701, 2]
    monkeypatch.setattr(toxicity, "text_slices", lambda column: slices.text_slices(column, 64))
    assert found() == whole


def test_a_fixed_expression_of_ordinary_words_is_learnt(spark):
    """Both words are as frequent, after as many different words, in either class; only their meeting tells."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = _text(rng, 30, 200).split()
        for word in ("north", "wind"):
            words.insert(rng.randrange(len(words)), word)
        toxic = i % 2
        words.insert(rng.randrange(len(words)), "north wind" if toxic else "wind north")
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumn("held_out", F.col("doc_id") >= 300)
    i = F.col("doc_id")
    model = toxicity.fit(docs.drop("held_out"), i < 220, (i >= 220) & (i < 300))
    found = {r.doc_id: r.predicted for r in toxicity.score(spark, docs, model).where("held_out").collect()}
    assert sum(found[i] == toxic for i, _, toxic in rows if i >= 300) >= 90
