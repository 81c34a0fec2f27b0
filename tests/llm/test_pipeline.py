"""The pipeline against a brute-force version, stage by stage."""

import os
import sys
from collections import Counter

import pytest

from fleetspark.llm import registry
from tests.llm.conftest import ROOT

sys.path.insert(0, ROOT)
import corpus_pipeline  # noqa: E402

registry.load_all()


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """Input and result of each stage, written and read again."""
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name))
        stage(spark, docs, sf).write.parquet(f"{path}/documents.parquet")
        out.append((docs, spark.read.parquet(f"{path}/documents.parquet"), path))
        docs = out[-1][1]
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def query(spark, name, steps, i, sf):
    """The stage's own query over the stage's input."""
    path = steps[i - 1][2] if i else sf
    return registry.QUERIES[name](spark, path).collect()


def test_columns(steps):
    for before, after, _ in steps[:-1]:
        assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_quality_stage(spark, sf, steps):
    kept = Counter(r.doc_id for r in query(spark, "op3_quality_rules", steps, 0, sf) if r.kept)
    before, after, _ = steps[0]
    assert Counter(r.doc_id for r in after.collect()) == kept
    assert not rows(after) - rows(before)


def test_simhash_stage(spark, sf, steps):
    found = query(spark, "op9_simhash_near_dedup", steps, 1, sf)
    before, after, _ = steps[1]
    assert not rows(after) - rows(before)
    ids = [r.doc_id for r in after.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in found} - {None})


def test_secret_stage(spark, sf, steps):
    before, after, _ = steps[2]
    spans = {r.doc_id: r.spans for r in query(spark, "op6_secret_scan", steps, 2, sf)}
    new = {r.doc_id: r for r in after.collect()}
    assert after.count() == before.count()
    for r in before.collect():
        assert (new[r.doc_id].text == r.text) == (spans[r.doc_id] == "")
        assert new[r.doc_id].n_chars == (len(new[r.doc_id].text) if r.text is not None else None)


def test_mixing_stage(spark, sf, steps):
    before, after, _ = steps[3]
    words = {r.doc_id: r for r in query(spark, "op2_mix_sources", steps, 3, sf)}
    times = Counter(r.doc_id for r in after.collect())
    for doc_id, r in words.items():
        assert times[doc_id] * r.size == r.taken
    assert set(rows(after)) <= set(rows(before))


def test_packing_stage(steps):
    before, after, _ = steps[4]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_run(spark, sf, steps, empty_sf):
    def size(df):
        return Counter((r.doc_id, r.doc_tokens) for r in df.where("start = 0").collect())
    assert size(corpus_pipeline.run(spark, sf)) == size(steps[-1][1])
    assert corpus_pipeline.run(spark, empty_sf).count() == 0
    assert os.path.exists(os.path.join(ROOT, "corpus_pipeline.py"))
