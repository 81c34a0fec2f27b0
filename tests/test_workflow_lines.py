"""The workflow views hold every line of every text as it is."""

from collections import Counter

from fleetspark.operators import textscan as ts
from fleetspark.plans.queries_text import lines_df
from fleetspark.sources.fixtures import fixture


def test_every_line_is_read(spark, tmp_path):
    bad = ["      uses: org/action@v1", "AWS_ACCESS_KEY_ID: x", "  runs-on: ubuntu-latest", "", "plain"]
    rows = [(i, "\n".join(bad[i % 5:] + bad[:i % 5]), "en", "s", 0) for i in range(1, 29)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{path}/documents.parquet")
    lines = fixture(spark, path, "fx_workflow_lines")
    own = {r.line_no: r.text for r in lines.where("line_no > 0").collect()}
    assert own == {i * 1000000 + n: line for i, text, *_ in rows for n, line in enumerate(text.split("\n"), 1)}
    shapes = [r.line_no for r in lines.where("line_no < 0").collect()]
    assert sorted(shapes) == sorted(-1 - k for k in own if (k // 1000000 + k % 1000000) % 14 < 7)
    assert ts.forbidden_names(lines_df(spark, path)).where("text = 'AWS_ACCESS_KEY_ID: x'").count() == len(rows)
    found = Counter(r.text for r in ts.unpinned_uses(lines_df(spark, path)).collect())
    assert found["      uses: org/action@v1"] == len(rows)
