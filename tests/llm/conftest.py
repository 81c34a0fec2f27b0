import os
import random

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "row_id string, size string, fp string, copies string, row string, held_out string, label string")


def _prose(rng, n):
    return " ".join("".join(rng.choice("aeioubdkrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def make_docs(seed=3):
    """Nulls in every column, empty and long texts, exact and near copies, repeated rows, clashing extra columns."""
    rng = random.Random(seed)
    base = [_prose(rng, rng.randint(20, 120)) + "." for _ in range(40)]
    shared = _prose(rng, 60)
    texts = [*base, base[0], base[0], base[1].replace("a", "e", 1), base[2] + " tail", None, "", " \t\n", "one", "Two words",
             "x" * 450, "ab " * 300, "é" * 250 + shared, shared + base[3], base[4] + "\n" + shared, base[5] + shared + base[6],
             "line of words\n" * 12, 'token = "abcdefgh1234"; PASSWORD: short', "AKIA" + "A1B2" * 4 + " " + "0f" * 20,
             "token: secret: abcdefghij", _prose(rng, 9000)]
    langs, sources = ["en", "fr", None], ["s1", "s2", "S3", None]
    rows = [(i if i != 7 else None, t, langs[i % 3], sources[i % 4], len(t or ""), "r", "s", "f", "c", "w", "h", "l")
            for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], rows[44]]


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory):
    """A folder of tables with every odd case."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = make_docs()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], i % 2, int(i % 5 == 0)) for i, r in enumerate(rows)] + [(1, None, None), (None, 1, 1), (2, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    bench = [(0, rows[0][1], "x"), (1, rows[1][1], "y"), (2, None, "z"), (2, None, "z"), (None, "", None), (3, "Ab ab 12 é", "w")]
    spark.createDataFrame(bench, "item_id long, text string, doc_id string").write.parquet(f"{path}/benchmark.parquet")
    nan, inf = float("nan"), float("inf")
    rng = random.Random(5)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(130)]
    vectors += [(200, None), (220, [nan] * 6), (240, [inf] + [0.0] * 5), (260, [None] * 6), (280, [0.5] * 3), (281, [0.25] * 3),
                (300, []), (301, []), (None, [0.1] * 6), vectors[20], vectors[20], vectors[41]]
    spark.createDataFrame([(a, b, 0, "q") for a, b in vectors], "vec_id long, embedding array<float>, label int, q string"
                          ).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="session")
def empty_sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="session")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
