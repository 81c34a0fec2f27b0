"""Numbers along an order against Python's sort."""

import random
from collections import defaultdict

import pytest

from fleetspark.operators.numbering import number_rows


def _rows(n=4000):
    rng = random.Random(8)
    # one group holds most rows, one row repeats very often, nulls in every column
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.randint(0, 50), i % 7 or None) for i in range(n)]
    return rows + [("hot", 25, 3)] * 1500


@pytest.mark.parametrize("group", [[], ["g"]])
def test_numbers_follow_the_order(spark, group):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, v int, w int").repartition(5)
    got = defaultdict(list)
    for r in number_rows(df, ["v", "w"], group).collect():
        got[r.g if group else 0].append((r.number, r.v, r.w))
    for key, numbered in got.items():
        numbered.sort()
        mine = [(v, w) for g, v, w in rows if not group or g == key]
        assert [n for n, *_ in numbered] == list(range(1, len(mine) + 1))
        assert [(v, w) for _, v, w in numbered] == sorted(mine, key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "g string, v int")
    assert number_rows(empty, ["v"], ["g"]).collect() == []
    with pytest.raises(ValueError):
        number_rows(spark.createDataFrame([(1, 2)], "v int, number int"), ["v"])


def test_candidates_of_one_host_spread(spark):
    from fleetspark.operators import audit as au
    n = 3000
    rows = [(f"registry.example.com/team/image:{i:05d}", 1.0, 2.0, 3.0, 0.0, "small", "eu", 2, 2) for i in range(n)]
    schema = ", ".join(f"{c} {'string' if c in ('image_name', 'sandbox_class', 'regions_key') else 'double'}"
                       for c in au.CANDIDATE_KEY) + ", distinct_names long, members long"
    numbered = au.candidate_numbering(spark.createDataFrame(rows, schema).repartition(4)).collect()
    assert {r.candidate_id: r.image_name for r in numbered} == {f"candidate-{i + 1:03d}": rows[i][0] for i in range(n)}
