"""What a worker holds stays bounded: remembered pieces, links of near copies; exploded tables are not broadcast."""

import tracemalloc

import numpy as np

from pyspark.sql import functions as F

from fleetspark.llm import mixing, simhash, tokens


def test_remembered_pieces_are_bounded():
    table = tokens.word_ids()
    letters = np.array(list("abcdefghijklmnopqrst"))
    most = 0
    for lo in range(0, 300_000, 20_000):
        words = ["".join(letters[[n // 20**k % 20 for k in range(5)]]) for n in range(lo, lo + 20_000)]
        ids, _, _ = tokens.encode([" ".join(words)], [True], table)
        assert np.frombuffer(ids, "<u4")[-1] == 2
        most = max(most, len(table))
    assert most <= 250_000


def test_links_of_near_copies_take_little_memory():
    bits = [1 << i for i in range(14)]
    fp = np.array(sorted(sum(b for i, b in enumerate(bits) if n >> i & 1) for n in range(4096)), np.uint64)
    tracemalloc.start()
    a, b = simhash._links_in(np.zeros(len(fp), np.int64), fp, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == len(fp) - 1 and set(b.tolist()) == {0}
    assert peak < 30_000_000


def test_frequent_pieces_stay_when_the_table_is_full():
    from tokenizers import Tokenizer
    import public_tokenizers
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    table = tokens.WordIds(public_tokenizers.path(tokens.TOKENIZER), 2)
    letters = np.array(list("abcdefghijklmnopqrst"))
    frequent = ["frequent", "words", "überall", "x1y2", "stay"]
    lo, full = 0, False
    while not full:
        full = len(table) >= tokens.CACHE_WORDS
        rare = ["".join(letters[[n // 20**k % 20 for k in range(5)]]) for n in range(lo, lo + 20_000)]
        text = " ".join(rare if full else frequent + rare)
        ids, _, ends = tokens.encode([text], [True], table)
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
        lo += 20_000
    assert len(table) < tokens.CACHE_WORDS and all(w in table for w in frequent)
    ids, _, _ = tokens.encode([" ".join(frequent)], [True], table)
    assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(" ".join(frequent), add_special_tokens=False).ids, 2]


def test_exploded_nodes_are_not_broadcast(spark):
    nodes = spark.range(3000).selectExpr("xxhash64(id) fp").union(spark.range(3000).selectExpr("xxhash64(id) ^ 5 fp"))
    links = simhash.near_links(nodes)
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().executedPlan().toString()
    found = {tuple(sorted(r)) for r in links.collect()}
    assert found == {tuple(sorted(r)) for r in nodes.limit(3000).selectExpr("fp a", "fp ^ 5 b").collect()}
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().executedPlan().toString()


def _outer_join(df):
    return next(line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)


def test_documents_are_not_broadcast(spark):
    docs = spark.range(300).selectExpr("id row_id", "id doc_id", "concat('some words of text ', id div 2) text")
    found = simhash.near_duplicates(spark, docs)
    assert found.count() == 300 and found.where("row_id <> keeper").count() >= 150
    assert "SortMergeJoin" in _outer_join(found)  # of all rows with their groups


def test_mixed_rows_are_not_broadcast(spark):
    rows = spark.range(500).selectExpr("id row_id", "id doc_id", "if(id % 3 = 0, null, concat('s', id % 7)) source", "id % 11 size")
    mixed, shuffled = mixing.mix(spark, rows), mixing.mix(spark, rows, broadcast_runs=3)
    assert "BroadcastHashJoin" in (join := _outer_join(mixed)) and "BuildRight" in join  # the runs
    assert "SortMergeJoin" in _outer_join(shuffled)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, shuffled.collect()))
    assert mixed.agg(F.count("*"), F.countDistinct("row_id")).first() == (500, 500)
