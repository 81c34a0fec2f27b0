"""Exact top-k inner-product search by Fagin's threshold algorithm.

Candidates are dealt into blocks.  Inside a block every dimension has a
sorted list; a batch of queries reads all lists from both ends at the same
depth (a negative query weight wants the low end), scores each row the first
time any list shows it, and a query stops when its k-th score beats the sum
of the best values left in the lists.  Blocks give partial top-k lists, a
ranking per query merges them.

Defined cases: a vector that is null, or holds a null, NaN or infinite
component, takes no part, nor does a row without ``vec_id``.  Vectors meet
only vectors of equal length.  A row never meets rows of its own id; repeated
candidate rows count each, a repeated identical query row is answered once.
Ties go to the smaller id.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import read, register

#: Rows per block: bounds a task's memory, never what is searched.
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 4096
#: Rows scored between two looks at the stopping bound.
STEP = 1024


def quantise(df: DataFrame, id_col: str, vector_col: str, scale: float = 64.0) -> DataFrame:
    """``(vec_id, q)`` with integer components, rows that take part only."""
    v = F.col(f"`{vector_col}`")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (df.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & usable)
            .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("q")))


def _matrix(table: pa.Table) -> np.ndarray:
    """The ``q`` column as an n x d matrix (all rows have the same length)."""
    n = table.num_rows
    flat = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _product(queries: np.ndarray, rows: np.ndarray, exact_float: bool) -> np.ndarray:
    """Integer inner products; floats carry them only while they are exact."""
    if exact_float:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def threshold_topk(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int,
                   step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Per query the k best rows of one block: (query position, row, score, rows scored)."""
    by_id = np.argsort(ids, kind="stable")
    ids, x = ids[by_id], x[by_id]
    n, d = x.shape
    lists = np.argsort(x, axis=0, kind="stable")
    sorted_x = np.take_along_axis(x, lists, axis=0)
    place = np.empty_like(lists)
    np.put_along_axis(place, lists, np.broadcast_to(np.arange(n)[:, None], (n, d)), axis=0)
    # depth at which a list, read from its nearer end, first shows the row
    depth = np.minimum(place, n - 1 - place).min(axis=1) if d else np.zeros(n, np.int64)
    seen_order = np.argsort(depth, kind="stable")
    depth_sorted = depth[seen_order]

    limit = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(d, 1)
    exact_float = limit < 2 ** 53
    packed = limit * n < 2 ** 62  # score and tie-break in one integer key

    active = np.arange(len(qids))
    best_row = np.full((len(qids), k), -1, np.int64)
    best_score = np.zeros((len(qids), k), np.int64)
    lo = scored = 0
    while lo < n and active.size:
        hi = min(n, lo + step)
        reached = int(depth_sorted[hi - 1]) + 1
        hi = int(np.searchsorted(depth_sorted, reached))
        rows = seen_order[lo:hi]
        scored += rows.size * active.size
        score = _product(q[active], x[rows], exact_float)
        all_rows = np.concatenate([best_row[active], np.broadcast_to(rows, score.shape)], axis=1)
        all_scores = np.concatenate([best_score[active], score], axis=1)
        out = (all_rows < 0) | (ids[np.maximum(all_rows, 0)] == qids[active][:, None])
        if packed:
            key = all_scores * n - all_rows  # ids are sorted: a smaller row is a smaller id
            key[out] = np.iinfo(np.int64).min
            kk = min(k, key.shape[1])
            pick = np.argpartition(-(key + 1), kk - 1, axis=1)[:, :kk]
            chosen = np.take_along_axis(key, pick, axis=1)
            pick = np.take_along_axis(pick, np.argsort(-(chosen + 1), axis=1), axis=1)
        else:
            pick = np.lexsort((all_rows, -all_scores, out), axis=1)[:, :k]
        dropped = np.take_along_axis(out, pick, axis=1)
        new_rows = np.where(dropped, -1, np.take_along_axis(all_rows, pick, axis=1))
        best_row[active, :new_rows.shape[1]] = new_rows
        best_score[active, :new_rows.shape[1]] = np.take_along_axis(all_scores, pick, axis=1)
        lo = hi
        if lo < n:
            # an unseen row lies strictly inside the depth read at both ends of every list
            high, low = sorted_x[n - 1 - reached], sorted_x[reached]
            bound = np.maximum(q[active] * high, q[active] * low).sum(axis=1)
            full = best_row[active, k - 1] >= 0
            active = active[~(full & (best_score[active, k - 1] > bound))]
    at, col = np.nonzero(best_row >= 0)
    return at, ids[best_row[at, col]], best_score[at, col], scored


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20,
          candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows of ``vectors``.

    Both inputs come from :func:`quantise`.  The query set meets all rows
    block by block: each pair of blocks is one group of bounded size, so
    neither side is ever whole in one place.
    """
    queries = queries.dropDuplicates(["vec_id", "q"])
    n_rows, n_queries = vectors.count(), queries.count()
    n_blocks = max(1, math.ceil(n_rows / candidate_block))
    n_query_blocks = max(1, math.ceil(n_queries / query_block))

    def dealt(df: DataFrame, block: Column, own: int, other: int, own_col: str, other_col: str) -> DataFrame:
        return (df.withColumn("dims", F.size("q"))
                .withColumn(own_col, F.pmod(block, F.lit(own)).cast("int"))
                .withColumn(other_col, F.explode(F.sequence(F.lit(0), F.lit(other - 1)))))

    # candidates by their place in the scan as well, so that copies of a row spread; queries differ in content and
    # come out of a shuffle, whose order a repeated task need not keep, so their block is data
    left = dealt(vectors, F.xxhash64("vec_id", F.monotonically_increasing_id()), n_blocks, n_query_blocks, "c_block", "q_block")
    right = dealt(queries, F.xxhash64("vec_id", "q"), n_query_blocks, n_blocks, "q_block", "c_block")

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            empty = pa.array([], pa.int64())
            return pa.table({"query_id": empty, "vec_id": empty, "score": empty})
        qids = asked.column("vec_id").to_numpy()
        at, ids, score, _ = threshold_topk(rows.column("vec_id").to_numpy(), _matrix(rows), qids, _matrix(asked), k)
        return pa.table({"query_id": qids[at], "vec_id": ids, "score": score})

    keys = ["q_block", "c_block", "dims"]
    partial = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
               .applyInArrow(search, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 20 = 0),
r AS (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@register("op10_topk_search", _SQL)
def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every embedding whose id is divisible by 20."""
    vectors = quantise(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(spark, vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)
