"""Exact top-k search by inner product with Fagin's threshold algorithm.

Queries and candidates are dealt into blocks, and each pair of blocks is one group of work. A candidate block is
sorted once along every dimension. A block of queries then reads all lists together from both ends, deeper from
round to round: each vector met is scored in full, and a query leaves as soon as the best score that an unseen
vector could have, the sum over dimensions of its weight times the list's value at that depth, is below its kth
result. The k best of each block meet in a last ranking.

Defined results: vectors that are null, hold null or non-finite components, or have no id take no part; repeated
rows count once; a shorter vector counts as padded with zeros; equal scores go by the smaller id; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landsieve.llm.common import written
from landsieve.session import ship_package

#: Rows of a candidate block and of a query block: bounds of one task's work.
CANDIDATES, QUERIES = 8192, 1024
FIRST_DEPTH, DEEPER = 16, 8
LONG = 2**63 - 1


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def _usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(r) == width for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def block_top_k(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
    """(query row, candidate row, score) of each query's k best candidates with another id; x by ascending id.

    Numbers are of the narrowest kind that holds every sum exactly; scores past a long are cut to its range.
    """
    n = len(x)
    bound = max(-int(q.min(initial=0)), int(q.max(initial=0))) * max(-int(x.min(initial=0)), int(x.max(initial=0))) * q.shape[1]
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    qk, xk = q.astype(kind), x.astype(kind)
    whole = lambda s: s.astype(np.int64) if kind is not object else np.clip(s, -LONG, LONG).astype(np.int64)
    lists = np.argsort(x, axis=0, kind="stable")
    seen = np.zeros(n, bool)
    active = np.arange(len(q))
    best_score = np.full((len(q), k), np.iinfo(np.int64).min)
    best_row = np.full((len(q), k), n)
    depth = 0
    while len(active) and depth < n:
        to = min(n, max(FIRST_DEPTH, depth * DEEPER))
        met = np.zeros(n, bool)
        met[lists[depth:to].ravel()] = True
        met[lists[n - to:n - depth].ravel()] = True
        fresh = np.flatnonzero(met & ~seen)
        seen[fresh] = True
        if len(fresh):
            score = whole(qk[active] @ xk[fresh].T)
            score[q_ids[active][:, None] == x_ids[fresh][None, :]] = np.iinfo(np.int64).min
            score = np.concatenate([best_score[active], score], axis=1)
            row = np.concatenate([best_row[active], np.broadcast_to(fresh, (len(active), len(fresh)))], axis=1)
            if score.shape[1] > k:
                # every score at or above the kth stays in, so that ties are settled by the row
                kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                for i, a in enumerate(active):
                    c = np.flatnonzero(score[i] >= kth[i])
                    c = c[np.lexsort((row[i, c], -score[i, c]))[:k]]
                    best_score[a], best_row[a] = score[i, c], row[i, c]
        high, low = xk[lists[n - to], np.arange(x.shape[1])], xk[lists[to - 1], np.arange(x.shape[1])]
        threshold = whole(np.maximum(qk[active], 0) @ high + np.minimum(qk[active], 0) @ low)
        depth = to
        active = active[best_score[active, -1] <= threshold]
    at = np.nonzero(best_score > np.iinfo(np.int64).min)
    return at[0], best_row[at], best_score[at]


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k best candidates (id, z) of each query (id, z): query_id, rank, vec_id, score."""
    n_q, n_x = queries.count(), candidates.count()
    q_blocks, x_blocks = max(1, -(-n_q // QUERIES)), max(1, -(-n_x // CANDIDATES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("id", "z"), F.lit(q_blocks)).cast("int")).withColumn("xb", every(x_blocks))
    x = candidates.withColumn("xb", F.pmod(F.xxhash64("z", "id"), F.lit(x_blocks)).cast("int")).withColumn("qb", every(q_blocks))
    schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by("id")
        width = max(max(map(len, t["z"].to_pylist()), default=0) for t in (left, right)) or 1
        q_ids, x_ids = left["id"].to_numpy(), right["id"].to_numpy()
        a, b, score = block_top_k(_matrix(left["z"], width), q_ids, _matrix(right["z"], width), x_ids, k)
        return pa.table([pa.array(q_ids[a]), pa.array(left["query"].to_numpy()[a]), pa.array(x_ids[b]), pa.array(score)],
                        schema=schema)

    ship_package(queries.sparkSession)
    cols = ["qb", "xb", "id", "z"]
    q = q.select(*cols, F.xxhash64("id", "z").alias("query"))
    near = (q.groupBy("qb", "xb").cogroup(x.select(*cols).groupBy("qb", "xb"))
            .applyInArrow(run, "query_id long, query long, vec_id long, score long"))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def embedding_top_k(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; candidates are all."""
    rows = written(embeddings.filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("z")).distinct(), "vectors")
    return top_k(rows.filter(F.col("id") % every == 0), rows, k)
