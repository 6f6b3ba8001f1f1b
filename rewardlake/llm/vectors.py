"""Vector helpers shared by the two search operators: packing and block-wise joins."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window

from rewardlake.llm.common import F, run_arrow, written
from rewardlake.operators.joins import bounded_broadcast
from rewardlake.operators.positions import prefix_sums

CANDIDATES_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 4096


def dimension(df: DataFrame, vec_col: str) -> int:
    """The most frequent vector length (the larger of equals); 0 without vectors."""
    top = (df.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("n")).count()
           .orderBy(F.desc("count"), F.desc("n")).limit(1).collect())
    return int(top[0]["n"]) if top else 0


def packed(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: float | None = None) -> DataFrame:
    """``vec_id, v, norm``: each vector as packed doubles, ``floor(scale * x)`` if ``scale`` is set.

    Rows with a null id, and vectors that are null, hold null or non-finite components or differ
    from the table's most frequent length, take no part. An id stands for one vector: of rows that
    repeat an id the one with the smallest packed vector counts."""
    dim = dimension(df, vec_col)
    src = df.select(F.col(id_col).cast("long").alias("vec_id"),
                    F.col(vec_col).cast("array<double>").alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") == dim)
        & ~F.exists("x", lambda c: c.isNull()))

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.asarray(b.column("x").flatten(), dtype=np.float64).reshape(b.num_rows, dim)
        keep = np.isfinite(x).all(axis=1)
        x = x[keep]
        if scale is not None:
            x = np.floor(scale * x)
        x += 0.0                                          # no negative zeros
        return pa.RecordBatch.from_arrays(
            [b.column("vec_id").filter(pa.array(keep)),
             pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "v"])

    return run_arrow(src, rows, "vec_id long, v binary").groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(packed_rows) -> np.ndarray:
    """Rows of packed doubles as a matrix."""
    rows = list(packed_rows)
    if not rows:
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def search_blocks(cands: DataFrame, queries: DataFrame, kernel, schema: str, home: int
                  ) -> DataFrame:
    """``kernel(candidates, queries)`` for each block of candidates and block of queries that wants
    it. ``cands`` has ``block``; ``queries`` has ``query_id`` and ``blocks``, the candidate blocks
    it wants, of which the one at place ``home`` says which queries are alike: queries are put into
    blocks of about ``QUERIES_PER_BLOCK`` in order of it, so that a block of queries wants few blocks of
    candidates, and a block of candidates is sent to those that want it and to no others. Both
    sides of a task are bounded by the block sizes."""
    queries = written(queries.where(F.size("blocks") > 0)
                      .withColumn("home", F.element_at("blocks", home).cast("long")))
    sizes = queries.groupBy("home").agg(F.count(F.lit(1)).alias("n"))
    before = written(prefix_sums(sizes, "home", "n", "before").join(sizes, "home"))
    place = F.col("before") + F.pmod(F.xxhash64("query_id"), F.col("n"))
    placed = (queries.join(bounded_broadcast(before), "home")
              .withColumn("q_block", F.floor(place / QUERIES_PER_BLOCK))
              .drop("home", "before", "n").withColumn("block", F.explode("blocks")).drop("blocks"))
    wanted = placed.select("block", "q_block").distinct()
    left = cands.join(wanted, "block")

    def one(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return kernel(c, q) if len(c) and len(q) else empty

    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64),
                          "score": np.zeros(0)})
    right = placed.withColumnsRenamed({"block": "of_block", "q_block": "of_q_block"})
    return (left.groupBy("block", "q_block").cogroup(right.groupBy("of_block", "of_q_block"))
            .applyInPandas(one, schema))


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each query over all blocks, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def k_best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, highest first, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]
