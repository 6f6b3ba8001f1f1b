"""Operator 1: exact top-k inner-product search with norm order, rotation and residual bounds.

Vectors are rotated by the right singular vectors of the whole table (from its second-moment
matrix, summed in Spark), so that leading components carry most of the length. They are dealt into
blocks by descending length. The first block gives each query a first k-th best score; a later
block is not visited at all if its greatest length times the query's cannot reach that score. In a
block, partial sums over leading rotated components plus the Cauchy-Schwarz bound on the rest
(residual length times residual length) discard candidates; the exact product is taken for those
left, and the k-th best score rises from slice to slice.

Bounds get a slack for rounding and only ever discard what cannot be among the k best, so results
are exact; integer components give exact integer scores while products stay below 2**53. Null,
odd or repeated vectors: see :func:`rewardlake.llm.vectors.packed`. An empty table or query set
gives an empty result. Ties go to the smaller id.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from rewardlake.llm.common import F, n_groups, run_arrow, written
from rewardlake.llm.vectors import (CANDIDATES_PER_BLOCK, best_of, k_best, matrix, packed,
                                    search_blocks)

SLICE = 2048            # candidates handled between two updates of the k-th best score
STEPS = (0.25, 0.5)     # shares of the components after which bounds are taken


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the table's right singular vectors, strongest first."""
    def partial(it):
        total = np.zeros((dim, dim))
        for b in it:
            x = matrix(b.column("v").to_pylist())
            if len(x):
                total += x.T @ x
        i, j = np.indices((dim, dim))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
             pa.array(total.ravel(), pa.float64())], ["i", "j", "s"])

    sums = (vectors.select("v").mapInArrow(partial, "i int, j int, s double")
            .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())      # dim x dim values
    moment = np.zeros((dim, dim))
    for r in sums:
        moment[r["i"], r["j"]] = r["s"]
    if not np.isfinite(moment).all():
        return np.eye(dim)
    _, vectors_ = np.linalg.eigh((moment + moment.T) / 2)
    return vectors_[:, ::-1].copy()


def block_kernel(rot: np.ndarray, k: int):
    """The search of one block of queries in one block of candidates (longest first)."""
    dim = len(rot)
    cuts = sorted({max(1, int(dim * s)) for s in STEPS} - {dim})

    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(["norm", "vec_id"], ascending=[False, True])
        ids, x = c["vec_id"].to_numpy(), matrix(c["v"])
        q_ids, y = q["query_id"].to_numpy(), matrix(q["v"])
        floor = q["floor"].to_numpy(dtype=np.float64).copy()
        xr, yr = x @ rot, y @ rot
        y_len = np.sqrt((y * y).sum(axis=1))
        kept = [(np.zeros(0), np.zeros(0, np.int64)) for _ in q_ids]
        for s in range(0, len(x), SLICE):
            part = slice(s, s + SLICE)
            xs, xrs, slice_ids = x[part], xr[part], ids[part]
            x_len = np.sqrt((xs * xs).sum(axis=1))
            slack = 1e-9 * (x_len[0] * y_len + 1.0)
            live = np.flatnonzero(x_len[0] * y_len + slack >= floor)   # longest of the slice
            if not len(live):
                continue
            mask, sums, done = np.ones((len(xs), len(live)), bool), 0.0, 0
            for cut in cuts:
                sums = sums + xrs[:, done:cut] @ yr[live, done:cut].T
                rest_x = np.sqrt((xrs[:, cut:] ** 2).sum(axis=1))
                rest_y = np.sqrt((yr[live, cut:] ** 2).sum(axis=1))
                mask &= (sums + rest_x[:, None] * rest_y + slack[live]) >= floor[live]
                done = cut
                if not mask.any():
                    break
            rows = np.flatnonzero(mask.any(axis=1))
            if not len(rows):
                continue
            scores = xs[rows] @ y[live].T                      # exact on integers
            for col, j in enumerate(live):
                at = np.flatnonzero(mask[rows, col] & (slice_ids[rows] != q_ids[j]))
                at = at[scores[at, col] >= floor[j]]
                if not len(at):
                    continue
                sc = np.concatenate([kept[j][0], scores[at, col]])
                vi = np.concatenate([kept[j][1], slice_ids[rows[at]]])
                top = k_best(sc, vi, k)
                kept[j] = sc[top], vi[top]
                if len(top) == k:
                    floor[j] = max(floor[j], sc[top[-1]])
        n = [len(v) for _, v in kept]
        return pd.DataFrame({"query_id": np.repeat(q_ids, n),
                             "vec_id": np.concatenate([v for _, v in kept]).astype(np.int64),
                             "score": np.concatenate([s for s, _ in kept])})
    return run


def norm_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """``vectors`` with ``norm`` and ``block``; blocks follow descending length, written.

    Lengths are cut at quantiles. Where many vectors share a length (copies of one vector) a block
    would be too large; it is dealt into several by the hash of the id. The blocks depend on the
    data alone, not on how many partitions hold it."""
    def lengths(b: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(b.column("v").to_pylist())
        return pa.RecordBatch.from_arrays(
            [b.column("vec_id"), b.column("v"), pa.array(np.sqrt((x * x).sum(axis=1)))],
            ["vec_id", "v", "norm"])

    schema = "vec_id long, v binary, norm double"
    sized = run_arrow(vectors.select("vec_id", "v"), lengths, schema)
    blocks = n_groups(rows, CANDIDATES_PER_BLOCK)
    cuts = np.unique(sized.select("norm").approxQuantile(
        "norm", [i / blocks for i in range(1, blocks)], 0.2 / blocks)) if blocks > 1 else []

    def ranged(b: pa.RecordBatch) -> pa.RecordBatch:
        # longest first: block 0 lies above the last cut
        at = len(cuts) - np.searchsorted(cuts, b.column("norm").to_numpy(), side="right")
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))],
                                          [*b.schema.names, "range"])

    placed = run_arrow(sized, ranged, schema + ", range int")
    counts = {r["range"]: r["count"] for r in placed.groupBy("range").count().collect()}
    parts = [n_groups(counts.get(i, 0), 2 * CANDIDATES_PER_BLOCK) for i in range(len(cuts) + 1)]
    first = [sum(parts[:i]) for i in range(len(parts))]
    at = (F.col("range") + 1).cast("int")
    return written(placed.withColumn("block", F.element_at(F.lit(first), at) + F.pmod(
        F.xxhash64("vec_id"), F.element_at(F.lit(parts), at)).cast("int")).drop("range"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` candidates of greatest inner product for each query, other than the one with the
    query's own id: ``query_id, rank, vec_id, score``.

    ``vectors`` and ``queries`` come from :func:`packed`; queries need not be among the vectors."""
    hits_schema = "query_id long, vec_id long, score double"
    vectors = written(vectors.select("vec_id", "v"))
    rows = vectors.count()
    first = vectors.select(F.length("v").alias("n")).limit(1).collect()
    dim = first[0]["n"] // 8 if first else 1
    blocked = norm_blocks(vectors, rows)
    tops = {r["block"]: r["top"] for r in
            blocked.groupBy("block").agg(F.max("norm").alias("top")).collect()}
    kernel = block_kernel(rotation(vectors, dim), k)
    queries = queries.select(F.col("vec_id").alias("query_id"), "v").where(
        F.length("v") == 8 * dim)
    seeds = written(search_blocks(
        blocked.where(F.col("block") == 0),
        queries.withColumn("floor", F.lit(float("-inf"))).withColumn("blocks", F.array(F.lit(0))),
        kernel, hits_schema, 1))
    floors = seeds.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
    # blocks whose greatest length may still reach the query's floor
    later = F.array(*[F.struct(F.lit(int(b)).alias("block"), F.lit(float(t)).alias("top"))
                      for b, t in sorted(tops.items()) if b > 0])
    rest = seeds
    if any(b > 0 for b in tops):
        wanted = (queries.join(floors, "query_id", "left")
                  .withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
        wanted = run_arrow(
            wanted.select("query_id", "v", "floor"), _with_length,
            "query_id long, v binary, floor double, norm double")
        wanted = wanted.withColumn("blocks", F.transform(
            F.filter(later, lambda s: s["top"] * F.col("norm") * (1 + 1e-9) + 1e-9
                     >= F.col("floor")), lambda s: s["block"])).drop("norm")
        # queries that reach equally far down the lengths want the same blocks
        rest = seeds.unionByName(search_blocks(blocked.where(F.col("block") > 0), wanted,
                                               kernel, hits_schema, -1))
    return best_of(rest, k)


def _with_length(b: pa.RecordBatch) -> pa.RecordBatch:
    x = matrix(b.column("v").to_pylist())
    return pa.RecordBatch.from_arrays(
        [*b.columns, pa.array(np.sqrt((x * x).sum(axis=1)))], [*b.schema.names, "norm"])


def exact_top_k(df: DataFrame, k: int, is_query: Column, id_col: str = "vec_id",
                vec_col: str = "embedding", scale: float | None = None) -> DataFrame:
    """Top ``k`` within one table; queries are the rows for which ``is_query`` (over ``vec_id``)
    holds. ``scale`` turns each component x into floor(scale * x) first."""
    vectors = written(packed(df, id_col, vec_col, scale))
    return top_k(vectors, vectors.where(is_query), k)
