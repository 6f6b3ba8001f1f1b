"""Operator 4: approximate nearest neighbours by a hierarchical k-means tree, best bin first.

The tree is fitted on at most ``SAMPLE`` vectors (the smallest by hash of the id; a bound, not a
share) by k-means at every node until a node has at most ``LEAF_SAMPLE`` of them. Every vector is
then indexed: it goes to the leaf reached by following the nearest centroid. A query walks the tree
with a priority queue of bins ordered by the inner product with their centroid. How many leaves are
visited is calibrated: for ``CALIBRATION`` queries the true neighbours are found by the exact
operator over all rows, and the number of leaves grows until their mean recall reaches the target.

Nearness is the inner product on the original vectors in double precision, ties to the smaller id.
Zero vectors and those :func:`rewardlake.llm.vectors.packed` leaves out take no part. An empty
table gives an empty result; with fewer candidates than asked for, all that the visited leaves hold
are returned, and a query that finds fewer than k visits all leaves.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from rewardlake.llm.common import F, least_hashed, n_groups, run_arrow, written
from rewardlake.llm.topk import top_k
from rewardlake.llm.vectors import (CANDIDATES_PER_BLOCK, best_of, matrix, packed, search_blocks)

SAMPLE = 20_000
BRANCHES = 8
LEAF_SAMPLE = 128
CALIBRATION = 256
TARGET_RECALL = 0.95


class Tree:
    """Flat arrays: centroid of each node, its children (empty for leaves) and leaf numbers."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE):
        self.centers, self.children = [sample.mean(axis=0)], [[]]
        work = [(0, np.arange(len(sample)))]
        rng = np.random.default_rng(42)
        while work:
            node, rows = work.pop()
            x = sample[rows]
            if len(rows) <= leaf or (x == x[0]).all():
                continue
            side = _kmeans(x, branches, rng)
            parts = [rows[side == c] for c in range(side.max() + 1)]
            parts = [p for p in parts if len(p)]
            if len(parts) < 2:
                continue
            for p in parts:
                self.children[node].append(len(self.centers))
                work.append((len(self.centers), p))
                self.centers.append(sample[p].mean(axis=0))
                self.children.append([])
        self.centers = np.array(self.centers)
        leaves = [n for n, c in enumerate(self.children) if not c]
        self.leaf_of = {n: i for i, n in enumerate(leaves)}
        self.n_leaves = len(leaves)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row: nearest centroid at every level."""
        leaf, work = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            kids = self.children[node]
            if not kids:
                leaf[rows] = self.leaf_of[node]
                continue
            pick = _nearest(x[rows], self.centers[kids])
            for i, kid in enumerate(kids):
                if (got := rows[pick == i]).size:
                    work.append((kid, got))
        return leaf

    def walk(self, near: np.ndarray, visits: int) -> list[int]:
        """Leaves in best-bin-first order; ``near`` is the query's nearness to every centroid."""
        queue, order = [(-near[0], 0)], []
        while queue and len(order) < visits:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                order.append(self.leaf_of[node])
            for kid in kids:
                heapq.heappush(queue, (-near[kid], kid))
        return order


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(axis=1) - 2 * (x @ centers.T), axis=1)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        side = _nearest(x, centers)
        centers = np.array([x[side == c].mean(axis=0) if (side == c).any() else centers[c]
                            for c in range(len(centers))])
    return _nearest(x, centers)


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Tree | None:
    """The tree of a bounded sample; None for an empty table."""
    h = F.xxhash64("vec_id")
    few = least_hashed(vectors, h, sample, vectors.count())
    rows = few.orderBy(h, "vec_id").limit(sample).select("v").collect()
    return Tree(matrix(r["v"] for r in rows)) if rows else None


def index(vectors: DataFrame, tree: Tree) -> DataFrame:
    """``vec_id, v, leaf`` of every vector; written."""
    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(tree.assign(matrix(b.column("v").to_pylist())))],
            [*b.schema.names, "leaf"])

    return written(run_arrow(vectors.select("vec_id", "v"), rows,
                             "vec_id long, v binary, leaf long"))


def visited(queries: DataFrame, tree: Tree, visits: int) -> DataFrame:
    """``query_id, v, leaves``: the first ``visits`` leaves on each query's way."""
    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        near = matrix(b.column("v").to_pylist()) @ tree.centers.T
        return pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([tree.walk(n, visits) for n in near], pa.list_(pa.int64()))],
            [*b.schema.names, "leaves"])

    return run_arrow(queries.select("query_id", "v"), rows,
                     "query_id long, v binary, leaves array<long>")


def calibrate(indexed: DataFrame, queries: DataFrame, tree: Tree, k: int,
              target: float = TARGET_RECALL, n: int = CALIBRATION) -> tuple[int, float]:
    """Fewest leaf visits whose mean recall on ``n`` queries reaches ``target``, and that recall."""
    probe = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(n)
    probe = written(probe)
    truth = top_k(indexed, probe.withColumnRenamed("query_id", "vec_id"), k)
    where = truth.join(indexed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf")
    order = visited(probe, tree, tree.n_leaves).select("query_id", "leaves")
    at = [r["at"] for r in where.join(order, "query_id")
          .select(F.array_position("leaves", F.col("leaf")).alias("at")).collect()]  # n * k rows
    if not at:
        return tree.n_leaves, 1.0
    at = np.sort(np.array(at))
    visits = int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)])
    return visits, float((at <= visits).mean())


def neighbours(df: DataFrame, k: int, is_query: Column, id_col: str = "vec_id",
               vec_col: str = "embedding", target: float = TARGET_RECALL) -> DataFrame:
    """The ``k`` nearest found for each query: ``query_id, rank, vec_id, score``."""
    schema = "query_id long, vec_id long, score double"
    vectors = packed(df, id_col, vec_col)
    vectors = written(run_arrow(vectors, _non_zero, "vec_id long, v binary"))
    tree = fit(vectors)
    if tree is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, "
                                                   "score double")
    indexed = index(vectors, tree)
    queries = indexed.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    visits, _ = calibrate(indexed, queries, tree, k, target)
    # leaves next to each other share a block until it is full; a large leaf has several
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    first, parts, block, fill = {}, {}, 0, 0
    for leaf in range(tree.n_leaves):
        size = sizes.get(leaf, 0)
        if fill and fill + size > CANDIDATES_PER_BLOCK:
            block, fill = block + 1, 0
        first[leaf], parts[leaf] = block, n_groups(size, CANDIDATES_PER_BLOCK)
        if parts[leaf] > 1:
            block, fill = block + parts[leaf], 0
        else:
            fill += size
    starts = F.array(*[F.lit(first[i]) for i in range(tree.n_leaves)])
    spans = F.array(*[F.lit(parts[i]) for i in range(tree.n_leaves)])
    leaf = (F.col("leaf") + 1).cast("int")
    cands = indexed.withColumn("block", F.element_at(starts, leaf) + F.pmod(
        F.xxhash64("vec_id"), F.element_at(spans, leaf)).cast("int"))

    def wanted(q: DataFrame) -> DataFrame:
        each = lambda i: F.sequence(F.element_at(starts, (i + 1).cast("int")),          # noqa: E731
                                    F.element_at(starts, (i + 1).cast("int"))
                                    + F.element_at(spans, (i + 1).cast("int")) - 1)
        return q.withColumn("blocks", F.array_distinct(F.flatten(F.transform("leaves", each))))

    # queries with the same nearest leaf want much the same blocks
    found = search_blocks(cands, wanted(visited(queries, tree, visits)), _leaf_kernel(k), schema, 1)
    found = written(best_of(found, k))
    short = found.groupBy("query_id").count().where(F.col("count") >= k)
    again = queries.join(short, "query_id", "left_anti")
    if visits >= tree.n_leaves or not again.take(1):
        return found
    more = search_blocks(cands, wanted(visited(again, tree, tree.n_leaves)), _leaf_kernel(k),
                         schema, 1)
    return found.join(short, "query_id", "left_semi").unionByName(best_of(more, k))


def _non_zero(b: pa.RecordBatch) -> pa.RecordBatch:
    keep = matrix(b.column("v").to_pylist()).any(axis=1)
    return b.select(["vec_id", "v"]).filter(pa.array(keep))


def _leaf_kernel(k: int):
    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(["leaf", "vec_id"])
        ids, leaf, x = c["vec_id"].to_numpy(), c["leaf"].to_numpy(), matrix(c["v"])
        q_ids, y = q["query_id"].to_numpy(), matrix(q["v"])
        leaves, starts = np.unique(leaf, return_index=True)
        ends = np.append(starts[1:], len(leaf))
        place = {int(f): i for i, f in enumerate(leaves)}
        out_q, out_v, out_s = [], [], []
        for j in range(len(q_ids)):
            mine = sorted(place[f] for f in q["leaves"].iloc[j] if f in place)
            if not mine:
                continue
            at = np.concatenate([np.arange(starts[i], ends[i]) for i in mine])
            at = at[ids[at] != q_ids[j]]
            near = x[at] @ y[j]
            if len(at) > k:       # rounding of the fast product must not decide about equals
                kth = np.partition(near, len(near) - k)[len(near) - k]
                at = at[near >= kth - 1e-9 * (1 + abs(kth))]
            exact = (x[at] * y[j]).sum(axis=1)
            top = np.lexsort((ids[at], -exact))[:k]
            out_q.append(np.full(len(top), q_ids[j]))
            out_v.append(ids[at][top])
            out_s.append(exact[top])
        if not out_q:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64),
                                 "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v),
                             "score": np.concatenate(out_s)})
    return run
