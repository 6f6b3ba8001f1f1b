"""Operators 1 and 4 against brute force."""
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardlake.llm import ann, queries, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, norm double, block int"


def odd_vectors(spark, n=400, dim=12, seed=1, hot=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.exponential(1, size=(n, 1))
    x[:hot] = x[0]
    rows = [(i, [float(v) for v in r], None, 1) for i, r in enumerate(x)]
    rows += [(1001, None, 1.0, 2), (1002, [None] * dim, 1.0, 2), (1003, [float("nan")] * dim, 1.0, 2),
             (1004, [float("inf")] * dim, 1.0, 2), (1005, [1.0], 1.0, 2), (1006, [], 1.0, 2),
             (None, [1.0] * dim, 1.0, 2), rows[min(7, n - 1)], rows[0], (1100, [0.0] * dim, 1.0, 2)]
    return spark.createDataFrame(rows, SCHEMA)


def usable(df, dim):
    out = {}
    for r in df.collect():
        v = r.embedding
        if r.vec_id is not None and v is not None and len(v) == dim and None not in v \
                and np.isfinite(v).all():
            out[r.vec_id] = np.array(v, float)
    return out


def brute(vecs, ids, k, measure):
    out = set()
    for q in ids:
        s = sorted(((-measure(vecs[q], v), c) for c, v in vecs.items() if c != q))[:k]
        out |= {(q, i + 1, c, -m) for i, (m, c) in enumerate(s)}
    return out


@pytest.mark.parametrize("hot", [0, 150])
def test_top_k_is_exact(spark, hot, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 64)
    monkeypatch.setattr(topk, "SLICE", 16)
    df = odd_vectors(spark, hot=hot)
    got = {tuple(r) for r in topk.exact_top_k(df, 5, F.pmod("vec_id", F.lit(20)) == 0,
                                              scale=1024.0).collect()}
    v = {i: np.floor(1024 * x) for i, x in usable(df, 12).items()}
    assert got == brute(v, [i for i in v if i % 20 == 0], 5, lambda a, b: float((a * b).sum()))


def test_top_k_few_and_none(spark):
    df = odd_vectors(spark, n=3)
    got = topk.exact_top_k(df.where("vec_id < 3"), 10, F.lit(True), scale=1024.0).collect()
    assert len(got) == 6 and {r["rank"] for r in got} == {1, 2}
    assert topk.exact_top_k(df.limit(0), 10, F.lit(True)).count() == 0
    assert topk.exact_top_k(df, 10, F.lit(False)).count() == 0


def test_negative_scores_reach_later_blocks(spark, monkeypatch):
    """Long vectors that point away must not hide short ones that score higher."""
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 4)
    rows = [(i, [-10.0 - i, 0.0], None, 0) for i in range(1, 9)]
    rows += [(0, [1.0, 0.0], None, 0), (50, [0.5, 0.0], None, 0), (51, [0.1, 0.0], None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.vec_id for r in topk.exact_top_k(df, 3, F.col("vec_id") == 0, scale=1024.0)
           .orderBy("rank").collect()]
    assert got == [50, 51, 1]


def test_top_k_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = {tuple(r) for r in con.sql(queries.ORACLE["op1_exact_topk"]).fetchall()}
    assert {tuple(r) for r in queries.op1_exact_topk(spark, sf).collect()} == want


@pytest.mark.parametrize("hot", [0, 150])
def test_tree_search_recall_and_scores(spark, hot, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES_PER_BLOCK", 64)
    monkeypatch.setattr(ann, "LEAF_SAMPLE", 16)
    df = odd_vectors(spark, hot=hot)
    v = {i: x for i, x in usable(df, 12).items() if x.any()}
    ids = [i for i in v if i % 20 == 0]
    got = ann.neighbours(df, 5, F.pmod("vec_id", F.lit(20)) == 0).collect()
    want = brute(v, ids, 5, lambda a, b: float((a * b).sum()))
    score = {}
    for r in got:
        assert abs(r.score - float((v[r.query_id] * v[r.vec_id]).sum())) < 1e-12
        score.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    for rows in score.values():
        assert [(s, i) for _, s, i in sorted(rows)] == sorted((s, i) for _, s, i in rows)
    hits = {(r.query_id, r.vec_id) for r in got} & {(q, c) for q, _, c, _ in want}
    assert len(hits) >= 0.9 * len(want) and set(score) == set(ids)


def test_tree_few_and_none(spark):
    df = odd_vectors(spark, n=4).where("vec_id < 4")
    assert ann.neighbours(df, 20, F.lit(True)).count() == 12
    assert ann.neighbours(df.limit(0), 20, F.lit(True)).count() == 0


def test_recall_on_the_test_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {}
    for r in queries.op4_kmeans_tree_ann(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    v = usable(spark.read.parquet(f"{sf}/embeddings.parquet"), 64)
    want = {}
    for q, _, c, _ in brute(v, [i for i in v if i % 20 == 0], 20,
                            lambda a, b: float((a * b).sum())):
        want.setdefault(q, set()).add(c)
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 20 * len(want)


def test_repeated_ids_count_once(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], None, 0)] * 5 + [(2, [2.0, 1.0], None, 0)], SCHEMA)
    assert vectors.packed(df).count() == 2


def test_candidate_blocks_go_to_the_query_blocks_that_want_them(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", 10)
    cands = spark.range(60).select(F.col("id").alias("vec_id"), F.lit(b"x").alias("v"),
                                   F.floor(F.col("id") / 10).cast("int").alias("block"))
    # a query wants the block of its own tens and the next one
    tens = F.floor(F.col("id") / 20).cast("int")
    qs = spark.range(100).select(F.col("id").alias("query_id"), F.array(tens, tens + 1).alias("blocks"))
    sent = []

    def kernel(c, q):
        import pandas as pd
        return pd.DataFrame({"query_id": [len(q)], "vec_id": [len(c)], "score": [0.0]})

    got = vectors.search_blocks(cands, qs, kernel, "query_id long, vec_id long, score double", 1)
    sent = got.collect()
    # every wanted pair once: five homes of twenty queries, two blocks of ten candidates each
    assert sum(r.query_id for r in sent) == 200
    assert all(r.vec_id == 10 and r.query_id <= 20 for r in sent)
    assert len(sent) <= 2 * 5 * 3           # not 6 blocks x 10 query blocks
