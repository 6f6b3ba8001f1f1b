"""Operator 11 against plain water-filling and a plain pivotal walk, and by invariants."""
import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from llm_data import frame, odd_docs, prose
from rewardlake.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes: dict, weights=(5, 2, 1), factor=1.5, most=2):
    """Shares by weight, the excess over each cap dealt out again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [
        s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = factor * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= most * sizes[s]}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in order}
        full |= over
        if len(full) == len(order):
            return {s: most * sizes[s] for s in order}


def check(rows, got):
    """Everything the result must keep, for (id, text, source) rows."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    of_source = collections.Counter()
    for (_, _, s), n in zip(rows, size):
        of_source[s] += n
    target = plain_targets(of_source)
    want = collections.Counter((d, n, of_source[s], round(target[s], 6))
                               for (d, _, s), n in zip(rows, size))
    assert collections.Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6))
                               for r in got) == want
    taken = collections.Counter()
    for r in got:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source_size, round(r.target, 6)] += r.taken
    same = collections.Counter((of_source[s], round(target[s], 6)) for s in of_source)
    return {k: (taken[k], same[k] * k[1]) for k in same}


def test_odd_rows(spark):
    rows = [(d, t, s) for d, t, _, s, _ in odd_docs()]
    df = frame(spark, odd_docs(), extra=True)
    got = mixing.mix(df).collect()
    check(rows, got)
    again = mixing.mix(df.repartition(5, "text")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(frame(spark, [])).count() == 0
    none = mixing.mix(frame(spark, [(1, None, None, None, None), (None, "", None, "a", 0)]))
    assert [(r.taken, r.target) for r in none.collect()] == [(0, 0.0)] * 2


def test_sources_come_near_their_targets(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        s = "hot" if i % 3 == 0 else rng.choice(["a", "b", "Z", "é", "", None])
        rows.append((i, prose(i, min(500, int(rng.paretovariate(1.3) * 20))), s))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, per_bucket=16).collect()
    for words, target in check(rows, got).values():
        assert abs(words - target) <= 30
    other = mixing.mix(df.repartition(13), per_bucket=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, other))
    assert sorted(map(str, got)) != sorted(map(str, mixing.mix(df, per_bucket=16, seed=12).collect()))


def test_hot_group_of_equal_rows(spark):
    rows = [(1, "one two three", "a")] * 25_001 + [(2, "four five", "a")] * 3 + [
        (i, prose(i, 40), "b") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for words, target in check(rows, got).values():
        assert abs(words - target) <= 40
    spread = collections.Counter(r.copies for r in got if r.doc_id == 1)
    assert len(spread) <= 2


def plain_walk(items):
    """(size, p, u) in order -> who goes up, and the fraction left."""
    done, rest = {}, None
    for at, (s, p, u) in enumerate(items):
        if rest is None:
            rest = [at, s, p]
            continue
        i, si, pi = rest
        gain_i, gain_x = min((1 - pi) * si, p * s), min(pi * si, (1 - p) * s)
        if u * (gain_i + gain_x) < gain_x:
            pi, p = pi + gain_i / si, p - gain_i / s
        else:
            pi, p = pi - gain_x / si, p + gain_x / s
        if min(pi, 1 - pi) <= min(p, 1 - p):
            done[i], rest = round(pi), [at, s, p]
        else:
            done[at], rest = round(p), [i, si, pi]
    return done, rest


def test_pivot_equals_plain_walk_and_keeps_expectations(spark):
    rng = random.Random(8)
    sizes = [rng.randint(1, 500) for _ in range(12)]
    ps = [rng.choice([0.1, 0.37, 0.5, 0.9]) for _ in sizes]
    runs = [[(s, p, rng.random()) for s, p in zip(sizes, ps)] for _ in range(4000)]
    df = spark.createDataFrame(
        [(k, [(s, 0, i, 1, 0, p, u) for i, (s, p, u) in enumerate(run)])
         for k, run in enumerate(runs)],
        "k long, items array<struct<size:bigint,text_hash:bigint,doc_id:bigint,n:bigint,"
        "whole:bigint,p:double,u:double>>")
    out = df.select("k", mixing._pivot(F.col("items"), "bigint").alias("r")).collect()
    mass, ups = sum(s * p for s, p in zip(sizes, ps)), collections.Counter()
    for row in out:
        done, rest = plain_walk(runs[row.k])
        assert {d.doc_id: int(d.up) for d in row.r.done} == done
        assert row.r.rest.doc_id == rest[0] and abs(row.r.rest.p - rest[2]) < 1e-6
        kept = sum(d["size"] * d.up for d in row.r.done) + row.r.rest.p * row.r.rest["size"]
        assert abs(kept - mass) < 1e-6
        for d in row.r.done:
            ups[d.doc_id] += d.up
        ups[row.r.rest.doc_id] += row.r.rest.p
    for i, p in enumerate(ps):
        assert abs(ups[i] / len(runs) - p) < 0.04


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_plain_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:03}": rng.choice([0, 1, 10, 1000, rng.randint(1, 10 ** 6)]) for i in range(40)}
    sizes[None] = 77
    df = spark.createDataFrame(
        [(s or "", s is None, n, i, float((5, 2, 1)[i % 3]))
         for i, (s, n) in enumerate(sizes.items())],
        "source string, no_source boolean, source_size long, source_no long, weight double")
    got = {None if r.no_source else r.source: r.target for r in mixing.with_targets(df).collect()}
    want = plain_targets(sizes)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_query_and_native_plan(spark):
    df = queries.op11_pivotal_mixing(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", "source").collect()
    check([tuple(r) for r in docs], df.collect())
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
