"""Operator 2 against brute force over all pairs."""
import re

import numpy as np
import pytest
import xxhash

from llm_data import frame, odd_docs, prose
from rewardlake.llm import simhash
from rewardlake.llm.components import components


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_groups(fps, radius=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(fp, rng, bits):
    for b in rng.choice(64, bits, replace=False):
        fp ^= 1 << int(b)
    return fp


def planted(seed, n=150):
    rng = np.random.default_rng(seed)
    out = []
    for b in rng.integers(0, 2 ** 63, n).tolist():
        out.append(b)
        while rng.random() < 0.6:                    # chains
            out.append(near(out[-1], rng, int(rng.integers(1, 6))))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("text", ["", None, " \t\n", "a", "A b C", "a b c d", "a b c d e",
                                  "É x\x0by z w q É", "w\x1cx y", prose(1, 500), "x" * 9999])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == slow_fingerprint(text)


@pytest.mark.parametrize("seed", range(3))
def test_links_join_all_pairs_within_the_radius(spark, seed, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 40)    # hot shards are dealt into parts
    fps = planted(seed)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    want = brute_groups(fps)
    groups = {}
    for i, f in enumerate(signed):
        groups.setdefault(roots.get(f, f), set()).add(i)
    exp = {}
    for i, g in enumerate(want):
        exp.setdefault(g, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, exp.values()))


def test_dense_ball_of_one_hot_shard(spark, monkeypatch):
    """Thousands of fingerprints that share most stripes: parts of one shard find every link."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 64)
    rng = np.random.default_rng(4)
    fps = list({int(x) << 40 for x in rng.integers(0, 2 ** 12, 700)})
    df = spark.createDataFrame([(f if f < 2 ** 63 else f - 2 ** 64,) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    assert len(set(brute_groups(fps))) == len(fps) - len(roots)


@pytest.mark.parametrize("n", [10, 10 ** 6, 10 ** 10])
def test_stripe_keys_cover_the_radius(n):
    masks = simhash.stripe_keys(n, 4)
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = int(rng.integers(0, 2 ** 63))
        y = near(x, rng, 4)
        assert any(x & m == y & m for m in masks)


def test_components_of_long_chain(spark):
    rows = [(i, i + 1) for i in range(200)] + [(500, 500), (600, 601)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "u long, v long"))
           .collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 601: 600}


def test_near_duplicates_of_odd_documents(spark):
    rows = odd_docs()
    got = simhash.near_duplicates(frame(spark, extra=True)).collect()
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    group = brute_groups(fps)
    least = {}
    for (d, *_), g in zip(rows, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = sorted(((d, f"{f:016x}", least.get(g)) for (d, *_), f, g in zip(rows, fps, group)),
                  key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_one_of_each_keeps_one_row_and_all_columns(spark):
    rows = odd_docs()
    docs = frame(spark, extra=True)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    group = brute_groups([slow_fingerprint(t) for _, t, *_ in rows])
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    want = {}
    for (d, *_), g in zip(rows, group):
        want.setdefault(g, []).append(d)
    best = [min((x for x in v if x is not None), default=None) for v in want.values()]
    assert ids == sorted(best, key=str)
    assert simhash.one_of_each(frame(spark, [])).count() == 0
