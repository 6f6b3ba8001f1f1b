"""Operator 8: balance, slots, groups and odd inputs."""
import random
import zlib
from collections import Counter, defaultdict

from llm_data import frame, odd_docs, prose
from rewardlake.llm import queries, sharding


def check(got, rows, shards):
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
                   for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    return size


def test_sizes_are_near_equal_and_groups_stay(spark):
    rng = random.Random(1)
    rows = [(i, prose(i, rng.randint(1, 60)), "en", "s", 0) for i in range(1500)]
    rows += [(5000 + i, rows[i % 40][1], "en", "s", 0) for i in range(100)]
    got = sharding.shard_documents(frame(spark, rows, extra=True), 4).collect()
    size = check(got, rows, 4)
    mean = sum(size.values()) / 4
    assert len(size) == 4 and max(abs(v - mean) for v in size.values()) < 0.03 * mean
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_heavy_group_is_cut(spark):
    rows = [(i, "same text over and over", "en", "s", 0) for i in range(600)]
    rows += [(1000 + i, prose(i, 10), "en", "s", 0) for i in range(600)]
    size = check(sharding.shard_documents(frame(spark, rows), 6).collect(), rows, 6)
    mean = sum(size.values()) / 6
    assert max(abs(v - mean) for v in size.values()) < 0.03 * mean


def test_odd_documents_and_few_rows(spark):
    check(sharding.shard_documents(frame(spark, extra=True), 4).collect(), odd_docs(), 4)
    check(sharding.shard_documents(frame(spark, odd_docs()[:2]), 24).collect(), odd_docs()[:2], 24)
    assert sharding.shard_documents(frame(spark, [])).count() == 0
    one = [(1, None, None, None, None)] * 5
    check(sharding.shard_documents(frame(spark, one), 3).collect(), one, 3)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet")
            .select("doc_id", "text").collect()]
    got = queries.op8_kd_tree_sharding(spark, sf).collect()
    size = check(got, rows, 24)
    assert len(size) == 24 and max(size.values()) < 1.1 * min(size.values()) + max(
        len(t.encode()) for _, t in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_written_shards(spark, tmp_path):
    rows = [(i, prose(i, 20), "en", "s", 0) for i in range(60)]
    docs = frame(spark, rows)
    sharding.write_shards(docs, sharding.shard_documents(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and back.select("shard").distinct().count() == 4
