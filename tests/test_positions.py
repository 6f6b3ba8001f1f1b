"""Global row numbers by range partitioning and prefix sums."""
import random

from pyspark.sql import functions as F

from rewardlake.operators import positions


def test_numbers_follow_the_order(spark):
    rng = random.Random(3)
    keys = rng.sample(range(10 ** 15), 3000)                    # sparse ids
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "k long, t string").repartition(7)
    got = positions.numbered(df, [F.col("k").asc()], partitions=11).collect()
    want = {k: i for i, k in enumerate(sorted(keys))}
    assert {r.k: r.row_idx for r in got} == want
    got = positions.numbered(df, [F.col("t").desc()], "at", partitions=5).collect()
    assert [r.t for r in sorted(got, key=lambda r: r.at)] == sorted(
        (f"t{k}" for k in keys), reverse=True)


def test_equal_and_null_keys(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.lit(None).cast("long"))
                                  .when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id"))
                                  .alias("k"), "id")
    got = positions.numbered(df, [F.col("k").asc_nulls_last()], partitions=9,
                             tie=F.monotonically_increasing_id()).collect()
    got.sort(key=lambda r: r.row_idx)
    assert [r.row_idx for r in got] == list(range(2000))
    ks = [r.k for r in got]
    assert ks == sorted(ks, key=lambda k: (k is None, k or 0))
    assert positions.numbered(df.limit(0), [F.col("k").asc()]).count() == 0


def test_prefix_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(positions, "FAN", 4)
    rng = random.Random(1)
    counts = [rng.randint(0, 9) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(counts)), "p int, n long")
    got = {r.p: r.s for r in positions.prefix_sums(df, "p", "n", "s").collect()}
    assert got == {i: sum(counts[:i]) for i in range(50)}


def test_partitions_follow_the_size(spark, tmp_path):
    df = spark.range(10)
    assert positions.range_partitions(df) == 1
    big = spark.range(10 ** 9)                                  # 8 GB planned
    assert positions.range_partitions(big) >= 50


def test_scans_equal_windows_over_the_whole_key(spark):
    """Keys inside one range, over several ranges, a hot one, null keys; values null at times."""
    from pyspark.sql import Window
    rng = random.Random(2)
    rows, pos = [], 0
    for key in ["a", "b", None, "hot", "z"]:
        for _ in range({"hot": 900, "b": 3}.get(key, 60)):
            pos += rng.randint(1, 10 ** 9)
            rows.append((key, pos, rng.choice([None, f"v{pos}"]), rng.random() < .2))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, pos long, v string, ok boolean")
    laid = positions.laid_out(df, [F.col("k").asc(), F.col("pos").asc()], partitions=12)
    assert laid.groupBy("_part").count().agg(F.max("count")).first()[0] < 300
    got = positions.scan(positions.by_part(laid), ["k"], "pos", {"n": F.col("ok")},
                         {"p": (F.col("v"), F.col("ok"))}, {"f": F.col("v")})
    w = Window.partitionBy("k").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({
        "n": F.count(F.when(F.col("ok"), 1)).over(before),
        "p": F.last(F.when(F.col("ok"), F.struct("v")), ignorenulls=True).over(before)["v"],
        "f": F.lead("v").over(w)})
    cols = ["k", "pos", "v", "ok", "n", "p", "f"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    assert positions.scan(positions.laid_out(df.limit(0), [F.col("pos").asc()]), ["k"], "pos",
                          {"n": F.col("ok")}).count() == 0
