"""Passed sets as bitmaps (A-17 ids, U-02 .. U-06 counts, S-07 chunks).

Tasks are numbered once; a model's passed set on an axis is a bitmap of at most 4 KB for each
``CHUNK`` task numbers. Bitmaps merge by or, so partial runs are united without going back to
their rows, and the counts of the paired classes follow from the sizes of unions alone. No set is ever
one array: what leaves as arrays leaves chunk by chunk."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardlake.operators.joins import join_dim
from rewardlake.operators.positions import numbered

# Fixed value: task numbers in one bitmap.
CHUNK = 32_768


def task_numbers(results: DataFrame, keys=("axis", "task_id")) -> DataFrame:
    """``axis, task_id, task_no``: every task, numbered from 0 in order of its keys."""
    tasks = results.select(*keys).distinct()
    return numbered(tasks, [F.col(k).asc() for k in keys], "task_no")


def passed_sets(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """``label, axis, chunk, bits``: one bitmap of passed task numbers a model, axis and chunk."""
    passed = join_dim(results.filter(F.col("passed")).select("label", "axis", "task_id"), tasks,
                      ["axis", "task_id"])
    at = F.col("task_no") + 1                       # bitmaps count from 1
    return passed.groupBy("label", "axis", (F.bitmap_bucket_number(at) - 1).alias("chunk")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def union(*sets: DataFrame) -> DataFrame:
    """The passed sets of partial runs as one."""
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    return every.groupBy("label", "axis", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(sets: DataFrame) -> DataFrame:
    """``label, axis, n_passed``."""
    return sets.groupBy("label", "axis").agg(F.sum(F.bitmap_count("bits")).alias("n_passed"))


def class_counts(sets: DataFrame, a: str, b: str, base: str = "base") -> DataFrame:
    """U-02 .. U-06: the class counts on each axis by inclusion and exclusion, chunk by chunk."""
    def in_any(*labels: str) -> Column:
        return F.coalesce(F.bitmap_count(F.bitmap_or_agg(F.when(
            F.col("label").isin(*labels), F.col("bits")))), F.lit(0))

    every, a_b = in_any(a, b, base), in_any(a, b)
    a_base, b_base, just_base = in_any(a, base), in_any(b, base), in_any(base)
    per = sets.groupBy("axis", "chunk").agg(
        (every - b_base).alias("n_only_a"), (every - a_base).alias("n_only_b"),
        (a_base + b_base - just_base - every).alias("n_fixed_by_both"),
        (every - a_b).alias("n_broken_by_both"))
    return per.groupBy("axis").agg(*[F.sum(c).alias(c) for c in (
        "n_only_a", "n_only_b", "n_fixed_by_both", "n_broken_by_both")])


def members_of(sets: DataFrame, tasks: DataFrame) -> DataFrame:
    """``label, axis, chunk, task_no, task_id``: the sets as rows again."""
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.col("_byte") + 1, F.lit(1))), 16, 10).cast("int")
    bits = (sets.withColumn("_byte", F.explode(F.sequence(F.lit(0), F.length("bits") - 1)))
            .withColumn("_value", byte).where(F.col("_value") != 0)
            .withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(7))))
            .where(F.getbit("_value", "_bit") == 1))
    at = F.col("chunk") * CHUNK + F.col("_byte") * 8 + F.col("_bit")
    rows = bits.select("label", "axis", "chunk", at.alias("task_no"))
    return join_dim(rows, tasks.select("task_no", "task_id"), "task_no")


def chunks(sets: DataFrame, tasks: DataFrame) -> DataFrame:
    """``label, axis, chunk, passed``: sorted ids, at most ``CHUNK`` to a row."""
    rows = members_of(sets, tasks)
    return rows.groupBy("label", "axis", "chunk").agg(
        F.array_sort(F.collect_list("task_id")).alias("passed"))
