"""Dense process rewards over ordered commit histories (W-04 .. W-06,
R-13 .. R-16).

The reference walks the list keeping two carried values; both depend
only on the last commit that parsed. That is a segmented scan: commits
are cut into ``(trajectory, pos div width)`` buckets, each bucket finds
its own previous valid commit with a window, and the carry-in from
earlier buckets comes from the small per-bucket table. No task ever holds
more than ``width`` commits of one trajectory, however long it is.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rewardlake.functions import rewards as rw
from rewardlake.operators import positions
from rewardlake.operators.joins import null_safe_join

# Step reward parts.
BAD_SYNTAX, VALID, DIFF, NEW_TESTS, FINAL = -0.1, 0.1, 0.2, 0.5, 1.0


def previous_valid(commits: DataFrame, keys, pos: str, valid: str, value: str,
                   width: int | None = None, name: str = "prev_code") -> DataFrame:
    """W-04: ``value`` of the last earlier row with ``valid`` true (null if
    none), plus ``is_final`` (W-06), by a scan over ranges sampled from the
    data, or with ``width`` over buckets of so many positions."""
    keys = list(keys)
    if width is None:
        laid = positions.laid_out(commits, [F.col(k).asc() for k in keys] + [F.col(pos).asc()])
        out = positions.scan(positions.by_part(laid), keys, pos,
                             previous={name: (F.col(value), F.col(valid))},
                             following={"_next": F.col(pos)})
        return out.withColumn("is_final", F.col("_next").isNull()).drop(
            "_next", "_part", "_place")
    b = commits.withColumn("_b", F.floor(F.col(pos) / width))
    per_bucket = b.groupBy(*keys, "_b").agg(
        F.max_by(F.col(value), F.when(F.col(valid), F.col(pos))).alias("_blast"),
        F.max(pos).alias("_bmax"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = (per_bucket
                  .withColumn("_carry", F.last("_blast", ignorenulls=True).over(earlier))
                  .withColumn("_kmax", F.max("_bmax").over(Window.partitionBy(*keys)))
                  .select(*keys, "_b", "_carry", "_kmax"))
    local = Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    out = null_safe_join(b, per_bucket, [*keys, "_b"])
    out = out.withColumn(name, F.coalesce(
        F.last(F.when(F.col(valid), F.col(value)), ignorenulls=True).over(local), F.col("_carry")))
    return out.withColumn("is_final", F.col(pos) == F.col("_kmax")).drop("_b", "_carry", "_kmax")


def step_rewards(commits: DataFrame, keys=("traj_id",), pos: str = "pos",
                 syntax_ok: str = "syntax_ok", width: int | None = None) -> DataFrame:
    """R-13 per commit. ``syntax_ok`` comes from the syntax job (X-06)."""
    valid = F.col(syntax_ok)
    out = (previous_valid(commits, keys, pos, syntax_ok, "code", width)                 # W-04, W-06
           .withColumn("tests", rw.pattern_tests("code"))                               # R-14
           .withColumn("prev_tests", F.when(F.col("prev_code").isNotNull(),
                                            rw.pattern_tests("prev_code"))
                       .otherwise(F.array().cast("array<string>")))
           .withColumn("new_tests", F.array_except("tests", "prev_tests"))             # W-05
           .withColumn("diff_ok", rw.diff_applies("code", "prev_code")))               # R-16
    reward = (F.lit(VALID)
              + F.when(F.col("diff_ok"), DIFF).otherwise(0.0)
              + F.when(F.size("new_tests") > 0, NEW_TESTS).otherwise(0.0)
              + F.when(F.col("is_final") & rw.all_required("tests"), FINAL).otherwise(0.0))  # R-15
    return out.withColumn("reward", F.when(valid, reward).otherwise(F.lit(BAD_SYNTAX)))
