"""Word 4-gram diversity per group (M-05, A-10).

distinct / total over all texts of a group, 1.0 when a group has no
n-gram. N-grams are counted per ``(group, ngram)`` first (partial
aggregation removes local repeats and spreads a hot group over many
keys); the sum and the number of those counts give both figures, so the
text is scanned and split once. A null group is a group.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardlake.functions.text import py_split
from rewardlake.operators.layout import spread


def _exploded(words: DataFrame, groups, n: int) -> DataFrame:
    """``*groups, gram``: the n-grams of ``_w`` as ``tokens.ngrams`` spells them, one null for fewer
    than n words. Each is joined from the words at its place, in generated code; an array of n-grams
    would be built element by element in interpreted code first."""
    first = F.slice("_w", 1, F.greatest(F.size("_w") - (n - 1), F.lit(0)))
    at = words.select(*groups, "_w", F.posexplode_outer(first).alias("_at", "_first"))
    gram = F.concat_ws(" ", *[F.get("_w", F.col("_at") + i) for i in range(n)])
    return at.select(*groups, F.when(F.col("_at").isNotNull(), gram).alias("gram"))


def ngram_diversity(texts: DataFrame, group: str = "grp", text: str = "text", n: int = 4
                    ) -> DataFrame:
    # n-grams are ~4x the text: an even spread first, whatever the input file layout
    words = spread(texts, force=True).select(group, py_split(text).alias("_w"))
    grams = _exploded(words, (group,), n)
    counts = grams.groupBy(group, "gram").agg(F.count("gram").alias("n"))
    out = counts.groupBy(group).agg(F.sum("n").alias("n_total"), F.count("gram").alias("n_distinct"))
    return out.withColumn("diversity", F.when(F.col("n_total") > 0,
                                              F.col("n_distinct") / F.col("n_total"))
                          .otherwise(F.lit(1.0)))


LG_K = 12
SKETCH_BOUND = 0.065


def ngram_sketch(texts: DataFrame, groups=("grp",), text: str = "text", n: int = 4,
                 lg_k: int = LG_K) -> DataFrame:
    """``*groups, n_total, sketch``: the n-grams of every group of texts."""
    words = spread(texts, force=True).select(*groups, py_split(text).alias("_w"))
    grams = _exploded(words, groups, n)
    return grams.groupBy(*groups).agg(
        F.count("gram").alias("n_total"),
        F.hll_sketch_agg("gram", lg_k).alias("sketch"))


def merged_sketches(sketches: DataFrame, groups=("grp",)) -> DataFrame:
    """Sketches of finer groups (steps, partial runs) united into those of ``groups``."""
    return sketches.groupBy(*groups).agg(F.sum("n_total").alias("n_total"),
                                         F.hll_union_agg("sketch").alias("sketch"))


def sketch_diversity(sketches: DataFrame) -> DataFrame:
    """``n_distinct`` (estimated) and ``diversity`` from a sketch; 1.0 without n-grams."""
    about = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("long")
    out = sketches.withColumn("n_distinct", F.least(about, F.col("n_total"))).drop("sketch")
    return out.withColumn("diversity", F.when(F.col("n_total") > 0, F.col("n_distinct")
                                              / F.col("n_total")).otherwise(F.lit(1.0)))
