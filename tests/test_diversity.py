"""A-10: n-grams exploded by position are those of the array form."""
from pyspark.sql import functions as F

from rewardlake.functions.text import py_split
from rewardlake.functions.tokens import ngrams
from rewardlake.operators import diversity as dv


def test_exploded_ngrams_equal_the_array_form(spark):
    texts = ["a b c d e", " a  b\tc d ", "a b c", "", None, "x x x x x x x x", "　a b c d"]
    df = spark.createDataFrame([(i % 3 or None, t) for i, t in enumerate(texts)],
                               "grp int, text string")
    words = df.select("grp", py_split("text").alias("_w"))
    for n in (1, 2, 4):
        got = dv._exploded(words, ("grp",), n)
        want = words.select("grp", F.explode_outer(ngrams("_w", n)).alias("gram"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for out in (dv.ngram_diversity(df), dv.ngram_sketch(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" in plan and "array_join" not in plan
