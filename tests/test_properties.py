"""Randomised properties."""
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from rewardlake.functions import tokens as tk
from rewardlake.operators import evaluation as ev
from rewardlake.operators import groups as gr
from rewardlake.operators.diversity import ngram_diversity

FEW = settings(max_examples=8, deadline=None)
rewards = st.lists(st.sampled_from([0.0, 1 / 3, 2 / 3, 1.0]), min_size=1, max_size=8)


@FEW
@given(st.lists(rewards, min_size=1, max_size=4))
def test_advantage_centred_and_scaled(spark, groups):
    rows = [("r", s, g, r) for s, grp in enumerate(groups) for g, r in enumerate(grp)]
    out = gr.advantage(spark.createDataFrame(rows, "run_id string, step long, g int, reward double")).collect()
    for s, grp in enumerate(groups):
        adv = [r.advantage for r in out if r.step == s]
        assert abs(sum(adv)) < 1e-6
        if len(grp) > 1 and len(set(grp)) > 1:
            n = len(adv)
            sd = math.sqrt(sum(a * a for a in adv) / (n - 1))
            assert abs(sd - 1) < 1e-6
        else:
            assert all(a == 0.0 for a in adv)


@FEW
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=6), st.lists(st.floats(-3, 3), min_size=1, max_size=6))
def test_kl_nonnegative_and_unit_ratio(spark, lp, ref):
    n = min(len(lp), len(ref))
    df = spark.createDataFrame([(lp[:n], ref[:n], 0.7)], "lp array<double>, ref array<double>, adv double")
    r = df.select(tk.k3_kl("lp", "ref").alias("kl"),
                  tk.surrogate(tk.seq_ratio("lp", "lp"), "adv", 0.2, 0.5).alias("s")).first()
    assert all(k >= -1e-12 for k in r.kl)
    assert abs(r.s + 0.7) < 1e-12          # ratio 1 => surrogate = -adv


@FEW
@given(st.lists(st.tuples(st.booleans(), st.booleans(), st.booleans()), min_size=1, max_size=12))
def test_paired_classes_disjoint(spark, outcomes):
    rows = [(m, "x", f"t{i}", p) for i, o in enumerate(outcomes) for m, p in zip(("base", "A", "B"), o)]
    df = spark.createDataFrame(rows, "label string, axis string, task_id string, passed boolean")
    pairs = ev.paired(df, "A", "B").collect()
    assert len(pairs) == len(outcomes)
    b = ev.breakdown(ev.paired(df, "A", "B")).first()
    assert sum(b) == sum(1 for p in pairs if p.cls is not None)


@FEW
@given(st.lists(st.text(alphabet="ab c\n", max_size=40), min_size=1, max_size=5))
def test_diversity_in_unit_interval(spark, texts):
    df = spark.createDataFrame([("g", t) for t in texts], "grp string, text string")
    r = ngram_diversity(df).first()
    assert 0 < r.diversity <= 1
    words = [t.split() for t in texts]
    grams = [tuple(w[i:i + 4]) for w in words for i in range(len(w) - 3)]
    want = len(set(grams)) / len(grams) if grams else 1.0
    assert abs(r.diversity - want) < 1e-12
