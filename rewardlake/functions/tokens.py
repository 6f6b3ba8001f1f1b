"""Token, log-prob and schedule math (M-01 .. M-17) on array columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cut_at_eos(ids, eos) -> Column:
    """M-01 ids: keep up to and including the first EOS."""
    pos = F.array_position(_c(ids), eos)
    return F.when(pos > 0, F.slice(_c(ids), 1, pos.cast("int"))).otherwise(_c(ids))


def truncated_no_eos(ids, eos, budget: int) -> Column:
    """M-01 flag: no EOS and at least ``budget`` ids."""
    return (F.array_position(_c(ids), eos) == 0) & (F.size(_c(ids)) >= budget)


def truncated_len(ids, budget: int) -> Column:
    """M-02: length reaches the budget."""
    return F.size(_c(ids)) >= budget


def truncated_exact(ids, budget: int) -> Column:
    """M-02 (v1 form): length equals the budget."""
    return F.size(_c(ids)) == budget


def truncated_reason(finish_reason) -> Column:
    """M-02 (engine form): the engine stopped on length."""
    return _c(finish_reason) == "length"


def cap_prompt(ids, n: int) -> Column:
    """M-03."""
    return F.slice(_c(ids), 1, n)


def is_repetitive(ids, m) -> Column:
    """M-04: at least 2m ids and the last m equal the m before them."""
    x = _c(ids)
    m = F.lit(m) if isinstance(m, int) else _c(m)
    ok = F.size(x) >= m * 2
    return F.when(ok, F.slice(x, -m, m) == F.slice(x, -(m * 2), m)).otherwise(F.lit(False))


def ngrams(words, n: int) -> Column:
    """M-05: word n-grams as space-joined strings (words hold no
    whitespace, so the join is one-to-one); none when fewer than n words."""
    w = _c(words)
    idx = F.sequence(F.lit(1), F.size(w) - (n - 1))
    grams = F.transform(idx, lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))


def mean_logprob(lp) -> Column:
    """M-06: mean; an empty completion counts as the single value -10."""
    x = _c(lp)
    s = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(x) == 0, F.lit(-10.0)).otherwise(s / F.size(x))


def seq_ratio(lp, old_lp) -> Column:
    """M-07: exp(mean(lp) - mean(old))."""
    return F.exp(mean_logprob(lp) - mean_logprob(old_lp))


def token_ratio(lp, old_lp) -> Column:
    """M-08: exp(lp - old) per token."""
    return F.zip_with(_c(lp), _c(old_lp), lambda a, b: F.exp(a - b))


def clip(ratio, eps_low, eps_high) -> Column:
    """M-09: clamp to [1 - eps_low, 1 + eps_high]; NaN stays NaN (H-3)."""
    r = _c(ratio)
    lo = 1 - (F.lit(eps_low) if isinstance(eps_low, float) else _c(eps_low))
    hi = 1 + (F.lit(eps_high) if isinstance(eps_high, float) else _c(eps_high))
    return F.when(F.isnan(r), r).otherwise(F.least(F.greatest(r, lo), hi))


def nan_min(a: Column, b: Column) -> Column:
    """min that propagates NaN like the tensor library (H-3)."""
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b))


def surrogate(ratio, adv, eps_low, eps_high) -> Column:
    """M-10: -min(ratio * adv, clip(ratio) * adv)."""
    r, a = _c(ratio), _c(adv)
    return -nan_min(r * a, clip(r, eps_low, eps_high) * a)


def naive_token_loss(lp, delta) -> Column:
    """M-11: -lp * delta per token."""
    d = _c(delta)
    return F.transform(_c(lp), lambda x: -x * d)


def token_surrogate(ratios, delta, eps: float | None) -> Column:
    """M-08 / M-10 per token: unclipped ``-r * d`` or clipped pessimistic form."""
    d = _c(delta)
    if eps is None:
        return F.transform(_c(ratios), lambda r: -r * d)
    return F.transform(_c(ratios), lambda r: -nan_min(r * d, clip(r, eps, eps) * d))


def k3_kl(lp, ref_lp) -> Column:
    """M-12: exp(ref - lp) - (ref - lp) - 1 per token."""
    return F.zip_with(_c(ref_lp), _c(lp), lambda r, l: F.exp(r - l) - (r - l) - 1)


def array_mean(x) -> Column:
    """Mean of an array; 0 for an empty one (an empty completion has KL 0)."""
    a = _c(x)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(
        F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a))


def array_sum(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v)


def entropy(lp) -> Column:
    """M-13: sampled entropy -mean(lp)."""
    return -mean_logprob(lp)


def log_softmax_at(logits, idx) -> Column:
    """M-14: log-softmax of a logits array, taken at 0-based ``idx``."""
    x = _c(logits)
    mx = F.array_max(x)
    lse = mx + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - mx)))
    return F.get(x, _c(idx)) - lse


def temperature(step, variant_fixes, t_fixed, t1, t2, switch) -> Column:
    """M-15: two-stage schedule for the variant, fixed otherwise."""
    staged = F.when(_c(step) >= _c(switch), _c(t2)).otherwise(_c(t1))
    return F.when(_c(variant_fixes), staged).otherwise(_c(t_fixed))


def snapshot_epoch(epoch, period: int) -> Column:
    """M-16: epoch of the frozen reference snapshot."""
    return _c(epoch) - F.pmod(_c(epoch), F.lit(period))


def total_loss(pg_loss, kl, kl_coeff) -> Column:
    """M-17."""
    return _c(pg_loss) + _c(kl_coeff) * _c(kl)
