"""Join helpers: a broadcast only behind a checked size, null-safe keys."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension side that the optimizer sizes above this is joined by shuffle.
BROADCAST_MAX_BYTES = 32 << 20


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's upper estimate of ``df``'s size; no job runs. A plan without
    statistics (joins, Python stages) counts as very large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only if its planned size is within ``max_bytes``.

    Beyond the bound the plain DataFrame is returned: adaptive execution still turns the
    join into a broadcast where the measured size allows, and else splits skewed keys."""
    return F.broadcast(df) if planned_bytes(df) <= max_bytes else df


def join_dim(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
             max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    return fact.join(bounded_broadcast(dim, max_bytes), on, how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys come from ``left``."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
