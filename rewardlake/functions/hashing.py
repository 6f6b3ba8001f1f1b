"""Deterministic draws (H-5): a uniform number in [0, 1) from a key.

``u = first 32 bits of md5(key) / 2^32``; the same number comes out of
DuckDB with ``('0x' || substr(md5(key), 1, 8))::BIGINT / 2^32``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    key = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string")
                             for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
