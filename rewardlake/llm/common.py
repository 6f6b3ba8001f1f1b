"""Helpers shared by the operators of this folder."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardlake.operators.layout import spread
from rewardlake.session import cut_lineage, ship_package
from rewardlake.sources.tables import read_table

__all__ = ["F", "DataFrame", "SparkSession", "pa", "np", "spread", "written", "load",
           "run_arrow", "text_of", "n_groups", "least_hashed"]


# Spark's default of rows in an Arrow batch, and what whole texts allow for in bounded memory.
ARROW_DEFAULT, ARROW_ROWS = 10_000, 1_000


def prepared(spark: SparkSession) -> None:
    """Ships the package and, where the session has Spark's default, lowers the rows of an Arrow
    batch: texts may be long, and a Python worker holds a batch several times over."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == ARROW_DEFAULT:
        spark.conf.set(key, str(ARROW_ROWS))


def load(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Pruned reader; tables with too few partitions are dealt over the cores."""
    prepared(spark)
    return spread(read_table(spark, sf_dir, name, *cols))


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: the work behind it
    runs once, and a lost executor costs only the tasks it held."""
    prepared(df.sparkSession)
    return cut_lineage(df)


def text_of(col: str = "text"):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def n_groups(rows: int, per_group: int) -> int:
    """How many groups of about ``per_group`` rows hold ``rows`` rows."""
    return max(1, -(-int(rows) // int(per_group)))


def least_hashed(df: DataFrame, h: Column, n: int, total: int) -> DataFrame:
    """Those of the ``total`` rows of ``df`` whose hash ``h`` is under a bound: all of the ``n``
    smallest and about as many more, so that ordering and collecting stay small on any number of
    partitions."""
    share = 2.0 * n / max(1, total)
    while share < 1:
        few = df.where(h < F.lit(int(share * 2 ** 64) - 2 ** 63))
        if few.count() >= n:
            return few
        share *= 4
    return df


def run_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None],
              schema: str) -> DataFrame:
    """``rows`` over each Arrow batch, one output batch per input batch."""
    prepared(df.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                out = rows(b)
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(batches, schema)
