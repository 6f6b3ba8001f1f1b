"""Session helpers.

``get_session`` is for tests, the bench and local runs. On a cluster the
caller owns the session; library code only reads settings from it.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "rewardlake") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read here.
    Only when it is unset and the master is local (tests) is a scratch folder
    made: on a cluster, executors and driver would not see each other's.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        cur = tempfile.mkdtemp(prefix="rewardlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    spark.sparkContext.setCheckpointDir(cur)
    return cur


def cut_lineage(df):
    """Materialise ``df`` once as a parquet table in the shared checkpoint
    folder and read it back.

    Unlike ``DataFrame.checkpoint`` (which computes the plan once for the
    action and again to write the checkpoint), the plan runs exactly once,
    so side-effecting work (test execution, H-7) is never repeated; the
    written table survives executor loss. Never a local checkpoint."""
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rewardlake`` importable in executor Python workers.

    Pandas UDFs and ``mapInPandas`` functions are pickled by module
    reference, so executors must import this package. It is zipped once
    per application on the driver and distributed with ``addPyFile``."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="rewardlake-pkg-"), "rewardlake.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


# Settings for a large cluster (~1000 executors, ~100 TB input). Applied by
# ``apply_cluster_defaults`` only where the session does not set them.
CLUSTER_DEFAULTS = {
    # 128 MB splits keep a scan task's decoded batch well inside executor memory.
    "spark.sql.files.maxPartitionBytes": str(128 << 20),
    # Start wide; AQE coalesces to ~256 MB per reducer and splits skewed ones.
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    # Broadcasts are decided by checked row bounds in the library; keep the
    # automatic size-based one modest.
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def apply_cluster_defaults(spark: SparkSession) -> dict:
    """Set each ``CLUSTER_DEFAULTS`` entry the session leaves unset (runtime
    SQL settings only); returns what was applied."""
    applied = {}
    for k, v in CLUSTER_DEFAULTS.items():
        if k.startswith("spark.sql.streaming.stateStore"):
            continue   # static: must be given when the session is built
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
            applied[k] = v
    return applied
