"""Wiring the streaming operators to a file source and a parquet sink.

Scored turns (or finished trajectories) land as parquet files in a
folder; the query reads them as a stream, runs the keyed operator and
appends results to a parquet folder. Progress and operator state live in
``<spark.checkpoint.dir>/streams/<name>`` unless a location is given, so a
restarted query resumes where it stopped.
"""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from rewardlake.session import ensure_checkpoint_dir
from rewardlake.streaming.episodes import (STATE_TIMEOUT_MS, WATERMARK, episode_stream,
                                           group_barrier, training_stream)

TURN_SCHEMA = ("run_id string, step long, g int, turn int, reward double, solved boolean, "
               "action string, feedback string, max_turns int, entry_point string, prompt string, "
               "ts timestamp")
FINISHED_SCHEMA = "run_id string, step long, g int, reward double, group_size int, ts timestamp"


# Typed state needs this store; a query takes the setting with it when it starts.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(spark, df, out_path, name, checkpoint, trigger):
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return _started(spark, df, out_path, name, checkpoint, trigger)
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def _started(spark, df, out_path, name, checkpoint, trigger):
    chk = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = (df.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", chk).outputMode("append"))
    w = w.queryName(name) if name else w
    w = w.trigger(availableNow=True) if trigger == "available_now" else w.trigger(processingTime=trigger)
    return w.start()


def start_episode_stream(spark: SparkSession, src: str, out_path: str, name: str = "episodes",
                         checkpoint: str | None = None, trigger: str = "available_now",
                         delay: str = WATERMARK, max_files: int = 100,
                         expire_ms: int = STATE_TIMEOUT_MS) -> StreamingQuery:
    """X-01 from a folder of scored-turn parquet files."""
    df = spark.readStream.schema(TURN_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(src)
    return _start(spark, episode_stream(df, delay=delay, expire_ms=expire_ms), out_path, name, checkpoint, trigger)


def start_group_barrier(spark: SparkSession, src: str, out_path: str, name: str = "groups",
                        checkpoint: str | None = None, trigger: str = "available_now",
                        delay: str = WATERMARK, max_files: int = 100,
                        expire_ms: int = STATE_TIMEOUT_MS) -> StreamingQuery:
    """X-02 from a folder of finished-trajectory parquet files."""
    df = spark.readStream.schema(FINISHED_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(src)
    return _start(spark, group_barrier(df, delay=delay, expire_ms=expire_ms), out_path, name, checkpoint, trigger)


def start_training_stream(spark: SparkSession, src: str, out_path: str, name: str = "training",
                          checkpoint: str | None = None, trigger: str = "available_now",
                          delay: str = WATERMARK, max_files: int = 100,
                          expire_ms: int = STATE_TIMEOUT_MS) -> StreamingQuery:
    """X-01 into X-02 from a folder of scored-turn parquet files that also hold ``reward_mode`` and
    ``group_size``."""
    schema = f"{TURN_SCHEMA}, reward_mode string, group_size int"
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(src)
    return _start(spark, training_stream(df, delay=delay, expire_ms=expire_ms), out_path, name, checkpoint, trigger)
