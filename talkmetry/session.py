"""Session factory and the settings the operators read from the session."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"
HOT_ROWS_KEY = "spark.talkmetry.hotRows"
DEFAULT_HOT_ROWS = 2_000_000


def build_session(app: str = "talkmetry", master: str | None = None, **conf) -> SparkSession:
    """A UTC session with AQE and the state store that custom streaming state needs."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(STATE_STORE_KEY, ROCKSDB_PROVIDER)
        # Call-site capture costs as much as analysing these plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def last_key_wins(spark: SparkSession) -> Iterator[None]:
    """JSON parsed into variants by expressions made inside keeps the last of repeated keys instead of failing."""
    before = spark.conf.get(DUPLICATE_KEYS, None)
    spark.conf.set(DUPLICATE_KEYS, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DUPLICATE_KEYS)
        else:
            spark.conf.set(DUPLICATE_KEYS, before)


def hot_rows(spark: SparkSession) -> int:
    """Rows above which one key is cut into blocks instead of staying in one task."""
    return int(spark.conf.get(HOT_ROWS_KEY, str(DEFAULT_HOT_ROWS)))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory under the folder every executor can reach.

    ``spark.checkpoint.dir`` names it on a cluster. Where nothing names it (tests,
    a laptop) the session's warehouse folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_talkmetry"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For results several later steps read: the work behind them is done once, and a lost
    executor costs a re-read instead of a recomputation.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
