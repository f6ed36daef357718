"""Session settings the operators are written for."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "parley", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    ``fallback`` is used only where the setting is absent, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set and no fallback folder was given")
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one. Without the setting, a local session (one machine, as in tests) gets
    a temporary folder of its own; on a cluster that is an error."""
    local = spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.split("[")[0] == "local"
    return f"{shared_folder(spark, tempfile.mkdtemp() if local else None).rstrip('/')}/{name}-{uuid.uuid4().hex}"
