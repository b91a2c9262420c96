"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str | None = None, app: str = "tapeframe", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**_SETTINGS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` when the session names one.

    Only a local master, where driver and executors are one process, falls back to a folder of its
    own; on a cluster a missing setting is an error, since a machine-local folder would not survive
    the loss of an executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    own = os.environ.get("TAPEFRAME_LOCAL_DIR") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def inline_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A few literal rows as a local relation, typed by ``columns`` (``name type, ...``).

    Unlike ``createDataFrame`` this needs no job and has exact statistics.
    """
    def literal(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v!r}D"
        if isinstance(v, int):
            return f"{v}L"
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    names = [c.split()[0] for c in columns.split(", ")]
    casts = ", ".join("cast({0} as {1}) {0}".format(*c.split()) for c in columns.split(", "))
    values = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"select {casts} from values {values} as t({', '.join(names)})")


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tapeframe/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage.

    Parquet rather than an RDD checkpoint: later readers prune columns and see file statistics.
    """
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
