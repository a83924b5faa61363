"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on (time zone, ANSI arithmetic) or that only pay off at scale
# (adaptive execution splits hot keys at joins and merges small shuffle partitions).
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins on (asset_id, date) may reuse the asset partitioning of the windows around them.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # HotSpot never compiles a method of more than 8,000 bytes: wide projections that stay below when split are not fused beyond it.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "marketloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = os.path.join(tempfile.gettempdir(), f"marketloom-{spark.sparkContext.applicationId}")
    os.makedirs(fallback, exist_ok=True)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "stage"):
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors do no harm."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A frame over files of more bytes than this is not stored for several passes: model frames are many times their input.
STORED_INPUT_BYTES = 2 << 30


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files ``df`` is made from, each table once; rows that were never in a file do not count."""
    leaves, sizes = df._jdf.queryExecution().optimizedPlan().collectLeaves(), {}
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            sizes[leaf.relation().location().rootPaths().mkString(",")] = int(leaf.relation().sizeInBytes())
    return sum(sizes.values())


def kept(df: DataFrame) -> DataFrame:
    """``df`` stored for several passes in memory and on disk; over large input (STORED_INPUT_BYTES) it is made anew for every pass instead."""
    return df if input_bytes(df) > STORED_INPUT_BYTES else df.persist(StorageLevel.MEMORY_AND_DISK)
