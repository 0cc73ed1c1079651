"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="pageweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pageweave/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a cached or locally checkpointed frame, the table outlives any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sorted_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``saved``, but in as many buckets of ``key`` as a shuffle has partitions, each sorted by it.

    Joins of such tables on the key need no shuffle. The catalog forgets the table at once; its files stay.
    """
    spark = df.sparkSession
    table, path = f"pageweave_{uuid.uuid4().hex}", new_path(spark, name)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table, format="parquet")
    out = spark.table(table)
    out.schema  # resolved while the catalog knows the buckets
    spark.sql(f"DROP TABLE {table}")
    return out


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` partitioned by ``key``, in a number of parts that grows with the input: 32 for each that it is read in.

    The number is told, as Spark would otherwise join parts by their size before their rows are exploded. The session is told that joins may
    rest on part of their keys: joins on ``key`` and further columns of two sides dealt alike then move no rows.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, 32 * df.rdd.getNumPartitions() if df.inputFiles() else least), key)


def small_arrow_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> None:
    """Bound the Arrow batches that Python workers get, by rows and by bytes, so that very long texts fit."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)
