"""Incremental ingest of a folder."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pageweave.functions.store import Versions, put_if_absent, remove

STATUS = "filename string, status string, batch bigint, writer string"
TOTALS = "filename string, n bigint"
_FILE = "path string, modificationTime timestamp, length bigint, content binary"
#: Files taken for images, by their names.
IMAGES = "*.{png,PNG,jpg,JPG,jpeg,JPEG}"


def _name(folder: str) -> Column:
    """A file's path below the folder."""
    below = folder.split(":", 1)[-1].strip("/")
    return F.element_at(F.split(F.col("_metadata.file_path"), f"/{below}/", 2), -1)


def watch_dir(spark: SparkSession, folder: str, schema: str, files_a_round: int = 100, pattern: str = "*.parquet") -> DataFrame:
    """Rows of new Parquet files, at most so many files a round, with their ``filename`` (the path below the folder)."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_round)
    return reader.parquet(folder).withColumn("filename", _name(folder))


def watch_files(spark: SparkSession, folder: str, files_a_round: int = 100, pattern: str = IMAGES) -> DataFrame:
    """New files as they are, ``filename, content``, images unless ``pattern`` says otherwise; also in folders below."""
    reader = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    rows = reader.option("maxFilesPerTrigger", files_a_round).load(folder)
    return rows.select(_name(folder).alias("filename"), "content")


def processed(spark: SparkSession, path: str) -> DataFrame:
    """``filename, status, batch, writer`` of every file handled so far."""
    try:
        return spark.read.schema(STATUS).parquet(path).select("filename", "status", "batch", "writer")
    except AnalysisException:
        return spark.createDataFrame([], STATUS)


def claim_names(spark: SparkSession, path: str, names: list[str], owner: str) -> set[str]:
    """Those of a round's names that are the owner's: claimed now, or by it before. Of any writers only one gets a name."""
    mine = set()
    for n in names:
        own = json.dumps({"filename": n, "owner": owner})
        place = f"{path.rstrip('/')}/{hashlib.sha256(n.encode()).hexdigest()}.json"
        if put_if_absent(spark, place, own) == own:
            mine.add(n)
    return mine


def claims(spark: SparkSession, path: str) -> DataFrame:
    """``filename, owner`` of every claim."""
    try:
        return spark.read.schema("filename string, owner string").option("pathGlobFilter", "*.json").json(path)
    except AnalysisException:
        return spark.createDataFrame([], "filename string, owner string")


def claim_first(images: DataFrame, done: DataFrame, path: str, n: int, owner: str) -> DataFrame:
    """The first ``n`` names of ``images(filename)`` that are neither in ``done`` nor claimed, claimed for ``owner``.

    They are put among the claims at once, so writers who choose at the same time get different names. Reads as
    ``filename, status`` (``batch_pending``) for a tracker.
    """
    spark = images.sparkSession
    got: set[str] = set()
    while len(got) < n:
        open_ = images.join(done.select("filename").union(claims(spark, path).select("filename")), "filename", "left_anti")
        names = [r["filename"] for r in open_.select("filename").distinct().orderBy("filename").limit(n - len(got)).collect()]
        if not names:
            break
        got |= claim_names(spark, path, names, owner)
    return spark.createDataFrame([(name, "batch_pending") for name in sorted(got)], "filename string, status string")


def each_file(one: Callable[[str, bytes], pd.DataFrame], schema: str) -> Callable[[DataFrame, int], DataFrame]:
    """A handler that gives ``one`` each file by itself: what it raises is the file's ``error`` and spoils no other file.

    For streams of ``watch_files``; ``one(filename, content)`` returns rows of ``schema``. The next file begins with the
    next row, so a task holds one file and its rows.
    """
    names = StructType.fromDDL(schema).fieldNames()
    out = f"filename string, error string, {schema}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["filename"], f["content"], strict=True):
                try:
                    rows = one(name, bytes(content))[names]
                    yield rows.assign(filename=name, error=None)[["filename", "error", *names]]
                except Exception as e:
                    yield pd.DataFrame([[name, f"{type(e).__name__}: {e}", *[None] * len(names)]], columns=["filename", "error", *names])

    return lambda rows, _: rows.mapInPandas(run, out)


class RoundsDone(RuntimeError):
    """The rounds asked for are done."""


def ingest_once(
    stream: DataFrame,
    status_path: str,
    checkpoint: str,
    handle: Callable[[DataFrame, int], DataFrame],
    out_path: str,
    claims_path: str | None = None,
    writer: str | None = None,
    max_batches: int | None = None,
    poll_seconds: float | None = None,
) -> StreamingQuery:
    """Each file once, over restarts, new checkpoints and several writers.

    Files that have a status are left out of a batch. With ``claims_path`` a batch's files (as many as a round takes) are
    claimed first, and only those that this ``writer`` got are handled; a writer is known by its name (its checkpoint, if none
    is given) and on a restart finds its claims again, while those of one that never returns stay its own. ``handle`` maps a
    batch's rows to result rows with ``filename`` and, if it likes, ``error``: such a file gives ``error: ...`` and no
    result. Other files get ``annotated``, or ``empty`` where there is no result row. Output and status are
    written under writer and number of the batch, so a batch that is run again overwrites itself.

    The query ends when nothing is left, or looks again every ``poll_seconds``. After ``max_batches`` rounds the next one is
    refused before it begins and stays for the next start: await such a query by ``drain``.
    """
    own = "w" + hashlib.sha256((writer or checkpoint).encode()).hexdigest()[:16]
    rounds = 0

    def run(batch: DataFrame, number: int) -> None:
        nonlocal rounds
        if max_batches is not None and rounds >= max_batches:
            raise RoundsDone(f"{rounds} rounds")
        spark = batch.sparkSession
        done = processed(spark, status_path).filter((F.col("batch") != number) | (F.col("writer") != own))
        fresh = batch.join(done.select("filename").distinct(), "filename", "left_anti")
        if claims_path:
            names = [r["filename"] for r in fresh.select("filename").distinct().collect()]  # at most a round's files
            fresh = fresh.filter(F.col("filename").isin(list(claim_names(spark, claims_path, sorted(names), own))))
        fresh = fresh.persist()
        result = handle(fresh, number)
        where = f"writer={own}/batch={number}"
        if "error" not in result.columns:
            result = result.withColumn("error", F.lit(None).cast("string"))
        aside = f"{out_path}/__handled/{where}"  # hidden from readers; handled once, whatever is asked of it
        result.withColumnRenamed("error", "__error").write.mode("overwrite").parquet(aside)
        raw = spark.read.parquet(aside)
        had = raw.groupBy("filename").agg(F.first("__error", ignorenulls=True).alias("error"), F.lit(True).alias("ok"))
        good = had.filter("error is null").select("filename")
        raw.filter("__error is null").drop("__error").join(good, "filename", "left_semi").write.mode("overwrite").parquet(f"{out_path}/{where}")
        status = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).when(F.col("ok"), "annotated").otherwise("empty")
        files = fresh.select("filename").distinct().join(had, "filename", "left")
        files.select("filename", status.alias("status")).write.mode("overwrite").parquet(f"{status_path}/{where}")
        fresh.unpersist()
        remove(spark, aside)
        rounds += 1

    writing = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    due = {"processingTime": f"{poll_seconds} seconds"} if poll_seconds else {"availableNow": True}
    return writing.trigger(**due).start()


def drain(query: StreamingQuery, seconds: float | None = None) -> bool:
    """Wait for a query's end; true if it was drained, false if it stopped at its number of rounds (or ``seconds`` passed)."""
    try:
        return bool(query.awaitTermination(seconds) if seconds else query.awaitTermination() is None)
    except StreamingQueryException as e:
        if "RoundsDone" in str(e):
            return False
        raise


def running_totals(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows per file so far; a round writes the totals of its own files only (update mode). ``totals`` reads the newest."""
    counts = stream.groupBy("filename").agg(F.count("*").alias("n"))

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rounds/batch={number}")

    writing = counts.writeStream.outputMode("update").foreachBatch(run)
    return writing.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _totals(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """Totals, the newest round in them and the number of the snapshot that they start from."""
    store = Versions(spark, f"{path}/snapshots", TOTALS)
    base = store.latest()
    upto = int(store.note(base) or -1) if base else -1
    old = store.read(base).withColumn("batch", F.lit(-1).cast("bigint"))
    try:
        rounds = spark.read.schema(f"{TOTALS}, batch bigint").parquet(f"{path}/rounds").filter(F.col("batch") > upto)
    except AnalysisException:
        rounds = old.limit(0)
    last = rounds.agg(F.max("batch").alias("b")).first()["b"]
    rows = old.unionByName(rounds).groupBy("filename").agg(F.max_by("n", "batch").alias("n"))
    return rows, upto if last is None else last, base


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``filename, n`` after the last round of ``running_totals``."""
    return _totals(spark, path)[0]


def compact_totals(spark: SparkSession, path: str) -> int:
    """Merge the rounds so far into the next snapshot, from which ``totals`` then starts; its number."""
    rows, last, base = _totals(spark, path)
    return Versions(spark, f"{path}/snapshots", TOTALS).commit(rows, base, str(last))
