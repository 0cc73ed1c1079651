"""Detection over a model that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageweave.functions.scratch import saved
from pageweave.functions.store import exists


def score_wave(regions: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int = 32) -> DataFrame:
    """``predict`` on batches of open regions; what it loads, it loads once per worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                yield predict(f.iloc[k : k + batch])

    return regions.mapInPandas(run, schema)


def run_cascade(
    pages: DataFrame,
    predict: Callable[[int], Callable[[pd.DataFrame], pd.DataFrame]],
    levels: int,
    schema: str,
    store: str | None = None,
    shared: int = 1,
) -> list[DataFrame]:
    """The waves' tables, one wave per level over all parents of all documents; each is written before the next begins.

    The first ``shared`` levels read the pages, each later one the wave before it. With ``store``, a folder of the shared
    store, waves are written there, and those that a run before has finished are read instead of computed again; one that it
    left unfinished is written anew.
    """
    spark = pages.sparkSession
    out: list[DataFrame] = []
    for level in range(levels):
        source = pages if level < shared else out[-1]
        if store is None:
            out.append(saved(score_wave(source, predict(level), schema), f"wave{level}"))
            continue
        path = f"{store.rstrip('/')}/wave{level}"
        if not exists(spark, f"{path}/_SUCCESS"):
            score_wave(source, predict(level), schema).write.mode("overwrite").parquet(path)
        out.append(spark.read.schema(schema).parquet(path))
    return out


def take_until_invalid(steps: DataFrame, parent: list[str], order: str, bad: str, most: int) -> DataFrame:
    """The steps before the first bad one, at most ``most``."""
    w = Window.partitionBy(*parent).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.withColumn("__b", F.max(F.expr(bad).cast("int")).over(w)).withColumn("__n", F.count("*").over(w))
    return rows.filter((F.col("__b") == 0) & (F.col("__n") <= most)).drop("__b", "__n")


def close_contours(steps: DataFrame, parent: list[str], order: str, near: float = 15.0) -> DataFrame:
    """``contours`` per parent: closed when at least three points end within ``near`` of the first.

    A NONE step (class 0) closes what is open, if it has three points, and ends; what is open at the end is dropped.
    """

    place = F.row_number().over(Window.partitionBy(*parent).orderBy(order))
    rows = steps.select(*parent, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "class_id", place.alias("__at"))
    kinds = ", ".join(f"{c} {k}" for c, k in steps.dtypes if c in parent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parents one after another, their steps in order; of a parent, only the open contour is held."""
        open_, ended, ordinal = [], False, 0
        for batch in batches:
            at, where = [], []
            for k, (n, x, y, kind) in enumerate(zip(*(batch[c].to_pylist() for c in ("__at", "x", "y", "class_id")), strict=True)):
                if n == 1:
                    open_, ended, ordinal = [], False, 0
                if ended:
                    continue
                ended = kind == 0
                if len(open_) >= 3 and (ended or ((x - open_[0]["x"]) ** 2 + (y - open_[0]["y"]) ** 2) ** 0.5 < near):
                    at.append(k)
                    where.append((ordinal, open_))
                    open_, ordinal = [], ordinal + 1
                elif not ended:
                    open_.append({"x": x, "y": y})
            keys = [batch[c].take(pa.array(at, pa.int64())) for c in parent]
            point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            cells = [pa.array([o for o, _ in where], pa.int32()), pa.array([c for _, c in where], point)]
            yield pa.RecordBatch.from_arrays([*keys, *cells], [*parent, "ordinal", "contour"])

    return rows.mapInArrow(run, f"{kinds}, ordinal int, contour array<struct<x:double,y:double>>")


def pair_by_ordinal(regions: DataFrame, classes: DataFrame, key: str, order: str) -> DataFrame:
    """Regions and classes of a key zipped in order; the shorter list ends it."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return regions.withColumn("n", n).join(classes.withColumn("n", n).drop(order), [key, "n"])


def score_document(counts: DataFrame, threshold: int, deep: bool = False) -> DataFrame:
    """``is_document`` where there are enough paragraphs; ``line_count`` of a deep look, else 0."""
    counts = counts.withColumn("line_count", F.col("lines") if deep else F.lit(0))
    return counts.withColumn("is_document", F.col("paragraphs") >= threshold)
