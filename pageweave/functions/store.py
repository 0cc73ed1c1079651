"""Small facts that several writers agree on: put-if-absent in the shared store, and versioned snapshots over it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> str:
    """What stands at ``path``: ``text`` if nothing stood there, else what another writer put there first.

    The text is written aside and then linked or renamed into place, which fails if the place is taken: one step on a local
    or mounted disk, on HDFS and on stores with the same promise for renames (not on plain object stores).
    """
    p, fs = _path(spark, path)
    aside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(aside.toUri().getPath(), p.toUri().getPath())
        else:
            hadoop = spark._jvm.org.apache.hadoop.fs
            kinds = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
            kinds[0] = getattr(hadoop, "Options$Rename").NONE
            hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, p, kinds)
        return text
    except (FileExistsError, Py4JJavaError) as e:
        found = read_text(spark, path)
        if found is None:
            raise e
        return found
    finally:
        fs.delete(aside, False)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or file that nobody reads any more."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


class Conflict(RuntimeError):
    """Another writer made the next version first; read it and try again."""


class Versions:
    """Snapshots of a table under ``path``, each whole and unchanged once there; readers see one version or the next.

    A version is a Parquet table under a name of its own; its number points to it by ``put_if_absent``, so of two writers that
    start from one version the second gets ``Conflict``. ``note`` is a short text kept with a version.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def latest(self) -> int:
        """The newest version's number, 0 if there is none."""
        p, fs = _path(self.spark, f"{self.path}/versions")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _entry(self, version: int) -> list[str]:
        return (read_text(self.spark, f"{self.path}/versions/{version:09d}") or "").split("\n", 1)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._entry(version)[0]}")

    def note(self, version: int | None = None) -> str:
        return (self._entry(self.latest() if version is None else version) + [""])[1]

    def commit(self, rows: DataFrame, base: int, note: str = "") -> int:
        """Make ``rows`` the version after ``base``."""
        name = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        if put_if_absent(self.spark, f"{self.path}/versions/{base + 1:09d}", f"{name}\n{note}") != f"{name}\n{note}":
            remove(self.spark, f"{self.path}/{name}")
            raise Conflict(f"version {base + 1} of {self.path} is another writer's")
        return base + 1

    def update(self, step: Callable[[DataFrame], DataFrame], tries: int = 8) -> int:
        """Make ``step`` of the newest version the next one, anew from the newest as often as another writer came first."""
        for _ in range(tries):
            base = self.latest()
            try:
                return self.commit(step(self.read(base)), base)
            except Conflict:
                continue
        raise Conflict(f"{tries} tries to change {self.path} came too late")
