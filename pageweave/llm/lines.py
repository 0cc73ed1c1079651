"""Line deduplication with levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageweave.functions.scratch import saved, sorted_by

MIN_POINTS = 20
MIN_DOCS = 3
#: Least number of documents of a line that is joined apart.
HOT_DOCS = 100
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space (ASCII) at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _UPPER.lower())


def _identified(docs: DataFrame) -> DataFrame:
    """``did`` (a null id is one document below all others), ``version`` of the text."""
    return docs.withColumns(
        {"__did": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")), "__version": F.xxhash64("text")}
    )


def keyed_lines(docs: DataFrame, batches: int) -> DataFrame:
    """``did, version, at, key, batch`` of the lines whose key is long enough; ``key`` is a 128-bit hash."""
    rows = _identified(docs.select("doc_id", "text")).select(
        "__did", "__version", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")
    )
    rows = rows.withColumn("norm", line_key(F.col("line"))).filter(F.length("norm") >= MIN_POINTS)
    return rows.select(
        F.col("__did").alias("did"),
        F.col("__version").alias("version"),
        "at",
        F.unhex(F.md5(F.col("norm").cast("binary"))).alias("key"),
        F.pmod(F.xxhash64("__did"), F.lit(batches)).cast("int").alias("batch"),
    )


class LineRuns:
    """Sorted runs ``key, n_docs, last`` by level; two runs of a level are merged into one of the next.

    A key stands in one run only: that of the batch which brought it. What later batches add to it stands in the
    batches' increments. Runs and batches are tables bucketed and sorted by key, so that the merge joins between them
    move no rows between tasks (Spark sorts each bucket anew, in its task, when it reads several runs). Documents of different batches must differ; every table is written once, so a lost executor loses
    nothing.
    """

    def __init__(self):
        self.levels: list[list[DataFrame]] = [[]]
        self.increments: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """No key is in both, so a full merge join lets the rows of both through in order."""
        x, y = a.select(F.struct("n_docs", "last").alias("x"), "key"), b.select(F.struct("n_docs", "last").alias("y"), "key")
        both = F.coalesce("x", "y")
        return x.join(y.hint("merge"), "key", "full").select("key", both["n_docs"].alias("n_docs"), both["last"].alias("last"))

    def add(self, lines: DataFrame) -> None:
        """A batch of ``(did, key)``: keys that no run knows, by merge anti-join, are a new run; the rest are increments."""
        counted = lines.groupBy("key").agg(F.count_distinct("did").alias("n_docs"), F.max("did").alias("last"))
        runs = self.runs()
        fresh = batch = sorted_by(counted, "key", "batch")
        for run in runs:
            fresh = fresh.join(run.select("key").hint("merge"), "key", "left_anti")
        if runs:
            fresh = sorted_by(fresh, "key", "run")
            self.increments.append(batch.join(fresh.select("key").hint("merge"), "key", "left_anti"))
        self.levels[0].append(fresh)
        k = 0
        while len(self.levels[k]) == 2:
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(sorted_by(self._merged(*self.levels[k]), "key", "run"))
            self.levels[k] = []
            k += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """``key, n_docs, last`` of the keys found in ``min_docs`` documents or more."""
        more = None
        for x in self.increments:
            more = x if more is None else more.unionByName(x)
        parts = []
        for run in self.runs():
            if more is not None:
                added = more.groupBy("key").agg(F.sum("n_docs").alias("n"), F.max("last").alias("l"))
                run = run.join(added.hint("merge"), "key", "left").select(
                    "key", (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("last", "l").alias("last")
                )
            parts.append(run.filter(F.col("n_docs") >= min_docs))
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out


def _dropped(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """``lines`` whose key is frequent, but for those of the last document.

    Keys of very many lines, at most eight a task, are joined from every task's memory and meet in no one place.
    """
    spark = lines.sparkSession
    share = lines.count() // (8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(frequent.filter(F.col("n_docs") > max(share, HOT_DOCS)).select("key", "last"))
    rest = lines.join(hot.select("key"), "key", "left_anti").join(frequent.select("key", "last"), "key")
    return lines.join(hot, "key").unionByName(rest).filter("did <> last")


def drop_frequent_lines(docs: DataFrame, batches: int = 4, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs``, ``text`` without the dropped lines, and ``n_lines, n_dropped``.

    A line goes if its key has at least 20 code points, stands in at least ``min_docs`` documents, and this is not the
    largest ``doc_id`` that holds it. Null and empty texts are one empty line; a text all of whose lines go is empty.
    Rows of the same ``doc_id`` are one document; a null ``doc_id`` is one document below all others; repeated rows
    lose the same lines. Columns named like the new ones are replaced.
    """
    base = docs.drop("n_lines", "n_dropped").withColumn("text", F.coalesce("text", F.lit("")))
    lines = saved(keyed_lines(base, batches), "lines")
    runs = LineRuns()
    for k in range(batches):
        runs.add(lines.filter(F.col("batch") == k))
    frequent = saved(runs.frequent(min_docs), "frequent")
    drops = (
        _dropped(lines, frequent)
        .groupBy(F.col("did").alias("__d"), F.col("version").alias("__v"))
        .agg(F.sort_array(F.collect_set("at")).alias("__drops"))
    )
    joined = _identified(base).join(drops, (F.col("__did") == F.col("__d")) & (F.col("__version") == F.col("__v")), "left")
    parts = F.split("text", "\n", -1)
    cut = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__drops", i)), "\n")
    return joined.select(
        *[F.when(F.col("__drops").isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else c for c in base.columns],
        F.size(parts).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
