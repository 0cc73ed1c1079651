"""Readers and writers of the corpus's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "struct<wi:int,text:string,x1:int,y1:int,x2:int,y2:int>"
ANNOTATION = f"doc_id bigint, is_handwritten boolean, paragraphs array<struct<pi:int,lines:array<struct<li:int,words:array<{WORD}>>>>>, _corrupt string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages (``page_id, url, html``); rows that hold no HTML go."""
    return spark.read.parquet(path).select("page_id", "url", "html").filter(F.col("html").rlike(r"(?i)<\s*(?:!doctype|html|body|a|p|div)\b"))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, length`` of .png, .jpg and .jpeg files by name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.withColumn("name", name).filter(F.lower("path").rlike(r"\.(png|jpe?g)$")).orderBy("name")


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """``path, hash`` of every file."""
    return spark.read.format("binaryFile").load(folder).select("path", F.md5("content").alias("hash"))


def write_annotations(nested: DataFrame, path: str) -> None:
    """One JSON object per document; compressed, as it repeats its keys at every word."""
    nested.write.option("compression", "gzip").json(path)


def mask_paths(nodes: DataFrame) -> DataFrame:
    """``mask_path`` of each node of ``hierarchy.unnest_tree``: ``masks/word_2_0_5_mask.png`` by its places."""
    kinds = {"page": "page_region", "paragraph": "para", "line": "line", "word": "word", "character": "char"}
    name = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in kinds.items()])
    return nodes.withColumn("mask_path", F.concat(F.lit("masks/"), F.concat_ws("_", name, "pi", "li", "wi", "ci", F.lit("mask.png"))))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Nested annotations; a missing ``is_handwritten`` is false, files that do not parse are left out."""
    rows = spark.read.schema(ANNOTATION).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = rows.filter("doc_id is not null and paragraphs is not null")
    return good.withColumn("is_handwritten", F.coalesce("is_handwritten", F.lit(False))).drop("_corrupt")


def write_requests(requests: DataFrame, path: str) -> None:
    """One JSON object per line: ``custom_id`` and the request's body."""
    requests.select(F.to_json(F.struct("custom_id", "body")).alias("value")).write.text(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """``custom_id, body`` of each line; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", "custom_id string, body string").alias("r")).select("r.*")


def export_metadata(registry: DataFrame, path: str, order: str = "ts") -> None:
    registry.orderBy(order).write.json(path)


def export_scores(collected: DataFrame, path: str, order: str = "index") -> None:
    """Collected documents with what their score rests on: ``details`` holds ``paragraph_count, line_count`` and the threshold."""
    details = F.struct("paragraph_count", "line_count", "threshold").alias("details")
    collected.orderBy(order).select("filename", "source_url", "paragraph_count", "line_count", "is_document", details).write.json(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` in the order of each file; a log is read whole by one task."""
    files = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
