"""Tables and SQL fragments that several registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageweave.functions.scratch import dealt
from pageweave.operators import layout, training


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, batch: int = 0) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dealt(training.batched(texts, "doc_id", batch), "batch") if batch else dealt(texts, "doc_id")


def words(spark: SparkSession, sf_dir: str, batch: int = 0) -> DataFrame:
    """Every document's words. Texts are dealt by document before they are laid out, so that what is grouped or joined by document and
    further keys below moves no word between tasks. With ``batch``, column and key are the batch of so many ids instead."""
    return layout.layout_words(_texts(spark, sf_dir, batch))


def spans(spark: SparkSession, sf_dir: str, keys: list[str], batch: int = 0) -> DataFrame:
    """The boxes that the words sharing ``keys`` (of document, paragraph, line) span; no word is made for them."""
    return layout.rollup_boxes(layout.layout_lines(_texts(spark, sf_dir, batch)), keys)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line boxes with a dense id per document: ``id = 5 * pi + li``."""
    rows = spans(spark, sf_dir, ["doc_id", "pi", "li"])
    return rows.withColumn("id", (5 * F.col("pi") + F.col("li")).cast("bigint"))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


#: Words with boxes, as ``layout.layout_words`` makes them.
WORDS = f"""
wr AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN [''] ELSE regexp_extract_all(x, '{layout.PIECES}') END)) AS w FROM documents),
ln AS (SELECT doc_id, unnest(w) AS line, unnest(range(len(w))) AS n FROM wr),
pc AS (SELECT doc_id, n, string_split(line, ' ') AS p FROM ln),
wk AS (SELECT doc_id, n, p, unnest(range(len(p))) AS k FROM pc),
words AS (SELECT doc_id, (n // 5)::INT AS pi, (n % 5)::INT AS li, len(list_filter(p[1:k], lambda x: x <> ''))::INT AS wi, p[k + 1] AS text,
  (40 + 12 * (length(array_to_string(p[1:k], ' ')) + (k > 0)::INT))::INT AS x1, (40 + 28 * n)::INT AS y1,
  (40 + 12 * (length(array_to_string(p[1:k], ' ')) + (k > 0)::INT) + 12 * length(p[k + 1]))::INT AS x2, (68 + 28 * n)::INT AS y2
  FROM wk WHERE p[k + 1] <> ''),
lines AS (SELECT doc_id, pi, li, (5 * pi + li)::BIGINT AS id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM words GROUP BY ALL),
paras AS (SELECT doc_id, pi, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM words GROUP BY ALL),
pgs AS (SELECT doc_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM words GROUP BY ALL)"""

#: Lines as slanted quadrilaterals with their retina's parameters (``pr``) and forward points (``fw``).
CASCADE = f"""{WORDS}, c AS (SELECT doc_id, id, x1 AS px, y1 AS py, x2 - x1 AS cw, y2 + id % 7 - y1 AS chh, x1, y1, x2, y2, id % 7 AS m,
  CASE WHEN (x2 - x1) ** 2 + (id % 7) ** 2 >= (y2 - y1) ** 2 THEN degrees(atan2((id % 7)::DOUBLE, (x2 - x1)::DOUBLE)) ELSE -90.0::DOUBLE END AS raw FROM lines),
 a AS (SELECT *, CASE WHEN abs(raw) < 0.5 THEN 0.0 ELSE raw END AS angle, abs(cos(radians(CASE WHEN abs(raw) < 0.5 THEN 0.0 ELSE raw END))) AS co, abs(sin(radians(CASE WHEN abs(raw) < 0.5 THEN 0.0 ELSE raw END))) AS si FROM c),
 r AS (SELECT *, greatest(ceil(cw * co + chh * si - 1e-9), 1) AS rw, greatest(ceil(cw * si + chh * co - 1e-9), 1) AS rh FROM a),
 s AS (SELECT *, least(1024.0::DOUBLE / rw, 1024.0::DOUBLE / rh) AS scale FROM r),
 pr AS (SELECT *, floor((1024 - trunc(rw * scale)) / 2) AS ox, floor((1024 - trunc(rh * scale)) / 2) AS oy FROM s),
 pt AS (SELECT *, unnest([x1, x2, x2, x1]) AS x, unnest([y1, y1 + m, y2 + m, y2]) AS y, unnest([0, 1, 2, 3]) AS k FROM pr),
 fw AS (SELECT *, trunc(((x - px - cw / 2) * cos(radians(angle)) + (y - py - chh / 2) * sin(radians(angle)) + rw / 2) * scale + ox)::INT AS fx,
  trunc((-(x - px - cw / 2) * sin(radians(angle)) + (y - py - chh / 2) * cos(radians(angle)) + rh / 2) * scale + oy)::INT AS fy FROM pt)"""
