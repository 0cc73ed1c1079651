"""Queries over box search, detection waves, contours through levels, files and ingest."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import functions as F

from pageweave.functions.scratch import new_path
from pageweave.functions.store import Versions
from pageweave.operators import boxes, crawl, detect, geometry, hierarchy, links, metrics
from pageweave.plans.common import CASCADE, WORDS, lines, table, words
from pageweave.plans.corpus import LINKS, _pages, LOGS, _logs
from pageweave.plans.documents import DETS, _BOX, _contours, _dets
from pageweave.sources import files
from pageweave.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@register(f"""WITH {WORDS}, e AS (SELECT doc_id, pi, li, wi, x1, y1, x2, y2, x2 - x1 AS w, greatest(1, trunc(quantile_cont(x2 - x1, 0.5) OVER (PARTITION BY doc_id, pi, li))::INT) AS e FROM words),
 s AS (SELECT *, CASE WHEN w <= 1.5 * e THEN [x1] ELSE list_distinct(list_concat(range(x1, x2 - e + 1, greatest(1, e // 2)), [x2 - e])) END AS starts FROM e)
 SELECT doc_id, pi, li, wi, x::INT AS x1, y1, CASE WHEN w <= 1.5 * e THEN x2 ELSE x + e END::INT AS x2, y2 FROM (SELECT *, unnest(starts) AS x FROM s)""")  # fmt: skip
def b2_candidate_boxes(spark, d):
    return boxes.candidate_boxes(words(spark, d).drop("text"), ["doc_id", "pi", "li"])


@register(f"""WITH {WORDS}{DETS}, dl AS (SELECT *, id // 2000 AS line FROM dets)
 SELECT a.doc_id || ':' || a.line AS component, a.id, (2 * sum(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))))::BIGINT AS score
 FROM dl a JOIN dl b ON a.doc_id = b.doc_id AND a.line = b.line GROUP BY ALL""")  # fmt: skip
def b10_overlap_score(spark, d):
    rows = _dets(spark, d).withColumn("component", F.concat_ws(":", "doc_id", F.expr("id div 2000")))
    return boxes.overlap_score(rows, "component", ("doc_id",)).withColumn("score", F.col("score").cast("bigint"))


def _named(spark, d):
    """Words labelled by their first letter."""
    w = words(spark, d).withColumn("id", (1000 * (5 * F.col("pi") + F.col("li")) + F.col("wi")).cast("bigint"))
    return w.select("doc_id", "id", F.lower(F.substring("text", 1, 1)).alias("label"), *_BOX)


@register(f"""WITH {WORDS}, f AS (SELECT doc_id, (1000 * (5 * pi + li) + wi)::BIGINT AS id, lower(text[1]) AS label, x1, y1, x2, y2 FROM words WHERE lower(text[1]) IN ('s', 't', 'a'))
 SELECT a.doc_id, a.id AS first, b.id AS second, c.id AS third FROM f a
 JOIN f b ON a.doc_id = b.doc_id AND b.label = 't' AND b.x1 >= a.x1 AND b.y1 >= a.y1 - 64 AND b.x2 <= a.x2 + 64 AND b.y2 <= a.y2 + 64
 JOIN f c ON b.doc_id = c.doc_id AND c.label = 'a' AND c.x1 >= b.x1 AND c.y1 >= b.y1 - 64 AND c.x2 <= b.x2 + 64 AND c.y2 <= b.y2 + 64 WHERE a.label = 's'""")  # fmt: skip
def b13_sequence_search(spark, d):
    found = boxes.sequence_search(_named(spark, d), "doc_id", "sta")
    return found.select("doc_id", *[F.col("chain")[k].alias(n) for k, n in enumerate(("first", "second", "third"))])


@register(f"""WITH {WORDS}, f AS (SELECT doc_id, (2 * (1000 * (5 * pi + li) + wi) + 1)::BIGINT AS id, lower(text[1]) AS label, x1, y1, x2, y2 FROM words WHERE lower(text[1]) IN ('s', 't', 'a'))
 SELECT a.doc_id, a.id AS first, b.id AS second, c.id AS third FROM f a
 JOIN f b ON a.doc_id = b.doc_id AND b.label = 't' AND b.x1 >= a.x1 AND b.y1 >= a.y1 - 64 AND b.x2 <= a.x2 + 64 AND b.y2 <= a.y2 + 64
 JOIN f c ON b.doc_id = c.doc_id AND c.label = 'a' AND c.x1 >= b.x1 AND c.y1 >= b.y1 - 64 AND c.x2 <= b.x2 + 64 AND c.y2 <= b.y2 + 64 WHERE a.label = 's'""")  # fmt: skip
def b13_merged_sequence_search(spark, d):
    """Each word with a copy one step to the right: a component of two, whose larger box is the copy."""
    rows = _named(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumns({"id": 2 * F.col("id") + F.col("copy"), "x1": F.col("x1") + F.col("copy"), "x2": F.col("x2") + F.col("copy")})
    found = boxes.merged_sequence_search(rows, "doc_id", "sta")
    return found.select("doc_id", *[F.col("chain")[k].alias(n) for k, n in enumerate(("first", "second", "third"))])


def _cands(spark, d):
    """Words and their moved copies, each also half a line lower, labelled by a prefix of the word."""
    w = words(spark, d).withColumn("k", (1000 * (5 * F.col("pi") + F.col("li")) + F.col("wi")).cast("bigint"))
    w = w.withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    shape = {"x1": F.col("x1") + 5 * F.col("copy"), "x2": F.col("x2") + 5 * F.col("copy"), "y1": F.col("y1") + 9 * F.col("copy"), "y2": F.col("y2") + 9 * F.col("copy")}
    w = w.withColumns(shape).withColumn("id", 3 * F.col("k") + F.col("copy"))
    label = F.expr("substring(text, 1, greatest(1, cast(length(text) - (k + copy) % 3 as int)))")
    return w.select("doc_id", "id", label.alias("label"), (F.col("id") * 37 % 101).alias("distance"), *_BOX)


@register()
def b21_greedy_same_label(spark, d):
    return boxes.greedy_same_label(_cands(spark, d), "doc_id")


@register()
def b22_drop_substring_overlaps(spark, d):
    return boxes.drop_substring_overlaps(_cands(spark, d), "doc_id")


def _classes(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf[["doc_id", "id"]].assign(class_id=(pdf["x2"] - pdf["x1"]) // 12 % 7)


@register(f"WITH {WORDS} SELECT doc_id, id, ((x2 - x1) // 12 % 7)::BIGINT AS class_id FROM lines")
def d1_score_wave(spark, d):
    """The model is a rule on the line's width."""
    return detect.score_wave(lines(spark, d), _classes, "doc_id long, id long, class_id long")


def _halves(level: int):
    """A wave's model: each region in two, across at even levels and down at odd ones."""
    a, b = ("x1", "x2") if level % 2 == 0 else ("y1", "y2")

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        mid = (pdf[a] + pdf[b]) // 2
        return pd.concat([pdf.assign(path=pdf["path"] * 2, **{b: mid}), pdf.assign(path=pdf["path"] * 2 + 1, **{a: mid})])

    return predict


@register(f"""WITH {WORDS}, l1 AS (SELECT doc_id, k AS path, CASE k WHEN 1 THEN (x1 + x2) // 2 ELSE x1 END AS x1, y1, CASE k WHEN 0 THEN (x1 + x2) // 2 ELSE x2 END AS x2, y2 FROM pgs, (SELECT unnest([0, 1]) AS k)),
 l2 AS (SELECT doc_id, 2 * path + k AS path, x1, CASE k WHEN 1 THEN (y1 + y2) // 2 ELSE y1 END AS y1, x2, CASE k WHEN 0 THEN (y1 + y2) // 2 ELSE y2 END AS y2 FROM l1, (SELECT unnest([0, 1]) AS k))
 SELECT doc_id, path::BIGINT AS path, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2 FROM l2""")  # fmt: skip
def d2_run_cascade(spark, d):
    pages = lines(spark, d).groupBy("doc_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    schema = "doc_id long, path long, x1 long, y1 long, x2 long, y2 long"
    return detect.run_cascade(pages.withColumn("path", F.lit(0)), _halves, 2, schema)[-1]


_WAVES = "w1 AS (SELECT doc_id, k AS path, x1, CASE k WHEN 1 THEN (y1 + y2) // 2 ELSE y1 END AS y1, x2, CASE k WHEN 0 THEN (y1 + y2) // 2 ELSE y2 END AS y2 FROM pgs, (SELECT unnest([0, 1]) AS k))" + "".join(
    f", w{n} AS (SELECT doc_id, 2 * path + k AS path, {cells} FROM w{n - 1}, (SELECT unnest([0, 1]) AS k))"
    for n in (2, 3, 4)
    for cells in ["CASE k WHEN 1 THEN (x1 + x2) // 2 ELSE x1 END AS x1, y1, CASE k WHEN 0 THEN (x1 + x2) // 2 ELSE x2 END AS x2, y2" if n % 2 == 0 else "x1, CASE k WHEN 1 THEN (y1 + y2) // 2 ELSE y1 END AS y1, x2, CASE k WHEN 0 THEN (y1 + y2) // 2 ELSE y2 END AS y2"]
)


@register(f"""WITH {WORDS}, {_WAVES} SELECT doc_id, path::BIGINT AS path, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2 FROM w4""")
def d2_resumed_cascade(spark, d):
    """Five levels, of which the first two read the pages: a run that stops after the third wave, and one that goes on from there."""
    pages = lines(spark, d).groupBy("doc_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    pages = pages.withColumn("path", F.lit(0))
    schema, store = "doc_id long, path long, x1 long, y1 long, x2 long, y2 long", new_path(spark, "waves")
    detect.run_cascade(pages, _halves, 3, schema, store, 2)
    return detect.run_cascade(pages, _halves, 5, schema, store, 2)[-1]


@register()
def d3_close_contours(spark, d):
    """Each word's upper left corner is a step of its paragraph; words of thirteen letters, or more, end it."""
    w = words(spark, d).select("doc_id", "pi", (100 * F.col("li") + F.col("wi")).alias("k"), F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y"), F.when(F.length("text") < 13, 4).otherwise(0).alias("class_id"))
    return detect.close_contours(w, ["doc_id", "pi"], "k", 200.0)


@register(f"""WITH {LINKS}, f AS (SELECT target AS url, min({{'o': 1000 * page_id + ordinal, 's': 'page' || page_id}}) AS f FROM res WHERE kind = 'page' GROUP BY target),
 t AS (SELECT url, f.s AS source, f.o AS o FROM f WHERE length(url) % 7 <> 0 AND length(url) % 6 >= 2 ORDER BY o, url LIMIT 150),
 n AS (SELECT url, source, row_number() OVER (ORDER BY o) - 1 AS index FROM t)
 SELECT url, source, index, printf('doc_%04d_%s.png', index, md5(url)[1:8]) AS name FROM n""")  # fmt: skip
def d7_collect_documents(spark, d):
    found = links.resolve_links(links.extract_links(_pages(spark, d)).filter("kind = 'page'")).select(
        F.col("target").alias("url"), (1000 * F.col("page_id") + F.col("ordinal")).alias("ordinal"), F.concat(F.lit("page"), "page_id").alias("source")
    )
    counts = found.select("url").distinct().withColumn("paragraphs", F.length("url") % 6).filter(F.length("url") % 7 != 0)
    return crawl.collect_documents(found, counts, 2, 150)


@register(f"WITH {CASCADE} SELECT doc_id, id, string_agg(fx || ',' || fy, ';' ORDER BY k) AS points FROM fw GROUP BY ALL")
def g10_forward_contours(spark, d):
    out = geometry.forward_contours(geometry.cascade_params(_contours(spark, d)))
    return out.select("doc_id", "id", F.array_join(F.expr("transform(contour, p -> concat(p.x, ',', p.y))"), ";").alias("points"))


@register(f"""WITH {WORDS}, a AS (SELECT doc_id, id, (x1 - 7) / 0.8 + 3 - 100 AS dx, (y1 - 5) / 0.8 + 11 - 50 AS dy, radians(-degrees(atan2(0.5, 0.8))) AS t FROM lines),
 b AS (SELECT doc_id, id, (cos(t) * dx + sin(t) * dy + 100 - 2) / 1.7 + id % 9 AS x, (-sin(t) * dx + cos(t) * dy + 50 - 4) / 1.7 + 6 AS y FROM a)
 SELECT doc_id, id, round_even(x, 0)::INT AS x, round_even(y, 0)::INT AS y FROM b""")  # fmt: skip
def g12_reverse_levels(spark, d):
    """A turn with neither rational sine nor cosine, so that no point falls on a half."""
    angle = geometry.orientation_angle(F.lit(0.5), F.lit(-0.8))
    level = lambda s, ox, oy, cx, cy, t, mx, my: F.struct(*[F.lit(v).cast("double").alias(n) if not hasattr(v, "alias") else v.cast("double").alias(n) for n, v in zip(("scale", "ox", "oy", "crop_x", "crop_y", "angle", "cx", "cy"), (s, ox, oy, cx, cy, t, mx, my))])
    rows = lines(spark, d).withColumn("contour", F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))
    rows = rows.withColumn("levels", F.array(level(0.8, 7, 5, 3, 11, angle, 100, 50), level(1.7, 2, 4, F.col("id") % 9, 6, 0, 0, 0)))
    return geometry.reverse_levels(rows).select("doc_id", "id", F.col("contour")[0]["x"].alias("x"), F.col("contour")[0]["y"].alias("y"))


@register(f"WITH {WORDS} SELECT doc_id, pi, li, wi, text, x1, y1, x2, y2 FROM words")
def s3_s4_annotation_files(spark, d):
    path = new_path(spark, "annotations")
    files.write_annotations(hierarchy.nest(words(spark, d)), path)
    return hierarchy.unnest(files.read_annotations(spark, path))


@register("SELECT 'd' || doc_id AS custom_id, coalesce(text, '') AS body FROM documents")
def s5_s6_request_files(spark, d):
    path = new_path(spark, "requests")
    rows = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("custom_id"), F.coalesce("text", F.lit("")).alias("body"))
    files.write_requests(rows, path)
    return files.read_responses(spark, path)


@register("SELECT o_orderkey, o_orderstatus FROM orders")
def s7_export_metadata(spark, d):
    path = new_path(spark, "metadata")
    files.export_metadata(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("ts")), path)
    return spark.read.schema("o_orderkey long, o_orderstatus string").json(path)


@register("SELECT DISTINCT coalesce(lang, 'none') AS lang, 'png' AS kind FROM documents")
def s2_list_images(spark, d):
    """A folder of image-named and other files of every document, by language; only the images are listed."""
    path = new_path(spark, "images")
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("folder"), F.md5("text").alias("line"))
    docs.write.partitionBy("folder").option("extension", "png").csv(path)
    docs.write.mode("append").partitionBy("folder").text(path)
    listed = files.list_images(spark, path)
    return listed.select(F.regexp_extract("path", "folder=([^/]+)/", 1).alias("lang"), F.regexp_extract("name", "([^.]+)$", 1).alias("kind")).distinct()


@register(f"WITH {LOGS} SELECT 'run' || run AS file, round(arg_max(loss, epoch) FILTER (improved), 3) AS best FROM b GROUP BY run")
def s9_read_logs(spark, d):
    """Logs written as a text file per run, read back in line order and parsed."""
    path = new_path(spark, "logs")
    rows = _logs(spark, d).repartition("file").sortWithinPartitions("file", "line_no")
    rows.select("file", "line").write.partitionBy("file").text(path)
    back = files.read_logs(spark, path).withColumn("file", F.regexp_extract("file", "file=([^/]+)", 1))
    return metrics.parse_training_log(back).withColumn("best", F.round("best", 3))


@register("SELECT doc_id AS path, md5(text || '!') AS hash FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 AND doc_id % 5 <> 0")
def m11_changed_files(spark, d):
    """Every fifth document changed, every seventh is new."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"), F.md5(F.concat("text", F.lit("!"))).alias("other"))
    now = docs.withColumn("hash", F.when((F.col("path") % 5 == 0) | (F.col("path") % 7 == 0), F.col("other")).otherwise(F.col("hash")))
    return crawl.changed_files(docs.filter("path % 7 <> 0"), now).select("path", "hash")


EVENTS = "event_id long, user_id long, value double"


def _incoming(spark, d):
    """The events as files of a folder."""
    path = new_path(spark, "incoming")
    table(spark, d, "events").select("event_id", "user_id", "value").repartition(6, "user_id").write.parquet(path)
    return path


def _ingested(spark, d):
    """Two writers run over the folder, then a third with a new checkpoint: it finds every file handled."""
    source, status, out, claims = _incoming(spark, d), *(new_path(spark, n) for n in ("status", "out", "claims"))
    for together in (2, 1):
        runs = []
        for _ in range(together):
            stream = ingest.watch_dir(spark, source, EVENTS, 2)
            runs.append(ingest.ingest_once(stream, status, new_path(spark, "stream"), lambda rows, _: rows.filter("value > 10"), out, claims))
        for r in runs:
            ingest.drain(r)
    return out


@register("SELECT event_id, user_id FROM events WHERE value > 10")
def x1_x2_once_per_file(spark, d):
    """Also X5: the runs drain the folder, two files a round."""
    return spark.read.parquet(_ingested(spark, d)).select("event_id", "user_id")


def _over_ten(name: str, content: bytes) -> pd.DataFrame:
    rows = pd.read_parquet(io.BytesIO(content))
    return rows[rows["value"] > 10][["event_id", "value"]]


@register("""SELECT k, CASE WHEN k % 3 = 0 THEN 'error' WHEN bool_or(value > 10) THEN 'annotated' ELSE 'empty' END AS status,
 CASE WHEN k % 3 = 0 THEN 0 ELSE count(*) FILTER (value > 10) END AS n FROM (SELECT user_id % 12 AS k, value FROM events WHERE user_id % 12 <> 2 OR value <= 10) GROUP BY k""")
def x6_status_sink(spark, d):
    """A folder of twelve files, four of which are no Parquet files and one of which has no result; each file's status and rows."""
    path, status, out = (new_path(spark, n) for n in ("files", "status", "out"))
    rows = table(spark, d, "events").select("event_id", "value", (F.col("user_id") % 12).alias("k")).filter("k <> 2 or value <= 10").repartition("k")
    rows.filter("k % 3 <> 0").write.partitionBy("k").parquet(path)
    rows.filter("k % 3 = 0").write.mode("append").partitionBy("k").option("extension", "parquet").csv(path)
    handle = ingest.each_file(_over_ten, "event_id long, value double")
    ingest.drain(ingest.ingest_once(ingest.watch_files(spark, path, 4, "*.parquet"), status, new_path(spark, "stream"), handle, out))
    found = spark.read.parquet(out).groupBy("filename").agg(F.count("*").alias("n"))
    files_ = ingest.processed(spark, status).join(found, "filename", "left")
    k = F.regexp_extract("filename", "k=([0-9]+)/", 1).cast("bigint")
    return files_.select(k.alias("k"), F.regexp_extract("status", "^[a-z]+", 0).alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


@register("SELECT user_id % 12 AS k, count(*) AS n FROM events GROUP BY k")
def x7_running_totals(spark, d):
    """Totals of each file over rounds of two files, half of them merged into a snapshot."""
    path, source = new_path(spark, "totals"), new_path(spark, "files")
    rows = table(spark, d, "events").select("event_id", "user_id", "value", (F.col("user_id") % 12).alias("k")).repartition("k")
    for part in ("k < 6", "k >= 6"):
        rows.filter(part).write.mode("append").partitionBy("k").parquet(source)
        if part == "k < 6":
            checkpoint = new_path(spark, "stream")
        else:
            ingest.compact_totals(spark, path)
        ingest.running_totals(ingest.watch_dir(spark, source, EVENTS, 2), path, checkpoint).awaitTermination()
    k = F.regexp_extract("filename", "k=([0-9]+)/", 1).cast("bigint")
    return ingest.totals(spark, path).select(k.alias("k"), "n")


@register("""WITH f AS (SELECT printf('f%09d', doc_id) AS filename FROM documents WHERE doc_id % 5 <> 0)
 SELECT filename, CASE WHEN n <= 20 THEN 'a' ELSE 'b' END AS owner, 'batch_pending' AS status FROM (SELECT filename, row_number() OVER (ORDER BY filename) AS n FROM f) WHERE n <= 50""")
def w1_claims_appended(spark, d):
    """Twenty names for one writer and thirty for another; every fifth document is done."""
    f = table(spark, d, "documents").select(F.format_string("f%09d", "doc_id").alias("filename"), "doc_id")
    path = new_path(spark, "claims")
    pending = ingest.claim_first(f, f.filter("doc_id % 5 = 0"), path, 20, "a").unionByName(ingest.claim_first(f, f.filter("doc_id % 5 = 0"), path, 30, "b"))
    return ingest.claims(spark, path).join(pending, "filename")


@register("""WITH r AS (SELECT user_id, event_id, CASE WHEN user_id % 4 = 0 THEN (100 * last)::INT ELSE -1 END AS paragraph_count
  FROM (SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) FILTER (event_type = (SELECT min(event_type) FROM events)) AS v, coalesce(v, -0.01) AS last FROM events GROUP BY user_id)
  WHERE user_id % 10 <> 0) SELECT *, (SELECT count(*) FROM r) AS n, 4::BIGINT AS version FROM r""")
def s8_registry_snapshots(spark, d):
    """A registry of users through four versions: two upserts, scores, deletions; with its exact count."""
    e = table(spark, d, "events")
    store = Versions(spark, new_path(spark, "registry"), "user_id bigint, event_id bigint, paragraph_count int")
    rows = e.select("user_id", "event_id", F.lit(-1).alias("paragraph_count"))
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        store.update(lambda old, part=part: crawl.insert_or_replace(old, rows.filter(part), "user_id", "event_id"))
    kind = e.agg(F.min("event_type").alias("event_type"))
    scores = e.join(F.broadcast(kind), "event_type").filter("user_id % 4 = 0")  # one row
    scores = scores.select("user_id", "event_id", F.round(100 * F.col("value")).cast("int").alias("paragraph_count"))
    store.update(lambda old: crawl.update_scores(old, scores.withColumnRenamed("event_id", "ts"), "user_id", "paragraph_count", "ts"))
    version = store.update(lambda old: old.filter("user_id % 10 <> 0"))
    now = store.read()
    return now.withColumns({"n": F.lit(now.count()), "version": F.lit(version).cast("bigint")})
