"""Crawl state: frontier, schedule, registry and budgets as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageweave.functions.scan import scan, schedule
from pageweave.functions.scratch import saved


def bfs_frontier(links: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """``url, depth``: first depth wins; per depth in order of ``url``, at most ``max_pages`` in all.

    ``links(src, dst)``, ``seeds(url)``. A depth is one distributed join and anti-join, written to the shared folder.
    """
    seen = saved(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "seen")
    layer = seen
    for depth in range(1, max_depth + 1):
        if max_pages is not None and seen.count() >= max_pages:
            break
        nxt = layer.join(links, layer["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        layer = saved(nxt.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), "layer")
        if layer.isEmpty():
            break
        seen = seen.unionByName(layer)  # the layers' own tables: none is written again
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def rate_limit_schedule(requests: DataFrame, delay: float, key: str = "host", arrive: str = "arrive") -> DataFrame:
    """Earliest start per host, at least ``delay`` apart: a running maximum of arrival minus place times delay.

    Ties go by the other columns. A host of any size lies over many tasks; its stretches meet as one place count and one
    maximum each. A request without an arrival starts as soon as the one before it lets it, and null if there is none.
    """
    rest = [c for c in requests.columns if c not in (key, arrive)]
    at = scan(requests, [key], [arrive, *rest], **schedule(delay, arrive), name="schedule")
    start = (F.col("i") - 1) * delay + F.col("peak")
    return at.withColumn("start", F.when(~F.isnan(start), start)).drop("i", "peak")


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of a key wins."""
    fresh = new.join(existing.select(key), key, "left_anti")
    first = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")
    return existing.unionByName(first)


def insert_or_replace(existing: DataFrame, new: DataFrame, key: str, ts: str) -> DataFrame:
    """The last row of a key wins; of equal times that of ``new``."""
    rows = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc("__new")))
    return rows.withColumn("__n", last).filter("__n = 1").drop("__n", "__new")


def union_sources(links: DataFrame, hits: DataFrame) -> DataFrame:
    """``url, source``: links with the page they are from, and search hits ``url, query`` with ``google:`` and the query."""
    found = hits.select("url", F.concat(F.lit("google:"), F.col("query").cast("string")).alias("source"))
    return links.select("url", "source").unionByName(found)


def asset_status(assets: DataFrame, min_bytes: int = 5000, min_side: int = 200, min_pdf: int = 10_000, max_pdf: int = 200_000_000) -> DataFrame:
    """Decision table on ``kind, bytes, width, height, pages``."""
    small = F.least("width", "height") < min_side
    return assets.withColumn(
        "status",
        F.when(F.col("bytes").isNull(), "failed")
        .when((F.col("kind") == "pdf") & ((F.col("bytes") < min_pdf) | (F.col("bytes") > max_pdf)), "failed")
        .when((F.col("kind") == "pdf") & (F.col("pages") < 1), "no_pages")
        .when((F.col("kind") != "pdf") & (F.col("bytes") < min_bytes), "skip_small")
        .when((F.col("kind") != "pdf") & small, "skip_small")
        .otherwise("saved"),
    )


def assign_index(rows: DataFrame, order: str, start: int = 0, per_part: int = 100_000) -> DataFrame:
    """Dense counter ``idx`` in ``order`` (a number) from ``start``: counts by stretch of the order, then places within."""
    part = F.floor(F.col(order) / per_part)
    counts = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch
    base = counts.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__b"))
    placed = rows.withColumn("__p", part).withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1)
    return placed.join(base, "__p").withColumn("idx", F.lit(start) + F.col("__b") + F.col("__r")).drop("__p", "__b", "__r")


def pdf_pages(assets: DataFrame, most: int = 100) -> DataFrame:
    """A row per page index of assets with ``pages``, at most ``most`` of each."""
    n = F.least(F.col("pages"), F.lit(most)).cast("int")
    return assets.filter("pages > 0").withColumn("page", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("pages_extracted", n)


def extracted_pages(assets: DataFrame, sizes: DataFrame, key: str, most: int = 100, least: int = 200) -> DataFrame:
    """The first ``most`` pages of each asset that are ``least`` wide and high (``sizes``: key, ``page, width, height``), with
    ``pages_extracted``, how many of an asset's stayed."""
    rows = pdf_pages(assets, most).drop("pages_extracted", "width", "height").join(sizes, [key, "page"])
    rows = rows.filter((F.col("width") >= least) & (F.col("height") >= least))
    n = rows.groupBy(key).agg(F.count("*").cast("int").alias("pages_extracted"))
    return rows.join(n, key)


def crawl_report(documents: DataFrame, queue: DataFrame, visited: DataFrame, assets: DataFrame) -> DataFrame:
    """``item, n``: documents kept, pages queued and visited, assets of each status."""
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n") for name, d in (("documents", documents), ("queue", queue), ("visited", visited))]
    status = counts_by(assets, "status").select(F.concat(F.lit("assets: "), "status").alias("item"), "n")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(status)


def score_gate(docs: DataFrame, scores: DataFrame, key: str, threshold: float) -> DataFrame:
    """Rows not scored yet take their score if it reaches the threshold and go otherwise; scored rows stay."""
    j = docs.join(scores.select(key, F.col("score").alias("__s")), key, "left")
    kept = j.filter((F.col("paragraph_count") != -1) | (F.col("__s") >= threshold))
    return kept.withColumn(
        "paragraph_count", F.when(F.col("paragraph_count") == -1, F.col("__s")).otherwise(F.col("paragraph_count"))
    ).drop("__s")


def skip_visited(assets: DataFrame, visited: DataFrame, key: str, order: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return assets.join(visited.select(key), key, "left_anti").withColumn("__n", first).filter("__n = 1").drop("__n")


def take_budget(rows: DataFrame, order: list[str], n: int, accepted: str) -> DataFrame:
    """The first ``n`` accepted rows in arrival order."""
    return rows.filter(accepted).orderBy(*order).limit(n)


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def image_names(rows: DataFrame, index: str, url: str, prefix: str = "documents/") -> DataFrame:
    """``name``: ``doc_`` + six digits + twelve characters of the URL's md5; ``object_key`` with the prefix."""
    name = F.format_string("doc_%06d_%s.png", F.col(index), F.substring(F.md5(F.col(url).cast("binary")), 1, 12))
    return rows.withColumn("name", name).withColumn("object_key", F.concat(F.lit(prefix), name))


def pdf_page_names(rows: DataFrame, index: str, url: str, page: str) -> DataFrame:
    """``name`` of each page: ``pdf_`` + six digits + twelve characters of the URL's md5 + ``_p`` + three digits."""
    return rows.withColumn("name", F.format_string("pdf_%06d_%s_p%03d.png", F.col(index), F.substring(F.md5(F.col(url).cast("binary")), 1, 12), F.col(page)))


def public_urls(rows: DataFrame, base: str, key: str = "object_key") -> DataFrame:
    """``public_url``: the object's key under the ``base`` of its store, one slash between."""
    return rows.withColumn("public_url", F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(F.col(key), F.lit("/"))))


def upsert(snapshot: DataFrame, changes: DataFrame, deleted: DataFrame, key: str, ts: str) -> DataFrame:
    """A registry's next snapshot: last write of a key wins, deleted keys go."""
    return insert_or_replace(snapshot, changes, key, ts).join(deleted.select(key), key, "left_anti")


def update_scores(snapshot: DataFrame, scores: DataFrame, key: str, score: str, ts: str) -> DataFrame:
    """Rows with the last ``score`` given for their key (of equal times the larger); keys without a row change nothing."""
    last = scores.groupBy(key).agg(F.max(F.struct(ts, score)).alias("__s"))
    j = snapshot.join(last, key, "left")
    new = F.when(F.col("__s").isNotNull(), F.col(f"__s.{score}")).otherwise(F.col(score))
    return j.withColumn(score, new).select(*snapshot.columns)


def collect_documents(found: DataFrame, counts: DataFrame, threshold: int, most: int) -> DataFrame:
    """``url, source, index, name`` of the first ``most`` distinct URLs (by ``ordinal``) with enough paragraphs.

    A URL without a row in ``counts`` (``url, paragraphs``) could not be fetched. It keeps the source that showed it first.
    """
    first = found.groupBy("url").agg(F.min(F.struct("ordinal", "source")).alias("f")).select("url", "f.*")
    taken = take_budget(first.join(counts, "url"), ["ordinal", "url"], most, f"paragraphs >= {threshold}")
    rows = assign_index(taken, "ordinal", 0)
    name = F.format_string("doc_%04d_%s.png", F.col("idx"), F.substring(F.md5("url"), 1, 8))
    return rows.select("url", "source", F.col("idx").alias("index"), name.alias("name"))


def changed_files(previous: DataFrame, now: DataFrame) -> DataFrame:
    """Rows of ``now`` (``path, hash``) whose hash differs from the last one seen; a new path is changed if it has a hash."""
    before = previous.select("path", F.col("hash").alias("__h"))
    return now.join(before, "path", "left").filter(~F.col("hash").eqNullSafe(F.col("__h"))).drop("__h")
