"""Queries over links, crawl state, waves' bookkeeping and run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageweave.functions.scratch import dealt
from pageweave.operators import crawl, geometry, links, metrics, waves
from pageweave.plans.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: What every page gets after its own text, so that all kinds of links, quotes and classes occur; %d is the page's id.
MORE = (
    "<img src='/i/%d.PNG'><img data-src=\"../thumb/%d.jpg?w=1&amp;h=2\"><IMG alt=\"a > b\" src=\"\" data-original=plain%d.webp>"
    "<source srcset=\"/s/%d-1.png 1x, ./s/%d-2.png 2x,\"><meta property=\"og:image\" content=\"//cdn.example.org/%d.gif\">"
    "<meta name='twitter:image' content='https://img.example.org/%d.bmp'><meta name=\"author\" content=\"x%d\">"
    "<a class=x href='/docs/../papers/./%d.PDF#page=2'>p</a><a href=\"/data/%d.tar\">t</a><a href=\"feed%d.xml\">f</a><a href=\"?q=%d\">q</a>"
    "<a href=\"#top%d\">h</a><a href=\"mailto:a%d@example.org\">m</a><a href=\"a/b/c/../../../../../../../../../../d/%d/..\">u</a>"
    "<!-- <a href=\"/hidden/%d\">n</a> --><a href=\"http://other.example.org:8080/%d\">o</a>"
    "<img src='https://shown.example.org/%d'><img data-src=https://www.google.com/logo%d.png>"
    "<a title=\"x href=wrong%d\" rel='y href=wrong' HREF=\"right%d.html\" href=late>r</a><img data-x=%d src=data:image/png;base64," + "iVBORw0K" * 400 + " alt=long>"
    "<script>var s = \"https://pics.example.net/%d.jpeg\", g = 'https://www.gstatic.com/%d.png', t = 'https://pics.example.net/%d.tiff';</script>"
)
_SQL_MORE = MORE.replace("'", "''")


def _pages(spark, d):
    return table(spark, d, "pages").withColumn("html", F.concat("html", F.replace(F.lit(MORE), F.lit("%d"), F.col("page_id").cast("string"))))


def _sql_value(name: str) -> str:
    """First pair of that name, parted at its first equals sign; quotes go by their place."""
    pair = f"list_filter(pairs, lambda z: lower(trim(split_part(z, '=', 1), chr(32) || chr(9) || chr(10) || chr(13) || chr(12))) = '{name}')[1]"
    raw = f"trim(substring({pair}, strpos({pair}, '=') + 1), chr(32) || chr(9) || chr(10) || chr(13) || chr(12))"
    found = f"nullif(CASE WHEN left({raw}, 1) IN (chr(34), chr(39)) THEN substring({raw}, 2, length({raw}) - 2) ELSE {raw} END, '')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        found = f"replace({found}, '{entity}', '{char}')"
    return found


_TAGS_SQL = r"""(?is)<(?:img|source|meta|a)\s(?:"[^"]*"|'[^']*'|[^'">])*>""".replace("'", "''")
_PAIRS_SQL = r"""[^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""".replace("'", "''")
_IMAGES_SQL = ", ".join(f"'{x}'" for x in links.IMAGES)
LINKS = rf"""more AS (SELECT page_id, url, html || replace('{_SQL_MORE}', '%d', page_id::VARCHAR) AS html FROM pages),
 tags AS (SELECT page_id, url, regexp_extract_all(regexp_replace(html, '{links.UNSEEN}', '', 'g'), '{_TAGS_SQL}') AS t FROM more),
 tg AS (SELECT page_id, url, unnest(t) AS tag, unnest(range(len(t)))::INT AS ordinal FROM tags),
 nm AS (SELECT *, lower(regexp_extract(tag, '^<([a-zA-Z]+)', 1)) AS name, regexp_extract_all(tag, '{_PAIRS_SQL}') AS pairs FROM tg),
 vl AS (SELECT page_id, url, ordinal, CASE WHEN name = 'a' THEN 'page' ELSE 'image' END AS kind, unnest(
  CASE WHEN name = 'a' THEN [{_sql_value("href")}] WHEN name = 'img' THEN [coalesce({_sql_value("src")}, {_sql_value("data-src")}, {_sql_value("data-original")})]
  WHEN name = 'source' THEN list_transform(string_split({_sql_value("srcset")}, ','), lambda x: regexp_extract(x, '^\s*(\S*)', 1))
  WHEN coalesce({_sql_value("property")}, {_sql_value("name")}) IN ('og:image', 'twitter:image') THEN [{_sql_value("content")}] END) AS raw_url FROM nm),
 links AS (SELECT page_id, url, kind, raw_url, min(ordinal) AS ordinal FROM vl WHERE raw_url <> '' GROUP BY ALL),
 pt AS (SELECT *, trim(raw_url) AS raw, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*(/(?:[^?#]*/)?)', 1) AS folder,
  regexp_extract(trim(raw_url), '^([^?#]*)', 1) AS path, regexp_extract(trim(raw_url), '^[^?#]*(.*)$', 1) AS tail FROM links),
 sg AS (SELECT *, string_split(CASE WHEN raw LIKE '/%' THEN path ELSE regexp_replace(CASE WHEN folder = '' THEN '/' ELSE folder END || path, '/{{2,}}', '/', 'g') END, '/') AS s FROM pt),
 fd AS (SELECT *, list_reduce(list_transform(s, lambda x: [x]), lambda acc, x: CASE WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 1)] WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END) AS f FROM sg),
 jn AS (SELECT *, array_to_string(CASE WHEN s[-1] IN ('.', '..') THEN list_concat(f, ['']) ELSE f END, '/') AS j FROM fd),
 res AS (SELECT page_id, url, kind, raw_url, ordinal, CASE WHEN regexp_matches(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN raw
  WHEN raw LIKE '//%' THEN regexp_extract(url, '^([a-z]+:)//', 1) || raw WHEN raw LIKE '#%' THEN regexp_extract(url, '^([^#]*)', 1) || raw
  WHEN raw LIKE '?%' THEN regexp_extract(url, '^([^?#]*)', 1) || raw ELSE host || CASE WHEN j = '' THEN '/' ELSE j END || tail END AS target FROM jn),
 ex AS (SELECT *, lower(regexp_extract(regexp_extract(target, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\.([^./]+)$', 1)) AS ext FROM res WHERE regexp_matches(target, '^https?://')),
 cl AS (SELECT page_id, url, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ({_IMAGES_SQL}) THEN 'image' WHEN ext IN ('tar', 'zip', 'js', 'css', 'svg', 'ico', 'mp4', 'exe') THEN 'skip' ELSE 'page' END AS class, target AS t0 FROM ex),
 cls AS (SELECT page_id, url, class, CASE WHEN class = 'page' THEN regexp_replace(t0, '#.*$', '') ELSE t0 END AS target FROM cl)"""


@register("SELECT page_id, url, length(html) AS n FROM pages WHERE regexp_matches(html, '(?i)<\\s*(?:!doctype|html|body|a|p|div)\\b')")
def s1_read_pages(spark, d):
    from pageweave.sources.files import read_pages

    return read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("n"))


@register(f"WITH {LINKS} SELECT page_id, kind, raw_url, ordinal FROM links")
def c1_extract_links(spark, d):
    return links.extract_links(_pages(spark, d)).select("page_id", "kind", "raw_url", "ordinal")


@register(f"WITH {LINKS} SELECT page_id, raw_url, target FROM res")
def c2_resolve_links(spark, d):
    return links.resolve_links(links.extract_links(_pages(spark, d))).select("page_id", "raw_url", "target")


@register(f"WITH {LINKS} SELECT page_id, target, class FROM cls")
def c3_classify_links(spark, d):
    r = links.classify_links(links.resolve_links(links.extract_links(_pages(spark, d))))
    return r.select("page_id", "target", "class")


@register(f"WITH {LINKS} SELECT page_id, count(*) AS n FROM cls WHERE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) = regexp_extract(target, '^[a-z]+://([^/?#]*)', 1) GROUP BY page_id")
def c6_same_domain(spark, d):
    r = links.same_domain(links.classify_links(links.resolve_links(links.extract_links(_pages(spark, d)))))
    return r.groupBy("page_id").agg(F.count("*").alias("n"))


#: Image URLs of each page's scripts with their first places (``f``).
SCRIPTS = rf"""b AS (SELECT page_id, array_to_string(list_transform(string_split(html, '<script')[2:], lambda z: split_part(z, '</script', 1)), chr(10)) AS t FROM more),
 u AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(t, '[\s"''\\<>()]+'), lambda z: contains(z, 'http'))) AS w, unnest(range(len(list_filter(regexp_split_to_array(t, '[\s"''\\<>()]+'), lambda z: contains(z, 'http'))))) AS pos FROM b),
 v AS (SELECT page_id, pos, regexp_extract(w, 'https?://.+') AS link FROM u),
 f AS (SELECT page_id, link, min(pos) AS pos FROM v WHERE NOT contains(link, 'google') AND NOT contains(link, 'gstatic')
  AND lower(string_split(string_split(split_part(split_part(link, '?', 1), '#', 1), '/')[-1], '.')[-1]) IN ({_IMAGES_SQL}) GROUP BY ALL)"""


@register(f"""WITH {LINKS}, {SCRIPTS} SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS rank FROM f QUALIFY rank <= 10""")
def c7_script_image_urls(spark, d):
    return links.script_urls(_pages(spark, d))


@register(f"""WITH {LINKS}, {SCRIPTS}, g AS (SELECT page_id, coalesce({_sql_value("src")}, {_sql_value("data-src")}) AS link, ordinal FROM nm WHERE name = 'img'),
 h AS (SELECT page_id, link, 0 AS kind, ordinal AS pos FROM g WHERE starts_with(link, 'http') AND NOT contains(link, 'google') UNION ALL SELECT page_id, link, 1, pos FROM f),
 m AS (SELECT page_id, link, min((kind, pos)) AS o FROM h GROUP BY ALL) SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY o)::INT AS rank FROM m QUALIFY rank <= 3""")
def c7_search_images(spark, d):
    return links.search_images(_pages(spark, d), 3)


@register("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
 e AS (SELECT page_id AS src, (7 * page_id + k) % n AS dst FROM pages, n, (SELECT unnest([1, 2, 3]) AS k)),
 r(url, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = url WHERE depth < 4)
 SELECT url, min(depth)::INT AS depth FROM r GROUP BY url""")  # fmt: skip
def c8_bfs_frontier(spark, d):
    pages = table(spark, d, "pages").select("page_id")
    n = pages.groupBy().agg(F.count("*").alias("n"))
    edges = pages.crossJoin(F.broadcast(n)).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))  # n is one row
    edges = edges.select(F.col("page_id").alias("src"), ((7 * F.col("page_id") + F.col("k")) % F.col("n")).alias("dst"))
    return crawl.bfs_frontier(edges, spark.range(1).select(F.col("id").alias("url")), 4)


@register("""WITH r AS (SELECT event_id, user_id, epoch_us(ts) / 1000000 AS arrive, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1000000, event_id) - 1 AS i FROM events)
 SELECT event_id, round(i * 3600 + max(arrive - i * 3600) OVER (PARTITION BY user_id ORDER BY i), 3)::DOUBLE AS start FROM r""")  # fmt: skip
def c9_rate_limit_schedule(spark, d):
    r = table(spark, d, "events").select("event_id", "user_id", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6).alias("arrive"))
    return crawl.rate_limit_schedule(r, 3600.0, "user_id").select("event_id", F.round("start", 3).alias("start"))


@register("""WITH e AS (SELECT user_id, event_id FROM events WHERE event_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
 n AS (SELECT user_id, event_id FROM events WHERE event_id % 5 <> 0 AND user_id NOT IN (SELECT user_id FROM e) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
 SELECT * FROM e UNION ALL SELECT * FROM n""")  # fmt: skip
def c10_insert_or_ignore(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    none = e.filter("event_id < 0")
    first = crawl.insert_or_ignore(none, e.filter("event_id % 5 = 0"), "user_id", "event_id")
    return crawl.insert_or_ignore(first, e.filter("event_id % 5 <> 0"), "user_id", "event_id")


@register("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def c11_insert_or_replace(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return crawl.insert_or_replace(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "event_id")


@register("SELECT user_id, event_id, value FROM events WHERE user_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def s8_registry_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return crawl.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), e.filter("user_id % 10 = 0"), "user_id", "event_id")


ASSETS = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'pdf' ELSE 'image' END AS kind, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars * 7 END AS bytes,
 64 + (n_chars * 31) % 900 AS width, 64 + (n_chars * 17) % 900 AS height, n_chars % 150 AS pages FROM documents"""


def _assets(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, "pdf").otherwise("image").alias("kind"), F.when(F.col("doc_id") % 11 != 0, n * 7).alias("bytes"),
        (64 + (n * 31) % 900).alias("width"), (64 + (n * 17) % 900).alias("height"), (n % 150).alias("pages"),
    )


@register(f"""SELECT doc_id, CASE WHEN bytes IS NULL THEN 'failed' WHEN kind = 'pdf' AND bytes < 10000 THEN 'failed' WHEN kind = 'pdf' AND pages < 1 THEN 'no_pages'
 WHEN kind <> 'pdf' AND bytes < 5000 THEN 'skip_small' WHEN kind <> 'pdf' AND least(width, height) < 200 THEN 'skip_small' ELSE 'saved' END AS status FROM ({ASSETS})""")  # fmt: skip
def c12_asset_status(spark, d):
    return crawl.asset_status(_assets(spark, d)).select("doc_id", "status")


@register("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 + 100 AS idx FROM documents WHERE n_chars % 3 > 0")
def c13_assign_index(spark, d):
    rows = table(spark, d, "documents").filter("n_chars % 3 > 0").select("doc_id")
    return crawl.assign_index(rows, "doc_id", 100, 100)


@register(f"SELECT doc_id, unnest(range(least(pages, 100)))::INT AS page, least(pages, 100)::INT AS pages_extracted FROM ({ASSETS}) WHERE pages > 0")
def c14_pdf_pages(spark, d):
    return crawl.pdf_pages(_assets(spark, d)).select("doc_id", "page", "pages_extracted")


@register("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality ELSE 9 END::INT AS paragraph_count FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)
 WHERE doc_id % 2 <> 0 OR quality >= 1""")  # fmt: skip
def c15_score_gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, -1).otherwise(9).alias("paragraph_count"))
    scores = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("score"))
    return crawl.score_gate(docs, scores, "doc_id", 1)


@register("SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id < 3) GROUP BY user_id")
def c16_skip_visited(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return crawl.skip_visited(e, e.filter("event_id < 3"), "user_id", "event_id")


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderdate, o_orderkey LIMIT 200")
def c17_take_budget(spark, d):
    return crawl.take_budget(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 200, "o_totalprice > 1000").select("o_orderkey", "o_totalprice")


@register("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def c18_crawl_counts(spark, d):
    return crawl.counts_by(table(spark, d, "events"), "event_type")


@register("SELECT url, 'crawl' AS source FROM pages UNION ALL SELECT text, 'google:' || item_id FROM benchmark")
def c19_union_sources(spark, d):
    hits = table(spark, d, "benchmark").select(F.col("text").alias("url"), F.col("item_id").cast("string").alias("query"))
    return crawl.union_sources(table(spark, d, "pages").select("url", F.lit("crawl").alias("source")), hits)


@register("SELECT page_id, printf('doc_%06d_%s.png', page_id, md5(url)[1:12]) AS name, 'documents/' || printf('doc_%06d_%s.png', page_id, md5(url)[1:12]) AS object_key FROM pages")
def s10_image_names(spark, d):
    return crawl.image_names(table(spark, d, "pages"), "page_id", "url").select("page_id", "name", "object_key")


@register("SELECT filename FROM (SELECT printf('f%09d', doc_id) AS filename, doc_id FROM documents) WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 ORDER BY filename LIMIT 100")
def w1_claim(spark, d):
    f = table(spark, d, "documents").select(F.format_string("f%09d", "doc_id").alias("filename"), "doc_id")
    return waves.claim(f.select("filename"), f.filter("doc_id % 3 = 0"), f.filter("doc_id % 5 = 0"), 100)


@register(f"""SELECT doc_id, CASE WHEN greatest(width, height) > 500 THEN trunc(width * (500.0::DOUBLE / greatest(width, height)))::BIGINT ELSE width END AS width,
 CASE WHEN greatest(width, height) > 500 THEN trunc(height * (500.0::DOUBLE / greatest(width, height)))::BIGINT ELSE height END AS height FROM ({ASSETS})""")  # fmt: skip
def w3_downscale_dims(spark, d):
    r = waves.downscale_dims(_assets(spark, d), 500)
    return r.select("doc_id", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"))


@register("""WITH RECURSIVE q AS (SELECT l_orderkey % 50 AS wave, l_orderkey * 10 + l_linenumber AS seq, l_quantity::BIGINT AS nbytes,
  row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey * 10 + l_linenumber, l_quantity) AS pos FROM lineitem),
 r AS (SELECT wave, pos, seq, 0::BIGINT AS chunk, 1 AS n, nbytes AS size FROM q WHERE pos = 1
  UNION ALL SELECT q.wave, q.pos, q.seq, chunk + (n >= 40 OR size + nbytes > 1000)::BIGINT, CASE WHEN n >= 40 OR size + nbytes > 1000 THEN 1 ELSE n + 1 END,
   CASE WHEN n >= 40 OR size + nbytes > 1000 THEN nbytes ELSE size + nbytes END FROM r JOIN q ON q.wave = r.wave AND q.pos = r.pos + 1)
 SELECT wave, seq, chunk FROM r""")
def w4_chunk_requests(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("wave"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").cast("bigint").alias("nbytes"))
    return waves.chunk_requests(li, 40, 1000)


@register("SELECT lang, doc_id, n_chars FROM documents WHERE n_chars > 100")
def w9_store_cascade(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return waves.store_cascade(docs.filter("n_chars < 0"), docs, docs.filter("n_chars > 100").select("doc_id"), ["doc_id"], ["lang", "doc_id", "n_chars"])


@register("WITH b AS (SELECT o_orderkey // 100 AS wave, CASE WHEN o_orderkey // 100 < 7 THEN 'completed' ELSE 'open' END AS status FROM orders) SELECT max(wave) FILTER (status = 'completed') AS last_wave, max(wave) FILTER (status = 'completed') + 1 AS next_wave FROM b")
def w10_last_completed_wave(spark, d):
    b = table(spark, d, "orders").select(F.expr("o_orderkey div 100").alias("wave"))
    return waves.last_completed_wave(b.withColumn("status", F.when(F.col("wave") < 7, "completed").otherwise("open")))


@register("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'error: timeout' WHEN n_chars < 100 THEN 'empty' ELSE 'annotated' END AS status FROM documents WHERE doc_id % 4 <> 0")
def w11_assembly_status(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "timeout").alias("error"), F.when(F.col("n_chars") < 100, 1).otherwise(9).alias("nodes"))
    return waves.assembly_status(docs, docs.filter("doc_id % 4 = 0")).select("doc_id", "status")


@register("""WITH b AS (SELECT CASE WHEN o_orderkey % 7 < 3 OR o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'submitted' ELSE 'failed' END AS status, o_orderkey % 7 AS wave, (o_custkey % 5) * 3600 AS took FROM orders)
 SELECT 'claimed' AS item, 'all' AS status, count(*) AS n, NULL::BIGINT AS seconds FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'cascade', 'all', count(*), NULL FROM lineitem
 UNION ALL SELECT 'batches', status, count(*), sum(took)::BIGINT FROM b GROUP BY status UNION ALL SELECT 'files', event_type, count(*), NULL FROM events GROUP BY event_type
 UNION ALL SELECT 'last wave', 'all', coalesce(max(wave), -1), NULL FROM (SELECT wave FROM b GROUP BY wave HAVING bool_and(status = 'completed'))""")  # fmt: skip
def w12_status_report(spark, d):
    status = F.when((F.col("o_orderkey") % 7 < 3) | (F.col("o_orderstatus") == "F"), "completed").when(F.col("o_orderstatus") == "O", "submitted").otherwise("failed")
    done = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_custkey") % 5) * 3600)
    batches = table(spark, d, "orders").select(status.alias("status"), (F.col("o_orderkey") % 7).alias("wave"), F.col("o_orderdate").alias("created"), done.alias("completed"))
    claims = table(spark, d, "documents").filter("doc_id % 3 = 0")
    return waves.status_report(claims, table(spark, d, "lineitem"), batches, table(spark, d, "events").withColumnRenamed("event_type", "status"))


@register("SELECT user_id % 5 AS wave, count(*) FILTER (value >= 20) AS stored, count(*) FILTER (value < 20) AS errors FROM events GROUP BY ALL")
def w13_wave_stats(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("wave"), (F.col("value") >= 20).alias("usable"))
    return waves.wave_stats(e)


@register("""SELECT role, count(*) AS calls, sum(length(text))::BIGINT AS prompt, sum(length(text) // 3)::BIGINT AS completion, (sum(length(text)) + sum(length(text) // 3))::BIGINT AS total,
 round(sum(length(text)) * 2.5 / 1e6 + sum(length(text) // 3) * 10.0 / 1e6, 6)::DOUBLE AS cost FROM conversations GROUP BY role""")  # fmt: skip
def w14_usage_rollup(spark, d):
    n = F.length("text").cast("bigint")
    return waves.usage_rollup(table(spark, d, "conversations").select("role", n.alias("prompt"), F.floor(n / 3).alias("completion")), "role")


@register("""WITH p AS (SELECT o_orderkey, o_orderpriority, sum(o_totalprice) OVER (ORDER BY o_orderpriority, o_orderkey) AS run FROM orders)
 SELECT o_orderpriority, count(*) AS pages FROM p WHERE run <= 20000000 GROUP BY o_orderpriority""")  # fmt: skip
def w16_budget_projection(spark, d):
    return waves.budget_projection(table(spark, d, "orders"), ["o_orderkey"], ["o_orderpriority", "o_orderkey"], "o_totalprice", 20_000_000.0, "o_orderpriority")


@register("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS messages FROM conversations GROUP BY conv_id")
def w19_message_table(spark, d):
    return waves.message_table(table(spark, d, "conversations")).withColumn("messages", F.array_join("messages", "\n"))


EPOCHS = "ep AS (SELECT user_id % 5 AS run, dayofmonth(ts)::INT AS epoch, sum(value * (1 + event_id % 3)) / sum(1 + event_id % 3) AS loss FROM events GROUP BY ALL)"


def _epochs(spark, d):
    e = table(spark, d, "events")
    return metrics.epoch_means(e.select((F.col("user_id") % 5).alias("run"), F.dayofmonth("ts").alias("epoch"), F.col("value").alias("loss"), (1 + F.col("event_id") % 3).alias("n")))


@register(f"WITH {EPOCHS} SELECT run, epoch, round(loss, 5) AS loss FROM ep")
def m1_epoch_means(spark, d):
    return _epochs(spark, d).withColumn("loss", F.round("loss", 5))


@register(f"""WITH {EPOCHS}, b AS (SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM ep),
 g AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run ORDER BY epoch) AS g FROM b), s AS (SELECT *, (row_number() OVER (PARTITION BY run, g ORDER BY epoch) - 1)::INT AS since FROM g)
 SELECT run, epoch, improved, since, max((since >= 5)::INT) OVER (PARTITION BY run ORDER BY epoch) = 1 AS stopped FROM s""")  # fmt: skip
def m2_early_stop(spark, d):
    return metrics.early_stop(_epochs(spark, d), 5).select("run", "epoch", "improved", "since", "stopped")


LOGS = f"""{EPOCHS}, b AS (SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM ep)"""


def _logs(spark, d):
    e = metrics.early_stop(_epochs(spark, d), 5)
    line = F.format_string("epoch %d train=0.0 val=%.4f", F.col("epoch"), F.col("loss"))
    rows = e.withColumn("line", F.explode(F.when(F.col("improved"), F.array(line, F.lit("  saved best model"))).otherwise(F.array(line))))
    return rows.select(F.concat(F.lit("run"), "run").alias("file"), (2 * F.col("epoch") + F.col("line").contains("saved").cast("int")).alias("line_no"), "line")


@register(f"WITH {LOGS} SELECT 'run' || run AS file, round(arg_max(loss, epoch) FILTER (improved), 3) AS best FROM b GROUP BY run")
def m3_parse_training_log(spark, d):
    return metrics.parse_training_log(_logs(spark, d)).withColumn("best", F.round("best", 3))


@register(f"WITH {LOGS} SELECT 'run' || run AS file, arg_max(loss, epoch) FILTER (improved) < 45 AS passed FROM b GROUP BY run")
def m4_gate(spark, d):
    return metrics.gate(metrics.parse_training_log(_logs(spark, d)), 45.0).select("file", "passed")


@register("""WITH j AS (SELECT t.l_linenumber AS level, t.l_partkey % 4 AS c, t.l_suppkey % 2 AS flag, (p.l_quantity * (1 + p.l_discount) - t.l_quantity) / 1024 AS ex,
 (p.l_tax + p.l_discount - t.l_tax) / 1024 AS ey, p.l_discount * 10 - 0.5 AS z FROM lineitem t JOIN lineitem p ON t.l_orderkey = p.l_orderkey AND t.l_linenumber = p.l_linenumber)
 SELECT level, round(avg((0.5 * ex ** 2 + 0.5 * ey ** 2) / 2) FILTER (c <> 0), 9) AS point_loss, 0.0::DOUBLE AS orientation_loss,
 round(avg(greatest(z, 0) - z * flag + ln(1 + exp(-abs(z)))) FILTER (c <> 0), 6) AS handwritten_loss, count(*) FILTER (c <> 0) AS n FROM j GROUP BY level""")  # fmt: skip
def m10_evaluate(spark, d):
    """Also M5, M6 and M8."""
    li = table(spark, d, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    one, zero = F.lit(1.0), F.lit(0.0)
    t = li.select(*key, F.col("l_linenumber").alias("level"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"), one.alias("dx"), zero.alias("dy"), (F.col("l_suppkey") % 2).alias("flag"), (F.col("l_partkey") % 4).alias("class_id"))
    p = li.select(*key, (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("x"), (F.col("l_tax") + F.col("l_discount")).alias("y"), one.alias("dx"), zero.alias("dy"), (F.col("l_discount") * 10 - 0.5).alias("logit"))
    out = metrics.evaluate(p, t, key)
    return out.select("level", F.round("point_loss", 9).alias("point_loss"), "orientation_loss", F.round("handwritten_loss", 6).alias("handwritten_loss"), "n")


@register("""SELECT vec_id, round(0.9 * (ln(list_sum(list_transform(embedding, lambda z: exp(z::DOUBLE)))) - embedding[label % 64 + 1]::DOUBLE)
 + 0.1 * (ln(list_sum(list_transform(embedding, lambda z: exp(z::DOUBLE)))) - list_sum(list_transform(embedding, lambda z: z::DOUBLE)) / len(embedding)), 5) AS loss FROM embeddings""")  # fmt: skip
def m7_class_loss(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("logits"), (F.col("label") % 64).alias("target"))
    return metrics.class_loss(e, 0.1).select("vec_id", F.round("loss", 5).alias("loss"))


@register("""WITH c AS (SELECT doc_id, (n_chars % 97)::DOUBLE AS a, doc_id % 2 = 0 AS even FROM documents),
 p AS (SELECT doc_id, [0, a, a, CASE WHEN even THEN 0 ELSE 200 END, a / 2, a / 3][k + 1] AS x, [0, 0, 50, CASE WHEN even THEN 50 ELSE -50 END, 25, -9][k + 1] AS y, k FROM c, (SELECT unnest(range(6)) AS k)),
 s AS (SELECT a.doc_id, a.k AS i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.k = a.k + 1),
 q AS (SELECT s.doc_id, (t.bx - t.ax) * (s.ay - t.ay) - (t.by - t.ay) * (s.ax - t.ax) AS d1, (t.bx - t.ax) * (s.by - t.ay) - (t.by - t.ay) * (s.bx - t.ax) AS d2,
  (s.bx - s.ax) * (t.ay - s.ay) - (s.by - s.ay) * (t.ax - s.ax) AS d3, (s.bx - s.ax) * (t.by - s.ay) - (s.by - s.ay) * (t.bx - s.ax) AS d4
  FROM s JOIN s t ON s.doc_id = t.doc_id AND t.i >= s.i + 2 AND NOT (s.i = 0 AND t.i = 4))
 SELECT doc_id, round(avg(1 / (1 + exp(least(700, greatest(-700, d1 * d2 * 0.01)))) / (1 + exp(least(700, greatest(-700, d3 * d4 * 0.01))))), 7)::DOUBLE AS score FROM q GROUP BY doc_id""")
def m9_self_intersection(spark, d):
    """Open contours of six points and growing size, some of them crossed."""
    pts = "array(struct(0D AS x, 0D AS y), struct(cast(n_chars % 97 AS double) AS x, 0D AS y), struct(cast(n_chars % 97 AS double) AS x, 50D AS y), struct(if(doc_id % 2 = 0, 0D, 200D) AS x, if(doc_id % 2 = 0, 50D, -50D) AS y), struct(n_chars % 97 / 2D AS x, 25D AS y), struct(n_chars % 97 / 3D AS x, -9D AS y))"
    return metrics.self_intersection(table(spark, d, "documents").select("doc_id", F.expr(pts).alias("contour")), "doc_id").withColumn("score", F.round("score", 7))


def _pixels(spark, d):
    """Images of 16 x 12 pixels, one per document: a background by id, a rectangle of ink. Dealt by image, so that no pixel moves."""
    docs = dealt(table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), "n_chars"), "image_id")
    docs = docs.withColumns({"width": F.lit(16), "height": F.lit(12)})
    p = docs.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(11))))
    ink = F.expr("x between 4 and 4 + n_chars % 8 and y between 3 and 3 + n_chars % 6")
    base = (200 + F.col("image_id") % 50).cast("int")
    return p.withColumns({c: F.when(ink, 10 + k).otherwise(base - k) for k, c in enumerate("rgb")})


@register("SELECT doc_id AS image_id, (200 + doc_id % 50)::INT AS r, (199 + doc_id % 50)::INT AS g, (198 + doc_id % 50)::INT AS b FROM documents")
def g17_background_color(spark, d):
    return geometry.background_color(_pixels(spark, d), 1)


@register("SELECT doc_id AS image_id, ((n_chars % 8 + 1) * (n_chars % 6 + 1))::BIGINT AS n FROM documents")
def g18_content_mask(spark, d):
    p = _pixels(spark, d)
    return geometry.content_mask(p, geometry.background_color(p, 1)).groupBy("image_id").agg(F.count("*").alias("n"))


@register()
def g14_region_contours(spark, d):
    """Rectangles of ink; thin ones are simplified to their diagonal, to which midpoints are added, and lines have none."""
    p = _pixels(spark, d)
    ink = geometry.content_mask(p, geometry.background_color(p, 1)).withColumnRenamed("image_id", "region")
    return geometry.region_contours(ink)
