"""Links of captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extensions of what is fetched as an image and of what is never fetched.
IMAGES = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif")
SKIPPED = (
    "zip", "gz", "tar", "rar", "7z", "bz2", "xz",
    "mp3", "mp4", "avi", "mov", "wmv", "flac", "ogg",
    "exe", "dmg", "iso", "msi", "deb", "rpm",
    "css", "js", "woff", "woff2", "ttf", "otf", "eot",
    "svg", "ico",
)
#: What a page's links are not looked for in.
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
#: Tags that may hold a link; a quoted attribute may hold a ``>``. Nothing is tried twice, so a tag may be of any length.
TAGS = r"""(?is)<(?:img|source|meta|a)\s(?:"[^"]*+"|'[^']*+'|[^'">]++)*+>"""
#: Name and value (one of three groups, by the quotes) of each attribute of a tag, one after the other.
ATTRIBUTES = r"""([^\s"'>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))"""
#: What scripts hold as URLs.
URLS = r"""https?://[^\s"'\\<>()]++"""


def _attributes() -> Column:
    """The attributes of ``tag`` in order: ``name`` (lower case) and ``value``."""
    names = F.transform(F.regexp_extract_all("tag", F.lit(ATTRIBUTES), 1), F.lower)
    values = [F.regexp_extract_all("tag", F.lit(ATTRIBUTES), k) for k in (2, 3, 4)]
    whole = F.transform(F.arrays_zip(*[v.alias(f"v{k}") for k, v in enumerate(values)]), lambda v: F.concat(v["v0"], v["v1"], v["v2"]))
    return F.arrays_zip(names.alias("name"), whole.alias("value"))


def _value(name: str) -> Column:
    """The value of the first attribute of that name in ``attributes``, null where it is missing or empty."""
    found = F.nullif(F.get(F.filter("attributes", lambda a: a["name"] == name), F.lit(0))["value"], F.lit(""))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        found = F.replace(found, F.lit(entity), F.lit(char))
    return found


def extract_links(pages: DataFrame) -> DataFrame:
    """``page_id, url, kind, raw_url, ordinal``: each target once per page and kind, at its first tag's place.

    Images are those of ``img`` (src, else data-src, else data-original), of each part of a ``source``'s srcset, and of
    the ``meta`` og:image and twitter:image; pages those of ``a href``. Values may be quoted in either way or not at
    all. Comments, scripts and styles hold no links; a null ``html`` has none.
    """
    tags = F.regexp_extract_all(F.regexp_replace("html", UNSEEN, ""), F.lit(TAGS), 0)
    rows = pages.select("page_id", "url", F.posexplode(tags).alias("ordinal", "tag")).withColumn("attributes", _attributes())
    name = F.lower(F.regexp_extract("tag", r"^<([a-zA-Z]+)", 1))
    parts = F.transform(F.split(_value("srcset"), ","), lambda x: F.regexp_extract(x, r"^\s*(\S*)", 1))
    shown = F.coalesce(_value("property"), _value("name")).isin("og:image", "twitter:image")
    found = (
        F.when(name == "a", F.array(_value("href")))
        .when(name == "img", F.array(F.coalesce(_value("src"), _value("data-src"), _value("data-original"))))
        .when(name == "source", parts)
        .when(shown, F.array(_value("content")))
    )
    kind = F.when(name == "a", "page").otherwise("image")
    rows = rows.select("page_id", "url", kind.alias("kind"), "ordinal", F.explode(found).alias("raw_url"))
    return rows.filter("raw_url <> ''").groupBy("page_id", "url", "kind", "raw_url").agg(F.min("ordinal").alias("ordinal"))


def _without_dots(path: Column) -> Column:
    """A path from the root without ``.`` and ``..`` segments, however many."""
    segments = F.split(path, "/")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    joined = F.array_join(ended, "/")
    return F.when(joined == "", "/").otherwise(joined)


def resolve_links(links: DataFrame) -> DataFrame:
    """``target``: the raw link made absolute against its page (absolute, ``//host``, ``/path``, ``?``, ``#``, relative)."""
    raw, url = F.trim("raw_url"), F.col("url")
    scheme, host = F.regexp_extract(url, r"^([a-z]+:)//", 1), F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1)
    bare, full = F.regexp_extract(url, r"^([^#]*)", 1), F.regexp_extract(url, r"^([^?#]*)", 1)
    folder = F.regexp_extract(url, r"^[a-z]+://[^/?#]*(/(?:[^?#]*/)?)", 1)
    path, tail = F.regexp_extract(raw, r"^([^?#]*)", 1), F.regexp_extract(raw, r"^[^?#]*(.*)$", 1)
    beside = F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), path), "/{2,}", "/")
    return links.withColumn(
        "target",
        F.when(raw.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(scheme, raw))
        .when(raw.startswith("/"), F.concat(host, _without_dots(path), tail))
        .when(raw.startswith("#"), F.concat(bare, raw))
        .when(raw.startswith("?"), F.concat(full, raw))
        .when(raw == "", bare)
        .otherwise(F.concat(host, _without_dots(beside), tail)),
    )


def extension(url: str) -> Column:
    """The lower-case extension of the path of a URL in column ``url``, empty if none."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def classify_links(resolved: DataFrame) -> DataFrame:
    """http(s) targets with ``class`` pdf, image, skip or page by the path's extension; page targets lose the fragment."""
    ext = extension("target")
    kind = F.when(ext == "pdf", "pdf").when(ext.isin(*IMAGES), "image").when(ext.isin(*SKIPPED), "skip").otherwise("page")
    rows = resolved.filter(F.col("target").rlike("^https?://")).withColumn("class", kind)
    return rows.withColumn("target", F.when(F.col("class") == "page", F.regexp_replace("target", "#.*$", "")).otherwise(F.col("target")))


def host(url: str):
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def same_domain(rows: DataFrame) -> DataFrame:
    """Targets whose host and port are those of the page that was asked for."""
    return rows.filter(host("url") == host("target"))


def _script_urls(pages: DataFrame) -> DataFrame:
    scripts = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*+>(.*?)</script"), 1), "\n")
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(scripts, F.lit(URLS), 0)).alias("at", "link"))
    return rows.filter(extension("link").isin(*IMAGES) & ~F.col("link").rlike("google|gstatic"))


def _first_ones(rows: DataFrame, first: int) -> DataFrame:
    rows = rows.groupBy("page_id", "link").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("at"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= first).select("page_id", "link", "rank")


def script_urls(pages: DataFrame, first: int = 10) -> DataFrame:
    """The first distinct image URLs (by extension) inside script text of each page, in order; those of ``google`` and ``gstatic`` not."""
    return _first_ones(_script_urls(pages), first)


def search_images(pages: DataFrame, first: int = 100) -> DataFrame:
    """``page_id, link, rank``: what a search page shows: the ``img`` tags' absolute sources (src, else data-src) that are not
    ``google``'s, whatever their extension, then its ``script_urls``; each once, at most ``first`` a page."""
    tags = F.regexp_extract_all(F.regexp_replace("html", UNSEEN, ""), F.lit(TAGS), 0)
    images = pages.select("page_id", F.posexplode(tags).alias("at", "tag")).filter(F.col("tag").rlike(r"(?i)^<img\s")).withColumn("attributes", _attributes())
    shown = images.select("page_id", F.struct(F.lit(0).alias("kind"), "at").alias("at"), F.coalesce(_value("src"), _value("data-src")).alias("link"))
    shown = shown.filter(F.col("link").startswith("http") & ~F.contains("link", F.lit("google")))
    told = _script_urls(pages).select("page_id", F.struct(F.lit(1).alias("kind"), "at").alias("at"), "link")
    return _first_ones(shown.unionByName(told), first)
