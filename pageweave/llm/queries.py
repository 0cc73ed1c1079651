"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageweave.llm import bpe, conversations, divergence, grammar, html_text, language, lines, packing, quality, scoring, simhash, suffixes, tiff


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file, from the installed package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text by ranks."""
    import public_tokenizers

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    ids = bpe.encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return bpe.decoded_digests(ids, path)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by a mixture fitted on the rows whose id's checksum is not held out; see ``language.predict`` for nulls and ties."""
    docs = _documents(spark, sf_dir)
    return language.predict(docs, language.fit(docs))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every text; see ``quality.clean_lines``."""
    return quality.clean_lines(_documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as TIFF pages, read back, with digests and a feature; a null text is empty, repeated rows give equal files."""
    return tiff.page_features(tiff.pages(tiff.store_texts(_documents(spark, sf_dir))))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every text under a network trained on all of them; see ``scoring.fit_and_score``."""
    return scoring.fit_and_score(_documents(spark, sf_dir))


def op6_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text; wordless ones link like any other."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op7_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more of all texts; see ``suffixes.spans``."""
    return suffixes.spans(_documents(spark, sf_dir))


def op8_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of at most 4096 ids; a null text is its end id alone."""
    return packing.pack(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op9_levelled_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and dropped, and the digest of what stays, of every text. Needs numeric ids; see ``lines.drop_frequent_lines``."""
    out = lines.drop_frequent_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_grammar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of every text's ids as read back from the compressed files. Needs numeric ids; a null text is its end id alone."""
    return grammar.id_checksums(grammar.stored_ids(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json")))


def op11_prefix_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations with what their subtrees hold and save."""
    return conversations.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op13_source_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each language, and the terms that set a source apart."""
    return divergence.divergences(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_byte_bpe,
            op2_language_mixture,
            op3_line_quality,
            op4_tiff_pages,
            op5_pseudo_likelihood,
            op6_simhash_anchors,
            op7_sparse_suffixes,
            op8_shortest_pack_first,
            op9_levelled_line_runs,
            op10_grammar_ids,
            op11_prefix_tour,
            op12_line_blocks,
            op13_source_stripes,
        )
    }


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def oracle_sql() -> dict[str, str]:
    return {
        "op9_levelled_line_runs": f"""
            WITH l AS (
              SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
              FROM documents),
            k AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
            f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
            m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
            FROM m GROUP BY doc_id""",
            "op11_prefix_tour": """
            WITH o AS (
              SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
              FROM conversations WHERE conv_id IS NOT NULL),
            n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
            c AS (
              SELECT conv_id, n, conv_id - conv_id % 100 AS first,
                     xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
                       lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 6 AS h
              FROM n),
            t AS (SELECT c.*, least(h, coalesce(f.n, 0)) AS took FROM c LEFT JOIN n f ON f.conv_id = c.first),
            r AS (SELECT o.conv_id, pos - h + took AS pos, role, text FROM o JOIN t USING (conv_id) WHERE pos > h
                  UNION ALL SELECT t.conv_id, pos, role, text FROM t JOIN o ON o.conv_id = t.first WHERE pos <= took),
            p AS (SELECT conv_id, pos AS depth, length(text) AS chars, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r
                  UNION ALL SELECT conv_id, 0, 0, [] FROM n),
            e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
            nd AS (SELECT min(p.conv_id) AS conv_id, p.depth, path, count(*) AS n_convs, min(chars) AS chars,
                     sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (e.depth = p.depth), '')) AS ends_sha256
                   FROM p JOIN e USING (conv_id) GROUP BY p.depth, path),
            up AS (SELECT nd.*, u.conv_id AS parent_conv_id FROM nd LEFT JOIN nd u ON u.depth = nd.depth - 1 AND u.path = nd.path[:len(nd.path) - 1]),
            k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
            a AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN k USING (conv_id, depth))
            SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves,
                   sum((b.n_convs - 1) * b.chars)::BIGINT AS saved_tokens, a.ends_sha256
            FROM a JOIN a b ON b.depth >= a.depth AND b.path[:a.depth] = a.path
            GROUP BY a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256""",
        "op13_source_stripes": r"""
            WITH d AS (
              SELECT row_number() OVER () AS doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
              FROM documents),
            w AS (SELECT doc_id, lang, source, translate(unnest(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
            c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY ALL),
            k AS (SELECT lang, term FROM c GROUP BY ALL HAVING sum(docs) >= 10),
            v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
            g AS (SELECT DISTINCT lang, source FROM d),
            f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::BIGINT AS n
                  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
            s AS (SELECT lang, source, term, n,
                         1 + 1000000000 * (n + 2) // ((sum(n) OVER (PARTITION BY lang, source))::BIGINT + 2 * v) AS p,
                         1 + 1000000000 * ((sum(n) OVER (PARTITION BY lang, term))::BIGINT + 2) // ((sum(n) OVER (PARTITION BY lang))::BIGINT + 2 * v) AS q
                  FROM f JOIN v USING (lang)),
            pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
                     FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
                     UNION ALL
                     SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                     WHERE a.lang NOT IN (SELECT lang FROM v)),
            term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM s WHERE n > 0 AND p > q),
            r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
                  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
            SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10""",
    }
