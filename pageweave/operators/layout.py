"""Text to page geometry: paragraphs of five lines, a fixed advance, boxes half-open on the right and below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADVANCE, LINE_HEIGHT, MARGIN, WIDTH, PARAGRAPH = 12, 28, 40, 2048, 5
FIT = (WIDTH - 2 * MARGIN) // ADVANCE


#: Pieces of a line: as much as fits up to a space or the end, or a whole width of a word that is longer.
PIECES = f"[^\\n]{{1,{FIT}}}( |\\z)|[^\\n]{{1,{FIT}}}"


def _beside(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def _wrapped(docs: DataFrame) -> DataFrame:
    """``doc_id, n, line`` and columns beside ``text``: what stands in each line of the page, spaces and empty lines as they are."""
    wrapped = F.transform(F.split("text", "\n", -1), lambda x: F.when(F.length(x) <= FIT, F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(PIECES), 0)))
    return docs.select(*_beside(docs), F.posexplode(F.flatten(wrapped)).alias("n", "line"))


def _place(n: str) -> tuple[Column, Column]:
    return F.expr(f"cast({n} div {PARAGRAPH} as int)").alias("pi"), (F.col(n) % PARAGRAPH).alias("li")


def layout_words(docs: DataFrame) -> DataFrame:
    """``doc_id, pi, li, wi, text, x1, y1, x2, y2``: words parted by spaces, every one of the text. Other columns of ``docs`` stay.

    A line too wide goes on in a further line after its last space that fits; a word wider than a line is parted at
    the width. Empty lines take their place; null texts have no words.
    """
    kept = _beside(docs)
    pieces = _wrapped(docs).select(*kept, "n", "line", F.split("line", " ", -1).alias("p"))
    pieces = pieces.select(*kept, "n", "line", F.array_position("p", F.lit("")).alias("gap"), "p")
    words = pieces.select(*kept, "n", "line", "gap", F.posexplode("p").alias("k", "text")).filter("text <> ''")
    x1 = F.expr(f"{MARGIN} + {ADVANCE} * (length(substring_index(line, ' ', k)) + if(k > 0, 1, 0))")
    y1 = MARGIN + LINE_HEIGHT * F.col("n")
    return words.select(
        *kept,
        *_place("n"),
        # pieces before the line's first gap are all words
        F.expr("if(gap = 0 or k < gap, k, size(array_remove(split(substring_index(line, ' ', k), ' ', -1), '')))").alias("wi"),
        "text",
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + ADVANCE * F.length("text")).alias("x2"),
        (y1 + LINE_HEIGHT).alias("y2"),
    )


def layout_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, pi, li, x1, y1, x2, y2``: the box that the words of each line of ``layout_words`` span, without making them.

    Documents of one id have their lines side by side, as their words.
    """
    y1 = MARGIN + LINE_HEIGHT * F.col("n")
    left = F.length("line") - F.length(F.ltrim("line"))
    return _wrapped(docs).filter(F.ltrim("line") != "").select(
        *_beside(docs), *_place("n"), (MARGIN + ADVANCE * left).alias("x1"), y1.alias("y1"),
        (MARGIN + ADVANCE * F.length(F.rtrim("line"))).alias("x2"), (y1 + LINE_HEIGHT).alias("y2"),
    )


def layout_chars(words: DataFrame) -> DataFrame:
    """One row per character of ``words``, each with the box of its advance."""
    at = words.withColumn("ci", F.explode(F.expr("sequence(0, length(text) - 1)")))
    left = F.col("x1") + ADVANCE * F.col("ci")
    return at.select(
        "doc_id", "pi", "li", "wi", "ci", F.expr("substring(text, ci + 1, 1)").alias("ch"),
        left.alias("x1"), "y1", (left + ADVANCE).alias("x2"), "y2",
    )


def rollup_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Parent box: the extremes of the children that share ``keys``."""
    return boxes.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def hierarchy_counts(words: DataFrame) -> DataFrame:
    """``doc_id, paragraphs, lines, words, chars`` and the page box; one shuffle, on the document."""
    per_line = words.groupBy("doc_id", "pi", "li").agg(
        F.count("*").alias("w"), F.sum(F.length("text")).alias("c"), *[f("{}".format(n)).alias(n) for f, n in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))]
    )
    return per_line.groupBy("doc_id").agg(
        F.count_distinct("pi").alias("paragraphs"), F.count("*").alias("lines"), F.sum("w").alias("words"), F.sum("c").alias("chars"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )
