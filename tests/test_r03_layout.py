"""Findings F29, F34, F35, F38, F40: lines are measured without their words, words are laid out once and stay where they are."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pageweave.operators import geometry, layout
from pageweave.plans import registry

KEYS = ["doc_id", "pi", "li"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(5)
    texts = [None, "", " ", "\n\n", "a" * 164, "a" * 165, "a" * 164 + " b", "  x  y   z  ", "\U0001f600" * 170 + " k", "a " * 82, " " * 400, "ab\r\n\tc d", "é" * 164 + "\n"]
    for _ in range(200):
        texts.append("".join(r.choice([" ", " ", "a", "bb", "\n", "é", "\U0001f600", "\t", "longer" * r.randrange(1, 40)]) for _ in range(r.randrange(1, 200))))
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, "  twice the  id\nx"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_lines_are_their_words_boxes(odd):
    want = layout.rollup_boxes(layout.layout_words(odd), KEYS)
    got = layout.rollup_boxes(layout.layout_lines(odd), KEYS)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_words_are_counted_past_gaps(odd):
    rows = layout.layout_words(odd.filter("doc_id <> 7")).groupBy(*KEYS).agg(F.sort_array(F.collect_list("wi")).alias("w"), F.sort_array(F.collect_list(F.struct("wi", "x1"))).alias("x")).collect()
    assert len(rows) > 100
    for r in rows:
        assert r["w"] == list(range(len(r["w"])))
        assert [v["x1"] for v in r["x"]] == sorted({v["x1"] for v in r["x"]})


def test_columns_beside_the_text_stay(spark):
    docs = spark.createDataFrame([(1, 9, "a b")], "doc_id long, batch long, text string")
    assert {r["batch"] for r in layout.layout_words(docs).collect() + layout.layout_lines(docs).collect()} == {9}


@pytest.mark.parametrize("name", ["t5_pad_batch", "t4_t5_t13_vectors", "g2_contours_to_retina"])
def test_words_are_not_moved_by_joins_or_batches(spark, sf, name):
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = plan(registry.queries()[name](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "Exchange" in got and all("REPARTITION_BY_NUM" in line for line in got.splitlines() if "Exchange" in line)


def test_requests_lay_words_out_once(spark, sf):
    assert plan(registry.queries()["w2_request_bodies"](spark, sf)).count("posexplode(p") == 1


def test_contours_of_told_length(spark):
    rows = spark.createDataFrame([(1, 2, 30, 40, 2.5, 3, 4), (-7, 0, 5, 9, 0.1, -1, 0)], "x1 int, y1 int, x2 int, y2 int, scale double, ox int, oy int")
    c = rows.withColumn("contour", geometry.corners("x1", "y1", "x2", "y2"))
    assert geometry.contours_to_retina(c, 4).collect() == geometry.contours_to_retina(c).collect()
