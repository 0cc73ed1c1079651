"""Findings of round 4 on trees: each test failed before its fix."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pageweave.functions import whole
from pageweave.operators import hierarchy, layout
from pageweave.plans import registry


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


DOCS = [
    (1, "one  two\nthree\n\n\n\nfour fíve 三 \U0001f600x"),
    (1, "ab d\nthr\n\nx"),  # the same id again: places meet
    (2, ""), (3, None), (None, "no id"), (4, " \n "), (5, "w" * 400 + " b"), (6, "x y"),
]


@pytest.mark.parametrize(("held", "words"), [(1 << 17, 1 << 15), (3, 2)])
def test_f1_letters_are_flattened_where_they_are_made(spark, sf, monkeypatch, held, words):
    monkeypatch.setattr(whole, "ROWS", held)
    monkeypatch.setattr(hierarchy, "WORDS", words)
    laid = layout.layout_words(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(2))
    assert _rows(hierarchy.flatten_letters(laid)) == _rows(hierarchy.flatten(layout.layout_chars(laid)))
    listed = hierarchy.flattened_letters(laid)
    assert _rows(listed.select("doc_id", F.inline("nodes"))) == _rows(hierarchy.flatten_letters(laid)) and listed.count() == 4
    assert [[n["id"] for n in r["nodes"]] for r in listed.collect()] == [list(range(len(r["nodes"]))) for r in listed.collect()]
    assert hierarchy.flatten_letters(laid.limit(0)).count() == 0
    assert _plan(registry.queries()["h3_flatten_characters"](spark, sf)).count("Window [") == 1


FLAT = "doc_id string, pi int, li int, wi int, type string, id long, text string, is_handwritten boolean, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("name", ["h4_h5_whole_tree", "s4_mask_paths"])
def test_f2_f3_trees_are_nested_in_one_pass(spark, sf, name):
    plan = _plan(registry.queries()[name](spark, sf))
    assert "Aggregate" not in plan and plan.count("Window [") == 1


@pytest.mark.parametrize("held", [1 << 17, 1])
def test_f2_f3_rows_without_a_place_or_kind(spark, monkeypatch, held):
    monkeypatch.setattr(whole, "ROWS", held)
    box = (1.5, 2.0, 3.0, 4.0)
    rows = [
        ("a", None, None, None, "page", None, None, None, *box), ("a", None, None, None, "page", 3, None, None, 0.0, 0.0, None, 9.0),
        ("a", 1, None, None, "paragraph", None, None, True, *box), ("a", 1, 0, None, "line", 1, None, None, *box),
        ("a", 1, 0, None, "word", 2, None, None, *box), ("a", 1, 0, None, "character", 3, "x", None, *box),  # a word without a place
        ("a", 1, 0, 4, "word", 5, None, None, *box), ("a", 1, 0, 4, "character", 9, None, None, *box), ("a", 1, 0, 4, "character", None, "n", None, *box),
        ("a", 1, None, None, "line", 6, None, None, *box), ("a", 1, None, 0, "word", 7, None, None, *box),  # a line without a place
        ("a", 1, 0, 4, "stamp", 8, "s", None, *box), ("a", 1, 0, 4, None, 8, "s", None, *box),
        ("b", 0, 0, 0, "stamp", 0, None, None, *box),
        (None, None, None, None, "page", 0, None, None, *box), (None, 0, None, None, "paragraph", 0, None, None, *box),
    ]
    flat = spark.createDataFrame(rows, FLAT)
    ordered = flat.coalesce(1).sortWithinPartitions("doc_id", "pi", "li", "wi", "id", "x1")
    assert sorted(map(repr, hierarchy.nest_tree(ordered, True).collect())) == sorted(map(repr, hierarchy.nest_tree(flat).collect()))
    got = {r["doc_id"]: r.asDict(True) for r in hierarchy.nest_tree(spark.createDataFrame(rows, FLAT).repartition(3)).collect()}
    own = dict(zip(("x1", "y1", "x2", "y2"), box))
    words = [{"box": own, "characters": []}, {"box": own, "characters": [{"box": own, "char": "n"}, {"box": own, "char": None}]}]
    lines = [{"box": own, "words": []}, {"box": own, "words": words}]
    assert got == {
        "a": {"doc_id": "a", "page_region": {"x1": 0.0, "y1": 0.0, "x2": None, "y2": 9.0}, "paragraphs": [{"box": own, "is_handwritten": True, "lines": lines}]},
        "b": {"doc_id": "b", "page_region": None, "paragraphs": []},
        None: {"doc_id": None, "page_region": None, "paragraphs": []},
    }
