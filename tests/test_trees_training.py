from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageweave.functions.store import exists
from pageweave.operators import detect, hierarchy, training, waves

FLAT = "doc_id long, pi int, li int, wi int, type string, id int, text string, is_handwritten boolean, x1 int, y1 int, x2 int, y2 int"


def test_tree_with_orphans_empty_parents_and_repeated_rows(spark):
    box = (1, 2, 3, 4)
    rows = [
        (1, None, None, None, "page", 0, None, None, *box),
        (1, 5, None, None, "paragraph", 1, None, True, *box),
        (1, 2, None, None, "paragraph", 2, None, None, *box),
        (1, 2, None, None, "paragraph", 9, None, False, 9, 9, 9, 9),  # the same place again: the last stands
        (1, 5, 0, None, "line", 3, None, None, *box),
        (1, 7, 0, None, "line", 4, None, None, *box),  # no such paragraph
        (1, 5, 0, 3, "word", 5, None, None, *box),
        (1, 5, 0, 1, "word", 6, None, None, *box),
        (1, 7, 0, 0, "word", 7, None, None, *box),
        (1, 5, 0, 3, "character", 8, "b", None, *box),
        (1, 5, 0, 3, "character", 7, "a", None, *box),
        (1, 5, 0, 2, "character", 9, "z", None, *box),  # no such word
        (2, 0, 0, None, "line", 0, None, None, *box),  # neither page nor paragraph
    ]
    nested = hierarchy.nest_tree(spark.createDataFrame(rows, FLAT).repartition(3))
    got = {r["doc_id"]: r for r in nested.collect()}
    assert got[2]["page_region"] is None and got[2]["paragraphs"] == []
    first, second = got[1]["paragraphs"]
    assert tuple(first["box"]) == (9, 9, 9, 9) and first["lines"] == [] and first["is_handwritten"] is False
    assert second["is_handwritten"] is True
    words = second["lines"][0]["words"]
    assert [[c["char"] for c in w["characters"]] for w in words] == [[], ["a", "b"]]
    flat = sorted((r["type"], r["pi"], r["li"], r["wi"], r["ci"], r["text"]) for r in hierarchy.unnest_tree(nested).collect() if r["type"] != "page")
    assert flat[:2] == [("character", 1, 0, 1, 0, "a"), ("character", 1, 0, 1, 1, "b")] and len(flat) == 7
    assert hierarchy.nest_tree(spark.createDataFrame([], FLAT)).count() == 0


def test_draw_is_the_same_under_any_partitioning_and_by_weight(spark):
    rows = [(k, 1.0 + k % 3) for k in range(30)] + [(100, 0.0), (101, None), (102, -1.0)]
    df = spark.createDataFrame(rows, "k long, weight double")
    a = {r["id"]: r["k"] for r in training.draw_with_replacement(df.repartition(1), "k", 6000, 5).collect()}
    b = {r["id"]: r["k"] for r in training.draw_with_replacement(df.repartition(7).orderBy(F.rand()), "k", 6000, 5).collect()}
    assert a == b and sorted(a) == list(range(6000))
    counts = pd.Series(list(a.values())).value_counts()
    assert set(counts.index) == set(range(30))
    for k in range(30):
        assert abs(counts[k] - 100 * (1 + k % 3)) < 6 * (100 * (1 + k % 3)) ** 0.5
    assert training.draw_with_replacement(df.filter("weight <= 0"), "k", 10, 5).count() == 0
    only = training.draw_with_replacement(df.filter("k = 4"), "k", 10, 5).collect()
    assert [r["k"] for r in only] == [4] * 10




def test_cascade_goes_on_from_the_last_stored_wave(spark, tmp_path):
    predict = lambda level: _closure(level)

    def _closure(level):
        def run(pdf):
            return pd.concat([pdf.assign(path=pdf["path"] * 10 + k) for k in (level, level + 1)])

        return run

    def broken(level):
        def run(pdf):
            raise ValueError("must not run again")

        return run if level < 3 else _closure(level)

    pages = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, path long")
    whole = detect.run_cascade(pages, predict, 5, "doc_id long, path long", None, 2)
    detect.run_cascade(pages, predict, 3, "doc_id long, path long", str(tmp_path), 2)
    (tmp_path / "wave3").mkdir()  # begun and left unfinished
    resumed = detect.run_cascade(pages, broken, 5, "doc_id long, path long", str(tmp_path), 2)
    for a, b in zip(whole, resumed, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert [w.count() for w in resumed] == [4, 4, 8, 16, 32] and exists(spark, f"{tmp_path}/wave4/_SUCCESS")


def test_padded_vectors(spark):
    steps = spark.createDataFrame([(0, 1, 5.0, 6.0, 0.6, 0.8, 0), (0, 2, 7.0, 8.0, 1.0, 0.0, 46), (1, 1, 9.0, 9.0, 0.0, 1.0, 2)], "p long, o int, x double, y double, dx double, dy double, class_id int")
    parents = spark.createDataFrame([(0,), (1,), (2,), (8,)], "p long")
    rows = training.normalise_steps(training.pad_sequences(training.contour_sequences(steps, parents, ["p"], "o", 2), "p", 8))
    got = {r["p"]: r for r in rows.collect()}
    assert [g["n"] for _, g in sorted(got.items())] == [2, 2, 1, 1]
    assert got[0]["x0"] == 7.0 and got[0]["mask"] == [False, False]  # cut to two steps, the NONE at the end is lost
    assert got[2]["mask"] == [False, True] and got[2]["x0"] == 0.0 and len(got[2]["target"]) == 2
    assert got[8]["mask"] == [False] and got[8]["batch"] == 1
    assert tuple(got[1]["prev"][1]) == (9 / 1024, 9 / 1024, 0.0, 1.0, 2 / 460)


@pytest.mark.parametrize("limits", [(3, 10), (100, 7), (1, 1000), (1000, 10**6)])
def test_chunks_equal_the_fold(spark, limits):
    rows = [(k % 2, k, (k * 7919) % 6) for k in range(150)] + [(5, 0, 99), (5, 1, 1), (5, 2, None), (None, 1, 1), (6, 3, 0)]
    df = spark.createDataFrame(rows, "wave long, seq long, nbytes long").repartition(3)
    got = {(r["wave"], r["seq"]): r["chunk"] for r in waves.chunk_requests(df, *limits).collect()}
    want = {}
    for wave in (0, 1, 5, 6, None):
        chunk = n = size = 0
        for _, seq, b in sorted(r for r in rows if r[0] == wave):
            if n and (n >= limits[0] or size + (b or 0) > limits[1]):
                chunk, n, size = chunk + 1, 0, 0
            n, size = n + 1, size + (b or 0)
            want[wave, seq] = chunk
    assert got == want
