"""Queries whose files, rows between tasks or calls grew out of proportion."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from pageweave.functions import scratch
from pageweave.functions.scratch import shared_dir
from pageweave.operators import boxes, waves
from pageweave.plans import registry


def test_listed_images_need_no_folder_per_document(spark, sf):
    folder = Path(shared_dir(spark).removeprefix("file://")) / "pageweave"
    before = set(folder.glob("images-*"))
    rows = registry.queries()["s2_listed_images"](spark, sf).collect()
    (made,) = set(folder.glob("images-*")) - before
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 3 <> 2")
    assert sum(r["n"] for r in rows) == docs.count() and sum(r["ids"] for r in rows) == docs.groupBy().sum("doc_id").first()[0]
    assert len([p for p in made.rglob("*") if p.is_dir()]) == len(rows)


def test_components_are_followed_in_place(spark, monkeypatch):
    """Against a plain search; with repeated ids, nulls, boxes without area or measure; no rounds over all links unless a group is large."""
    rng = random.Random(3)
    rows = []
    for k in range(300):
        x, y = rng.randrange(150), rng.randrange(60)
        again = k % 97 == 96
        rows.append((rows[-1][0] if again else rng.choice(["a", "b", None]), k - again, x, y, x + rng.randrange(1, 30), y + rng.randrange(20)))
    rows.append(("a", 900, None, 3, 4, 5))

    def linked(p, q):
        w, h = min(p[4], q[4]) - max(p[2], q[2]), min(p[5], q[5]) - max(p[3], q[3])
        small = min((r[4] - r[2]) * (r[5] - r[3]) for r in (p, q))
        return small > 0 and max(0, w) * max(0, h) / small >= 0.4

    name = {r[1]: r[1] for r in rows}
    while True:
        before = dict(name)
        for p in rows:
            for q in rows:
                if p[0] is not None and p[0] == q[0] and None not in p + q and linked(p, q):
                    name[p[1]] = name[q[1]] = min(name[p[1]], name[q[1]])
        if name == before:
            break
    want = sorted(repr((*r, name[r[1]])) for r in rows)
    df = spark.createDataFrame(rows, "g string, id long, x1 long, y1 long, x2 long, y2 long").repartition(3)
    large = boxes.connected_components
    for limit in (boxes.COMPONENT, 1):
        monkeypatch.setattr(boxes, "COMPONENT", limit)
        monkeypatch.setattr(boxes, "connected_components", large if limit == 1 else None)
        got = boxes.box_components(df, "g", 0.4).select("g", "id", "x1", "y1", "x2", "y2", "component").collect()
        assert sorted(repr(tuple(r)) for r in got) == want


def test_pixels_stay_with_their_image(spark, sf):
    """Pixels are made where their image was dealt; regions go to Python by the batch."""
    for name in ("g18_content_mask", "g14_region_contours"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan
        assert all("REPARTITION_BY_NUM" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_chunks_are_joined_by_blocks(spark, monkeypatch):
    """Against a plain loop, on waves of many blocks and of many chunks a block; only the heads of blocks are joined from one to the next."""
    rng = random.Random(5)
    rows = [(w, k, rng.choice([None, 0, 1, 3, 9, 40])) for w, n in ((0, 1500), (1, 1), (None, 130), (7, 64), (8, 65)) for k in range(n)]
    joined = []

    def seen(df, name):
        out = scratch.saved(df, name)
        joined.append((name, out.count()))
        return out

    monkeypatch.setattr(waves, "saved", seen)
    monkeypatch.setattr(waves, "BLOCK", 64)
    df = spark.createDataFrame(rows, "wave long, seq long, nbytes long").repartition(3)
    for most, least in ((3, 10_000), (16, 60), (1, 1)):
        want, before, chunk, n, size = [], object(), 0, 0, 0
        for w, k, b in rows:
            b = b or 0
            new = n >= most or size + b > least
            chunk, n, size = (0, 1, b) if w != before else (chunk + new, 1 if new else n + 1, b if new else size + b)
            before = w
            want.append((w, k, chunk))
        joined.clear()
        got = sorted(map(tuple, waves.chunk_requests(df, most, least).collect()), key=str)
        assert got == sorted(want, key=str)
        blocks = sum(-(-n // 64) for n in (1500, 1, 130, 64, 65))
        assert {n for name, n in joined if name == "entries"} and all(n <= most * blocks for _, n in joined)


def _plan(spark, sf, name):
    return registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, layouts", [("t2_level_index", 1), ("b13_sequence_search", 0)])
def test_texts_are_laid_out_once(spark, sf, name, layouts):
    """In ``b13_sequence_search`` for a table of letters, which the plan reads."""
    assert _plan(spark, sf, name).count("posexplode(flatten(") == layouts


def test_answers_are_made_once(spark, sf):
    assert _plan(spark, sf, "w5_parse_responses").count("StructsToJsonEvaluator") == 1
