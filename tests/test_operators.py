from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pageweave.functions.vocab import characters
from pageweave.operators import boxes, crawl, detect, geometry, layout, links, training, waves
from pageweave.plans import registry
from pageweave.plans.common import table, words
from pageweave.sources import files
from pageweave.streaming import ingest

CHECKED = ("h3_flatten_preorder", "h4_flat_to_nested", "h6_hierarchy_counts", "h8_assemble_text", "h10_local_to_global", "g2_to_retina", "g7_dominant_angles", "b1_content_regions", "b7_b8_overlap_pairs", "b20_nearest_template", "c1_extract_links", "c8_bfs_frontier", "c9_rate_limit_schedule", "c11_insert_or_replace", "t4_build_sequences", "t9_split_train_val", "w5_parse_responses", "w17_correction_rate", "m2_early_stop", "m7_class_loss", "b2_candidate_boxes", "b9_box_components", "b10_overlap_score", "b13_sequence_search", "d1_score_wave", "d2_run_cascade", "d7_collect_documents", "g12_reverse_levels", "s3_s4_annotation_files", "s9_read_logs", "m11_changed_files", "x1_x2_once_per_file", "x6_status_sink", "x7_running_totals")


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    df = registry.queries()[name](spark, sf)
    got = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([plain(v) for v in r]) for r in got.fetchall())


def test_nms_keeps_no_overlap_and_is_idempotent(spark, sf):
    from pageweave.plans.documents import _dets

    kept = boxes.nms(_dets(spark, sf), ["doc_id", "pi", "li"]).persist()
    pairs = boxes.iou_pairs(kept, "doc_id").filter(F.col("iou") >= 0.3).filter("a_id div 2000 = b_id div 2000")
    assert kept.count() > 0 and pairs.count() == 0
    assert boxes.nms(kept, ["doc_id", "pi", "li"]).count() == kept.count()


def test_chunks_respect_limits(spark, sf):
    rows = registry.queries()["w4_chunk_requests"](spark, sf).groupBy("wave", "chunk").count().collect()
    assert rows and max(r["count"] for r in rows) <= 40


def test_contours_lift_back(spark, sf):
    rows = registry.queries()["g9_g11_cascade_round_trip"](spark, sf)
    assert rows.count() > 0 and rows.filter("not within").count() == 0


def test_region_contours(spark, sf):
    rows = registry.queries()["g14_region_contours"](spark, sf).limit(60).collect()
    for r in rows:
        c = [(p["x"], p["y"]) for p in r["contour"]]
        assert len(c) == 0 or 4 <= len(c) <= 20
        assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(c, c[1:] + c[:1])) <= 0


def test_links_resolve(spark):
    page = "http://a.example/x/y.html?q=1#f"
    want = {"/z": "http://a.example/z", "z": "http://a.example/x/z", "../z": "http://a.example/z", "//b/c": "http://b/c", "?k": "http://a.example/x/y.html?k", "#g": "http://a.example/x/y.html?q=1#g", "https://c/d": "https://c/d"}
    df = spark.createDataFrame([(1, page, u) for u in want], "page_id long, url string, raw_url string")
    assert {r["raw_url"]: r["target"] for r in links.resolve_links(df).collect()} == want


def test_close_contours_and_prefix(spark):
    steps = [(1, k, x, y, 5) for k, (x, y) in enumerate([(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (3.0, 3.0), (50.0, 50.0)])] + [(2, 0, 0.0, 0.0, 5), (2, 1, 9.0, 9.0, 0)]
    df = spark.createDataFrame(steps, "p long, k long, x double, y double, class_id long")
    got = detect.close_contours(df, ["p"], "k").collect()
    assert [(r["p"], len(r["contour"])) for r in got] == [(1, 3)]


def test_calls_and_cost(spark):
    df = spark.createDataFrame([(46, 68, 543)], "paragraphs long, lines long, words long")
    assert waves.call_plan(df).first()["calls"] == 659


def test_files_round_trip(spark, sf, tmp_path):
    from pageweave.operators.hierarchy import nest

    nested = nest(words(spark, sf)).limit(20)
    files.write_annotations(nested, f"{tmp_path}/ann")
    (tmp_path / "ann" / "bad.json").write_text("{nonsense")
    back = files.read_annotations(spark, f"{tmp_path}/ann")
    assert back.count() == 20 and not back.filter("is_handwritten").count()
    req = spark.createDataFrame([("a", "x"), ("b", "y")], "custom_id string, body string")
    files.write_requests(req, f"{tmp_path}/req")
    assert sorted(map(tuple, files.read_responses(spark, f"{tmp_path}/req").collect())) == [("a", "x"), ("b", "y")]
    (tmp_path / "img").mkdir()
    for n in ("b.PNG", "a.jpg", "c.txt"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert [r["name"] for r in files.list_images(spark, f"{tmp_path}/img").collect()] == ["a.jpg", "b.PNG"]


def test_stream_handles_each_file_once(spark, sf, tmp_path):
    src = f"{tmp_path}/in"
    table(spark, sf, "events").repartition(3).write.parquet(src)
    schema = "event_id long, user_id long"

    def go(checkpoint):
        stream = ingest.watch_dir(spark, src, schema, 2)
        handle = lambda df, n: df.filter("event_id >= 0")
        ingest.ingest_once(stream, f"{tmp_path}/status", f"{tmp_path}/{checkpoint}", handle, f"{tmp_path}/out").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").count()

    assert go("c1") == 1000
    assert go("c1") == 1000
    status = ingest.processed(spark, f"{tmp_path}/status")
    assert status.count() == 3 and {r["status"] for r in status.collect()} == {"annotated"}


def test_parent_local(spark):
    rows = [(1, 0, 10, 20, 522, 276), (1, 1, 522, 20, 1034, 532), (None, 0, 0, 0, 5, 5)]
    got = training.parent_local(spark.createDataFrame(rows, "p int, k int, x1 int, y1 int, x2 int, y2 int"), ["p"]).collect()
    assert sorted((r["k"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in got) == [(0, 0, 256, 512, 512), (1, 512, 256, 1024, 768)]


def test_vocabulary_and_layout(spark):
    chars = characters()
    assert len(chars) == len(set(chars)) == 455 and all(len(c) == 1 for c in chars)
    assert chars[33] == "A" and chars[95] == "\xa0" and chars[369] == "∀" and chars[-1] == "″"
    rows = layout.layout_words(spark.createDataFrame([(1, "ab  c\n\nd"), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["li"], r["wi"], r["text"], r["x1"]) for r in rows] == [(1, 0, 0, "ab", 40), (1, 0, 1, "c", 88), (1, 2, 0, "d", 40)]
    assert geometry.SIDE == 1024


def _boxes(n, seed, labels):
    import random

    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y = rng.randrange(300), rng.randrange(200)
        rows.append((k % 2, k, rng.choice(labels), rng.randrange(9), x, y, x + rng.randrange(1, 80), y + rng.randrange(1, 60)))
    return rows


BOXES = "doc_id long, id long, label string, distance long, x1 int, y1 int, x2 int, y2 int"


def _meet(a, b):
    return a[4] <= b[6] and b[4] <= a[6] and a[5] <= b[7] and b[5] <= a[7]


def test_greedy_same_label(spark):
    rows = _boxes(120, 1, ["to", "top", "stop", "op"])
    want = []
    for r in sorted(rows, key=lambda r: (r[3], r[5], r[4], r[1])):
        if not any(r[0] == k[0] and r[2] == k[2] and _meet(r, k) for k in want):
            want.append(r)
    got = boxes.greedy_same_label(spark.createDataFrame(rows, BOXES), "doc_id").collect()
    assert 0 < len(got) < 120 and sorted(r["id"] for r in got) == sorted(r[1] for r in want)
    assert boxes.greedy_same_label(spark.createDataFrame([], BOXES), "doc_id").count() == 0


def test_drop_substring_overlaps(spark):
    rows = _boxes(120, 2, ["to", "top", "stop", "op", "zz"])
    alive = set()
    for doc in (0, 1):
        left = sorted((r for r in rows if r[0] == doc), key=lambda r: (*r[4:], r[2], r[1]))
        gone = set()
        for i, a in enumerate(left):
            for b in left[i + 1 :]:
                if a[1] in gone:
                    break
                if b[1] not in gone and (a[2] in b[2] or b[2] in a[2]) and _meet(a, b):
                    gone.add(b[1] if len(a[2]) > len(b[2]) else a[1])
        alive |= {r[1] for r in left} - gone
    got = boxes.drop_substring_overlaps(spark.createDataFrame(rows, BOXES), "doc_id").collect()
    assert 0 < len(got) < 120 and {r["id"] for r in got} == alive
    assert boxes.drop_substring_overlaps(spark.createDataFrame([], BOXES), "doc_id").count() == 0


def test_sequence_search(spark):
    rows = _boxes(90, 3, ["a", "b"])
    inside = lambda p, n: n[4] >= p[4] and n[5] >= p[5] - 64 and n[6] <= p[6] + 64 and n[7] <= p[7] + 64
    want = [[r[1]] for r in rows if r[2] == "a"]
    at = {r[1]: r for r in rows}
    for c in "ba":
        want = [w + [r[1]] for w in want for r in rows if r[2] == c and r[0] == at[w[-1]][0] and inside(at[w[-1]], r)]
    df = spark.createDataFrame(rows, BOXES)
    got = boxes.sequence_search(df, "doc_id", "aba").collect()
    assert want and sorted(list(r["chain"]) for r in got) == sorted(want)
    assert boxes.sequence_search(df, "doc_id", "a").count() == 0


def test_merged_sequence_search(spark):
    rows = _boxes(60, 5, ["a", "b"])
    rows += [(r[0], 1000 + r[1], r[2], r[3], r[4] + 1, *r[5:]) for r in rows]

    def shared(a, b):
        return max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5]))

    def best(some):
        """One box per component of ``some``."""
        area, left, out = lambda r: (r[6] - r[4]) * (r[7] - r[5]), list(some), []
        while left:
            part = [left.pop()]
            for r in part:
                near = [x for x in left if area(r) and area(x) and shared(r, x) >= 0.9 * min(area(r), area(x))]
                part += near
                left = [x for x in left if x not in near]
            out.append(max(part, key=lambda r: (sum(2 * shared(r, x) for x in part), *r[4:8], r[1])))
        return out

    def chains(last, word):
        if not word:
            return [[]]
        some = [r for r in rows if r[2] == word[0] and r[0] == last[0] and (len(last) == 1 or (r[4] >= last[4] and r[5] >= last[5] - 64 and r[6] <= last[6] + 64 and r[7] <= last[7] + 64))]
        return [[b[1], *rest] for b in best(some) for rest in chains(b, word[1:])]

    df = spark.createDataFrame(rows, BOXES)
    for word in ("ab", "a"):
        want = sorted(c for g in {r[0] for r in rows} for c in chains((g,), word))
        assert want and sorted(list(r["chain"]) for r in boxes.merged_sequence_search(df, "doc_id", word).collect()) == want
    assert boxes.merged_sequence_search(df, "doc_id", "").count() == 0


def test_changed_files(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4"), ("d", None)], "path string, hash string")
    assert sorted(r["path"] for r in crawl.changed_files(before, now).collect()) == ["b", "c"]


def test_every_word_gets_a_box(spark):
    """Lines too wide go on in further lines; a word wider than a line is parted at the width."""
    texts = ["a " * 300 + "\n\n b", "x" * 400, "w" * 164 + " z", "\r q\u0085r  ", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = layout.layout_words(docs).orderBy("doc_id", "pi", "li", "wi").collect()
    for k, t in enumerate(texts):
        mine = [r for r in rows if r["doc_id"] == k]
        joined = "".join(r["text"] for r in mine)
        assert joined == (t or "").replace(" ", "").replace("\n", "")
        assert all(r["x2"] <= layout.WIDTH - layout.MARGIN for r in mine)
    assert [len(r["text"]) for r in rows if r["doc_id"] == 1] == [164, 164, 72]
    assert max(5 * r["pi"] + r["li"] for r in rows if r["doc_id"] == 0) == 5  # four lines of the first, an empty one, the last


def test_links_of_all_tags(spark):
    html = """<img src=one.png><IMG data-src='/two.jpg'><img src="" data-original="three.gif?a=1&amp;b=2"><source srcset="s1 1x, s2 2x,">
     <meta property="og:image" content="og.png"><meta name=viewport content="no"><a title="a > b" href='four.html'><a href=""><!-- <a href="no"> -->
     <script>"<a href='no2'>"</script><a href="four.html">"""
    rows = links.extract_links(spark.createDataFrame([(1, "http://h/", html), (2, "http://h/", None)], "page_id long, url string, html string")).collect()
    want = ["one.png", "/two.jpg", "three.gif?a=1&b=2", "s1", "s2", "og.png", "four.html"]
    assert [r["raw_url"] for r in sorted(rows, key=lambda r: (r["ordinal"], r["raw_url"]))] == want


def test_any_number_of_steps_up(spark):
    raw = {"../" * 30 + "x": "http://h/x", "/a/../b/./c": "http://h/b/c", "..": "http://h/d/", "e/f/../..//g?q=../..": "http://h/d/e2/g?q=../..", ".": "http://h/d/e2/"}
    df = spark.createDataFrame([(u,) for u in raw], "raw_url string").selectExpr("1L AS page_id", "'http://h/d/e2/p.html?x=/y/' AS url", "raw_url")
    assert {r["raw_url"]: r["target"] for r in links.resolve_links(df).collect()} == raw
