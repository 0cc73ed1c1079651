from __future__ import annotations

import random

import corpus_pipeline
from pageweave.llm import near


def shingle_set(text):
    w = text.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_pipeline_drops_near_copies_by_similarity(spark, sf):
    """Copies of five-word Jaccard 0.8 or more go though their fingerprints differ in many bits; others stay."""
    rng = random.Random(3)
    texts, want = [], set()
    for k in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for changes in (0, 1, 2, 3, 8):
            w = list(base)
            for j in range(changes):
                w[(j * 29 + 7) % 150] = f"new{k}x{changes}x{j}"
            texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    for i, s in enumerate(sets):
        first = i // 5 * 5
        if all(len(s & sets[j]) / len(s | sets[j]) < 0.8 for j in range(first, i)):
            want.add(i)
    assert 30 < len(want) < 90
    texts += [texts[0], "", " ", None, "one two", "One  two"]
    want |= {151, 154}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == want


def test_bucket_of_any_size_gives_rows_in_proportion(spark):
    rows = spark.createDataFrame([(k, 100, [5]) for k in range(9)], "mark long, size long, bands array<long>")
    assert near.candidates(rows).count() == 36
    many = spark.createDataFrame([(k, 100, [5]) for k in range(2000)], "mark long, size long, bands array<long>")
    assert near.candidates(many).count() <= 2000 * 2 * near.NEIGHBOURS


def test_links_in_crowded_buckets_are_all_found(spark):
    """Fifty texts in one bucket, in similar pairs apart from each other: each pair is one component."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(150)]
    texts = []
    for k in range(25):
        own = [f"v{k}x{j}" for j in range(100)]
        texts += [" ".join(common + own), " ".join(common + own[:-1] + [f"z{k}"])]
    sets = [shingle_set(t) for t in texts]
    close = {(i, j) for i in range(50) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert close == {(2 * k + 1, 2 * k) for k in range(25)}
    rng.shuffle(order := list(range(50)))
    docs = spark.createDataFrame([(k, texts[k]) for k in order], "doc_id long, text string")

    sketched = near.sketches(docs)
    marks = sketched.select("doc_id", "mark")
    one_bucket = sketched.selectExpr("mark", "size", "array(1L) AS bands")
    apart = marks.selectExpr("mark", "mark AS component")
    rest = near.left_over(one_bucket, apart)
    assert rest.count() == 50
    sets = near.shingle_sets(docs, marks)
    links = near.confirmed(near.shared_prefixes(rest, sets), sets)
    ids = {r["mark"]: r["doc_id"] for r in marks.collect()}
    assert {tuple(sorted((ids[r["a"]], ids[r["b"]]), reverse=True)) for r in links.collect()} == close
    whole = near.near_copies(docs).collect()
    assert {(r["doc_id"], r["component_id"]) for r in whole} == {(k, k // 2 * 2) for k in range(50)}
    joined = marks.selectExpr("mark", "1L AS component")
    assert near.left_over(one_bucket, joined).count() == 0


def test_links_run_through_rows_without_id(spark):
    """A is like B and B like C, but A not like C; B has no id."""
    base = [f"w{k}" for k in range(204)]
    b = list(base)
    for k in range(4):
        b[10 + 12 * k] = f"b{k}"
    c = list(b)
    for k in range(4):
        c[100 + 12 * k] = f"c{k}"
    texts = [" ".join(x) for x in (base, b, c)]
    sets = [shingle_set(t) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert alike(0, 1) >= 0.8 and alike(1, 2) >= 0.8 and alike(0, 2) < 0.8
    docs = spark.createDataFrame(list(zip([5, None, 7], texts, strict=True)) + [(None, "alone"), (9, None), (None, None)], "doc_id long, text string")
    got = sorted(map(str, ((r["doc_id"], r["component_id"]) for r in near.near_copies(docs).collect())))
    assert got == sorted(map(str, [(5, 5), (None, 5), (7, 5), (None, None), (9, 9), (None, 9)]))
    assert sorted(str(r["doc_id"]) for r in near.keep_one(docs).collect()) == ["5", "9", "None", "None", "None"]


def test_crowded_bucket_is_dealt_and_moves_each_set_about_once(spark):
    """Near copies of one text: one component, sets moved in proportion, buckets over several tasks."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(1500):
        w = list(base)
        w[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = near.sketches(docs).select("mark", "size", "bands")
    pairs = near.candidates(marks)
    leads = pairs.filter("lead").count()
    assert leads < 5 * 1500 and pairs.count() < 1500 * 20 * 2 * near.NEIGHBOURS
    assert {r["component_id"] for r in near.near_copies(docs).collect()} == {0}


def test_near_copies_of_an_empty_table_and_of_clashing_columns(spark):
    schema = "doc_id long, text string, mark string, size string, component_id string"
    assert near.keep_one(spark.createDataFrame([], schema)).collect() == []
    docs = spark.createDataFrame([(1, "a b c", "m", "s", "c"), (2, "A b  c", "m", "s", "d")], schema)
    assert [tuple(r) for r in near.keep_one(docs).collect()] == [(1, "a b c", "m", "s", "c")]
