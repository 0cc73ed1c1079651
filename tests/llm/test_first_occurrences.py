from __future__ import annotations

import random
from collections import defaultdict

from pageweave.llm import suffixes


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def nested(rng, shares):
    """Documents that share a passage with the last one around one key: so many words left and right of it."""
    left, key, right = words(rng, 20), words(rng, suffixes.KEY_WORDS), words(rng, 20)
    out = []
    for a, b in shares:
        out.append(words(rng, 60) + left[20 - a :] + key + right[:b] + words(rng, 60))
    return [*out, words(rng, 60) + left + key + right + words(rng, 60)]


def first_places(texts):
    """Places of each text in a passage of 50 words that stands there first and somewhere else too."""
    where = defaultdict(list)
    for k, w in enumerate(texts):
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].append((k, i))
    out = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            k, i = min(places)
            out[k].update(range(i, i + 50))
    return out


def test_first_occurrences_of_nested_excerpts(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        texts += nested(rng, [(8, 18), (12, 14), (20, 10)])
        texts += nested(rng, [(5, 19), (9, 16), (13, 13), (17, 9)])
        whole = nested(rng, [])[0]
        texts += [whole, words(rng, 40) + whole[63:115] + words(rng, 40), words(rng, 40) + whole[72:124] + words(rng, 40)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = defaultdict(set)
    for r in suffixes.spans(docs).filter("not dropped").collect():
        got[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
    want = first_places(texts)
    missing = {k: len(x - got[k]) for k, x in want.items() if x - got[k]}
    assert not missing


def test_own_side_of_a_partner_between(spark):
    """L, M and Z share 53, 53 and 57 words with R around one key; each is the first holder of some passage."""
    rng = random.Random(1)
    texts = nested(rng, [(8, 18), (12, 14), (20, 10)])
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in suffixes.spans(docs).filter("not dropped").collect()} == {0, 1, 2}


def exact(rows):
    """Word places of each document that some window drops, and of those that it holds first with another holder."""
    where = defaultdict(set)
    for k, t in rows:
        w = (t or "").split()
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add((k, i))
    dropped, first = defaultdict(set), defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            least = min(places)
            first[least[0]].update(range(least[1], least[1] + 50))
            for k, i in places - {least}:
                dropped[k].update(range(i, i + 50))
    return dict(dropped), dict(first)


def got(spark, rows, many):
    out = (defaultdict(set), defaultdict(set))
    for r in suffixes.spans(spark.createDataFrame(rows, "doc_id long, text string, window int"), many).collect():
        assert r["n_words"] >= 50
        out[0 if r["dropped"] else 1][r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
    return dict(out[0]), dict(out[1])


def test_every_window_and_no_other(spark):
    """Word for word what brute force finds, also where keys are dealt over tasks (a key of over three suffixes)."""
    rng = random.Random(21)
    shared = [words(rng, n) for n in (27, 40, 49, 50, 51, 73, 200)]
    texts = []
    for k in range(90):
        w = words(rng, rng.randrange(70))
        for p in rng.sample(shared, rng.randrange(4)):
            a = rng.randrange(len(p) // 2)
            w += p[a:] if rng.random() < 0.3 else p
            w += words(rng, rng.randrange(4))
        texts.append(" ".join(w))
    texts += texts[:4] + ["a " * 130, "a " * 70, "x y z " * 60, None, "", " \t ", "word", "\x1cw " * 60]
    rows = [(k, t, 1) for k, t in enumerate(texts)]
    want = exact([(k, t) for k, t, _ in rows])
    assert want[0] and got(spark, rows, suffixes.MANY) == want
    assert got(spark, rows, 3) == want
    assert got(spark, rows + rows[:20], 3) == want


def test_hot_key_with_contexts_of_its_own(spark):
    """A passage of 40 words in every document, with other words around it: no window is shared but by some pairs."""
    rng = random.Random(5)
    key = words(rng, 40)
    around = [(words(rng, 30), words(rng, 30)) for _ in range(200)]
    texts = [" ".join(a + key + b) for a, b in around]
    texts += [" ".join(words(rng, 9) + around[k][0][18:] + key + words(rng, 40)) for k in (3, 77, 150)]
    rows = [(k, t, 1) for k, t in enumerate(texts)]
    want = exact([(k, t) for k, t, _ in rows])
    assert set(want[0]) == {200, 201, 202} and got(spark, rows, 2) == want


def test_same_id_with_another_text(spark):
    """Cuts of one text are not made in another text of the same id."""
    rng = random.Random(6)
    p, other = " ".join(words(rng, 80)), " ".join(words(rng, 90))
    docs = spark.createDataFrame([(1, p), (2, p), (2, other), (None, p), (2, p)], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["text"]) for r in suffixes.cut_repeats(docs).collect())
    assert out == sorted([(0, p), (1, p), (2, ""), (2, ""), (2, other)])


def test_pieces_of_a_long_text(spark, monkeypatch):
    """Texts are hashed in stretches; a window over two of them is found like any other."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    texts = pa.array([" ".join(words(rng, n)) for n in (400, 10, 0, 51, 50, 49)])
    h, bounds = suffixes.word_hashes(texts)
    assert np.diff(bounds).tolist() == [400, 10, 0, 51, 50, 49]
    whole = suffixes.retained(h, bounds)
    assert whole[3].sum() == 351 + 2 + 1 == len(whole[4])
    monkeypatch.setattr(suffixes, "_AT_ONCE", 64)
    for a, b in zip(whole, suffixes.retained(h, bounds)):
        assert (a == b).all()
