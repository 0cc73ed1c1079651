from __future__ import annotations

import random

import numpy as np

from pageweave.llm import near, simhash


def test_simhash_alone_finds_near_copies(spark, monkeypatch):
    """With the bands taken away, texts whose fingerprints differ in at most three bits still meet, and are held to the similarity."""
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        for changed in (None, 300, 599):
            texts.append(" ".join(w if k != changed else "other" for k, w in enumerate(base)))
    prints = [simhash.majority(near.shingles(t)) for t in texts]
    close = [[bin(x ^ y).count("1") <= 3 for y in prints] for x in prints]
    want = {k: next(j for j in range(k // 3 * 3, k + 1) if close[k][j]) for k in range(len(texts))}
    assert sum(k != c for k, c in want.items()) >= 12
    none = spark.createDataFrame([], "a long, b long, lead boolean")
    monkeypatch.setattr(near, "candidates", lambda distinct: none)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(docs).collect()}
    for k, c in want.items():
        assert got[k] <= c and got[k] // 3 == k // 3
    # Equal fingerprints of unlike sets are no copies.
    monkeypatch.setattr(simhash, "majority", lambda hashes: 7 if np.size(hashes) else 0)
    unlike = spark.createDataFrame([(0, "a b c d e f g"), (1, "h i j k l m n"), (2, "A b c d e f g")], "doc_id long, text string")
    assert sorted(tuple(r) for r in near.near_copies(unlike).collect()) == [(0, 0), (1, 1), (2, 0)]
