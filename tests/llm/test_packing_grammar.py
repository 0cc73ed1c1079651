"""Packing against one-by-one shortest-pack-first, grammars against one-by-one Re-Pair, and odd rows of both."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageweave.llm import grammar, packing
from pageweave.llm import queries as q
from pageweave.llm.word_bpe import WordEncoder

BASE = 49408


@pytest.fixture(scope="module")
def word_file():
    return q.tokenizer_file("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aAzZéÉß'’ ,.!1²̱̌jJ\x00\x1c\x85\xa0\t\n|<>#日🙂ªº×", max_size=40), max_size=5), st.integers(0, 4))
def test_encoder_is_the_library(texts, marks):
    """Added tokens anywhere, case that only lower-casing makes one, marks that compose with some letters only."""
    from tokenizers import Tokenizer

    path = q.tokenizer_file("word_bpe_49k.json")
    texts = [("<|endoftext|>" * marks).join(list(t)) + "<|ENDOFTEXT|>'S" for t in texts]
    ids, bounds = WordEncoder(path, most=5).flat(pa.array([None, *texts], pa.string()))
    want = [[]] + [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)] if texts else [[]]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want


def shortest_pack_first(histogram, size):
    """Packs of the method one piece at a time: longest first, each into the shortest pack, if it fits there."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = min(range(len(packs)), key=packs.__getitem__, default=None)
            if k is None or packs[k] + length > size:
                packs.append(length)
            else:
                packs[k] += length
    return len(packs)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_patterns_need_no_more_sequences_than_one_by_one(histogram):
    need = sum(c for _, c in packing.placed(histogram, 64))
    assert need <= 1.1 * shortest_pack_first(histogram, 64) + 1
    slots = packing.slots(packing.placed(histogram, 64))
    seen = set()
    for length, n in histogram.items():
        rows = slots[slots[:, 0] == length]
        for rank in range(n):
            row = rows[np.searchsorted(rows[:, 1], rank, "right") - 1]
            again, sequence = divmod(rank - row[1], row[4])
            start = row[3] + again * length
            places = {(row[2] + sequence, k) for k in range(start, start + length)}
            assert len(places) == length and not places & seen
            seen |= places


def test_packing_odd_rows(spark, word_file):
    """Null and repeated ids, null texts; every row is packed."""
    rows = [(None, "a b"), (None, None), (3, "a b"), (3, "a b"), (3, "c"), (4, "")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), word_file).collect()
    assert sorted(((r["doc_id"] or 0), r["length"]) for r in out) == [(0, 1), (0, 3), (3, 2), (3, 3), (3, 3), (4, 1)]
    assert {r["sequence_id"] for r in out} == {0}
    assert sorted(r["offset"] for r in out) == list(np.cumsum([0, *sorted((r["length"] for r in out), reverse=True)])[:-1])


def test_hot_length_is_dealt_over_parts(spark):
    cut = spark.range(9000).selectExpr("id AS doc_id", "0L AS start", "7L AS length", "id AS ids_crc32", "7L AS doc_tokens")
    ranks = packing.ranked(cut, {7: 9000}).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(9000))


def one_by_one(docs, base, least):
    """Symbols and rules after Re-Pair with one pair at a time."""
    docs, rules = [list(d) for d in docs], 0
    while True:
        counts = collections.Counter()
        for d in docs:
            k = 0
            while k + 1 < len(d):
                counts[d[k], d[k + 1]] += 1
                k += 2 if k + 2 < len(d) and d[k] == d[k + 1] == d[k + 2] else 1
        if not counts or max(counts.values()) < least:
            return sum(map(len, docs)), rules
        best = max(counts, key=lambda p: (counts[p], p))
        new, rules = base + rules, rules + 1
        for i, d in enumerate(docs):
            out, k = [], 0
            while k < len(d):
                if tuple(d[k : k + 2]) == best:
                    out.append(new)
                    k += 2
                else:
                    out.append(d[k])
                    k += 1
            docs[i] = out


def size(symbols, rules):
    return 2 * symbols + 8 * rules


def test_grammar_saves_what_one_by_one_saves():
    rng = random.Random(4)
    words = [[rng.randrange(400) for _ in range(rng.randrange(1, 5))] for _ in range(60)]
    docs = [[x for _ in range(rng.randrange(5, 120)) for x in words[int(rng.paretovariate(0.9)) % 60]] + [1] for _ in range(60)]
    ids = np.concatenate([np.array(d, np.uint32) for d in docs])
    left, right, x, cuts = grammar.compress(ids, np.cumsum([len(d) for d in docs]), BASE)
    symbols, rules = one_by_one(docs, BASE, 6)
    plain = 2 * len(ids)
    assert plain - size(len(x), len(left)) > 0.93 * (plain - size(symbols, rules))


def test_no_frequent_pair_is_left():
    rng = random.Random(2)
    docs = [[rng.randrange(12) for _ in range(300)] + [1] for _ in range(30)] + [[7] * 500, [3, 4] * 200]
    ids = np.concatenate([np.array(d, np.uint32) for d in docs])
    left, right, x, cuts = grammar.compress(ids, np.cumsum([len(d) for d in docs]), BASE)
    counts, at = collections.Counter(), 0
    for stop in cuts.tolist():
        d, k = x[at:stop].tolist(), 0
        while k + 1 < len(d):
            counts[d[k], d[k + 1]] += 1
            k += 2 if k + 2 < len(d) and d[k] == d[k + 1] == d[k + 2] else 1
        at = stop
    assert max(counts.values()) < 6


def test_stretches_follow_stored_lengths():
    rng = random.Random(3)
    docs = [np.array([rng.randrange(5) for _ in range(400)] + [1], "<u4") for _ in range(20)]
    f = grammar.GrammarFile(grammar.pack_file(list(range(20)), [d.tobytes() for d in docs], BASE))
    assert len(f.lengths) and f.lengths.max() > 2
    for _ in range(200):
        k, a, b = rng.randrange(20), rng.randrange(401), rng.randrange(402)
        assert (f.stretch(k, a, b) == docs[k][a:b]).all() and len(f.stretch(k, a, b)) == max(0, b - a)
    ids, bounds = f.documents(3, 9)
    assert (ids == np.concatenate(docs[3:9])).all() and bounds.tolist() == list(range(0, 401 * 7, 401))


def test_grammar_odd_rows_and_small_files(spark, word_file, tmp_path):
    """Repeated and null ids, documents above a file's size; each row comes back."""
    rows = [(None, "a"), (2, "b c"), (2, "b c"), (2, None), (5, "word " * 300), (7, "x y z")]
    path = grammar.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/ids", word_file, ids_a_file=4)
    read = sorted(grammar.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in read] == [None, 2, 2, 2, 5, 7]
    assert [r["n_tokens"] for r in read] == [2, 1, 3, 3, 301, 4]
    assert [r["start"] for r in read] == [0, 2, 3, 6, 9, 310]
    one = grammar.id_checksums(grammar.read_ids(spark, path)).filter("doc_id = 7").first()
    ids = WordEncoder(word_file).encode(["x y z"])[0] + np.array([1], "<u4").tobytes()
    assert one["ids_crc32"] == zlib.crc32(ids)
