from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from pageweave.llm import bpe, grammar, language, lines, packing, quality, scoring, simhash, suffixes, tiff
from pageweave.llm import queries as q
from pageweave.llm.word_bpe import WordEncoder

ODD = [None, "", " ", "\n\n", "a", "  two  spaces\n\n tabs\t\there ", "x" * 70_000, "don't 've 's ''s",
       "naïve ÉCOLE ŒUVRE ﬁ ſ İ \x1c\x1f\x85\xa0z", "<|endoftext|> 12345 日本語 🙂🙂", "a\x00b", "word " * 3000]
RAW = "doc_id long, text string, lang string, kept string, bucket int, sequence_id string"


def frame(spark, texts, langs=None):
    """Texts with ids in order and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, (langs or ["en"] * len(texts))[k], "x", 1, "y") for k, t in enumerate(texts)], RAW)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# 1 ------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tik():
    import public_tokenizers as P

    return bpe._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def bpe_rows(spark, docs):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.decode(bpe.encode(docs, path, P.PATTERN), path)).collect()


def digest(tik, t):
    ids = tik.encode_ordinary(t or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_matches_tiktoken(spark, sf, tik):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD + ODD[:3]
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe_rows(spark, frame(spark, texts))}
    assert got == {k: digest(tik, t) for k, t in enumerate(texts)}


def test_bpe_query_matches_tiktoken(spark, sf, tik):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in q.op1_byte_bpe(spark, sf).collect()} == {k: digest(tik, t) for k, t in texts.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t　\x1caB'stré1²-!", max_size=40), max_size=4))
def test_blocks_split_as_the_pattern_does(texts):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    whole = bpe._encoding(path, P.PATTERN)
    assert isinstance(whole, tiktoken.Encoding)
    block = bpe._Block(P.PATTERN)
    for k, t in enumerate(texts):
        block.add(k, t)
    words = list(block.words)
    for (_, stream), t in zip(block.docs, texts):
        parts = [words[c] for c in bpe._unvarint(stream).tolist()]
        assert "".join(parts) == t
        assert [i for w in parts for i in whole._encode_single_piece(w)] == whole.encode_ordinary(t)


def test_bpe_blocks_of_any_size(spark, tik):
    """Blocks cut within a batch, and blocks over several batches, give the same ids."""
    import public_tokenizers as P

    texts = [t or "" for t in ODD * 3]
    path = P.path("byte_bpe_50k.tiktoken")
    for chars in (1, 40, 1 << 20):
        rows = bpe.encode(frame(spark, texts), path, P.PATTERN, block_chars=chars).collect()
        assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in rows} == {k: tik.encode_ordinary(t) for k, t in enumerate(texts)}


def test_decode_refuses_unknown_ids(spark):
    import public_tokenizers as P

    wrong = spark.createDataFrame([(1, bytearray(np.array([60_000], "<u4").tobytes()))], "doc_id long, ids binary")
    with pytest.raises(Exception):
        bpe.decode(wrong, P.path("byte_bpe_50k.tiktoken")).collect()


def test_bpe_empty_table_and_null_id(spark):
    assert bpe_rows(spark, frame(spark, [])) == []
    rows = bpe_rows(spark, spark.createDataFrame([(None, "hi there"), (None, None), (4, "hi there"), (4, "hi there")], "doc_id long, text string"))
    assert sorted((r["n_tokens"] for r in rows)) == [0, 2, 2, 2]


# 2 ------------------------------------------------------------------------------------------------------------------
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges_and_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, logp = model = language.fit(docs)
    by = {r["lang"]: r["text"] for r in docs.groupBy("lang").agg(F.max_by("text", "n_chars").alias("text")).collect()}
    mixed = by["en"][:3000] + "\n" + by["de"][:3000]
    shares = language.infer([mixed, by["fr"]], langs, logp)
    assert set(shares[0]) == {"en", "de"} and abs(shares[0]["en"] - 0.5) < 0.2
    assert max(shares[1], key=shares[1].get) == "fr"
    rows = language.predict(frame(spark, [None, "", "123 !!", "the", *ODD]), model).collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and all(r["score"] == 0 for r in rows[:3])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    nothing = language.fit(frame(spark, ["a b"], [None]))
    assert nothing[0] == [] and language.predict(frame(spark, ["some text"]), nothing).first()["lang_pred"] == "und"
    assert language.predict(frame(spark, []), model).count() == 0


def test_prediction_ignores_language_and_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    a = [r["lang_pred"] for r in language.predict(docs.orderBy("doc_id"), model).orderBy("doc_id").collect()]
    b = [r["lang_pred"] for r in language.predict(docs.withColumn("lang", F.lit("xx")), model).orderBy("doc_id").collect()]
    assert a == b


# 3 ------------------------------------------------------------------------------------------------------------------
def brute_quality(t):
    t = t or ""
    words = regex.findall(r"[^\x20\x09-\x0D]+", t)
    spans = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = collections.Counter(spans)
    hit = {k + j for k, s in enumerate(spans) if count[s] > 1 for j in range(3)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if regex.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


def test_quality_measures(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD + ["a b c a b c\nx\nx\n\n"]
    rows = quality.clean_lines(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        assert tuple(r[c] for c in quality._FIELDS[:6]) == brute_quality(t)
        assert not (r["kept"] and r["base_failed"])
    assert quality.clean_lines(frame(spark, [])).count() == 0


def test_quality_removes_lines_then_documents(spark):
    rng = random.Random(1)
    good = prose(rng, 80)
    mostly = "\n".join([good] + ["Home | Menu | Login | Contact |"] * 1 + ["All rights reserved."])
    junk = "\n".join([prose(rng, 20)] + [" ".join(w + "###" for w in prose(rng, 100).split())])
    docs = frame(spark, [good, mostly, junk])
    kept = {r["doc_id"]: r["text"] for r in quality.keep_clean(docs).collect()}
    assert kept == {0: good, 1: good}


# 4 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_tiff_round_trips(how, kind):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 9, (37, 50)).astype(kind), rng.integers(0, 250, (16, 16, 3)).astype(kind), np.zeros((1, 64), kind)]
    for pred in (1, 2):
        for layout in ({"rows": 7}, {"tile": 16}, {}):
            for order in "<>":
                got = list(tiff.read_pages(tiff.write_pages(pages, how, pred, order=order, **layout)))
                assert len(got) == 3
                for p, g in zip(pages, got):
                    assert (g[5] == p.reshape(*p.shape[:2], -1)).all() and g[5].dtype == kind


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 3))
def test_codecs(raw, times):
    raw *= 1 + 7 * times
    assert tiff.unpack_bits(tiff.pack_bits(raw)) == raw
    assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw


def test_known_strips():
    """The worked example of PackBits, and the LZW example of the format's description."""
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.lzw_decode(tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw


def test_media_features(spark):
    texts = [*ODD, "é" * 3_000_000, ODD[5]]
    rows = tiff.page_features(tiff.pages(tiff.store_texts(frame(spark, texts)))).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(pad))
        assert r["payload_sha256"] == hashlib.sha256(pad).hexdigest() and r["tail_crc32"] == zlib.crc32(pad[-64:])
    assert rows[5][1:] == rows[-1][1:]
    bad = tiff.pages(spark.createDataFrame([(1, 2, b"nonsense"), (2, None, None)], "doc_id long, n_bytes long, media binary")).collect()
    assert all(r["error"] and r["page"] is None for r in bad)


# 5 ------------------------------------------------------------------------------------------------------------------
def brute_scores(texts, lex, weights):
    """Sum of each text's log-probabilities, a token at a time, from all counts."""
    def split(t):  # white space by Unicode, lower case letter by letter
        return [w for w in regex.split(r"[\s\x1c-\x1f]+", "".join(c.lower()[0] for c in t or "")) if w]

    net, counts = scoring.Network(weights), collections.Counter(w for t in texts for w in split(t))
    assert lex.common == sorted(counts, key=lambda w: (-counts[w], w))[: len(lex.common)]
    own = {w: k for k, w in enumerate(lex.common[: scoring.OWN])}
    klass = {w: own.get(w, scoring.OWN + scoring.rare_class(w)) for w in counts}
    tokens, once = collections.Counter(), collections.Counter()
    for w, n in counts.items():
        tokens[klass[w]] += n
        once[klass[w]] += n == 1
    assert all(lex.tokens[c - scoring.OWN] == n for c, n in tokens.items() if c >= scoring.OWN)
    out = []
    for t in texts:
        ws, total = split(t), 0.0
        for k, w in enumerate(ws):
            around = [klass[ws[j]] if 0 <= j < len(ws) else scoring.CLASSES for j in (k - 2, k - 1, k + 1, k + 2)]
            hidden = np.tanh(sum(net.enter[i][c] for i, c in enumerate(around)).astype(float))
            g, m = divmod(klass[w], scoring.GROUPS)
            for z, j in ((hidden @ net.out + net.bias, g), (hidden @ net.inner[g] + net.inner_bias[g], m)):
                total += z[j] - np.log(np.exp(z).sum())
            c = klass[w]
            if c >= scoring.OWN:
                if counts[w] > 1:
                    total += np.log((1 - once[c] / tokens[c]) * (counts[w] - 1) / (tokens[c] - 1))
                else:
                    total += np.log(once[c] / tokens[c]) - (len(w.encode()) + 1) * np.log(257)
        out.append((len(ws), total))
    return out


@pytest.mark.parametrize("common", [scoring.COMMON, 250])
def test_scores_by_brute_force(spark, sf, common):
    """With all words common, and with most words joined; repeated rows, null ids, odd texts."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ODD
    rows = [(k, t, 0) for k, t in enumerate(texts)] + [(3, texts[3], 0), (3, texts[3], 0), (None, texts[4], 0), (3, texts[5], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    counts = scoring.word_counts(docs)
    lex = scoring.lexicon(counts, common)
    weights = scoring.train(docs, lex, batch=64)
    got = sorted(((r["doc_id"], r["n_tokens"], r["pseudo_log_likelihood"]) for r in scoring.score(docs, lex, counts, weights).collect()), key=str)
    want = sorted(((d, n, s) for (d, _, _), (n, s) in zip(rows, brute_scores([t for _, t, _ in rows], lex, weights))), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-3 + 1e-5 * g[1]


def test_scores_do_not_depend_on_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50).coalesce(1).cache()
    lex = scoring.lexicon(scoring.word_counts(docs))
    weights = scoring.train(docs, lex)
    assert (weights == scoring.train(docs, lex)).all()
    counts = scoring.word_counts(docs)
    a = sorted(map(tuple, scoring.score(docs, lex, counts, weights).collect()))
    b = sorted(map(tuple, scoring.score(docs.repartition(5), lex, counts, weights).collect()))
    for x, y in zip(a, b, strict=True):  # but for the last digit of 32-bit outputs, which follow the batch
        assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 * abs(x[2]) + 1e-4


def test_pseudo_likelihood(spark):
    rng = random.Random(5)
    order = ["the", "cat", "sat", "on", "a", "mat"]
    regular = [" ".join(order[(k + j) % 6] for j in range(300)) for k in range(40)]
    mixed = " ".join(rng.choice(order) for _ in range(300))
    docs = frame(spark, regular + [mixed, None, "", "cat"])
    counts = scoring.word_counts(docs)
    lex = scoring.lexicon(counts)
    assert set(lex.common) == set(order)
    rows = scoring.score(docs, lex, counts, scoring.train(docs, lex, rounds=2, batch=64)).orderBy("doc_id").collect()
    assert rows[0]["mean_log_probability"] > rows[40]["mean_log_probability"] + 0.5
    assert rows[41]["n_tokens"] == 0 and rows[42]["mean_log_probability"] is None and rows[43]["n_tokens"] == 1
    assert scoring.fit_and_score(frame(spark, [])).count() == 0
    around = scoring.windows(np.array([5, 6, 7, 8, 9]), np.array([0, 2, 2, 5]), 0, 5)
    end = scoring.CLASSES
    assert around.tolist() == [[end, end, 6, end], [end, 5, end, end], [end, end, 8, 9], [end, 7, 9, end], [7, 8, end, end]]


def test_document_found_twice_scores_above_its_like(spark):
    rng = random.Random(8)
    texts = [prose(rng, 200, 10**6) for _ in range(60)]
    rows = scoring.fit_and_score(frame(spark, texts + texts[:5])).collect()
    twice = [r["mean_log_probability"] for r in rows if r["doc_id"] < 5 or r["doc_id"] >= 60]
    assert min(twice) > max(r["mean_log_probability"] for r in rows if 5 <= r["doc_id"] < 60)


def test_gradient():
    net = scoring.Network()
    rng = np.random.default_rng(0)
    around, target = rng.integers(0, 256, (64, 4)), rng.integers(0, 256, 64)
    before = net.log_probability(around, target).mean()
    for _ in range(20):
        net.train(around, target, 0.5)
    assert net.log_probability(around, target).mean() > before + 0.3


# 6 ------------------------------------------------------------------------------------------------------------------
def brute_fingerprint(t):
    import xxhash

    w = regex.findall(r"[^\x20\x09-\x0D]+", regex.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, sf):
    rng = random.Random(9)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD
    base = prose(rng, 300, 5000).split()
    for k in range(40):
        w = list(base)
        w[rng.randrange(300)] = f"new{k}"
        texts.append(" ".join(w))
    rows = simhash.near_duplicates(frame(spark, texts)).collect()
    fps = [brute_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{fps[k]:016x}", find(k)) for k in range(len(texts))}
    left = {r["doc_id"] for r in simhash.keep_one(frame(spark, texts)).collect()}
    assert left == {find(k) for k in range(len(texts))}


def test_anchors_meet():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63)) * 2 + 1
        b = a
        for p in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= 1 << int(p)
        row, key = simhash.anchors(np.array([a, b], np.uint64).view(np.int64))
        assert set(key[row == 0]) & set(key[row == 1])
        assert len(set(key[row == 0])) == (row == 0).sum() <= 32


def test_large_sets_are_parted():
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, 21_000).astype(np.uint64)
    fps[1000:1200] = fps[:200] ^ np.uint64(1 << 17 | 1 << 40 | 1)
    root = simhash.groups(fps)
    assert (root[1000:1200] == np.arange(200)).all() and (root[1200:] == np.arange(1200, 21_000)).all()
    few = fps[:3000]
    assert (simhash.groups(few) == simhash._spread(few, 3)).all()


def test_simhash_edges(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(None, None), (3, ""), (2, " ")], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in rows} == {2} and {r["fingerprint"] for r in rows} == {"0" * 16}


# 7 ------------------------------------------------------------------------------------------------------------------
def covered(texts, n):
    """Word places of each text that lie in some passage of n words found elsewhere too."""
    where = collections.defaultdict(list)
    split = [(t or "").split() for t in texts]
    for k, w in enumerate(split):
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].append((k, i))
    out = [set() for _ in texts]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                out[k].update(range(i, i + n))
    return out


def test_spans_cover_all_repeats(spark):
    rng = random.Random(12)
    passages = [prose(rng, n, 10**6) for n in (50, 51, 60, 75, 130, 400)]
    texts = [prose(rng, rng.randrange(5, 300), 10**6) for _ in range(60)]
    for k, p in enumerate(passages):
        for j in rng.sample(range(60), 2 + 3 * k):
            w = texts[j].split()
            at = rng.randrange(len(w))
            texts[j] = " ".join([*w[:at], p, *w[at:]])
    short = prose(rng, 49, 10**6)
    texts += [short + " " + prose(rng, 60, 10**6), short, texts[0], *ODD]
    want = covered(texts, 50)
    got = [set() for _ in texts]
    kept = collections.defaultdict(set)
    for r in suffixes.spans(frame(spark, texts)).collect():
        got[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
        assert r["n_words"] >= 50
        if not r["dropped"]:
            kept[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
    for g, w in zip(got, want):
        assert g == w
    out = {r["doc_id"]: r["text"] for r in suffixes.cut_repeats(frame(spark, texts)).collect()}
    assert len(out) == len(texts)
    for p in passages:  # a copy that another passage interrupts is not whole; its parts may meet when that is cut
        assert sum(t.count(p) for t in out.values() if t) == 1
    clean = [k for k, w in enumerate(want) if not w]
    assert clean and all(out[k] == texts[k] for k in clean)
    assert suffixes.spans(frame(spark, [])).count() == 0


# 8 and 10 -----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def word_file():
    return q.tokenizer_file("word_bpe_49k.json")


def plain_ids(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("aBcÉßİΣσςﬁ'é ,.!1\u0301", max_size=30)), max_size=5))
def test_chunks_encode_as_whole_texts(texts):
    path = q.tokenizer_file("word_bpe_49k.json")
    got = [np.frombuffer(x, "<u4").tolist() for x in WordEncoder(path, most=3).encode(texts)]
    assert got == plain_ids(path, texts)


def test_packing(spark, sf, word_file):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD + [prose(random.Random(1), 9000)]
    ids = [x + [2] for x in plain_ids(word_file, texts)]
    rows = packing.pack(frame(spark, texts), word_file).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, x in enumerate(ids):
        at = 0
        for start, n in sorted(by_doc[k]):
            assert start == at
            at += n
        assert at == len(x)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sum(map(len, ids)) > 0.9 * 4096 * (len(by_seq) - 1)
    assert packing.pack(frame(spark, []), word_file).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_patterns_place_every_length(histogram):
    got = packing.patterns(histogram, 64)
    n = collections.Counter()
    for p, c in got:
        assert sum(p) <= 64 and c > 0 and p == sorted(p, reverse=True)
        for x in p:
            n[x] += c
    assert n == collections.Counter(histogram)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=6), st.integers(0, 60), st.integers(0, 60))
def test_grammar_file(docs, a, b):
    ids = [np.array([*d, 1], "<u4") for d in docs]
    f = grammar.GrammarFile(grammar.pack_file(list(range(len(docs))), [x.tobytes() for x in ids], 49408))
    for k, x in enumerate(ids):
        assert (f.document(k) == x).all()
        i, j = sorted((min(a, len(x) - 1), min(b, len(x))))
        assert (f.stretch(k, i, j) == x[i:j]).all() or i >= j


def test_grammar_compresses_and_reads_back(spark, sf, word_file):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD
    ids = [x + [1] for x in plain_ids(word_file, texts)]
    rows = grammar.id_checksums(grammar.stored_ids(frame(spark, texts).repartition(3), word_file)).orderBy("doc_id").collect()
    at = 0
    for r, x in zip(rows, ids, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    data = grammar.pack_file(list(range(len(ids))), [np.array(x, "<u4").tobytes() for x in ids], 49408)
    assert len(data) < 1.5 * at
    assert grammar.stored_ids(frame(spark, []), word_file).count() == 0
    null = spark.createDataFrame([(5, "b c"), (None, "a")], "doc_id long, text string")
    assert [r["doc_id"] for r in grammar.stored_ids(null, word_file).orderBy("start").collect()] == [None, 5]


# 9 ------------------------------------------------------------------------------------------------------------------
def brute_lines(rows):
    def key(x):
        return regex.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))

    docs = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                docs[key(x)].add(d)
    out = {}
    for d, t in rows:
        xs = (t or "").split("\n")
        left = [x for x in xs if len(docs.get(key(x), ())) < 3 or max(docs[key(x)]) == d]
        out[d] = (len(xs), len(xs) - len(left), "\n".join(left))
    return out


def test_line_runs(spark, sf):
    rng = random.Random(2)
    pool = [f"this is shared line number {k}" for k in range(30)] + ["short", "", "  ", "\x0bTHIS is shared line number 3 ", "\xa0this is shared line number 3"]
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(80)]
    for batches in (1, 5):
        rows = lines.drop_frequent_lines(frame(spark, texts), batches).collect()
        assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in rows} == brute_lines(list(enumerate(texts)))
        assert rows[0]["kept"] == "x"
    assert lines.drop_frequent_lines(frame(spark, [])).count() == 0


def test_hot_line_and_repeated_ids(spark, monkeypatch):
    """A line of nearly all documents is joined apart; rows of one id, and of the null id, are one document."""
    monkeypatch.setattr(lines, "HOT_DOCS", 5)
    hot, warm = "this line is nearly everywhere", "this line is in four documents"
    texts = [f"{hot}\nown {k}" + (f"\n{warm}" if k % 15 == 1 else "") for k in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.drop_frequent_lines(frame(spark, texts)).collect()}
    assert got == brute_lines(rows)
    odd = [(7, f"{hot}\nx"), (7, f"{hot}\nx"), (7, f"y\n{hot}"), (None, f"{hot}\nz"), (None, hot)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    assert {r["n_dropped"] for r in lines.drop_frequent_lines(docs).collect()} == {0}
    out = lines.drop_frequent_lines(docs.unionByName(spark.createDataFrame([(9, hot)], docs.schema))).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in out) == [(0, 1), (0, 1), (7, 1), (7, 1), (7, 1), (9, 0)]


def test_runs_are_compacted(spark):
    runs = lines.LineRuns()
    for k in range(4):
        runs.add(spark.createDataFrame([(k, b"a"), (k, b"a"), (k, str(k).encode())], "did long, key binary"))
        stored = [bytes(r["key"]) for run in runs.runs() for r in run.collect()]
        assert sorted(stored) == sorted({b"a", *(str(j).encode() for j in range(k + 1))})  # a key is in one run only
        assert sum(map(len, runs.levels)) == (k + 1).bit_count()
    fresh = runs.levels[2][0].join(runs.levels[2][0].select("key").hint("merge"), "key", "left_anti")
    assert "Exchange" not in fresh._jdf.queryExecution().executedPlan().toString()
    got = {bytes(r["key"]): (r["n_docs"], r["last"]) for r in runs.frequent(1).collect()}
    assert got == {b"a": (4, 3)} | {str(k).encode(): (1, k) for k in range(4)}


# pipeline -----------------------------------------------------------------------------------------------------------
def test_pipeline(spark, sf, word_file):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(kept[name]) <= set(before)
        if name == "quality rules":
            assert set(kept[name]) == {d for d, t in before.items() if quality.measure(t)[6]}
        if name == "line dedup":
            assert kept[name] == {d: t for d, (_, _, t) in brute_lines(list(before.items())).items()}
        if name == "suffix-array dedup":
            assert set(kept[name]) == set(before)
        docs = spark.createDataFrame(out.collect(), out.schema)
    rows = corpus_pipeline.run(spark, sf).collect()
    last = kept["suffix-array dedup"]
    want = {d: len(x) + 1 for d, x in zip(last, plain_ids(word_file, last.values()))}
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == want
    assert sum(r["length"] for r in rows) == sum(want.values())
