"""Conversation tries, main text of pages and source divergences against brute force."""

from __future__ import annotations

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest

from pageweave.functions.scan import scan, sums, xors
from pageweave.llm import conversations, divergence, html_text

# --- scan ------------------------------------------------------------------------------------------------------------


def test_scan_runs_through_partitions_batches_and_null_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), k, rng.randrange(1 << 40)) for k in range(3000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        df = spark.createDataFrame(rows, "g long, o long, v long").repartition(5)
        got = {r["o"]: (r["s"], r["n"]) for r in scan(df, ["g"], ["o"], **sums(s="v", n="1"), name="t").collect()}
        mixed = {r["o"]: r["x"] for r in scan(df, ["g"], ["o"], **xors(x="v"), name="t").collect()}
        whole = {r["o"]: r["n"] for r in scan(df, [], ["o"], **sums(n="1"), name="t").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    total, n, xor = Counter(), Counter(), Counter()
    for g, o, v in rows:
        total[g] += v
        n[g] += 1
        xor[g] ^= v
        assert got[o] == (total[g], n[g]) and mixed[o] == xor[g]
    assert whole == {k: k + 1 for k in range(3000)}


# --- op11 ------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append(((turn is not None, turn or 0), role.encode(), text[:32].encode(), text, role))
    own = {c: [(x[4], x[3]) for x in sorted(v, key=lambda x: x[:4])] for c, v in by.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, depth long, id string"


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, conversations.prefix_trie(df.repartition(3)).collect()), key=str)


def test_trie_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "", None, "ccc é"])) for c in range(330) for t in range(rng.randrange(9))]
    rows += [(900, None, "user", "null first"), (900, 0, "user", "x"), (900, 0, "user", "x"), (None, 1, "user", "nobody")]
    rows += [(c, 0, "user", "same") for c in range(500, 560)] + [(1201, 0, "user", "without a first")]
    assert trie(spark, rows) == brute_trie(rows)


def test_deep_conversation_and_small_chunks(spark, monkeypatch):
    """One conversation with nearly all turns, and a list so long that it is spliced by coins."""
    rows = [(100, t, "u", str(t % 3)) for t in range(400)] + [(150, t, "u", str(t % 3)) for t in range(40)]
    monkeypatch.setattr(conversations.ranked, "__defaults__", (64,))
    assert trie(spark, rows) == brute_trie(rows)


@pytest.mark.parametrize("chunk", [4, 50, 1 << 16])
def test_list_ranking(spark, chunk):
    ids = list(range(0, 3000, 3))
    random.Random(2).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, [*ids[1:], None], strict=True)), "arc long, succ long")
    assert {r["arc"]: r["place"] for r in conversations.ranked(df, max(chunk, 50) if chunk != 4 else 300).collect()} == {a: k for k, a in enumerate(ids)}


def test_empty_conversations(spark):
    assert trie(spark, []) == []


# --- op12 ------------------------------------------------------------------------------------------------------------


def prose(rng, n):
    return " ".join(rng.choice(["the", "naïve", "&amp;", "plan", "moved", "x&#33;", "over", "&lt;b&gt;", "sea"]) for _ in range(n)) + "."


def page(rng, wrap):
    blocks = [prose(rng, rng.choice([1, 3, 40, 120])) for _ in range(rng.randrange(3, 12))]
    blocks[rng.randrange(len(blocks))] = prose(rng, 150)
    body = f"<h1>{blocks[0]}</h1>"
    for k, b in enumerate(blocks[1:]):
        body += rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br><p>", "\n<blockquote>{}</blockquote>\n", "<ul><li>{}</ul>"]).format(b)
        if k % 3 == 1:
            body += rng.choice(["<div class='ad-slot'>Buy {}</div>", "<aside>{}</aside>", "<form><input name=q>{}</form>", "<script>var p='</p>{}'</script>"]).format(prose(rng, 9))
    noise = prose(rng, 40)
    before = f"<header><a href='/'>Site</a> {noise}</header><nav><ul>" + "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(8)) + "</ul></nav>"
    before += f"<div id='cookie-notice'>{noise}</div><!-- {noise} --><style>p > a {{}}</style>"
    after = f"<section id='comments'><h2>Comments</h2><div class='comment'>{prose(rng, 300)}</div></section><div class='sidebar'>{noise}</div><footer>&copy; {noise}</footer>"
    text = " ".join(html.unescape(b) for b in blocks)
    return f"<!DOCTYPE html><html><head><title>{noise}</title></head><body class='has-sidebar'>{before}{wrap.format(body)}{after}</body></html>", " ".join(text.split())


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div role='main'>{}</div>", "<div class='text'>{}</div>", "{}"])
def test_main_text_of_known_pages(spark, wrap):
    rng = random.Random(wrap)
    pages, want = zip(*[page(rng, wrap) for _ in range(40)], strict=True)
    df = spark.createDataFrame([(k, "u", p, "old") for k, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    for k, w in enumerate(want):
        assert got[k]["text"] == w and got[k]["n_chars"] == len(w)


def test_pages_without_marks_by_the_distribution_alone():
    long = "Words of the article go on for a while here, as they do. " * 4
    links = "".join(f"<div><a href='/{k}'>Some other page {k}</a></div>" for k in range(9))
    got = html_text.main_text(f"<div>{links}</div><div><p>{long}</p><p>Short.</p><p>{long}</p></div><div>{links}</div><div>Tail</div>")
    assert got == " ".join(f"{long} Short. {long}".split())


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "<p>a<i>b</i>c"), (3, ""), (4, "no markup &amp  here")], "page_id long, html string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, "", 0), (1, "", 0), (None, "abc", 3), (3, "", 0), (4, "no markup & here", 16)], key=str)
    assert html_text.extract(df.limit(0)).collect() == []
    assert html_text.main_text("<form><p>All stands in a form</p></form>") == "All stands in a form"
    assert html_text.main_text("<nav><a href=x>q</a><article><p>Never closed</p></article>") == "Never closed"


@pytest.mark.parametrize("part", ["<a ", "<", "<!--", "<p class='", "<div>", "<div class=ad>", "<script>", "&", "<span class=ad>", "</b>", "<article>"])
def test_very_long_pages_take_linear_time(part):
    began = time.process_time()
    html_text.main_text(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 20


# --- op13 ------------------------------------------------------------------------------------------------------------


def brute_divergences(rows, least=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        sources = [s for g, s in groups if g == lang]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(found, 1) if part == "pair" or k <= 10]
    return sorted(out)


@pytest.mark.parametrize("slots", [1, 7])
def test_divergences_equal_brute_force(spark, slots):
    rng = random.Random(slots)
    words = ["the", "The", "É", "é", "don't", "a1b2", "x_y", "[z]", "日本", "~", "rare"] + [f"w{c}{d}" for c in "abcdef" for d in "ghijk"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s1", None, "ß", "S"])) for _ in range(300)]
    rows += [(None, "en", "silent"), ("", "xx", "a"), ("one", "xx", "b"), (None, "yy", None), ("z" * 50_000, "en", "s1")] + [rows[0]] * 12
    df = spark.createDataFrame([(k, *r, "clash") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string")
    got = sorted(tuple(r) for r in divergence.divergences(df.repartition(3), slots=slots).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_divergences(rows)


def test_stripes_given_away_early_and_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(" ".join(f"w{chr(97 + rng.randrange(20))}" for _ in range(50)), "en", f"s{k % 3}") for k in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    few = divergence.merged(divergence.stripes(df, entries=15), 10)
    many = divergence.merged(divergence.stripes(df), 10)

    def plain(x):
        return sorted((r["term"], sorted((s["source"], s["n"]) for s in r["at"])) for r in x.collect())

    assert divergence.stripes(df, entries=15).count() > divergence.stripes(df).count() and plain(few) == plain(many)
    text = ("word " * 30 + "é" * 40 + " ") .encode() * 3
    monkeypatch.setattr(divergence, "_PIECE", 16)
    assert [t for p in divergence._pieces(text) for t in p] == text.split()


def test_no_documents(spark):
    assert divergence.divergences(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
