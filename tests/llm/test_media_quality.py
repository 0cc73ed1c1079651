"""The stored media of texts in every layout, features and line verdicts against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from pageweave.llm import quality, tiff


def test_every_layout_gives_the_payload_back_and_the_feature_is_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "a" * 64, "é" * 5000, "x" * 70_000] + [" ".join(rng.choice(["the", "sea", "ß", "\U0001f600", "\n"]) for _ in range(rng.randrange(400))) for _ in range(90)]
    texts += texts[:6]
    ids = [None if k == 7 else k for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, media string")
    rows = tiff.page_features(tiff.pages(tiff.store_texts(docs, page_rows=200))).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) and len(got) == len(texts)
    used, files = set(), {}
    for i, t in zip(ids, texts, strict=True):
        raw = (t or "").encode()
        n = len(raw)
        raw += b"\0" * (max(64, -(-n // 64) * 64) - n)
        used.add(zlib.crc32(raw) % len(tiff.LAYOUTS))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        stretches = [raw[k * len(raw) // 16 : (k + 1) * len(raw) // 16] for k in range(16)]
        assert r["feature"] == "".join(f"{sum(s) // len(s):02x}" for s in stretches) + f"{min(raw):02x}{max(raw):02x}"
        assert files.setdefault(t or "", r["media_sha256"]) == r["media_sha256"]
    assert len(used) == len(tiff.LAYOUTS)
    assert tiff.page_features(tiff.pages(tiff.store_texts(docs.limit(0)))).collect() == []


def test_layouts_of_the_query_are_read_back():
    image = np.frombuffer(np.random.default_rng(1).integers(0, 255, 64 * 300, np.uint8).tobytes(), np.uint8).reshape(-1, 64)
    for layout in tiff.LAYOUTS:
        (page,) = list(tiff.read_pages(tiff.write_pages([image], **layout)))
        assert (page[-1].reshape(300, 64) == image).all()


def fails(line):
    """The rules as their docstring says, written another way."""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", line) if w]
    if not words:
        return False
    chars = sum(map(len, words))
    if 5 * sum(c in "#*$%&|<>" for c in line) > chars:
        return True
    if 2 * sum(w[-1] in "#*$%&|<>" or w[-2:] == "!!" for w in words) > len(words):
        return True
    low = line.lower()
    if quality.NAVIGATION.fullmatch(low.strip()):
        return True
    count = lambda s: sum(1 for c in s if c not in " \t\n\x0b\x0c\r")
    cut = [m.start() for m in re.finditer("[|»>]", low)]
    items, last = [], 0
    for k in cut:
        items.append(low[last:k])
        last = k + 1
    items = [x for x in items if 1 <= len(x.split()) <= 3]
    menu = 0
    if len(items) >= 3:
        menu = sum(count(x) + 1 for x in items) + (count(low[last:]) if len(low[last:].split()) <= 3 else 0)
    phrases = sum(count(m.group()) for m in quality.BOILERPLATE.finditer(low))
    most = max(menu, phrases)
    return most > 0 and 10 * most >= 3 * chars


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["Home | News | Contact us | Help", "privacy policy", "all rights reserved", "a plain line of words that says something", "#### $$", "wow!! yes!! so!!", "Login", "x > y > z", "", "javascript", "Menu »"]
    lines = [rng.choice(bits) + rng.choice(["", " " + " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(40)))]) for _ in range(600)]
    assert [quality.line_fails(x) for x in lines] == [fails(x) for x in lines] and 0 < sum(map(fails, lines)) < 600
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(12))) for _ in range(120)] + [None, ""]
    got = {r["doc_id"]: r for r in quality.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        chars = lambda s: sum(1 for c in s if c not in " \t\n\x0b\x0c\r")
        left = "\n".join(x for x in (t or "").split("\n") if not fails(x))
        lost = chars(t or "") - chars(left)
        assert got[k]["kept"] == (not got[k]["base_failed"] and 2 * lost <= chars(t or ""))
        assert got[k]["clean_text"] == left


@pytest.mark.parametrize("unit", ["a", "| ", "a | ", "a>", "privacy policy ", "!! ", "home ", "»"])
def test_lines_of_a_megabyte(unit):
    began = time.process_time()
    quality.line_fails(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 1


def test_prose_that_names_a_phrase_stays_whatever_its_length():
    for n in (29, 30, 31, 500):
        assert not quality.line_fails(" ".join(["we", "changed", "our", "privacy", "policy", "in", "spring"] + ["word"] * (n - 7)))
