from __future__ import annotations

import random

import pytest

from pageweave.llm import quality


def prose(n):
    rng = random.Random(7)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.mark.parametrize("phrase", ["the privacy policy", "some JavaScript", "its terms of service", "a | b | c | d"])
def test_long_clean_line_may_name_a_phrase(spark, phrase):
    text = f"{prose(60)} {phrase} {prose(60)[::-1]}"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r["text"] for r in quality.keep_clean(docs).collect()] == [text]


def test_lines_of_such_phrases_still_fail():
    for line in ("Read our privacy policy.", "Home | Menu | Login |", "Home | Menu | News > " * 20, "lorem ipsum " * 40, "all rights reserved " * 20):
        assert quality.line_fails(line)


def test_repeated_words_by_brute_force():
    import collections

    rng = random.Random(3)
    for _ in range(300):
        w = [b"%d" % rng.randrange(rng.choice((2, 5, 40))) for _ in range(rng.randrange(60))]
        n = collections.Counter(zip(w, w[1:], w[2:]))
        want = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if n[x] > 1 for j in range(3)}
        assert quality.repeated_words(w) == len(want)
    assert quality.repeated_words([b"word"] * 1_000_000) == 1_000_000  # very long, in a few arrays
