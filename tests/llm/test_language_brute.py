"""Language mixtures against a plain, one-document-at-a-time expectation-maximisation."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

from pageweave.llm import language


def trigrams(text):
    """Letter trigrams of the lower-cased text, each run of other characters one space, a space at both ends; middle letters only."""
    out, last = [" "], " "
    for c in (text or "").lower():
        c = c if c.isalpha() else " "
        if c != " " or last != " ":
            out.append(c)
        last = c
    if out[-1] != " ":
        out.append(" ")
    return [tuple(map(ord, out[k : k + 3])) for k in range(len(out) - 2) if out[k + 1] != " "]


def bucket(t):
    return ((((t[0] << 42) ^ (t[1] << 21) ^ t[2]) * 0x9E3779B97F4A7C15) % (1 << 64)) >> 49


def fitted(rows):
    counts = defaultdict(Counter)
    for doc, text, lang in rows:
        if lang is not None and doc is not None and zlib.crc32(str(doc).encode()) % 4 != 2:
            counts[lang].update(map(bucket, trigrams(text)))
    counts = {k: v for k, v in counts.items() if v}
    return {k: (lambda b, v=v, t=sum(v.values()) + 0.5 * language.BUCKETS: (v[b] + 0.5) / t) for k, v in counts.items()}


def em(features, model, mix, rounds):
    total = sum(features.values())
    for _ in range(rounds):
        new = dict.fromkeys(mix, 0.0)
        for b, n in features.items():
            part = {x: mix[x] * model[x](b) for x in mix}
            whole = sum(part.values())
            for x in mix:
                new[x] += n * part[x] / whole
        mix = {x: v / total for x, v in new.items()}
    return mix, sum(n * math.log(sum(mix[x] * model[x](b) for x in mix)) for b, n in features.items())


def shares(text, model):
    features = Counter(map(bucket, trigrams(text)))
    if not features:
        return {}
    n = sum(features.values())
    mix, like = em(features, model, {x: 1 / len(model) for x in sorted(model)}, 12)
    cost = -2 * like + 4 * len(mix) * math.log(n + 1)
    while len(mix) > 1:
        worst = min(mix, key=lambda x: (mix[x], x))
        begin = {x: v + 1e-3 for x, v in mix.items() if x != worst}
        begin = {x: v / sum(begin.values()) for x, v in begin.items()}
        trial, like = em(features, model, begin, 12)
        now = -2 * like + 4 * len(trial) * math.log(n + 1)
        if now > cost:
            break
        mix, cost = trial, now
    return mix


def test_mixture_equals_brute_force(spark):
    rng = random.Random(9)
    parts = {"aa": "ka ro mi tel ona", "bb": "sch ung eit ver ich", "cc": "ção nha lhe ões mão", "dd": "ent ous eau eux tion"}
    word = lambda lang: "".join(rng.choice(parts[lang].split()) for _ in range(rng.randrange(1, 4)))
    rows = []
    for k in range(120):
        langs = rng.sample(sorted(parts), rng.choice([1, 1, 1, 2]))
        text = rng.choice([" ", ", ", " 12 "]).join(word(rng.choice(langs)) for _ in range(rng.randrange(1, 60)))
        rows.append((k, text, rng.choice([langs[0], langs[0], None])))
    rows += [rows[0], rows[0], (200, None, "aa"), (201, "", None), (202, " 7 ! ", "bb"), (None, rows[3][1], "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fitted(rows)
    langs, logp = language.fit(docs)
    assert langs == sorted(model)
    for k, x in enumerate(langs):
        for b in (0, 77, *map(bucket, trigrams("karo schung"))):
            assert abs(logp[k, b] - math.log(model[x](b))) < 1e-5
    got = sorted(language.predict(docs, (langs, logp)).collect(), key=str)
    assert len(got) == len(rows)
    want = defaultdict(list)
    for doc, text, _ in rows:
        s = shares(text, model)
        best = max(sorted(s), key=lambda x: s[x]) if s else "und"
        want[doc].append((best, s.get(best, 0.0), len(s)))
    for r in got:
        label, score, n = want[r["doc_id"]][0]
        assert (r["lang_pred"], r["n_langs"]) == (label, n) and abs(r["score"] - score) < 1e-4
        assert r["held_out"] == (None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
