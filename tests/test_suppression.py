from __future__ import annotations

import random

import pytest

from pageweave.operators import boxes

DETS = "doc_id long, pi long, id long, class_id long, confidence double, x1 long, y1 long, x2 long, y2 long"


def brute(rows, thr=0.3):
    kept = []
    for r in sorted((r for r in rows if r[3] and r[4] is not None and r[4] >= 0.1), key=lambda r: (-r[4], r[2])):
        for k in kept:
            w, h = min(r[7], k[7]) - max(r[5], k[5]), min(r[8], k[8]) - max(r[6], k[6])
            inter = max(w, 0) * max(h, 0)
            union = (r[7] - r[5]) * (r[8] - r[6]) + (k[7] - k[5]) * (k[8] - k[6]) - inter
            if r[:2] == k[:2] and union > 0 and inter / union >= thr:
                break
        else:
            kept.append(r)
    return sorted(kept)


def some(n, seed, span):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rng.randrange(span), rng.randrange(60)
        out.append((k % 3, k % 2, k, rng.randrange(4), rng.choice([0.05, 0.2, 0.5, 0.5, 0.9, None, rng.random()]), x, y, x + rng.randrange(60), y + rng.randrange(40)))
    return out


@pytest.mark.parametrize(("largest", "span"), [(1 << 17, 200), (3, 200), (1 << 17, 40)])
def test_nms_equals_greedy_order(spark, monkeypatch, largest, span):
    """With components settled by one task, and with rounds alone."""
    monkeypatch.setattr(boxes, "COMPONENT", largest)
    rows = some(200, span, span)
    got = boxes.nms(spark.createDataFrame(rows, DETS), ["doc_id", "pi"]).collect()
    assert sorted(map(tuple, got)) == brute(rows) and 0 < len(got) < 200
    assert boxes.nms(spark.createDataFrame([], DETS), ["doc_id", "pi"]).count() == 0


@pytest.mark.parametrize("largest", [1 << 17, 2])
def test_long_row_of_neighbours(spark, monkeypatch, largest):
    """Boxes in a row, each over the next and better than it: every second one stays."""
    monkeypatch.setattr(boxes, "COMPONENT", largest)
    n = 40 if largest > 2 else 14
    rows = [(0, 0, k, 1, 1 - k / 100, 10 * k, 0, 10 * k + 18, 10) for k in range(n)]
    got = boxes.nms(spark.createDataFrame(rows, DETS), ["doc_id", "pi"], thr=0.2).collect()
    assert sorted(r["id"] for r in got) == list(range(0, n, 2))
