"""SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageweave.functions.scratch import saved, small_arrow_batches
from pageweave.operators.graph import connected_components

THRESHOLD = 3
_PLACES = np.arange(1, 32, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; a bit is set if it is set in more than half of the shingles' hashes. No words: zero."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return h(b" ".join(w), 42)
    return majority(np.array([h(b" ".join(x), 42) for x in zip(*(w[k:] for k in range(shingle)))], "<u8"))


def majority(a: np.ndarray) -> int:
    """A bit is set if it is set in more than half of the hashes."""
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(a), 1 << 14):
        bits = np.unpackbits(a[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(0, dtype=np.uint16)
    return int(np.packbits(2 * set_bits > len(a), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, fp)``, the fingerprint as a signed long."""
    small_arrow_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row of the fingerprint, anchor)`` for every anchor within covering radius plus threshold.

    Two of the 64 bits are left out and the rest forms two halves of 31: fingerprints that differ in at most three
    bits differ in at most one bit of some half. A half's anchors are the words of the Hamming(31, 26) code, of
    covering radius 1, so two such halves meet at an anchor within 1 of the first and 2 of the second. The words
    within 2 of a half follow from its syndrome s: none but itself if s = 0, else flip s, or any two places whose
    exclusive or is s. An anchor's number is twice its word, plus the half.
    """
    fps = fps.view(np.uint64)
    rows, keys = [], []
    for half in (0, 1):
        v = ((fps >> np.uint64(31 * half)) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        s = np.zeros(len(v), np.int64)
        for p in range(31):
            s ^= np.where((v >> p) & 1, p + 1, 0)
        exact = np.flatnonzero(s == 0)
        rows.append(exact)
        keys.append(2 * v[exact] + half)
        off = np.flatnonzero(s)
        rows.append(off)
        keys.append(2 * (v[off] ^ (1 << (s[off] - 1))) + half)
        i = np.broadcast_to(_PLACES, (len(off), 31))
        j = i ^ s[off, None]
        ok = (j > i)
        word = v[off, None] ^ (1 << (i - 1)) ^ np.where(ok, 1 << np.maximum(j - 1, 0), 0)
        r, _ = np.nonzero(ok)
        rows.append(off[r])
        keys.append(2 * word[ok] + half)
    return np.concatenate(rows), np.concatenate(keys)


def groups(fps: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Index of the first member of each fingerprint's component under links of at most ``threshold`` bits.

    Each member looks once at those that no component has yet; a large set is first parted by four 16-bit words, one
    of which linked fingerprints share, and the parts' components are joined.
    """
    n = len(fps)
    root = np.arange(n)
    if n > 20_000 and threshold < 4:

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for word in range(4):
            v = (fps >> np.uint64(16 * word)) & np.uint64(0xFFFF)
            order = np.argsort(v, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(v[order])) + 1):
                if len(part) > 1:
                    for a, b in zip(part.tolist(), part[_spread(fps[part], threshold)].tolist()):
                        a, b = find(a), find(b)
                        root[max(a, b)] = min(a, b)
        return np.array([find(k) for k in range(n)])
    return _spread(fps, threshold)


def _spread(fps: np.ndarray, threshold: int) -> np.ndarray:
    root = np.full(len(fps), -1)
    rest = np.arange(len(fps))
    while len(rest):
        first, todo, rest = rest[0], [rest[0]], rest[1:]
        root[first] = first
        while todo and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[todo.pop()]) <= threshold
            if near.any():
                found = rest[near]
                root[found] = first
                todo += found.tolist()
                rest = rest[~near]
    return root


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(fp)``, each once -> ``(a, b)``: links that connect what lies within ``threshold`` bits at some anchor.

    Each fingerprint goes to at most 32 anchors. At an anchor, members of one component are linked to its first, so
    the rows grow with the members and not with their pairs.
    """

    def replicate(batches):
        for b in batches:
            fps = b["fp"].to_numpy()
            row, key = anchors(fps)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(key), "fp": pa.array(fps[row])})

    def compare(batches):
        held_key, held = None, []
        for b in batches:
            key, fp = b["anchor"].to_numpy(), b["fp"].to_numpy()
            if not len(key):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            out: list[tuple[np.ndarray, np.ndarray]] = []
            if key[0] == held_key:
                held.append(fp[: cuts[1]])
                cuts = cuts[1:]
            if len(cuts) > 1:
                if held:
                    out += _linked(np.concatenate(held))
                sizes = np.diff(cuts)
                for k in np.flatnonzero(sizes[:-1] > 1).tolist():
                    out += _linked(fp[cuts[k] : cuts[k + 1]])
                held_key, held = key[-1], [fp[cuts[-2] :]]
            if out:
                yield _pairs(out)
        if held and (out := _linked(np.concatenate(held))):
            yield _pairs(out)

    def _linked(fps):
        if len(fps) < 2:
            return []
        root = groups(fps.view(np.uint64), threshold)
        at = np.flatnonzero(root != np.arange(len(fps)))
        return [(fps[at], fps[root[at]])] if len(at) else []

    def _pairs(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([y for _, y in out]))], ["a", "b"]
        )

    small_arrow_batches(distinct.sparkSession, rows=10_000)
    return (
        distinct.select("fp")
        .mapInArrow(replicate, "anchor bigint, fp bigint")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(compare, "a bigint, b bigint")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``.

    The component is that of links of at most 3 bits between fingerprints; its id is its smallest ``doc_id``. Null,
    empty and wordless texts have fingerprint 0 and form a group; repeated rows are kept and share theirs; a null
    ``doc_id`` is in a component but never its id unless no other is there; other columns are ignored. Copies meet
    in one distinct fingerprint, so a large group of copies is one row in all but the last join, which Spark may
    split.
    """
    marked = saved(fingerprints(docs), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = connected_components(links(distinct))
    members = distinct.join(parts, distinct["fp"] == parts["vertex"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    members = saved(members, "members")
    ids = members.groupBy("component").agg(F.min("least").alias("component_id"))
    table = members.join(ids, "component").select("fp", "component_id")
    return marked.join(table, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents whose id is that of their component; the columns of ``docs``. Null ids stay as they are."""
    out = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)
