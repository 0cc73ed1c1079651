"""Audit of sources: how far the words of each source of a language stand from those of the others and of the whole.

Partitions fold whole documents into stripes, a term with its document frequency and its count in every source; stripes are
given away whenever they fill the memory meant for them, and merged by their key. The merged stripes emit the divergences.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageweave.functions.scratch import saved

#: Bytes of a term: all but 00-40, 5B-60 and 7B-7F, which part terms; A-Z become a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_STRIPES = "lang string, term string, docs long, sources array<string>, counts array<long>"
_ARROW = pa.schema(
    [("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()),
     ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
)
#: Bytes of a text that are parted at once.
_PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, some at a time, so that a very long text never stands as one list."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        folded = text[at:end].translate(_FOLD)
        while end < len(text) and folded[-1] != 0x20:  # a term goes on
            more = text[end : end + _PIECE].translate(_FOLD)
            cut = more.find(b" ")
            folded += more if cut < 0 else more[: cut + 1]
            end += len(more) if cut < 0 else cut + 1
        yield folded.split()
        at = end


class _Fold:
    """The stripes of a partition: of each language the documents of a term, and its count in each source."""

    def __init__(self) -> None:
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

    def add(self, lang: str, source: str, text: bytes) -> None:
        count, had = self.counts[lang][source], set()
        for terms in _pieces(text):
            count.update(terms)
            had.update(terms)
        self.docs[lang].update(had)

    def size(self) -> int:
        return sum(map(len, self.docs.values())) + sum(len(c) for by in self.counts.values() for c in by.values())

    def stripes(self) -> Iterator[pa.RecordBatch]:
        for lang, docs in self.docs.items():
            rows: dict[bytes, list] = {}
            for source, counts in self.counts[lang].items():
                for term, n in counts.items():
                    rows.setdefault(term, []).append((source, n))
            terms = list(rows)
            for k in range(0, len(terms), 20_000):
                some = terms[k : k + 20_000]
                at = [rows[t] for t in some]
                ends = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
                flat = [x for row in at for x in row]
                cells = [
                    pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([docs[t] for t in some], pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array([s for s, _ in flat], pa.string())),
                    pa.ListArray.from_arrays(ends, pa.array([n for _, n in flat], pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cells, schema=_ARROW)


def stripes(docs: DataFrame, entries: int = 400_000) -> DataFrame:
    """``lang, term, docs, sources, counts`` as folded by each partition; a key occurs once per fold that was given away.

    ``entries``: counts a partition holds before it gives its stripes away.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Fold()
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                held.add(lang, source, memoryview(text.as_buffer()).tobytes())
                if held.size() > entries:
                    yield from held.stripes()
                    held = _Fold()
        yield from held.stripes()

    rows = docs.select(*_group(), F.coalesce("text", F.lit("")).cast("binary"))
    return rows.mapInArrow(fold, _STRIPES)


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def merged(parts: DataFrame, least: int) -> DataFrame:
    """One stripe a key (``lang, term, at``: structs of source and count), of terms in at least so many documents."""
    pairs = F.arrays_zip("sources", "counts")
    own = F.array(F.struct(F.lit(None).cast("string").alias("sources"), F.col("docs").alias("counts")))
    rows = parts.repartition("lang", "term").select("lang", "term", F.explode(F.concat(own, pairs)).alias("x"))
    sums = rows.groupBy("lang", "term", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    whole = sums.groupBy("lang", "term").agg(
        F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("docs"),
        F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))).alias("at"),
    )
    return whole.filter(F.col("docs") >= least).select("lang", "term", "at")


def _share(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)) by long division, three digits a step: exact up to 10^15 words."""
    over = total + 2 * terms
    rest, out = count + 2, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // over, rest % over
    return 1 + out


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Below 10^18 + 1 before the division, so 64 bits are exact."""
    return (p - q) * (p - q) // (p + q)


_OUT = "lang string, source string, part string, items array<string>, values array<long>"
_OUT_ARROW = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()),
     ("items", pa.list_(pa.string())), ("values", pa.list_(pa.int64()))]
)


class _Slot:
    """The groups of a language, and what a share of its stripes adds to their divergences."""

    def __init__(self, lang: str, slot: int, top: int) -> None:
        self.lang, self.top, self.names, self.totals, self.terms = lang, top, [], [], 0
        self.ready, self.pairs = False, slot == 0

    def group(self, source: str, total: int, terms: int) -> None:
        self.names.append(source)
        self.totals.append(total)
        self.terms = terms

    def begin(self) -> None:
        """All groups are there."""
        if self.ready:
            return
        n = len(self.names)
        self.place = {s: k for k, s in enumerate(self.names)}
        self.total = np.array(self.totals, np.int64)
        self.sums = np.zeros((n, n), np.int64)
        self.best: list[list] = [[] for _ in range(n)]
        self.step = max(1, (1 << 20) // max(n, 1))
        self.words: list[str] = []
        self.at: list[list] = []
        self.ready = True

    def stripe(self, term: str, at: list) -> None:
        self.begin()
        self.pairs = True
        self.words.append(term)
        self.at.append(at)
        if len(self.words) >= self.step:
            self.work()

    def work(self) -> None:
        if not self.words:
            return
        n = len(self.names)
        rows = np.repeat(np.arange(len(self.at)), [len(x) for x in self.at])
        cols = np.fromiter((self.place[x["source"]] for a in self.at for x in a), np.int64, len(rows))
        count = np.zeros((len(self.at), n), np.int64)
        count[rows, cols] = np.fromiter((x["n"] for a in self.at for x in a), np.int64, len(rows))
        p = _share(count, self.total, self.terms)
        for k in range(n - 1):
            self.sums[k, k + 1 :] += _apart(p[:, k : k + 1], p[:, k + 1 :]).sum(axis=0)
        q = _share(count.sum(axis=1), self.total.sum(), self.terms)[:, None]
        value = np.where((count > 0) & (p > q), _apart(p, q), -1)
        for k in range(n):
            self._rank(k, value[:, k])
        self.words, self.at = [], []

    def _rank(self, k: int, value: np.ndarray) -> None:
        has = np.flatnonzero(value >= 0)
        if len(has) > self.top:  # all that reach the last place, ties included
            has = has[value[has] >= np.partition(value[has], -self.top)[-self.top]]
        found = self.best[k] + [(-int(value[i]), self.words[i].encode()) for i in has]
        self.best[k] = heapq.nsmallest(self.top, found)

    def result(self) -> Iterator[pa.RecordBatch]:
        self.begin()
        self.work()
        both = self.sums + self.sums.T
        for k, source in enumerate(self.names):
            others = [i for i in range(len(self.names)) if i != k]
            if others and self.pairs:
                yield self._row(source, "pair", [self.names[i] for i in others], both[k, others].tolist())
            if self.best[k]:
                yield self._row(source, "term", [t.decode() for _, t in self.best[k]], [-v for v, _ in self.best[k]])

    def _row(self, source: str, part: str, items: list[str], values: list[int]) -> pa.RecordBatch:
        cells = ([self.lang], [source], [part], [items], [values])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _OUT_ARROW, strict=True)], schema=_OUT_ARROW)


def divergences(docs: DataFrame, least_docs: int = 10, top: int = 10, slots: int | None = None) -> DataFrame:
    """``lang, source, part, item, value, rank``: of each occurring group (language and source) the divergence from every
    other source of its language (part ``pair``), and the terms it uses most above its language (part ``term``, to ``top``).

    A term's share of a group is 1 + floor(10^9 (count + 2) / (N + 2 V)) over the V terms that at least ``least_docs``
    documents of the language hold, N the group's count of them; shares p and q lie floor((p - q)^2 / (p + q)) apart.
    A null text, language or source is the empty string; ids, further columns and the order of rows play no part, repeated
    rows count each time, and an empty table gives no row. A language without kept terms has pairs of value 0.

    The stripes of a language are dealt by term over ``slots`` shares (a shuffle's partitions by default), so no language,
    source or term is a hot key; each share is led by the language's groups. A task holds the groups of one language, the sums of
    their pairs and a million counts. The output itself has a row for every pair.
    """
    spark = docs.sparkSession
    slots = slots or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = saved(merged(stripes(docs), least_docs), "stripes")
    size = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    counts = kept.select("lang", F.explode("at").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    groups = docs.select(*_group()).distinct().join(counts, ["lang", "source"], "left").join(size, "lang", "left")
    share = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    none = F.lit(None)
    lead = groups.select(
        "lang", share.alias("slot"), "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms"),
        none.cast("string").alias("term"), none.cast("array<struct<source:string,n:bigint>>").alias("at"),
    )
    rest = kept.select(
        "lang", F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int").alias("slot"), none.cast("string").alias("source"),
        F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("terms"), "term", "at",
    )
    rows = lead.unionByName(rest).repartition("lang", "slot").sortWithinPartitions("lang", "slot", F.col("term").isNotNull(), "source")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, slot = None, None
        for b in batches:
            for r in b.to_pylist():
                if key != (r["lang"], r["slot"]):
                    if slot:
                        yield from slot.result()
                    key = r["lang"], r["slot"]
                    slot = _Slot(*key, top)
                if r["term"] is None:
                    slot.group(r["source"], r["n"], r["terms"])
                else:
                    slot.stripe(r["term"], r["at"])
        if slot:
            yield from slot.result()

    found = rows.mapInArrow(emit, _OUT).repartition("lang", "source").sortWithinPartitions("lang", "source", "part")
    return found.mapInArrow(lambda b: _ranked(b, top), "lang string, source string, part string, item string, value long, rank int")


def _ranked(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The shares of each group and part added up (``pair``) or their best taken (``term``), with their ranks."""
    kinds = [pa.string()] * 4 + [pa.int64(), pa.int32()]
    names = ["lang", "source", "part", "item", "value", "rank"]
    key, sums = None, Counter()

    def rows() -> pa.RecordBatch:
        best = sorted(sums.items(), key=lambda x: (-x[1], x[0].encode()))
        best = best if key[2] == "pair" else best[:top]
        n = len(best)
        cells = [[key[0]] * n, [key[1]] * n, [key[2]] * n, [i for i, _ in best], [v for _, v in best], range(1, n + 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=names)

    for b in batches:
        for r in b.to_pylist():
            now = r["lang"], r["source"], r["part"]
            if now != key:
                if key:
                    yield rows()
                key, sums = now, Counter()
            for i, v in zip(r["items"], r["values"], strict=True):
                sums[i] += v
            if key[2] == "term" and len(sums) > 100 * top:  # a term stands in one share only
                sums = Counter(dict(sorted(sums.items(), key=lambda x: (-x[1], x[0].encode()))[:top]))
    if key:
        yield rows()
