"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageweave.functions.scratch import saved, small_arrow_batches
from pageweave.llm import simhash
from pageweave.operators.graph import connected_components

SHINGLE = 5
LEAST = 0.8
#: A pair of similarity s meets in some band with probability 1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: At a band's bucket a member is paired with this many first ones and as many of those just before it.
NEIGHBOURS = 4
#: Members of a bucket, and pairs of a hub, that one task takes.
CROWD, HUB = 1000, 500
#: Marks of one shingle that meet in one place at most on a side.
SALTED = 256
_RNG = np.random.default_rng(64)
_XOR, _TIMES = (_RNG.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) for _ in range(2))
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE lower-cased words; a shorter text is one run, no words none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    if len(w) <= SHINGLE:
        return np.array([h(b" ".join(w), 5)] if w else [], np.uint64)
    return np.unique(np.array([h(b" ".join(x), 5) for x in zip(*(w[k:] for k in range(SHINGLE)))], np.uint64))


def bands(marks: np.ndarray) -> list[int]:
    """One signed 64-bit value a band, of ROWS least hashes each."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(marks), 4096):
        x = (marks[k : k + 4096, None] ^ _XOR) * _TIMES
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(0), out=least)
    raw, width = least.tobytes(), 8 * ROWS
    return [int(np.uint64(xxhash.xxh64_intdigest(raw[k * width : k * width + width], k)).view(np.int64)) for k in range(BANDS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of distinct hashes."""
    both = len(a) + len(b)
    if not both:
        return 1.0
    merged = np.sort(np.concatenate([a, b]))
    common = int((merged[1:] == merged[:-1]).sum())
    return common / (both - common)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, fp, size, bands``: ``mark`` is equal for equal sets only, ``size`` counts their shingles, ``fp`` is their SimHash."""
    small_arrow_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in b["text"].to_pylist()]
            mark = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            fps = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            sizes, found = pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(mark), pa.array(fps), sizes, found], ["doc_id", "mark", "fp", "size", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, mark bigint, fp bigint, size bigint, bands array<bigint>")


def alike(distinct: DataFrame) -> DataFrame:
    """``(mark, fp, size)``, each mark once -> ``(a, b, lead)``: pairs by SimHash that may be similar by size.

    Marks of one fingerprint meet its least mark, and least marks meet where ``simhash.links`` links their fingerprints. All are
    leading pairs; a pair may be given more than once.
    """
    least = saved(distinct.groupBy("fp").agg(F.min(F.struct("mark", "size")).alias("m")).select("fp", "m.*"), "prints")
    one, two = (least.select(*[F.col(c).alias(c + k) for c in ("fp", "mark", "size")]) for k in "12")
    across = simhash.links(least.select("fp")).toDF("fp1", "fp2").distinct().join(one, "fp1").join(two, "fp2")
    within = distinct.select("fp", F.col("mark").alias("mark1"), F.col("size").alias("size1")).join(least, "fp").filter("mark1 <> mark")
    within = within.withColumnsRenamed({"mark": "mark2", "size": "size2"})
    met = across.select("mark1", "size1", "mark2", "size2").unionByName(within.select("mark1", "size1", "mark2", "size2"))
    met = met.filter(F.least("size1", "size2") >= LEAST * F.greatest("size1", "size2"))
    return met.select(F.least("mark1", "mark2").alias("a"), F.greatest("mark1", "mark2").alias("b"), F.lit(True).alias("lead"))


def candidates(distinct: DataFrame) -> DataFrame:
    """``(mark, size, bands)``, each mark once -> ``(a, b, lead)``, once each: what shares a band and may be similar by size.

    In a bucket members stand in one order for all bands and meet some first ones and those just before them, so that a bucket
    of any size gives rows in proportion to its members, and all pairs up to 2 * NEIGHBOURS + 1 members. ``lead`` tells the
    pairs with the very first, which is mostly the same in all buckets of a group of copies. A crowded bucket is dealt over
    tasks, each of which gets that first one.
    """
    order = F.xxhash64("mark")
    rows = distinct.select("mark", "size", order.alias("order"), F.explode("bands").alias("value"))
    crowd = rows.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("order", "mark", "size")).alias("first")).filter(F.col("n") > CROWD)
    crowd = saved(crowd.select("value", "first", F.ceil(F.col("n") / CROWD).cast("int").alias("salts")), "crowded")
    dealt = rows.join(crowd, "value", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("mark", "value"), F.col("salts")).cast("int"), F.lit(0))
    dealt = dealt.filter("first is null or first.mark <> mark").select("value", salt.alias("salt"), F.lit(1).alias("kind"), "order", "mark", "size")
    lead = crowd.select("value", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "first.*")
    both = dealt.unionByName(lead).repartition("value", "salt").sortWithinPartitions("value", "salt", "kind", "order", "mark")

    def pair(batches):
        key, first, last = None, [], []
        for b in batches:
            out = []
            for *now, m, n in zip(*(b[c].to_pylist() for c in ("value", "salt", "mark", "size"))):
                if now != key:
                    key, first, last = now, [], []
                for k, (m2, n2) in enumerate(first + last):
                    if min(n, n2) >= LEAST * max(n, n2):
                        out.append((min(m, m2), max(m, m2), k == 0))
                if len(first) < NEIGHBOURS:
                    first.append((m, n))
                else:
                    last = [*last[1 - NEIGHBOURS :], (m, n)]
            a, b_, lead_ = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b_, pa.int64()), pa.array(lead_, pa.bool_())], ["a", "b", "lead"])

    small_arrow_batches(distinct.sparkSession, rows=10_000)
    found = both.select("value", "salt", "mark", "size").mapInArrow(pair, "a bigint, b bigint, lead boolean")
    return found.groupBy("a", "b").agg(F.max("lead").alias("lead"))


def shingle_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``mark, marks``: the shingles of each ``chosen(mark, doc_id)``, as little-endian 64-bit numbers.

    An id whose rows have several texts gives each of their marks; only the chosen one is kept. A mark that no row with an
    id has is looked for among the rows without one.
    """
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            raw = [shingles(t).tobytes() for t in b["text"].to_pylist()]
            mark = np.array([xxhash.xxh64_intdigest(x, 7) for x in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(raw, pa.binary())], ["mark", "marks"])

    shape = "mark bigint, marks binary"
    known = docs.select("doc_id", "text").join(chosen.select("doc_id").distinct(), "doc_id", "left_semi").select("text").mapInArrow(run, shape)
    nameless = docs.filter("doc_id is null").select("text").mapInArrow(run, shape)
    return known.unionByName(nameless).join(chosen.select("mark"), "mark", "left_semi").dropDuplicates(["mark"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those ``pairs(a, b)`` whose ``sets(mark, marks)`` have a similarity of LEAST or more.

    Of a pair, the mark with more pairs is the hub: its set goes once to each task of its pairs (at most HUB), and the
    other's set once a pair, so a group of copies that are held against one of them moves about once.
    """
    ends = pairs.select(F.col("a").alias("mark")).union(pairs.select("b")).groupBy("mark").agg(F.count("*").alias("n"))
    two = pairs.select("a", "b").join(ends.toDF("a", "na"), "a").join(ends.toDF("b", "nb"), "b")
    swap = F.expr("nb > na or nb = na and b < a")
    spokes = two.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("mark"))
    spokes = saved(spokes, "spokes")
    hubs = spokes.groupBy("hub").agg(F.ceil(F.count("*") / HUB).cast("int").alias("salts"))
    rays = spokes.join(hubs, "hub").select("hub", F.pmod(F.xxhash64("mark"), F.col("salts")).cast("int").alias("salt"), "mark")
    rays = rays.join(sets, "mark").select("hub", "salt", F.lit(1).alias("kind"), "mark", "marks")
    cores = hubs.withColumn("mark", F.col("hub")).join(sets, "mark")
    cores = cores.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "mark", "marks")

    def run(batches):
        core = None
        for batch in batches:
            out = []
            for hub, kind, mark, raw in zip(*(batch[c].to_pylist() for c in ("hub", "kind", "mark", "marks"))):
                if not kind:
                    core = np.frombuffer(raw, np.uint64)
                elif similarity(core, np.frombuffer(raw, np.uint64)) >= LEAST:
                    out.append((min(hub, mark), max(hub, mark)))
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    small_arrow_batches(pairs.sparkSession)
    rows = cores.unionByName(rays).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    return rows.select("hub", "kind", "mark", "marks").mapInArrow(run, "a bigint, b bigint")


def _across(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Those ``pairs`` whose ends are not of one component yet."""
    of = members.select("mark", "component")
    return pairs.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").filter("ca <> cb").drop("ca", "cb")


def _joined(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the components that ``links(a, b)`` between marks bring together."""
    of = members.select("mark", "component")
    ends = links.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    return saved(_named(members, connected_components(ends), "component"), "members")


def left_over(distinct: DataFrame, members: DataFrame) -> DataFrame:
    """``(mark, size, component)`` of the marks in buckets where ``candidates`` did not pair all members and
    ``members(mark, component)`` are not of one component yet; no other pair of ``candidates`` can be missing."""
    rows = distinct.select("mark", "size", "bands").join(members.select("mark", "component"), "mark")
    rows = rows.select("mark", "size", "component", F.explode("bands").alias("value"))
    crowded = rows.groupBy("value").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    crowded = crowded.filter((F.col("n") > 2 * NEIGHBOURS + 1) & (F.col("low") < F.col("high"))).select("value")
    return rows.join(crowded, "value").select("mark", "size", "component").distinct()


def shared_prefixes(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)``, once each: all pairs of ``rest(mark, size, component)`` across components that may be similar.

    Sets of similarity LEAST or more share one of their rarest size - ceil(LEAST * size) + 1 shingles, in any order
    common to all sets; here by frequency in ``sets(mark, marks)``, so that what many texts share is no key. A key of
    many marks is split by salt on one side.
    """

    def run(batches):
        for b in batches:
            for m, x in zip(b["mark"].to_pylist(), b["marks"].to_pylist()):
                marks = np.frombuffer(x, np.int64)
                for k in range(0, len(marks), 1 << 16):
                    part = pa.array(marks[k : k + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), m, np.int64)), part], ["mark", "shingle"])

    small_arrow_batches(sets.sparkSession)
    rows = sets.select("mark", "marks").mapInArrow(run, "mark bigint, shingle bigint")
    rows = rows.join(rows.groupBy("shingle").agg(F.count("*").alias("n")), "shingle").join(rest, "mark")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("mark").orderBy("n", "shingle")))
    keys = rows.filter((F.col("place") <= F.floor(F.col("size") * (1 - LEAST) + 1e-6) + 1) & (F.col("n") > 1))
    keys = saved(keys.select("shingle", "mark", "size", "component", "place"), "prefixes")
    parts = keys.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    parts = parts.groupBy("shingle").agg(
        F.ceil(F.sum("n") / SALTED).cast("int").alias("salts"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("c")
    )
    keys = keys.join(parts.filter("c > 1").drop("c"), "shingle")
    # The largest component of a key is never paired with itself: one side of each pair is of another one.
    one = keys.filter("component <> main").select(
        "shingle", F.pmod(F.hash("mark"), "salts").alias("salt"), *(F.col(c).alias(c + "1") for c in ("mark", "size", "component", "place"))
    )
    two = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    met = one.join(two, ["shingle", "salt"]).filter("component1 <> component AND (component = main OR component1 < component)")
    # What two sets can share from a place on; at their first common place this holds for all that are similar.
    met = met.filter(1 + F.least(F.expr("size1 - place1"), F.expr("size - place")) >= LEAST / (1 + LEAST) * F.expr("size1 + size") - 1e-6)
    met = met.filter(F.least("size1", "size") >= LEAST * F.greatest("size1", "size"))
    return met.select(F.least("mark1", "mark").alias("a"), F.greatest("mark1", "mark").alias("b")).distinct()


def _named(members: DataFrame, parts: DataFrame, by: str) -> DataFrame:
    """``members`` with the component that ``parts(vertex, component)`` names for column ``by``, or ``by`` itself."""
    parts = parts.select(F.col("vertex").alias(by), F.col("component").alias("named"))
    return members.join(parts, by, "left").select("mark", "least", F.coalesce("named", by).alias("component"))


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` per row: components of links of similarity LEAST or more, named by the least id.

    Equal sets, wordless texts among them, are one mark before any pair is made, so exact copies never meet in pairs. Pairs come
    from SimHash and, as sets of similarity LEAST may differ in more bits than it links, from bands of least hashes; all are confirmed exactly.
    Buckets of any size are paired in proportion to their members: first all with their bucket's first, then only what is
    of different components still; where that leaves several components in one bucket, an exact search by shared rare
    shingles looks for the links between them. Null ids are linked like others but name no component.
    """
    marked = saved(sketches(docs), "sketches")
    distinct = saved(
        marked.groupBy("mark").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("bands").alias("bands")), "marks"
    )
    worded = distinct.filter("size > 0")
    pairs = candidates(worded).unionByName(alike(worded)).groupBy("a", "b").agg(F.max("lead").alias("lead"))
    pairs = saved(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("mark")).union(pairs.select(F.col("b"))).distinct()
    sets = saved(shingle_sets(docs, distinct.join(ends, "mark").select("mark", F.col("least").alias("doc_id"))), "sets")
    members = saved(_named(distinct, connected_components(confirmed(pairs.filter("lead"), sets)), "mark"), "members")
    others = saved(_across(pairs.filter("not lead"), members), "other-pairs")
    if not others.isEmpty():
        members = _joined(members, confirmed(others, sets))
    rest = saved(left_over(worded, members), "rest")
    if not rest.isEmpty():
        chosen = distinct.join(rest.select("mark"), "mark").select("mark", F.col("least").alias("doc_id"))
        sets = saved(shingle_sets(docs, chosen), "rest-sets")
        members = _joined(members, confirmed(saved(shared_prefixes(rest, sets), "rest-pairs"), sets))
    ids = members.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "mark").join(members.join(ids, "component").select("mark", "component_id"), "mark").select(
        "doc_id", "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents whose id is that of their component; the columns of ``docs``. Null ids stay as they are."""
    out = near_copies(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)
