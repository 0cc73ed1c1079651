"""The trie of conversation prefixes, its subtrees by the Euler-tour technique."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageweave.functions.scan import scan, sums, xors
from pageweave.functions.scratch import saved

#: Elements of a list that are ranked in one task's memory.
CHUNK = 1 << 16


# --- turns -----------------------------------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, a, b, n``: each turn's place (from 1), 120 bits of its digest and its code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    bits = [F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("bigint") for k in (0, 1)]
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 32).alias("head"),
        digest.alias("digest"), bits[0].alias("a"), bits[1].alias("b"), F.length(text).cast("bigint").alias("n"),
    )
    return scan(rows, ["conv_id"], ["turn", "role", "head", "digest"], **sums(pos="1"), name="turns", keep=["conv_id", "a", "b", "n"])


def rebuilt(turn: DataFrame, prefix: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of their family's first: ``conv_id, size`` and ``conv_id, pos, a, b, n``.

    c takes the first h turns of c - c % family, h = crc32(c) % prefix, then its own after its first h.
    """
    sizes = turn.groupBy("conv_id").agg(F.count("*").alias("own"))
    c = F.col("conv_id")
    convs = sizes.withColumns({"h": F.crc32(c.cast("string").cast("binary")) % prefix, "first": c - c % family})
    first = sizes.select(F.col("conv_id").alias("first"), F.col("own").alias("had"))
    took = F.least("h", F.coalesce("had", F.lit(0)))
    convs = saved(convs.join(first, "first", "left").withColumn("took", took), "conversations")
    rest = F.greatest(F.col("own") - F.col("h"), F.lit(0))
    own = turn.join(convs.select("conv_id", "h", "took"), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("took")).alias("pos"), "a", "b", "n")
    heads = turn.filter(F.col("pos") < prefix).withColumnRenamed("conv_id", "first")
    shared = convs.filter("took > 0").select("conv_id", "first", "took").join(heads, "first").filter("pos <= took")
    return convs.select("conv_id", (F.col("took") + rest).alias("size")), own.unionByName(shared.select(own.columns))


# --- nodes -----------------------------------------------------------------------------------------------------------


def nodes(sizes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes ``id, conv_id, depth, n_convs, chars, x, y, px, py``, and the members that end at one: ``depth, x, y, conv_id``.

    A prefix of d turns is known by d and two running exclusive ors of 64-bit hashes of place and turn; taking the last
    turn's hash off again gives the parent's. ``id`` ascends with (``conv_id``, ``depth``).
    """
    hashed = rows.withColumns({k: F.xxhash64("pos", F.lit(k), "a", "b") for k in ("hx", "hy")})
    path = scan(hashed, ["conv_id"], ["pos"], **xors(x="hx", y="hy"), name="paths", keep=["conv_id", "pos", "n", "hx", "hy"])
    path = path.withColumnRenamed("pos", "depth")
    found = path.groupBy("depth", "x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n").alias("chars"),
        F.min(F.col("x").bitwiseXOR(F.col("hx"))).alias("px"), F.min(F.col("y").bitwiseXOR(F.col("hy"))).alias("py"),
    )
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", zero.alias("chars"), none.alias("px"), none.alias("py")
    )
    every = found.unionByName(root).repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    ends = path.join(sizes.filter("size > 0"), "conv_id").filter("depth = size").select("depth", "x", "y", "conv_id")
    turnless = sizes.filter("size = 0").select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id")
    return saved(every.withColumn("id", F.monotonically_increasing_id()), "nodes"), ends.unionByName(turnless)


def ends_digests(ends: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, ends_sha256``: SHA-256 of each key's values, ascending and joined by commas.

    Range partitions join stretches of values to one text each; a key's stretches then pass through its digest one by one,
    so no task holds a key's values.
    """
    kinds = [(k, pa.int64()) for k in keys]
    parts = pa.schema([*kinds, ("least", pa.int64()), ("text", pa.string())])
    whole = pa.schema([*kinds, ("ends_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = [b[k].to_numpy() for k in keys]
                new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
                begins = np.concatenate([[0], new])
                values = b[value].to_pylist()
                texts = [",".join(map(str, values[i:j])) for i, j in zip(begins, [*new, len(values)], strict=True)]
                cells = [pa.array(c[begins]) for c in cols] + [pa.array([values[i] for i in begins]), pa.array(texts)]
                yield pa.RecordBatch.from_arrays(cells, schema=parts)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []
        for b in batches:
            for *now, _, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now == key:
                    sha.update(b"," + text.encode())
                else:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256(text.encode())
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=whole)
                done = []
        if key:
            done.append((*key, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=whole)

    ddl = ", ".join(f"{k} bigint" for k in keys)
    rows = ends.select(*keys, value).repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    pieces = rows.mapInArrow(join, f"{ddl}, least bigint, text string")
    pieces = pieces.repartition(*keys).sortWithinPartitions(*keys, "least")
    return pieces.mapInArrow(digest, f"{ddl}, ends_sha256 string")


# --- tour ------------------------------------------------------------------------------------------------------------


def tour(tree: DataFrame) -> DataFrame:
    """``arc, succ``: node v is entered by arc 2v and left by 2v + 1; ``tree``: ``id, parent, k`` (place among siblings from 1)."""
    first = tree.filter("k = 1").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    after = tree.filter("k > 1").select("parent", (F.col("k") - 1).alias("k"), F.col("id").alias("sibling"))
    enter = tree.join(first, "id", "left").select(
        (2 * F.col("id")).alias("arc"), F.coalesce(2 * F.col("child"), 2 * F.col("id") + 1).alias("succ")
    )
    leave = tree.join(after, ["parent", "k"], "left").select(
        (2 * F.col("id") + 1).alias("arc"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("succ")
    )
    return enter.unionByName(leave)


_CHAIN = pa.schema([(c, pa.int64()) for c in ("arc", "head", "before", "succ", "size")])


def _chains(arc: np.ndarray, succ: np.ndarray, known: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Runs of elements that follow each other among these: each element's first one and the size before it, and of first
    ones the run's successor (null at the end) and size."""
    by = np.argsort(arc, kind="stable")
    arc, succ, known, size = arc[by], succ[by], known[by], size[by]
    to = np.minimum(np.searchsorted(arc, succ), len(arc) - 1)
    near = known & (arc[to] == succ)
    here = np.arange(len(arc))
    back, before = here.copy(), np.zeros(len(arc), np.int64)
    back[to[near]] = here[near]
    before[to[near]] = size[near]
    while (back[back] != back).any():
        before, back = before + before[back], back[back]
    last = here[~near]  # of each run
    head = back[last]
    out, whole, ends = np.zeros(len(arc), np.int64), np.zeros(len(arc), np.int64), np.ones(len(arc), bool)
    out[head], whole[head], ends[head] = succ[last], before[last] + size[last], ~known[last]
    cells = [pa.array(arc), pa.array(arc[back]), pa.array(before), pa.array(out, mask=ends), pa.array(whole)]
    return pa.RecordBatch.from_arrays(cells, schema=_CHAIN)


def _contract(live: DataFrame, chunk: int) -> DataFrame:
    """``_chains`` of each stretch of at most so many elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            known = t["succ"].is_valid().to_numpy()
            return _chains(t["arc"].to_numpy(), t["succ"].fill_null(0).to_numpy(), known, t["size"].to_numpy())

        for b in batches:
            if held and sum(x.num_rows for x in held) + b.num_rows > chunk:
                yield flush()
                held = []
            if b.num_rows:
                held.append(b)
        if held:
            yield flush()

    return live.select("arc", "succ", "size").mapInArrow(run, "arc long, head long, before long, succ long, size long")


def _splice(live: DataFrame, turn: int) -> DataFrame:
    """About every fourth element goes into the one before it: those with coin 1 after one with coin 0."""
    coin = F.pmod(F.xxhash64("arc", F.lit(turn)), F.lit(2))
    u = live.filter(coin == 0).select(*[F.col(c).alias(f"u_{c}") for c in ("arc", "succ", "size")])
    v = live.filter(coin == 1)
    both = u.join(v, u["u_succ"] == v["arc"], "full")
    alone = both.filter("u_arc is null").select("arc", F.col("arc").alias("head"), F.lit(0).cast("long").alias("before"), "succ", "size")
    first = both.filter("u_arc is not null").select(
        F.col("u_arc").alias("arc"), F.col("u_arc").alias("head"), F.lit(0).cast("long").alias("before"),
        F.when(F.col("arc").isNull(), F.col("u_succ")).otherwise(F.col("succ")).alias("succ"),
        (F.col("u_size") + F.coalesce("size", F.lit(0))).alias("size"),
    )
    gone = both.filter("u_arc is not null and arc is not null").select(
        "arc", F.col("u_arc").alias("head"), F.col("u_size").alias("before"), F.lit(None).cast("long").alias("succ"), F.lit(0).cast("long").alias("size")
    )
    return alone.unionByName(first).unionByName(gone)


def ranked(arcs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``arc, place``: the elements' places (from 0) in the list that ``arc, succ`` (null at its end) describe.

    Runs within stretches of the ids become one element each; where that shrinks the list too little, elements are spliced out
    by coins instead, a quarter a round whatever the list. A list of at most ``chunk`` elements is ranked in one task. The
    rounds' tables then give the places back.
    """
    live = arcs.withColumn("size", F.lit(1).cast("long"))
    rounds: list[DataFrame] = []
    left, near = None, True
    while True:
        if left is not None and left <= chunk:
            level = _contract(live.repartition(1), chunk)
        elif near:
            level = _contract(live.repartitionByRange("arc").sortWithinPartitions("arc"), chunk)
        else:
            level = _splice(live, len(rounds))
        level = saved(level, "list")
        done = left is not None and left <= chunk
        rounds.append(level)
        if done:
            break
        live = level.filter("arc = head").select("arc", "succ", "size")
        now = live.count()
        near = near and (left is None or now < left / 2)
        left = now
    place = rounds.pop().select("arc", F.col("before").alias("place"))
    for level in reversed(rounds):
        head = place.select(F.col("arc").alias("head"), "place")
        place = level.join(head, "head").select("arc", (F.col("before") + F.col("place")).alias("place"))
    return place


def prefix_trie(conversations: DataFrame, prefix: int = 6, family: int = 100) -> DataFrame:
    """A row per node of the trie of rebuilt conversations (see ``rebuilt``), for reuse of shared prefixes.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and
    ``saved_tokens`` of the subtree (code points of each node's last text for all its members but one), ``ends_sha256`` of the
    members that end here. Turns are ordered by ``turn``, null first; equal ones by role, the text's first 32
    characters and its digest. A null role or text is empty; rows without ``conv_id`` belong to no conversation; repeated rows are
    repeated turns; an empty table has no node, not even a root. Other columns play no part.

    Enter and exit arcs of the nodes are ranked as one list; prefix sums at the arcs' places give the subtrees.
    Conversations, nodes and families of any size or depth lie over many tasks.
    """
    sizes, rows = rebuilt(turns(conversations), prefix, family)
    trie, ends = nodes(sizes, rows)
    up = trie.select(
        F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"),
        F.col("x").alias("px"), F.col("y").alias("py"),
    )
    linked = trie.join(up, ["depth", "px", "py"], "left")
    keep = ["id", "conv_id", "depth", "n_convs", "chars", "x", "y", "parent", "parent_conv_id"]
    tree = scan(linked.select(*keep), ["parent"], ["conv_id"], **sums(k="1"), name="siblings")
    place = ranked(tour(tree.select("id", "parent", "k")))
    kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    whole = tree.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    whole = saved(whole.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "tree")
    weights = whole.select((2 * F.col("id")).alias("arc"), (F.col("n_children") == 0).cast("bigint").alias("leaf"), "saved")
    zero = F.lit(0).cast("bigint")
    arcs = place.join(weights, "arc", "left").select("arc", "place", F.coalesce("leaf", zero).alias("leaf"), F.coalesce("saved", zero).alias("saved"))
    run = scan(arcs, [], ["place"], **sums(leaves="leaf", savings="saved"), name="tour", keep=["arc", "leaf", "saved"])
    out = F.col("arc") % 2 == 1
    below = run.groupBy(F.shiftright("arc", 1).alias("id")).agg(
        F.sum(F.when(out, F.col("leaves")).otherwise(F.col("leaf") - F.col("leaves"))).alias("n_leaves"),
        F.sum(F.when(out, F.col("savings")).otherwise(F.col("saved") - F.col("savings"))).alias("saved_tokens"),
    )
    marks = ends_digests(ends, ["depth", "x", "y"], "conv_id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.join(below, "id").join(marks, ["depth", "x", "y"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
