"""Repeated passages by a sparse suffix array."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageweave.functions.scratch import saved, small_arrow_batches

MIN_WORDS = 50
WINDOW = 24
#: Suffixes that share a passage of MIN_WORDS share this many words from the retained place on.
KEY_WORDS = MIN_WORDS - WINDOW + 1
GRAM = 8
#: Bits of the table of repeated keys that every task gets: 8 MB, whatever the input.
TABLE_BITS = 1 << 26
#: Least number of suffixes of a key that are dealt over several tasks.
MANY = 1000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = np.uint64(24)
#: Words that are hashed together at once.
_AT_ONCE = 1 << 21


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every white-space word of the texts (null: none), and the bounds of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    each = np.fromiter(map(xxhash.xxh64_intdigest, names, repeat(11)), np.uint64, len(names))
    within, bounds = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    if len(blank := np.flatnonzero(names == "")):  # a text without a word is one empty string
        real = within != blank[0]
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        within = within[real]
    return each[within], bounds


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MUL
    return x ^ (x >> np.uint64(32))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on, built by doubling."""
    have, out, done = h, None, 0
    size = 1
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                if out is None:
                    out, done = have, size
                else:
                    m = len(h) - done - size + 1
                    out = _mix(out[:m] * np.uint64(3) + have[done : done + m])
                    done += size
            if size * 2 > n:
                return out
            m = len(have) - size
            have = _mix(have[:m] * np.uint64(5) + have[size:])
            size *= 2


def retained(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``place, key, first window, number of windows`` of each retained suffix, and the first places of all windows.

    A window is MIN_WORDS consecutive words of a text. It holds WINDOW places from each of which KEY_WORDS words follow
    inside it; the suffix at the one with the least gram is retained, wherever these words stand, and the window
    counts as that suffix's: so many words to the left of its place and so many to the right of its key.
    """
    parts = []
    for k in range(0, len(h) - MIN_WORDS + 1, _AT_ONCE):
        some = h[k : k + _AT_ONCE + MIN_WORDS - 1]
        low = _grams(some, GRAM)
        # the place stands in the low bits, so that the least tells its place and equal grams go by place
        low = (low >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(low), dtype=np.uint64)
        size = 1
        while size < WINDOW:
            step = min(size, WINDOW - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        at = (low[: len(some) - MIN_WORDS + 1] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        parts.append((at + k, _grams(some, KEY_WORDS)[at]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    at, key = (np.concatenate(x) for x in zip(*parts))
    inside = np.zeros(len(at) + 1, np.int64)
    long = np.diff(bounds) >= MIN_WORDS
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - MIN_WORDS + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[:-1])
    at, key = at[start], key[start]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(start, prepend=-1) != 1))
    return at[new], key[new], start[new], np.diff(np.append(new, len(start))), start


def _binaries(numbers: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of 64-bit numbers, by their first places and lengths, as binaries."""
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)
    bounds = pa.py_buffer(np.concatenate([[0], 8 * ends]).astype(np.int64).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, bounds, pa.py_buffer(numbers[place].tobytes())]).cast(pa.binary())


def suffixes(docs: DataFrame, repeated=None) -> DataFrame:
    """``(doc_id, text)`` -> ``(key, ways, doc_id, version, at, start, n, before, after)`` of retained suffixes.

    ``at`` is the suffix's place; ``n`` windows from ``start`` on count as its own. ``before`` and ``after`` are the words of
    these windows before the place and after the key, 64 bits each. With ``repeated``, a broadcast pair of a bit table and of the tasks that hot keys are dealt over, only
    suffixes whose key may be repeated; without, ``key`` alone.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        table = None if repeated is None else np.frombuffer(repeated.value[0], np.uint8)
        for b in batches:
            h, bounds = word_hashes(b["text"])
            at, key, start, sizes, _ = retained(h, bounds)
            if table is None:
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])
                continue
            slot = (key % np.uint64(TABLE_BITS)).astype(np.int64)
            on = np.flatnonzero((table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            of = np.searchsorted(bounds, at[on], "right") - 1
            hot, dealt = repeated.value[1:]
            flat = key[on].view(np.int64)
            ways = np.ones(len(on), np.int32)
            if len(hot):
                where = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
                ways = np.where(hot[where] == flat, dealt[where], 1).astype(np.int32)
            own = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(flat),
                    pa.array(ways),
                    b["doc_id"].take(own),
                    b["version"].take(own),
                    pa.array(at[on] - bounds[of]),
                    pa.array(start[on] - bounds[of]),
                    pa.array(sizes[on]),
                    _binaries(h, start[on], at[on] - start[on]),
                    _binaries(h, at[on] + KEY_WORDS, start[on] + sizes[on] - 1 + MIN_WORDS - at[on] - KEY_WORDS),
                ],
                ["key", "ways", "doc_id", "version", "at", "start", "n", "before", "after"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    if repeated is None:
        return rows.mapInArrow(run, "key bigint")
    return rows.mapInArrow(run, f"key bigint, ways int, doc_id {kind}, version bigint, at bigint, start bigint, n bigint, before binary, after binary")


def _repeated_keys(docs: DataFrame, many: int):
    """Broadcast: TABLE_BITS bits with the keys found twice or more, by their remainder; hot keys, and their tasks.

    A key is hot if it has more than an eighth of what a task gets on average (and more than ``many``), so that there
    are at most eight of them a task.
    """
    spark = docs.sparkSession
    counts = saved(suffixes(docs).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    low = F.col("key").bitwiseAND(F.lit(TABLE_BITS - 1))
    words = (
        counts.select(F.shiftright(low, 5).cast("int").alias("word"), low.bitwiseAND(F.lit(31)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .toArrow()  # at most TABLE_BITS / 32 rows
    )
    table = np.zeros(TABLE_BITS // 32, np.uint32)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(many, total // (8 * _tasks(spark)))
    hot = counts.filter(F.col("n") > share).orderBy("key").toArrow()  # at most eight a task
    dealt = -(-hot["n"].to_numpy() // share)
    return spark.sparkContext.broadcast((table.tobytes(), hot["key"].to_numpy(), dealt))


def _tasks(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_FOUND = ("doc_id", "version", "start", "n_words", "of_doc_id", "of_start", "first", "window")


def _words(stretches: pa.ChunkedArray, backwards: bool) -> np.ndarray:
    """A row of WINDOW - 1 words for each stretch, from the key outwards; zeros after its end."""
    sizes = pc.binary_length(stretches).to_numpy().astype(np.int64) // 8
    flat = np.frombuffer(b"".join(stretches.to_pylist()), np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), WINDOW - 1), np.uint64)
    out[row, sizes[row] - 1 - column if backwards else column] = flat
    return out


def _classes(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``(WINDOW, rows)``: at n, equal numbers for rows of one key whose first n words agree.

    Rows are sorted by key and words, that is in suffix order; how many words neighbours share tells where rows that
    agree on n words begin and end.
    """
    order = np.lexsort((*words.T[::-1], key))
    shared = np.minimum.accumulate(words[order][1:] == words[order][:-1], axis=1).sum(axis=1)
    shared[key[order][1:] != key[order][:-1]] = -1
    out = np.empty((WINDOW, len(key)), np.int64)
    for n in range(WINDOW):
        out[n, order] = np.concatenate([[0], np.cumsum(shared < n)])
    return out


def _window_hash(key: np.ndarray, before: np.ndarray, after: np.ndarray, left: np.ndarray) -> np.ndarray:
    """64 bits of a window that takes ``left`` words before the key and the rest after it."""
    out = key.astype(np.uint64) + left.astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in range(WINDOW - 1):
            out = np.where(n < left, _mix(out * np.uint64(3) + before[:, n]), out)
            out = np.where(n < WINDOW - 1 - left, _mix(out * np.uint64(5) + after[:, n]), out)
    return out


def _compared(rows: pa.Table) -> pa.RecordBatch:
    """What the sorted suffixes of whole keys share, as rows of _FOUND.

    The suffixes of a key are sorted by the words after it, and neighbours compared: so it is known which ones agree how
    far to the right. The words before it, sorted and compared alike, tell how far the matches extend to the left. Two
    suffixes share a window if they agree on its words on both sides. A window's first holder is the first in order;
    stretches of windows that another suffix holds first, and of those that this one holds first and another too, make a
    row each.
    """
    sizes = rows["n"].to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    start = rows["start"].to_numpy()[row] + np.arange(len(row)) - (ends - sizes)[row]
    entity = _entities(rows)[row]
    own_key, salt = rows["key"].to_numpy(), rows["salt"].to_numpy()
    key = np.cumsum(np.concatenate([[0], (own_key[1:] != own_key[:-1]) | (salt[1:] != salt[:-1])])[: len(own_key)])
    before, after = _words(rows["before"], True), _words(rows["after"], False)
    right, left = _classes(key, after), _classes(key, before)
    to_left = rows["at"].to_numpy()[row] - start  # words of the window before the key
    here = (right[WINDOW - 1 - to_left, row] * len(sizes) + left[to_left, row]) * WINDOW + to_left
    order = np.argsort(here, kind="stable")
    group = np.flatnonzero(np.diff(here[order], prepend=~here[order[:1]]) != 0) if len(order) else order
    count = np.diff(np.append(group, len(order)))
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[group], count)
    other = (entity != entity[first]) | (start != start[first])
    shared = np.empty(len(order), bool)
    shared[order] = np.repeat(np.logical_or.reduceat(other[order], group) if len(group) else other, count)
    # a row of the same document and place counts as one with the first
    alone = (first == np.arange(len(order))) & ~other
    dealt = (rows["ways"].to_numpy() > 1)[row]
    parts = []
    for mine, is_first in ((other, False), (alone & shared & ~dealt, True)):
        k = np.flatnonzero(mine)
        new = np.flatnonzero((np.diff(k, prepend=-2) != 1) | (np.diff(row[k], prepend=-1) != 0))
        parts.append((k[new], np.diff(np.append(new, len(k))) + MIN_WORDS - 1, np.full(len(new), is_first), np.zeros(len(new), bool)))
    late = np.flatnonzero(alone & dealt)
    parts.append((late, np.full(len(late), MIN_WORDS), shared[late], np.ones(len(late), bool)))
    k, n, is_first, is_late = (np.concatenate(x) for x in zip(*parts))
    own, partner = pa.array(row[k]), pa.array(row[first[k]])
    window = np.zeros(len(k), np.uint64)
    window[is_late] = _window_hash(own_key[row[late]], before[row[late]], after[row[late]], to_left[late])
    return pa.RecordBatch.from_arrays(
        [
            rows["doc_id"].combine_chunks().take(own),
            rows["version"].combine_chunks().take(own),
            pa.array(start[k]),
            pa.array(n.astype(np.int64)),
            rows["doc_id"].combine_chunks().take(partner),
            pa.array(start[first[k]]),
            pa.array(is_first),
            pa.array(window.view(np.int64), mask=~is_late),
        ],
        list(_FOUND),
    )


def _entities(rows: pa.Table) -> np.ndarray:
    """A number for each document and version."""
    ids = rows["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    pair = np.stack([ids.astype(np.int64), rows["version"].to_numpy()], 1)
    return np.unique(pair, axis=0, return_inverse=True)[1].reshape(-1)


def matches(docs: DataFrame, many: int = MANY) -> DataFrame:
    """Matches of the sorted sparse suffixes: ``doc_id, version, start, n_words, of_doc_id, of_start, first``.

    Suffixes are dealt by key; those of a key stand together, are sorted by their words and compared with their neighbours,
    and matches extended to both sides (``_compared``). ``first`` marks passages that this document holds first. A key of very many suffixes is dealt
    over tasks by document: each task finds its own first holders, and these are compared by window over the tasks,
    at most one for each window and task.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark, rows=2500)
    kind = dict(docs.dtypes)["doc_id"]
    fields = f"doc_id {kind}, version bigint, start bigint, n_words bigint, of_doc_id {kind}, of_start bigint, first boolean, `window` bigint"

    def compare(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt = batch["key"].to_numpy(), batch["salt"].to_numpy()
            same = (key == key[-1]) & (salt == salt[-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last key may go on
            if cut or (held and (held[-1]["key"][-1].as_py(), held[-1]["salt"][-1].as_py()) != (key[0], salt[0])):
                yield _compared(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _compared(pa.Table.from_batches(held))

    kept = suffixes(docs, _repeated_keys(docs, many)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "version"), "ways"))
    dealt = kept.repartition(_tasks(spark), "key", "salt").sortWithinPartitions("key", "salt", "doc_id", "version", "at")
    found = saved(dealt.mapInArrow(compare, fields), "matches")
    by_window = Window.partitionBy("window")
    late = (
        found.filter("window is not null")
        .withColumn("least", F.min(F.struct("doc_id", "version", "start")).over(by_window))
        .withColumn("shared", F.max("first").over(by_window) | (F.count("*").over(by_window) > 1))
        .filter("shared")
        .withColumn("first", F.struct("doc_id", "version", "start") == F.col("least"))
        .withColumn("of_doc_id", F.col("least.doc_id"))
        .withColumn("of_start", F.col("least.start"))
    )
    return found.filter("window is null").unionByName(late.select(*found.columns)).drop("window")


def _passages(docs: DataFrame, many: int) -> DataFrame:
    """Overlapping matches of a document and kind as one."""
    rows = matches(docs.filter("doc_id is not null"), many)
    w_rows = rows.withColumn("dropped", ~F.col("first")).withColumn("stop", F.col("start") + F.col("n_words"))
    w = Window.partitionBy("doc_id", "version", "dropped").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        w_rows.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
        .withColumn("passage", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "version", "dropped", "passage")
        .agg(
            F.min("start").alias("start"),
            (F.max("stop") - F.min("start")).alias("n_words"),
            F.min_by(F.struct("of_doc_id", "of_start"), F.struct("start", "stop", "of_doc_id", "of_start")).alias("of"),
        )
        .select("doc_id", "start", "n_words", F.col("of.of_doc_id"), F.col("of.of_start"), "dropped", "version")
    )


def spans(docs: DataFrame, many: int = MANY) -> DataFrame:
    """One row per repeated passage of a document: ``doc_id, start, n_words, of_doc_id, of_start, dropped``.

    Passages of MIN_WORDS words or more; overlapping ones of a document and kind make one. Places are numbers of
    white-space words from 0. ``dropped`` is false where the passage is its first occurrence (smallest ``doc_id``, then
    place); else ``of_doc_id`` and ``of_start`` tell where its first words stand first. A document may repeat a passage
    within itself. Null, empty and short texts have none; rows of the same ``doc_id`` and text count as one, rows of
    the same ``doc_id`` with another text as another document; a null ``doc_id`` is left out; other columns are
    ignored.
    """
    return _passages(docs, many).drop("version")


def cut_repeats(docs: DataFrame, many: int = MANY) -> DataFrame:
    """``docs`` with every repeated passage but its first occurrence cut out of ``text``; all columns, all rows."""
    cuts = (
        _passages(docs, many)
        .filter("dropped")
        .groupBy(F.col("doc_id").alias("__of"), F.col("version").alias("__version"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("__cuts"))
    )
    same = (F.col("doc_id") == F.col("__of")) & (F.xxhash64("text") == F.col("__version"))
    joined = docs.join(cuts, same, "left").drop("__of", "__version")
    names = docs.columns
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        import re

        words = re.compile(rb"[^\x20\x09-\x0d]+")
        for b in batches:
            texts = b["text"].to_pylist()
            for k, cut in enumerate(b["__cuts"].to_pylist()):
                if cut and texts[k] is not None:
                    raw = texts[k].encode("utf-8", "surrogatepass")
                    at = [m.span() for m in words.finditer(raw)]
                    parts, done = [], 0
                    for c in cut:
                        i, j = c["start"], min(c["start"] + c["n_words"], len(at))
                        if i < j:
                            parts.append(raw[done : max(done, at[i][0])])
                            done = max(done, at[j - 1][1])
                    texts[k] = b"".join([*parts, raw[done:]]).decode("utf-8", "surrogatepass")
            arrays = [pa.array(texts, pa.string()) if c == "text" else b[c] for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(run, T.StructType(docs.schema.fields))
