"""Packing token sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageweave.functions.scratch import saved, small_arrow_batches
from pageweave.llm.word_bpe import closed, encoder

SIZE = 4096


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``): each document's ids and end id, cut at ``size``."""
    small_arrow_batches(docs.sparkSession, rows=2500)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        flat = encoder(tokenizer_path).flat
        for b in batches:
            ids, bounds = closed(*flat(b["text"]), end_id)
            tokens = np.diff(bounds)
            of = np.repeat(np.arange(len(tokens)), -(-tokens // size))
            start = size * (np.arange(len(of)) - np.searchsorted(of, of))
            length = np.minimum(size, tokens[of] - start)
            at = bounds[of] + start
            parts = [ids[i : i + n].tobytes() for i, n in zip(at.tolist(), length.tolist())]
            cols = {
                "doc_id": b["doc_id"].take(pa.array(of)),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                "doc_tokens": pa.array(tokens[of], pa.int64()),
            } | ({"ids": pa.array(parts, pa.binary())} if keep_ids else {})
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * keep_ids,
    )


def placed(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packing patterns as runs ``(length, how often)``, longest first, and how many sequences follow each.

    Lengths are placed longest first into the shortest packs, that is the patterns with most room, as long as they
    fit, else into new ones; as many of a length as fit go into a pack at once. Only counts of patterns are updated,
    so the work depends on ``size`` and not on the number of pieces.
    """
    room: list[list[tuple[tuple, int]]] = [[] for _ in range(size + 1)]
    widest = 0
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"length {length}")
        while n:
            while widest and not room[widest]:
                widest -= 1
            if widest < length:
                each = size // length
                for k, count in ((each, n // each), (n % each, 1)):
                    if k and count:
                        room[size - k * length].append((((length, k),), count))
                        widest = max(widest, size - k * length)
                break
            pattern, count = room[widest].pop()
            each = min(widest // length, n)
            used = min(count, n // each)
            if count > used:
                room[widest].append((pattern, count - used))
            room[widest - each * length].append((pattern + ((length, each),), used))
            n -= used * each
    return [x for some in room for x in some]


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Lengths of each packing pattern, longest first, and how many sequences follow it."""
    return [([length for length, k in p for _ in range(k)], c) for p, c in placed(histogram, size)]


def slots(chosen: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """Rows ``length, first rank, first sequence, first offset, sequences``, one per run of a pattern.

    Pieces of a length take the slots by rank: those of a run go to each of its sequences in turn, then to each again.
    """
    out, given, sequence = [], {}, 0
    for pattern, count in chosen:
        offset = 0
        for length, k in pattern:
            out.append((length, given.get(length, 0), sequence, offset, count))
            given[length] = given.get(length, 0) + k * count
            offset += k * length
        sequence += count
    a = np.array(out, np.int64).reshape(-1, 5)
    return a[np.lexsort((a[:, 1], a[:, 0]))]


def ranked(cut: DataFrame, histogram: dict[int, int], per_part: int = 500) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0, in no task that holds all of a length.

    Pieces of a length are dealt by hash into as many parts as it needs; the parts' counts give their first ranks.
    """
    spark = cut.sparkSession
    parts = spark.createDataFrame([(k, 1 + n // per_part) for k, n in histogram.items()], "length bigint, parts bigint")
    dealt = (
        cut.join(F.broadcast(parts), "length")  # at most as many rows as a sequence has places
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "parts"))
        .drop("parts")
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        dealt.groupBy("length", "part").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))
    ).drop("count")
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    return (
        dealt.withColumn("at", F.row_number().over(within) - 1)
        .join(first, ["length", "part"])
        .withColumn("rank", F.col("first") + F.col("at"))
        .drop("part", "at", "first")
    )


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: every id of every document in exactly one piece.

    Documents of more than ``size`` ids are cut at multiples of it; others stay whole. Null and empty texts have their
    end id alone. Repeated rows, and rows of a null or a repeated ``doc_id``, are packed each; equal lengths go by
    document and place; other columns are ignored; an empty table gives no piece. The driver sees the histogram: at
    most ``size`` counts.
    """
    cut = saved(pieces(docs, tokenizer_path, end_id, size, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = cut.sparkSession.sparkContext.broadcast(slots(placed(histogram, size)))  # its size depends on `size`
    order = ranked(cut, histogram)
    schema = order.schema

    def place(batches):
        a = table.value
        key = a[:, 0] << 40 | a[:, 1]
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            run = a[np.searchsorted(key, length << 40 | rank, side="right") - 1] if len(a) else np.zeros((0, 5), np.int64)
            again, sequence = np.divmod(rank - run[:, 1], run[:, 4])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(run[:, 2] + sequence), pa.array(run[:, 3] + again * length)],
                [*b.schema.names, "sequence_id", "offset"],
            )

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return order.mapInArrow(place, f"{names}, sequence_id bigint, offset bigint").select(
        *cut.columns, "sequence_id", "offset"
    )
