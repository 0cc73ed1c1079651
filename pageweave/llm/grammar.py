"""Token ids on disk, compressed by Re-Pair grammars."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageweave.functions.scratch import new_path, small_arrow_batches
from pageweave.llm.word_bpe import closed, encoder

MAGIC = b"RPG1"
SYMBOLS = 1 << 16
SLOT_BITS = 20
#: Ids that a reader holds expanded at once, or one document's if it has more.
IDS_AT_ONCE = 1 << 20


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = 6):
    """``(left, right, symbols, symbol ends)``: rules ``base + k -> left[k] right[k]`` and what the ids became.

    Re-Pair by falling frequency: the pairs of neighbours inside documents that stand at least half as often as the
    most frequent one get new symbols, together; then the pairs are counted again. Of pairs that overlap, the left one
    is replaced; a pair that would be replaced fewer than ``least`` times gets no symbol. It ends where no pair is
    left that can be replaced ``least`` times, or where all 16-bit symbols are given away.
    """
    x = ids.astype(np.uint16)
    last = np.zeros(len(x), bool)
    last[ends - 1] = True
    left, right = np.zeros(0, np.int64), np.zeros(0, np.int64)
    often = None
    while len(x) > 1 and (spare := SYMBOLS - base - len(left)) > 0:
        pair = x[:-1].astype(np.uint32) << 16 | x[1:]
        slot = _slot(pair)
        inside = ~last[:-1]
        full = np.bincount(slot[inside], minlength=1 << SLOT_BITS)  # no pair is more frequent than its slot
        top = int(full.max())
        often = min(often or top, top)
        at = np.zeros(0, np.int64)
        while often >= least and not len(at):
            often = max(least, often // 2) if often > least else least
            open_places = np.flatnonzero((full >= often)[slot] & inside)
            at, where, chosen = _replaceable(pair[open_places], open_places, often, spare, least)
            if not len(at) and often == least:
                often = 0
        if not len(at):
            break
        x[at] = base + len(left) + where
        last[at] = last[at + 1]
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        x, last = x[keep], last[keep]
        left, right = np.append(left, chosen >> 16), np.append(right, chosen & 0xFFFF)
    return left.astype(np.int64), right.astype(np.int64), x, np.flatnonzero(last) + 1


def _replaceable(pair: np.ndarray, places: np.ndarray, often: int, spare: int, least: int):
    """Places to replace, which pair stands at each, and the pairs: the most frequent ones of ``often`` or more."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    ordered = np.sort(pair)
    cut = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else none[0]
    counts = np.diff(np.append(cut, len(ordered)))
    pick = np.flatnonzero(counts >= often)
    if not len(pick):
        return none
    pick = pick[np.argsort(-counts[pick], kind="stable")[:spare]]
    for some in (pick, pick[:1]):  # where the pairs take each other's places, the most frequent one goes alone
        chosen = np.sort(ordered[cut[some]])
        where = np.minimum(np.searchsorted(chosen, pair), len(chosen) - 1)
        hit = chosen[where] == pair
        at, where = places[hit], where[hit]
        run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        even = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
        at, where = at[even], where[even]
        enough = np.bincount(where, minlength=len(chosen)) >= least
        if enough.any():
            good = enough[where]
            return at[good], (np.cumsum(enough) - 1)[where[good]], chosen[enough]
    return none


def _slot(pair: np.ndarray) -> np.ndarray:
    return (pair * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)


def expansion_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    n: list[int] = []
    for a, b in zip(left.tolist(), right.tolist()):
        n.append((1 if a < base else n[a - base]) + (1 if b < base else n[b - base]))
    return np.array(n, np.int64)


def pack_file(doc_ids: list, ids: list[bytes], base: int) -> bytes:
    """One file: header, rules with expansion lengths, documents (id, first symbol, first id), symbols."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    if len(flat) and int(flat.max()) >= base:
        raise ValueError("an id is outside the vocabulary")
    ends = np.cumsum([len(x) // 4 for x in ids])
    left, right, symbols, cuts = compress(flat, ends, base)
    lengths = expansion_lengths(left, right, base)
    return b"".join(
        [
            MAGIC,
            struct.pack("<IIIIQ", base, len(ids), len(left), len(symbols), len(flat)),
            left.astype("<u2").tobytes(),
            right.astype("<u2").tobytes(),
            lengths.astype("<u4").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.append(0, cuts).astype("<u4").tobytes(),
            np.append(0, ends).astype("<u4").tobytes(),
            symbols.astype("<u2").tobytes(),
        ]
    )


class GrammarFile:
    """Random access to the documents of a file, and to any stretch of a document's ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a grammar file")
        self.base, self.n_docs, n_rules, n_symbols, self.n_ids = struct.unpack_from("<IIIIQ", data, 4)
        at = 28

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        left, right, self.lengths = take("<u2", n_rules), take("<u2", n_rules), take("<u4", n_rules)
        self.null, self.doc_ids = take(np.uint8, self.n_docs), take("<i8", self.n_docs)
        self.first_symbol, self.first_id = take("<u4", self.n_docs + 1), take("<u4", self.n_docs + 1)
        self.symbols = take("<u2", n_symbols)
        self.left, self.right = left.astype(np.int64), right.astype(np.int64)
        self.sizes = np.concatenate([np.ones(self.base, np.int64), self.lengths.astype(np.int64)])

    def documents(self, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents ``first`` to ``stop``, one after the other, and the bounds of each there."""
        ids = self._expand(self.symbols[self.first_symbol[first] : self.first_symbol[stop]])
        return ids, self.first_id[first : stop + 1].astype(np.int64) - int(self.first_id[first])

    def document(self, k: int) -> np.ndarray:
        return self.documents(k, k + 1)[0]

    def stretch(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a document; by the stored lengths only what covers them is expanded."""
        s = self.symbols[self.first_symbol[k] : self.first_symbol[k + 1]]
        stop = max(start, stop)
        ends = np.cumsum(self.sizes[s])
        i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (int(ends[i - 1]) if i else 0)
        return self._expand(s[i:j], skip, stop - start) if stop > start else s[:0].astype("<u4")

    def _expand(self, s: np.ndarray, skip: int = 0, take: int | None = None) -> np.ndarray:
        """Ids of a run of symbols, or ``take`` of them after ``skip``.

        A rule's lengths tell where its two sides go, so that sides beyond the stretch are left as they are.
        """
        s = s.astype(np.int64)
        n = self.sizes[s]
        place = np.cumsum(n) - n - skip
        out = np.empty(int(n.sum()) if take is None else min(take, int(n.sum()) - skip), "<u4")
        while len(s):
            inside = (place < len(out)) & (place + self.sizes[s] > 0)
            s, place = s[inside], place[inside]
            leaf = s < self.base
            out[place[leaf]] = s[leaf]
            rule, place = s[~leaf] - self.base, place[~leaf]
            one, two = self.left[rule], self.right[rule]
            s, place = np.concatenate([one, two]), np.concatenate([place, place + self.sizes[one]])
        return out


def write_ids(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, base: int = 49408, ids_a_file: int = 1 << 21
) -> str:
    """Write the ids of all documents in ascending ``doc_id`` order; a Parquet table with a file in each row.

    Columns ``shard`` (in order of ``doc_id``), ``block`` and ``start`` (ids before it in its shard), ``n_ids``,
    ``data``. Only Spark's writer touches the store. Null and empty texts have their end id alone; a null ``doc_id``
    comes first; rows of one ``doc_id`` go by text; other columns are ignored.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark, rows=2500)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer_path).flat
        held, size, block, start = [], 0, 0, 0

        def flush():
            data = pack_file([d for d, _ in held], [i for _, i in held], base)
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "start": pa.array([start], pa.int64()),
                    "n_ids": pa.array([size], pa.int64()),
                    "data": pa.array([data], pa.binary()),
                }
            )

        for b in batches:
            ids, bounds = closed(*encode(b["text"]), end_id)
            for doc_id, i, j in zip(b["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                held.append((doc_id, ids[i:j].tobytes()))
                size += j - i
                if size >= ids_a_file:
                    yield flush()
                    held, block, start, size = [], block + 1, start + size, 0
        if held:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(run, "shard int, block int, start bigint, n_ids bigint, data binary").write.parquet(path)
    return path


def read_ids(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of the files under ``path``; ``ids`` little-endian unsigned.

    The driver gets one number per shard, to know the ids before it.
    """
    files = spark.read.schema("shard int, block int, start bigint, n_ids bigint, data binary").parquet(path)
    totals = sorted((r["shard"], r["n"]) for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before, done = {}, 0
    for shard, n in totals:
        before[shard] = done
        done += n
    shared = spark.sparkContext.broadcast(before)
    small_arrow_batches(spark)

    def run(batches):
        for b in batches:
            for shard, start, data in zip(*(b[c].to_pylist() for c in ("shard", "start", "data"))):
                f = GrammarFile(data)
                first = shared.value[shard] + start
                k = 0
                while k < f.n_docs:
                    stop = int(np.searchsorted(f.first_id, int(f.first_id[k]) + IDS_AT_ONCE, "right")) - 1
                    stop = min(max(stop, k + 1), k + 500, f.n_docs)
                    ids, bounds = f.documents(k, stop)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(f.doc_ids[k:stop], pa.int64(), mask=f.null[k:stop].astype(bool)),
                            "start": pa.array(first + f.first_id[k:stop].astype(np.int64)),
                            "n_tokens": pa.array(np.diff(bounds)),
                            "ids": pa.array([ids[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary()),
                        }
                    )
                    k = stop

    return files.select("shard", "start", "data").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def stored_ids(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write and read back; ``doc_id, start, n_tokens, ids``."""
    spark = docs.sparkSession
    return read_ids(spark, write_ids(docs, new_path(spark, "ids"), tokenizer_path))


def id_checksums(read: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
