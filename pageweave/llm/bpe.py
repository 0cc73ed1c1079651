"""Byte-level BPE encoding and decoding by a global shuffle of distinct words."""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageweave.functions.scratch import small_arrow_batches

#: Unicode's White_Space, which is what ``\s`` means to the pattern's own engine.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """The pre-token pattern with ``\\s`` spelled out."""
    out = pattern.replace("[^\\s", f"[^{_SPACE}").replace("\\S", f"[^{_SPACE}]").replace("\\s", f"[{_SPACE}]")
    return regex.compile(out)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def _varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian base-128 numbers in one run of bytes, and where each of them ends there."""
    size = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[(ends - size)[has] + k] = (numbers[has] >> 7 * k & 127).astype(np.uint8) | more
    return out, ends


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``start, start + 1, ...`` of every stretch, one stretch after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _unvarint(raw: bytes) -> np.ndarray:
    """All numbers of a run of little-endian base-128 numbers."""
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(a < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = (a[starts] & 127).astype(np.int64)
    for k in range(1, int((ends - starts).max()) + 1):
        more = starts + k <= ends
        out[more] |= (a[starts[more] + k] & 127).astype(np.int64) << (7 * k)
    return out


class _Block:
    """Documents of one input slice: each distinct word once, and each text as its words' codes in order.

    A code's place in the stream is its word's position. The pattern lets a single space between two other
    characters only open a word, so the pieces between such spaces split independently of each other: each
    distinct piece of the block is split once, many to a call. A text with any other white space beside a space
    is split whole.
    """

    def __init__(self, pattern: str):
        self.pattern, self.ids, self.pieces, self.bad = pattern, [], {}, bytearray()
        self.whole: dict[int, str] = {}
        self.places, self.counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        self.n_docs = 0

    def add(self, doc_id, text: str) -> None:
        self.add_all(pa.array([doc_id]), pa.array([text], pa.string()))

    def add_all(self, ids: pa.Array, texts: pa.Array) -> None:
        known, at_edge = self.pieces, _edges()
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        for p in names:
            if p not in known:
                known[p] = len(known)
                self.bad.append(p[:1] in at_edge or p[-1:] in at_edge)
        here = np.fromiter((known[p] for p in names), np.int32, len(names))
        bad = np.fromiter((self.bad[k] for k in here.tolist()), bool, len(names))
        within = coded.indices.to_numpy()
        for i in np.flatnonzero(np.logical_or.reduceat(bad[within], bounds[:-1])).tolist():
            self.whole[self.n_docs + i] = texts[i].as_py()
        self.places.append(here[within])
        self.counts.append(np.diff(bounds).astype(np.int64))
        self.ids.append(ids)
        self.n_docs += len(texts)

    @cached_property
    def words(self) -> list[str]:
        """The words in order of their codes; the block is closed by this."""
        find, words = splitter(self.pattern).findall, {}
        code = lambda found: [words.setdefault(w, len(words)) for w in found]
        pieces = list(self.pieces)
        self.pieces = {}
        counts, places = np.concatenate(self.counts), np.concatenate(self.places)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        firsts = bounds[:-1]
        inner = np.ones(self.n_docs, bool)
        inner[list(self.whole)] = False
        inner = np.repeat(inner, counts)
        inner[firsts] = False
        used = np.zeros(len(pieces), bool)
        used[places[inner]] = True
        sizes = np.zeros(len(pieces) + len(firsts), np.int64)
        codes = []
        chosen = np.flatnonzero(used)
        for k in range(0, len(chosen), 5_000):
            some = chosen[k : k + 5_000]
            found = find(" " + " ".join([pieces[i] for i in some.tolist()]))
            opens = np.flatnonzero(np.fromiter((w[0] == " " for w in found), bool, len(found)))
            if len(opens) != len(some):
                raise ValueError("the pattern does not open a word at every single space")
            sizes[some] = np.diff(np.append(opens, len(found)))
            codes.append(np.array(code(found), np.uint32))
        lone = []
        for i, first in enumerate(places[firsts].tolist()):
            found = code(find(self.whole[i] if i in self.whole else pieces[first]))
            sizes[len(pieces) + i] = len(found)
            lone += found
        codes.append(np.array(lone, np.uint32))
        self.bounds, self.inner, self.places = bounds, inner, places
        self.sizes, self.codes = sizes, np.concatenate(codes)
        order = np.concatenate([chosen, np.arange(len(pieces), len(sizes))])
        self.starts = np.zeros(len(sizes), np.int64)
        self.starts[order] = np.cumsum(sizes[order]) - sizes[order]
        self.n_pieces = len(pieces)
        self.whole.clear()
        return list(words)

    @property
    def docs(self) -> list:
        ids = [i for some in self.ids for i in some.to_pylist()]
        return list(zip(ids, (x for some in self.streams(250) for x in some)))

    def streams(self, docs: int):
        """Lists of the codes of each text, packed, in the order of the input; ``words`` is read before."""
        for k in range(0, len(self.bounds) - 1, docs):
            bounds = self.bounds[k : k + docs + 1]
            here = slice(bounds[0], bounds[-1])
            units, stays = self.places[here].astype(np.int64), self.inner[here].copy()
            firsts = bounds[:-1] - bounds[0]
            units[firsts] = self.n_pieces + k + np.arange(len(firsts))
            stays[firsts] = True
            units = units[stays]
            sizes = self.sizes[units]
            raw, ends = _varints(self.codes[_ragged(self.starts[units], sizes)])
            ends = np.concatenate([[0], ends])
            last = np.append(np.cumsum(stays)[firsts] - 1, len(units))
            cuts = ends[np.concatenate([[0], np.cumsum(sizes)])[last]]
            yield [raw[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=1)
def _edges() -> frozenset[str]:
    """White space characters, and the empty string, which stands for a piece without characters."""
    return frozenset(regex.findall(f"[{_SPACE}]", "".join(map(chr, range(0x3001))))) | {""}


def _blocks(batches, pattern: str, limit: int):
    """Cut by the texts alone, however the batches fall."""
    block, size = _Block(pattern), 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, before = 0, 0
        while start < len(ends):
            k = int(np.searchsorted(ends, before + limit - size, side="right"))
            block.add_all(batch["doc_id"].slice(start, k + 1 - start), batch["text"].slice(start, k + 1 - start))
            if k >= len(ends):
                size += int(ends[-1]) - before
                break
            yield block
            block, size, start, before = _Block(pattern), 0, k + 1, int(ends[k])
    if block.n_docs:
        yield block


def _key(words: list[bytes]) -> int:
    """A block's key follows from its words in order of their codes: equal keys have equal codes."""
    h = xxhash.xxh64(np.array([len(w) for w in words], np.uint32).tobytes(), seed=7)
    h.update(b"".join(words))
    return h.intdigest() - (1 << 63)


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, block_chars: int = 48 << 20, buckets: int | None = None
) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, ids)``: ids as little-endian unsigned 32-bit integers in a binary.

    Every slice of the input gives each of its distinct words once, with a code, and each text as the codes of
    its words by position. The words are dealt by hash and a word of the whole corpus is encoded once, where its
    rows meet; the ids go back to the slices, whose texts are put together by position. What moves is one row
    of packed words per slice and bucket, and one row of codes per text: no word is ever a hot key.

    Null and empty texts give no ids; repeated rows, and rows with a null ``doc_id``, are encoded as they come;
    other columns are ignored. The result has one row per input row. The input must give the same rows in the
    same order when it is read twice, as files do; otherwise the job fails rather than give wrong ids.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or parts
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = pa.int64() if dict(texts.dtypes)["doc_id"] == "bigint" else pa.string()

    def words_of(batches):
        for block in _blocks(batches, pattern, block_chars):
            words = [w.encode() for w in block.words]
            del block
            at: list[list[int]] = [[] for _ in range(buckets)]
            for code, w in enumerate(words):
                at[xxhash.xxh64_intdigest(w) % buckets].append(code)
            filled = [k for k in range(buckets) if at[k]]
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(filled, pa.int32()),
                    "block": pa.array([_key(words)] * len(filled), pa.int64()),
                    "codes": pa.array([np.array(at[k], np.uint32).tobytes() for k in filled], pa.binary()),
                    "sizes": pa.array(
                        [np.array([len(words[c]) for c in at[k]], np.uint32).tobytes() for k in filled], pa.binary()
                    ),
                    "words": pa.array([b"".join([words[c] for c in at[k]]) for k in filled], pa.binary()),
                }
            )

    def texts_of(batches):
        for block in _blocks(batches, pattern, block_chars):
            key = _key([w.encode() for w in block.words])
            block.words.clear()
            ids = pa.chunked_array(block.ids)
            for k, some in enumerate(block.streams(250)):
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([key] * len(some), pa.int64()),
                        "doc_id": ids.slice(250 * k, len(some)).cast(id_type).combine_chunks(),
                        "codes": pa.array(some, pa.binary()),
                    }
                )

    def encode_words(batches):
        one = _encoding(ranks_path, pattern)._encode_single_piece
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = {"block": [], "codes": [], "sizes": [], "ids": []}
            for block, codes, sizes, words in zip(*(batch[c].to_pylist() for c in ("block", "codes", "sizes", "words"))):
                ids, at = [], 0
                for n in np.frombuffer(sizes, np.uint32).tolist():
                    w = words[at : at + n]
                    at += n
                    if (x := known.get(w)) is None:
                        x = known[w] = array("H", one(w)).tobytes()
                    ids.append(x)
                out["block"].append(block)
                out["codes"].append(codes)
                out["sizes"].append(np.array([len(x) // 2 for x in ids], np.uint32).tobytes())
                out["ids"].append(b"".join(ids))
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array(out["block"], pa.int64())}
                | {c: pa.array(out[c], pa.binary()) for c in ("codes", "sizes", "ids")}
            )

    def ids_of(run: list[bytes], table: np.ndarray, flat: np.ndarray) -> list[bytes]:
        raw = b"".join(run)
        at = _unvarint(raw)
        if len(at) and (int(at.max()) >= table.shape[1] or (table[1, at] < 0).any()):
            raise ValueError("the input gave other rows when it was read again")
        n = table[1, at]
        ids = flat[_ragged(table[0, at], n)].astype("<u4")
        codes = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) < 128)])
        cuts = np.concatenate([[0], np.cumsum(n)])[codes[np.cumsum([0, *map(len, run)])]]
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]

    def reassemble(batches):
        block, table, parts, flat = None, None, [], None
        for batch in batches:
            out, run, size = [], [], 0
            rows = zip(*(batch[c].to_pylist() for c in ("block", "codes", "sizes", "ids")))
            for key, codes, sizes, ids in rows:
                if run and (key != block or size > 1 << 19):
                    out += ids_of(run, table, flat)
                    run, size = [], 0
                if key != block:
                    block, table, parts = key, None, []
                if ids is not None:
                    parts.append((codes, sizes, ids))
                    continue
                if table is None:
                    c = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(p[0], np.uint32) for p in parts)])
                    n = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(p[1], np.uint32) for p in parts)])
                    flat = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(p[2], np.uint16) for p in parts)])
                    table = np.zeros((2, int(c.max()) + 1 if len(c) else 0), np.int64)
                    table[1] = -1
                    table[0, c], table[1, c] = np.cumsum(n, dtype=np.int64) - n, n
                    parts = []
                run.append(codes)
                size += len(codes)
            if run:
                out += ids_of(run, table, flat)
            docs_out = batch["doc_id"].filter(batch["ids"].is_null())
            yield pa.RecordBatch.from_arrays([docs_out, pa.array(out, pa.binary())], ["doc_id", "ids"])

    kind = "bigint" if id_type == pa.int64() else "string"
    words = texts.mapInArrow(
        words_of, "bucket int, block bigint, codes binary, sizes binary, words binary"
    ).repartition(buckets, "bucket")
    coded = words.mapInArrow(encode_words, "block bigint, codes binary, sizes binary, ids binary")
    streams = texts.mapInArrow(texts_of, f"block bigint, doc_id {kind}, codes binary")
    met = (
        coded.select("block", "codes", "sizes", "ids", F.lit(None).cast(kind).alias("doc_id"), F.lit(0).alias("after"))
        .unionByName(
            streams.select(
                "block",
                "codes",
                F.lit(None).cast("binary").alias("sizes"),
                F.lit(None).cast("binary").alias("ids"),
                "doc_id",
                F.lit(1).alias("after"),
            )
        )
        .repartition(parts, "block")
        .sortWithinPartitions("block", "after")
    )
    return met.mapInArrow(reassemble, f"doc_id {kind}, ids binary")


@lru_cache(maxsize=4)
def _token_bytes(ranks_path: str) -> pa.Array:
    """The token-byte table by id; ids that the file leaves out are null."""
    of = {v: k for k, v in ranks(ranks_path).items()}
    return pa.array([of.get(i) for i in range(max(of, default=-1) + 1)], pa.large_binary())


@lru_cache(maxsize=2)
def _decimals(n: int) -> pa.Array:
    return pa.array([b"%d " % i for i in range(n)], pa.large_binary())


def _joined(table: pa.Array, ids: np.ndarray) -> memoryview | bytes:
    """The values of ``table`` at ``ids``, one after the other."""
    values = table.take(pa.array(ids))
    if values.null_count:
        raise ValueError("an id is not in the token-byte table")
    if not len(ids):
        return b""
    _, ends, data = values.buffers()
    return memoryview(data)[: int(np.frombuffer(ends, np.int64)[len(ids)])]


def _decoded(batches, ranks_path: str):
    table = _token_bytes(ranks_path)
    for batch in batches:
        out = [bytes(_joined(table, np.frombuffer(x.as_py() or b"", "<u4"))) for x in batch["ids"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])


def _digested(batches):
    names = _decimals(1 << 16)
    for batch in batches:
        n, a, b = [], [], []
        for ids, text in zip(batch["ids"], batch["decoded"]):
            ids = np.frombuffer(ids.as_py() or b"", "<u4")
            if len(ids) and int(ids.max()) >= len(names):
                names = _decimals(int(ids.max()) + 1)
            n.append(len(ids))
            a.append(hashlib.sha256(_joined(names, ids)[:-1]).hexdigest())
            b.append(hashlib.sha256(text.as_py() or b"").hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, ids)`` -> the same with ``decoded``: the bytes of the ids, in order.

    The token-byte table has one row per rank, a bound that the vocabulary file sets, so each task joins it from
    memory. A null ``ids`` decodes to no bytes; an id outside the table fails the job.
    """
    small_arrow_batches(encoded.sparkSession)
    kind = dict(encoded.dtypes)["doc_id"]
    schema = f"doc_id {kind}, ids binary, decoded binary"
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, ranks_path), schema)


_DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(decoded: DataFrame) -> DataFrame:
    """``(doc_id, ids, decoded)`` -> ``doc_id, n_tokens, ids_sha256, decoded_sha256``; a null counts as empty."""
    return decoded.mapInArrow(_digested, f"doc_id {dict(decoded.dtypes)['doc_id']}, {_DIGESTS}")


def decoded_digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``digests(decode(encoded))`` in one pass.

    Decoding and digests share a worker, so that the decoded bytes do not pass through the JVM.
    """
    small_arrow_batches(encoded.sparkSession)
    kind = dict(encoded.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {_DIGESTS}"
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _digested(_decoded(batches, ranks_path)), schema)
