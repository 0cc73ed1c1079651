"""TIFF pages: a reader for strips and tiles, and a writer to test and feed it."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageweave.functions.scratch import small_arrow_batches

# Tag numbers and codes of the TIFF 6.0 format, fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_BYTES = (
    256, 257, 258, 259, 262, 273, 277, 278, 279,
)
PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_BYTES = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_TYPE = {1: "B", 2: "s", 3: "H", 4: "I"}


def unpack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        run = 1
        while run < 128 and raw[i : i + 1] == raw[i + run : i + run + 1]:
            run += 1
        if run > 2:
            out += bytes([257 - run]) + raw[i : i + 1]
            i += run
            continue
        j = i
        while j < len(raw) and j - i < 128:
            if raw[j : j + 1] == raw[j + 1 : j + 2] == raw[j + 2 : j + 3]:
                break
            j += 1
        out += bytes([j - i - 1]) + raw[i:j]
        i = j
    return bytes(out)


def lzw_decode(raw: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, 9 to 12 bits, clear 256, end 257, widths change one code early."""
    out, at, width = [], 0, 9
    table: list[bytes] = []
    last = b""
    bits, have = 0, 0
    while True:
        while have < width:
            if at >= len(raw):
                return b"".join(out)
            bits, have, at = bits << 8 | raw[at], have + 8, at + 1
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            last = table[code]
        else:
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
            last = now
        out.append(last)
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1


def lzw_encode(raw: bytes) -> bytes:
    out, bits, have, width = bytearray(), 0, 0, 9
    table = {bytes([k]): k for k in range(256)}
    nxt = 258

    def put(code):
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
            bits &= (1 << have) - 1

    put(256)
    w = b""
    for k in range(len(raw)):
        c = raw[k : k + 1]
        if w + c in table:
            w += c
            continue
        put(table[w])
        table[w + c] = nxt
        nxt += 1
        if nxt >= 4094:
            put(256)
            table, nxt, width = {bytes([k]): k for k in range(256)}, 258, 9
        elif nxt > (1 << width) - 1:
            width += 1
        w = c
    if w:
        put(table[w])
        nxt += 1
        if nxt > (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


_UNPACK = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}
_PACK = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}


def read_pages(data: bytes):
    """Yield ``(width, height, samples per pixel, bits, compression, array rows x columns x samples)`` per page.

    Walks the chain of image directories of either byte order; a chain that returns to a directory it has seen ends
    there. 8- and 16-bit samples stored together, predictors 1 and 2.
    """
    e = {b"II": "<", b"MM": ">"}.get(data[:2])
    if e is None or struct.unpack_from(e + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(e + "I", data, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(e + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
            if kind in _TYPE:
                size = struct.calcsize(e + _TYPE[kind]) * count
                p = at + 10 + 12 * k
                if size > 4:
                    (p,) = struct.unpack_from(e + "I", data, p)
                tags[tag] = struct.unpack_from(f"{e}{count}{_TYPE[kind]}", data, p)
        w, h, s = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
        bits, how, pred = tags.get(BITS, (8,))[0], tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
        if bits not in (8, 16) or how not in _UNPACK or pred not in (1, 2):
            raise ValueError(f"not supported: {bits} bits, compression {how}, predictor {pred}")
        kind = np.dtype(e + ("u1" if bits == 8 else "u2"))
        tiled = TILE_AT in tags
        cw, ch = (tags[TILE_W][0], tags[TILE_H][0]) if tiled else (w, min(tags.get(ROWS, (h,))[0], h))
        page = np.zeros((h, w, s), kind.newbyteorder("="))
        across = -(-w // cw)
        for k, (p, size) in enumerate(zip(*(tags[x] for x in ((TILE_AT, TILE_BYTES) if tiled else (STRIP_AT, STRIP_BYTES))))):
            y, x = k // across * ch, k % across * cw
            rows = ch if tiled else min(ch, h - y)
            raw = _UNPACK[how](data[p : p + size])
            part = np.frombuffer(raw, kind, rows * cw * s).reshape(rows, cw, s).astype(page.dtype)
            if pred == 2:
                part = np.cumsum(part, axis=1, dtype=page.dtype)
            page[y : y + rows, x : x + cw] = part[: h - y, : w - x]
        yield w, h, s, bits, how, page
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)


def write_pages(
    pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 1024, tile: int = 0, order: str = "<"
) -> bytes:
    """A TIFF file of pages (rows x columns, or with samples; 8 or 16 bits); ``tile`` > 0 writes square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        h, w, s = page.shape
        ch, cw = (tile, tile) if tile else (min(rows, h), w)
        places, sizes = [], []
        for y in range(0, h, ch):
            for x in range(0, w, cw):
                part = page[y : y + ch, x : x + cw]
                if tile:
                    part = np.pad(part, ((0, ch - part.shape[0]), (0, cw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=part[:, :1] * 0)
                raw = _PACK[compression](part.astype(page.dtype.newbyteorder(order)).tobytes())
                places.append(len(out))
                sizes.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        at_tag, n_tag = (TILE_AT, TILE_BYTES) if tile else (STRIP_AT, STRIP_BYTES)
        bits = page.dtype.itemsize * 8
        tags = {WIDTH: ("I", [w]), HEIGHT: ("I", [h]), BITS: ("H", [bits] * s), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [1]), at_tag: ("I", places), SAMPLES: ("H", [s]), n_tag: ("I", sizes), PREDICTOR: ("H", [predictor])}
        tags |= {TILE_W: ("I", [tile]), TILE_H: ("I", [tile])} if tile else {ROWS: ("I", [ch])}
        entries = bytearray()
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{kind}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, 3 if kind == "H" else 4, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


#: Ways to store a file, which one a text's checksum tells, so that equal texts give equal files: most deflate, two in sixteen
#: PackBits and two LZW, in strips and tiles, with and without the predictor, in both byte orders.
LAYOUTS = (
    *[{"compression": DEFLATE}] * 6,
    *[{"compression": DEFLATE, "predictor": 2}] * 2,
    *[{"compression": DEFLATE, "tile": 64}] * 2,
    {"compression": DEFLATE, "tile": 32, "predictor": 2},
    {"compression": DEFLATE, "order": ">", "rows": 100},
    {"compression": PACKBITS},
    {"compression": PACKBITS, "tile": 32, "predictor": 2},
    {"compression": LZW, "rows": 256},
    {"compression": LZW, "tile": 64, "predictor": 2, "order": ">"},
)


def store_texts(docs: DataFrame, width: int = 64, page_rows: int = 16384, layouts: tuple[dict, ...] = LAYOUTS) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes, padded, as a TIFF of one or more 8-bit pages.

    Rows have 64 samples; a page has at most ``page_rows`` rows, so that a text of any length is stored whole. Null
    is the empty text, whose payload is one row of zeros. The ``layouts`` take turns by the CRC-32 of the payload.
    """
    small_arrow_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            sizes, media = [], []
            for t in b["text"].to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                raw += b"\0" * (max(width, -(-len(raw) // width) * width) - len(raw))
                image = np.frombuffer(raw, np.uint8).reshape(-1, width)
                layout = layouts[zlib.crc32(raw) % len(layouts)]
                media.append(write_pages([image[k : k + page_rows] for k in range(0, len(image), page_rows)], **layout))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def pages(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)`` -> one row per page, pages of a file adjacent and in order, in its partition.

    Adds ``page, n_pages, width, height, samples, bits, compression, pixels`` (samples as stored, row by row) and
    ``media_bytes, media_sha256`` of the file. A null or unreadable file gives one row with null page columns and
    ``error``.
    """
    small_arrow_batches(media.sparkSession)
    kind = dict(media.dtypes)["doc_id"]
    fields = [("doc_id", None), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("page", pa.int32()), ("n_pages", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, n, data in zip(b["doc_id"].to_pylist(), b["n_bytes"].to_pylist(), b["media"].to_pylist()):
                digest = hashlib.sha256(data).hexdigest() if data is not None else None
                head = (doc_id, n, None if data is None else len(data), digest)
                try:
                    if data is None:
                        raise ValueError("no file")
                    got = list(read_pages(data))
                    rows += [(*head, k, len(got), w, h, s, bits, how, p.tobytes(), None) for k, (w, h, s, bits, how, p) in enumerate(got)]
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    rows.append((*head, *[None] * 8, str(e)[:200]))
            cols = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t or b.schema.field("doc_id").type) for c, (_, t) in zip(cols, fields)], [f for f, _ in fields]
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        f"doc_id {kind}, n_bytes bigint, media_bytes bigint, media_sha256 string, page int, n_pages int, width int, "
        "height int, samples int, bits int, compression int, pixels binary, error string",
    )


def page_features(paged: DataFrame) -> DataFrame:
    """Rows of ``pages`` -> one row per file: payload size and digests, and ``feature``.

    The feature is the mean level of 16 equal stretches of the payload, two hexadecimal digits each, then its
    smallest and largest level. Pages of a file are adjacent, so no shuffle is needed.
    """
    kind = dict(paged.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        held: list[bytes] = []
        for b in batches:
            out = []
            for row in zip(*(b[c].to_pylist() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "n_pages", "pixels", "error"))):
                doc_id, n, size, digest, page, n_pages, pixels, error = row
                if error is not None:
                    raise ValueError(f"document {doc_id}: {error}")
                held.append(pixels)
                if page + 1 == n_pages:
                    raw = held[0] if len(held) == 1 else b"".join(held)
                    held = []
                    a = np.frombuffer(raw, np.uint8)
                    means = np.add.reduceat(a, np.arange(16) * len(a) // 16, dtype=np.int64) // np.diff(np.arange(17) * len(a) // 16)
                    feature = bytes(means.astype(np.uint8)).hex() + f"{a.min():02x}{a.max():02x}"
                    out.append((doc_id, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), size, digest, feature))
            cols = list(zip(*out)) or [()] * len(names)
            kinds = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return paged.mapInArrow(
        run,
        f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string",
    )
