"""Ids of a word-level BPE file of the tokenizers library, with each distinct pre-token encoded once per worker."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode's White_Space; the file's normaliser and pre-tokeniser never join or look across it.
_SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: Chunks that lower-casing letter by letter normalises as the file does: printable ASCII and the letters of Latin-1.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
#: The file's pre-tokens of such chunks, and the line ends that part chunks here.
_PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+|\n")
_LINE = 2000
_WORDS_AT_ONCE = 1 << 20


@lru_cache(maxsize=2)
def _tokenizers(path: str):
    """The file's tokenizer, and one for text that is normalised and parted into pre-tokens by single spaces already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True  # added tokens are parted off before, where they stand in the text as it is
    bare = Tokenizer(whole.model)
    bare.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return whole, bare


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``start, start + 1, ...`` of every stretch, one stretch after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out), dtype=out.dtype)
    return out


class _Table:
    """Stretches of numbers by index; grows at its end."""

    def __init__(self, kind):
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        ends = np.cumsum(sizes) + len(self.flat)
        self.starts = np.concatenate([self.starts, ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and numbers of the stretches at ``at``, one after the other."""
        sizes = self.sizes[at]
        return sizes, self.flat[ragged(self.starts[at], sizes)]


class WordEncoder:
    """Ids of whole texts as the library gives them with its defaults and ``add_special_tokens=False``.

    White space is dropped by the file's pre-tokeniser and nothing is merged or normalised across it, so the ids
    of a text are those of its chunks between white space, and those of a chunk are those of its pre-tokens. The
    strings of the file's added tokens are those tokens wherever a text holds them, before it is normalised.
    ``most`` bounds what is remembered, never the result.
    """

    def __init__(self, path: str, most: int = 700_000):
        self.whole, self.bare = _tokenizers(path)
        self.most = most
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[k for t, k in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        self.added = {t.content: k for k, t in self.whole.get_added_tokens_decoder().items()}
        self.part = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self._forget()

    def _forget(self) -> None:
        self.chunks, self.chunk_table = {}, _Table(np.int32)
        self.pre, self.pre_table = {"\n": 0}, _Table(np.uint32)
        self.pre_table.add(np.zeros(1, np.int64), np.zeros(0))

    def _encoded(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of pre-tokens, many to a text: the last id of each is the only one that ends a word."""
        lines = [pre_tokens[k : k + _LINE] for k in range(0, len(pre_tokens), _LINE)]
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for line, e in zip(lines, self.bare.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(line):
                each = [np.array(x.ids, np.uint32) for x in self.bare.encode_batch_fast(line, add_special_tokens=False)]
                cuts, ids = np.cumsum([len(x) for x in each]), np.concatenate(each)
            sizes.append(np.diff(cuts, prepend=0))
            flat.append(ids)
        return np.concatenate(sizes), np.concatenate(flat)

    def _learn(self, new: list[str]) -> list[int] | range:
        """Chunks of plain characters by their pre-tokens; any other as one, by the file's own normaliser and rules."""
        pre, known, first = self.pre, len(self.pre), len(self.chunks)
        plain = [c for c in new if _PLAIN.fullmatch(c)]
        other = [c for c in new if not _PLAIN.fullmatch(c)] if len(plain) < len(new) else []
        if plain:
            found = _PRE_TOKENS.findall("\n".join(plain).lower() + "\n")
            codes = np.array([pre.setdefault(x, len(pre)) for x in found], np.int32)
            stop = codes == 0
            ends = np.flatnonzero(stop)
            self.chunk_table.add(np.diff(ends, prepend=-1) - 1, codes[~stop])
            self.pre_table.add(*self._encoded(list(islice(pre, known, None))))
        if other:
            encoded = self.whole.encode_batch_fast([_SPACES.sub(" ", c) for c in other], add_special_tokens=False)
            ids = [np.array(e.ids, np.uint32) for e in encoded]
            self.chunk_table.add(np.ones(len(other), np.int64), len(pre) + np.arange(len(other)))
            self.pre_table.add(np.array([len(x) for x in ids], np.int64), np.concatenate(ids))
            pre.update(("\n" + c, len(pre) + k) for k, c in enumerate(other))
        self.chunks.update(zip([*plain, *other], range(first, first + len(new))))
        return [self.chunks[c] for c in new] if other else range(first, first + len(new))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), one after the other, and the bounds of each text there."""
        texts = pc.fill_null(texts, "")
        holds = np.zeros(len(texts), bool)
        for mark in self.added:
            holds |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._plain(texts)
        stretches, marks, owner = [], [], []
        for k in range(len(texts)):
            parts = self.part.split(texts[k].as_py()) if holds[k] else [texts[k].as_py()]
            stretches += parts[::2]
            marks += [[self.added[m]] for m in parts[1::2]] + [[]]
            owner += [k] * (len(parts) // 2 + 1)
        ids, bounds = self._plain(pa.array(stretches, texts.type))
        ids = np.concatenate([x for a, b, m in zip(bounds[:-1], bounds[1:], marks) for x in (ids[a:b], np.array(m, np.uint32))])
        sizes = np.diff(bounds) + [len(m) for m in marks]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, sizes, len(texts)).astype(np.int64))])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.chunks) > self.most:
            self._forget()
        texts = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)  # as the file does; fewer chunks
        split = pc.ascii_split_whitespace(texts)
        offsets, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        at = np.fromiter(map(self.chunks.get, names, repeat(-1)), np.int64, len(names))
        if len(new := np.flatnonzero(at < 0)):
            at[new] = self._learn(names[new].tolist())
        per_chunk, pre = self.chunk_table.of(at)
        per_pre, ids = self.pre_table.of(pre)
        ends = np.concatenate([[0], np.cumsum(per_pre)])[np.concatenate([[0], np.cumsum(per_chunk)])]
        starts, sizes = ends[:-1], np.diff(ends)
        within = coded.indices.to_numpy()
        counts = sizes[within]
        out = [ids[:0]]
        for k in range(0, len(within), _WORDS_AT_ONCE):
            some = within[k : k + _WORDS_AT_ONCE]
            out.append(ids[ragged(starts[some], counts[k : k + _WORDS_AT_ONCE])])
        return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])[offsets]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.flat(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


def closed(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds with ``end_id`` after each text."""
    return np.insert(ids, bounds[1:], end_id).astype("<u4"), bounds + np.arange(len(bounds))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker process: what it has learned serves the worker's next tasks too."""
    return WordEncoder(path)
