"""Masked pseudo-likelihood of documents under a bidirectional window network over a vocabulary that is the corpus's."""

from __future__ import annotations

from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageweave.functions.scratch import saved, small_arrow_batches

#: Token classes: the most frequent words have one each, all other words share RARE classes.
GROUPS = 16
CLASSES = GROUPS * GROUPS
RARE = 64
OWN = CLASSES - RARE
SIDE = 2
WIDTH = 16
#: Words whose counts every task holds; those of all other words are joined.
COMMON = 1 << 16
#: Rows of a product of matrices, so few that it runs in one thread.
_ROWS = 1024
_AT_ONCE = 1 << 18
#: Bars of the histogram of counts for each doubling of the count.
_STEPS = 64
_MICRO = 1e6
_BYTE = float(np.log(257))
#: Outputs are held between these, so that their exponentials are finite.
_FAR = 60.0
_PLACES = np.arange(2 * SIDE) * (CLASSES + 1)
#: Places of a row's weights among all that enter.
_CELLS = np.arange(2 * SIDE * (CLASSES + 1) * WIDTH).reshape(-1, WIDTH)
_ONES = np.ones(GROUPS, np.float32)


class Network:
    """Embeddings of the ``SIDE`` tokens on each side, one table per place, summed, tanh, softmax in two levels.

    A class is one of GROUPS groups and one of GROUPS members of it: its probability is that of the group times that
    of the member in the group, so that a token costs 2 * GROUPS outputs.
    """

    def __init__(self, weights: np.ndarray | None = None):
        shapes = [(2 * SIDE, CLASSES + 1, WIDTH), (WIDTH, GROUPS), (GROUPS,), (GROUPS, WIDTH, GROUPS), (GROUPS, GROUPS)]
        sizes = [int(np.prod(s)) for s in shapes]
        if weights is None:
            rng = np.random.default_rng(1)
            weights = np.concatenate([rng.normal(0, sd, n) for sd, n in zip((0.3, 0.1, 0, 0.1, 0), sizes)])
        self.flat = np.array(weights, np.float32)
        ends = np.cumsum(sizes)
        self.enter, self.out, self.bias, self.inner, self.inner_bias = (
            self.flat[b - n : b].reshape(s) for b, n, s in zip(ends, sizes, shapes)
        )

    def hidden(self, around: np.ndarray) -> np.ndarray:
        out = self.enter[0].take(around[:, 0], 0)
        for k in range(1, 2 * SIDE):
            out += self.enter[k].take(around[:, k], 0)
        return np.tanh(out, out=out)

    @staticmethod
    def _exponentials(z: np.ndarray) -> np.ndarray:
        """In place; the sums of the rows."""
        np.minimum(z, _FAR, out=z)
        np.maximum(z, -_FAR, out=z)
        np.exp(z, out=z)
        return z @ _ONES

    @staticmethod
    def _by_group(group: np.ndarray):
        """Order of the tokens by the group of their class, and each group's stretch there."""
        order = np.argsort(group.astype(np.uint8), kind="stable")
        stops = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
        return order, [(g, a, b) for g, (a, b) in enumerate(zip([0, *stops[:-1]], stops)) if b > a]

    def log_probability(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each token's class given both sides."""
        out = np.empty(len(target), np.float32)
        order, stretches = self._by_group(target // GROUPS)
        for g, a, b in stretches:
            for k in range(a, b, _ROWS):
                some = order[k : min(k + _ROWS, b)]
                hidden = self.hidden(around.take(some, 0))
                z = hidden @ self.out
                z += self.bias
                sums = self._exponentials(z)
                p = z[:, g] / sums
                z = hidden @ self.inner[g]
                z += self.inner_bias[g]
                sums = self._exponentials(z)
                p *= z[np.arange(len(some)), target[some] % GROUPS] / sums
                out[some] = np.log(np.maximum(p, 1e-30))
        return out

    def train(self, around: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient descent on a batch."""
        order, stretches = self._by_group(target // GROUPS)
        around, t = around.take(order, 0), target.take(order)
        group, member = np.divmod(t, GROUPS)
        hidden, row, step = self.hidden(around), np.arange(len(t)), np.float32(rate / len(t))
        z = hidden @ self.out
        z += self.bias
        z /= self._exponentials(z)[:, None]
        z[row, group] -= 1
        back = z @ self.out.T
        grad, bias = hidden.T @ z, z.sum(0)
        for g, a, b in stretches:
            np.matmul(hidden[a:b], self.inner[g], out=z[a:b])
        z += self.inner_bias.take(group, 0)
        z /= self._exponentials(z)[:, None]
        z[row, member] -= 1
        for g, a, b in stretches:
            back[a:b] += z[a:b] @ self.inner[g].T
            self.inner[g] -= step * (hidden[a:b].T @ z[a:b])
        some = [g for g, _, _ in stretches]
        self.inner_bias[some] -= step * np.add.reduceat(z, [a for _, a, _ in stretches], 0)
        self.out -= step * grad
        self.bias -= step * bias
        hidden *= hidden
        np.subtract(1, hidden, out=hidden)
        hidden *= step
        back *= hidden
        at = _CELLS.take(around + _PLACES, 0).ravel()
        sums = np.bincount(at, np.repeat(back[:, None], 2 * SIDE, 1).ravel(), self.enter.size)
        self.enter -= sums.reshape(self.enter.shape).astype(np.float32)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased white-space words of the texts (null: none), the word at each place, bounds of each text."""
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    coded = split.flatten().dictionary_encode()
    within, bounds = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    blank = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    if blank.any():  # a text without a word is one empty string
        real = ~blank[within]
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        within = within[real]
    return coded.dictionary, within, bounds


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over the whole corpus; each batch counts its own words first."""
    small_arrow_batches(docs.sparkSession, rows=1500)

    def run(batches):
        for b in batches:
            names, within, _ = words_of(b["text"])
            n = np.bincount(within, minlength=len(names))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(some)).cast(pa.string()), pa.array(n[some])], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon(NamedTuple):
    """The most frequent words with their counts; tokens and once-found words of each of the RARE classes."""

    common: list[str]
    counts: np.ndarray
    tokens: np.ndarray
    once: np.ndarray

    @property
    def seen(self) -> np.ndarray:
        """Per class, the logarithm of what an earlier occurrence of a word counts for."""
        with np.errstate(divide="ignore"):
            return np.log(1 - self.once / np.maximum(self.tokens, 1)) - np.log(np.maximum(self.tokens - 1, 1))

    @property
    def unseen(self) -> np.ndarray:
        """Per class, the logarithm of the share of words that are found nowhere else."""
        return np.log(np.maximum(self.once, 1) / np.maximum(self.tokens, 1))


def rare_class(word: str) -> int:
    """One of RARE classes by a word's last two characters."""
    return xxhash.xxh64_intdigest(word[-2:].encode("utf-8", "surrogatepass"), 42) % RARE


def lexicon(counts: DataFrame, common: int = COMMON) -> Lexicon:
    """From ``counts(word, n)``: the words of the highest counts that are at most ``common`` together; ties by word.

    The driver gets a histogram of the counts' logarithms, those words, and RARE numbers.
    """
    step = F.floor(F.log2("n") * _STEPS).alias("step")
    found = sorted(((r["step"], r["count"]) for r in counts.groupBy(step).count().collect()), reverse=True)
    lowest, total = None, 0
    for k, n in found:
        total += n
        if total > common:
            break
        lowest = k
    top = [] if lowest is None else counts.filter(step >= lowest).collect()
    top.sort(key=lambda r: (-r["n"], r["word"]))
    own = [r["word"] for r in top[:OWN]]
    of = F.pmod(F.xxhash64(F.right("word", F.lit(2))), F.lit(RARE))
    rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in own], "word string")), "word", "left_anti")
    sums = rest.groupBy(of.alias("c")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).collect()
    tokens, once = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
    for r in sums:
        tokens[r["c"]], once[r["c"]] = r["n"], r["once"]
    return Lexicon([r["word"] for r in top], np.array([r["n"] for r in top], np.int64), tokens, once)


class Tokens:
    """Class of each word, and the logarithm of a common word's share of its class, in millionths."""

    def __init__(self, lex: Lexicon):
        self.place = {w: k for k, w in enumerate(lex.common)}
        n = len(lex.common)
        self.klass = np.arange(n)
        self.klass[OWN:] = [OWN + rare_class(w) for w in lex.common[OWN:]]
        size = np.array([len(w.encode("utf-8", "surrogatepass")) for w in lex.common], np.int64)
        self.share = np.where(np.arange(n) < OWN, 0, _share(lex, lex.counts, np.maximum(self.klass - OWN, 0), size))
        self.suffix: dict[str, int] = {}

    def of(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Class of each name, and its place among the common words or -1."""
        words = names.to_numpy(zero_copy_only=False)
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        klass = self.klass[place] if len(self.klass) else place.copy()
        suffix = self.suffix
        for k in np.flatnonzero(place < 0).tolist():
            end = words[k][-2:]
            if (c := suffix.get(end)) is None:
                c = suffix[end] = OWN + rare_class(end)
            klass[k] = c
        return klass, place


def _share(lex: Lexicon, n: np.ndarray, klass: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log-share of a word in its class in millionths, without the occurrence itself; see ``score``."""
    known = lex.seen[klass] + np.log(np.maximum(n - 1, 1))
    return np.rint(_MICRO * np.where(n > 1, known, lex.unseen[klass] - (size + 1) * _BYTE)).astype(np.int64)


def windows(target: np.ndarray, bounds: np.ndarray, first: int, stop: int) -> np.ndarray:
    """Classes around the places ``first`` to ``stop``; ``CLASSES`` stands beyond a text's ends."""
    at = np.arange(first, stop)
    text = np.searchsorted(bounds, at, "right") - 1
    low, high = bounds[text], bounds[text + 1]
    out = np.full((len(at), 2 * SIDE), CLASSES, np.int64)
    for j, k in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
        ok = (at + k >= low) & (at + k < high)
        out[ok, j] = target[(at + k)[ok]]
    return out


def train(docs: DataFrame, lex: Lexicon, rounds: int = 1, rate: float = 2.0, batch: int = _ROWS) -> np.ndarray:
    """Weights of the network after ``rounds`` of averaging what the slices of the corpus have learned.

    In a round each slice descends from the common weights over all tokens of its texts, in an order that its seed
    fixes, and Spark averages the results, weighted by tokens, in whole numbers, so that their order does not matter.
    The driver gets one number per weight. The slices are those of the input, so the same files give the same
    weights. A corpus without words leaves the first weights.
    """
    sc = docs.sparkSession.sparkContext
    small_arrow_batches(docs.sparkSession, rows=1500)
    weights = Network().flat
    for r in range(rounds):
        shared = sc.broadcast((weights, lex))  # a fixed number of weights, at most COMMON words

        def learn(batches, r=r, shared=shared):
            start, lex = shared.value
            net, tokens, n = Network(start), Tokens(lex), 0
            rng = np.random.default_rng(r)
            for b in batches:
                names, within, bounds = words_of(b["text"])
                target = tokens.of(names)[0][within]
                for k in range(0, len(target), _AT_ONCE):
                    around, t = windows(target, bounds, k, min(k + _AT_ONCE, len(target))), target[k : k + _AT_ONCE]
                    order = rng.permutation(len(t))
                    for j in range(0, len(t), batch):
                        some = order[j : j + batch]
                        net.train(around[some], t[some], rate * len(some) / batch)
                    n += len(t)
            if n:
                fixed = np.rint(net.flat.astype(np.float64) * (1 << 24)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(fixed)), pa.int32()), pa.array(fixed), pa.array(np.full(len(fixed), n))], ["k", "w", "n"]
                )

        whole = "decimal(38, 0)"
        got = (
            docs.select("text")
            .mapInArrow(learn, "k int, w bigint, n bigint")
            .groupBy("k")
            .agg((F.sum(F.col("w").cast("decimal(20, 0)") * F.col("n").cast("decimal(18, 0)")).cast(whole).cast("double") / F.sum("n")).alias("w"))
            .toArrow()  # one row per weight
        )
        if got.num_rows:
            weights = np.array(weights)
            weights[got["k"].to_numpy()] = got["w"].to_numpy() / (1 << 24)
    return weights


def score(docs: DataFrame, lex: Lexicon, counts: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, n_tokens, pseudo_log_likelihood, mean_log_probability``.

    The sum, over every token of the whole text, of its log-probability given the tokens on both sides: that of its
    class by the network, and that of the word in the class. Words with a class of their own have all of it. In a
    shared class, words found elsewhere in the corpus (the occurrence itself left out) share by their counts what
    once-found words leave; a word found nowhere else takes the once-found words' share, written out in bytes, all
    equally likely. The counts of words beyond the common ones are joined by hash, at most one row a document and
    word. Sums are made in whole millionths, so their order does not matter; the network's outputs are 32-bit numbers,
    whose last digit may follow the batch that a text comes in.

    A null, empty or blank text has no token: sum 0 and a null mean. Repeated rows score alike; a null ``doc_id`` is
    scored like any other; other columns are ignored.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark, rows=1500)
    shared = spark.sparkContext.broadcast((weights, lex))
    kind = dict(docs.dtypes)["doc_id"]
    item = pa.struct([("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int32())])

    def run(batches):
        weights, lex = shared.value
        net, tokens = Network(weights), Tokens(lex)
        for b in batches:
            names, within, bounds = words_of(b["text"])
            klass, place = tokens.of(names)
            target, n = klass[within], np.diff(bounds)
            parts = [np.zeros(0, np.int64)]
            for k in range(0, len(target), _AT_ONCE):
                lp = net.log_probability(windows(target, bounds, k, min(k + _AT_ONCE, len(target))), target[k : k + _AT_ONCE])
                parts.append(np.rint(_MICRO * lp.astype(np.float64)).astype(np.int64))
            common = np.where(place < 0, 0, tokens.share[place]) if len(tokens.share) else np.zeros(len(names), np.int64)
            sums = np.concatenate([[0], np.cumsum(np.concatenate(parts) + common[within])])[bounds]
            at = np.flatnonzero(place[within] < 0)
            pair, tf = np.unique((np.searchsorted(bounds, at, "right") - 1) * len(names) + within[at], return_counts=True)
            text, word = np.divmod(pair, max(1, len(names)))
            distinct, where = np.unique(word, return_inverse=True)
            rare = names.take(pa.array(distinct))
            h = np.array([xxhash.xxh64_intdigest(w, 42) for w in rare.to_pylist()], np.uint64).view(np.int64)[where]
            size = pc.binary_length(rare).to_numpy().astype(np.int64)[where]
            # one item of class -1 for each text with its tokens and sum, then its rare words
            first = np.searchsorted(text, np.arange(len(n)))
            mark = np.random.default_rng(len(pair)).integers(-(1 << 63), 1 << 63, len(n))  # these meet no word, and no one task
            cols = [np.insert(x, first, y) for x, y in ((h, mark), (tf, n), (size, np.diff(sums)), (klass[word] - OWN, -1))]
            items = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(cols, item)], fields=list(item))
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(n)) + 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["version"], pa.ListArray.from_arrays(pa.array(ends), items)], ["doc_id", "version", "items"]
            )

    items = "array<struct<h: bigint, a: bigint, b: bigint, c: int>>"
    rows = (
        docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
        .mapInArrow(run, f"doc_id {kind}, version bigint, items {items}")
        .select("doc_id", "version", F.inline("items"))
    )
    known = counts.filter("n > 1").groupBy(F.xxhash64("word").alias("h")).agg(F.sum("n").alias("n"))
    seen, unseen = (F.get(F.array(*[F.lit(float(x)) for x in t]), F.col("c")) for t in (np.maximum(lex.seen, -1e9), lex.unseen))
    own = F.when(F.col("n") > 1, seen + F.log(F.col("n") - 1.0)).otherwise(unseen - (F.col("b") + 1) * F.lit(_BYTE))
    part = F.when(F.col("c") < 0, F.col("b")).otherwise(F.col("a") * F.rint(_MICRO * own).cast("bigint"))
    sums = (
        rows.join(known, "h", "left")
        .groupBy("doc_id", "version")
        .agg(F.sum(part).alias("s"), F.max(F.when(F.col("c") < 0, F.col("a"))).alias("n_tokens"), F.count_if(F.col("c") < 0).alias("copies"))
    )
    total = (F.expr("s div copies") / F.lit(_MICRO)).alias("total")
    once = sums.select("doc_id", "n_tokens", total, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    mean = F.when(F.col("n_tokens") > 0, F.round(F.col("total") / F.col("n_tokens"), 6))
    return once.select("doc_id", "n_tokens", F.round("total", 4).alias("pseudo_log_likelihood"), mean.alias("mean_log_probability"))


def fit_and_score(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """Count words, train over the corpus, score every document."""
    counts = saved(word_counts(docs), "words")
    lex = lexicon(counts, common)
    return score(docs, lex, counts, train(docs, lex))
