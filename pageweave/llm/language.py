"""Language identification by multilingual mixtures."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageweave.functions.scratch import small_arrow_batches

BUCKETS = 1 << 15
MOST_LANGUAGES = 500


def _features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter trigrams of the texts, one after another, and the number of each text.

    Letters are lower-cased; each run of anything else counts as one space, and a space stands at both ends.
    """
    ends, raw = [], []
    for t in texts:
        t = t.lower() if t else ""
        raw.append(" " + t + " \n")
        ends.append(len(raw[-1]))
    joined = "".join(raw)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), ends)
    letter = _is_letter(cp)
    stop = cp == 10
    stop &= np.isin(np.arange(len(cp)), np.cumsum(ends) - 1)
    code = np.where(letter, cp, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    keep[:-1] |= np.diff(owner) > 0
    keep &= ~stop
    # a space opens each text even where its first character is none of the letters
    first = np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(ends) else np.zeros(0, int)
    keep[first] = True
    code, owner = code[keep], owner[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = (owner[2:] == owner[:-2]) & (code[1:-1] != 32)
    h = (code[:-2] << np.uint64(42)) ^ (code[1:-1] << np.uint64(21)) ^ code[2:]
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    return h[whole].astype(np.int64), owner[2:][whole]


_letters = None


def _is_letter(cp: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[cp]


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: a language is given and crc32 of the id as text, modulo 4, is not 2.

    A null ``doc_id`` has no remainder: such a row is neither learned from nor held out.
    """
    return docs.filter(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))


def fit(docs: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (language by bucket) from all training rows.

    Counts are summed by Spark; the driver gets at most ``MOST_LANGUAGES`` x ``BUCKETS`` of them, whatever the
    number of documents. Without a training row there are no languages.
    """
    small_arrow_batches(docs.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                got = np.bincount(_features(texts)[0], minlength=BUCKETS)
                sums[lang] = sums[lang] + got if lang in sums else got
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(at), "bucket": pa.array(at, pa.int32()), "n": pa.array(c[at], pa.int64())}
            )

    rows = (
        training_rows(docs)
        .select("lang", "text")
        .mapInArrow(count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .limit(MOST_LANGUAGES * BUCKETS + 1)
        .toArrow()
    )
    if rows.num_rows > MOST_LANGUAGES * BUCKETS:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(set(rows["lang"].to_pylist()))
    table = np.full((len(langs), BUCKETS), smoothing)
    if langs:
        where = {x: k for k, x in enumerate(langs)}
        table[[where[x] for x in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _em(c: np.ndarray, p: np.ndarray, start: np.ndarray, mix: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document (row of ``mix``) and its log-likelihood; features of a document are adjacent."""
    sizes = np.diff(np.append(start, len(c)))
    total = np.maximum(np.add.reduceat(c, start), 1e-9)
    for _ in range(rounds):
        part = p * np.repeat(mix, sizes, 0)
        part *= (c / np.maximum(part.sum(1), 1e-30))[:, None]
        mix = np.add.reduceat(part, start, 0) / total[:, None]
    like = np.log(np.maximum((p * np.repeat(mix, sizes, 0)).sum(1), 1e-30))
    return mix, np.add.reduceat(like * c, start)


def infer(
    texts: list[str | None], langs: list[str], logp: np.ndarray, penalty: float = 4.0, rounds: int = 12
) -> list[dict[str, float]]:
    """Language proportions of each text; an empty dict where the text has no feature or nothing was learned.

    Expectation-maximisation over all languages; then languages are given up one by one, the least first, as long
    as that lowers ``-2 log L + penalty * k * log n`` (k languages, n features).
    """
    h, owner = _features(texts)
    out: list[dict[str, float]] = [{} for _ in texts]
    if not langs or not len(h):
        return out
    both, counts = np.unique(owner * BUCKETS + h, return_counts=True)
    owner, h = both // BUCKETS, both % BUCKETS
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    docs = owner[start]
    c = counts.astype(np.float64)
    lp = logp[:, h].T.astype(np.float64)
    top = lp.max(1, keepdims=True)
    p = np.exp(lp - top)
    n = np.add.reduceat(c, start)
    allowed = np.ones((len(docs), len(langs)), bool)
    mix, like = _em(c, p, start, np.full(allowed.shape, 1 / len(langs)), rounds)
    cost = -2 * like + penalty * allowed.sum(1) * np.log(n + 1)
    live = np.arange(len(docs))
    sizes = np.diff(np.append(start, len(c)))
    while len(live) and len(langs) > 1:
        live = live[allowed[live].sum(1) > 1]
        if not len(live):
            break
        trial = allowed[live].copy()
        worst = np.where(trial, mix[live], 2.0).argmin(1)
        trial[np.arange(len(live)), worst] = False
        begin = mix[live] * trial + 1e-3 * trial
        begin /= begin.sum(1, keepdims=True)
        rows = np.repeat(start[live], sizes[live]) + _ramp(sizes[live])
        at = np.concatenate([[0], np.cumsum(sizes[live])[:-1]])
        m, like = _em(c[rows], p[rows], at, begin, rounds if len(langs) > 2 and trial.sum(1).max() > 1 else 0)
        now = -2 * like + penalty * trial.sum(1) * np.log(n[live] + 1)
        better = now <= cost[live]
        won = live[better]
        allowed[won], mix[won], cost[won] = trial[better], m[better], now[better]
        live = won
    for k, d in enumerate(docs.tolist()):
        out[d] = {langs[j]: float(mix[k, j]) for j in np.flatnonzero(allowed[k]).tolist()}
    return out


def _ramp(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], batch: int = 200) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, n_langs``: the language with the largest share, and that share.

    Only ``text`` is an input. Null and letterless texts, and all texts where nothing was learned, are ``und``
    with score 0. Ties go to the language that sorts first; repeated rows get equal results.
    """
    small_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGUAGES x BUCKETS numbers
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        langs, logp = shared.value
        for b in batches:
            texts, ids = b["text"].to_pylist(), b["doc_id"].to_pylist()
            got: list[dict[str, float]] = []
            for k in range(0, len(texts), batch):
                got += infer(texts[k : k + batch], langs, logp)
            best = [max(g, key=lambda x: (g[x], [-ord(y) for y in x])) if g else "und" for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    pa.array([None if i is None else zlib.crc32(str(i).encode()) % 4 == 2 for i in ids], pa.bool_()),
                    pa.array(best, pa.string()),
                    pa.array([min(1.0, g[x]) if g else 0.0 for g, x in zip(got, best)], pa.float64()),
                    pa.array([len(g) for g in got], pa.int32()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "n_langs"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_langs int"
    )
