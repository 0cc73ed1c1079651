"""Line-first cleaning."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pageweave.functions.scratch import small_arrow_batches

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
#: A line that is one of these and no more is navigation.
NAVIGATION = re.compile(
    r"(?:home|menu|login|log in|sign in|sign up|register|next|previous|back to top|skip to content|read more|"
    r"click here|share(?: this)?|subscribe|sitemap|search|contact(?: us)?|about(?: us)?)\W*"
)
#: Marks after the items of a menu or a trail, the fewest items that make one, and the most words of an item.
MARKS, ITEMS, ITEM_WORDS = re.compile("[|»>]"), 3, 3
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept cookies|lorem ipsum|javascript"
)
#: A line fails by menu items or boilerplate if they hold this share of its word characters, however long it is.
MATCHED = 0.3
#: Largest share of a document's word characters that failed lines may hold.
MOST_LOST = 0.5
MOST_SYMBOLS = 0.2


def _chars(text: str) -> int:
    return len(text) - sum(text.count(c) for c in SPACES)


def _menu(line: str) -> int:
    """Word characters of the items of a menu or trail (``Home | News | Contact``) with their marks; 0 if too few."""
    parts = MARKS.split(line)
    items = [x for x in parts[:-1] if 0 < len(x.split(None, ITEM_WORDS)) <= ITEM_WORDS]
    if len(items) < ITEMS:
        return 0
    last = parts[-1] if len(parts[-1].split(None, ITEM_WORDS)) <= ITEM_WORDS else ""
    return sum(_chars(x) + 1 for x in items) + _chars(last)


def line_fails(line: str) -> bool:
    """Punctuation, navigation and boilerplate rules of one line; a line without a word never fails.

    Punctuation: more than a fifth of its word characters are symbols, or most words end in such marks or in two
    exclamation marks. Navigation: the line is one such phrase, or the items of a menu hold the share MATCHED of its word
    characters. Boilerplate: its phrases hold that share, so prose may name one. Each rule takes time in proportion to
    the line.
    """
    words = line.encode("utf-8", "surrogatepass").split()
    if not words:
        return False
    chars = _chars(line)
    if sum(line.count(c) for c in SYMBOLS) > MOST_SYMBOLS * chars:
        return True
    if 2 * sum(w.endswith(b"!!") or w[-1:] in b"#*$%&|<>" for w in words) > len(words):
        return True
    low = line.lower()
    if NAVIGATION.fullmatch(low.strip()):
        return True
    matched = max(_menu(low), sum(_chars(m[0]) for m in BOILERPLATE.finditer(low)))
    return matched > 0 and matched >= MATCHED * chars


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more, in arrays of one number a word."""
    code: dict[bytes, int] = {}
    c = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    n = len(code)
    if len(words) < 4 or n == len(words):
        return 0
    pair = np.unique(c[:-1] * n + c[1:], return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * n + c[2:], return_inverse=True, return_counts=True)
    k = np.flatnonzero(count[which] > 1)
    covered = np.zeros(len(words), bool)
    covered[k] = covered[k + 1] = covered[k + 2] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > 50 * len(words)
    parts = text.split("\n")
    good = [x for x in parts if not line_fails(x)]
    if len(good) == len(parts):
        return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, failed, not failed, text
    clean = "\n".join(good)
    left = len(clean) - sum(clean.count(c) for c in SPACES)
    kept = not failed and chars - left <= MOST_LOST * chars
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, failed, kept, clean


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")
_TYPES = (pa.int64(),) * 5 + (pa.bool_(),) * 2 + (pa.string(),)


def clean_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus the measures, the verdict ``kept`` and ``clean_text`` (failed lines removed).

    Null and empty texts have no words, so they fail the base rule. Lines are parted by ``\\n`` only; ties and
    repeated rows are judged alike; columns of ``docs`` that have one of the new names are replaced. One pass, no
    shuffle.
    """
    small_arrow_batches(docs.sparkSession)
    base = docs.drop(*_FIELDS)
    names = base.columns

    def run(batches):
        for b in batches:
            got = list(zip(*[measure(t) for t in b["text"].to_pylist()])) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(x, kind) for x, kind in zip(got, _TYPES))], [*names, *_FIELDS]
            )

    kinds = [T.LongType()] * 5 + [T.BooleanType()] * 2 + [T.StringType()]
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, k) for n, k in zip(_FIELDS, kinds))])
    return base.mapInArrow(run, schema)


def keep_clean(docs: DataFrame) -> DataFrame:
    """Documents that pass, their text without the failed lines; the columns of ``docs``."""
    judged = clean_lines(docs).filter("kept")
    return judged.withColumn("text", judged["clean_text"]).select(*docs.columns)
