"""Main text of web pages by the distribution of text over blocks of lines."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a sliding window; a stripped part leaves as many empty ones.
WINDOW = 3
#: A stretch of lines counts beside the fullest one if its fullest window holds this share of that one's text.
SHARE = 0.2

# Names of HTML's elements by what they are.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead "
    "tr ul".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks whose end closes all that is still open in them.
CONTAINERS = BLOCKS - frozenset("caption dd dt h1 h2 h3 h4 h5 h6 hr legend li option p summary tr tbody tfoot thead".split())

#: Blocks that hold a part of a page of their own.
SECTIONS = frozenset("html body div section article main td th center".split())

# Elements that never are main text; ``header`` only outside an article.
STRIPPED = frozenset("nav aside footer form head noscript template svg canvas select datalist button dialog menu object audio video map search".split())
ROLES = frozenset("navigation complementary contentinfo search form menu menubar toolbar dialog alertdialog alert".split())
#: First or last words of class names and ids that say the same.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments commentlist "
    "respond replies disqus pagination pager toolbar masthead topbar copyright disclaimer".split()
)
NEGATED = frozenset("no not has with without is".split())
OUTSIDE = frozenset("header heading top".split())
READERS = frozenset("comment comments commentlist respond replies disqus aside sidebar sidebars related recommended recommendations".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORDS = re.compile(r"[a-z0-9]+")
_LEGAL = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def _said(attributes: dict[str, str], words: frozenset[str]) -> bool:
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if parts and parts[0] not in NEGATED and (parts[0] in words or parts[-1] in words):
            return True
    return False


class _Lines:
    """Markup off: a page as lines of text, each with its text outside links and whether it stands in an article."""

    def __init__(self, keep_forms: bool = False) -> None:
        self.keep_forms = keep_forms
        self.text: list[str] = []
        self.free: list[int] = []  # characters outside links
        self.inside: list[bool] = []
        self.section: list[int] = []  # the innermost section
        self.sections = 0
        self.parts: list[str] = []
        self.linked = self.in_link = 0
        self.open: list[tuple[str, str, bool, int]] = []  # name, why all in it is stripped, whether it begins an article, section
        self.stripped = ""  # why, now
        self.counted: dict[str, int] = {}
        self.articles = 0

    def line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.text.append(text)
            self.free.append(0 if 2 * self.linked > len(text) else len(text))
            self.inside.append(self.articles > 0)
            self.section.append(self.open[-1][3] if self.open else 0)
        self.parts, self.linked = [], 0

    def gap(self) -> None:
        self.line()
        self.text += [""] * WINDOW
        self.free += [0] * WINDOW
        self.inside += [self.articles > 0] * WINDOW
        self.section += [-1] * WINDOW

    def words(self, text: str) -> None:
        if text and not self.stripped:
            text = html.unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.in_link:
                self.linked += len(text.strip())

    def _why(self, name: str, a: dict[str, str]) -> str:
        if name in STRIPPED and not (name == "form" and self.keep_forms):
            return "readers" if name in ("aside", "footer") else "tag"
        if not a or name in ("html", "body", "main"):
            return ""
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return "hidden"
        if a.get("role", "").lower() in ROLES:
            return "tag"
        if _said(a, MARKS):
            return "readers" if _said(a, READERS) else "tag"
        return "tag" if not self.articles and (a.get("role", "").lower() == "banner" or _said(a, OUTSIDE)) else ""

    def begin(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name in BLOCKS:
            self.line()
            if self.open and self.open[-1][0] == "p" and name not in VOID:
                self._pop()
        if name in VOID:
            return
        if name == "a":
            self.in_link = 1
        a = _attributes(attributes) if attributes else {}
        main = name in ("article", "main") or a.get("role") == "main" or a.get("itemprop") == "articleBody"
        why = self._why(name, a)
        if not why and name == "header" and not self.articles and not main:
            why = "tag"
        around = self.stripped
        if main and not why and around != "readers":  # what is open around it was never closed
            around = ""
        if name in CONTAINERS or why or self.counted.get(name):
            if why and not self.stripped:
                self.gap()
            self.stripped = around or why
            own = main and not self.stripped
            self.sections += name in SECTIONS
            section = self.sections if name in SECTIONS else self.open[-1][3] if self.open else 0
            self.open.append((name, self.stripped, own, section))
            self.counted[name] = self.counted.get(name, 0) + 1
            self.articles += own

    def _pop(self) -> None:
        name, _, own, _ = self.open.pop()
        self.counted[name] -= 1
        self.line()
        self.articles -= own
        self.stripped = self.open[-1][1] if self.open else ""

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.line()
        if name == "a":
            self.in_link = 0
        if self.counted.get(name):
            if name in CONTAINERS:
                self.in_link = 0
            while self.open[-1][0] != name:
                self._pop()
            self._pop()


def lines(page: str, keep_forms: bool = False) -> _Lines:
    """Markup, scripts, styles, comments and what is marked as no main text off; see ``_Lines``."""
    out, at, tag, closing = _Lines(keep_forms), 0, _TAG, True
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= len(page):
            out.words(page[at:])
            break
        out.words(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4) if closing else -1
            closing = end >= 0
            end = end + 3 if closing else page.find(">", lt) + 1
            if not end:
                break
            at = end
        elif page[lt + 1] in "!?" or page.startswith("</", lt) and not page[lt + 2 : lt + 3].isalpha():
            at = page.find(">", lt) + 1
            if not at:
                break
        elif (page[lt + 1].isascii() and page[lt + 1].isalpha()) or page[lt + 1] == "/":
            m = tag.match(page, lt)
            if not m and tag is _TAG:  # a quote that never ends
                tag = _LOOSE
                m = tag.match(page, lt)
            if not m:
                if page.find(">", lt) < 0:
                    break  # a tag that never ends
                out.words("<")
                at = lt + 1
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:
                out.end(name)
            elif name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(page, at)
                if name == "title" or name == "iframe":
                    out.line()
                at = close.end() if close else len(page)
            else:
                out.begin(name, m[3])
        else:
            out.words("<")
            at = lt + 1
    out.line()
    return out


def between(free: np.ndarray) -> list[tuple[int, int, int]]:
    """Surge and dive: ``first, last + 1, most`` of each stretch over which no window of lines is empty, with its fullest window."""
    n = len(free)
    run = np.concatenate([[0], np.cumsum(free)])
    at = np.arange(1 - WINDOW, n)
    window = run[np.minimum(at + WINDOW, n)] - run[np.maximum(at, 0)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], window > 0, [0]])))
    out = []
    for surge, dive in edge.reshape(-1, 2):
        has = np.flatnonzero(free[max(at[surge], 0) : min(at[dive - 1] + WINDOW, n)]) + max(at[surge], 0)
        out.append((int(has[0]), int(has[-1]) + 1, int(window[surge:dive].max())))
    return out


def main_text(page: str) -> str:
    """The page's main text: its lines between surges and dives, joined by a space.

    Where an article holds the fullest window, its lines alone count, whatever their length. Otherwise lines that are half
    links count as empty, and stretches stay that reach a share of the fullest one or stand in the same section as it.
    """
    for keep_forms in (False, True):
        got = lines(page, keep_forms)
        length = np.array([len(t) for t in got.text], np.int64)
        inside = np.array(got.inside, bool)
        if length.any():
            own = between(np.where(inside, length, 0))
            rest = between(np.where(inside, 0, np.array(got.free)))
            most = max((m for *_, m in rest), default=0)
            if own and max(m for *_, m in own) >= SHARE * most:
                return " ".join(t for i, j, _ in own for t, x in zip(got.text[i:j], got.inside[i:j], strict=True) if t and x)
            if rest:
                first, last = next((i, j) for i, j, m in rest if m == most)
                room = np.bincount(np.array(got.section[first:last]) + 1, np.array(got.free[first:last]))
                home = int(room.argmax()) - 1  # most of the fullest stretch stands there
                kept = [(i, j) for i, j, m in rest if m >= SHARE * most or home in got.section[i:j]]
                text = [t for i, j in kept for t in got.text[i:j] if t]
                while text and _LEGAL.match(text[-1]):
                    text.pop()
                return " ".join(text)
    return ""


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` without ``page``, with ``text`` (empty if none) and ``n_chars``, its code points.

    Pages are read whole, each by itself, in batches bounded by Arrow; a null page has no text; repeated rows, clashing columns
    (``text`` and ``n_chars`` are replaced) and any ids are fine; an empty table gives an empty one.
    """
    rest = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    schema = pages.select(*rest, F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py() or "") for x in b.column(len(rest))]
            cells = [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=[*rest, "text", "n_chars"])

    return pages.select(*rest, page).mapInArrow(run, schema)
