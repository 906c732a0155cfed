"""Problem 9: documents stuffed with keywords, links or product tags.

A document's tokens are words, numbers, links and tags. A token lies in a list when it is a link or tag, or when few
function words stand around it. A document mostly made of such tokens is spam if its list goes beyond what is usual in
one of these: link text, tags, the share of its three top words, repeated word pairs, repeated lines, or separators where
function words are missing altogether. A text in whole sentences is spam if one keyword takes far more of them than is
usual. What is usual is measured per language over all documents first: of each measure the upper
decile, from which its limit follows (LIMITS). A language with few documents leans on all languages together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import ANY, guess_language
from millrace.session import spread

TOKEN = re.compile(r"(?:https?://|www\.)\S+|[#@]\w+|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*")
LINK = re.compile(r"(?:https?://|www\.)\S+|[#@]\w+", re.I)
SEPARATOR = re.compile(r"[,;|/*»•\n]|\s[-–]\s")
LINE = re.compile(r"[\n.!?]+")
#: Words on either side over which function words are counted; a token is listed where their share is below LISTED times the usual one.
AROUND, LISTED = 6, 0.5
#: For each measure its limit: so many times the upper decile of all documents, but at least the floor (many are 0 in nearly all texts).
LIMITS = {"top": (2.5, 0.1), "top3": (1.0, 0.15), "pairs": (1.0, 0.15), "lines": (1.5, 0.3), "separators": (3.0, 0.35), "links": (2.0, 0.12), "tags": (2.0, 0.3)}
#: Documents that the measures over all languages weigh in those of one language.
POOLED = 50
#: Fewer links, or tags, are a few; measures of words are taken from this many words on.
FEW_LINKS, FEW_TAGS, FEW_WORDS = 4, 5, 20
#: Words from which a text's own measures count for what is usual.
USUAL_WORDS = 30


class _Kinds(dict):
    """Kinds of tokens seen: 1 link, 2 tag, 3 word, 4 number."""

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        k = {"#": 2, "@": 3}.get(w[0]) or (4 if w[0].isdigit() else 1 if w.startswith(("http://", "https://", "www.")) else 3)
        self[w] = k
        return k


_KINDS = _Kinds()


def parts(text: str) -> tuple[list[str], list[int]]:
    """Lower-case tokens and their kinds (1 link, 2 tag, 3 word, 4 number)."""
    words = TOKEN.findall(text.lower())
    return words, list(map(_KINDS.__getitem__, words))


def repeated(items: list) -> float:
    """The share of the items that have come before."""
    return 1 - len(set(items)) / len(items) if items else 0.0


def lines_of(text: str) -> list[str]:
    """Lines and sentences, without case and blanks around."""
    return [s for s in map(str.strip, LINE.split(text.lower())) if s]


def usual(text: str) -> tuple | None:
    """(language, share of function words, then the measures of LIMITS over the whole text) of a text of USUAL_WORDS words or more."""
    words, kinds = parts(text)
    plain = [w for w, k in zip(words, kinds, strict=True) if k == 3] if min(kinds, default=3) < 3 or max(kinds, default=3) > 3 else words
    if len(plain) < USUAL_WORDS:
        return None
    lang = guess_language(plain)
    if lang is None:
        return None
    content = Counter(plain)
    n, m = len(plain), len(words)
    function = sum(content.pop(w) for w in content.keys() & ANY)
    most = sorted(content.values(), reverse=True)[:3] or [0]
    return (
        lang, function / n, most[0] / n, sum(v for v in most if v > 2) / n, repeated(list(zip(plain, plain[1:], strict=False))),
        repeated(lines_of(text)), len(SEPARATOR.findall(text)) / m, kinds.count(1) / m, kinds.count(2) / m,
    )


#: What a decision needs to know of a language: the usual share of function words, and the limits.
Norms = dict[str, dict[str, float]]


def signals(text: str, norms: Norms, full: bool = True) -> dict[str, float]:
    """The measures that the decision uses, and the decision; `norms` as from `calibrate`.

    Without `full`, texts that can't be spam whatever the measures still to be taken come back with that alone.
    """
    words, kind_list = parts(text)
    n = len(words)
    none = dict.fromkeys(("spam", "listed", "function", *LIMITS), 0.0)
    if not n:
        return none
    links, tags = kind_list.count(1), kind_list.count(2)
    plain = [w for w, k in zip(words, kind_list, strict=True) if k == 3] if min(kind_list) < 3 or max(kind_list) > 3 else words
    lang = guess_language(plain)
    norm = norms.get(lang or "", norms[""])
    content = Counter(plain)
    for w in content.keys() & ANY:
        del content[w]
    top = max(content.values(), default=0) / len(plain) if plain else 0.0
    stuffed = len(plain) >= USUAL_WORDS and top >= norm["top"]
    # no evidence without some links, some tags, or a word (or number) that comes three times among enough of them
    if not full and not stuffed and links < FEW_LINKS and tags < FEW_TAGS and (n < FEW_WORDS or 4 not in kind_list and max(content.values(), default=0) < 3):
        return none
    kinds, sizes = np.array(kind_list, np.int8), np.fromiter(map(len, words), np.int64, n)
    # function words in the window around each token, over the tokens there
    isfw = np.fromiter(map(ANY.__contains__, words), np.int64, n)
    c = np.concatenate([[0], np.cumsum(isfw)])
    i = np.arange(n)
    a, b = np.maximum(i - AROUND, 0), np.minimum(i + AROUND + 1, n)
    local = (c[b] - c[a]) / (b - a)
    listed = (kinds == 1) | (kinds == 2) | (local < LISTED * norm["function"])
    share = sizes[listed].sum() / max(1, sizes.sum())
    if not full and not stuffed and share < 0.5:
        return none
    inside = [w for w, x in zip(words, listed & (kinds >= 3), strict=True) if x]
    count = Counter(inside)
    m, units = max(1, len(inside)), max(1, int(listed.sum()))
    own_function = sum(count.pop(w) for w in count.keys() & ANY) / m
    enough = len(inside) >= FEW_WORDS and max(count.values(), default=0) > 2
    got = {
        "top": top,
        "top3": sum(v for _, v in count.most_common(3) if v > 2) / m,
        "pairs": repeated(list(zip(inside, inside[1:], strict=False))),
        "lines": repeated(lines_of(text)),
        "separators": len(SEPARATOR.findall(text)) / n,
        "links": links / units,
        "tags": tags / units,
    }
    beyond = {k: v >= norm[k] for k, v in got.items()}
    evidence = (
        beyond["links"] and links >= FEW_LINKS
        or beyond["tags"] and tags >= FEW_TAGS
        or enough and (beyond["top3"] or beyond["pairs"] or beyond["lines"] or beyond["separators"] and own_function < norm["missing"])
    )
    return none | got | {"spam": float(stuffed or (share >= 0.5 and evidence)), "listed": float(share), "function": own_function}


def calibrate(docs: DataFrame, text: str = "text") -> Norms:
    """What is usual, per guessed language, over all documents of USUAL_WORDS words or more; under '' over all languages.

    One aggregate of a row per language comes to the driver.
    """
    names = ["function", *LIMITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [u for t in b.column(0).to_pylist() if t and (u := usual(t))]
            cols = list(zip(*got, strict=True)) or [[] for _ in range(1 + len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.float64()) for c in cols[1:]]], ["lang", *names])

    measured = spread(docs.select(F.col(text).cast("string"))).mapInArrow(run, "lang string, " + ", ".join(f"{x} double" for x in names))
    quantiles = [F.percentile_approx(x, 0.5 if x == "function" else 0.9, 1000).alias(x) for x in names]
    rows = {r["lang"]: r.asDict() for r in measured.rollup("lang").agg(F.count("*").alias("n"), *quantiles).collect()}
    every = rows.pop(None, None) or {}
    pooled = {x: (every.get(x) if every.get(x) is not None else 0.4 if x == "function" else 0.0) for x in names}
    out = {"": limits_of(pooled, pooled["function"])}
    for lang, r in rows.items():
        w = r["n"] / (r["n"] + POOLED)
        own = {x: w * r[x] + (1 - w) * pooled[x] for x in names}
        out[lang] = limits_of(own, own["function"])
    return out


def limits_of(deciles: dict[str, float], function: float) -> dict[str, float]:
    """Limits from upper deciles, with the usual share of function words and the one from which they are `missing`."""
    return {x: max(floor, times * deciles[x]) for x, (times, floor) in LIMITS.items()} | {"function": function, "missing": function / 6}


NAMES = ["listed", "function", *LIMITS]


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", full: bool = True) -> DataFrame:
    """(key, spam, and the measures) for every document; without `full`, (key, spam) alone, which is cheaper.

    Null, empty and blank texts score 0 and are no spam; fewer than FEW_WORDS words are spam only as links or tags. Long
    texts are read to their end. Repeated rows come out each. Two passes over the texts, with one shuffle of per-language
    quantiles between them.
    """
    norms = calibrate(docs, text)
    names = NAMES if full else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [signals(t or "", norms, full) for t in b.column(1).to_pylist()]
            cols = [pa.array([bool(g["spam"]) for g in got], pa.bool_())] + [pa.array([g[x] for g in got], pa.float64()) for x in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [key, "spam", *names])

    rows = spread(docs.select(F.col(key), F.col(text).cast("string")))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, spam boolean" + "".join(f", {x} double" for x in names))


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of the documents that are spam."""
    return scored(docs, key, text, full=False).where("spam").select(key)
