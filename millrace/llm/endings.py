"""Terminal-context model: does a text stop where its kind of texts stop?

The model is trained on the corpus itself. Texts that close with a full stop are examples of complete ones;
the same texts cut at random places are examples of cut ones. Features are the closing words, as they are and
with rare words masked, and whether the last word is known or only the beginning of known words. Word counts
cover all texts; the classifier is fitted on a bounded sample of closed texts (SAMPLE).
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most closed texts that the classifier is fitted on.
SAMPLE = 20_000
#: Words in at least this share of the texts keep their form in masked contexts.
FREQUENT = 0.03
#: Words that are the last one, with no mark after them, this often against their other uses, are known to close texts.
LAST = 0.3
DIM = 1 << 18
TOKEN = re.compile(r"[^\W_]+(?:[-'’‑][^\W_]+)*|[.!?…]+|[,;:|/—–]")
#: What may follow the end of a complete text: closing marks, emoji, tags and links.
TAIL = re.compile(r"(?:\s+#\w+|\s*https?://\S+|[^\w.,!?…;:\-�]|\s)+$")
ERROR = re.compile(r"^\s*\[\w+ ERROR\b", re.I)


#: A last character after which only a tag or a link can still be part of the tail.
_FIRM = re.compile(r"[\w.,!?…;:\-�]\Z")


def stem(text: str) -> str:
    """The text without closing quotes, emoji, tags, links and white space."""
    if _FIRM.search(text, max(0, len(text) - 1)):
        last = text.rsplit(None, 1)[-1]
        if last[0] != "#" and "://" not in last:
            return text
    return TAIL.sub("", text)


def closed(text: str) -> bool:
    """Whether the text ends with a full stop, question or exclamation mark (dots of omission don't count)."""
    return closed_stem(stem(text))


def closed_stem(s: str) -> bool:
    return s[-1:] in {"!", "?"} or s[-1:] == "." and s[-2:-1] not in {"", "."}


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


@dataclass
class Vocabulary:
    """Counts of words inside the texts: all that are frequent enough to be known, and the most frequent ones."""

    known: frozenset[str]
    sorted: list[str]
    frequent: frozenset[str]
    #: Words that are often the last one, and no beginning of others.
    last: frozenset[str] = frozenset()

    def begins(self, part: str) -> bool:
        """Whether some known word goes on after this beginning."""
        i = bisect_left(self.sorted, part)
        while i < len(self.sorted) and self.sorted[i].startswith(part):
            if len(self.sorted[i]) > len(part):
                return True
            i += 1
        return False


def vocabulary(texts: DataFrame, column: str) -> tuple[Vocabulary, int]:
    """Word counts over all distinct texts (a last word without a mark after it may be a part and isn't counted), and the number of rows.

    Equal texts count once: copies of a cut one would make its last word one that closes texts. A word is known from max(3, 1/100,000 of the texts) on, which bounds the table by 100,000 times the words of
    a text, whatever the corpus. Each partition sums its own counts before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        final: Counter = Counter()
        n = rows = 0
        for b in batches:
            for t, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and (w := tokens(t)):
                    n += 1
                    rows += copies
                    count.update({x for x in w[:-1] if x[0].isalnum()})
                    if w[-1][0].isalnum():
                        final[w[-1]] += 1
        names = list(count.keys() | final.keys())
        yield pa.RecordBatch.from_arrays([pa.array(["", *names]), pa.array([n, *(count[w] for w in names)], pa.int64()), pa.array([rows, *(final[w] for w in names)], pa.int64())], ["word", "n", "final"])

    distinct = texts.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("copies"))
    counts = distinct.mapInArrow(run, "word string, n bigint, final bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("final").alias("final"))
    rows = counts.where("n >= 3 or final >= 5 or word = ''")
    got = rows.toPandas()
    n, total = (int(got.loc[got["word"] == "", c].sum()) for c in ("n", "final"))  # distinct texts, rows
    got = got[got["word"] != ""]
    ends = got.loc[(got["final"] >= max(5, n / 100_000)) & (got["final"] >= LAST * got["n"]), "word"]
    got = got[got["n"] >= max(3, n / 100_000)]
    known = sorted(got["word"])
    frequent = frozenset(got.loc[got["n"] >= FREQUENT * max(1, n), "word"])
    v = Vocabulary(frozenset(known), known, frequent)
    return Vocabulary(v.known, v.sorted, v.frequent, frozenset(w for w in ends if not v.begins(w))), total


def features(text: str, v: Vocabulary) -> list[int]:
    """Hashed features of where the text stops; `text` is a stem without closing dots."""
    words = tokens(text[-160:])
    words = ["<s>" if w[0] in ".!?…" else w for w in words]
    if len(text) > 160:
        words = words[1:]
    words = ["<s>", *words][-9:]
    last = words[-1]
    known = last in v.known
    part = not known and v.begins(last)
    mask = [w if w in v.frequent or not w[0].isalnum() else "*" for w in words]
    if part:
        mask[-1] = "*part"
    elif not known and last[0].isalnum() and last != "<s>":
        mask[-1] = "*new"
    keys = [f"k{known}{part}", f"l{min(len(last), 5)}{known}{part}"]
    keys += ["w" + " ".join(words[-n:]) for n in range(1, min(5, len(words) + 1))]
    keys += [f"m{n}" + " ".join(mask[-n:]) for n in range(2, len(mask) + 1)]
    return [zlib.crc32(k.encode()) % DIM for k in keys]


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        """Log odds that the text is complete, whatever mark it ends with."""
        s = stem(text).rstrip(".!?…").rstrip()
        f = features(s, self.vocabulary)
        closing = tokens(s[-60:])
        if closing and closing[-1] in self.vocabulary.last:
            return max(0.0, float(self.weights[f].sum()) + self.bias)
        return float(self.weights[f].sum()) + self.bias


def fit(texts: list[str], v: Vocabulary, seed: int = 7, epochs: int = 5) -> Model:
    """Logistic regression on closed texts and on the same texts cut at random places."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for t in texts:
        s = stem(t).rstrip(".!?…").rstrip()
        if len(s) < 12:
            continue
        rows.append(features(s, v))
        labels.append(1.0)
        for at in rng.integers(max(6, len(s) // 5), len(s), 2):
            cut = s[: int(at)].rstrip()
            rest = s[len(cut) :].lstrip()[:1]
            if not cut or cut[-1] in ".!?…" or rest in ".!?…":
                continue
            rows.append(features(cut, v))
            labels.append(0.0)
    w = np.zeros(DIM)
    g = np.full(DIM, 1e-3)
    bias = 0.0
    if not rows:
        return Model(v, w, 0.0)
    y = np.array(labels)
    lens = np.array([len(r) for r in rows])
    flat = np.fromiter((i for r in rows for i in r), np.int64)
    start = np.concatenate([[0], np.cumsum(lens)])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 256):
            pick = order[k : k + 256]
            idx = np.concatenate([flat[start[i] : start[i + 1]] for i in pick])
            own = np.repeat(np.arange(len(pick)), lens[pick])
            z = np.bincount(own, w[idx], len(pick)) + bias
            d = y[pick] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            step = np.bincount(idx, d[own], DIM)
            at = np.flatnonzero(step)
            g[at] += step[at] ** 2
            w[at] += 0.3 * step[at] / np.sqrt(g[at])
            bias += 0.01 * d.mean()
    return Model(v, w.astype(np.float32).astype(np.float64), bias)


def sample_closed(texts: DataFrame, column: str, key: str, n: int, most: int = SAMPLE) -> list[str]:
    """At most about `most` closed texts, drawn by the hash of their key, at every size of the corpus alike."""
    some = texts.where(F.col(column).isNotNull() & F.col(column).rlike(r"[^.][.!?]\W*$"))
    if n > most:
        some = some.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / n)))
    return sorted(r[0] for r in some.select(column).collect() if closed(r[0]))
