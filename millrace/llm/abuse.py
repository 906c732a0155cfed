"""Problem 3: scores for abusive, hateful and sexually explicit language.

Words are brought to their plain form first: look-alike letters, digits for letters, inserted marks and repeated
letters are undone, and rare words within one edit of a lexicon term (two for long ones) are read as that term, marked
as misspelt. The lexicon is a trie walked together with a Levenshtein automaton; it holds the given terms, the words of
those that have several, and the words that reviewers' labels show to be telling. Then a linear model over word n-grams scores every window of WINDOW words; the text's score
is its best window, so that words which quote, reject or soften a term count where they stand near it and
abuse elsewhere in the text is not averaged away.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.canon import bare, dataset_name
from millrace.llm.words import ANY as FUNCTION_WORDS
from millrace.session import spread, table

#: Most labelled texts that the model is fitted on.
LABELLED = 15_000
#: Unlabelled texts per labelled one that the model also sees, their weight, and the log odds from which they are left out.
BACKGROUND, BACKGROUND_WEIGHT, DOUBT = 1, 0.1, 0.8
#: Log odds beyond which a text on the right side teaches nothing more.
MARGIN = 2.5
#: Letters from which a term may differ in two edits (the first letter must agree then); shorter ones, from four on, in one.
LONG = 8
#: n-grams seen less often among the labelled texts carry no weight.
RARE = 3
WINDOW = 10
GRAMS = 4
#: n-grams of each length, and misspelt terms.
COLUMNS = GRAMS + 1
DIM = 1 << 19
#: Words in at least this share of the distinct texts (and KNOWN_LEAST of them) are spelled as they are meant, but see `trusted`.
KNOWN, KNOWN_LEAST = 2e-4, 5

#: Letters of other scripts that look like Latin ones; invisible characters; digits and signs read as letters.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "ӏ": "l", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v"}
INVISIBLE = "­​‌‍⁠﻿᠎"
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
_FOLD = str.maketrans(LOOKALIKES | dict.fromkeys(INVISIBLE, "") | {"’": "'", "‘": "'", "‑": "-"})
_LEET = str.maketrans(LEET)
TOKEN = re.compile(r"https?://\S+|[#@]?\w[\w*@$'-]*(?:[.!|+][\w*@$]+)*|\$\w+")
SPACED = re.compile(r"(?<!\S)(?:[^\W_]\s){3,}[^\W_](?!\w)")
JOINED = re.compile(r"^(?:[^\W_][-_.*'])+[^\W_]$")
REPEAT = re.compile(r"(.)\1{2,}")


def fold(text: str) -> str:
    """Lower case, look-alikes as Latin letters, invisible characters gone."""
    t = text.lower()
    return t if t.isascii() else t.translate(_FOLD)


def chunks(text: str) -> list[str]:
    """The white-space separated parts in lower case; letters that stand apart, four or more in a row, are joined."""
    t = text.lower()
    return (SPACED.sub(lambda m: "".join(m.group().split()), t) if SPACED.search(t) else t).split()


def words(text: str) -> list[str]:
    return [w for c in chunks(text) for w in TOKEN.findall(fold(c))]


def _shortened(word: str, most: int) -> set[str]:
    """The word with up to `most` letters deleted."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


@dataclass
class Lexicon:
    """Terms in a trie, searched with a Levenshtein automaton (an exchange of neighbours counts as one edit)."""

    terms: frozenset[str]
    trie: dict = field(default_factory=dict)
    near: frozenset[str] = frozenset()
    near_long: frozenset[str] = frozenset()

    @classmethod
    def of(cls, terms) -> Lexicon:
        lex = cls(frozenset(terms))
        for t in sorted(lex.terms):
            node = lex.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
        lex.near = frozenset().union(*(_shortened(t, 1) for t in lex.terms))
        lex.near_long = frozenset().union(*(_shortened(t, 2) for t in lex.terms if len(t) >= LONG))
        return lex

    def may_match(self, word: str) -> bool:
        """Whether any term can be near enough: both then share a form with as many letters deleted as edits are allowed."""
        return "*" in word or not self.near.isdisjoint(_shortened(word, 1)) or len(word) >= LONG - 2 and not self.near_long.isdisjoint(_shortened(word, 2))

    def match(self, word: str) -> str | None:
        """The nearest term: within one edit from four letters on, two from LONG on; `*` stands for any letter, and allows no edits.

        A starred word must show two letters and half of the term. States of the automaton are rows of the edit
        table, kept only while some entry is within the bound.
        """
        if word in self.terms:
            return word
        plain = len(word.replace("*", ""))
        if len(word) < 3 or plain < max(2, len(word) / 2) or not self.may_match(word):
            return None
        n = len(word)
        most = 0 if "*" in word else 2 if n >= LONG - 2 else 1 if n >= 3 else 0
        best: tuple[int, str] | None = None
        first = list(range(n + 1))
        stack: list = [(self.trie, first, None, "")]
        while stack:
            node, row, before, letter = stack.pop()
            for c, child in node.items():
                if c == "":
                    d = row[n]
                    allowed = 0 if most == 0 else 2 if len(child) >= LONG and child[0] == word[0] else 1 if len(child) >= 4 and n >= 4 else 0
                    if d <= min(most, allowed) and (best is None or (d, child) < best):
                        best = (d, child)
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    w = word[j - 1]
                    v = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (w != c and w != "*"))
                    if before is not None and j > 1 and w == letter and word[j - 2] == c:
                        v = min(v, before[j - 2] + 1)
                    new.append(v)
                if min(new) <= most:
                    stack.append((child, new, row, c))
        return best[1] if best else None


@dataclass
class Reader:
    """Words in their plain form; remembers what it has seen."""

    known: frozenset[str]
    lexicon: Lexicon
    memo: dict[str, list[int]] = field(default_factory=dict)

    def plain(self, w: str) -> str:
        return self.read(w)[0]

    def read(self, w: str) -> tuple[str, bool]:
        """A word in plain form, and whether it is a misspelt term.

        Known words stay, disguised or misspelt terms become terms; links, handles, numbers and rare words are masked.
        """
        if w in self.known or w in self.lexicon.terms:
            return w, False
        if w[0] in "@#" or w.startswith("http"):
            return "<ref>", False
        if w.isdigit():
            return "<num>", False
        if w.isalpha():
            forms = [w]
        else:
            bare = re.sub(r"(?<=\w)[-_.'](?=\w)", "", w)
            forms = [re.sub(r"[-_.*']", "", w)] if JOINED.match(w) else []
            forms += [w, bare, bare.translate(_LEET)]
            if "1" in bare:
                forms.append(bare.replace("1", "l").translate(_LEET))
        if REPEAT.search(w):
            forms += [REPEAT.sub(r"\1", f) for f in forms] + [REPEAT.sub(r"\1\1", f) for f in forms]
        for f in forms:
            if f in self.lexicon.terms or f in self.known:
                return f, False
        for f in forms:
            if t := self.lexicon.match(f):
                return t, True
        return "<rare>", False

    def ids(self, text: str) -> list[int]:
        """Ids of the plain words: odd numbers, with bit 32 set for misspelt terms."""
        memo, out = self.memo, []
        for c in chunks(text):
            got = memo.get(c)
            if got is None:
                if len(memo) > 300_000:
                    memo.clear()
                got = memo[c] = [zlib.crc32(p.encode()) | 1 | off << 32 for p, off in map(self.read, TOKEN.findall(fold(c)))]
            out += got
        return out


def _slot(h: np.ndarray) -> np.ndarray:
    x = h ^ (h >> np.uint64(31))
    return ((x * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - 19)).astype(np.int64)


def grams(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Slots of the n-grams (1 to GRAMS) of plain words that end at each word, a column per n, and one for a misspelt term; -1 for none."""
    n = len(ids)
    out = np.full((n, COLUMNS), -1, np.int64)
    pos = np.arange(n) - start
    h = np.zeros(n, np.uint64)
    u = ids.astype(np.uint64) & np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for k in range(GRAMS):
            prev = np.roll(u, k)
            h = h * np.uint64(0x9E3779B97F4A7C15) + (prev * np.uint64(0xD6E8FEB86659FD93))
            out[:, k] = np.where(pos >= k, _slot(h), -1)
        out[:, GRAMS] = np.where(ids >> 32 > 0, _slot(u * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(2)), -1)
    return out


@dataclass
class Model:
    known: frozenset[str]
    terms: frozenset[str]
    weights: np.ndarray
    bias: float

    def reader(self) -> Reader:
        return Reader(self.known, Lexicon.of(self.terms))

    def scores(self, texts: list[str | None], reader: Reader) -> np.ndarray:
        """The score of each text's best window; texts without words score the bias alone."""
        rows = [reader.ids(t) if t else [] for t in texts]
        lens = np.array([len(r) for r in rows], np.int64)
        out = np.full(len(texts), self.bias)
        some = np.flatnonzero(lens)
        if not len(some):
            return out
        ids = np.fromiter((i for r in rows for i in r), np.int64)
        first = np.concatenate([[0], np.cumsum(lens[some])])[:-1]
        out[some] = np.maximum.reduceat(window_sums(ids, first, lens[some], self.weights), first) + self.bias
        return out


def window_sums(ids: np.ndarray, first: np.ndarray, lens: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each word, the summed weights of the n-grams that end in the WINDOW words up to it."""
    start = np.repeat(first, lens)
    g = grams(ids, start)
    s = np.where(g >= 0, weights[g], 0.0).sum(axis=1, dtype=np.float64)
    c = np.concatenate([[0.0], np.cumsum(s)])
    i = np.arange(len(ids))
    return c[i + 1] - c[np.maximum(start, i + 1 - WINDOW)]


def fit(labelled: list[tuple[str, int]], terms: dict[str, float], known: frozenset[str], background: list[str] = (), seed: int = 3, epochs: int = 8) -> Model:
    """Logistic regression on the best windows; terms start from their given weights, so few labels still score.

    `labelled`: (text, 0 or 1). `terms`: lexicon terms with weights between 0 and 1. `background`: unlabelled
    texts, most of them harmless; from half of the epochs on they weigh a little as harmless ones, except those
    that the model by then finds abusive. They keep rare harmless words from looking telling.
    """
    rng = np.random.default_rng(seed)
    # words that reviewers' labels show to be telling join the lexicon
    plain = Reader(known, Lexicon.of(single(terms)))
    count = {0: Counter(), 1: Counter()}
    n = Counter(y for _, y in labelled)
    for t, y in labelled:
        count[y].update({p for w in words(t) if not (p := plain.plain(w)).startswith("<")})
    telling = {
        w for w, k in count[1].items()
        if k >= 3 and len(w) >= 3 and k / max(1, n[1]) >= 5 * (count[0][w] + 0.5) / max(1, n[0])
    }
    lexicon = single(terms) | telling
    reader = Reader(known, Lexicon.of(lexicon))
    w = np.zeros(DIM + 1)  # the last slot stands for absent n-grams
    for t, x in terms.items():  # a term of several words starts as their n-gram
        ids = np.array(reader.ids(t)[-GRAMS:], np.int64)
        w[grams(ids, np.zeros(len(ids), np.int64))[-1, len(ids) - 1]] = 3.0 * x
    bias = -2.5
    rows = [(r, y) for t, y in labelled if (r := reader.ids(t))]
    n_labelled = len(rows)
    if rows and len({y for _, y in rows}) == 2:
        rows += [(r, 0) for t in background if (r := reader.ids(t))]
        lens = np.array([len(r) for r, _ in rows])
        first = np.concatenate([[0], np.cumsum(lens)])[:-1]
        ids = np.fromiter((i for r, _ in rows for i in r), np.int64)
        y = np.array([v for _, v in rows], float)
        g = grams(ids, np.repeat(first, lens))
        g[g < 0] = DIM
        seen = np.bincount(g[: lens[:n_labelled].sum()].ravel(), minlength=DIM + 1)
        g[seen[g] < RARE] = DIM  # what a few texts alone have teaches nothing
        acc = np.full(DIM + 1, 1.0)
        weight = np.where(np.arange(len(y)) < n_labelled, 1.0, BACKGROUND_WEIGHT)
        used = np.arange(n_labelled)
        for epoch in range(epochs):
            if epoch == epochs // 2 and len(rows) > n_labelled:
                rest = np.arange(n_labelled, len(rows))
                z = np.maximum.reduceat(window_sums_of(g, first, lens, w), first)[rest] + bias
                used = np.concatenate([used, rest[z < DOUBT]])
            for pick in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
                sl = np.concatenate([np.arange(first[i], first[i] + lens[i]) for i in pick])
                f = np.concatenate([[0], np.cumsum(lens[pick])])[:-1]
                sums = window_sums_of(g[sl], f, lens[pick], w)
                own = np.repeat(np.arange(len(pick)), lens[pick])
                at = np.arange(len(sl)) - f[own]
                best = np.array([int(np.argmax(sums[a : a + k])) for a, k in zip(f, lens[pick], strict=True)])
                z = sums[f + best] + bias
                d = (y[pick] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * weight[pick]
                d[np.where(y[pick] == 1, z > MARGIN, z < -MARGIN)] = 0.0  # clear cases would only push harmless words down
                inside = (at <= best[own]) & (at > best[own] - WINDOW) if epoch else np.ones(len(sl), bool)
                idx = g[sl][inside].ravel()
                step = np.bincount(idx, np.repeat(d[own][inside], COLUMNS), DIM + 1)
                hit = np.flatnonzero(step)
                hit = hit[hit < DIM]
                acc[hit] += step[hit] ** 2
                w[hit] += 0.3 * step[hit] / np.sqrt(acc[hit]) - 1e-4 * w[hit]
    return Model(known, lexicon, w[:DIM].astype(np.float32), float(bias))


def window_sums_of(g: np.ndarray, first: np.ndarray, lens: np.ndarray, weights: np.ndarray) -> np.ndarray:
    s = weights[g].sum(axis=1)
    c = np.concatenate([[0.0], np.cumsum(s)])
    i = np.arange(len(g))
    return c[i + 1] - c[np.maximum(np.repeat(first, lens), i + 1 - WINDOW)]


def known_words(texts: DataFrame, column: str) -> frozenset[str]:
    """Words of letters in at least KNOWN of all distinct texts (KNOWN_LEAST at least): at most 1 / KNOWN times the words of a text.

    Texts that differ in formatting only (`canon.bare`) count as one, and a word counts once in each, however often
    it stands there and in whichever of the copies. Equal texts collapse before they are read; what is shuffled then
    is each text's words, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        for b in batches:
            own, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = {""}  # stands for the text itself
                for c in t.lower().split():
                    got = memo.get(c)
                    if got is None:
                        if len(memo) > 300_000:
                            memo.clear()
                        got = memo[c] = [w for w in TOKEN.findall(fold(c)) if w.replace("-", "").isalpha()]
                    found.update(got)
                out += found
                own += [i] * len(found)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array(out, pa.string())], ["canon", "word"])

    distinct = texts.where(F.length(column) > 0).select(F.col(column).alias("value")).distinct()
    pairs = distinct.select(F.xxhash64(bare(F.col("value"))).alias("canon"), "value").mapInArrow(run, "canon bigint, word string").distinct()
    counts = pairs.groupBy("word").agg(F.count("*").alias("n")).where(f"n >= {KNOWN_LEAST} or word = ''")
    got = counts.toPandas()
    n = int(got.loc[got["word"] == "", "n"].sum())
    return frozenset(got.loc[(got["word"] != "") & (got["n"] >= max(KNOWN_LEAST, KNOWN * n)), "word"])


def single(terms: Iterable[str]) -> frozenset[str]:
    """The terms of one word, and the words of the others that are no function words: what spellings are compared with."""
    return frozenset(w for t in terms for w in t.split() if " " not in t or w not in FUNCTION_WORDS and len(w) > 3)


def trusted(known: frozenset[str], labelled: list[tuple[str, int]], terms: Iterable[str]) -> frozenset[str]:
    """The known words without those that a lexicon term is within one edit of, unless labels show them harmless.

    How often a misspelling stands in the corpus says nothing about what it means. Labels show a word harmless if it
    stands in a larger share of the harmless texts than of the abusive ones; fixed function words are harmless anyway.
    """
    lexicon = Lexicon.of(single(terms))
    near = {w for w in known if w not in lexicon.terms and w not in FUNCTION_WORDS and lexicon.match(w)}
    if not near:
        return known
    texts = {(frozenset(words(t)), y) for t, y in labelled}  # copies count once
    n = Counter(y for _, y in texts)
    count = {y: Counter(w for t, k in texts if k == y for w in t & near) for y in (0, 1)}
    return known - {w for w in near if count[0][w] * max(1, n[1]) <= count[1][w] * max(1, n[0])}


def terms_of(rows: DataFrame) -> dict[str, float]:
    """Lexicon terms with their weights (null: 0.5); blanks within a term are single ones."""
    out: dict[str, float] = {}
    for r in rows.select("term", "weight").collect():  # a fixed, small table
        if t := " ".join(fold(r["term"] or "").split()):
            out[t] = max(out.get(t, 0.0), 0.5 if r["weight"] is None else float(r["weight"]))
    return out


def train(spark: SparkSession, texts: DataFrame, labels: DataFrame, terms: DataFrame) -> Model:
    """The model of a corpus: `texts` (src_table, row_id, value), reviewers' `labels` and the lexicon."""
    small = labels.where("abusive is not null").select("src_table", "row_id", "abusive")
    n = small.count()
    if n > LABELLED:
        small = small.where(F.pmod(F.xxhash64("src_table", "row_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * LABELLED / n)))
    pairs = texts.where("value is not null").join(F.broadcast(small), ["src_table", "row_id"]).select("row_id", "value", "abusive").orderBy("row_id", "value").collect()
    every = texts.count()
    share = min(1.0, BACKGROUND * len(pairs) / max(1, every))
    drawn = texts.where(F.col("value").isNotNull() & (F.pmod(F.xxhash64("row_id", "src_table", F.lit("background")), F.lit(1_000_000)) < F.lit(int(1_000_000 * share))))
    background = sorted(r[0] for r in drawn.select("value").collect())
    labelled, lexicon = [(r["value"], int(r["abusive"] == 1)) for r in pairs], terms_of(terms)
    return fit(labelled, lexicon, trusted(known_words(texts, "value"), labelled, lexicon), background)


def texts_of(spark: SparkSession, captions: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(src_table, row_id, dataset, value) of captions and rewrites; datasets under their right names."""
    a = captions.select(F.lit("unified_train").alias("src_table"), "row_id", dataset_name(F.col("dataset")).alias("dataset"), F.col("text").alias("value"))
    b = rewrites.select(F.lit("train_pseudo_rewrites_merged").alias("src_table"), "row_id", dataset_name(F.col("dataset")).alias("dataset"), F.col("pseudo_rewrite").alias("value"))
    return a.unionByName(b)


def scored(texts: DataFrame, labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(src_table, row_id, dataset, score, flag) for every row; score is a probability, flag is score > 0.5.

    Null and empty texts score as texts without words and are never flagged. Whole texts are read. Repeated rows
    come out each. Without labels the lexicon's weights alone decide; without any text the result is empty.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(train(spark, texts, labels, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = model.reader()
        for b in batches:
            z = np.clip(model.scores(b.column(3).to_pylist(), reader), -30, 30)
            p = np.round(1 / (1 + np.exp(-z)), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(p), pa.array(p > 0.5)], ["src_table", "row_id", "dataset", "score", "flag"])

    rows = spread(texts.select("src_table", "row_id", "dataset", "value"))
    return rows.mapInArrow(run, "src_table string, row_id bigint, dataset string, score double, flag boolean")


def found(texts: DataFrame, labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(src_table, row_id) of the flagged rows."""
    return scored(texts, labels, terms).where("flag").select("src_table", "row_id")


def rates(texts: DataFrame, labels: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows, flagged rows, their rate and the mean score per table and dataset."""
    return (
        scored(texts, labels, terms)
        .groupBy("src_table", "dataset")
        .agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"), F.round(F.avg(F.col("flag").cast("int")), 6).alias("rate"), F.round(F.avg("score"), 4).alias("mean_score"))
    )


def inputs(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts, labels and lexicon of a data directory."""
    texts = texts_of(spark, table(spark, directory, "unified_train"), table(spark, directory, "train_pseudo_rewrites_merged"))
    return texts, table(spark, directory, "review_labels"), table(spark, directory, "abuse_terms")
