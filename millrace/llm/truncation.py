"""Problem 5: texts that lost their end in a field limit or in transfer.

Near-copies are found by min-hash banding of beginnings: a value without a closing mark is sketched as it is, every other
value at its beginnings of all lengths of a grid (LENGTHS), so that a copy that lost most of its text still shares its
whole sketch with the text it was. Verified pairs are aligned: where the longer text goes on in the middle of a sentence,
the shorter one was cut; where a sentence ends there, it merely lacks its full stop. Values without such a partner
are scored by their closing words (`endings`), with the odds of a field limit where many values of a source stop at
one length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import NULL_LIKE
from millrace.llm import bitfilter, endings
from millrace.llm.canon import dataset_name
from millrace.session import dropped, few_or_not, spread, stored, table

SHINGLE = 5
SIMILAR = 0.8
#: Bands and rows of the min-hash: pairs of similarity 0.8 miss each other in all bands with a probability of 0.009.
BANDS, ROWS = 12, 5
#: Lengths of beginnings, in words, that are sketched: each up to twelve, then in steps of a tenth.
DENSE, STEP = 12, 1.1
#: Words that a beginning and its near-copy may differ in length.
SHIFT = 2
#: Log odds below which a value counts as cut, on the model alone.
CUT = -4.5
#: A length is a field limit where unclosed values are LIMIT_TIMES those of the lengths around, beyond chance: the
#: likelihood ratio of that against no more than around is LIMIT_RATIO (log) at least.
LIMIT_TIMES, LIMIT_AROUND, LIMIT_RATIO = 4.0, 8, 6.0


def is_value(text: str | None) -> bool:
    """Whether there is a text to judge: error markers, null-like values and values without two words are none."""
    if not text or endings.ERROR.match(text):
        return False
    t = text.strip().lower()
    return t.strip(" .-\"'") not in NULL_LIKE and len(list(islice(endings.TOKEN.finditer(t), 2))) == 2


def grid(most: int) -> list[int]:
    """The lengths of beginnings up to `most`."""
    out = [g for g in range(SHINGLE, DENSE + 1) if g <= most]
    g = DENSE
    while (g := max(g + 1, int(g * STEP))) <= most:
        out.append(g)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Codes(dict):
    """Numbers of the tokens of a batch, each token looked at once: the hash and first letter of a word (0 for marks), and what it is to the word before it."""

    def __init__(self):
        self.hashes: list[int] = []
        self.letters: list[int] = []
        self.marks: list[int] = []

    def __missing__(self, token: str) -> int:
        word = token[0].isalnum()
        w = token.lower()
        self.hashes.append(zlib.crc32(w.encode()) * 2_654_435_761 + zlib.adler32(w[::-1].encode()) if word else 0)
        self.letters.append(ord(w[0]) if word else 0)
        self.marks.append(ord(_mark(token)))
        code = self[token] = len(self)
        return code


class Words:
    """The words of a batch of texts as one array of hashes: `n` of each text from `first` on, with each one's first letter and what follows it."""

    def __init__(self, texts: list[str]):
        codes = _Codes()
        found = [[codes[t] for t in endings.TOKEN.findall(text)] for text in texts]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(lens.sum()))
        letters, marks = np.array(codes.letters, np.uint64)[flat], np.append(np.array(codes.marks, np.uint64)[flat], [np.uint64(ord("$"))])
        marks[np.cumsum(lens)[lens > 0]] = ord("$")  # what follows a text's last token is another text
        at = np.flatnonzero(letters)
        self.ids = np.array(codes.hashes, np.uint64)[flat[at]]
        self.letters = letters[at]
        self.marks = marks[at + 1]
        self.n = np.bincount(np.repeat(np.arange(len(lens)), lens)[at], minlength=len(lens)).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n

    def shingles(self) -> np.ndarray:
        """A hash of the five words from each word on (those that reach into the next text are not to be used)."""
        s = np.zeros(len(self.ids), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(SHINGLE):
                s = (s ^ np.roll(self.ids, -k)) * _A
                s ^= s >> np.uint64(29)
        return s

    def ends(self) -> np.ndarray:
        """A hash of the two words before each word and of its first letter; what comes before the third word is not to be used."""
        with np.errstate(over="ignore"):
            return _mix((np.roll(self.ids, 2) * _A + np.roll(self.ids, 1)) * _B + self.letters)

    def beginnings(self) -> np.ndarray:
        """A hash of each text up to each word, with what follows that one: all that `stops` looks at."""
        own = np.repeat(np.arange(len(self.n)), self.n)
        with np.errstate(over="ignore"):
            each = _mix(self.ids * _A + (np.arange(len(self.ids)) - self.first[own]).astype(np.uint64) * _B)
            upto = np.cumsum(each)
            return _mix(upto - (upto - each)[self.first[own]] + self.marks * _A)


def only_words(text: str) -> list[str]:
    return [w for w in endings.tokens(text) if w[0].isalnum()]


def _band_keys(shingles: np.ndarray, first: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For each beginning of `g` words from `first` on its BANDS keys.

    A text's five-word runs are hashed once, however many of its beginnings are asked for: minima of the runs that each
    length adds to the one below, and from these the minima from the text's first word on.
    """
    lengths, step = np.unique(g, return_inverse=True)
    begins, own = np.unique(first, return_inverse=True)
    most = np.zeros(len(begins), np.int64)
    np.maximum.at(most, own, step)
    order = np.argsort(-most, kind="stable")  # the texts of each length are the first ones of those of the length below
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    texts = np.searchsorted(-most[order], -np.arange(len(lengths)), side="right")
    block = np.cumsum(texts) - texts
    runs = np.diff(lengths - SHINGLE + 1, prepend=0)
    done = lengths - SHINGLE + 1 - runs
    s = shingles[np.concatenate([(begins[order[:t], None] + np.arange(d, d + r)).ravel() for t, d, r in zip(texts, done, runs, strict=True)])]
    start = np.repeat(runs, texts)
    start = np.cumsum(start) - start
    asked, back = np.unique(block[step] + rank[own], return_inverse=True)
    size = np.repeat(lengths, texts)[asked].astype(np.uint64) * _A
    out = np.zeros((len(asked), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            h = size + np.uint64(b + 1)
            for r in range(ROWS):
                i = np.uint64((b * ROWS + r + 1) * int(_B) & (2**64 - 1))
                least = np.minimum.reduceat(_mix((s ^ i) * _A), start)
                for t, below, at in zip(texts[1:], block, block[1:]):
                    np.minimum(least[at : at + t], least[below : below + t], out=least[at : at + t])
                h = _mix((h ^ least[asked]) * _A)
            out[:, b] = h
    return out[back]


def _end_keys(ends: np.ndarray, g) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(ends ^ (np.asarray(g, np.uint64) * _A + np.uint64(1)))


def sketched_whole(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key) for each band of the texts as they are: all their words but the last, which may be a part of one. And their end keys."""
    own = np.flatnonzero(w.n - 1 >= SHINGLE)
    if not len(own):
        return own, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    lengths = np.array(grid(int(w.n.max())))
    g = lengths[np.searchsorted(lengths, w.n[own] - 1, side="right") - 1]
    end = w.ends()[w.first[own] + w.n[own] - 1]
    with np.errstate(over="ignore"):
        keys = _mix(_band_keys(w.shingles(), w.first[own], g) + end[:, None])
    return np.repeat(own, BANDS), keys.ravel(), _end_keys(end, g)


def sketched_beginnings(w: Words, passes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, key, beginning) for each band of each beginning of the texts that passes the filter; equal beginnings once.

    `place` is the number of the word in which the shorter text would stop, counted from 0: the pair of words before it
    and its first letter are part of the key, and it lies SHIFT words at most off what the beginning's length allows.
    """
    lengths = grid(int(w.n.max(initial=0)))
    ends, texts, sizes, places = w.ends(), [], [], []
    for g, after in zip(lengths, [*lengths[1:], lengths[-1] + 1] if lengths else [], strict=True):
        some = np.flatnonzero(w.n > g)
        for place in range(max(2, g - SHIFT), after + SHIFT):
            at = some[w.n[some] > place]
            at = at[passes(_end_keys(ends[w.first[at] + place], g))]
            texts.append(at)
            sizes.append(np.full(len(at), g))
            places.append(np.full(len(at), place))
    if not sum(map(len, texts)):
        nil = np.zeros(0, np.int64)
        return nil, nil, nil.view(np.uint64), nil.view(np.uint64)
    text, g, place = (np.concatenate(x) for x in (texts, sizes, places))
    begins = w.beginnings()[w.first[text] + place]
    with np.errstate(over="ignore"):
        _, once = np.unique(_mix(begins ^ (g.astype(np.uint64) * _B)), return_index=True)
        text, g, place, begins = text[once], g[once], place[once], begins[once]
        keys = _mix(_band_keys(w.shingles(), w.first[text], g) + ends[w.first[text] + place][:, None])
    i, b = np.nonzero(passes(keys))
    return text[i], place[i], keys[i, b], begins[i]


def stops(short: list[str], long: list[str], marks: str, place: int) -> str | None:
    """How a text stops where a longer one goes on: `inside` a word, `before` another word, at the end of a sentence (`whole`), `open` if that can't be told.

    None if they are no near-copies.
    `short` and `long` are words; `marks` tells what follows each word of the longer text: a full stop or the like (`.`),
    another mark (`,`), a word in capitals (`A`), the end of the text (`$`) or another word (` `). At least SIMILAR of the shorter text's
    five-word runs must stand in the longer one before `place`, where its last word must stand or begin.
    """
    if len(short) <= SHINGLE or place >= len(long) or not long[place].startswith(short[-1]) or short[-2] != long[place - 1]:
        return None
    runs = runs_of(short[:-1])
    if len(runs & runs_of(long[:place])) < SIMILAR * len(runs):
        return None
    if long[place] != short[-1]:
        return "inside"
    return {".": "whole", " ": "before", "$": None}.get(marks[place], "open")


def runs_of(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


#: How a text stops, as bits of what its copies say.
HOW = {"inside": 1, "before": 2, "open": 4, "whole": 8}


def _mark(after: str) -> str:
    """What follows a word (see `stops`), from the next token; none at the end of the text."""
    return "$" if not after else "." if after[0] in ".!?…" else "A" if after[0].isupper() else " " if after[0].isalnum() else ","


def marked_words(text: str) -> tuple[list[str], str]:
    """The words of a text in lower case, and for each what follows it (see `stops`)."""
    found = endings.TOKEN.findall(text)
    words, marks = [], []
    for i, t in enumerate(found):
        if t[0].isalnum():
            after = found[i + 1] if i + 1 < len(found) else ""
            words.append(t.lower())
            marks.append(_mark(after))
    return words, "".join(marks)


def matched(shorts: DataFrame, values: DataFrame) -> DataFrame:
    """(tid, how) of the values of `shorts` with a longer near-copy among `values`: how they stop (see `stops`). Both: distinct (tid, value).

    Of several copies one that ends a sentence there counts more than one that goes on with another word; if one ends a
    sentence and another goes on inside the word, they tell nothing (`open`). Every
    short value meets every different beginning in its bands, none is left out; values in none of them are not shuffled.
    """
    kind = shorts.schema["tid"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, keys, ends = sketched_whole(Words(b.column(1).to_pylist()))
            tids = b.column(0).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys, ends]).view(np.int64)), pa.concat_arrays([tids, pa.nulls(len(ends), tids.type)])], ["key", "tid"])

    # keys of bands with their text, and of ends without: only the filter needs these
    a = stored(shorts.select("tid", "value").mapInArrow(whole, f"key bigint, tid {kind}"))
    # one filter of bounded size: keys beyond that pass oftener, which costs a shuffle and no result
    bits = values.sparkSession.sparkContext.broadcast(bitfilter.of_column(a))

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = partial(bitfilter.passes, *bits.value)
        for b in batches:
            own, place, keys, begins = sketched_beginnings(Words(b.column(1).to_pylist()), passes)
            cols = [pa.array(keys.view(np.int64)), pa.array(begins.view(np.int64)), b.column(0).take(pa.array(own)), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "beginning", "longer", "place"])

    # texts that begin alike stand for each other: what follows is not looked at
    longer = values.select("tid", "value").mapInArrow(beginnings, f"key bigint, beginning bigint, longer {kind}, place int")
    longer = longer.groupBy("key", "beginning").agg(F.min(F.struct("longer", "place")).alias("x"))
    pairs = longer.join(few_or_not(a.where("tid is not null")), "key").groupBy("tid", "beginning").agg(F.min("x").alias("x"))
    pairs = stored(pairs.where("x.longer <> tid").select("tid", "x.longer", "x.place"))
    texts = few_or_not(pairs).join(values.select(F.col("tid").alias("longer"), F.col("value").alias("long")), "longer").join(few_or_not(shorts.select("tid", "value")), "tid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, how = [], []
            memo: dict[str, list[str]] = {}
            for i, (x, y, p) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                a = memo.get(x)
                if a is None:
                    a = memo[x] = only_words(x)
                if h := stops(a, *marked_words(y), p):
                    own.append(i)
                    how.append(HOW[h])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array(how, pa.int32())], ["tid", "how"])

    found = texts.select("tid", "value", "long", "place").mapInArrow(verify, f"tid {kind}, how int").groupBy("tid").agg(F.bit_or("how").alias("says"))

    def said(*how: str) -> Column:
        return F.col("says").bitwiseAND(F.lit(sum(HOW[h] for h in how))) != 0

    how = F.when(said("inside") & said("whole"), "open").when(said("whole"), "whole").when(said("inside"), "inside").when(said("before"), "before").otherwise("open")
    out = stored(found.select("tid", how.alias("how")))
    dropped(a, pairs)
    return out


def limits(values: DataFrame, source: str, column: str) -> dict[str, dict[int, float]]:
    """Field limits: for each source, lengths with the log odds that an unclosed value of that length was cut.

    Lengths of all distinct values of a source are counted, so copies of one value make no limit; only lengths that
    stand out against those around come to the driver.
    """
    lens = (
        values.where(~F.col(column).rlike(r"[.!?…\"”’»')\]]\s*$") & (F.length(column) >= 20))
        .select(F.col(source).alias("source"), F.length(column).alias("size"), F.xxhash64(column).alias("value"))
        .distinct()
        .groupBy("source", "size")
        .agg(F.count("*").alias("n"))
    )
    w = Window.partitionBy("source").orderBy("size").rangeBetween(-LIMIT_AROUND, LIMIT_AROUND)
    near = lens.withColumn("around", (F.sum("n").over(w) - F.col("n")) / F.lit(2.0 * LIMIT_AROUND))
    usual = F.greatest("around", F.lit(0.5))
    # Poisson log likelihood of the count under a rate of its own, less that under the rate around
    ratio = F.col("n") * F.log(F.col("n") / usual) - F.col("n") + usual
    rows = near.where((F.col("n") >= LIMIT_TIMES * usual) & (ratio >= LIMIT_RATIO)).collect()
    out: dict[str, dict[int, float]] = {}
    for r in rows:
        out.setdefault(r["source"], {})[r["size"]] = math.log((r["n"] - r["around"]) / max(r["around"], 0.5))
    return out


NONE, NO, DOUBT, WORDS, SURE = range(-1, 4)


def verdict(text: str, source: str, model: endings.Model, marks: dict[str, dict[int, float]]) -> int:
    """Whether the value lost its end, by itself: NONE (it is no value, or closes with a full stop), NO, DOUBT (closing words speak for it, not enough), WORDS (they do), or SURE (its last characters or a field limit do)."""
    if not is_value(text):
        return NONE
    if text.rstrip().endswith("�"):
        return SURE
    s = endings.stem(text)
    if s.endswith("-") and len(s) > 1 and s[-2].isalpha():
        return SURE
    if endings.closed_stem(s):
        return NONE
    score = model.score(text)
    limit = marks.get(source, {}).get(len(text))
    if limit is not None and not s.endswith(("...", "…")):
        return SURE if score < min(4.0, limit) else NO
    return WORDS if score < CUT else DOUBT if score < 0 else NO


def judge(text: str, source: str, model: endings.Model, marks: dict[str, dict[int, float]]) -> bool:
    """Whether a value lost its end, going by itself alone."""
    return verdict(text, source, model, marks) >= WORDS


def values_of(spark: SparkSession, rewrites: DataFrame, explanations: DataFrame) -> DataFrame:
    """(src_table, row_id, dataset, value) of the two tables; datasets under their right names."""
    a = rewrites.select(F.lit("train_pseudo_rewrites_merged").alias("src_table"), "row_id", dataset_name(F.col("dataset")).alias("dataset"), F.col("pseudo_rewrite").alias("value"))
    b = explanations.select(F.lit("train_explanations_merged").alias("src_table"), "row_id", dataset_name(F.col("dataset")).alias("dataset"), F.col("explanation.implicit_meaning").alias("value"))
    return a.unionByName(b)


def text_id(value: str) -> Column:
    """128 bits of a text: no two of a corpus share them."""
    return F.unhex(F.md5(value))


def flagged(values: DataFrame) -> DataFrame:
    """`values` (src_table, row_id, dataset, value) with `cut`: whether the value lost its end.

    Null, blank and null-like values and error markers are never cut; values of one word neither. Values that close with a
    full stop are whole, also where a copy goes on with another sentence. Repeated rows are judged each, and need no key
    of their own. An empty table gives an empty result.
    """
    spark = values.sparkSession
    rows = values.where(F.col("value").isNotNull()).withColumn("source", F.concat_ws("\u0001", "src_table", "dataset"))
    vocabulary, n = endings.vocabulary(rows, "value")
    model = endings.fit(endings.sample_closed(rows, "value", "value", n), vocabulary)
    shared = spark.sparkContext.broadcast((model, limits(rows, "source", "value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, marks = shared.value
        for b in batches:
            texts = b.column(3).to_pylist()
            got = [verdict(t, s, model, marks) for t, s in zip(texts, b.column(4).to_pylist(), strict=True)]
            rest = [t if NONE < g < SURE else None for t, g in zip(texts, got, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got, pa.int8()), pa.array(rest, pa.string())], ["src_table", "row_id", "dataset", "own", "rest"])

    # `rest`: unclosed values, of which a longer near-copy may tell more than they do themselves
    key = values.schema["row_id"].dataType.simpleString()
    own = stored(spread(rows.select("src_table", "row_id", "dataset", "value", "source")).mapInArrow(run, f"src_table string, row_id {key}, dataset string, own tinyint, rest string"))
    shorts = stored(own.where("rest is not null").select(F.col("rest").alias("value")).distinct().select(text_id("value").alias("tid"), "value"))
    copies = few_or_not(matched(shorts, rows.select("value").distinct().select(text_id("value").alias("tid"), "value")))
    dropped(shorts)
    hit = own.withColumn("tid", text_id("rest")).join(copies, "tid", "left")
    own, how = F.col("own"), F.col("how")
    cut = F.when(own == SURE, True).when(how == "inside", True).when(how == "before", own >= DOUBT).when(how == "whole", False).otherwise(own == WORDS)
    return hit.select("src_table", "row_id", "dataset", cut.alias("cut"))


def found(values: DataFrame) -> DataFrame:
    """(src_table, row_id) of the values that lost their end."""
    return flagged(values).where("cut").select("src_table", "row_id")


def rates(values: DataFrame) -> DataFrame:
    """Rows, cut rows and their rate for each table and dataset; values that are null count among the rows."""
    hit = flagged(values).where("cut").groupBy("src_table", "dataset").agg(F.count("*").alias("cut"))
    every = values.groupBy("src_table", "dataset").agg(F.count("*").alias("n"))
    return every.join(hit, ["src_table", "dataset"], "left").select(
        "src_table", "dataset", "n", F.coalesce("cut", F.lit(0)).alias("cut"), F.round(F.coalesce("cut", F.lit(0)) / F.col("n"), 6).alias("rate")
    )


def values(spark: SparkSession, directory: str) -> DataFrame:
    return values_of(spark, table(spark, directory, "train_pseudo_rewrites_merged"), table(spark, directory, "train_explanations_merged"))
