"""Problem 4: records of evaluation splits that also stand in the training split, exactly or almost.

Texts are sequences of words; two are near if the edit distance between the sequences is at most one in WORDS_PER_EDIT of the
evaluation text's words. Texts that differ in formatting only are one class from the start, so copies are
neither compared nor paired with each other.

Segment join: with k edits allowed, an evaluation text is cut into at least k + 1 segments, one of which a near
training text must hold unchanged, at most k places further on or back. The cuts are laid so that every segment
tells about as much (bigram statistics of the training texts), which keeps common phrases from being segments of
their own. A training text is looked at through all its word runs; a bit filter made from the evaluation segments,
and sized by their number, drops nearly all of them before any shuffle. Segments too many for one filter are taken in
blocks, each against all training texts. Candidates are thinned by a word-parity signature (each edit flips at most two of
its bits) and verified by banded dynamic programming, many pairs at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import bitfilter
from millrace.llm.canon import bare, clean_path, dataset_name, has_letters, ordered_panels
from millrace.session import dropped, few_or_not, stored

WORDS_PER_EDIT = 6
#: Texts with fewer letters and digits count as none.
LEAST = 12
#: Longest segment, in words.
LONGEST = 24
#: Numbers of words, and places, that share a band in the filter.
BAND = 6
#: A bigram is counted one by one from this share of the training texts on; rarer ones tell as much as that.
COMMON = 1e-4

WORD = re.compile(r"https?\W{0,4}//\S+|[^\W_]+")
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xFF51AFD7ED558CCD)


class WordIds(dict):
    """Hashes of words, kept while they are few enough."""

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        plain = re.sub(r"[\W_]+", "", w)
        h = self[w] = int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "little", signed=True)
        return h


def word_ids(text: str, memo: WordIds) -> list[int]:
    """Hashes of the words in lower case; a link is one word, a hyphen parts words."""
    return [memo[w] for w in WORD.findall(text.lower())]


def edits_allowed(n):
    """Edits for a text of n words: none below WORDS_PER_EDIT words."""
    return n // WORDS_PER_EDIT


def distance_within(a: list[int], b: list[int], k: int) -> bool:
    """Whether the edit distance of two sequences is at most k: dynamic programming in a band of 2k + 1."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    far = k + 1
    row = {j: j for j in range(0, min(m, k) + 1)}
    for i in range(1, n + 1):
        new = {}
        for j in range(max(0, i - k), min(m, i + k) + 1):
            v = min(row.get(j, far) + 1, new.get(j - 1, far) + 1)
            if j:
                v = min(v, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            else:
                v = i
            new[j] = min(v, far)
        if min(new.values()) > k:
            return False
        row = new
    return row.get(m, far) <= k


def distances_within(a: tuple, b: tuple, k: np.ndarray, block: int = 4096) -> np.ndarray:
    """`distance_within` for many pairs: `a` and `b` as from `_flat`, `k` edits allowed for each pair.

    Pairs of like length are taken together; a block's table is the band of one row for each of its pairs.
    """
    (ia, fa, na), (ib, fb, nb) = a, b
    out = np.zeros(len(na), bool)
    todo = np.flatnonzero(np.abs(na - nb) <= k)
    todo = todo[np.lexsort((k[todo], na[todo]))]
    for at in range(0, len(todo), block):
        p = todo[at : at + block]
        n, m, most = na[p], nb[p], k[p]
        rows, wide = int(n.max()), int(most.max())
        far = wide + 1
        d = np.arange(-wide, wide + 1)
        d0 = np.where(d >= 0, np.minimum(d, far), far)
        table = np.repeat(d0[None, :], len(p), axis=0)
        for i in range(1, rows + 1):
            live = np.flatnonzero(i <= n)
            col = i + d[None, :]
            inside = (col >= 0) & (col <= m[live][:, None])
            x = ia[fa[p[live]] + i - 1][:, None]
            y = ib[np.clip(fb[p[live]][:, None] + np.clip(col - 1, 0, np.maximum(m[live] - 1, 0)[:, None]), 0, max(0, len(ib) - 1))] if len(ib) else np.zeros((len(live), len(d)), ia.dtype)
            old = table[live]
            new = old + ((x != y) | (col < 1))
            new[:, :-1] = np.minimum(new[:, :-1], old[:, 1:] + 1)
            new = np.where(col == 0, i, new)
            new = np.where(inside, np.minimum(new, far), far)
            for j in range(1, len(d)):
                new[:, j] = np.where(inside[:, j], np.minimum(new[:, j], new[:, j - 1] + 1), far)
            table[live] = new
        out[p] = table[np.arange(len(p)), m - n + wide] <= most
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _N
    return x ^ (x >> np.uint64(29))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a list column as one array, each list's first place and length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy().astype(np.int64)
    ids = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64).view(np.uint64)
    return ids, ends[:-1] - ends[0], np.diff(ends)


def _runs(ids: np.ndarray, length: int, before: np.ndarray | None) -> np.ndarray:
    """Hashes of the runs of `length` words that start at each place, from those of one word less."""
    nxt = np.roll(ids, -(length - 1)) if length > 1 else ids
    with np.errstate(over="ignore"):
        return nxt.copy() if before is None else before * _M + nxt


def _key(runs: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(runs + np.uint64(length) * _M)


def _bands(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A band of text lengths and one of places as one number."""
    with np.errstate(over="ignore"):
        return (size.astype(np.uint64) * np.uint64(1 << 32) + place.astype(np.uint64) + np.uint64(1)) * _N


def _banded(keys: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Keys of the filter: a segment with its bands."""
    with np.errstate(over="ignore"):
        return _mix(keys + bands)


def _bigrams(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the hash of it and of it with the word before (of the word alone at the beginning of a text)."""
    with np.errstate(over="ignore"):
        one = _mix(ids * _M)
        two = _mix(np.roll(ids, 1) * _N + ids)
    start = np.zeros(len(ids), bool)
    start[first[n > 0]] = True
    return one, np.where(start, one ^ np.uint64(1), two)


def segments(ids: np.ndarray, first: np.ndarray, n: np.ndarray, tells: np.ndarray) -> np.ndarray:
    """For each word the number of its segment within its text: k + 1 or more segments, none empty.

    `tells` is how much each word tells; segments get about equal sums. Where that would leave one empty or too
    long, every word is given more weight, in the end the same.
    """
    k1 = edits_allowed(n) + 1
    own = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(ids)) - first[own]
    out = place * k1[own] // np.maximum(n, 1)[own]
    todo = np.ones(len(n), bool)
    for extra in (0.3, 1.0, 3.0, 9.0):
        w = tells + extra
        c = np.cumsum(w)
        base = (c - w)[first[own]]
        total = np.bincount(own, w, len(n))
        s = np.minimum(((c - w - base + w / 2) / np.maximum(total, 1e-9)[own] * k1[own]).astype(np.int64), k1[own] - 1)
        step = np.diff(s, prepend=0)
        inner = place > 0
        jump = np.bincount(own[inner], np.maximum(step[inner] - 1, 0), len(n)).astype(int)
        edge = np.zeros(len(n), bool)
        some = n > 0
        edge[some] = (s[first[some]] != 0) | (s[first[some] + n[some] - 1] != k1[some] - 1)
        new = np.flatnonzero((step != 0) | ~inner)
        longest = np.zeros(len(n), np.int64)
        np.maximum.at(longest, own[new], np.diff(np.append(new, len(ids))))
        fine = todo & (jump == 0) & ~edge & (longest <= LONGEST)
        pick = fine[own]
        out[pick] = s[pick]
        todo &= ~fine
        if not todo.any():
            break
    return out


def _tell(ids: np.ndarray, first: np.ndarray, n: np.ndarray, stats) -> np.ndarray:
    """Minus the log share of each word after the word before it."""
    key, count, least, total = stats
    one, two = _bigrams(ids, first, n)

    def look(h):
        if not len(key):
            return np.full(len(h), least)
        i = np.clip(np.searchsorted(key, h), 0, len(key) - 1)
        return np.where(key[i] == h, count[i], least)

    pair, before = look(two), np.roll(look(one), 1)
    start = np.zeros(len(ids), bool)
    start[first[n > 0]] = True
    base = np.where(start, total, np.maximum(before, pair))
    return np.clip(np.log(np.maximum(base, least) / pair), 0.0, -np.log(COMMON))


def has_text(text):
    return has_letters(text, LEAST)


def prepared(rows: DataFrame) -> DataFrame:
    """(id, class, plain, file) of rows (id, text, path), each: a digest of the text without its formatting, the text with panels in order (both null
    without a text), and the file (null without one). There is no filter here: it would be pushed below, and all that it names computed twice."""
    text, some = F.col("text"), has_text(F.col("text"))
    return rows.select("id", F.when(some, F.unhex(F.md5(bare(text)))).alias("class"), F.when(some, ordered_panels(text)).alias("plain"), clean_path(F.col("path")).alias("file"))


def tokenized(rows: DataFrame) -> DataFrame:
    """(class, ids, n, sig) of the classes of `prepared` rows, a class being known by its smallest row id.

    Word hashes of one of its texts, their number, and for 64 kinds of words whether their number is odd.
    """
    classes = rows.where("class is not null").groupBy("class").agg(F.min("id").alias("cid"), F.min("plain").alias("plain"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordIds()
        for b in batches:
            rows = [word_ids(t, memo) for t in b.column(1).to_pylist()]
            n = np.array([len(r) for r in rows], np.int64)
            flat = np.fromiter(chain.from_iterable(rows), np.int64, count=int(n.sum()))
            own = np.repeat(np.arange(len(n)), n)
            bit = (_mix(flat.view(np.uint64)) >> np.uint64(58)).astype(np.int64)
            odd = np.bincount(own * 64 + bit, minlength=len(n) * 64).reshape(-1, 64) & 1
            sig = np.packbits(odd.astype(np.uint8), axis=1).view(">i8").astype(np.int64)[:, 0]
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(n.astype(np.int32)), pa.array(sig)], ["class", "ids", "n", "sig"])

    return classes.select("cid", "plain").mapInArrow(run, "class bigint, ids array<bigint>, n int, sig bigint")


def _statistics(train: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Counts of the words and bigrams of at least a share COMMON of the texts (at most 2 / COMMON times the words of a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, rows = [], [], 0
        for b in batches:
            ids, first, n = _flat(b.column(0))
            rows += len(n)
            if len(ids):
                for h in _bigrams(ids, first, n):
                    k, c = np.unique(h, return_counts=True)
                    keys.append(k)
                    counts.append(c)
        if keys:
            k, i = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(i, np.concatenate(counts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c), pa.array(np.full(len(k), 0, np.int64))], ["k", "c", "rows"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([rows], pa.int64())], ["k", "c", "rows"])

    sums = train.select("ids").mapInArrow(run, "k bigint, c bigint, rows bigint").groupBy("k").agg(F.sum("c").alias("c"), F.sum("rows").alias("rows"))
    total = train.count()
    least = max(2.0, COMMON * total)
    got = sums.where(F.col("c") >= least).select("k", "c").toPandas()
    k = got["k"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(k)
    return k[order], got["c"].to_numpy(float)[order], least, float(max(total, 1))


def _segmented(evals: DataFrame, stats) -> DataFrame:
    """(key, class, place, length, k, n, sig): a row for each segment of each evaluation class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st = stats.value
        for b in batches:
            keep = pc.greater_equal(b.column(2), WORDS_PER_EDIT)
            b = b.filter(keep)
            ids, first, n = _flat(b.column(1))
            if not len(ids):
                continue
            seg = segments(ids, first, n, _tell(ids, first, n, st))
            own = np.repeat(np.arange(len(n)), n)
            begin = np.flatnonzero((np.diff(seg, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
            size = np.diff(np.append(begin, len(ids)))
            key = np.zeros(len(begin), np.uint64)
            runs = None
            for length in range(1, int(size.max()) + 1):
                runs = _runs(ids, length, runs)
                at = size == length
                key[at] = _key(runs[begin[at]], length)
            who = own[begin]
            cols = b.take(pa.array(who))
            place = pa.array((begin - first[who]).astype(np.int32))
            k = pa.array(edits_allowed(n[who]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), cols.column(0), place, pa.array(size.astype(np.int32)), k, cols.column(2), cols.column(3)], ["key", "class", "place", "length", "k", "n", "sig"])

    return evals.select("class", "ids", "n", "sig").mapInArrow(run, "key bigint, class bigint, place int, length int, k int, n int, sig bigint")


def _filter_keys(b: pa.RecordBatch) -> np.ndarray:
    """The keys of the filter for segments (key, n, k, place): one for each band of lengths and of places that edits can lead to."""
    key, n, k, p = (b.column(i).to_numpy() for i in range(4))
    key = key.view(np.uint64)
    low, high, left, right = np.maximum(n - k, 0) // BAND, (n + k) // BAND, np.maximum(p - k, 0) // BAND, (p + k) // BAND
    out = [np.zeros(0, np.uint64)]
    for i in range(int((high - low).max(initial=-1)) + 1):
        for j in range(int((right - left).max(initial=-1)) + 1):
            on = (low + i <= high) & (left + j <= right)
            out.append(_banded(key[on], _bands((low + i)[on], (left + j)[on])))
    return np.concatenate(out)


def _matching(train: DataFrame, bits, lengths: list[int], block: int, blocks: int) -> DataFrame:
    """(key, class, where, sig): the word runs of the training classes that pass the filter of a block; `where` is place * 2^32 + n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, size = bits.value
        for b in batches:
            ids, first, n = _flat(b.column(1))
            if not len(ids):
                continue
            own = np.repeat(np.arange(len(n)), n)
            room = (first + n)[own] - np.arange(len(ids))
            bands = _bands((n // BAND)[own], (np.arange(len(ids)) - first[own]) // BAND)
            runs = None
            keys, at = [], []
            for length in range(1, max(lengths, default=0) + 1):
                runs = _runs(ids, length, runs)
                if length not in lengths:
                    continue
                i = np.flatnonzero(room >= length)
                k = _key(runs[i], length)
                if blocks > 1:
                    own_block = k % np.uint64(blocks) == block
                    i, k = i[own_block], k[own_block]
                on = bitfilter.passes(f, size, _banded(k, bands[i]))
                keys.append(k[on])
                at.append(i[on])
            if not keys:
                continue
            k, i = np.concatenate(keys), np.concatenate(at)
            cols = b.take(pa.array(own[i]))
            where = (i - first[own[i]]) * (1 << 32) + n[own[i]]
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), cols.column(0), pa.array(where), cols.column(3)], ["key", "class", "where", "sig"])

    return train.select("class", "ids", "n", "sig").mapInArrow(run, "key bigint, class bigint, where bigint, sig bigint")


#: Filter keys of a segment, about: the bands of lengths and places that its edits reach.
KEYS_PER_SEGMENT = 4


def near_classes(train: DataFrame, evals: DataFrame) -> DataFrame:
    """(t, e): classes whose texts are near but not the same. Both sides as from `tokenized`."""
    sc = train.sparkSession.sparkContext
    stats = sc.broadcast(_statistics(train))
    segs = stored(_segmented(evals, stats))
    lengths = sorted(r[0] for r in segs.select("length").distinct().collect())  # at most LONGEST
    keys = KEYS_PER_SEGMENT * segs.count()
    blocks = bitfilter.blocks_for(keys)
    found = None
    for block in range(blocks):
        own = segs if blocks == 1 else segs.where(_unsigned_mod(F.col("key"), blocks) == block)
        bits = sc.broadcast(bitfilter.made(own.select("key", "n", "k", "place"), _filter_keys, -(-keys // blocks)))
        t = _matching(train, bits, lengths, block, blocks).select("key", F.col("class").alias("t"), "where", F.col("sig").alias("ts"))
        e = own.select("key", F.col("class").alias("e"), "place", "k", "n", "sig")
        close = (
            (F.abs(F.shiftright("where", 32).cast("int") - F.col("place")) <= F.col("k"))
            & (F.abs(F.col("where").bitwiseAND(F.lit((1 << 32) - 1)).cast("int") - F.col("n")) <= F.col("k"))
            & (F.bit_count(F.col("ts").bitwiseXOR(F.col("sig"))) <= 2 * F.col("k"))
        )
        got = e.join(t, "key").where(close).select("t", "e")
        if blocks > 1:
            got = stored(got.distinct())
            bits.unpersist()
        found = got if found is None else found.unionByName(got)
    pairs = stored(found.distinct())
    both = stored(few_or_not(pairs).join(evals.select(F.col("class").alias("e"), F.col("ids").alias("ei")), "e"))
    dropped(segs, pairs)
    texts = few_or_not(both).join(train.select(F.col("class").alias("t"), F.col("ids").alias("ti")), "t")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _flat(b.column(2)), _flat(b.column(3))
            b = b.filter(pa.array(distances_within(x, y, edits_allowed(x[2])), pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["t", "e"])

    out = stored(texts.select("t", "e", "ei", "ti").mapInArrow(verify, "t bigint, e bigint"))
    dropped(both)
    return out


def _unsigned_mod(key: Column, n: int) -> Column:
    """A long, read as unsigned, modulo n."""
    return (F.pmod(F.shiftrightunsigned(key, 1), F.lit(n)) * 2 + key.bitwiseAND(F.lit(1))) % n


@dataclass
class Matches:
    """What both sides share, by classes: rows of one class have texts that are the same up to formatting.

    `train` and `evals`: (id, class) of the rows with a text. `near`: (tc, ec), pairs of different classes.
    `train_files` and `eval_files`: (id, file, has_text) of the rows that name a file.
    """

    train: DataFrame
    evals: DataFrame
    near: DataFrame
    train_files: DataFrame
    eval_files: DataFrame


def matches(train: DataFrame, evals: DataFrame, key: str = "row_id", text: str = "text", path: str = "image_path") -> Matches:
    """Overlaps as pairs between classes and files, plus the rows of each: copies aren't expanded into pairs."""
    rows_a, rows_b = (x.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(path).alias("path")) for x in (train, evals))
    a, b = stored(prepared(rows_a)), stored(prepared(rows_b))  # canonical forms and files are used several times below
    ta, tb = stored(tokenized(a)), stored(tokenized(b))
    ca, cb = (x.where("class is not null").select("id", "class") for x in (a, b))
    found = near_classes(ta, tb)
    dropped(ta, tb)
    # classes are known by their smallest row there: its digest leads from a pair of classes to all their rows
    near = few_or_not(found).join(ca.select(F.col("id").alias("t"), F.col("class").alias("tc")), "t").join(cb.select(F.col("id").alias("e"), F.col("class").alias("ec")), "e").where("tc <> ec")
    near = stored(near.select("tc", "ec"))
    dropped(found)
    files = (x.where("file is not null").select("id", "file", F.col("class").isNotNull().alias("has_text")) for x in (a, b))
    return Matches(ca, cb, near, *files)


def overlaps(train: DataFrame, evals: DataFrame, key: str = "row_id", text: str = "text", path: str = "image_path") -> DataFrame:
    """(train_row, eval_row, kind): every pair, `kind` one of same, near, picture.

    A pair counts when both rows have a text and the texts are the same up to formatting or near, or when at
    least one has none and both name the same file. Null texts and those with fewer than LEAST letters and
    digits are none; a null or blank path names no file. Repeated rows make their own pairs. Empty tables give
    no pairs. Whole texts are compared, whatever their length.
    """
    m = matches(train, evals, key, text, path)
    ca, cb = m.train.select(F.col("id").alias("train_row"), "class"), m.evals.select(F.col("id").alias("eval_row"), "class")
    same = ca.join(cb, "class").select("train_row", "eval_row", F.lit("same").alias("kind"))
    near = stored(few_or_not(m.near).join(cb.withColumnRenamed("class", "ec"), "ec").select("tc", "eval_row"))
    near = few_or_not(near).join(ca.withColumnRenamed("class", "tc"), "tc").select("train_row", "eval_row", F.lit("near").alias("kind"))
    fa, fb = m.train_files.withColumnRenamed("id", "train_row"), m.eval_files.withColumnRenamed("id", "eval_row")
    mute_a, mute_b = (few_or_not(stored(x.where("not has_text").drop("has_text"))) for x in (fa, fb))
    picture = fb.select("eval_row", "file").join(mute_a, "file").select("train_row", "eval_row")
    picture = picture.unionByName(fa.join(mute_b, "file").where("has_text").select("train_row", "eval_row")).withColumn("kind", F.lit("picture"))
    return same.unionByName(near).unionByName(picture)


def counted(train: DataFrame, evals: DataFrame, key: str = "row_id", text: str = "text", path: str = "image_path") -> DataFrame:
    """(eval_row, kind, pairs): for each evaluation row with overlaps the number of its training rows, by kind.

    Counts go through classes and files: no pair of rows is made, so a picture or text with many copies costs a row.
    """
    m = matches(train, evals, key, text, path)
    of_class = m.train.groupBy("class").agg(F.count("*").alias("n"))
    of_file = m.train_files.groupBy("file").agg(F.count_if(~F.col("has_text")).alias("mute"), F.count("*").alias("n"))
    cb = m.evals.select(F.col("id").alias("eval_row"), "class")
    same = cb.join(of_class, "class").select("eval_row", F.lit("same").alias("kind"), "n")
    per = few_or_not(m.near).join(of_class.withColumnRenamed("class", "tc"), "tc").groupBy(F.col("ec").alias("class")).agg(F.sum("n").alias("n"))
    near = cb.join(per, "class").select("eval_row", F.lit("near").alias("kind"), "n")
    n = F.when(F.col("has_text"), F.col("mute")).otherwise(F.col("n"))
    picture = m.eval_files.join(of_file, "file").select(F.col("id").alias("eval_row"), F.lit("picture").alias("kind"), n.alias("n")).where("n > 0")
    return same.unionByName(near).unionByName(picture).groupBy("eval_row", "kind").agg(F.sum("n").alias("pairs"))


def report(train: DataFrame, evals: DataFrame, key: str = "row_id") -> DataFrame:
    """Per split and dataset of the evaluation rows: their number, the overlapping ones by kind, the pairs and the rate."""
    rows = evals.select(F.col(key).alias("eval_row"), "split", dataset_name(F.col("dataset")).alias("dataset"))
    per = counted(train, evals, key).groupBy("eval_row").agg(F.sum("pairs").alias("pairs"), *[F.max(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k) for k in ("same", "near", "picture")])
    j = rows.join(per, "eval_row", "left").fillna(0, ["pairs", "same", "near", "picture"])
    return j.groupBy("split", "dataset").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("pairs") > 0).alias("overlapping"),
        *[F.sum(k).cast("long").alias(k) for k in ("same", "near", "picture")],
        F.sum("pairs").cast("long").alias("pairs"),
        F.round(F.count_if(F.col("pairs") > 0) / F.count("*"), 6).alias("rate"),
    )
