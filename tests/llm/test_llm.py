"""Operators of the llm package: small cases, brute force, round trips, held-out accuracy."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import abuse, canon, endings, formatting, overlap, packing, pairs, queries, quota, stuffing, tokenizer, truncation, words
from millrace.session import table
from tests.compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    assert_same(queries.queries()[name](spark, data).toPandas(), connect(data).sql(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, data, name):
    assert queries.queries()[name](spark, data).count() >= 0


def strings(spark, values, kind="row_id bigint, text string"):
    return spark.createDataFrame(list(enumerate(values)), kind)


# --- canonical forms


def test_paths(spark):
    paths = ["./a/b.jpg", "a/./b.jpg", "a\\b.jpg", "a/c/../b.jpg", " a//b.jpg", "", None, "a/b.jpg"]
    got = [r[0] for r in strings(spark, paths).orderBy("row_id").select(canon.clean_path(F.col("text"))).collect()]
    assert got == ["a/b.jpg"] * 5 + [None, None, "a/b.jpg"]


def test_names(spark):
    got = strings(spark, ["MMHS-150k", " mami", "har_meme\t", None]).orderBy("row_id").select(canon.dataset_name(F.col("text"))).collect()
    assert [r[0] for r in got] == ["mmhs150k", "mami", "harmeme", None]


SAME = [
    "top: the cat sat | bottom: on the big mat", "[BOTTOM] on the big mat\n[TOP] the cat sat", '{"bottom": "on the big mat", "top": "The cat sat"}',
    "bottom = on the big mat; top = the cat sat", "Bottom : on the big-mat! / Top : the c​at sat.", "“top the cat sat bottom on the BIG mat”",
]
OTHER = ["top: on the big mat | bottom: the cat sat", "the cat sat on the big mat", "left: the cat sat | right: on the big mat", "short", "", None, "😂😂", "the cat sat on the big rug"]


def test_copies(spark):
    rows = strings(spark, OTHER[:2] + SAME + OTHER[2:] + [SAME[0], "short"])
    got = {(r.keep, r.dup) for r in formatting.copies(rows).collect()}
    n = len(OTHER) + len(SAME)
    assert got == {(2, i) for i in range(3, 2 + len(SAME))} | {(2, n)}
    groups = {r.keep: (r.copies, r.variants) for r in formatting.collapse(rows).collect()}
    assert groups[2] == (len(SAME) + 1, len(SAME)) and groups[0] == (1, 1) and len(groups) == 5


def test_copies_match_brute_force(spark):
    rng = random.Random(3)
    base = ["Schöne Straße am Fluß", "one text of some words", "another text of words", "A-B c.d E f G h I j K l"]

    def noise(t):
        t = rng.choice([str.upper, str.lower, str.title, str])(t)
        return "".join(c + rng.choice(["", "", "", " ", "!", "​", "-"]) for c in t)

    texts = [noise(rng.choice(base)) for _ in range(200)]

    def key(t):
        return "".join(c for c in unicodedata.normalize("NFC", t).lower().replace("ß", "ss") if c.isalnum())

    first = {}
    want = set()
    for i, t in enumerate(texts):
        if len(key(t)) >= 12 and first.setdefault(key(t), i) != i:
            want.add((first[key(t)], i))
    assert {(r.keep, r.dup) for r in formatting.copies(strings(spark, texts)).collect()} == want


def test_hot_and_empty_copies(spark):
    rows = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("The same caption"), F.repeat(F.lit("!"), (F.col("id") % 7).cast("int")))).otherwise(F.concat(F.lit("caption number "), "id")).alias("text"), F.lit(1).alias("bare"), F.lit(2).alias("raw"))
    got = formatting.copies(rows)
    assert got.count() == 999 and got.where("keep = 0").count() == 999
    assert formatting.copies(rows.limit(0)).count() == 0


# --- tokenizer


def test_pieces_keep_ids():
    enc = tokenizer.encoding()
    rng = random.Random(1)
    for _ in range(30):
        t = "".join(rng.choices("ab  \n\t.,'s1é😂<|endoftext|>", k=400))
        assert "".join(tokenizer.safe_pieces(t, 20)) == t
        assert [i for p in tokenizer.safe_pieces(t, 20) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)


def test_ids_match_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenizer.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["Hello world", "", None, " ", "<|endoftext|> x", "naïve — ☃ 😂\r\n\x00", "word " * 9000, "a" * 30000]
    got = {r.doc_id: list(r.ids) for r in tokenizer.token_ids(strings(spark, texts, "doc_id bigint, text string")).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    back = {r.doc_id: r.text for r in tokenizer.decoded(tokenizer.token_ids(strings(spark, texts, "doc_id bigint, text string"))).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}


# --- packing


def check_packing(rows, sizes, capacity):
    used, per_key = {}, {}
    for r in rows:
        if r.container is not None:
            used[r.container] = used.get(r.container, 0) + r.n_tokens
        per_key.setdefault(r.key, []).append((r.start, r.n_tokens, r.container))
    assert set(per_key) == {k for k, _ in sizes}
    assert all(u <= capacity for u in used.values())
    for k, s in sizes:
        parts = sorted(per_key[k], key=lambda p: p[0])
        assert sum(p[1] for p in parts) == max(0, s or 0)
        assert len(parts) == max(1, -(-(s or 0) // capacity))
        assert all((p[2] is None) == (p[1] == 0) for p in parts)
    return used


def test_pack(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 1, 5, 30, 99, 100, 101, 250, None])) for i in range(500)] + [(i, 40) for i in range(500, 900)]
    df = spark.createDataFrame(sizes, "key bigint, n_tokens int")
    rows = packing.pack(df, "key", capacity=100, tiers=(25, 50, 100), step=8).collect()
    used = check_packing(rows, sizes, 100)
    assert len(used) <= -(-sum(s or 0 for _, s in sizes) // 100) * 1.15
    assert set(used) == set(range(len(used)))
    groups = {}
    for r in rows:
        if r.container is not None:
            groups.setdefault(r.step_group, set()).add(r.container)
    assert max(map(len, groups.values())) - min(map(len, groups.values())) <= 1


def test_pack_nothing(spark):
    df = spark.createDataFrame([], "key bigint, n_tokens int")
    assert packing.pack(df, "key").count() == 0
    df = spark.createDataFrame([(1, 0), (2, None)], "key bigint, n_tokens int")
    assert [r.container for r in packing.pack(df, "key").collect()] == [None, None]
    assert packing.fill_report(packing.pack(df, "key")).first().containers == 0


def test_pack_ranks_large_sizes_in_buckets(spark):
    sizes = [(i, 7 + i % 3) for i in range(2000)]
    rows = packing.pack(spark.createDataFrame(sizes, "key bigint, n_tokens int"), "key", capacity=100, tiers=(25, 50, 100), ranked=100).collect()
    used = check_packing(rows, sizes, 100)
    assert len(used) <= -(-sum(s for _, s in sizes) // 100) * 1.03


def test_plan_fills_gaps():
    p = packing.plan({1500: 10, 548: 10, 1024: 4, 3: 8})
    assert p.containers == 13 and p.tokens == 1500 * 10 + 5480 + 4096 + 24


def test_plan_follows_tiers():
    rng = random.Random(7)
    sizes = [max(1, min(2048, int(rng.lognormvariate(4.5, 1.2)))) for _ in range(20_000)]
    left = np.bincount(sizes, minlength=2049)
    fewest = -(-sum(sizes) // 2048)
    made = {}
    for tiers in ((2048,), (512, 2048), packing.TIERS):
        patterns = packing.windows(left, tiers)
        for t, below in zip(tiers, (0, *tiers[:-1]), strict=True):
            for filled, times, content in patterns[t]:
                assert filled == sum(s * k for s, k in content) <= t and times > 0
                assert max(s for s, _ in content) > below  # a window is opened for a text of its own tier
        p = made[tiers] = packing.composed(patterns, 2048)
        used, inside = np.zeros(p.containers, np.int64), {}
        for s in np.flatnonzero(left):
            n = int(left[s])
            window, at = p.find(np.full(n, s), np.arange(n))
            assert (window >= s).all()
            np.add.at(used, at, s)
            for w in window:
                inside[int(w)] = inside.get(int(w), 0) + 1
        assert used.max() <= 2048 and used.sum() == sum(sizes) == p.tokens
        assert p.containers <= fewest * 1.001 + 1
        assert set(inside) == set(tiers)  # every tier's windows are in use, and change with the tiers
    short = {t: np.mean(made[t].find(np.full(50, 40), np.arange(50))[0] <= 256) for t in made}
    assert short[(2048,)] == 0 and short[packing.TIERS] > 0
    # many texts just over a short window, and nothing to fill its gaps: the ladder gets coarser by itself
    assert packing.plan({300: 600}).containers == 100 and len(packing.plan({300: 600}).tiers) < 4


# --- quotas


def brute_seats(available, target, floor, n):
    order = sorted((r > floor[c], (r - 0.5) / target[c], c) for c in target if target[c] > 0 for r in range(1, available.get(c, 0) + 1))
    given = dict.fromkeys(target, 0)
    for _, _, c in order[:n]:
        given[c] += 1
    return given


def test_seats_match_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        cats = "abcdef"[: rng.randint(1, 6)]
        available = {c: rng.choice([0, 1, 3, 10, 50, 400]) for c in cats}
        target = {c: rng.choice([0.0, 0.01, 0.1, 0.25, 0.5]) for c in cats}
        floor = {c: rng.choice([0, 1, 5, 20]) for c in cats}
        n = rng.choice([0, 1, 7, 40, 200, 2000])
        assert quota.seats(available, target, floor, n) == brute_seats(available, target, floor, n)


def test_floors_beyond_the_sample_take_no_longer():
    target, floor = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10**9, "b": 10**9, "c": 10**8}
    got = quota.seats({"a": 10**10, "b": 10**10, "c": 10**10}, target, floor, 10**9)
    assert sum(got.values()) == 10**9 and got["c"] == 10**8 and abs(got["a"] / got["b"] - 5 / 3) < 1e-6


def test_sample_and_report(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("k"), F.lit("x").alias("seats"), F.lit("y").alias("order"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 1), ("c", 0.1, 2), (None, 0.1, 1)], "k string, target_share double, min_rows int")
    got = quota.sample(rows, targets, ["k"], share=0.3)
    assert got.columns == rows.columns
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {"a": 200, "b": 100}
    assert {r.k: r.unmet for r in quota.report(rows, targets, ["k"], share=0.3).collect()} == {"a": "shifted", "b": "exhausted", "c": "absent"}
    assert quota.sample(rows.limit(0), targets, ["k"]).count() == 0
    assert quota.sample(rows, targets.limit(0), ["k"]).count() == 0


# --- pairs


P = "[T: x] [V: y] [M: null] | The quick brown fox and the lazy dog are here"
CASES = [
    (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("N/A", "empty"), ("...", "empty"), ("😂", "empty"), ("Rewrite: n/a", "empty"),
    ("the QUICK brown fox, and the lazy-dog are here!!", "copy"), (P.upper(), "copy"), ("Rewrite: The quick brown fox and the lazy dog are here", "copy"),
    ("I'm sorry, but I can't help with rewriting this text.", "refusal"), ("i cant do that, the meme is against policy", "refusal"),
    ("Der Nachbar und die Lehrerin sind in der Schule und trinken einen Kaffee.", "other_language"),
    ("The quick brown fox and the small dog are here", None), ("Sorry to everyone who waited for the bus.", None), ("The baker was unable to find the cat.", None),
]


def test_defects():
    model = endings.Model(endings.Vocabulary(frozenset(), [], frozenset()), np.zeros(endings.DIM), 5.0)
    for response, want in CASES:
        assert pairs.defect(P, response, model, {}) == want, response
    assert pairs.defect(None, "Some words here.", model, {}) is None
    assert pairs.defect(P, "x" * 50_000, model, {}) is None


WORDS = "the quick brown fox and the lazy dog are here while nobody in the old harbour sells bread or paints a lantern green".split()


def test_compressor_decides_copies(monkeypatch):
    rng = random.Random(13)
    copies, changed = [], []
    for _ in range(400):
        w = rng.choices(WORDS, k=rng.randint(8, 60))
        i = rng.randrange(2, len(w) - 2)
        other = rng.choice([x for x in WORDS if len(x) == len(w[i]) and x != w[i]] or ["qz" + w[i][2:]])
        copies.append((" ".join(w), " ".join(w).title() + " !"))
        changed += [(" ".join(w), " ".join([*w[:i], other, *w[i + 1 :]])), (" ".join(w), " ".join(w[:i] + w[i + 1 :])), (" ".join(w), " ".join([*w[:i], "not", *w[i:]]))]
    changed = [(a, b) for a, b in changed if pairs.canonical(a) != pairs.canonical(b)]
    assert all(pairs.is_copy(b, a) for a, b in copies)
    assert np.mean([pairs.is_copy(b, a) for a, b in changed]) < 0.01
    assert all(pairs.is_copy(x, x) for x in ("A b c", "word " * 3, "ünï cödé 😂 " * 9000))
    assert not pairs.is_copy("A b d", "A b c") and not pairs.is_copy("a b c d", "a b c")
    # without the compressor either every copy is lost or the changed texts come along
    monkeypatch.setattr(pairs, "packed", lambda a, b: len(a))
    assert np.mean([pairs.is_copy(b, a) for a, b in changed]) > 0.2
    monkeypatch.setattr(pairs, "packed", lambda a, b: len(a) if a != b else 0)
    monkeypatch.setattr(pairs, "new_bytes", lambda a, b: len(a))
    assert not any(pairs.is_copy(b, a) for a, b in copies)


def test_long_refusals():
    one = "I'm sorry, but I can't help with rewriting this text. "
    assert pairs.is_refusal(one) and pairs.is_refusal(one * 9) and pairs.is_refusal("The weather was fine. " * 50 + one)
    assert not pairs.is_refusal("He was unable to come. " + "The weather was fine. " * 20 + "They read the captions.")


def test_defects_of_odd_tables(spark):
    kind = "row_id bigint, input_text string, target_text string, dataset string, prompt int, source int"
    assert pairs.defects(spark.createDataFrame([], kind)).count() == 0
    rows = spark.createDataFrame([(1, None, None, None, 1, 1), (1, None, None, None, 1, 1), (2, P, None, "d", 1, 1)], kind)
    assert [r.defect for r in pairs.defects(rows).collect()] == ["empty"] * 3


def test_language():
    assert words.guess_language("the cat and the dog are in the house".split()) == "en"
    assert words.guess_language("der hund und die katze sind in dem haus".split()) == "de"
    assert words.guess_language(["x"]) is None


# --- endings and truncation


def test_model_tells_cut_texts():
    rng = random.Random(4)
    who, what, where = ["the baker", "my uncle", "a tired nurse", "our landlord"], ["opened", "painted", "carried", "described"], ["in the garden", "on the balcony", "under the bridge", "at the market"]

    def sentence():
        return f"{rng.choice(who)} {rng.choice(what)} the {rng.choice(['window', 'bicycle', 'umbrella', 'lantern'])} {rng.choice(where)}"

    texts = [sentence() + "." for _ in range(600)]
    count = {}
    for t in texts:
        for w in set(endings.tokens(t)):
            count[w] = count.get(w, 0) + 1
    v = endings.Vocabulary(frozenset(count), sorted(count), frozenset(w for w in count if count[w] >= 0.03 * len(texts)))
    m = endings.fit(texts, v)
    whole = [m.score(sentence()) for _ in range(100)]
    part = [m.score(s[: rng.randint(10, len(s) - 4)]) for s in (sentence() for _ in range(100))]
    assert np.mean([x > 0 for x in whole]) > 0.95 and np.mean([x < 0 for x in part]) > 0.9


def test_stops():
    long = "The baker opened the window in the garden and the Nurse laughed at the market. Then it rained, all day"

    def how(short, place=None):
        a = truncation.only_words(short)
        return truncation.stops(a, *truncation.marked_words(long), len(a) - 1 if place is None else place)

    assert how("the baker opened the window in the garden and the nur") == "inside"
    assert how("the baker opened the window in the garden") == "before"
    assert how("The baker opened the window in the garden and the nurse laughed at the market") == "whole"
    assert how("The baker opened the window in the garden and the") == "open"
    assert how(long) is None and how("") is None and how("the tailor sold a lamp on the balcony before noon") is None
    assert how("the baker opened the green window in the garden and the nurse laughed at the mar", 14) is None  # two of nine runs differ too much
    assert how("a baker opened the window in the garden and the nurse laughed at the mar") == "inside"


NOUNS = [f"{a}{b}" for a in "baker tailor nurse lantern window garden bicycle umbrella market harbour bridge kettle".split() for b in ("", "s", "ish", "like", "wise", "hood", "less")]


def sentence(rng, n):
    return [rng.choice(NOUNS) if rng.random() < 0.6 else rng.choice(["the", "of", "and", "in", "with", "by"]) for _ in range(n)]


def near_copy(rng, words):
    """One word in forty changed, added or missing."""
    out = []
    for w in words:
        out += rng.choice([[], [w, "also"], ["quite"]]) if rng.random() < 1 / 40 else [w]
    return out


def test_recall_of_cut_copies(spark):
    """Copies that kept 30 to 80 % of their text, word for word or nearly: those at similarity 0.8 or more are found, by the min-hash leg alone."""
    rng = random.Random(21)
    values, exact, near = [], [], []
    for i in range(1500):
        whole = sentence(rng, rng.randint(24, 90))
        values.append((3 * i, " ".join(whole)))
        for k, (copy, into) in enumerate(((whole, exact), (near_copy(rng, whole), near)), 1):
            kept = copy[: int(len(copy) * rng.uniform(0.3, 0.8))]
            if len(kept[-1]) > 3:
                kept[-1] = kept[-1][: rng.randint(1, len(kept[-1]))]
            values.append((3 * i + k, " ".join(kept)))
            runs = truncation.runs_of(kept[:-1])
            if len(kept) > 5 and len(runs & truncation.runs_of(whole)) >= 0.8 * len(runs) and kept[-3:-1] in [whole[j : j + 2] for j in range(len(whole))]:
                into.append(3 * i + k)
    df = spark.createDataFrame(values, "tid bigint, value string")
    got = {r.tid for r in truncation.matched(df.where("tid % 3 > 0"), df).collect()}
    assert len(exact) > 1400 and len(near) > 600
    assert np.mean([t in got for t in exact]) > 0.995
    assert np.mean([t in got for t in near]) > 0.9


def test_bands_of_beginnings():
    words = sentence(random.Random(5), 60)
    long, other = " ".join(words), " ".join(sentence(random.Random(6), 60))
    for n in range(6, 60):
        _, keys, ends = truncation.sketched_whole(truncation.Words([" ".join(words[:n])]))
        assert len(keys) == truncation.BANDS and len(ends) == 1

        def passes(k, keys=np.concatenate([keys, ends])):
            return np.isin(k, keys)

        own, place, found, _ = truncation.sketched_beginnings(truncation.Words([other, long, "too short", long + " too"]), passes)
        assert set(own) == {1} and n - 1 in set(place) and set(found) == set(keys)
    own, keys, ends = truncation.sketched_whole(truncation.Words(["too short", "", "one two three four five"]))
    assert not len(own) and not len(keys) and not len(ends)


def test_runs_are_hashed_once(monkeypatch):
    rng = np.random.default_rng(4)
    w = truncation.Words([" ".join(f"w{i}" for i in rng.integers(0, 500, n)) for n in (3, 7, 40, 900)])
    first, g = (np.array(x) for x in zip(*((f, g) for f, n in zip(w.first, w.n) for g in truncation.grid(int(n)) * 2)))
    own, mixed = truncation._mix, []
    monkeypatch.setattr(truncation, "_mix", lambda x: mixed.append(len(x)) or own(x))
    got = truncation._band_keys(w.shingles(), first, g)
    # each run and each different beginning once a row of a band, not each run again for all beginnings that hold it
    assert sum(mixed) <= truncation.BANDS * truncation.ROWS * (len(w.ids) + len(g) // 2)
    each = [truncation._band_keys(w.shingles(), first[i : i + 1], g[i : i + 1])[0] for i in range(len(g))]
    assert np.array_equal(got, each)
    s, i = w.shingles()[w.first[1] : w.first[1] + 3], np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = np.uint64(7) * i + np.uint64(1)
        for r in range(truncation.ROWS):
            h = own((h ^ own((s ^ np.uint64((r + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))) * i).min()) * i)
    assert got[(first == w.first[1]) & (g == 7)][0, 0] == h


def test_batches_of_short_values(spark):
    w = truncation.Words(["two words", "", "...", "one, two three four"])
    assert w.n.tolist() == [2, 0, 0, 4] and bytes(w.marks.astype(np.uint8)) == b" $,  $"
    assert all(len(x) == 0 for x in truncation.sketched_beginnings(w, lambda keys: np.ones(keys.shape, bool)))
    assert truncation.matched(*[strings(spark, ["two words", "one two three"], "tid bigint, value string")] * 2).count() == 0


def test_closing_marks():
    assert [endings.closed(t) for t in ("a.", "a!", "?", "!..", "a..", "a...", "a?.", ".", "", "a", "a.\n", 'a." ', "a…")] == [True] * 3 + [False] * 3 + [True] + [False] * 3 + [True, True, False]


def test_flagged(spark):
    texts = ["The baker opened the window in the garden.", "The baker opened the wind�", "The nurse painted the bicy-", None, "", "n/a", "[REWRITE ERROR: x]", "unknown", "The nurse painted the bicycle on the balcony before the rain came over the hills", "The nurse painted the bicycle on the balcony before the rain came over"]
    rows = spark.createDataFrame([("t", i, "d", t) for i, t in enumerate(texts)], "src_table string, row_id bigint, dataset string, value string")
    got = {r.row_id for r in truncation.found(rows).collect()}
    assert {1, 2, 9} <= got and not got & {0, 3, 4, 5, 6, 7}
    assert truncation.rates(rows).first().n == len(texts)
    assert truncation.found(rows.limit(0)).count() == 0


def test_whole_copy_need_not_be_the_longest(spark):
    whole = "the baker opened the window in the garden and the nurse laughed at the market because the old bus from the harbour came late again that day with nobody on board at all."
    short = whole[: whole.index(" on board")]
    others = [f"{whole[:-12]} {name} {i} and everybody went home by train to the north" for i, name in enumerate(["ann", "bob", "cleo", "dan"])]
    values = spark.createDataFrame([(1, short), (2, whole)] + [(i + 3, t) for i, t in enumerate(others)], "tid bigint, value string")
    assert {(r.tid, r.how) for r in truncation.matched(values.where("tid in (1, 2)"), values).collect()} == {(1, "before")}


def test_an_end_of_a_sentence_is_no_early_end(spark):
    short = "the joke relies on the idea that the beekeeper would never share an accordion with the neighbours"
    texts = [short, short + ". Everyone went home.", short + " and their dogs."]
    rows = spark.createDataFrame([("t", i, "d", t) for i, t in enumerate(texts)], "src_table string, row_id bigint, dataset string, value string")
    assert not truncation.found(rows).where("row_id = 0").count()
    assert truncation.found(rows.where("row_id <> 1")).where("row_id = 0").count() in (0, 1)  # left to the closing words


def test_same_template_is_no_copy(spark):
    texts = ["the image mocks all people who use a wheelchair every day by placing a shiny toothbrush inside the phone booth", "the image mocks all people who use a wheelchair every day by placing a wireless casserole inside the phone booth while nobody was looking"]
    values = spark.createDataFrame(list(enumerate(texts)), "tid bigint, value string")
    assert truncation.matched(values, values).count() == 0


def test_copies_make_no_limit_and_no_last_word(spark):
    copies = ["the baker opened the window and the zeppelin"] * 30
    other = [f"the nurse number {i} painted the bicycle." for i in range(20)]
    rows = strings(spark, copies + other + [None]).withColumn("source", F.lit("s"))
    assert truncation.limits(rows.where("text is not null"), "source", "text") == {}
    v, n = endings.vocabulary(rows, "text")
    assert n == 50 and "zeppelin" not in v.last and "opened" not in v.known and "nurse" in v.known
    few = strings(spark, [f"the tailor {'abcdefg'[i]} sold the old lamp" for i in range(2)]).withColumn("source", F.lit("s"))
    assert truncation.limits(few, "source", "text") == {}
    some = strings(spark, [f"the tailor {'abcdefg'[i]} sold the old lamp" for i in range(7)]).withColumn("source", F.lit("s"))
    assert len(truncation.limits(some, "source", "text")["s"]) == 1  # a small source has its limit, too
    many = strings(spark, [f"the tailor {'abcdefghijklmnopqrst'[i]} sold the old lamp" for i in range(20)]).withColumn("source", F.lit("s"))
    assert list(truncation.limits(many, "source", "text")["s"]) == [len("the tailor a sold the old lamp")]


# --- abuse


def distance(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_matches_brute_force():
    rng = random.Random(6)
    terms = ["idiot", "scum", "vermin", "moron", "garbagebag", "pig", "bootlicker"]
    lex = abuse.Lexicon.of(terms)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "i", "z"])
        w = "".join(w)
        if len(w) < 4:
            continue
        near = [t for t in terms if distance(w, t) <= (2 if len(t) >= abuse.LONG and t[0] == w[0] else 1) and (len(t) >= 4 or w == t)]
        got = lex.match(w)
        assert (got in near) if near else got is None, (w, got, near)


@pytest.mark.parametrize("text", ["you idiot", "you 1d10t", "you i d i o t", "you id​iot", "you іdіot", "you idiooooot", "you i-d-i-o-t", "you iidot", "you id**t", "YOU IDIOT"])
def test_disguises(text):
    r = abuse.Reader(frozenset(["you"]), abuse.Lexicon.of(["idiot"]))
    assert [i & 0xFFFFFFFF for i in r.ids(text)] == r.ids("you idiot")


def misspelt(rng, w, edits):
    for _ in range(edits):
        i = rng.randrange(1, len(w) - 1)
        w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeioustrn") + w[i:], w[:i] + rng.choice("aeioustrn") + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])
    return w


def test_stars_and_terms_of_several_words():
    lex = abuse.Lexicon.of(["rat", "slut", "bootlicker"])
    assert [lex.match(w) for w in ("r*t", "s**t", "s***", "b**tl*cker", "r**", "*")] == ["rat", "slut", None, "bootlicker", None, None]
    model = abuse.fit([], {"driven out": 1.0}, frozenset(["they", "must", "be", "driven", "out", "far"]))
    a, b, c = model.scores(["they must be driven out", "they must be drivn out", "driven far"], model.reader())
    assert a == b > c


def test_automaton_earns_its_place(spark, monkeypatch):
    """Abusive texts that were labelled, their terms misspelt by one edit or (long ones) two: found with the automaton, mostly lost without."""
    texts, labels, terms = abuse.inputs(spark, "/root/testdata/sf0.1")
    model = abuse.train(spark, texts.join(F.broadcast(labels.select("src_table", "row_id").distinct()), ["src_table", "row_id"]), labels, terms)
    rows = texts.join(F.broadcast(labels.where("abusive = 1").select("src_table", "row_id").distinct()), ["src_table", "row_id"]).orderBy("row_id").limit(1500).collect()
    rng = random.Random(17)
    on, off = {1: [], 2: []}, {1: [], 2: []}
    cases = {1: [], 2: []}
    for r in rows:
        for edits in (1, 2):
            w = r["value"].split()
            at = [i for i, x in enumerate(w) if x.lower() in model.terms and len(x) >= 5]
            if any(len(w[i]) >= (5 if edits == 1 else abuse.LONG) for i in at):
                cases[edits].append(" ".join(misspelt(rng, x, edits if len(x) >= abuse.LONG else 1) if i in at else x for i, x in enumerate(w)))
    for edits in (1, 2):
        on[edits] = model.scores(cases[edits], model.reader()) > 0
    monkeypatch.setattr(abuse.Lexicon, "match", lambda self, w: w if w in self.terms else None)
    for edits in (1, 2):
        off[edits] = model.scores(cases[edits], model.reader()) > 0
    print({e: (len(cases[e]), float(np.mean(on[e])), float(np.mean(off[e]))) for e in (1, 2)})
    assert len(cases[1]) > 200 and np.mean(on[1]) > 0.95 and np.mean(on[1]) > np.mean(off[1]) + 0.1
    assert len(cases[2]) > 20 and np.mean(on[2]) > np.mean(off[2]) + 0.1


def test_harmless_words_stay():
    r = abuse.Reader(frozenset(["hello", "crab", "pit"]), abuse.Lexicon.of(["hell", "crap", "pig"]))
    assert [r.plain(w) for w in ("hello", "crab", "pit", "@hell", "123")] == ["hello", "crab", "pit", "<ref>", "<num>"]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    texts, labels, terms = abuse.inputs(spark, d)
    even, odd = labels.where("row_id % 4 <> 0"), labels.where("row_id % 4 = 0")
    scored = abuse.scored(texts.join(F.broadcast(labels.select("src_table", "row_id").distinct()), ["src_table", "row_id"]), even, terms)
    r = scored.join(odd, ["src_table", "row_id"]).agg(F.avg((F.col("flag").cast("int") == F.col("abusive")).cast("int"))).first()[0]
    assert r > 0.95


def test_abuse_of_odd_tables(spark):
    texts = spark.createDataFrame([("t", 1, "d", None), ("t", 2, "d", ""), ("t", 3, "d", "you idiot"), ("t", 3, "d", "you idiot"), ("t", 4, "d", "word " * 20000)], "src_table string, row_id bigint, dataset string, value string")
    labels = spark.createDataFrame([], "src_table string, row_id bigint, abusive int, category string")
    terms = spark.createDataFrame([("idiot", "abuse", 0.9), ("Vermin ", "hate", None), (None, None, None)], "term string, category string, weight double")
    got = {(r.row_id, r.flag) for r in abuse.scored(texts, labels, terms).collect()}
    assert got == {(1, False), (2, False), (3, True), (4, False)}
    assert abuse.scored(texts.limit(0), labels, terms).count() == 0


def test_known_words_count_distinct_texts(spark):
    copies = ["She was nkaed nkaed nkaed at noon" + "!" * (i % 7) for i in range(30)] + ["SHE was nkaed, nkaed, nkaed at noon"]
    other = [f"the baker number {'abcdefghij'[i]} said hello hello" for i in range(6)]
    known = abuse.known_words(strings(spark, copies + other + [None, ""]), "text")
    assert {"baker", "hello"} <= known and not {"nkaed", "she", "noon"} & known


def test_words_near_terms_need_labels():
    known = frozenset(["nkaed", "hello", "there", "baker", "naked"])
    labelled = [(f"hello baker {i}", 0) for i in range(4)] + [("nkaed now", 1)] * 3
    assert abuse.trusted(known, labelled, ["naked", "hell", "these"]) == known - {"nkaed"}
    assert abuse.trusted(known, [], ["naked", "hell", "these"]) == known - {"nkaed", "hello"}
    model = abuse.fit(labelled, {"naked": 0.9}, abuse.trusted(known, labelled, ["naked"]))
    assert model.reader().plain("nkaed") == "naked"


# --- overlaps


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(8)
    for _ in range(2000):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        for k in range(4):
            assert overlap.distance_within(a, b, k) == (word_distance(a, b) <= k)


def test_distances_of_many_pairs():
    rng = random.Random(18)
    rows = [([rng.randrange(4) for _ in range(rng.randint(0, 14))], [rng.randrange(4) for _ in range(rng.randint(0, 14))], rng.randint(0, 4)) for _ in range(3000)]
    rows += [(a, a, 0) for a, _, _ in rows[:50]] + [([], [], 0), ([1], [], 1), ([], [1], 1), ([], [1], 0)]

    def flat(lists):
        n = np.array([len(x) for x in lists], np.int64)
        return np.array([i for x in lists for i in x], np.uint64), np.cumsum(n) - n, n

    got = overlap.distances_within(flat([r[0] for r in rows]), flat([r[1] for r in rows]), np.array([r[2] for r in rows]), block=100)
    assert list(got) == [word_distance(a, b) <= k for a, b, k in rows]
    assert len(overlap.distances_within(flat([]), flat([]), np.zeros(0, np.int64))) == 0


def test_filter(spark, monkeypatch):
    from millrace.llm import bitfilter

    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key bigint")
    bits, size = bitfilter.of_column(df)
    assert bitfilter.passes(bits, size, keys.view(np.uint64)).all()
    other = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 20_000).view(np.uint64)
    assert bitfilter.passes(bits, size, other).mean() < 0.002
    assert bitfilter.blocks_for(0) == bitfilter.blocks_for(1000) == 1 and bitfilter.blocks_for(10**9) == 60
    assert bitfilter.size_for(10**12) == bitfilter.MOST_BITS
    got = df.select(overlap._unsigned_mod(F.col("key"), 7)).toPandas().iloc[:, 0]
    assert sorted(got) == sorted(int(k) % 7 for k in keys.view(np.uint64))


def pair_texts(rng, n):
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "and", "of"] * 8
    train = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 30))] for _ in range(n)]
    evals = [list(rng.choice(train)) for _ in range(n)]
    for t in evals:
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randint(0, 1)] = rng.choice([[], [rng.choice(vocabulary)]])
    return [" ".join(t) for t in train], [" ".join(t) for t in evals]


def test_filter_looks_no_further_than_needed(spark, monkeypatch):
    from millrace.llm import bitfilter

    keys = np.random.default_rng(8).integers(-(2**63), 2**63, 30_000)
    bits, size = bitfilter.of_column(spark.createDataFrame([(int(k),) for k in keys[:10_000]], "key bigint"))
    seen = []
    monkeypatch.setattr(bitfilter, "_SLOTS", tuple(lambda k, f=f: seen.append(len(k)) or f(k) for f in bitfilter._SLOTS))
    on = bitfilter.passes(bits, size, keys.view(np.uint64).reshape(100, 300))
    assert on.shape == (100, 300) and on.ravel()[:10_000].all() and on.ravel()[10_000:].mean() < 0.002
    assert seen[0] == 30_000 and seen[1] < 12_000 and seen[2] < 11_000
    assert not len(bitfilter.passes(bits, size, np.zeros(0, np.uint64)))


def test_rows_are_prepared_once(spark):
    a = spark.createDataFrame([(1, "the baker opened a window", "./a.jpg"), (2, None, "a.jpg"), (3, "too short", " "), (4, "", None)], "row_id bigint, text string, image_path string")
    m = overlap.matches(a, a)
    for x in (m.train, m.evals, m.train_files, m.eval_files):
        assert "regexp" not in x._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.id for r in m.train.collect()] == [1]
    assert sorted(m.train_files.collect()) == [(1, "a.jpg", True), (2, "a.jpg", False)]


def test_plain_letters_are_never_ignored(spark):
    chars = [chr(i) for i in range(0x500) if chr(i) not in "ßς"]
    got = [r[0] for r in strings(spark, chars).orderBy("row_id").select(canon.bare(F.col("text"))).collect()]
    for c, x in zip(chars, got):
        if (k := unicodedata.category(c)) in {"Cc", "Cf", "Sm", "Sk", "Sc"} or k[0] in "PZ":
            assert x == "", c
        elif k[0] in "LN":
            assert x, c


def test_blocks_and_counts_give_the_same(spark, monkeypatch):
    from millrace.llm import bitfilter

    train, evals = pair_texts(random.Random(19), 60)
    kind = "row_id bigint, text string, image_path string, split string, dataset string"
    a = spark.createDataFrame([(i, t if i % 9 else None, f"p/{i % 12}", "train", "d") for i, t in enumerate(train)], kind)
    b = spark.createDataFrame([(1000 + i, t if i % 7 else "", f"p/./{i % 12}", "val", "D ") for i, t in enumerate(evals)], kind)
    pairs = overlap.overlaps(a, b).collect()
    count = {}
    for r in pairs:
        count[r.eval_row, r.kind] = count.get((r.eval_row, r.kind), 0) + 1
    assert {(r.eval_row, r.kind): r.pairs for r in overlap.counted(a, b).collect()} == count
    total = overlap.report(a, b).first()
    assert (total.n, total.pairs, total.overlapping) == (60, len(pairs), len({r.eval_row for r in pairs}))
    monkeypatch.setattr(bitfilter, "blocks_for", lambda keys: 3)
    assert {(r.train_row, r.eval_row) for r in overlap.overlaps(a, b).collect()} == {(r.train_row, r.eval_row) for r in pairs}


def test_segments_are_enough():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 60, 300)
    n[:3] = (0, 1, 400)
    ids = rng.integers(0, 50, n.sum()).astype(np.int64).view(np.uint64)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    for tells in (np.zeros(len(ids)), rng.random(len(ids)) * 9, np.where(rng.random(len(ids)) < 0.05, 9.0, 0.0)):
        seg = overlap.segments(ids, first, n, tells)
        for i in range(len(n)):
            s = seg[first[i] : first[i] + n[i]]
            if n[i]:
                assert (np.diff(s) >= 0).all() and len(set(s)) == overlap.edits_allowed(n[i]) + 1
                assert np.bincount(s).max() <= overlap.LONGEST


def test_overlaps_match_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "and", "of"] * 8

    def make():
        return [rng.choice(vocabulary) for _ in range(rng.randint(4, 30))]

    def edit(t):
        t = list(t)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randint(0, 1)] = rng.choice([[], [rng.choice(vocabulary)]])
        return t

    train = [make() for _ in range(150)]
    evals = [edit(rng.choice(train)) for _ in range(150)]
    kind = "row_id bigint, text string, image_path string, class int, ids int"
    a = spark.createDataFrame([(i, " ".join(t), f"p/{i}", 0, 0) for i, t in enumerate(train)], kind)
    b = spark.createDataFrame([(1000 + i, " ".join(t), f"q/{i}", 0, 0) for i, t in enumerate(evals)], kind)
    want = set()
    for i, x in enumerate(train):
        for j, y in enumerate(evals):
            if len("".join(x)) >= 12 and len("".join(y)) >= 12 and ("".join(x) == "".join(y) or word_distance(y, x) <= len(y) // overlap.WORDS_PER_EDIT):
                want.add((i, 1000 + j))
    got = [(r.train_row, r.eval_row) for r in overlap.overlaps(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pictures_and_odd_rows(spark):
    kind = "row_id bigint, text string, image_path string"
    a = spark.createDataFrame([(1, None, "d/./x.jpg"), (2, "a caption with enough letters", "d/x.jpg"), (3, "short", None), (4, "other caption with many letters", "d\\y.jpg")], kind)
    b = spark.createDataFrame([(11, "", "./d/x.jpg"), (12, "yet another caption of this picture", "d/x.jpg"), (13, None, ""), (14, "OTHER caption, with many letters!", "z"), (15, None, "d/y.jpg")], kind)
    got = {(r.train_row, r.eval_row, r.kind) for r in overlap.overlaps(a, b).collect()}
    assert got == {(1, 11, "picture"), (2, 11, "picture"), (1, 12, "picture"), (4, 14, "same"), (4, 15, "picture")}
    assert overlap.overlaps(a.limit(0), b).count() == 0 and overlap.overlaps(a, b.limit(0)).count() == 0


# --- stuffing


PROSE = "The baker opened the window in the garden and the nurse laughed because it was late. "
SPAM = [
    "cheap shoes, buy shoes, shoes sale, shoes online, best shoes, shoes price, cheap shoes, shoes deal, buy shoes, shoes discount",
    "http://a.example/x http://b.example/y www.c.example/z http://d.example/q http://e.example/1 http://f.example/2 http://g.example/3 http://h.example/4",
    " ".join(f"#tag{i % 7}" for i in range(40)),
    " | ".join(f"SKU-{i} red chair, chair price {i}.99" for i in range(20)),
]
FINE = [None, "", " ", PROSE, PROSE * 400, PROSE + "#one #two http://x.example/", "What to bring:\n" + "\n".join(f"- item{c} (kind{c})" for c in "abcdefghijklmnop"), "word", "😂" * 500, (PROSE + "We all sing the song again. ") * 6]


def test_stuffing(spark):
    seven = " ".join(f"http://site{c}.example/p" for c in "abcdefg")
    rows = strings(spark, SPAM + FINE + SPAM[:1] + [seven], "doc_id bigint, text string").withColumn("spam", F.lit("x")).withColumn("listed", F.lit(1))
    n = len(SPAM + FINE)
    assert {r.doc_id for r in stuffing.found(rows).collect()} == {0, 1, 2, 3, n, n + 1}
    assert stuffing.scored(rows).count() == n + 2
    assert stuffing.found(rows.limit(0)).count() == 0


KEYS = "chair lamp table spoon fork knife plate glass bowl cup shelf sofa stool bench clock mirror rug vase bucket ladder hammer saw drill tape".split()
#: For each measure a document that it alone can tell to be spam.
ONLY = {
    "top": PROSE * 2 + "A chair is a chair and the chair of my chair was the chair that we had when a chair was there.",
    "top3": "chair aa bb lamp cc dd table ee ff chair gg hh lamp ii jj table kk ll chair mm nn lamp oo pp table qq",
    "pairs": " ".join(f"{a} {b}" for _ in range(4) for a, b in zip(KEYS[:20:2], KEYS[1:20:2], strict=True)),
    "lines": "\n".join(" ".join(KEYS[(i * 7 + j * 5) % 24] for j in range(3)) for i in [*range(8)] * 3),
    "separators": ", ".join(KEYS * 3),
    "links": SPAM[1],
    "tags": SPAM[2],
}


@pytest.mark.parametrize("name", sorted(ONLY))
def test_each_measure_decides(name):
    off = dict.fromkeys(stuffing.LIMITS, 9.0) | {"function": 0.42, "missing": 0.07}
    limit = stuffing.limits_of(dict.fromkeys(stuffing.LIMITS, 0.0), 0.42)[name]
    assert stuffing.signals(ONLY[name], {"": off | {name: limit}})["spam"]
    assert not stuffing.signals(ONLY[name], {"": off})["spam"]
    assert not any(stuffing.signals(t or "", {"": off | {name: limit}})["spam"] for t in FINE)


def test_limits_follow_the_language(spark):
    de = "Der Nachbar und die Lehrerin sind in der Schule und trinken einen Kaffee, weil es auf dem Hof so kalt ist und der Regen nicht mehr aufhört zu fallen. "
    rows = strings(spark, [PROSE * 3] * 300 + [(de + "- ja; ja, nein; / so, ja; ") * 2] * 300, "doc_id bigint, text string")
    norms = stuffing.calibrate(rows)
    assert set(norms) == {"", "en", "de"}
    assert norms["de"]["separators"] > norms["en"]["separators"] and norms["de"]["function"] != norms["en"]["function"]
    assert stuffing.calibrate(rows.limit(0)).keys() == {""}


def test_found_decides_as_scores():
    prose = [w for w in (PROSE * 10).replace(".", "").split() if w.isalpha()][:90]
    linked = " ".join(w + (" http://" + "x" * 58 + f".example/{i % 10}" if i % 9 == 8 else "") for i, w in enumerate(prose))
    deciles = {"top": 0.05, "top3": 0.1, "pairs": 0.2, "lines": 0.1, "separators": 0.12, "links": 0.0, "tags": 0.0}
    norms = {"en": stuffing.limits_of(deciles, 0.4), "": stuffing.limits_of(deciles, 0.4)}
    assert stuffing.signals(linked, norms)["spam"]
    rng = random.Random(12)
    pieces = [*SPAM, PROSE, linked, "free shop order ", "a1 b2 12 12 12 7 ", "#tag @me ", "keyword " * 5, *ONLY.values()]
    for _ in range(600):
        t = " ".join(rng.choice(pieces)[: rng.randint(5, 400)] for _ in range(rng.randint(1, 6)))
        assert stuffing.signals(t, norms)["spam"] == stuffing.signals(t, norms, full=False)["spam"]
    assert stuffing.signals(linked, norms, full=False)["spam"]
