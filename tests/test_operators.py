"""Boundary rows of each rule and operator."""

import json
import os
import random
import subprocess
import sys
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from millrace.functions import keys as K
from millrace.functions import model_json
from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.functions.similarity import char_similarity, rouge_l
from millrace.operators import dedupe, joins, metrics, plugins, rank, splits
from millrace.operators import rules as R
from millrace import session
from millrace.sources import readers, sinks


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_sanitize(spark):
    cases = {
        'Rewrite: "Hi   there !!!!"': "Hi there!",
        "x [/INST] Output: yes": "yes",
        "```json\nline one\nline two\n```": "line one line two",
        "see http://a.org/b now @bob #tag": "see now",
        "": "",
        None: "",
        "    ": "",
        "a • b�c": "a b c",
    }
    assert column(spark, list(cases), T.sanitize) == list(cases.values())


def test_compare_and_change(spark):
    df = spark.createDataFrame([("a a b", "a c"), ("", ""), ("a", ""), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(T.token_change("a", "b")).collect()]
    assert got == pytest.approx([1 - 1 / 3, 0.0, 1.0, 0.0])
    assert column(spark, ["Hello  WORLD!", None], T.compare_form) == ["hello world", ""]


def test_collapsed(spark):
    assert column(spark, ["", "x", "aaaa", "a b", "go go go go go go", None], T.collapsed) == [True, True, True, False, True, True]


def test_target_group(spark):
    cases = {"Race/Ethnicity": "race_ethnicity", "human": "gender", "mental illness": "gender", "N/A": None, "xyz": None, "sexual-orientation": "sexual_orientation", None: None}
    assert column(spark, list(cases), T.target_group) == list(cases.values())


FORMAT = {
    "": "empty", "see www.a.org now": "url", "@bob hi": "mention", "#tag hi": "hashtag", "one": "too_short", "http://a.org @b": "url",
    "a a a a a a a b": "low_diversity", "a a a a b c d e": "repetition", "!? !? ok": "symbol_heavy", "hello world": "no_edit",
    "ab " * 93 + "x": "low_diversity", None: "empty", "fine and good": None,
}


def test_format_rules(spark):
    df = spark.createDataFrame([(i, v, "Hello  WORLD!") for i, v in enumerate(FORMAT)], "i int, v string, o string")
    got = [r[0] for r in df.select("i", R.reason(R.format_rules(R.format_parts(F.col("v"), F.col("o")))).alias("r")).orderBy("i").select("r").collect()]
    assert got == list(FORMAT.values())
    words = " ".join(f"w{i}" for i in range(80))
    long = [words[:280].strip(), words[:281] + "x"]
    df = spark.createDataFrame([(v, "o") for v in long], "v string, o string")
    assert [r[0] for r in df.select(R.reason(R.format_rules(R.format_parts(F.col("v"), F.col("o"))))).collect()] == [None, "too_long"]


def test_training_filter(spark):
    df = spark.createDataFrame([(True, None), (False, None), (None, float("nan")), (False, 0.0), (False, 1e-9)], "e boolean, d double")
    got = [r[0] for r in df.select(R.reason(R.training_filter(F.col("e"), F.col("d")))).collect()]
    assert got == ["parse_error", "missing_toxicity_drop", "missing_toxicity_drop", "non_positive_drop", None]


def test_gate_boundaries(spark):
    g = R.Gate(sta=0.5, similar=0.2, drop=0.1, source=0.3)
    rows = [(0.5, 0.5, 0.1, 0.3), (0.51, 0.2, 0.1, 0.3), (0.51, 0.5, 0.1, 0.3), (0.51, 0.5, 0.0, 0.29), (0.51, 1.0, 0.0, 0.3)]
    df = spark.createDataFrame(rows, "s double, b double, d double, o double")
    a = (F.col("s"), F.col("b"), F.col("d"), F.col("o"))
    assert [r[0] for r in df.select(R.reject_rewrites(g, *a)).collect()] == ["low_sta", "low_bertscore", None, None, "low_toxicity_drop"]
    assert [r[0] for r in df.select(R.reject_combined(g, *a)).collect()] == ["low_sta", "low_bertscore", None, None, "high_bertscore"]
    with pytest.raises(ValueError):
        R.Gate(sta=1.5)
    with pytest.raises(ValueError):
        R.Gate(similar=0.9, most_similar=0.8)


def test_length_bucket(spark):
    df = spark.createDataFrame([(9,), (10,), (300,), (301,), (None,)], "n int")
    assert [r[0] for r in df.select(R.length_bucket(F.col("n"))).collect()] == ["low", None, None, "high", None]


def test_paths_and_keys(spark):
    import os

    paths = ["a/./b", "a//b/../c", "../x", "a/../../x", "/a/../../b", "", None, "a\\b", "./a", "/"]
    got = column(spark, paths, K.normal_path)
    assert got == [os.path.normpath((p or "").replace("\\", "/")) for p in paths]
    rows = spark.createDataFrame([("1", "x/y", "t"), (None, "x/./y", " t  u ")], "i string, p string, t string")
    assert [r[0] for r in rows.select(K.rewrite_key(F.col("i"), F.col("p"), F.col("t"))).collect()] == ["id::1", "imgtxt::x/y::t u"]


def test_md5_shard(spark):
    import hashlib

    keys = ["a", "", "ü", "k" * 100]
    for n in (7, 8, 13):
        assert column(spark, keys, lambda c, n=n: K.md5_shard(c, n)) == [int(hashlib.md5(k.encode()).hexdigest(), 16) % n for k in keys]


@pytest.mark.parametrize("n,sizes", [(1, (0, 0, 1)), (2, (0, 1, 1)), (5, (3, 1, 1)), (15, (12, 2, 1)), (25, (21, 2, 2)), (35, (28, 4, 3))])
def test_stratified_sizes(spark, n, sizes):
    df = spark.range(n).withColumn("s", F.lit(None).cast("string"))
    got = {r["split"]: r["count"] for r in splits.stratified(df, ["s"], "id").groupBy("split").count().collect()}
    assert tuple(got.get(x, 0) for x in ("train", "val", "test")) == sizes


def test_two_way_and_samples(spark):
    for n in (0, 1, 10, 999):
        got = splits.two_way(spark.range(n), "id").groupBy("split").count().collect()
        assert sum(r["count"] for r in got) == n
        assert {r["split"]: r["count"] for r in got}.get("train", 0) == int(n * 0.9)
    df = spark.range(100).withColumn("c", F.col("id") % 3)
    assert splits.per_class(df, ["c"], "id", 5).groupBy("c").count().where("count = 5").count() == 3


def test_first_wins_plan_and_rows(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 0, 9), ("b", 3, 1), (None, 1, 1)], "k string, f int, l int")
    got = dedupe.first_wins(df, F.col("k"), "f", "l")
    assert {(r.k, r.f) for r in got.collect()} == {("a", 0), ("b", 3), (None, 1)}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_two_level_lookup(spark):
    src = spark.createDataFrame([("d1", "1", 1, "x"), ("d1", "1", 2, "y"), ("d2", "1", 3, "z")], "ds string, id string, row int, v string")
    rows = spark.createDataFrame([("d1", "1"), ("d3", "1"), ("d1", "9")], "ds string, id string")
    got = {(r.ds, r.id): r.v for r in joins.two_level(rows, src, "ds", "id", ["row"], "v").collect()}
    assert got == {("d1", "1"): "y", ("d3", "1"): "x", ("d1", "9"): ""}
    assert joins.two_level(rows, src, "ds", "id", ["row"], "v", None).count() == 2


def test_pending_keeps_null_keys(spark):
    a = spark.createDataFrame([("1",), (None,), ("2",)], "id string")
    b = spark.createDataFrame([("1",), (None,)], "id string")
    assert {r.id for r in joins.pending(a, b, "id").collect()} == {None, "2"}


def test_votes(spark):
    rows = spark.createDataFrame([([0, 1, 2],), ([0, 0, 3],), ([1, 2, 2],), ([],)], "v array<int>")
    assert [tuple(r) for r in rows.select(metrics.majority(F.col("v")), metrics.mode(F.col("v"))).collect()] == [(True, 0), (False, 0), (True, 2), (False, None)]


def test_dominant(spark):
    df = spark.createDataFrame([("a", "url"), ("a", "empty"), ("b", " "), ("b", None)], "k string, r string")
    assert {x.k: x.r for x in metrics.dominant(df, "k", "r", "none").collect()} == {"a": "url", "b": "none"}


def test_moving_average(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(8)] + [("b", 0, 1.0), ("b", 1, 3.0)], "s string, t int, v double")
    got = sorted(tuple(r) for r in metrics.moving_average(df, ["s"], "t", "v").collect())
    assert got == [("a", i, pytest.approx(i - 2.0)) for i in range(4, 8)] + [("b", 0, 1.0), ("b", 1, 3.0)]


def test_retries_shrink(spark):
    seen = []

    def generate(rows, attempt):
        seen.append(rows.count())
        return rows.withColumn("ok", F.col("id") % 2 == 0)

    assert rank.with_retries(spark.range(10), "id", generate, F.col("ok"), 2).count() == 15
    assert seen == [10, 5]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0, 0.0], [0.2, 0.8])], "a array<double>, z array<double>, p array<double>")
    r = df.select(V.argmax(F.col("a")), V.cosine01(F.col("a"), F.col("z")), V.cosine01(F.col("a"), F.col("a")), V.probability(F.col("p"), F.lit(5)), F.size(V.padded(F.col("a"), 5))).first()
    assert (r[0], r[1], r[4]) == (2, None, 5)
    assert r[2] == pytest.approx(1.0)
    assert r[3] == pytest.approx(0.8)


def test_similarities_match_brute_force(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("ab c", k=rng.randint(0, 30))), "".join(rng.choices("ab c", k=rng.randint(0, 30)))) for _ in range(60)] + [(None, "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", char_similarity("a", "b").alias("c"), rouge_l("a", "b").alias("l")).orderBy("i").collect()
    for (a, b), r in zip(pairs, got, strict=True):
        assert r.c == pytest.approx(SequenceMatcher(None, a or "", b or "").ratio())
        x, y = (a or "").split(), (b or "").split()
        parts = [[w for j, w in enumerate(x[:10]) if m >> j & 1] for m in range(1 << min(len(x), 10))]
        best = max(len(c) for c in parts if is_subsequence(c, y))
        if len(x) <= 10:
            assert r.l == pytest.approx(2 * best / (len(x) + len(y)) if best else 0.0)


def is_subsequence(a, b):
    it = iter(b)
    return all(x in it for x in a)


def test_model_json():
    good = json.dumps({"target_group": "gender", "visual_evidence": None, "implicit_meaning": "a } b"})
    assert model_json.parse("```json\n{\"target_group\": \"x\"}\n```")["target_group"] == "x"
    assert model_json.parse("{bad} text {\"implicit_meaning\": \"m\"}")["implicit_meaning"] == "m"
    assert model_json.parse(good.replace(" } ", " "))["parse_error"] is False
    for bad in (None, "", "no braces", "[1, 2]", "{torn"):
        assert model_json.parse(bad)["parse_error"] is True


def test_jsonl_states(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"x": 1}\n[1]\n\n7\n{"x": \n{"x": 2}')
    lines = readers.numbered_lines(spark, str(tmp_path), "*.txt")
    states = [r.state for r in readers.permissive(lines, "x int").orderBy("line").collect()]
    assert states == ["object", "invalid", "blank", "invalid", "invalid", "object"]
    assert [r.record.x for r in readers.until_bad(lines, "x int").collect()] == [1]


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image_path,dataset,original_label,ocr_text,ocr_char_count,clip_meme_score,clip_screenshot_score,clip_best_negative,clip_threshold_used,kept\na,d,l,\"x\ny\",1,0.5,0.5,,, TRUE\nb,d,l,NA,1,0.5,0.5,,,no\n")
    rows = readers.manifest(spark, str(tmp_path / "m.csv")).orderBy("image_path").collect()
    assert [(r.ocr_text, r.kept) for r in rows] == [("x\ny", True), ("NA", False)]
    assert readers.manifest(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "t.tsv").write_text('File Name\tmisogynous\n"a\t1\nb\t0\n')
    t = readers.sniffed(spark, str(tmp_path / "t.tsv"))
    assert t.columns == ["file_name", "misogynous"] and readers.fuzzy(t, "misogyn") == "misogynous"
    assert [r[0] for r in t.orderBy("misogynous").collect()] == ["b", '"a']
    assert readers.annotation_file(["b.csv", "a_train.csv", "c.txt"]) == "a_train.csv"
    assert readers.annotation_file(["x.txt"]) is None
    assert readers.first_existing(spark, [str(tmp_path / "q"), str(tmp_path / "t.tsv")]).endswith("t.tsv")


def test_directory_scan_keeps_every_group(spark, tmp_path):
    from millrace.plans import catalogue

    names = [*(f"name {i}" for i in range(12)), "name-1", "NAME 1", " a/b\t", "", None]
    rows = [(n,) for i, n in enumerate(names) for _ in range(i + 1)]
    spark.createDataFrame(rows, "dataset string").write.parquet(f"{tmp_path}/unified_train.parquet")
    got = {r.dataset: r.n for r in catalogue.queries()["json_directory_scan"](spark, str(tmp_path)).collect()}
    assert got == {n: i + 1 for i, n in enumerate(names)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    sinks.jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":null}'
    assert df.select(sinks.fixed_width((F.col("a"), 3), (F.col("b"), 5))).first()[0] == "1  N/A  "


def test_scorer_falls_back_to_rows(spark):
    class Fragile:
        def score(self, rows):
            if len(rows) > 1 or rows["t"].iloc[0] == "bad":
                raise RuntimeError
            return [1.0]

    df = spark.createDataFrame([("ok",), ("bad",)], "t string").coalesce(1)
    assert {r.t: r.s for r in plugins.scored(df, Fragile, "s").collect()} == {"ok": 1.0, "bad": None}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, text string, c int")
    assert splits.stratified(empty, ["c"], "id").count() == 0
    assert dedupe.first_wins(empty, F.col("id"), "c").count() == 0
    assert empty.select(T.sanitize("text")).count() == 0


def test_no_row_at_a_time_python(spark, data):
    from millrace.plans import catalogue

    for name in ("stage_build_counts", "sanitize_text", "best_candidate", "quality_gate"):
        plan = catalogue.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan


def test_scan_is_pruned(spark, data):
    from millrace.plans import catalogue

    plan = catalogue.queries()["hateful_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<row_id:bigint,is_hateful:boolean>" in plan
    assert "EqualTo(is_hateful" in plan or "is_hateful" in plan.split("PushedFilters")[1][:80]


# --- session


class _Remote:
    def __init__(self, master, named=None):
        self.sparkContext = type("C", (), {"master": master})()
        self.conf = type("K", (), {"get": lambda *_: named})()


def test_a_cluster_must_name_a_shared_folder():
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_folder(_Remote(master))
        assert session.shared_folder(_Remote(master, "hdfs://h/x/")) == "hdfs://h/x"
    assert session.shared_folder(_Remote("local[4]"))


def test_stored_tables_are_deleted(spark):
    a, b = (session.stored(spark.range(n)) for n in (5, 7))
    for t in (a, b):
        assert readers._exists(spark, t._stored_at)
    session.dropped(a, spark.range(1))
    assert not readers._exists(spark, a._stored_at) and b.count() == 7
    session.release()
    assert not readers._exists(spark, b._stored_at)


def test_broadcasts_go_by_bytes(spark):
    wide = spark.range(100).select("id", F.array_repeat(F.col("id"), 1000).alias("a"), F.repeat(F.lit("x"), 500).alias("s"))

    def marked(df, most):
        return "broadcast" in session.few_or_not(df, most)._jdf.queryExecution().logical().toString()

    assert marked(wide, 100 * 10_000) and not marked(wide, 100 * 8_000)
    assert marked(spark.createDataFrame([], "a array<string>, b struct<c: int, d: string>"), 1)


def test_core_needs_no_llm_library():
    code = """
import builtins, sys
real = builtins.__import__
def gone(name, *a, **k):
    if name.split(".")[0] in ("zstandard", "tiktoken"):
        raise ModuleNotFoundError(name, name=name)
    return real(name, *a, **k)
builtins.__import__ = gone
import __spark_entry__ as e
from millrace.plans import catalogue
assert set(catalogue.queries()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)
