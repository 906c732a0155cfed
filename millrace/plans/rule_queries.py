"""Queries of filters, gates, projections and prompt building."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import metrics as M
from millrace.operators import rules as R
from millrace.plans import dialect as D
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources.annotations import HARMLESS, first_label

P, E, U, TR = "train_pseudo_rewrites_merged", "train_explanations_merged", "unified_train", "train"

_REASONED = f"""SELECT row_id, CASE WHEN coalesce(explanation.parse_error, false) THEN 'parse_error' WHEN toxicity_drop IS NULL OR isnan(toxicity_drop) THEN 'missing_toxicity_drop'
    WHEN toxicity_drop <= 0 THEN 'non_positive_drop' END AS reason FROM {P}"""


def _reasoned(spark, d):
    return table(spark, d, P).select("row_id", R.reason(R.training_filter(F.col("explanation.parse_error"), F.col("toxicity_drop"))).alias("reason"))


@query("reasoned_filter", _REASONED)
def _(spark, d):
    return _reasoned(spark, d)


@query("reason_histogram", f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ({_REASONED}) GROUP BY 1")
def _(spark, d):
    return M.distribution(_reasoned(spark, d), F.coalesce("reason", F.lit("kept")), "reason")


@query("funnel_counts", f"""SELECT count(*) AS loaded, count(*) FILTER (reason = 'parse_error') AS parse_error, count(*) FILTER (reason = 'missing_toxicity_drop') AS missing,
    count(*) FILTER (reason = 'non_positive_drop') AS non_positive, count(*) FILTER (reason IS NULL) AS kept FROM ({_REASONED})""")
def _(spark, d):
    r = F.col("reason")
    return _reasoned(spark, d).agg(
        F.count("*").alias("loaded"), F.count_if(r == "parse_error").alias("parse_error"), F.count_if(r == "missing_toxicity_drop").alias("missing"),
        F.count_if(r == "non_positive_drop").alias("non_positive"), F.count_if(r.isNull()).alias("kept"),
    )


@query("length_range_filter", f"SELECT row_id FROM {U} WHERE length(text) BETWEEN 10 AND 300")
def _(spark, d):
    return table(spark, d, U).where(F.length("text").between(10, 300)).select("row_id")


@query("length_bucket", f"SELECT row_id, CASE WHEN length(text) < 10 THEN 'low' WHEN length(text) > 300 THEN 'high' END AS bucket FROM {U}")
def _(spark, d):
    return table(spark, d, U).select("row_id", R.length_bucket(F.length("text")).alias("bucket"))


@query("pass_rate", f"SELECT dataset, count(*) AS n, count(*) FILTER (passed_stage1_filters) AS passed, round(count(*) FILTER (passed_stage1_filters)::DOUBLE / greatest(count(*), 1), 6) AS rate FROM {P} GROUP BY 1")
def _(spark, d):
    passed = F.count_if("passed_stage1_filters")
    return table(spark, d, P).groupBy("dataset").agg(F.count("*").alias("n"), passed.alias("passed"), F.round(M.rate(passed, F.count("*")), 6).alias("rate"))


@query("kept_filter", f"SELECT row_id FROM {P} WHERE format_valid = true")
def _(spark, d):
    df = table(spark, d, P)
    return (df.where("format_valid = true") if "format_valid" in df.columns else df).select("row_id")


@query("hateful_filter", f"SELECT row_id FROM {E} WHERE is_hateful")
def _(spark, d):
    return table(spark, d, E).where("is_hateful").select("row_id")


_SIM = "CASE WHEN isnan(bertscore) THEN NULL ELSE bertscore END"


def _gate_sql(g: R.Gate) -> str:
    high = "" if g.most_similar >= 1 else f" AND sim < {g.most_similar}::DOUBLE"
    return f"""SELECT *, coalesce(sta > {g.sta}::DOUBLE, false) AS p1, coalesce(sim > {g.similar}::DOUBLE{high}, false) AS p2,
        coalesce(dr >= CASE WHEN o >= {g.source}::DOUBLE THEN {g.drop}::DOUBLE ELSE 0::DOUBLE END, false) AS p3
      FROM (SELECT row_id, format_valid, sta_score AS sta, {_SIM} AS sim, toxicity_drop AS dr, original_toxicity AS o FROM {P})"""


def _scores(spark, d):
    sim = F.when(~F.isnan("bertscore"), F.col("bertscore"))
    return table(spark, d, P).select("row_id", "format_valid", F.col("sta_score").alias("sta"), sim.alias("sim"), F.col("toxicity_drop").alias("dr"), F.col("original_toxicity").alias("o"))


def _args():
    return F.col("sta"), F.col("sim"), F.col("dr"), F.col("o")


@query("quality_gate", f"SELECT row_id, p1 AS passes_sta, p2 AS passes_bertscore, p3 AS passes_toxicity_delta FROM ({_gate_sql(R.REWRITES_ONLY)})")
def _(spark, d):
    return _scores(spark, d).select("row_id", *[c.alias(n) for n, c in R.gate(R.REWRITES_ONLY, *_args()).items()])


_BOUNDED = R.Gate(sta=0.3, similar=0.2, most_similar=0.9, drop=0.02)


@query("quality_gate_bounded", f"SELECT row_id, p1 AS passes_sta, p2 AS passes_bertscore, p3 AS passes_toxicity_delta FROM ({_gate_sql(_BOUNDED)})")
def _(spark, d):
    return _scores(spark, d).select("row_id", *[c.alias(n) for n, c in R.gate(_BOUNDED, *_args()).items()])


@query("reject_reason_a", f"""SELECT row_id, CASE WHEN p1 AND p2 AND p3 THEN NULL WHEN NOT p1 THEN 'low_sta' WHEN coalesce(sim <= {R.COMBINED.similar}::DOUBLE, true) THEN 'low_bertscore'
    WHEN sim >= {R.COMBINED.most_similar}::DOUBLE THEN 'high_bertscore' ELSE 'low_toxicity_drop' END AS reason FROM ({_gate_sql(R.COMBINED)})""")
def _(spark, d):
    return _scores(spark, d).select("row_id", R.reject_combined(R.COMBINED, *_args()).alias("reason"))


@query("reject_reason_b", f"""SELECT row_id, CASE WHEN NOT p1 THEN 'low_sta' WHEN NOT p3 THEN 'low_toxicity_drop' WHEN NOT p2 THEN CASE WHEN coalesce(sim >= {_BOUNDED.most_similar}::DOUBLE, false) THEN 'high_bertscore' ELSE 'low_bertscore' END END AS reason
    FROM ({_gate_sql(_BOUNDED)})""")
def _(spark, d):
    return _scores(spark, d).select("row_id", R.reject_rewrites(_BOUNDED, *_args()).alias("reason"))


@query("format_gates_scores", f"SELECT row_id, coalesce(format_valid, false) AND p1 AND p2 AND p3 AS passed FROM ({_gate_sql(R.REWRITES_ONLY)})")
def _(spark, d):
    p = R.gate(R.REWRITES_ONLY, *_args())
    return _scores(spark, d).select("row_id", (F.coalesce("format_valid", F.lit(False)) & p["passes_sta"] & p["passes_bertscore"] & p["passes_toxicity_delta"]).alias("passed"))


@query("similarity_filter", f"SELECT row_id FROM {P} WHERE bertscore >= 0.5::DOUBLE AND NOT isnan(bertscore)")
def _(spark, d):
    return table(spark, d, P).where("bertscore >= 0.5 and not isnan(bertscore)").select("row_id")


@query("score_arithmetic", f"SELECT row_id, round(1 - rewrite_toxicity, 6) AS sta, round(original_toxicity - rewrite_toxicity, 6) AS drop_ FROM {P}")
def _(spark, d):
    return table(spark, d, P).select("row_id", F.round(1 - F.col("rewrite_toxicity"), 6).alias("sta"), F.round(F.col("original_toxicity") - F.col("rewrite_toxicity"), 6).alias("drop_"))


@query("safe_float", f"SELECT row_id, round(coalesce(TRY_CAST(regexp_extract(text, '[0-9]+[.]?[0-9]*') AS DOUBLE), -1.0::DOUBLE), 6) AS number FROM {U}")
def _(spark, d):
    return table(spark, d, U).select("row_id", F.round(F.coalesce(F.regexp_extract("text", "[0-9]+[.]?[0-9]*", 0).try_cast("double"), F.lit(-1.0)), 6).alias("number"))


@query("rounding", f"SELECT row_id, round_even(sta_score * 10, 0)::BIGINT AS tenths FROM {P}")
def _(spark, d):
    return table(spark, d, P).select("row_id", F.rint(F.col("sta_score") * 10).cast("long").alias("tenths"))


# --- explanations

_F3 = ("target_group", "visual_evidence", "implicit_meaning")
#: What stands in for a missing part of an explanation.
DEFAULTS = {"target_group": "other", "visual_evidence": "No clear visual evidence was identified.", "implicit_meaning": "The implicit meaning could not be determined."}


@query("explanation_flatten", "SELECT row_id, " + ", ".join(f"coalesce(nullif(explanation.{f}, ''), 'null') AS {f}" for f in _F3) + f", coalesce(explanation.parse_error, false) AS parse_error FROM {E}")
def _(spark, d):
    return table(spark, d, E).select("row_id", *[T.truthy(f"explanation.{f}", F.lit("null")).alias(f) for f in _F3], F.coalesce("explanation.parse_error", F.lit(False)).alias("parse_error"))


_TOP = "CASE WHEN row_id % 3 = 0 THEN dataset WHEN row_id % 3 = 1 THEN '' END"


@query("explanation_precedence", f"SELECT row_id, coalesce(nullif({_TOP}, ''), nullif(explanation.target_group, ''), 'null') AS target_group, coalesce(nullif({_TOP}, ''), nullif(explanation.implicit_meaning, ''), '') AS implicit_meaning FROM {E}")
def _(spark, d):
    top = F.expr(_TOP)  # a field of the record itself goes before the one inside its explanation
    return table(spark, d, E).select("row_id", T.truthy(top, "explanation.target_group", F.lit("null")).alias("target_group"), F.coalesce(T.truthy(top, "explanation.implicit_meaning"), F.lit("")).alias("implicit_meaning"))


@query("truthy_coalesce", f"SELECT row_id, coalesce(nullif(target_text, ''), nullif(original_text, ''), 'null') AS out FROM {TR}")
def _(spark, d):
    return table(spark, d, TR).select("row_id", T.truthy("target_text", "original_text", F.lit("null")).alias("out"))


def _forced(f):
    c = F.col(f"explanation.{f}")
    return F.when(F.col("is_hateful") & T.null_like(c, T.FORCED), F.lit(DEFAULTS[f])).otherwise(c)


def _missing_sql(f):
    return f"coalesce(lower({D.strip('explanation.' + f)}) IN ('', 'null', 'none', 'n/a', 'na', 'unknown'), true)"


def _forced_sql(f):
    return f"CASE WHEN is_hateful AND {_missing_sql(f)} THEN '{DEFAULTS[f]}' ELSE explanation.{f} END"


@query("null_like_force", f"SELECT row_id, {', '.join(f'{_forced_sql(f)} AS {f}' for f in _F3)}, is_hateful AND ({' OR '.join(map(_missing_sql, _F3))}) AS changed FROM {E}")
def _(spark, d):
    changed = F.col("is_hateful") & (T.null_like("explanation.target_group", T.FORCED) | T.null_like("explanation.visual_evidence", T.FORCED) | T.null_like("explanation.implicit_meaning", T.FORCED))
    return table(spark, d, E).select("row_id", *[_forced(f).alias(f) for f in _F3], changed.alias("changed"))


@query("fallback_record", f"""SELECT row_id, CASE WHEN explanation.error IS NULL THEN explanation.target_group WHEN is_hateful THEN 'other' END AS target_group,
    CASE WHEN explanation.error IS NULL THEN explanation.implicit_meaning WHEN is_hateful THEN '{DEFAULTS["implicit_meaning"]}' END AS implicit_meaning, explanation.error AS error FROM {E}""")
def _(spark, d):
    err, hate = F.col("explanation.error"), F.col("is_hateful")
    return table(spark, d, E).select(
        "row_id",
        *[F.when(err.isNull(), F.col(f"explanation.{f}")).when(hate, F.lit(DEFAULTS[f])).alias(f) for f in ("target_group", "implicit_meaning")],
        err.alias("error"),
    )


@query("completeness", f"SELECT row_id, {' AND '.join(f'''coalesce(explanation.{f} <> '', false)''' for f in _F3)} AS complete FROM {E}")
def _(spark, d):
    c = [F.coalesce(F.col(f"explanation.{f}") != "", F.lit(False)) for f in _F3]
    return table(spark, d, E).select("row_id", (c[0] & c[1] & c[2]).alias("complete"))


@query("prompt_defaults", f"""SELECT row_id, 'Target: ' || coalesce(nullif(explanation.target_group, ''), 'other') || '; evidence: ' || coalesce(nullif(explanation.visual_evidence, ''), 'none') || '; text: ' || original_text AS prompt FROM {E}""")
def _(spark, d):
    return table(spark, d, E).select("row_id", F.format_string("Target: %s; evidence: %s; text: %s", T.truthy("explanation.target_group", F.lit("other")), T.truthy("explanation.visual_evidence", F.lit("none")), F.col("original_text")).alias("prompt"))


#: Advice for a further attempt, by the reason the last one was rejected.
HINTS = {
    "empty": "Write a complete sentence.",
    "url": "Leave out links.",
    "mention": "Leave out user names.",
    "hashtag": "Leave out tags.",
    "too_short": "Write at least a few words.",
    "too_long": "Be brief.",
    "low_diversity": "Vary the words.",
    "repetition": "Don't repeat words.",
    "symbol_heavy": "Use words, not symbols.",
    "no_edit": "Change the wording.",
    "too_similar": "Change more of the wording.",
    "low_sta": "Be less offensive.",
    "low_bertscore": "Stay closer to the meaning.",
    "high_bertscore": "Move further from the original.",
    "low_toxicity_drop": "Remove the offensive parts.",
}


@query("prompt_with_hint", f"SELECT row_id, 'Rewrite: ' || original_text || coalesce(' Hint: ' || CASE reject_reason {' '.join(f'''WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}' ''' for k, v in HINTS.items())} END, '') AS prompt FROM {P}")
def _(spark, d):
    hint = F.try_element_at(F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv]), F.col("reject_reason"))
    return table(spark, d, P).select("row_id", F.concat(F.lit("Rewrite: "), F.col("original_text"), F.coalesce(F.concat(F.lit(" Hint: "), hint), F.lit(""))).alias("prompt"))


CONDITIONS = {"full": (1, 1, 1), "target_only": (1, 0, 0), "visual_only": (0, 1, 0), "none": (0, 0, 0)}


def conditioned(mode: str, t="target_group", v="visual_evidence", m="implicit_meaning", text="original_text"):
    """`[T: …] [V: …] [M: …] | text`, with `null` for what the mode masks or the row lacks."""
    parts = [T.truthy(c, F.lit("null")) if on else F.lit("null") for c, on in zip((t, v, m), CONDITIONS[mode], strict=True)]
    return F.concat(F.lit("[T: "), parts[0], F.lit("] [V: "), parts[1], F.lit("] [M: "), parts[2], F.lit("] | "), F.col(text))


def _conditioned_sql(mode: str) -> str:
    t, v, m = (f"coalesce(nullif({c}, ''), 'null')" if on else "'null'" for c, on in zip(_F3, CONDITIONS[mode], strict=True))
    return f"'[T: ' || {t} || '] [V: ' || {v} || '] [M: ' || {m} || '] | ' || original_text"


@query("conditional_input", f"SELECT row_id, {_conditioned_sql('full')} AS input FROM {TR}")
def _(spark, d):
    return table(spark, d, TR).select("row_id", conditioned("full").alias("input"))


@query("ablation_fanout", " UNION ALL ".join(f"SELECT row_id, '{m}' AS mode, {_conditioned_sql(m)} AS input FROM {TR}" for m in CONDITIONS))
def _(spark, d):
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), conditioned(m).alias("input")) for m in CONDITIONS]))
    return table(spark, d, TR).select("row_id", each.alias("x")).select("row_id", "x.mode", "x.input")


# --- votes and labels


@query("majority_vote", f"SELECT row_id, len(list_filter(v, lambda x: x <> 0)) >= 2 AS hateful FROM (SELECT row_id, [row_id % 3, row_id % 4, row_id % 2] AS v FROM {U})")
def _(spark, d):
    v = F.array(*[F.col("row_id") % k for k in (3, 4, 2)])
    return table(spark, d, U).select("row_id", M.majority(v).alias("hateful"))


@query("array_mode", f"SELECT row_id, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE a END AS vote FROM (SELECT row_id, row_id % 3 AS a, row_id % 4 AS b, row_id % 2 AS c FROM {U})")
def _(spark, d):
    return table(spark, d, U).select("row_id", M.mode(F.array(*[F.col("row_id") % k for k in (3, 4, 2)])).alias("vote"))


@query("dominant_reason", f"""SELECT dataset, coalesce(max_by(r, (n, r)) FILTER (r <> ''), 'low_sta') AS reject_reason FROM
    (SELECT dataset, trim(coalesce(reject_reason, '')) AS r, count(*) AS n FROM {P} GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    return M.dominant(table(spark, d, P), "dataset", "reject_reason", "low_sta")


@query("label_normalise", f"SELECT row_id, lower(coalesce(original_label, 'not harmful')) <> 'not harmful' AS hateful FROM {U}")
def _(spark, d):
    label = F.col("original_label")
    field = F.when(F.col("row_id") % 2 == 0, F.to_json(F.array(label, F.lit("other")), {"ignoreNullFields": "false"})).otherwise(label)  # a list in half of the rows
    return table(spark, d, U).select("row_id", (F.lower(first_label(field)) != HARMLESS).alias("hateful"))


@query("guarded_int", f"SELECT row_id, coalesce(TRY_CAST(regexp_extract(original_label, '=(.*)$', 1) AS INTEGER) = 1, false) AS positive FROM {U}")
def _(spark, d):
    return table(spark, d, U).select("row_id", F.coalesce(F.regexp_extract("original_label", "=(.*)$", 1).try_cast("int") == 1, F.lit(False)).alias("positive"))


@query("label_dim_lookup", f"SELECT row_id, coalesce(n.name, (u.row_id % 9)::VARCHAR) AS label FROM {U} u LEFT JOIN (VALUES (0, 'none'), (1, 'racist'), (2, 'sexist'), (3, 'homophobe'), (4, 'religion'), (5, 'other')) n(code, name) ON u.row_id % 9 = n.code")
def _(spark, d):
    names = dict(enumerate(("none", "racist", "sexist", "homophobe", "religion", "other")))
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    code = (F.col("row_id") % 9).cast("int")
    return table(spark, d, U).select("row_id", F.coalesce(F.try_element_at(m, code), code.cast("string")).alias("label"))


@query("constant_lookup", f"SELECT dataset, coalesce(CASE dataset WHEN 'mmhs150k' THEN 150.0 WHEN 'mami' THEN 10.0 END, 0.0)::DOUBLE AS thousands FROM (SELECT DISTINCT dataset FROM {U})")
def _(spark, d):
    m = F.create_map(F.lit("mmhs150k"), F.lit(150.0), F.lit("mami"), F.lit(10.0))
    return table(spark, d, U).select("dataset").distinct().select("dataset", F.coalesce(F.try_element_at(m, F.col("dataset")), F.lit(0.0)).alias("thousands"))


# --- vectors

_L = "list_transform(range(1, 6), lambda i: embedding[i]::DOUBLE)"
_EV = f"SELECT vec_id, label, {_L} AS a, list_transform(range(6, 11), lambda i: embedding[i]::DOUBLE) AS b FROM embeddings"


def _vecs(spark, d):
    e = V.doubles(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", "label", F.slice(e, 1, 5).alias("a"), F.slice(e, 6, 5).alias("b"))


_FULL = "SELECT vec_id, label, list_transform(embedding[1:len(embedding) // 2], lambda x: x::DOUBLE) AS a, list_transform(embedding[len(embedding) // 2 + 1:], lambda x: x::DOUBLE) AS b FROM embeddings"


def _halves(spark, d):
    """Both halves of the whole vectors."""
    e = V.doubles(F.col("embedding"))
    n = F.floor(F.size(e) / 2).cast("int")
    return table(spark, d, "embeddings").select("vec_id", "label", F.slice(e, F.lit(1), n).alias("a"), F.slice(e, n + 1, n).alias("b"))


_SM = "list_transform(a, lambda x: exp(x - list_max(a)) / list_sum(list_transform(a, lambda y: exp(y - list_max(a)))))"


@query("softmax_argmax", f"SELECT vec_id, (list_position(a, list_max(a)) - 1)::INTEGER AS top, round(list_max({_SM}), 6) AS p FROM ({_EV})")
def _(spark, d):
    return _vecs(spark, d).select("vec_id", V.argmax(F.col("a")).alias("top"), F.round(F.array_max(V.softmax(F.col("a"))), 6).alias("p"))


@query("multiclass_filter", f"SELECT vec_id FROM (SELECT vec_id, {_SM} AS p FROM ({_EV})) WHERE p[1] > list_max(p[2:5]) AND p[1] >= 0.22::DOUBLE")
def _(spark, d):
    p = _vecs(spark, d).select("vec_id", V.softmax(F.col("a")).alias("p"))
    return p.where((F.element_at("p", 1) > F.array_max(F.slice("p", 2, 4))) & (F.element_at("p", 1) >= 0.22)).select("vec_id")


@query("binary_score_filter", f"SELECT vec_id FROM ({_EV}) WHERE a[1] > a[2]")
def _(spark, d):
    return _vecs(spark, d).where(F.element_at("a", 1) > F.element_at("a", 2)).select("vec_id")


@query("reject_bucket", f"SELECT vec_id, CASE WHEN NOT (p[1] > list_max(p[2:5]) AND p[1] >= 0.22::DOUBLE) THEN CASE WHEN round(p[1], 4) < 0.22::DOUBLE THEN 'threshold' ELSE 'not_top' END END AS bucket FROM (SELECT vec_id, {_SM} AS p FROM ({_EV}))")
def _(spark, d):
    p = _vecs(spark, d).select("vec_id", V.softmax(F.col("a")).alias("p"))
    top = F.element_at("p", 1)
    return p.select("vec_id", R.score_bucket((top > F.array_max(F.slice("p", 2, 4))) & (top >= 0.22), top, 0.22).alias("bucket"))


@query("score_tensor", f"SELECT vec_id, round(CASE WHEN abs(list_sum(a) - 1) <= 0.001::DOUBLE THEN a[2] ELSE ({_SM})[2] END, 6) AS p2, round(CASE WHEN a[1] BETWEEN 0 AND 1 THEN a[1] ELSE 1 / (1 + exp(-a[1])) END, 6) AS p1 FROM ({_EV})")
def _(spark, d):
    return _vecs(spark, d).select("vec_id", F.round(V.probability(F.col("a"), F.lit(1)), 6).alias("p2"), F.round(V.probability(F.slice("a", 1, 1), F.lit(1)), 6).alias("p1"))


@query("positive_label", "SELECT name, place FROM (VALUES ('hateful', 1), ('toxic', 0), ('plain', NULL)) t(name, place)")
def _(spark, d):
    maps = spark.createDataFrame([("hateful", {0: "not hateful", 1: "hateful"}), ("toxic", {0: "toxic", 1: "neutral"}), ("plain", {0: "a", 1: "b"})], "name string, labels map<int,string>")
    hit = F.map_filter("labels", lambda k, v: F.lower(v).rlike("hate|toxic|offens|abus") & ~F.lower(v).rlike(r"\b(not|non|no)\b|^non"))
    return maps.select("name", F.array_min(F.map_keys(hit)).alias("place"))


@query("cosine01", f"SELECT vec_id, round((list_cosine_similarity(a, b) + 1) / 2, 6) AS c FROM ({_FULL})")
def _(spark, d):
    return _halves(spark, d).select("vec_id", F.round(V.cosine01(F.col("a"), F.col("b")), 6).alias("c"))


@query("l2_norm", f"SELECT vec_id, round(a[1] / sqrt(list_sum(list_transform(a, lambda x: x * x))), 6) AS first, round(a[-1] / sqrt(list_sum(list_transform(a, lambda x: x * x))), 6) AS last FROM ({_FULL})")
def _(spark, d):
    u = V.unit(F.col("a"))
    return _halves(spark, d).select("vec_id", F.round(F.element_at(u, 1), 6).alias("first"), F.round(F.element_at(u, -1), 6).alias("last"))


@query("vec_concat_pad", f"SELECT vec_id, 96::BIGINT AS n, round(list_sum(a) + list_sum(b), 5) AS total FROM ({_FULL})")
def _(spark, d):
    v = V.padded(F.concat("a", "b"), 96)
    return _halves(spark, d).select("vec_id", F.size(v).cast("long").alias("n"), F.round(V.total(v), 5).alias("total"))


@query("mean_pool", f"SELECT vec_id, len(a)::BIGINT * 2 // 8 AS n, round(list_sum(a[1:8]) / 8, 6) AS m1, round(list_sum(b[len(b) - 7:]) / 8, 6) AS last FROM ({_FULL})")
def _(spark, d):
    m = V.mean_pool(F.concat("a", "b"), 8)
    return _halves(spark, d).select("vec_id", F.size(m).cast("long").alias("n"), F.round(F.element_at(m, 1), 6).alias("m1"), F.round(F.element_at(m, -1), 6).alias("last"))


@query("mse_loss", f"SELECT label, round(avg(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i]))) / len(a)), 6) AS loss FROM ({_FULL}) GROUP BY 1")
def _(spark, d):
    return _halves(spark, d).groupBy("label").agg(F.round(F.avg(V.mse(F.col("a"), F.col("b"))), 6).alias("loss"))
