"""Queries of joins, de-duplication, splits, samples, ranking and aggregation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import keys as K
from millrace.functions import text as T
from millrace.operators import dedupe, joins, plugins, rank, splits
from millrace.operators import metrics as M
from millrace.operators import rules as R
from millrace.plans import dialect as D
from millrace.plans.registry import query
from millrace.plans.rule_queries import conditioned
from millrace.session import cut, once, spread, stored, table

P, E, U, TR = "train_pseudo_rewrites_merged", "train_explanations_merged", "unified_train", "train"

# --- joins


@query("kept_semi_join", f"SELECT row_id FROM {U} WHERE image_path IN (SELECT image_path FROM {E})")
def _(spark, d):
    return joins.keep(table(spark, d, U), table(spark, d, E), "image_path").select("row_id")


@query("resume_anti_join", f"SELECT row_id FROM {U} u WHERE NOT EXISTS (SELECT 1 FROM {E} e WHERE e.id = u.id)")
def _(spark, d):
    return joins.pending(table(spark, d, U), table(spark, d, E), "id").select("row_id")


@query("hateful_not_rewritten", f"SELECT row_id FROM {E} e WHERE is_hateful AND NOT EXISTS (SELECT 1 FROM {P} p WHERE p.id = e.id)")
def _(spark, d):
    return joins.pending(table(spark, d, E).where("is_hateful"), table(spark, d, P), "id").select("row_id")


_LOOKUP = f"""WITH s AS (SELECT dataset || '::' || id AS k, max_by(coalesce(explanation.target_group, ''), row_id) AS v FROM {E} GROUP BY 1),
    b AS (SELECT id AS k, min_by(coalesce(explanation.target_group, ''), row_id) AS v FROM {E} GROUP BY 1)
    SELECT t.row_id, coalesce(s.v, b.v) AS grp FROM {TR} t LEFT JOIN s ON t.dataset || '::' || t.id = s.k LEFT JOIN b ON t.id = b.k"""


def _lookup(spark, d, missing):
    src = table(spark, d, E).select("dataset", "id", "row_id", F.coalesce("explanation.target_group", F.lit("")).alias("grp"))
    return joins.two_level(table(spark, d, TR).select("row_id", "dataset", "id"), src, "dataset", "id", ["row_id"], "grp", missing).select("row_id", "grp")


@query("two_level_lookup", f"SELECT row_id, coalesce(grp, '') AS grp FROM ({_LOOKUP})")
def _(spark, d):
    return _lookup(spark, d, "")


@query("two_level_lookup_strict", f"SELECT row_id, grp FROM ({_LOOKUP}) WHERE grp IS NOT NULL")
def _(spark, d):
    return _lookup(spark, d, None)


@query("label_lookup", f"SELECT u.row_id, l.category FROM {U} u LEFT JOIN (SELECT row_id, max(category) AS category FROM review_labels WHERE src_table = '{U}' GROUP BY 1) l USING (row_id)")
def _(spark, d):
    labels = table(spark, d, "review_labels").where(F.col("src_table") == U).groupBy("row_id").agg(F.max("category").alias("category"))
    return table(spark, d, U).select("row_id").join(labels, "row_id", "left")


@query("positional_join", f"""SELECT a.row_id AS left_row, b.row_id AS right_row FROM (SELECT row_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY row_id) AS n FROM {E}) a
    JOIN (SELECT row_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY row_id) AS n FROM {P}) b USING (dataset, n)""")
def _(spark, d):
    a, b = (joins.numbered(table(spark, d, t).select("row_id", "dataset"), ["dataset"], "row_id") for t in (E, P))
    return a.withColumnRenamed("row_id", "left_row").join(b.withColumnRenamed("row_id", "right_row"), ["dataset", "place"]).select("left_row", "right_row")


@query("slot_regroup", f"SELECT id, row_id, row_number() OVER (PARTITION BY id ORDER BY row_id) - 1 AS slot FROM {P}")
def _(spark, d):
    return joins.numbered(table(spark, d, P).select("id", "row_id"), ["id"], "row_id", name="slot")


_STEM = r"regexp_replace(regexp_extract(image_path, '([^/\\]*)$', 1), '[.][^.]*$', '')"
_EXT = r"lower(regexp_extract(image_path, '[.]([^.]+)$', 1))"


@query("extension_preference", f"SELECT stem, min_by(image_path, (list_position(['jpg', 'jpeg', 'png'], ext), image_path)) AS path FROM (SELECT image_path, {_STEM} AS stem, {_EXT} AS ext FROM {U}) WHERE ext IN ('jpg', 'jpeg', 'png') GROUP BY 1")
def _(spark, d):
    ext = F.lower(F.regexp_extract("image_path", r"[.]([^.]+)$", 1))
    place = F.array_position(F.array(F.lit("jpg"), F.lit("jpeg"), F.lit("png")), ext)
    f = table(spark, d, U).select("image_path", K.stem(F.col("image_path")).alias("stem"), place.alias("place")).where("place > 0")
    return f.groupBy("stem").agg(F.min_by("image_path", F.struct("place", "image_path")).alias("path"))


@query("directory_semi_join", f"SELECT row_id FROM {TR} WHERE {_STEM} IN (SELECT {_STEM} FROM {U})")
def _(spark, d):
    files = table(spark, d, U).select(K.stem(F.col("image_path")).alias("stem"))
    return joins.keep(table(spark, d, TR).select("row_id", K.stem(F.col("image_path")).alias("stem")), files, "stem").select("row_id")


@query("system_metric_grid", f"SELECT dataset AS system, metric, round(CASE metric WHEN 'sta' THEN sta WHEN 'sim' THEN sim ELSE dr END, 6) AS mean FROM (SELECT dataset, avg(sta_score) AS sta, avg(CASE WHEN NOT isnan(bertscore) THEN bertscore END) AS sim, avg(toxicity_drop) AS dr FROM {P} GROUP BY 1), (VALUES ('sta'), ('sim'), ('drop')) m(metric)")
def _(spark, d):
    a = table(spark, d, P).groupBy("dataset").agg(F.avg("sta_score").alias("sta"), F.avg(F.when(~F.isnan("bertscore"), F.col("bertscore"))).alias("sim"), F.avg("toxicity_drop").alias("drop"))
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 6).alias("mean")) for m in ("sta", "sim", "drop")]))
    return a.select(F.col("dataset").alias("system"), cells.alias("c")).select("system", "c.metric", "c.mean")


@query("rewrite_precision", f"""SELECT count(*) AS n, round(avg((b.g IS NULL OR b.g <> a.g)::INTEGER), 6) AS precision_ FROM (SELECT id, original_text, min_by(explanation.target_group, row_id) AS g FROM {E} WHERE explanation.target_group IS NOT NULL GROUP BY 1, 2) a
    JOIN (SELECT id, original_text, min_by(g, row_id) AS g FROM (SELECT id, original_text, row_id, explanation.target_group AS g FROM {P}) WHERE g IS NOT NULL GROUP BY 1, 2) b USING (id, original_text)""")
def _(spark, d):
    def first(t):
        return table(spark, d, t).where("explanation.target_group is not null").groupBy("id", "original_text").agg(F.min_by("explanation.target_group", "row_id").alias("g"))

    a, b = first(E), first(P).withColumnRenamed("g", "h")
    j = a.join(b, ["id", "original_text"])
    return j.agg(F.count("*").alias("n"), F.round(F.avg((F.col("h").isNull() | (F.col("h") != F.col("g"))).cast("int")), 6).alias("precision_"))


# --- unions and sets

_UNI = "unified_train unified_val unified_test".split()


@query("union_sources", "SELECT dataset, split, count(*) AS n FROM (" + " UNION ALL BY NAME ".join(f"SELECT * FROM {t}" for t in _UNI) + ") GROUP BY 1, 2")
def _(spark, d):
    a, b, c = (table(spark, d, t) for t in _UNI)
    return a.unionByName(b).unionByName(c).groupBy("dataset", "split").agg(F.count("*").alias("n"))


@query("unify_schema", f"SELECT row_id, 'caption' AS kind, text FROM {U} UNION ALL SELECT row_id, 'rewrite', pseudo_rewrite FROM {P} UNION ALL SELECT doc_id, 'document', text FROM documents")
def _(spark, d):
    def part(t, key, kind, text):
        return table(spark, d, t).select(F.col(key).alias("row_id"), F.lit(kind).alias("kind"), F.col(text).alias("text"))

    return part(U, "row_id", "caption", "text").unionByName(part(P, "row_id", "rewrite", "pseudo_rewrite")).unionByName(part("documents", "doc_id", "document", "text"))


@query("distinct_set", f"SELECT DISTINCT image_path FROM {U}")
def _(spark, d):
    return table(spark, d, U).select("image_path").distinct()


@query("distinct_keep_order", f"SELECT row_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS out FROM (SELECT row_id, {D.words('original_text')} AS w FROM {TR})")
def _(spark, d):
    return table(spark, d, TR).select("row_id", F.array_join(F.array_distinct(T.tokens("original_text")), " ").alias("out"))


@query("set_membership", f"SELECT id FROM (SELECT DISTINCT id FROM {U} WHERE id IS NOT NULL) INTERSECT SELECT id FROM {E}")
def _(spark, d):
    return table(spark, d, U).select("id").distinct().join(table(spark, d, E).select("id"), "id", "left_semi")


# --- de-duplication and keys


@query("dedupe_first_wins", f"SELECT min_by(row_id, (shard, row_id)) AS row_id FROM {E} GROUP BY id, image_path")
def _(spark, d):
    df = table(spark, d, E).select("row_id", "shard", F.concat_ws("\u0001", "id", "image_path").alias("k"))
    return dedupe.first_wins(df, F.col("k"), "shard", "row_id").select("row_id")


@query("dedupe_last_wins", f"SELECT max(row_id) AS row_id FROM {P} GROUP BY id")
def _(spark, d):
    return dedupe.last_wins(table(spark, d, P).select("row_id", "id"), F.col("id"), "row_id").select("row_id")


@query("dedupe_skewed_key", f"SELECT image_path, max(row_id) AS row_id FROM {U} GROUP BY 1")
def _(spark, d):
    return dedupe.last_by(table(spark, d, U).select("image_path", "row_id"), "image_path", ["row_id"], ["row_id"])


def _shortest(p: str) -> str:
    """The shortest form of a path, for up to four nested parents."""
    out = f"regexp_replace(regexp_replace(replace(coalesce({p}, ''), chr(92), '/'), '/+', '/', 'g'), '(^|/)([.]/)+', '\\1', 'g')"
    for _ in range(4):
        out = f"regexp_replace({out}, '(^|/)([^/.][^/]*|[.][^/.][^/]*)/[.][.](/|$)', '\\1')"
    return f"coalesce(nullif(regexp_replace({out}, '(.)/[.]?$', '\\1'), ''), '.')"


@query("path_normalise", f"SELECT row_id, {_shortest('image_path')} AS path FROM {U}")
def _(spark, d):
    return table(spark, d, U).select("row_id", K.normal_path(F.col("image_path")).alias("path"))


@query("record_key", f"""SELECT row_id, CASE WHEN trim(coalesce(id, '')) <> '' THEN 'id::' || trim(id) ELSE 'imgtxt::' || {_shortest('image_path')} || '::' || {D.squeeze("coalesce(original_text, '')")} END AS key,
    CASE WHEN trim(coalesce(id, '')) <> '' THEN trim(id) ELSE {_shortest('image_path')} END AS short FROM {P}""")
def _(spark, d):
    return table(spark, d, P).select("row_id", K.rewrite_key(F.col("id"), F.col("image_path"), F.col("original_text")).alias("key"), K.explanation_key(F.col("id"), F.col("image_path")).alias("short"))


@query("md5_shard", f"""SELECT row_id, ((((((a % 13) * 9 + b) % 13) * 9 + c) % 13) * 9 + e) % 13 AS shard FROM
    (SELECT row_id, ('0x' || substr(h, 1, 8))::BIGINT AS a, ('0x' || substr(h, 9, 8))::BIGINT AS b, ('0x' || substr(h, 17, 8))::BIGINT AS c, ('0x' || substr(h, 25, 8))::BIGINT AS e FROM (SELECT row_id, md5(image_path) AS h FROM {U}))""")
def _(spark, d):
    return table(spark, d, U).select("row_id", K.md5_shard(F.col("image_path"), 13).cast("long").alias("shard"))


@query("shard_tag", f"SELECT row_id, 'shard' || lpad((row_id % 8)::VARCHAR, 2, '0') || 'of08' AS tag, regexp_matches('x_shard' || row_id || 'of8.jsonl', '_shard[0-9]+of[0-9]+[.]jsonl$') AS is_shard FROM {U}")
def _(spark, d):
    name = F.concat(F.lit("x_shard"), F.col("row_id").cast("string"), F.lit("of8.jsonl"))
    return table(spark, d, U).select("row_id", K.shard_tag((F.col("row_id") % 8).cast("int"), 8).alias("tag"), name.rlike(r"_shard\d+of\d+\.jsonl$").alias("is_shard"))


@query("row_shard", f"SELECT row_id, (row_number() OVER (PARTITION BY dataset ORDER BY row_id) - 1) % 8 AS shard FROM {U}")
def _(spark, d):
    return joins.numbered(table(spark, d, U).select("row_id", "dataset"), ["dataset"], "row_id").select("row_id", (F.col("place") % 8).alias("shard"))


@query("path_parts", f"SELECT row_id, {_STEM} AS stem, regexp_extract(image_path, '([^/\\\\]*)$', 1) AS name, starts_with(image_path, '/') AS absolute, 'root/' || image_path AS joined FROM {U}")
def _(spark, d):
    p = F.col("image_path")
    return table(spark, d, U).select("row_id", K.stem(p).alias("stem"), F.regexp_extract(p, r"([^/\\]*)$", 1).alias("name"), p.startswith("/").alias("absolute"), F.concat_ws("/", F.lit("root"), p).alias("joined"))


# --- splits and samples


def _strata(seed: int, src: str) -> str:
    return f"""SELECT row_id, dataset, hateful, row_number() OVER (PARTITION BY dataset, hateful ORDER BY md5(row_id || ':{seed}'), row_id)::DOUBLE AS r, count(*) OVER (PARTITION BY dataset, hateful)::DOUBLE AS n FROM {src}"""


_SPLIT = f"""SELECT row_id, dataset, hateful, CASE WHEN r <= greatest(n - v - t, 0) THEN 'train' WHEN r <= greatest(n - t, 0) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS v, greatest(1, round_even(n * (1::DOUBLE - 0.8::DOUBLE - 0.1::DOUBLE), 0)) AS t FROM ({_strata(42, U)}))"""


def _split(spark, d):
    return splits.stratified(table(spark, d, U).select("row_id", "dataset", "hateful"), ["dataset", "hateful"], "row_id")


@query("stratified_split", f"SELECT row_id, split FROM ({_SPLIT})")
def _(spark, d):
    return _split(spark, d).select("row_id", "split")


@query("split_stats", f"SELECT split, dataset, count(*) AS total, coalesce(sum(hateful), 0)::BIGINT AS hateful, round(100.0::DOUBLE * coalesce(sum(hateful), 0) / greatest(count(*), 1), 1) AS hateful_pct FROM ({_SPLIT}) GROUP BY 1, 2")
def _(spark, d):
    return M.split_stats(_split(spark, d), "split", "dataset")


@query("split_pct_floor", f"SELECT dataset, count(*) AS total, (100 * coalesce(sum(hateful), 0)::BIGINT) // count(*) AS pct FROM {U} GROUP BY 1")
def _(spark, d):
    h = F.coalesce(F.sum("hateful"), F.lit(0))
    return table(spark, d, U).groupBy("dataset").agg(F.count("*").alias("total"), F.floor(100 * h / F.count("*")).alias("pct"))


@query("split_matrix", f"SELECT dataset, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM ({_SPLIT}) GROUP BY 1")
def _(spark, d):
    return _split(spark, d).groupBy("dataset").pivot("split", ["train", "val", "test"]).count().fillna(0)


@query("global_split", f"SELECT row_id, CASE WHEN r <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM (SELECT row_id, row_number() OVER (ORDER BY md5(row_id || ':42'), row_id) AS r, count(*) OVER () AS n FROM {TR})")
def _(spark, d):
    return splits.two_way(table(spark, d, TR).select("row_id"), "row_id")


@query("val_fallback", f"SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS r, count(*) OVER () AS n FROM {TR}) WHERE r <= greatest(1, n // 10)")
def _(spark, d):
    df = table(spark, d, TR).select("row_id")
    return joins.numbered(df, [], "row_id").where(F.col("place") < max(1, df.count() // 10)).select("row_id")


@query("sample_per_class", f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY dataset, format_valid ORDER BY md5(row_id || ':0'), row_id) AS r FROM {P}) WHERE r <= 50")
def _(spark, d):
    return splits.per_class(table(spark, d, P).select("row_id", "dataset", "format_valid"), ["dataset", "format_valid"], "row_id", 50).select("row_id")


@query("seeded_sample", f"SELECT row_id FROM {U} ORDER BY md5(row_id || ':42'), row_id LIMIT 300")
def _(spark, d):
    return splits.top(table(spark, d, U).select("row_id"), 300, K.seeded(F.col("row_id"), 42), "row_id")


@query("topk_limit", f"SELECT row_id, round(toxicity_drop, 6) AS drop_ FROM {P} WHERE toxicity_drop IS NOT NULL ORDER BY toxicity_drop DESC, row_id LIMIT 16")
def _(spark, d):
    return splits.top(table(spark, d, P).where("toxicity_drop is not null"), 16, F.desc("toxicity_drop"), "row_id").select("row_id", F.round("toxicity_drop", 6).alias("drop_"))


@query("first_samples", f"SELECT row_id, input_text, target_text FROM {TR} ORDER BY row_id LIMIT 5")
def _(spark, d):
    return splits.top(table(spark, d, TR), 5, "row_id").select("row_id", "input_text", "target_text")


@query("sort_by_key", f"SELECT row_id, row_number() OVER (PARTITION BY shard ORDER BY id, row_id) AS place FROM {E}")
def _(spark, d):
    return joins.numbered(table(spark, d, E).select("row_id", "shard", "id"), ["shard"], "id", "row_id").select("row_id", (F.col("place") + 1).alias("place"))


# --- ranking

_NT = f"len({D.words('pseudo_rewrite')})"
_RANKED = f"""SELECT row_id, id, row_number() OVER (PARTITION BY id ORDER BY coalesce(format_valid, false) DESC, trim(coalesce(pseudo_rewrite, '')) <> '' DESC,
    coalesce(passes_sta, false) AND coalesce(passes_bertscore, false) AND coalesce(passes_toxicity_delta, false) DESC, coalesce(passes_sta, false) AND coalesce(passes_toxicity_delta, false) DESC,
    coalesce(passes_bertscore, false) DESC, coalesce(sim, -1) DESC, coalesce(sta_score, -1) DESC, coalesce(toxicity_drop, -1) DESC, abs({_NT} - 12), length(coalesce(pseudo_rewrite, '')), row_id) AS place
    FROM (SELECT *, CASE WHEN NOT isnan(bertscore) THEN bertscore END AS sim FROM {P})"""


def _cands(spark, d):
    return table(spark, d, P).withColumn("bertscore", F.when(~F.isnan("bertscore"), F.col("bertscore"))).withColumnRenamed("pseudo_rewrite", "rewrite")


@query("best_candidate", f"SELECT row_id FROM ({_RANKED}) WHERE place = 1")
def _(spark, d):
    return rank.best(_cands(spark, d), "id", "row_id").select("row_id")


@query("best_over_attempts", f"SELECT row_id FROM ({_RANKED.replace('length(coalesce(pseudo_rewrite, %s)), row_id' % (chr(39) * 2), 'length(coalesce(pseudo_rewrite, %s)), row_id %% 2, row_id' % (chr(39) * 2))}) WHERE place = 1")
def _(spark, d):
    df = _cands(spark, d).withColumn("attempt", F.col("row_id") % 2)
    return rank.best(df, "id", "attempt", "row_id").select("row_id")


@query("retry_unresolved", f"SELECT row_id, attempt FROM (SELECT row_id, 1 AS attempt, toxicity_drop FROM {P} UNION ALL SELECT row_id, 2, toxicity_drop FROM {P} WHERE NOT coalesce(toxicity_drop > 0.3::DOUBLE, false))")
def _(spark, d):
    def generate(rows, attempt):
        return rows.withColumn("ok", F.coalesce(F.col("toxicity_drop") > 0.3 / attempt, F.lit(False)))

    got = rank.with_retries(table(spark, d, P).select("row_id", "toxicity_drop"), "row_id", generate, F.col("ok"))
    return got.select("row_id", "attempt")


# --- aggregates


@query("distribution", f"SELECT condition AS value, count(*) AS n FROM {TR} GROUP BY 1 ORDER BY n DESC, value")
def _(spark, d):
    return M.distribution(table(spark, d, TR), F.col("condition")).orderBy(F.desc("n"), "value")


@query("presence_counts", f"SELECT CASE WHEN target_group = 'null' THEN 'absent' ELSE 'present' END AS value, count(*) AS n FROM {TR} GROUP BY 1")
def _(spark, d):
    return M.distribution(table(spark, d, TR), F.when(F.col("target_group") == "null", "absent").otherwise("present"))


@query("metric_summary", f"SELECT dataset, round(avg(sta_score), 6) AS mean, round(stddev_pop(sta_score), 6) AS std, count(sta_score) AS n FROM {P} GROUP BY 1")
def _(spark, d):
    m, s, n = M.summary("sta_score")
    return table(spark, d, P).groupBy("dataset").agg(F.round(m, 6).alias("mean"), F.round(s, 6).alias("std"), n.alias("n"))


@query("sta_share", f"SELECT dataset, round(avg((coalesce(rewrite_toxicity, 1) < 0.5::DOUBLE)::INTEGER), 4) AS share FROM {P} GROUP BY 1")
def _(spark, d):
    return table(spark, d, P).groupBy("dataset").agg(F.round(F.avg((F.coalesce("rewrite_toxicity", F.lit(1.0)) < 0.5).cast("int")), 4).alias("share"))


_C = D.strip("coalesce(pseudo_rewrite, '')")


@query("collapse_guard", f"SELECT shard, round(CASE WHEN avg(c) >= 0.05::DOUBLE THEN 0.0::DOUBLE ELSE avg(sta_score) END, 6) AS score FROM (SELECT shard, sta_score, (len({D.words(_C)}) <= 1)::INTEGER AS c FROM {P}) GROUP BY 1")
def _(spark, d):
    c = (F.size(T.tokens("pseudo_rewrite")) <= 1).cast("int")
    return table(spark, d, P).groupBy("shard").agg(F.round(M.guarded(F.avg("sta_score"), F.avg(c), 0.05), 6).alias("score"))


@query("aggregate_j", f"SELECT dataset, round(avg(sta_score) * avg(CASE WHEN NOT isnan(bertscore) THEN bertscore END) * avg(1 - rewrite_toxicity) * avg(passed_stage1_filters::INTEGER), 6) AS j FROM {P} GROUP BY 1")
def _(spark, d):
    sim = F.avg(F.when(~F.isnan("bertscore"), F.col("bertscore")))
    return table(spark, d, P).groupBy("dataset").agg(F.round(M.joint(F.avg("sta_score"), sim, F.avg(1 - F.col("rewrite_toxicity")), F.avg(F.col("passed_stage1_filters").cast("int"))), 6).alias("j"))


@query("min_ignoring_null", f"SELECT dataset, round(min(rewrite_toxicity), 6) AS least FROM {P} GROUP BY 1")
def _(spark, d):
    return table(spark, d, P).groupBy("dataset").agg(F.round(F.min("rewrite_toxicity"), 6).alias("least"))


@query("grand_totals", f"SELECT coalesce(dataset, 'all') AS dataset, count(*) AS n, count(*) FILTER (passed_stage1_filters) AS kept, round(100.0::DOUBLE * count(*) FILTER (passed_stage1_filters) / count(*), 1) AS pct FROM {P} GROUP BY ROLLUP (dataset)")
def _(spark, d):
    kept = F.count_if("passed_stage1_filters")
    t = table(spark, d, P).rollup("dataset").agg(F.count("*").alias("n"), kept.alias("kept"), F.round(100.0 * kept / F.count("*"), 1).alias("pct"))
    return t.withColumn("dataset", F.coalesce("dataset", F.lit("all")))


# --- logs: one trainer log per event type and user group

_LOG = "SELECT event_type || '-' || (user_id % 50) AS run, event_id AS step, value FROM events"


def _log(spark, d):
    return table(spark, d, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("run"), F.col("event_id").alias("step"), "value")


@query("moving_average", f"""SELECT run, step, round(CASE WHEN n <= w THEN value ELSE m END, 4) AS value FROM (
      SELECT run, step, value, n, w, i, list_avg(list_slice(vs, i - w + 1, i)) AS m FROM (
        SELECT run, step, value, i, n, greatest(5, n // 20) AS w, list(value) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS vs FROM (
          SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS i, count(*) OVER (PARTITION BY run) AS n FROM ({_LOG})))) WHERE n <= w OR i >= w""")
def _(spark, d):
    return M.moving_average(_log(spark, d), ["run"], "step", "value").withColumn("value", F.round("value", 4))


@query("running_stats", f"SELECT run, i AS seen, s AS high FROM (SELECT run, row_number() OVER (PARTITION BY run ORDER BY step) AS i, sum((value > 50)::INTEGER) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING)::BIGINT AS s FROM ({_LOG})) WHERE i % 10 = 0")
def _(spark, d):
    return M.running(_log(spark, d), ["run"], "step", 10, high=(F.col("value") > 50).cast("int"))


@query("running_best", f"SELECT run, step, round(min(value) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING), 6) AS best FROM ({_LOG})")
def _(spark, d):
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return _log(spark, d).select("run", "step", F.round(F.min("value").over(w), 6).alias("best"))


@query("log_split", f"SELECT kind, count(*) AS n, round(sum(coalesce(loss, eval_loss)), 4) AS total FROM (SELECT CASE WHEN loss IS NOT NULL AND eval_loss IS NULL THEN 'train' WHEN eval_loss IS NOT NULL THEN 'eval' END AS kind, * FROM (SELECT CASE WHEN step % 10 <> 0 THEN value END AS loss, CASE WHEN step % 10 = 0 THEN value END AS eval_loss FROM ({_LOG}))) WHERE kind IS NOT NULL GROUP BY 1")
def _(spark, d):
    e = F.col("step") % 10 == 0
    log = _log(spark, d).select(F.when(~e, F.col("value")).alias("loss"), F.when(e, F.col("value")).alias("eval_loss"))
    kind = F.when(F.col("loss").isNotNull() & F.col("eval_loss").isNull(), "train").when(F.col("eval_loss").isNotNull(), "eval")
    return log.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("loss", "eval_loss")), 4).alias("total"))


@query("history_wrap", f"SELECT run, max(step) AS global_step, count(*) AS entries, round(min(value), 6) AS best_metric FROM ({_LOG}) GROUP BY 1")
def _(spark, d):
    h = _log(spark, d).groupBy("run").agg(F.max("step").alias("global_step"), F.array_sort(F.collect_list(F.struct("step", "value"))).alias("log_history"))
    return h.select("run", "global_step", F.size("log_history").cast("long").alias("entries"), F.round(F.array_min(F.transform("log_history", lambda x: x["value"])), 6).alias("best_metric"))


# --- pipelines


def stage_rows(spark, d):
    """The training-set build: filter with reasons, clean, check the format, format the input, split."""
    src = spread(table(spark, d, P))
    kept = R.kept(src, R.training_filter(F.col("explanation.parse_error"), F.col("toxicity_drop")))
    clean = once(kept, "target_text", T.sanitize("pseudo_rewrite")).select(
        "row_id", "dataset", T.strip_ws("original_text").alias("original_text"), "target_text",
        *[F.col(f"explanation.{f}").alias(f) for f in ("target_group", "visual_evidence", "implicit_meaning")],
    )
    good = clean.where((F.col("original_text") != "") & (F.col("target_text") != ""))
    good = R.with_format_reason(good, F.col("target_text"), F.col("original_text")).where("format_reason is null").drop("format_reason")
    # the split reads its input more than once
    return splits.two_way(stored(good.withColumn("input_text", conditioned("full"))), "row_id")


_CLEAN = f"""SELECT row_id, dataset, {D.strip('original_text')} AS original_text, {D.sanitize('pseudo_rewrite')} AS t,
    coalesce(nullif(explanation.target_group, ''), 'null') AS g FROM {P} WHERE NOT coalesce(explanation.parse_error, false) AND toxicity_drop IS NOT NULL AND NOT isnan(toxicity_drop) AND toxicity_drop > 0"""
_GOOD = f"""SELECT row_id, dataset, t, g, original_text FROM (SELECT *, {D.words('lower(t)')} AS w FROM ({_CLEAN})) WHERE original_text <> '' AND t <> ''
    AND NOT (regexp_matches(t, '(?:^|{D.NW})(?i:https?://|www\\.){D.NS}*{D.W}') OR t <> {D.domains('t')}) AND NOT regexp_matches(t, '(?:^|{D.NW})@{D.W}+') AND NOT regexp_matches(t, '(?:^|{D.NW})#{D.W}+')
    AND len(w) >= 2 AND length(t) <= 280 AND NOT (len(w) >= 8 AND {D.unique('w')} < 0.35::DOUBLE) AND NOT (len(w) >= 8 AND {D.most('w')} > 0.45::DOUBLE)
    AND NOT ({D.symbols('t')} > 0.35::DOUBLE) AND {D.compare('t')} <> {D.compare('original_text')}"""
_BUILT = f"SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(row_id || ':42'), row_id) <= floor(count(*) OVER () * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM ({_GOOD})"


@query("training_rows", f"SELECT row_id, t AS target_text FROM ({_GOOD})")
def _(spark, d):
    return stage_rows(spark, d).select("row_id", "target_text")


@query("stage_build_counts", f"SELECT split, dataset, count(*) AS n, count(*) FILTER (g <> 'null') AS with_group FROM ({_BUILT}) GROUP BY 1, 2")
def _(spark, d):
    g = T.truthy("target_group", F.lit("null"))
    return stage_rows(spark, d).groupBy("split", "dataset").agg(F.count("*").alias("n"), F.count_if(g != "null").alias("with_group"))


_SOURCES = " UNION ALL ".join(f"SELECT row_id, id, image_path, lower(regexp_replace(dataset, '[\\s_-]+', '', 'g')) AS dataset, text, hateful FROM {t}" for t in _UNI)
_KEPT = f"SELECT * FROM ({_SOURCES}) WHERE length(text) BETWEEN 10 AND 300 AND hateful IS NOT NULL AND image_path IN (SELECT image_path FROM {E})"


@query("unified_build_stats", f"""SELECT split, dataset, count(*) AS total, sum(hateful)::BIGINT AS hateful, round(100.0::DOUBLE * sum(hateful) / greatest(count(*), 1), 1) AS hateful_pct FROM (
    SELECT *, CASE WHEN r <= greatest(n - v - t, 0) THEN 'train' WHEN r <= greatest(n - t, 0) THEN 'val' ELSE 'test' END AS split FROM (
      SELECT *, greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS v, greatest(1, round_even(n * (1::DOUBLE - 0.8::DOUBLE - 0.1::DOUBLE), 0)) AS t FROM ({_strata(42, f'({_KEPT})')}))) GROUP BY 1, 2""")
def _(spark, d):
    """The unified corpus: three sources under one schema, kept pictures only, length gate, stratified split, statistics."""
    parts = [table(spark, d, t).select("row_id", "id", "image_path", F.lower(F.regexp_replace("dataset", r"[\s_-]+", "")).alias("dataset"), "text", "hateful") for t in _UNI]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.length("text").between(10, 300) & F.col("hateful").isNotNull())
    rows = joins.keep(rows, table(spark, d, E), "image_path")
    return M.split_stats(splits.stratified(rows, ["dataset", "hateful"], "row_id"), "split", "dataset")


@query("rewrite_pipeline")
def _(spark, d):
    """Rewrites with stand-in models: candidates, cleaning, format rules before scores, gate, best of two attempts."""
    rows = table(spark, d, E).where("is_hateful").select("row_id", "original_text")
    gate = R.Gate(sta=0.0, similar=0.1, drop=0.0)

    def generate(todo, attempt):
        got = plugins.candidates(todo, lambda: plugins.DropWords("original_text"), "row_id", 2 + attempt)
        c = once(got.withColumnRenamed("rewrite", "raw").join(todo, "row_id"), "rewrite", T.sanitize("raw")).drop("raw")
        c = R.with_format_reason(c, F.col("rewrite"), F.col("original_text")).withColumn("format_valid", F.col("format_reason").isNull())
        c = cut(c)  # used by both branches below
        # scores cost more than rules, so only valid candidates get them
        scored = plugins.scored(c.where("format_valid"), lambda: plugins.VowelShare("rewrite"), "rewrite_toxicity")
        c = scored.unionByName(c.where("not format_valid").withColumn("rewrite_toxicity", F.lit(None).cast("double")))
        c = c.withColumn("sta_score", 1 - F.col("rewrite_toxicity")).withColumn("bertscore", 1 - T.token_change("original_text", "rewrite")).withColumn("toxicity_drop", 0.4 - F.col("rewrite_toxicity"))
        p = R.gate(gate, F.col("sta_score"), F.col("bertscore"), F.col("toxicity_drop"), F.lit(0.4))
        return c.withColumns({k: F.col("format_valid") & v for k, v in p.items()})

    passed = F.col("passes_sta") & F.col("passes_bertscore") & F.col("passes_toxicity_delta")
    best = rank.best(rank.with_retries(rows, "row_id", generate, passed), "row_id", "attempt", "cand")
    return best.select("row_id", "rewrite", "format_valid", "attempt", "cand", F.round("sta_score", 6).alias("sta_score"), passed.alias("passed"))


@query("evaluation_table", f"""SELECT system, count(*) AS n, round(avg(sta_score), 4) AS sta, round(avg(sim), 4) AS sim, round(avg(sta_score) * avg(sim) * avg(ok), 4) AS j FROM (
    SELECT dataset AS system, sta_score, CASE WHEN NOT isnan(bertscore) THEN bertscore END AS sim, passed_stage1_filters::INTEGER AS ok FROM {P}) GROUP BY 1""")
def _(spark, d):
    """Each system's means and their product."""
    s = F.avg(F.when(~F.isnan("bertscore"), F.col("bertscore")))
    sta, ok = F.avg("sta_score"), F.avg(F.col("passed_stage1_filters").cast("int"))
    return table(spark, d, P).groupBy(F.col("dataset").alias("system")).agg(F.count("*").alias("n"), F.round(sta, 4).alias("sta"), F.round(s, 4).alias("sim"), F.round(M.joint(sta, s, F.lit(1.0), ok), 4).alias("j"))
