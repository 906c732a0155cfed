"""Queries that scan and write files, repair model answers, run models' stand-ins and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import model_json
from millrace.functions import text as T
from millrace.operators import plugins
from millrace.operators.dedupe import first_wins
from millrace.operators.joins import pending
from millrace.plans import dialect as D
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources import annotations as A
from millrace.sources import readers as S
from millrace.sources import sinks
from millrace.streaming import incremental

P, E, U, TR = "train_pseudo_rewrites_merged", "train_explanations_merged", "unified_train", "train"
_ROWS = "row_id bigint, id string, text string, hateful int"


def _captions(spark, d):
    return table(spark, d, U).select("row_id", "id", "text", "hateful")


def _text_lines(df, path, parts=4):
    """Lines of text as files, one per part, in which rows keep their order."""
    df.repartitionByRange(parts, "row_id").sortWithinPartitions("row_id", "line_no").select("value").write.text(path)


@query("csv_quoted_scan", f"SELECT row_id, nullif(text, '') AS text, hateful FROM {U}")
def _(spark, d):
    path = sinks.scratch(spark, "csv")
    sinks.csv_table(_captions(spark, d), path, ["row_id", "text", "hateful"])
    return S.csv_table(spark, path, "row_id bigint, text string, hateful int")


@query("csv_sniffed_scan", f"SELECT id, row_id::VARCHAR AS row_id FROM {U}")
def _(spark, d):
    path = sinks.scratch(spark, "tsv")
    df = table(spark, d, U).select("row_id", F.coalesce("id", F.lit("")).alias("id"))
    df.select(F.col("row_id").alias("Row ID"), F.col("id").alias("id")).coalesce(1).write.option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)
    return S.sniffed(spark, path).select("row_id", "id")


@query("manifest_scan", f"SELECT dataset, count(*) AS n, count(*) FILTER (hateful = 1) AS kept FROM {U} GROUP BY 1")
def _(spark, d):
    path = sinks.scratch(spark, "manifest")
    m = table(spark, d, U).select("image_path", F.concat(F.lit("<"), "dataset", F.lit(">")).alias("dataset"), F.when(F.col("hateful") == 1, " True").otherwise("0").alias("kept"))
    names = [f.name for f in spark.createDataFrame([], schemas.MANIFEST).schema]
    full = m.select(*[F.col(n) if n in m.columns else F.lit(None).cast("string").alias(n) for n in names])
    sinks.csv_table(full, path, names)
    got = S.manifest(spark, path).withColumn("dataset", F.regexp_replace("dataset", "^<|>$", ""))
    return got.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


@query("jsonl_strict_scan", f"SELECT row_id, id, text, hateful FROM {U}")
def _(spark, d):
    path = sinks.scratch(spark, "jsonl")
    sinks.jsonl(_captions(spark, d), path)
    return S.jsonl(spark, path, _ROWS)


def _noisy_lines(spark, d, path):
    """Each row as an object; after every 100th a torn line, an array, a scalar and a blank."""
    rows = _captions(spark, d)
    good = F.to_json(F.struct("row_id", "id", "text", "hateful"))
    bad = F.when(F.col("row_id") % 100 == 0, F.array(good, F.substring(good, 1, 9), F.lit("[1, 2]"), F.lit("7"), F.lit(""))).otherwise(F.array(good))
    _text_lines(rows.select("row_id", F.posexplode(bad).alias("line_no", "value")), path)


@query("jsonl_permissive_scan", f"SELECT row_id, text FROM {U}")
def _(spark, d):
    path = sinks.scratch(spark, "noisy")
    _noisy_lines(spark, d, path)
    return S.permissive(S.numbered_lines(spark, path, "*.txt"), _ROWS).where("state = 'object'").select("record.row_id", "record.text")


@query("jsonl_states", f"""SELECT state, n FROM (VALUES ('object', (SELECT count(*) FROM {U})), ('invalid', (SELECT 3 * count(*) FROM {U} WHERE row_id % 100 = 0))) t(state, n)""")
def _(spark, d):
    path = sinks.scratch(spark, "noisy")
    _noisy_lines(spark, d, path)
    p = S.permissive(S.numbered_lines(spark, path, "*.txt"), _ROWS)
    return p.where("state <> 'blank'").groupBy("state").agg(F.count("*").alias("n"))


@query("jsonl_prefix_scan")
def _(spark, d):
    path = sinks.scratch(spark, "noisy")
    _noisy_lines(spark, d, path)
    return S.until_bad(S.numbered_lines(spark, path, "*.txt"), _ROWS).select("record.row_id")


@query("json_map_explode", f"SELECT 'r' || row_id AS key, len(v)::BIGINT AS votes, len(list_filter(v, lambda x: x <> 0)) >= 2 AS hateful, text FROM (SELECT row_id, coalesce(text, '') AS text, [row_id % 3, row_id % 4, row_id % 2] AS v FROM {U})")
def _(spark, d):
    path = sinks.scratch(spark, "map")
    rows = table(spark, d, U)
    record = F.struct(F.array(*[(F.col("row_id") % k).cast("int") for k in (3, 4, 2)]).alias("labels"), F.coalesce("text", F.lit("")).alias("tweet_text"))
    # a document holds at most 5,000 rows, so no group grows with the table; each is a file
    entry = F.struct(F.concat(F.lit("r"), F.col("row_id").cast("string")), record)
    docs = rows.groupBy(F.floor(F.col("row_id") / 5000)).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    m = S.json_map(spark, path)
    return m.select("key", F.size("value.labels").cast("long").alias("votes"), (F.size(F.filter("value.labels", lambda x: x != 0)) >= 2).alias("hateful"), F.col("value.tweet_text").alias("text"))


# --- raw annotations under one schema


def _raw_lines(spark, d):
    path = sinks.scratch(spark, "lines")
    u, label = table(spark, d, U), F.coalesce("original_label", F.lit("not harmful"))
    row = F.struct("id", F.concat(F.lit("p"), F.col("row_id").cast("string"), F.lit(".png")).alias("image"), "text")
    one, listed = (F.to_json(F.struct(row["id"].alias("id"), row["image"].alias("image"), row["text"].alias("text"), x.alias("labels"))) for x in (label, F.array(label, F.lit("x"))))
    u.select(F.when(F.col("row_id") % 2 == 0, listed).otherwise(one).alias("value")).write.text(path)
    return A.from_lines(spark, path, "img/a", "harmeme")


def _raw_table(spark, d):
    path = sinks.scratch(spark, "annotations")
    name = F.concat(F.lit(" q"), F.col("row_id").cast("string"), F.lit(".jpg "))
    text = T.squeeze(F.coalesce("text", F.lit("")))
    flag = F.when(F.col("hateful").isNull(), "x").otherwise(F.col("hateful").cast("string"))
    u = table(spark, d, U).select(name.alias("File Name"), flag.alias("Misogynous"), text.alias("Text Transcription"))
    u.write.option("header", True).option("sep", "\t").option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return A.from_table(S.sniffed(spark, path), "img/b", "mami")


def _raw_map(spark, d):
    path = sinks.scratch(spark, "votes")
    u = table(spark, d, U)
    record = F.struct(F.array(*[(F.col("row_id") % k).cast("int") for k in (3, 4, 2)]).alias("labels"), F.coalesce("text", F.lit("")).alias("tweet_text"))
    docs = u.groupBy(F.floor(F.col("row_id") / 5000)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("row_id").cast("string"), record)))).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    listing = u.where("row_id % 5 <> 0").select(F.col("row_id").cast("string").alias("stem"), F.concat(F.lit("img/c/"), F.col("row_id").cast("string"), F.lit(".jpeg")).alias("path"))
    return A.from_map(S.json_map(spark, path), listing, "mmhs150k")


_LINES_SQL = f"SELECT coalesce(id, 'p' || row_id) AS id, 'img/a/p' || row_id || '.png' AS image_path, 'harmeme' AS dataset, coalesce(text, '') AS text, (lower(coalesce(original_label, 'not harmful')) <> 'not harmful')::INTEGER AS hateful, coalesce(original_label, 'not harmful') AS original_label FROM {U}"
_TABLE_SQL = f"SELECT 'q' || row_id AS id, 'img/b/q' || row_id || '.jpg' AS image_path, 'mami' AS dataset, {D.squeeze("coalesce(text, '')")} AS text, coalesce((hateful = 1)::INTEGER, 0) AS hateful, 'misogynous=' || coalesce(hateful::VARCHAR, 'unknown') AS original_label FROM {U}"
_MAP_SQL = f"""SELECT row_id::VARCHAR AS id, 'img/c/' || row_id || '.jpeg' AS image_path, 'mmhs150k' AS dataset, coalesce(text, '') AS text, (len(v) >= 2)::INTEGER AS hateful,
    CASE WHEN len(v) = 0 THEN 'NotHate' ELSE (['NotHate', 'Racist', 'Sexist', 'Homophobe', 'Religion', 'OtherHate'])[(CASE WHEN len(v) = 3 AND v[2] = v[3] THEN v[2] ELSE v[1] END) + 1] END AS original_label
    FROM (SELECT row_id, text, list_filter([row_id % 3, row_id % 4, row_id % 2], lambda x: x <> 0) AS v FROM {U} WHERE row_id % 5 <> 0)"""


@query("raw_lines_loader", _LINES_SQL)
def _(spark, d):
    return _raw_lines(spark, d)


@query("raw_table_loader", _TABLE_SQL)
def _(spark, d):
    return _raw_table(spark, d)


@query("raw_map_loader", _MAP_SQL)
def _(spark, d):
    return _raw_map(spark, d)


@query("raw_unified", f"SELECT dataset, count(*) AS n, sum(hateful)::BIGINT AS hateful FROM ({_LINES_SQL} UNION ALL {_TABLE_SQL} UNION ALL {_MAP_SQL}) WHERE length(text) BETWEEN 10 AND 300 GROUP BY 1")
def _(spark, d):
    rows = _raw_lines(spark, d).unionByName(_raw_table(spark, d)).unionByName(_raw_map(spark, d))
    return rows.where(F.length("text").between(10, 300)).groupBy("dataset").agg(F.count("*").alias("n"), F.sum("hateful").alias("hateful"))


@query("json_directory_scan", f"SELECT dataset, count(*)::BIGINT AS n FROM {U} GROUP BY dataset")
def _(spark, d):
    path = sinks.scratch(spark, "dir")
    stats = table(spark, d, U).groupBy("dataset").agg(F.count("*").alias("n"))
    # the reader takes one record per file: each spelling has one row and a folder of its own, so a file holds one
    part = F.coalesce(F.concat(F.lit("k"), F.hex("dataset")), F.lit("null"))
    stats.withColumn("part", part).write.partitionBy("part").json(path)
    return S.json_directory(spark, path, "dataset string, n bigint").select("dataset", "n")


@query("shard_merge", f"SELECT min_by(row_id, (shard, row_id)) AS row_id FROM {E} GROUP BY id, image_path")
def _(spark, d):
    path = sinks.scratch(spark, "shards")
    rows = table(spark, d, E).select("row_id", "id", "image_path", "shard", F.col("shard").alias("part"))
    # files of a shard each, of a range of rows; their names sort like shards
    rows.repartitionByRange("part", "row_id").sortWithinPartitions("part", "row_id").write.partitionBy("part").option("ignoreNullFields", False).json(path)
    got = spark.read.schema("row_id bigint, id string, image_path string, shard string, part string").json(path)
    return first_wins(got, F.concat_ws("\u0001", "id", "image_path"), "part", "row_id").select("row_id")


@query("file_listing", "SELECT 3 AS files, 3 AS filled")
def _(spark, d):
    path = sinks.scratch(spark, "listing")
    table(spark, d, "nation").repartition(3).write.option("header", True).csv(path)
    return S.files(spark, path, "csv").agg(F.count("*").alias("files"), F.count_if(F.col("size") > 0).alias("filled"))


@query("latest_checkpoint", "SELECT event_type AS run, max(user_id % 1000)::BIGINT AS step FROM events GROUP BY 1")
def _(spark, d):
    paths = table(spark, d, "events").select(F.col("event_type").alias("run"), F.concat(F.col("event_type"), F.lit("/checkpoint-"), (F.col("user_id") % 1000).cast("string"), F.lit("/state.json")).alias("path"))
    return S.latest_checkpoint(paths).select("run", F.regexp_extract("path", r"-(\d+)/", 1).cast("long").alias("step"))


@query("debug_examples", "SELECT printf('debug_%04d', i) AS id, CASE WHEN i < 8 THEN 1 ELSE 0 END AS label, CASE WHEN i < 8 THEN (['race_ethnicity', 'nationality', 'religion', 'gender', 'sexual_orientation', 'disability', 'other'])[i % 7 + 1] END AS target_group FROM range(16) r(i)")
def _(spark, d):
    groups = F.array(*[F.lit(g) for g, _ in T.GROUP_KEYWORDS])
    i = F.col("id").cast("int")
    return spark.range(16).select(F.format_string("debug_%04d", i).alias("id"), F.when(i < 8, 1).otherwise(0).alias("label"), F.when(i < 8, F.element_at(groups, i % 7 + 1)).alias("target_group"))


# --- sinks


@query("jsonl_sink", f"SELECT row_id, explanation.target_group AS target_group, explanation.error AS error FROM {E}")
def _(spark, d):
    path = sinks.scratch(spark, "out")
    sinks.jsonl(table(spark, d, E).select("row_id", "explanation"), path)
    return S.jsonl(spark, path, "row_id bigint, explanation struct<target_group:string,error:string>").select("row_id", "explanation.target_group", "explanation.error")


@query("append_log", f"SELECT row_id % 3 AS part, count(*) AS n FROM {U} GROUP BY 1")
def _(spark, d):
    path = sinks.scratch(spark, "log")
    rows = table(spark, d, U).select("row_id", (F.col("row_id") % 3).alias("part"))
    for i in range(3):
        sinks.jsonl(rows.where(F.col("part") == i), path, "append")
    return S.jsonl(spark, path, "row_id bigint, part bigint").groupBy("part").agg(F.count("*").alias("n"))


@query("skip_if_exists", f"SELECT count(*) AS n FROM {TR}")
def _(spark, d):
    path = sinks.scratch(spark, "once")
    rows = table(spark, d, TR).select("row_id")
    sinks.jsonl(rows, path, "ignore")
    sinks.jsonl(rows.where("row_id % 2 = 0"), path, "ignore")
    return S.jsonl(spark, path, "row_id bigint").agg(F.count("*").alias("n"))


@query("json_document", f"""SELECT '{{"dataset":"' || dataset || '","n":' || count(*) || ',"with_group":' || count(*) FILTER (target_group <> 'null') || '}}' AS document FROM {TR} GROUP BY dataset""")
def _(spark, d):
    t = table(spark, d, TR).groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("target_group") != "null").alias("with_group"))
    return t.select(sinks.document(F.col("dataset"), F.col("n"), F.col("with_group")).alias("document"))


@query("text_report", f"SELECT rpad(dataset, 12, ' ') || rpad(count(*)::VARCHAR, 8, ' ') || rpad(coalesce(sum(hateful), 0)::BIGINT::VARCHAR, 8, ' ') AS line FROM {U} GROUP BY dataset")
def _(spark, d):
    t = table(spark, d, U).groupBy("dataset").agg(F.count("*").alias("n"), F.coalesce(F.sum("hateful"), F.lit(0)).alias("h"))
    return t.select(sinks.fixed_width((F.col("dataset"), 12), (F.col("n"), 8), (F.col("h"), 8)).alias("line"))


@query("copy_plan", f"SELECT image_path AS src, 'subset/' || coalesce(split, 'none') || '/' || regexp_extract(image_path, '([^/\\\\]+)$', 1) AS dst FROM {U} WHERE hateful = 1")
def _(spark, d):
    return sinks.copy_plan(table(spark, d, U).where("hateful = 1"), F.col("image_path"), "subset", F.coalesce("split", F.lit("none")))


# --- model answers, stand-ins, streams


@query("llm_json_repair", f"SELECT row_id, explanation.target_group AS target_group, explanation.implicit_meaning AS implicit_meaning, false AS parse_error FROM {E} WHERE explanation IS NOT NULL")
def _(spark, d):
    e = F.struct("explanation.target_group", "explanation.visual_evidence", "explanation.implicit_meaning")
    answer = F.concat(F.lit("Here you are {draft}:\n```json\n"), F.to_json(e, {"ignoreNullFields": "false"}), F.lit("\n```"))
    rows = table(spark, d, E).where("explanation is not null").select("row_id", F.regexp_replace(answer, r"^Here[^\n]*\n", "").alias("answer"))
    # named once, so that the function runs once per row
    got = rows.select("row_id", model_json.parsed("answer").alias("x"))
    return got.select("row_id", "x.target_group", "x.implicit_meaning", "x.parse_error")


@query("llm_json_raw_output")
def _(spark, d):
    rows = table(spark, d, E).where("explanation.raw_output is not null").select("row_id", F.col("explanation.raw_output").alias("raw"))
    return rows.select("row_id", model_json.parsed("raw").alias("x")).select("row_id", "x.target_group", "x.implicit_meaning", "x.parse_error")


@query("plugin_scorer", f"SELECT row_id, round(CASE WHEN n > 0 THEN v::DOUBLE / n END, 6) AS score FROM (SELECT row_id, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n, length(regexp_replace(t, '[^aeiou]', '', 'g')) AS v FROM (SELECT row_id, lower(coalesce(text, '')) AS t FROM {U}))")
def _(spark, d):
    rows = table(spark, d, U).select("row_id", "text")
    return plugins.scored(rows, lambda: plugins.VowelShare("text")).select("row_id", F.round("score", 6).alias("score"))


_W = D.words("original_text")


@query("plugin_generator", f"SELECT row_id, cand, array_to_string(list_filter(w, lambda x, i: i % (cand + 2) <> 0), ' ') AS rewrite FROM (SELECT row_id, {_W} AS w FROM {TR}), (SELECT i::INTEGER AS cand FROM range(4) r(i))")
def _(spark, d):
    rows = table(spark, d, TR).select("row_id", "original_text")
    return plugins.candidates(rows, lambda: plugins.DropWords("original_text"), "row_id", 4)


@query("stream_dedupe", f"SELECT DISTINCT id FROM {P}")
def _(spark, d):
    src, out, state = (sinks.scratch(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    sinks.jsonl(table(spark, d, P).select("row_id", "id"), src)
    stream = incremental.first_arrivals(incremental.json_stream(spark, src, "row_id bigint, id string"), "id")
    incremental.run_once(stream, out, state)
    return spark.read.schema("row_id bigint, id string").parquet(out).select("id")


@query("stream_resume", f"SELECT row_id FROM {TR}")
def _(spark, d):
    src, out, state = (sinks.scratch(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    rows = table(spark, d, TR).select("row_id")
    for part in (0, 1):
        sinks.jsonl(rows.where(F.col("row_id") % 2 == part), src, "append")
        incremental.run_once(incremental.json_stream(spark, src, "row_id bigint"), out, state)
        # what a restart would still have to do
        rest = pending(rows, spark.read.schema("row_id bigint").parquet(out), "row_id")
    return rows.join(rest, "row_id", "left_anti")
