"""The queries of this package over a data directory, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import abuse, formatting, overlap, packing, pairs, quota, stuffing, tokenizer, truncation
from millrace.llm.canon import PANELS, dataset_name
from millrace.session import table

STRATA = ["dataset", "hateful"]


def _evals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "unified_val").unionByName(table(spark, d, "unified_test"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "train"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return pairs.rates(table(spark, d, "train"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copies(table(spark, d, "unified_train")).select(F.col("keep").alias("keep_row_id"), F.col("dup").alias("dup_row_id"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return formatting.collapse(table(spark, d, "unified_train")).select("keep", "copies", "variants")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(*abuse.inputs(spark, d))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(*abuse.inputs(spark, d))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(*abuse.inputs(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    p = overlap.overlaps(table(spark, d, "unified_train"), _evals(spark, d))
    return p.select(F.col("train_row").alias("train_row_id"), F.col("eval_row").alias("eval_row_id"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "unified_train"), _evals(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(truncation.values(spark, d))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.values(spark, d))


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = quota.named(table(spark, d, "unified_train").select("row_id", *STRATA))
    return quota.sample(rows, table(spark, d, "sample_targets"), STRATA)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    rows = quota.named(table(spark, d, "unified_train").select("row_id", *STRATA))
    return quota.report(rows, table(spark, d, "sample_targets"), STRATA)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("given"))
    back = tokenizer.decoded(tokenizer.token_ids(docs, text="given"))
    return docs.join(back, "doc_id").select("doc_id", (F.col("given") == F.col("text")).alias("same"))


def p8_assign(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack_texts(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.found(table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.scored(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def _bare_sql(text: str) -> str:
    """The canonical form of a text in DuckDB's dialect."""
    mark = r"""[\s]*["'”’»*\])]*[\s]*[:=\])}|–—-]["\s]*"""
    gap = r"(?:[^\p{L}\p{N}]*[^\p{L}\p{N}\s][^\p{L}\p{N}]*|[ \t]*[\r\n]\s*)"
    t = rf"""(CASE WHEN regexp_matches({text}, '^\s*\{{\s*"') THEN regexp_replace({text}, '\\[nrt]', ' ', 'g') ELSE {text} END)"""
    out = t
    for first, second in PANELS:
        whole = rf"(?is)^([^\p{{L}}\p{{N}}]*){second}{mark}(.*?){gap}{first}{mark}(.*)$".replace("'", "''")
        out = rf"(CASE WHEN regexp_matches({t}, '(?i)^[^\p{{L}}\p{{N}}]*{second}[^\p{{L}}\p{{N}}]') THEN regexp_replace({t}, '{whole}', '{first} \3 {second} \2') ELSE {out} END)"
    ignored = r"[\p{P}\p{Z}\p{C}\p{Sm}\p{Sk}\p{Sc}\s\x{FE0F}]+"
    return f"replace(replace(regexp_replace(lower({out}), '{ignored}', '', 'g'), 'ß', 'ss'), 'ς', 'σ')"


def oracle_sql() -> dict[str, str]:
    captions = rf"""
        WITH b AS (SELECT row_id, text, {_bare_sql("text")} AS bare FROM unified_train WHERE text IS NOT NULL),
             g AS (SELECT bare, min(row_id) AS keep, count(*) AS copies, count(DISTINCT text) AS variants FROM b
                   WHERE length(regexp_replace(bare, '[^\p{{L}}\p{{N}}]+', '', 'g')) >= {formatting.LEAST} GROUP BY bare)
    """
    sample = f"""
        WITH t AS (SELECT dataset, hateful, sum(target_share) AS share, max(min_rows) AS least FROM sample_targets GROUP BY ALL),
             r AS (SELECT row_id, lower(regexp_replace(dataset, '[\\s\\p{{Z}}_-]+', '', 'g')) AS dataset, hateful FROM unified_train),
             k AS (SELECT r.row_id, r.dataset, r.hateful, share, least,
                          row_number() OVER (PARTITION BY r.dataset, r.hateful ORDER BY md5('{quota.SEED}:' || r.row_id), r.row_id) AS n
                   FROM r JOIN t ON r.dataset = t.dataset AND r.hateful = t.hateful WHERE share > 0),
             p AS (SELECT *, row_number() OVER (ORDER BY n > least, (n - 0.5::DOUBLE) / share, dataset, hateful) AS place FROM k)
        SELECT row_id, dataset, hateful FROM p WHERE place <= (SELECT floor(count(*) * {quota.SHARE}::DOUBLE + 0.5::DOUBLE) FROM unified_train)
    """
    report = f"""
        WITH t AS (SELECT dataset, hateful, sum(target_share) AS target_share, max(min_rows)::BIGINT AS min_rows FROM sample_targets GROUP BY ALL),
             a AS (SELECT lower(regexp_replace(dataset, '[\\s\\p{{Z}}_-]+', '', 'g')) AS dataset, hateful, count(*) AS available FROM unified_train GROUP BY ALL),
             s AS (SELECT dataset, hateful, count(*) AS sampled FROM ({sample}) GROUP BY ALL),
             z AS (SELECT floor(count(*) * {quota.SHARE}::DOUBLE + 0.5::DOUBLE) AS size FROM unified_train),
             j AS (SELECT t.*, coalesce(available, 0) AS available, coalesce(sampled, 0) AS sampled, size FROM t LEFT JOIN a USING (dataset, hateful) LEFT JOIN s USING (dataset, hateful), z)
        SELECT dataset, hateful, target_share, min_rows, available, sampled, CASE WHEN size > 0 THEN round(sampled / size, 6) ELSE 0 END AS share,
               CASE WHEN sampled < size * target_share - 1 OR sampled < min_rows THEN CASE WHEN available = 0 THEN 'absent' WHEN available < min_rows THEN 'floor' ELSE 'exhausted' END
                    WHEN sampled > size * target_share + 1 THEN 'shifted' END AS unmet FROM j
    """
    return {
        "p2_found": captions + "SELECT g.keep AS keep_row_id, b.row_id AS dup_row_id FROM b JOIN g USING (bare) WHERE b.row_id <> g.keep",
        "p2_groups": captions + "SELECT keep, copies, variants FROM g",
        "p6_sample": sample,
        "p6_report": report,
        "p7_roundtrip": "SELECT doc_id, true AS same FROM documents",
    }
