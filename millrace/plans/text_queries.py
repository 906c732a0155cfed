"""Queries of text expressions over captions, rewrites and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.similarity import char_similarity, ngrams, rouge_l, rouge_n
from millrace.operators import rules as R
from millrace.operators.metrics import distribution
from millrace.plans import dialect as D
from millrace.plans.registry import query
from millrace.session import once, spread
from millrace.session import table as scan



def table(spark, d, name):
    """Text expressions are heavy: a table in few files is dealt over the cores first."""
    return spread(scan(spark, d, name))


REWRITES, CAPTIONS, TRAIN = "train_pseudo_rewrites_merged", "unified_train", "train"


def _one(name, source, column, expression, sql):
    @query(name, f"SELECT row_id, {sql(column)} AS out FROM {source}")
    def q(spark, d):
        return table(spark, d, source).select("row_id", expression(F.col(column)).alias("out"))


_one("strip_urls", CAPTIONS, "text", T.strip_urls, D.urls)
_one("strip_domains", CAPTIONS, "text", T.strip_domains, D.domains)
_one("strip_mentions", CAPTIONS, "text", T.strip_mentions, D.mentions)
_one("strip_hashtags", CAPTIONS, "text", T.strip_hashtags, D.hashtags)
_one("strip_label", REWRITES, "pseudo_rewrite", T.strip_label, D.label)
_one("collapse_punctuation", CAPTIONS, "text", T.collapse_punctuation, D.collapse)
_one("squeeze_whitespace", CAPTIONS, "text", T.squeeze, D.squeeze)
_one("sanitize_text", REWRITES, "pseudo_rewrite", T.sanitize, D.sanitize)
_one("normalize_compare", CAPTIONS, "text", T.compare_form, D.compare)


@query("last_segment", r"""SELECT row_id, CASE WHEN len(list_filter(regexp_split_to_array(s, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda t: t <> '')) >= 2 THEN s ELSE x END AS out
    FROM (SELECT row_id, x, string_split(x, 'output:')[-1] AS s FROM (SELECT row_id, 'input: ' || original_text || ' output:' || coalesce(target_text, '') AS x FROM train))""")
def _(spark, d):
    x = F.concat(F.lit("input: "), F.col("original_text"), F.lit(" output:"), F.coalesce("target_text", F.lit("")))
    return table(spark, d, TRAIN).select("row_id", T.last_segment(x, "output:", 2).alias("out"))


@query("tokenize_stats", f"""SELECT row_id, len(w)::BIGINT AS n, round({D.unique('w')}, 6) AS uniq, round({D.most('w')}, 6) AS top
    FROM (SELECT row_id, {D.words('lower(pseudo_rewrite)')} AS w FROM {REWRITES})""")
def _(spark, d):
    w = F.col("w")
    return table(spark, d, REWRITES).select("row_id", T.tokens(F.lower("pseudo_rewrite")).alias("w")).select(
        "row_id", F.size(w).cast("long").alias("n"), F.round(T.unique_ratio(w), 6).alias("uniq"), F.round(T.max_share(w), 6).alias("top")
    )


@query("symbol_ratio", f"SELECT row_id, round({D.symbols('text')}, 6) AS ratio FROM {CAPTIONS}")
def _(spark, d):
    return table(spark, d, CAPTIONS).select("row_id", F.round(T.symbol_ratio("text"), 6).alias("ratio"))


@query("symbol_ratio_documents", f"SELECT doc_id, round({D.symbols('text')}, 6) AS ratio FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.symbol_ratio("text"), 6).alias("ratio"))


_C = D.strip("coalesce(pseudo_rewrite, '')")


@query("collapse_flag", f"""SELECT row_id, len(w) <= 1 OR (len(w) >= 6 AND {D.unique('w')} < 0.35::DOUBLE) OR
      (len(list_distinct(list_filter(string_split(lower(c), ''), lambda t: NOT regexp_matches(t, '{D.SP}') AND t <> ''))) <= 2 AND length(c) >= 4) AS collapsed
    FROM (SELECT row_id, {_C} AS c, {D.words(f'lower({_C})')} AS w FROM {REWRITES})""")
def _(spark, d):
    return table(spark, d, REWRITES).select("row_id", T.collapsed("pseudo_rewrite").alias("collapsed"))


def _words(spark, d):
    rows = table(spark, d, REWRITES).select("row_id", "original_text", "pseudo_rewrite")
    return once(rows, "x", F.struct(T.compare_tokens("original_text").alias("a"), T.compare_tokens("pseudo_rewrite").alias("b")))


_AB = f"SELECT row_id, {D.compare_words('original_text')} AS a, {D.compare_words('pseudo_rewrite')} AS b FROM {REWRITES}"


@query("token_change_ratio", f"""SELECT row_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 1.0::DOUBLE
    ELSE 1.0::DOUBLE - {D.overlap('a', 'b')} / greatest(len(a), len(b), 1) END, 6) AS change FROM ({_AB})""")
def _(spark, d):
    return _words(spark, d).select("row_id", F.round(T.word_change(F.col("x.a"), F.col("x.b")), 6).alias("change"))


@query("multiset_overlap", f"SELECT row_id, ({D.overlap('a', 'b')})::BIGINT AS shared FROM ({_AB})")
def _(spark, d):
    return _words(spark, d).select("row_id", T.overlap(F.col("x.a"), F.col("x.b")).cast("long").alias("shared"))


def _rouge_sql(n: int) -> str:
    def gram(x):
        return x if n == 1 else f"list_transform(range(1, greatest(len({x}), 1)), lambda i: {x}[i] || ' ' || {x}[i + 1])"

    return f"""SELECT row_id, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN 2.0::DOUBLE * {D.overlap('x', 'y')} / (len(x) + len(y)) ELSE 0.0::DOUBLE END, 6) AS rouge
      FROM (SELECT row_id, {gram('a')} AS x, {gram('b')} AS y FROM ({_AB}))"""


def _rouge(n):
    @query(f"rouge{n}", _rouge_sql(n))
    def q(spark, d):
        rows = table(spark, d, REWRITES).select("row_id", "original_text", "pseudo_rewrite")
        grams = once(rows, "x", F.struct(*[ngrams(T.compare_tokens(c), n).alias(a) for c, a in (("original_text", "a"), ("pseudo_rewrite", "b"))]))
        return grams.select("row_id", F.round(rouge_n(F.col("x.a"), F.col("x.b")), 6).alias("rouge"))


_rouge(1)
_rouge(2)


@query("rouge_l")
def _(spark, d):
    return table(spark, d, REWRITES).select("row_id", F.round(rouge_l(T.compare_form("original_text"), T.compare_form("pseudo_rewrite")), 6).alias("rouge"))


@query("char_similarity")
def _(spark, d):
    rows = table(spark, d, REWRITES).select("row_id", "original_text", "pseudo_rewrite")
    both = once(rows, "x", F.struct(T.compare_form("original_text").alias("a"), T.compare_form("pseudo_rewrite").alias("b")))
    pairs = both.select("row_id", "x.a", "x.b").where((F.length("a") >= 24) & (F.length("b") >= 24))
    return pairs.select("row_id", F.round(char_similarity("a", "b"), 6).alias("similarity"))


_T = D.strip("coalesce(pseudo_rewrite, '')")
_FORMAT = f"""SELECT row_id, CASE WHEN t = '' THEN 'empty'
      WHEN regexp_matches(t, '(?:^|{D.NW})(?i:https?://|www\\.){D.NS}*{D.W}') OR t <> {D.domains('t')} THEN 'url'
      WHEN regexp_matches(t, '(?:^|{D.NW})@{D.W}+') THEN 'mention' WHEN regexp_matches(t, '(?:^|{D.NW})#{D.W}+') THEN 'hashtag'
      WHEN len(w) < 2 THEN 'too_short' WHEN length(t) > 280 THEN 'too_long'
      WHEN len(w) >= 8 AND {D.unique('w')} < 0.35::DOUBLE THEN 'low_diversity' WHEN len(w) >= 8 AND {D.most('w')} > 0.45::DOUBLE THEN 'repetition'
      WHEN {D.symbols('t')} > 0.35::DOUBLE THEN 'symbol_heavy' WHEN {D.compare('t')} = {D.compare('original_text')} THEN 'no_edit' END AS reason
    FROM (SELECT row_id, original_text, {_T} AS t, {D.words(f'lower({_T})')} AS w FROM {REWRITES})"""


def _reasons(spark, d):
    rows = table(spark, d, REWRITES).select("row_id", "pseudo_rewrite", "original_text")
    return R.with_format_reason(rows, F.col("pseudo_rewrite"), F.col("original_text"), "reason").select("row_id", "reason")


@query("format_validity_reason", _FORMAT)
def _(spark, d):
    return _reasons(spark, d)


@query("format_reason_histogram", f"SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM ({_FORMAT}) GROUP BY 1")
def _(spark, d):
    return distribution(_reasons(spark, d), F.coalesce("reason", F.lit("ok")), "reason")


@query("format_validity_guarded")
def _(spark, d):
    rows = table(spark, d, REWRITES).select("row_id", "pseudo_rewrite", "original_text")
    return R.with_format_reason(rows, F.col("pseudo_rewrite"), F.col("original_text"), "reason", lexical=0.05, char=0.98).select("row_id", "reason")


@query("target_group_norm", f"SELECT row_id, {D.target_group('explanation.target_group')} AS grp FROM train_explanations_merged")
def _(spark, d):
    return table(spark, d, "train_explanations_merged").select("row_id", T.target_group(F.col("explanation.target_group")).alias("grp"))


@query("null_like_test", f"SELECT row_id, {D.null_like('explanation.implicit_meaning')} AS missing FROM train_explanations_merged")
def _(spark, d):
    return table(spark, d, "train_explanations_merged").select("row_id", T.null_like(F.col("explanation.implicit_meaning")).alias("missing"))


@query("error_marker", "SELECT row_id FROM train_pseudo_rewrites_merged WHERE starts_with(pseudo_rewrite, '[REWRITE ERROR:')")
def _(spark, d):
    return table(spark, d, REWRITES).where(F.startswith("pseudo_rewrite", F.lit("[REWRITE ERROR:"))).select("row_id")


@query("pair_filter", f"""SELECT row_id FROM train WHERE {D.strip('original_text')} <> '' AND {D.strip("coalesce(target_text, '')")} <> ''
    AND lower({D.strip('original_text')}) <> lower({D.strip('target_text')})""")
def _(spark, d):
    a, b = T.strip_ws("original_text"), T.strip_ws("target_text")
    return table(spark, d, TRAIN).where((a != "") & (b != "") & (F.lower(a) != F.lower(b))).select("row_id")
