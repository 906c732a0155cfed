"""Ordered quality rules: each list of rules becomes one CASE, so a row has the reason of the first rule it fails."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.similarity import char_similarity
from millrace.session import once


@dataclass(frozen=True)
class Rule:
    """`fails`: the condition under which a row is dropped for `name`; an unknown condition doesn't drop it."""

    name: str
    fails: Column


def reason(rules: list[Rule]) -> Column:
    """The name of the first failing rule, null if all pass."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.fails, F.lit(r.name)).otherwise(out)
    return out


def kept(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return df.where(reason(rules).isNull())


def training_filter(parse_error: Column, drop: Column, least: float = 0.0) -> list[Rule]:
    """Parse errors, then missing toxicity drops, then drops that are not above the least one."""
    d = drop.try_cast("double")
    return [
        Rule("parse_error", F.coalesce(parse_error, F.lit(False))),
        Rule("missing_toxicity_drop", d.isNull() | F.isnan(d)),
        Rule("non_positive_drop", d <= least),
    ]


@dataclass(frozen=True)
class Gate:
    """Thresholds of the quality gate, checked when made."""

    sta: float = 0.25
    similar: float = 0.15
    most_similar: float = 1.0
    drop: float = 0.05
    source: float = 0.20
    lexical: float = 0.0
    char: float = 1.0

    def __post_init__(self):
        for name in ("sta", "similar", "most_similar", "drop", "source", "lexical", "char"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} is not between 0 and 1")
        if self.most_similar <= self.similar:
            raise ValueError("most_similar is not above similar")


COMBINED = Gate(sta=0.45, similar=0.25, drop=0.0)
REWRITES_ONLY = Gate()


def gate(g: Gate, sta: Column, similar: Column, drop: Column, original: Column) -> dict[str, Column]:
    """passes_sta (strict), passes_bertscore (strict; the upper bound only counts below 1), passes_toxicity_delta (inclusive)."""
    c = F.lit(True) if g.most_similar >= 1 else similar < g.most_similar
    need = F.when(original >= g.source, F.lit(g.drop)).otherwise(F.lit(0.0))
    out = {"passes_sta": sta > g.sta, "passes_bertscore": (similar > g.similar) & c, "passes_toxicity_delta": drop >= need}
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def reject_combined(g: Gate, sta: Column, similar: Column, drop: Column, original: Column) -> Column:
    """Why the gate failed: sta, then similarity (the upper bound always counts), then the drop; null if it passed."""
    p = gate(g, sta, similar, drop, original)
    ok = p["passes_sta"] & p["passes_bertscore"] & p["passes_toxicity_delta"]
    return (
        F.when(ok, F.lit(None).cast("string"))
        .when(~p["passes_sta"], F.lit("low_sta"))
        .when(F.coalesce(similar <= g.similar, F.lit(True)), F.lit("low_bertscore"))
        .when(similar >= g.most_similar, F.lit("high_bertscore"))
        .otherwise(F.lit("low_toxicity_drop"))
    )


def reject_rewrites(g: Gate, sta: Column, similar: Column, drop: Column, original: Column) -> Column:
    """As `reject_combined`, with the drop before the similarity."""
    p = gate(g, sta, similar, drop, original)
    high = (similar >= g.most_similar) if g.most_similar < 1 else F.lit(False)
    return (
        F.when(~p["passes_sta"], F.lit("low_sta"))
        .when(~p["passes_toxicity_delta"], F.lit("low_toxicity_drop"))
        .when(~p["passes_bertscore"], F.when(F.coalesce(high, F.lit(False)), F.lit("high_bertscore")).otherwise(F.lit("low_bertscore")))
    )


def format_parts(rewrite: Column, original: Column) -> Column:
    """What the format rules look at, as one struct: stripped text, its words, both texts in the form they are compared in."""
    t = T.strip_ws(F.coalesce(rewrite, F.lit("")))
    return F.struct(t.alias("text"), T.tokens(F.lower(t)).alias("words"), T.compare_form(rewrite).alias("new"), T.compare_form(original).alias("old"))


def format_rules(parts: Column, lexical: float = 0.0) -> list[Rule]:
    """Rules of a usable rewrite, in order, over `format_parts`."""
    t, words, new, old = (parts.getField(f) for f in ("text", "words", "new", "old"))
    n = F.size(words)
    rules = [
        Rule("empty", t == ""),
        Rule("url", t.rlike(T.URL) | t.rlike(T.DOMAIN)),
        Rule("mention", t.rlike(T.MENTION)),
        Rule("hashtag", t.rlike(T.HASHTAG)),
        Rule("too_short", n < 2),
        Rule("too_long", F.length(t) > 280),
        Rule("low_diversity", (n >= 8) & (T.unique_ratio(words) < 0.35)),
        Rule("repetition", (n >= 8) & (T.max_share(words) > 0.45)),
        Rule("symbol_heavy", T.symbol_ratio(t) > 0.35),
        Rule("no_edit", new == old),
    ]
    if lexical > 0:
        rules.append(Rule("too_similar", T.token_change(old, new) < lexical))
    return rules


def with_format_reason(df: DataFrame, rewrite: Column, original: Column, name: str = "format_reason", lexical: float = 0.0, char: float = 1.0) -> DataFrame:
    """Adds the reason of the first format rule that fails (null: usable); texts are prepared once per row."""
    d = once(df, "_parts", format_parts(rewrite, original))
    d = d.withColumn(name, reason(format_rules(F.col("_parts"), lexical)))
    if char < 1:
        # runs in Python, so only texts that pass the other rules are handed over
        new, old = F.col("_parts.new"), F.col("_parts.old")
        asked = F.col(name).isNull() & (F.least(F.length(new), F.length(old)) >= 24)
        d = d.withColumn("_like", char_similarity(F.when(asked, old), F.when(asked, new)))
        d = d.withColumn(name, F.when(asked & (F.col("_like") > char), F.lit("too_similar")).otherwise(F.col(name))).drop("_like")
    return d.drop("_parts")


def score_bucket(kept_: Column, score: Column, threshold: float) -> Column:
    """Why a picture was dropped: below the threshold (its rounded score), or not the top label; null if kept."""
    return F.when(~kept_, F.when(F.round(score, 4) < threshold, F.lit("threshold")).otherwise(F.lit("not_top")))


def length_bucket(n: Column, low: int = 10, high: int = 300) -> Column:
    return F.when(n < low, F.lit("low")).when(n > high, F.lit("high"))
