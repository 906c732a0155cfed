"""Text expressions (Column -> Column) with Unicode-exact character classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters, their complement, white space, its complement: spelt out, since the short classes differ by engine.
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
SP = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
NS = r"[^\s\x{1c}-\x{1f}\x{85}\p{Z}]"
#: A word boundary on these classes.
B = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

#: Top-level domains, label words of generated text, group keywords in their order.
TLDS = "com org net co io ai edu gov uk us ru de fr it me ly info biz".split()
LABELS = ["rewrite", "rewritten text", "rewritten_text", "output", "answer", "response"]
NULL_LIKE = ["", "null", "none", "n/a", "na", "unknown", "unspecified"]
#: What counts as missing where fields are forced to a default: "unspecified" is kept there.
FORCED = ["", "null", "none", "n/a", "na", "unknown"]
GROUP_KEYWORDS = [
    ("race_ethnicity", ["race", "ethnic", "asian", "black", "white"]),
    ("nationality", ["nation", "country", "immigrant"]),
    ("religion", ["relig", "muslim", "christian", "jew", "hindu"]),
    ("gender", ["gender", "woman", "women", "man", "men", "female", "male"]),
    ("sexual_orientation", ["gay", "lesbian", "lgbt", "sexual"]),
    ("disability", ["disab", "autis", "handicap"]),
    ("other", ["other"]),
]

URL = rf"(?i)(?<!{W})(?:https?://|www\.){NS}*{W}"
DOMAIN = rf"(?i)(?<!{W})[a-z0-9][a-z0-9-]{{1,62}}\.(?:{'|'.join(TLDS)})(?:/{NS}*{W}|{B})"
MENTION = rf"(?<!{W})@{W}+"
HASHTAG = rf"(?<!{W})#{W}+"
LABEL = rf"(?i)^{SP}*(?:{'|'.join(LABELS)}){SP}*:{SP}*"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x: Column | str) -> Column:
    """White space of any kind taken off both ends; null stays null."""
    return F.regexp_replace(_c(x), f"^{SP}+|{SP}+$", "")


def squeeze(x: Column | str) -> Column:
    """Runs of white space become one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(_c(x), f"{SP}+", " "))


def tokens(x: Column | str) -> Column:
    """The white-space separated words; null and blank give an empty array."""
    return F.filter(F.split(F.coalesce(_c(x), F.lit("")), f"{SP}+"), lambda t: t != "")


def compare_form(x: Column | str) -> Column:
    """Lower case, every run of non-word characters one blank; null gives an empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), f"{NW}+", " "))


def strip_urls(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), URL, " ")


def strip_domains(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), DOMAIN, " ")


def strip_mentions(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), MENTION, " ")


def strip_hashtags(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), HASHTAG, " ")


def strip_label(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), LABEL, "")


def collapse_punctuation(x: Column | str) -> Column:
    """Three or more of the same mark become one."""
    return F.regexp_replace(_c(x), r"([!?.,;:])\1{2,}", "$1")


def last_segment(x: Column | str, marker: str, least: int = 0) -> Column:
    """What follows the last `marker` (a literal), or the whole when that has fewer than `least` words."""
    c = _c(x)
    last = F.element_at(F.split(c, rf"\Q{marker}\E"), -1)
    return F.when(F.size(tokens(last)) >= least, last).otherwise(c) if least else last


def _unfence(x: Column) -> Column:
    """A fenced block loses its first line, and its last one when that closes the fence; lines are joined."""
    lines = F.split(x, "\n")
    n = F.size(lines)
    closed = F.element_at(lines, -1).startswith("```")
    kept = F.slice(lines, F.lit(2), F.greatest(n - F.when(closed & (n > 1), 2).otherwise(1), F.lit(0)))
    return F.when(x.startswith("```"), F.array_join(kept, " ")).otherwise(x)


def sanitize(x: Column | str) -> Column:
    """Generated text made plain: markers, fences, labels, handles, links, bullets and stray quotes removed.

    The order of the steps is part of the meaning (handles go before links). Null gives an empty string.
    """
    c = strip_ws(F.coalesce(_c(x), F.lit("")))
    c = strip_ws(last_segment(c, "[/INST]"))
    c = strip_label(_unfence(c))
    c = F.regexp_replace(c, r"[\r\n]+", " ")
    c = strip_domains(strip_urls(strip_hashtags(strip_mentions(c))))
    c = F.regexp_replace(c, "[•�]", " ")
    c = collapse_punctuation(c)
    c = F.regexp_replace(c, rf"{SP}+([!?.,;:])", "$1")
    c = squeeze(c)
    c = F.regexp_replace(c, "^[\"'` ]+|[\"'` ]+$", "")
    return strip_ws(c)


def symbol_ratio(x: Column | str) -> Column:
    """Share of characters that are neither letters, digits nor white space."""
    c = F.coalesce(_c(x), F.lit(""))
    return F.length(F.regexp_replace(c, rf"[\p{{L}}\p{{N}}\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]", "")) / F.greatest(F.length(c), F.lit(1))


def unique_ratio(words: Column) -> Column:
    """Distinct words over words; 0 for none."""
    return F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))


def max_share(words: Column) -> Column:
    """Share of the most frequent word; 0 for none. Quadratic in the words: meant for short texts."""
    counts = F.transform(F.array_distinct(words), lambda u: F.size(F.filter(words, lambda t: t == u)))
    return F.coalesce(F.array_max(counts), F.lit(0)) / F.greatest(F.size(words), F.lit(1))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two word arrays."""
    per_word = F.transform(
        F.array_intersect(a, b),
        lambda u: F.least(F.size(F.filter(a, lambda t: t == u)), F.size(F.filter(b, lambda t: t == u))),
    )
    return F.aggregate(per_word, F.lit(0), lambda s, n: s + n)


def compare_tokens(x: Column | str) -> Column:
    return F.filter(F.split(compare_form(x), " "), lambda t: t != "")


def word_change(x: Column, y: Column) -> Column:
    """Share of words changed between two word arrays: 0 for both empty, 1 for one empty."""
    n, m = F.size(x), F.size(y)
    return (
        F.when((n == 0) & (m == 0), F.lit(0.0))
        .when((n == 0) | (m == 0), F.lit(1.0))
        .otherwise(1.0 - overlap(x, y) / F.greatest(n, m, F.lit(1)))
    )


def token_change(a: Column | str, b: Column | str) -> Column:
    """`word_change` of two texts in the form they are compared in."""
    return word_change(compare_tokens(a), compare_tokens(b))


def collapsed(x: Column | str) -> Column:
    """Degenerate text: at most one word, or few distinct words among six or more, or two characters repeated."""
    c = strip_ws(F.coalesce(_c(x), F.lit("")))
    words = tokens(F.lower(c))
    chars = F.size(F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda t: ~t.rlike(SP) & (t != ""))))
    return (
        (F.size(words) <= 1)
        | ((F.size(words) >= 6) & (unique_ratio(words) < 0.35))
        | ((chars <= 2) & (F.length(c) >= 4))
    )


def null_like(x: Column | str, listed: list[str] = NULL_LIKE) -> Column:
    """Null or a stand-in for it."""
    return F.coalesce(F.lower(strip_ws(x)).isin(listed), F.lit(True))


def truthy(*xs: Column | str) -> Column:
    """First value that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(_c(x), F.lit("")) for x in xs])


def target_group(x: Column | str) -> Column:
    """A free group name mapped to the enum: exact name, else the first keyword list that hits, else null."""
    k = F.regexp_replace(F.lower(strip_ws(x)), r"[- ]", "_")
    out = F.when(null_like(x), F.lit(None).cast("string")).when(k.isin([g for g, _ in GROUP_KEYWORDS]), k)
    for group, words in GROUP_KEYWORDS:
        out = out.when(k.rlike("|".join(words)), F.lit(group))
    return out
