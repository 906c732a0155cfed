"""Canonical forms of texts, paths and names that several operators share, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of panels in reading order.
PANELS = [("top", "bottom"), ("left", "right"), ("before", "after")]

#: Marks, separators, control and invisible characters, and mathematical or modifier signs. Other symbols (emoji) stay.
#: Plain letters and digits are told apart first, as they are most of a text.
_IGNORED = r"[[^a-z0-9]&&[\p{P}\p{Z}\p{C}\p{Sm}\p{Sk}\p{Sc}\s\x{FE0F}]]+"


def ordered_panels(text: Column) -> Column:
    """A text of two named panels that names the later one first, turned into reading order.

    Any notation counts in which each name is followed by a mark (`:`, `=`, `]`, quotes and so on) and the
    second name is set off from the first panel's words by a mark or a line break. Other texts stay.
    """
    mark = r"""[\s]*["'”’»\*\]\)]*[\s]*[:=\]\)\}\|–—-]["\s]*"""
    gap = r"(?:[^\p{L}\p{N}]*[^\p{L}\p{N}\s][^\p{L}\p{N}]*|[ \t]*[\r\n]\s*)"
    out = text
    for first, second in PANELS:
        out = F.regexp_replace(out, rf"(?is)^([^\p{{L}}\p{{N}}]*){second}{mark}(.*?){gap}{first}{mark}(.*)$", f"{first} $3 {second} $2")
    late = "|".join(second for _, second in PANELS)
    return F.when(text.rlike(rf"(?i)^[^\p{{L}}\p{{N}}]*(?:{late})[^\p{{L}}\p{{N}}]"), out).otherwise(text)


def bare(text: Column) -> Column:
    """Lower case, and nothing but letters, digits, accents and emoji: equal for texts that differ in formatting only.

    Escapes of line breaks and tabs in a text written as JSON count as white space.
    """
    t = F.when(text.rlike(r'^\s*\{\s*"'), F.regexp_replace(text, r"\\[nrt]", " ")).otherwise(text)
    low = F.lower(ordered_panels(t))
    return F.replace(F.replace(F.regexp_replace(low, _IGNORED, ""), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def has_letters(text: Column, least: int) -> Column:
    """Whether there are `least` letters and digits; reads no further than the last of them."""
    return F.coalesce(text.rlike(rf"(?:[\p{{L}}\p{{N}}][^\p{{L}}\p{{N}}]*+){{{least}}}"), F.lit(False))


def dataset_name(name: Column) -> Column:
    """The right name of a dataset: lower case without blanks, dashes and underscores."""
    return F.lower(F.regexp_replace(name, r"[\s\p{Z}_-]+", ""))


def clean_path(path: Column) -> Column:
    """A file path in its shortest form: forward slashes, no `.`, no `name/..`, no doubled slashes. Blank gives null."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"/{2,}", "/")
    p = F.regexp_replace(p, r"(?<=^|/)(?:\./)+", "")
    for _ in range(4):  # nested parents are rare; each round resolves one level
        p = F.regexp_replace(p, r"(?:(?<=^|/))(?!\.\./)[^/]+/\.\./", "")
    p = F.when(path.rlike(r"\\|//|(?:^|/)\.|^ | $"), p).otherwise(path)  # most paths are clean
    return F.nullif(p, F.lit(""))
