"""The text expressions of `functions.text` in DuckDB's dialect (RE2: no lookaround, no back references)."""

from __future__ import annotations

from millrace.functions.text import GROUP_KEYWORDS, LABELS, NULL_LIKE, TLDS

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
NS = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def sub(x: str, pattern: str, by: str, flags: str = "g") -> str:
    p = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{p}', '{by}', '{flags}')" if flags else f"regexp_replace({x}, '{p}', '{by}')"


def strip(x: str) -> str:
    return sub(x, f"^{SP}+|{SP}+$", "")


def squeeze(x: str) -> str:
    return f"trim({sub(x, SP + '+', ' ')})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{SP}+'), lambda t: t <> '')"


def compare(x: str) -> str:
    return f"trim({sub(f'lower(coalesce({x}, {chr(39) * 2}))', NW + '+', ' ')})"


def compare_words(x: str) -> str:
    return f"list_filter(string_split({compare(x)}, ' '), lambda t: t <> '')"


def urls(x: str) -> str:
    return sub(x, rf"(^|{NW})(?i:https?://|www\.){NS}*{W}", r"\1 ")


def domains(x: str) -> str:
    return sub(x, rf"(^|{NW})(?i:[a-z0-9][a-z0-9-]{{1,62}}\.(?:{'|'.join(TLDS)}))(?:/{NS}*{W}|\b)", r"\1 ")


def mentions(x: str) -> str:
    return sub(x, f"(^|{NW})@{W}+", r"\1 ")


def hashtags(x: str) -> str:
    return sub(x, f"(^|{NW})#{W}+", r"\1 ")


def label(x: str) -> str:
    return sub(x, rf"(?i)^{SP}*(?:{'|'.join(LABELS)}){SP}*:{SP}*", "", "")


def collapse(x: str) -> str:
    for c in "!?.,;:":
        x = sub(x, f"[{c}]{{3,}}", c)
    return x


def sanitize(x: str) -> str:
    c = strip(f"coalesce({x}, '')")
    c = strip(f"string_split({c}, '[/INST]')[-1]")
    lines = f"string_split({c}, chr(10))"
    c = f"CASE WHEN starts_with({c}, '```') THEN array_to_string(list_slice({lines}, 2, CASE WHEN starts_with({lines}[-1], '```') AND len({lines}) > 1 THEN len({lines}) - 1 ELSE len({lines}) END), ' ') ELSE {c} END"
    c = sub(label(c), r"[\r\n]+", " ")
    c = domains(urls(hashtags(mentions(c))))
    c = collapse(sub(c, "[•�]", " "))
    c = squeeze(sub(c, rf"{SP}+([!?.,;:])", r"\1"))
    return strip(sub(c, "^[\"'` ]+|[\"'` ]+$", ""))


def symbols(x: str) -> str:
    kept = sub(f"coalesce({x}, '')", r"[\p{L}\p{N}\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]", "")
    return f"(length({kept})::DOUBLE / greatest(length(coalesce({x}, '')), 1))"


def unique(w: str) -> str:
    return f"(len(list_distinct({w}))::DOUBLE / greatest(len({w}), 1))"


def most(w: str) -> str:
    return f"(coalesce(list_max(list_transform(list_distinct({w}), lambda u: len(list_filter({w}, lambda t: t = u)))), 0)::DOUBLE / greatest(len({w}), 1))"


def overlap(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda u: least(len(list_filter({a}, lambda t: t = u)), len(list_filter({b}, lambda t: t = u))))), 0)::DOUBLE"


def null_like(x: str) -> str:
    listed = ", ".join(f"'{v}'" for v in NULL_LIKE)
    return f"coalesce(lower({strip(x)}) IN ({listed}), true)"


def target_group(x: str) -> str:
    k = f"replace(replace(lower({strip(x)}), ' ', '_'), '-', '_')"
    names = ", ".join(f"'{g}'" for g, _ in GROUP_KEYWORDS)
    rules = " ".join(f"WHEN regexp_matches({k}, '{'|'.join(words)}') THEN '{g}'" for g, words in GROUP_KEYWORDS)
    return f"CASE WHEN {null_like(x)} THEN NULL WHEN {k} IN ({names}) THEN {k} {rules} END"
