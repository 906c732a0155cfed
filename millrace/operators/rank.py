"""The best of several candidates, over one attempt or several."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.operators.dedupe import first_wins
from millrace.session import cut

#: Words of an ideal rewrite.
IDEAL = 12


def candidate_order(text: str = "rewrite") -> list[Column]:
    """Better candidates first: valid, non-empty, passing, then scores, length near the ideal, shorter."""
    no = F.lit(False)
    sta, bert, drop = (F.coalesce(c, no) for c in ("passes_sta", "passes_bertscore", "passes_toxicity_delta"))
    return [
        F.coalesce("format_valid", no).desc(),
        (F.trim(F.coalesce(text, F.lit(""))) != "").desc(),
        (sta & bert & drop).desc(),
        (sta & drop).desc(),
        bert.desc(),
        F.coalesce("bertscore", F.lit(-1.0)).desc(),
        F.coalesce("sta_score", F.lit(-1.0)).desc(),
        F.coalesce("toxicity_drop", F.lit(-1.0)).desc(),
        F.abs(F.size(tokens(text)) - IDEAL).asc(),
        F.length(F.coalesce(text, F.lit(""))).asc(),
    ]


def best(df: DataFrame, slot: str, *tie: str, text: str = "rewrite") -> DataFrame:
    """The best candidate of each slot; ties go to the smallest `tie` (attempt and candidate number)."""
    return first_wins(df, F.col(slot), *candidate_order(text), *tie)


def with_retries(items: DataFrame, key: str, generate: Callable[[DataFrame, int], DataFrame], passed: Column, attempts: int = 2) -> DataFrame:
    """Candidates of up to `attempts` rounds; each round works on the keys that no round before it resolved.

    `generate(rows, attempt)` returns candidates with `key`. Lineage is cut after each round, so the plan does
    not grow with them.
    """
    todo, out = items, None
    for attempt in range(1, attempts + 1):
        got = cut(generate(todo, attempt).withColumn("attempt", F.lit(attempt)))
        out = got if out is None else out.unionByName(got)
        if attempt < attempts:
            todo = cut(todo.join(got.where(passed).select(key).distinct(), key, "left_anti"))
    return out
