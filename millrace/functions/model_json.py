"""Answers of language models that should be JSON: fences off, the last balanced object found and parsed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

FIELDS = ("target_group", "visual_evidence", "implicit_meaning")
SCHEMA = StructType([StructField(f, StringType()) for f in FIELDS] + [StructField("parse_error", BooleanType()), StructField("raw_output", StringType())])


def last_object(text: str) -> str | None:
    """The last span of balanced braces, found from the right; braces in strings count like any others."""
    end = text.rfind("}")
    if end < 0:
        return None
    depth = 0
    for i in range(end, -1, -1):
        depth += (text[i] == "}") - (text[i] == "{")
        if depth == 0:
            return text[i : end + 1]
    return None


def parse(text: str | None) -> dict:
    """The three fields, or nulls with parse_error and the raw text."""
    t = (text or "").strip()
    t = re.sub(r"^```(?:json)?\s*|\s*```$", "", t)
    t = re.sub(r"^json\s*\n", "", t)
    body = last_object(t)
    try:
        got = json.loads(body) if body else None
    except ValueError:
        got = None
    if not isinstance(got, dict):
        return dict.fromkeys(FIELDS) | {"parse_error": True, "raw_output": text}
    clean = {f: None if got.get(f) is None else got[f] if isinstance(got[f], str) else json.dumps(got[f]) for f in FIELDS}
    return clean | {"parse_error": False, "raw_output": None}


@F.pandas_udf(SCHEMA)
def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The struct of a model's answer; null is a parse error."""
    for s in batches:
        yield pd.DataFrame([parse(x) for x in s], columns=[*FIELDS, "parse_error", "raw_output"])
