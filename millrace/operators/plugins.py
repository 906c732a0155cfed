"""Model boundary: scorers and generators run in mapInPandas with one model per Python worker.

The ones that ship are deterministic stand-ins. They make pipelines run and tests repeatable; they are no models
and their scores mean nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Scorer(Protocol):
    def score(self, rows: pd.DataFrame) -> list[float | None]: ...


class Generator(Protocol):
    def generate(self, rows: pd.DataFrame, n: int) -> list[list[str]]: ...


class VowelShare:
    """Stand-in for a text scorer: the share of vowels among the letters; null for no letters."""

    def __init__(self, text: str):
        self.text = text

    def score(self, rows: pd.DataFrame) -> list[float | None]:
        out = []
        for t in rows[self.text]:
            letters = [c for c in (t or "").lower() if "a" <= c <= "z"]
            out.append(sum(c in "aeiou" for c in letters) / len(letters) if letters else None)
        return out


class DropWords:
    """Stand-in for a rewriter: candidate i leaves out every (i + 2)-th word."""

    def __init__(self, text: str):
        self.text = text

    def generate(self, rows: pd.DataFrame, n: int) -> list[list[str]]:
        return [[" ".join(w for j, w in enumerate((t or "").split(), 1) if j % (i + 2)) for i in range(n)] for t in rows[self.text]]


_MODELS: dict[str, object] = {}


def _made(token: str, make: Callable):
    """The model of a call of `scored` or `candidates`, made once per Python worker: tasks get other copies of `make`, but the same token."""
    if token not in _MODELS:
        if len(_MODELS) >= 8:
            _MODELS.clear()
        _MODELS[token] = make()
    return _MODELS[token]


def scored(df: DataFrame, make: Callable[[], Scorer], name: str = "score") -> DataFrame:
    """Adds a score. A batch that fails is scored row by row, a row that fails gets null."""
    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _made(token, make)
        for b in batches:
            try:
                s = model.score(b)
            except Exception:
                s = []
                for i in range(len(b)):
                    try:
                        s += model.score(b.iloc[i : i + 1])
                    except Exception:
                        s.append(None)
            yield b.assign(**{name: pd.Series(s, index=b.index, dtype="float64")})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` double")


def candidates(df: DataFrame, make: Callable[[], Generator], key: str, n: int) -> DataFrame:
    """(key, cand, rewrite): n candidates of each row."""
    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _made(token, make)
        for b in batches:
            got = model.generate(b, n)
            rows = [(k, i, t) for k, ts in zip(b[key], got, strict=True) for i, t in enumerate(ts)]
            yield pd.DataFrame(rows, columns=[key, "cand", "rewrite"])

    return df.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, cand int, rewrite string")
