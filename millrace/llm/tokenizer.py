"""Problem 7: every document as the ids of a public byte-level BPE.

The ranks and the pattern come from a folder of public vocabularies (parameter `folder`). A worker process
loads them once. Long texts are cut before encoding at places that no match of the pattern crosses, so the
ids are those of the whole text and one piece never grows with the document.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

FOLDER = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Characters from which a text is cut into pieces before it is encoded.
PIECE = 20_000


@functools.lru_cache(maxsize=4)
def encoding(folder: str = FOLDER, name: str = VOCABULARY):
    """The tiktoken encoding of a rank file, with the pattern that the folder's module states."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("vocabulary_folder", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut after at least `size` characters, before a blank that stands between two other characters.

    There the pattern always ends one match and begins the next, so encoding the pieces one by one gives the
    ids of the whole. Where no such blank comes, the piece stays long.
    """
    pieces, start, n = [], 0, len(text)
    while n - start > size:
        at = text.find(" ", start + size)
        while at != -1 and (at + 1 >= n or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        pieces.append(text[start:at])
        start = at
    pieces.append(text[start:])
    return pieces


def encode(text: str | None, enc) -> list[int]:
    """Ids without special tokens (their strings are ordinary text); null and empty give an empty list."""
    if not text:
        return []
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text) for i in enc.encode_ordinary(piece)]


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each row's text, in no shuffle.

    Null and empty texts give an empty array, blank ones the ids of their blanks. Repeated rows and keys are
    encoded row by row; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for b in batches:
            rows = [encode(t, enc) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.fromiter((i for r in rows for i in r), np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"])

    rows = spread(docs.select(F.col(key), F.col(text).cast("string")))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) as `token_ids`, without shipping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for b in batches:
            n = pa.array([len(encode(t, enc)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], [key, "n_tokens"])

    rows = spread(docs.select(F.col(key), F.col(text).cast("string")))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint")


def decoded(ids: DataFrame, key: str = "doc_id", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(key, text): the ids turned back through raw bytes; a list without ids gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for b in batches:
            texts = [enc.decode_bytes(r or []).decode("utf-8", "replace") for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"`{key}` {ids.schema[key].dataType.simpleString()}, text string")
