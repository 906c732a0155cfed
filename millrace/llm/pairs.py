"""Problem 1: prompt and response pairs whose response is unusable, with the kind of defect.

Copies are told by compression: the letters of the response are packed with those of the prompt as a zstandard
dictionary, and the other way round. A copy leaves nothing to say in either direction; each real change of a word costs
some bytes. Only the outermost letters, where no match is long enough to pay, are compared as they are. Empty
responses and refusals go by dictionaries, other languages by function words, cut responses by the terminal-context
model.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import LABELS, NULL_LIKE
from millrace.llm import endings
from millrace.llm.canon import dataset_name
from millrace.llm.truncation import judge, limits
from millrace.llm.words import WORD, language_counts
from millrace.session import spread

#: Bytes that a copy may take beyond those that the original takes under itself. A changed word takes 3 at least, 6 mostly.
MOST_NEW = 1
#: Bytes on either end that no match of the compressor may reach: these are compared one by one, and shorter texts as a whole.
EDGE = 8

#: How a refusal says that it won't, and what it won't do, in four languages.
DECLINES = re.compile(
    r"\b(?:(?:i|we)(?: a|')?m (?:not able|unable|sorry|not comfortable)|(?:i|we) (?:am|are) (?:unable|sorry|not able)|unable to|not able to|(?:i|we) (?:must|have to|need to) (?:decline|pass|refuse|reject)|"
    r"(?:can ?not|can'?t|won'?t|will not|could not|couldn'?t|would not|don'?t|do not|decline to|refuse to)\b.{0,40}?\b(?:rewrite|rewriting|paraphras\w+|assist|help|provide|creat\w+|generat\w+|produc\w+|complet\w+|fulfil\w*|comply|do)|"
    r"no rewrite|(?:is|goes|are) against|against (?:my|our|the) \w+|inappropriate (?:for|to)|as an? (?:ai|language model|assistant)|my apologies|declin\w+|"
    r"kann ich (?:leider )?nicht|tut mir leid|nicht in der lage|lehne ich ab|no puedo|lo siento|me niego|je ne peux pas|désolée?|je refuse|impossible de)",
    re.I,
)
OBJECT = re.compile(
    r"\b(?:rewrit\w+|paraphras\w+|request\w*|contents?|captions?|texts?|memes?|guidelines?|polic(?:y|ies)|material|version|language model|assist\w*|harmful|hateful|offensive|stereotypes?|safety|"
    r"umformulier\w+|anfrage|inhalt\w*|texte?n?|reescrib\w+|solicitud|contenido|réécri\w+|demande|contenu)\b",
    re.I,
)
#: A label that generated text may begin with; what follows it is the response.
LABEL = re.compile(r"^\s*(?:" + "|".join(LABELS) + r")\s*:\s*", re.I)
#: Characters around declining words in which what they decline must be named.
NEAR = 200
QUOTES = str.maketrans({"’": "'", "‘": "'"})


def canonical(text: str) -> str:
    """Letters and digits only, without case; marks of any kind, signs and white space left out, emoji kept."""
    return "".join(c for c in unicodedata.normalize("NFC", text).casefold() if c.isalnum() or unicodedata.category(c) in ("So", "Mn", "Mc"))


def caption_of(prompt: str) -> str:
    """What follows the bracketed parts of a prompt `[T: …] [V: …] [M: …] | caption`."""
    return prompt.split("] | ", 1)[1] if prompt.startswith("[") and "] | " in prompt else prompt


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    letters = re.sub(r"[\W_]+", " ", LABEL.sub("", response)).strip().lower()
    return not letters or letters in {re.sub(r"[\W_]+", " ", x) for x in NULL_LIKE} or bool(endings.ERROR.match(response))


def packed(text: bytes, dictionary: bytes) -> int:
    """Bytes that a text takes with another as its dictionary."""
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False).compress(text))


def new_bytes(text: bytes, original: bytes) -> int:
    """What each of two texts says that the other doesn't, in packed bytes; the larger of both directions.

    The frame and the one match that a text is under itself are taken off. Both texts must have EDGE bytes or more.
    """
    forth = packed(text, original) - packed(original, original)
    return forth if forth > MOST_NEW else max(forth, packed(original, text) - packed(text, text))


def copied(text: str, original: str) -> bool:
    """Whether letters repeat the original's letters, all of them and no others."""
    a, b = text.encode(), original.encode()
    if min(len(a), len(b)) < 2 * EDGE:
        return a == b
    return new_bytes(a, b) <= MOST_NEW and a[:EDGE] == b[:EDGE] and a[-EDGE:] == b[-EDGE:]


def is_copy(response: str, prompt: str) -> bool:
    """Whether the response, a label before it aside, repeats the caption or the whole prompt but for case, spacing and marks."""
    whole, caption = canonical(prompt), canonical(caption_of(prompt))
    forms = {canonical(response), canonical(LABEL.sub("", response))} - {""}
    return any(copied(r, p) for r in forms for p in {whole, caption} - {""})


def is_refusal(response: str) -> bool:
    """Whether some words decline, and what they decline stands within NEAR characters of them; the length doesn't matter."""
    t = response.translate(QUOTES)
    return any(OBJECT.search(t, max(0, m.start() - NEAR), m.end() + NEAR) for m in DECLINES.finditer(t))


def other_language(response: str, caption: str) -> bool:
    """Whether the response's language is another than the caption's; both must show it clearly."""
    a, b = ([w for w in WORD.findall(re.sub(r"(?:https?://|www\.)\S+|[@#]\w+", " ", x.lower()))] for x in (caption, response))
    ca, cb = language_counts(a), language_counts(b)
    la, lb = max(ca, key=ca.get), max(cb, key=cb.get)
    return la != lb and ca[la] >= 2.5 and cb[lb] >= 2.5 and ca[la] >= 1.5 * ca[lb] + 1 and cb[lb] >= 1.5 * cb[la] + 1


def defect(prompt: str | None, response: str | None, model: endings.Model, marks: dict, source: str = "") -> str | None:
    """The defect of a pair, or None. The first that applies counts: empty, copy, refusal, other_language, truncated."""
    if is_empty(response):
        return "empty"
    prompt = prompt or ""
    if is_copy(response, prompt):
        return "copy"
    if is_refusal(response):
        return "refusal"
    if other_language(response, caption_of(prompt)):
        return "other_language"
    return "truncated" if judge(response, source, model, marks) else None


def defects(rows: DataFrame, key: str = "row_id", prompt: str = "input_text", response: str = "target_text", source: str | None = "dataset") -> DataFrame:
    """(key, source, defect) for every row; `defect` is null for a usable response, `source` the right name of its dataset.

    A null response is `empty`; a null prompt counts as an empty one, of which nothing is a copy and which has
    no language. Repeated rows come out each; whole texts are read. An empty table gives no rows.
    """
    spark = rows.sparkSession
    name = dataset_name(F.coalesce(F.col(source), F.lit(""))) if source else F.lit("")
    data = rows.select(F.col(key).alias("key"), F.col(prompt).cast("string").alias("prompt"), F.col(response).cast("string").alias("response"), name.alias("source"))
    vocabulary, n = endings.vocabulary(data, "response")
    model = endings.fit(endings.sample_closed(data, "response", "key", n), vocabulary)
    shared = spark.sparkContext.broadcast((model, limits(data.where("response is not null"), "source", "response")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, marks = shared.value
        for b in batches:
            got = [defect(p, r, model, marks, s) for p, r, s in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(got, pa.string())], ["key", "source", "defect"])

    out = spread(data).mapInArrow(run, f"key {rows.schema[key].dataType.simpleString()}, source string, defect string")
    return out.withColumnRenamed("key", key)


def found(rows: DataFrame) -> DataFrame:
    """(row_id, defect) of the defective rows."""
    return defects(rows).where("defect is not null").select("row_id", "defect")


def rates(rows: DataFrame) -> DataFrame:
    """(dataset, defect, n): rows by dataset and kind of defect, `none` for usable ones."""
    return defects(rows).groupBy(F.col("source").alias("dataset"), F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n"))
