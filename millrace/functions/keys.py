"""Keys and paths: record keys, hash shards, normal forms of paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import squeeze


def normal_path(path: Column) -> Column:
    """The shortest form of a path with forward slashes; null and empty give `.`. A leading slash stays.

    Parts are folded over a stack: `.` and empty parts vanish, `..` takes the part before it away, unless there
    is none (then it stays in a relative path and vanishes in an absolute one).
    """
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    rooted = p.startswith("/")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))

    # element_at of an empty array is an error, so folding starts from a mark that is taken off again
    folded = F.aggregate(parts, F.array(F.lit("..")), lambda s, x: F.when(x == "..", _up(s, rooted)).otherwise(F.concat(s, F.array(x))))
    body = F.array_join(F.slice(folded, F.lit(2), F.size(folded)), "/")
    return F.when(rooted, F.concat(F.lit("/"), body)).otherwise(F.when(body == "", F.lit(".")).otherwise(body))


def _up(stack: Column, rooted: Column) -> Column:
    top_is_name = (F.size(stack) > 1) & (F.element_at(stack, -1) != "..")
    return F.when(top_is_name, F.slice(stack, F.lit(1), F.size(stack) - 1)).when(rooted, stack).otherwise(F.concat(stack, F.array(F.lit(".."))))


def explanation_key(ident: Column, image: Column) -> Column:
    """The id, or the path of the picture where the id is blank."""
    i = F.trim(F.coalesce(ident, F.lit("")))
    return F.when(i != "", i).otherwise(normal_path(image))


def rewrite_key(ident: Column, image: Column, text: Column) -> Column:
    """`id::` and the id, else `imgtxt::` with path and text."""
    i = F.trim(F.coalesce(ident, F.lit("")))
    return F.when(i != "", F.concat(F.lit("id::"), i)).otherwise(F.concat_ws("::", F.lit("imgtxt"), normal_path(image), squeeze(F.coalesce(text, F.lit("")))))


def md5_shard(key: Column, shards: int) -> Column:
    """The md5 of the key, read as one number, modulo `shards`: Horner's rule over chunks of 32 bits."""
    h = F.md5(key)
    chunks = [F.conv(F.substring(h, i, 8), 16, 10).cast("long") for i in (1, 9, 17, 25)]
    return reduce(lambda acc, c: (acc * F.lit(4294967296 % shards) + c) % shards, chunks, F.lit(0).cast("long")).cast("int")


def shard_tag(shard: Column, shards: int) -> Column:
    return F.format_string(f"shard%02dof{shards:02d}", shard)


def stem(path: Column) -> Column:
    """File name without directories and the last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def seeded(key: Column, seed: int) -> Column:
    """A hex string that puts rows into a random order, equal on every engine with md5."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
