"""Problem 8: texts packed into containers of fixed capacity, through windows of several lengths.

A text is routed to the tier of the shortest window that holds it. Each tier is packed into windows of its own
length, from the longest down; what a window has left is filled from shorter tiers. Windows then make up the
containers: as many of one length as fit, and a few mixed ones at the end. A finer ladder of tiers keeps short texts in
short windows (which is what attention is paid over), but where short texts are too few to fill the windows it wastes
space; `plan` takes the finest ladder that needs no more than SLACK more containers than the best one.

Sizes are whole numbers from 1 to the capacity, so all this is computed on their histogram, which has as many entries
as the capacity has tokens however large the corpus is. Rows find their window by their rank among those of equal
size; sizes with many rows are ranked in hash buckets whose number follows from their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tokenizer import FOLDER, VOCABULARY, token_counts
from millrace.session import stored

CAPACITY = 2048
TIERS = (256, 512, 1024, 2048)
#: Share of containers that a finer ladder of tiers may cost.
SLACK = 0.0005
#: Rows of one size that one task ranks, about.
RANKED = 1_000_000
#: Containers that one training step takes.
STEP = 64


@dataclass
class Plan:
    """Where the rows of each size go.

    Slots, sorted by (size, first rank): the tier of the window, the number of the first window, and over how many
    windows the slot's ranks go round. For each tier: windows in a container, containers of that tier alone, the first
    of them, and the containers of the windows left over.
    """

    tiers: np.ndarray
    size: np.ndarray
    first: np.ndarray
    tier: np.ndarray
    base: np.ndarray
    times: np.ndarray
    per: np.ndarray
    alone: np.ndarray
    start: np.ndarray
    mixed: np.ndarray
    containers: int
    tokens: int

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window length, container) for rows of the sizes, by their ranks among equal ones."""
        wide = np.int64(1) << 42
        slot = np.searchsorted(self.size * wide + self.first, size * wide + rank, side="right") - 1
        t, w = self.tier[slot], self.base[slot] + (rank - self.first[slot]) % self.times[slot]
        full = self.alone[t] * self.per[t]
        left = np.clip(w - full, 0, self.mixed.shape[1] - 1)
        return self.tiers[t], np.where(w < full, self.start[t] + w % np.maximum(self.alone[t], 1), self.mixed[t, left])


def windows(histogram: np.ndarray, tiers: tuple[int, ...]) -> dict[int, list[tuple[int, int, list[tuple[int, int]]]]]:
    """For each tier its windows as patterns (tokens, times, [(size, how many)]); tiers in rising order.

    Each step builds one pattern - the tier's largest size left, then always the largest size that fits into the
    gap, of whatever tier - and repeats it as often as its sizes allow, so every step uses some size up.
    """
    left = histogram.copy()
    out: dict[int, list[tuple[int, int, list[tuple[int, int]]]]] = {t: [] for t in tiers}
    for top, below in zip(tiers[::-1], (*tiers[-2::-1], 0), strict=True):
        while (sizes := np.flatnonzero(left[below + 1 : top + 1])).size:
            gap, content = top, {}
            largest = int(sizes[-1]) + below + 1
            while largest:
                fit = int(min(gap // largest, left[largest]))
                content[largest] = fit
                gap -= fit * largest
                smaller = np.flatnonzero(left[1 : min(gap, largest - 1) + 1])
                largest = int(smaller[-1]) + 1 if smaller.size else 0
            times = min(int(left[s]) // k for s, k in content.items())
            for s, k in content.items():
                left[s] -= times * k
            out[top].append((top - gap, times, list(content.items())))
    return out


def composed(patterns: dict[int, list[tuple[int, int, list[tuple[int, int]]]]], capacity: int) -> Plan:
    """Windows put together to containers; those of one tier in the order of their fill, so that neighbours are alike."""
    tiers = sorted(patterns)
    taken = np.zeros(capacity + 1, np.int64)
    slots, count, tokens = [], [], 0
    for i, t in enumerate(tiers):
        base = 0
        for filled, times, content in sorted(patterns[t], key=lambda p: (-p[0], len(p[2]))):
            for s, k in content:
                slots.append((s, int(taken[s]), i, base, times))
                taken[s] += times * k
            base += times
            tokens += filled * times
        count.append(base)
    per = np.array([capacity // t for t in tiers])
    alone = np.array(count) // per
    start = np.cumsum(alone) - alone
    room: list[int] = []  # of the mixed containers
    mixed = np.zeros((len(tiers), max(1, int(per.max()))), np.int64)
    for i in range(len(tiers) - 1, -1, -1):
        for j in range(count[i] - int(alone[i] * per[i])):
            at = next((c for c, r in enumerate(room) if r >= tiers[i]), len(room))
            if at == len(room):
                room.append(capacity)
            room[at] -= tiers[i]
            mixed[i, j] = int(alone.sum()) + at
    a = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return Plan(np.array(tiers), a[:, 0], a[:, 1], a[:, 2], a[:, 3], a[:, 4], per, alone, start, mixed, int(alone.sum()) + len(room), tokens)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, slack: float = SLACK) -> Plan:
    """The packing of a histogram of sizes: the finest ladder within `slack` of the fewest containers that any ladder needs.

    Ladders are `tiers`, and `tiers` without their shortest ones; the capacity is always the longest window.
    """
    left = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        if not 1 <= s <= capacity:
            raise ValueError(f"size {s} is not between 1 and {capacity}")
        left[s] = n
    ladder = tuple(sorted({t for t in tiers if t < capacity} | {capacity}))
    plans = [composed(windows(left, ladder[i:]), capacity) for i in range(len(ladder))]
    fewest = min(p.containers for p in plans)
    return next(p for p in plans if p.containers <= fewest * (1 + slack))


def step_group(container: np.ndarray, containers: int, step: int) -> np.ndarray:
    """Groups of `step` containers, dealt in turns, so that tiers and fuller and less full containers are spread evenly."""
    groups = max(1, -(-containers // step))
    turn, at = container // groups, container % groups
    return np.where(turn % 2 == 0, at, groups - 1 - at)


def pack(sizes: DataFrame, key: str = "doc_id", n: str = "n_tokens", capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, step: int = STEP, ranked: int = RANKED) -> DataFrame:
    """(key, piece, start, n_tokens, tier, window, container, step_group) for every row of `sizes`.

    `tier` is the shortest window that would hold the piece, `window` the length of the one it is in. A size over the
    capacity is split into full pieces and a rest, no other is. Rows of no tokens (or a null size) take no space:
    piece 0, the last four null. Rows of equal size are interchangeable; repeated keys are packed row by row.
    """
    spark = sizes.sparkSession
    c = F.lit(capacity)
    total = F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(0)).cast("long")
    rows = sizes.select(F.col(key).alias("key"), total.alias("total"))
    pieces = stored(
        rows.select(
            "key",
            F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / c).cast("int") - 1, F.lit(0)))).alias("piece"),
            "total",
        ).select(
            "key",
            "piece",
            (F.col("piece").cast("long") * c).alias("start"),
            F.least(c.cast("long"), F.col("total") - F.col("piece").cast("long") * c).cast("int").alias("size"),
        )
    )
    per_size = np.zeros(capacity + 1, np.int64)
    for r in pieces.where("size > 0").groupBy("size").count().collect():  # at most as many rows as the capacity
        per_size[r["size"]] = r["count"]
    p = plan({int(s): int(per_size[s]) for s in np.flatnonzero(per_size)}, capacity, tiers)
    buckets = np.maximum(1, -(-per_size // ranked))
    of_size = F.element_at(F.lit(buckets.astype(np.int32).tolist()), F.col("size") + 1)
    full = pieces.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), of_size).cast("int"))
    # rows of a size before those of a bucket; only sizes with several buckets are counted again
    offset = np.cumsum(buckets) - buckets
    before = np.zeros(int(buckets.sum()), np.int64)
    many = [int(s) for s in np.flatnonzero(buckets > 1)]
    if many:
        for r in full.where(F.col("size").isin(many)).groupBy("size", "bucket").count().toLocalIterator():
            before[offset[r["size"]] + r["bucket"]] = r["count"]
        for s in many:
            own = before[offset[s] : offset[s] + buckets[s]]
            own[:] = np.cumsum(own) - own
    shared = spark.sparkContext.broadcast((p, offset, before, np.array(sorted({*tiers, capacity}))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, offset, before, levels = shared.value
        for b in batches:
            size, bucket, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4, 5))
            nil = size <= 0
            s, r = np.where(nil, 1, size), np.where(nil, 0, rank + before[offset[np.where(nil, 0, size)] + bucket])
            window, container = p.find(s, r) if len(p.size) else (s, s)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), b.column(2), pa.array(size), pa.array(levels[np.searchsorted(levels, s)].astype(np.int32), mask=nil), pa.array(window.astype(np.int32), mask=nil),
                    pa.array(container, mask=nil), pa.array(step_group(container, p.containers, step), mask=nil),
                ],
                names,
            )

    names = [key, "piece", "start", "n_tokens", "tier", "window", "container", "step_group"]
    # rows of no tokens take no rank, so that a third of all rows being empty is no large group
    w = Window.partitionBy("size", "bucket").orderBy("key", "piece")
    full = full.withColumn("rank", F.row_number().over(w).cast("long") - 1)
    none = pieces.where("size <= 0").withColumns({"bucket": F.lit(0), "rank": F.lit(0).cast("long")})
    kind = sizes.schema[key].dataType.simpleString()
    return full.unionByName(none).mapInArrow(
        place, f"`{key}` {kind}, piece int, start bigint, n_tokens bigint, tier int, window int, container bigint, step_group bigint"
    )


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """`pack` with the sizes of the texts in tokens of a public tokenizer; null and empty texts have none."""
    return pack(token_counts(docs, key, text, folder, name), key, "n_tokens", capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the fewest containers that could hold them, and the share of space used."""
    per = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.coalesce(F.ceil(F.sum("used") / F.lit(capacity)), F.lit(0)).cast("long").alias("fewest"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * F.lit(capacity)), 6).alias("fill"),
    )
