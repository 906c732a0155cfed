"""Problem 6: a sample whose categories stand in given proportions.

Divisor method: within a category, rows come in random order; the row of rank r has priority (r - 0.5) / target,
rows within the category's floor come before all others, and the rows of smallest priority are kept. A
category that runs out has no further priorities, so its seats go to the others by themselves.

The order within a category only matters up to its number of seats. That number follows from the categories'
counts alone, so the driver computes it from one count per category (as many as there are targets), and the
rows are ranked inside hash ranges: the ranges below the cut are taken whole, the one that holds the cut is
ranked, the rest is dropped. No category is ever sorted in one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.canon import dataset_name
from millrace.operators.splits import range_digits

SEED = 42
SHARE = 0.1


def seats(available: dict, target: dict, floor: dict, n: int) -> dict:
    """Seats of each category among the `n` smallest (floor first, priority, category)."""
    owed = {c: min(floor[c], available.get(c, 0)) if target[c] > 0 else 0 for c in target}
    if sum(owed.values()) >= n:  # the floors take all there is: they are filled in the same order
        return _filled(owed, dict.fromkeys(target, 0), target, n)
    return _filled({c: available.get(c, 0) if target[c] > 0 else 0 for c in target}, owed, target, n)


def _filled(most: dict, least: dict, target: dict, n: int) -> dict:
    """`n` seats by priority (r - 0.5) / target, from `least` up to `most` of each category.

    Whole quotas go first: the level at which they fill n seats is found by setting aside, round by round, the categories
    that it would push beyond their most, or keep below their least. Rounding moves few seats per category, which a heap gives.
    """
    given = {c: min(least[c], most[c]) for c in target}
    free = {c for c in target if target[c] > 0 and given[c] < most[c]}
    fixed = dict(given)
    while free:
        level = max(0.0, n - sum(fixed[c] for c in target if c not in free)) / sum(target[c] for c in free)
        over = {c for c in free if target[c] * level >= most[c]}
        out = over or {c for c in free if target[c] * level <= given[c]}
        if not out:
            for c in free:
                given[c] = max(given[c], min(most[c], int(target[c] * level) - 2 * len(target)))
            break
        for c in out:
            fixed[c] = most[c] if c in over else given[c]
        free -= out
    for c in target:
        given[c] = max(given[c], fixed[c] - 2 * len(target))
    spare = sum(given.values()) - n
    for c in sorted(given, key=lambda c: -(given[c] - least.get(c, 0))):  # rounding never takes this many; kept for safety
        back = max(0, min(spare, given[c] - min(least[c], most[c])))
        given[c] -= back
        spare -= back
    heap = [((given[c] + 0.5) / target[c], c) for c in target if target[c] > 0 and given[c] < most[c]]
    heapq.heapify(heap)
    for _ in range(n - sum(given.values())):
        if not heap:
            break
        _, c = heapq.heappop(heap)
        given[c] += 1
        if given[c] < most[c]:
            heapq.heappush(heap, ((given[c] + 0.5) / target[c], c))
    return given


def random_order(key: Column, seed: int) -> Column:
    """A hex string that orders rows at random, the same way everywhere."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def _targets(targets: DataFrame, strata: list[str]) -> dict:
    rows = targets.collect()  # one row per category
    out: dict = {}
    for r in rows:
        c = tuple(r[s] for s in strata)
        if any(x is None for x in c) or r["target_share"] is None:
            continue
        share, least = out.get(c, (0.0, 0))
        out[c] = (share + max(0.0, float(r["target_share"])), max(least, int(r["min_rows"] or 0)))
    return out


def _counted(rows: DataFrame, targets: DataFrame, strata: list[str], share: float):
    want = _targets(targets, strata)
    n_all = rows.count()
    counts = {tuple(r[s] for s in strata): r["count"] for r in rows.groupBy(*strata).count().join(F.broadcast(targets.select(*strata).distinct()), strata, "left_semi").collect()}
    n = int(n_all * share + 0.5)
    given = seats(counts, {c: s for c, (s, _) in want.items()}, {c: m for c, (_, m) in want.items()}, n)
    return want, counts, given, n


def named(rows: DataFrame) -> DataFrame:
    """Rows with their datasets under their right names."""
    return rows.withColumn("dataset", dataset_name(F.col("dataset")))


def sample(rows: DataFrame, targets: DataFrame, strata: list[str], key: str = "row_id", share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The rows kept, with all their columns.

    `targets` has a row per category: the strata, `target_share`, `min_rows`. Rows of no listed category (a
    null in a stratum included) are never kept, but count towards the sample's size of `share` of all rows
    (rounded half up). Categories listed twice add up. Repeated keys take the same place in the random order
    and go by no further rule; keys are expected to be unique. An empty table or target list gives no rows.
    """
    spark = rows.sparkSession
    _, counts, given, _ = _counted(rows.select(*strata), targets, strata, share)
    digits = range_digits(max(counts.values(), default=0))
    given = {c: g for c, g in given.items() if g}
    if not given:
        return rows.limit(0)
    by = [f"s{i}" for i in range(len(strata))]
    schema = ", ".join(f"{b} {rows.schema[s].dataType.simpleString()}" for b, s in zip(by, strata, strict=True)) + ", seats bigint"
    seat = spark.createDataFrame([(*c, g) for c, g in given.items()], schema)
    # rows travel as one struct, so that their columns may have any names
    keyed = rows.select(F.struct("*").alias("row"), *[F.col(s).alias(b) for b, s in zip(by, strata, strict=True)], F.col(key).alias("key"), random_order(F.col(key), seed).alias("order"))
    keyed = keyed.withColumn("range", F.substring("order", 1, digits)).join(F.broadcast(seat), by)
    w = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keyed.groupBy(*by, "range").agg(F.count("*").alias("inside"), F.first("seats").alias("seats"))  # as many rows a category as ranges
    ranges = ranges.select(*by, "range", "inside", (F.col("seats") - F.coalesce(F.sum("inside").over(w), F.lit(0))).alias("room")).where("room > 0")
    near = keyed.drop("seats").join(F.broadcast(ranges), [*by, "range"])
    r = Window.partitionBy(*by, "range").orderBy("order", "key")
    part = near.where("room < inside").withColumn("rank", F.row_number().over(r)).where("rank <= room")
    return near.where("room >= inside").select("row").unionByName(part.select("row")).select("row.*")


def report(rows: DataFrame, targets: DataFrame, strata: list[str], share: float = SHARE) -> DataFrame:
    """One row per category: target share and floor, rows there are, seats, the share reached, and what was not met.

    `unmet` is null where the share lies within one seat of its target and the floor is reached; else `absent`
    (no such rows), `floor` (fewer rows than the floor), `exhausted` (all its rows taken, too few) or `shifted`
    (more seats than its share, taken over from exhausted categories or owed to its floor).
    """
    spark = rows.sparkSession
    want, counts, given, n = _counted(rows.select(*strata), targets, strata, share)
    out = []
    for c, (s, least) in sorted(want.items()):
        have, got = counts.get(c, 0), given.get(c, 0)
        unmet = None
        if got < min(n * s, max(n, 0)) - 1 or got < least:
            unmet = "absent" if not have else "floor" if have < least else "exhausted"
        elif got > n * s + 1:
            unmet = "shifted"
        out.append((*c, s, least, have, got, round(got / n, 6) if n else 0.0, unmet))
    types = [rows.schema[x].dataType.simpleString() for x in strata]
    head = ", ".join(f"`{x}` {t}" for x, t in zip(strata, types, strict=True))
    return spark.createDataFrame(out, head + ", target_share double, min_rows bigint, available bigint, sampled bigint, share double, unmet string")
