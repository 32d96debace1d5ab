"""Filling fixed-capacity containers: best-two-fit over the histogram of sizes.

Sizes are whole tokens of at most the capacity, so a corpus of any size has at
most ``capacity`` different sizes. The packing works on their counts: a bin is
filled greedily, largest size first; then its smallest size is replaced by the
two unpacked sizes that fit its gap and that size's room more tightly. The bin
found is repeated as long as the counts last, which empties at least one size (or
leaves fewer of it than the bin needs), so the number of different bins follows
the number of sizes, not of documents. Documents are then numbered within their
size and looked up in the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents numbered by one task at a time.
BLOCK_ROWS = 50_000


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as ``({size: how many}, repeats)`` for ``counts[size]`` items of each size in 1..capacity."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    bins: list[tuple[dict[int, int], int]] = []
    alive = np.flatnonzero(left)
    while len(alive):
        own: dict[int, int] = {}
        gap, i = capacity, len(alive) - 1
        while i >= 0:  # greedily, largest first
            s = int(alive[i])
            n = min(gap // s, int(left[s]))
            if n:
                own[s] = n
                gap -= n * s
            i = min(i - 1, int(np.searchsorted(alive, gap, side="right")) - 1)
        pair = _two_for_smallest(alive, left, own, gap) if gap else None
        if pair:
            low = min(own)
            own[low] -= 1
            if not own[low]:
                del own[low]
            for s in pair:
                own[s] = own.get(s, 0) + 1
        times = min(int(left[s]) // n for s, n in own.items())
        gone = False
        for s, n in own.items():
            left[s] -= n * times
            gone |= left[s] == 0
        if gone:
            alive = alive[left[alive] > 0]
        bins.append((own, times))
    return bins


def _two_for_smallest(alive: np.ndarray, left: np.ndarray, own: dict[int, int], gap: int) -> tuple[int, int] | None:
    """The two unpacked sizes that fill the gap and the smallest item's room best, if they beat that item."""
    low = min(own)
    room = gap + low
    free = left[alive]
    for s, n in own.items():
        free[np.searchsorted(alive, s)] -= n
    sizes, free = alive[(free > 0) & (alive < room)], free[(free > 0) & (alive < room)]
    if not len(sizes):
        return None
    # for each a the largest b <= a with a + b <= room; b == a needs two of it
    j = np.searchsorted(sizes, np.minimum(room - sizes, sizes), side="right") - 1
    same = (j >= 0) & (j == np.arange(len(sizes))) & (free < 2)
    j = np.where(same, j - 1, j)
    both = np.where(j >= 0, sizes + sizes[np.maximum(j, 0)], 0)
    k = int(both.argmax())
    return (int(sizes[k]), int(sizes[j[k]])) if both[k] > low else None


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """The plan as intervals over the items in order of size and number: ``start, first_bin, each``.

    ``offset[size]`` is the place of that size's first item. Item ``p`` of interval ``i`` goes
    to bin ``first_bin[i] + (p - start[i]) // each[i]``.
    """
    offset = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    used = offset.copy()
    start, first, each = [], [], []
    b = 1
    for own, times in best_two_fit(counts, capacity):
        for s, n in own.items():
            start.append(used[s])
            first.append(b)
            each.append(n)
            used[s] += n * times
        b += times
    o = np.argsort(np.array(start, dtype=np.int64), kind="stable")
    return {"offset": offset, "start": np.array(start, dtype=np.int64)[o], "first_bin": np.array(first, dtype=np.int64)[o], "each": np.array(each, dtype=np.int64)[o], "bins": np.array([b - 1])}


def pieces(docs: DataFrame, budgets: DataFrame, key: str = "doc_id") -> DataFrame:
    """``budget_id, key, part, size``: documents as items of each budget.

    A document beyond the capacity becomes full parts and a rest; other documents are
    whole, part 1. Empty documents have size 0. Budgets (a table of fixed size,
    broadcast) that are null or below 1 are left out.
    """
    own = budgets.where("capacity_tokens >= 1").groupBy("budget_id").agg(F.max("capacity_tokens").alias("cap"))
    x = docs.select(key, "tokens").join(F.broadcast(own), F.lit(True))
    parts = F.greatest(F.ceil(F.col("tokens") / F.col("cap")), F.lit(1)).cast("int")
    x = x.select("budget_id", "cap", key, "tokens", F.explode(F.sequence(F.lit(1), parts)).alias("part"))
    return x.select("budget_id", key, "part", F.least(F.col("cap"), F.col("tokens") - (F.col("part") - 1) * F.col("cap")).cast("int").alias("size"))


def pack(spark: SparkSession, docs: DataFrame, budgets: DataFrame, key: str = "doc_id") -> DataFrame:
    """``budget_id, key, part, size, bin`` for documents with ``tokens``; ``docs`` is read twice and should be written.

    Bins are numbered from 1. Items of size 0 need no room and go to bin 1. The numbering
    within a size is by hash of the key, so a size held by a third of all documents is
    numbered in blocks. What reaches the driver is one count per budget, size and block
    row; what is broadcast is the plan, whose length follows the number of sizes.
    """
    items = pieces(docs, budgets, key)
    hist = items.groupBy("budget_id", "size").count().collect()
    caps = {r.budget_id: r.cap for r in budgets.where("capacity_tokens >= 1").groupBy("budget_id").agg(F.max("capacity_tokens").alias("cap")).collect()}
    plans, blocks = {}, {}
    for b, cap in caps.items():
        counts = np.zeros(cap + 1, dtype=np.int64)
        for r in hist:
            if r.budget_id == b:
                counts[r["size"]] = r["count"]
        blocks[b] = counts
        rest = counts.copy()
        rest[0] = 0
        plans[b] = plan(rest, cap)
    # a size's items are numbered in as many blocks as it needs
    split = [(b, s, int(-(-n // BLOCK_ROWS))) for b, c in blocks.items() for s, n in enumerate(c) if n > BLOCK_ROWS]
    h = F.xxhash64(F.col(key), F.col("part"))
    if split:
        many = spark.createDataFrame(split, "budget_id long, size int, blocks int")
        items = items.join(F.broadcast(many), ["budget_id", "size"], "left").withColumn("block", F.pmod(h, F.coalesce("blocks", F.lit(1)))).drop("blocks")
        per = items.where(F.col("block").isNotNull()).join(F.broadcast(many.select("budget_id", "size")), ["budget_id", "size"]).groupBy("budget_id", "size", "block").count()
        before = per.select("budget_id", "size", "block", (F.sum("count").over(Window.partitionBy("budget_id", "size").orderBy("block")) - F.col("count")).alias("before"))
        numbered = items.withColumn("n", F.row_number().over(Window.partitionBy("budget_id", "size", "block").orderBy(h, key, "part")) - 1)
        numbered = numbered.join(before, ["budget_id", "size", "block"], "left").withColumn("n", F.col("n") + F.coalesce("before", F.lit(0))).drop("before", "block")
    else:
        numbered = items.withColumn("n", (F.row_number().over(Window.partitionBy("budget_id", "size").orderBy(h, key, "part")) - 1).cast("long"))
    shared = spark.sparkContext.broadcast(plans)

    @F.pandas_udf("long")
    def place(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for b, s, n in parts:
            out = np.ones(len(b), dtype=np.int64)
            budget, size, number = b.to_numpy(), s.to_numpy(), n.to_numpy()
            for one in np.unique(budget):
                p, at = shared.value[one], np.flatnonzero((budget == one) & (size > 0))
                if len(at):
                    where = p["offset"][size[at]] + number[at]
                    i = np.searchsorted(p["start"], where, side="right") - 1
                    out[at] = p["first_bin"][i] + (where - p["start"][i]) // p["each"][i]
            yield pd.Series(out)

    return numbered.select("budget_id", key, "part", "size", place("budget_id", "size", F.col("n").cast("long")).alias("bin"))
