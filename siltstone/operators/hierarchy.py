"""Parent-child rows to full hierarchies by bottom-up leaf peeling.

Round k removes the items that have no remaining child. Each removed item sends
its subtree size to its parent (summed before the shuffle, so a folder with a
third of all items receives one row per task). What can never be removed lies on
a loop. The peel order is then walked backwards: an item takes depth, root and
path from its parent, which was removed later or lies on a loop.

Lists of descendants are not sent upwards as values: a root's list would hold
its whole tree in one row. The reverse walk gives each item its ancestors, and
``descendants`` emits the pairs (ancestor, descendant) from those, one item at a
time and without a shuffle.

Every round reads and writes only what is left. A round that takes off less than a
``SLOW``-th of it ends the peel: what then remains is mostly chains and loops, which pointer doubling resolves
in as many rounds as their length has bits. So the rounds follow the logarithm of the items, and all layers together, which
the reverse walk reads, hold at most ``SLOW`` times as many rows as there are items. Once at
most ``finish_rows`` items are left (counted, not assumed) one task finishes in memory instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import Scratch

_TWO64_LOW = 446744073709551616  # 2**64 = 18 * 10**18 + this
_E18 = 10**18
#: A peeling round has to take off this part of what is left, or the rest is left to pointer doubling.
SLOW = 4


def _dec(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("decimal(38,0)")


def decimal_text(number: Column) -> Column:
    """A reference number as decimal text without leading zeros; null and blank give null.

    32 hexadecimal digits are a number with the lowest byte first, anything else
    is decimal already.
    """
    x = F.trim(number)
    swapped = F.array_join(F.transform(F.sequence(F.lit(15), F.lit(0)), lambda i: F.substring(x, i * 2 + 1, F.lit(2))), "")
    high, low = F.substring(swapped, 1, 16), F.conv(F.substring(swapped, 17, 16), 16, 10)
    h, lo = _dec(F.conv(high, 16, 10)), _dec(low)
    h1, h0 = F.floor(h / _dec(_E18)).cast("decimal(38,0)"), (h % _dec(_E18)).cast("decimal(38,0)")
    l1, l0 = F.floor(lo / _dec(_E18)).cast("decimal(38,0)"), (lo % _dec(_E18)).cast("decimal(38,0)")
    d0 = _dec(h0 * _dec(_TWO64_LOW)) + l0
    c0 = F.floor(d0 / _dec(_E18)).cast("decimal(38,0)")
    d1 = _dec(h1 * _dec(_TWO64_LOW)) + _dec(h0 * _dec(18)) + l1 + c0
    c1 = F.floor(d1 / _dec(_E18)).cast("decimal(38,0)")
    d2 = _dec(h1 * _dec(18)) + c1
    digits = lambda c: F.lpad((_dec(c) % _dec(_E18)).cast("decimal(38,0)").cast("string"), 18, "0")
    wide = F.concat(d2.cast("decimal(38,0)").cast("string"), digits(d1), digits(d0))
    hexed = F.when(high == "0" * 16, low).otherwise(wide)
    text = F.when(F.length(x) == 32, hexed).when(x == "", None).otherwise(x)
    return F.regexp_replace(text, r"^0+(?=\d)", "")


def current_items(sightings: DataFrame) -> DataFrame:
    """The sighting that holds for each item: ``volume_id, num, parent, item_name, is_directory``.

    The highest ``last_observed_usn`` holds (null is lowest), ties go to the later
    ``observed_at``, then to the greater values. Sightings without a number name no
    item and are left out.
    """
    own = sightings.select(
        "volume_id",
        decimal_text(F.col("file_reference_number")).alias("num"),
        decimal_text(F.col("parent_file_reference_number")).alias("parent"),
        "item_name",
        "is_directory",
        "last_observed_usn",
        "observed_at",
    ).where("num is not null")
    best = F.max(F.struct("last_observed_usn", "observed_at", "parent", "item_name", "is_directory"))
    return own.groupBy("volume_id", "num").agg(best.alias("b")).select("volume_id", "num", "b.parent", "b.item_name", "b.is_directory")


def _order(c: Column) -> Column:
    """Sorts decimal texts by number."""
    return F.struct(F.length(c).alias("len"), c.alias("num"))


_NONE = "array<string>"


def _schema(want: frozenset[str]) -> str:
    return "volume_id bigint, num string, root string, depth int, subtree bigint" + (", ancestors array<string>" if "ancestors" in want else "") + (", path string" if "path" in want else "")


def _finish(want: frozenset[str]):
    """Peels what is left in memory; rows as in ``_schema``, sent on in parts as lists of ancestors can be long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        at: dict[tuple, tuple] = {}
        size: dict[tuple, int] = {}
        names = rows.item_name if "path" in want else [None] * len(rows)
        for v, num, parent, name, n, rooted in zip(rows.volume_id, rows.num, rows.parent, names, rows.subtree, rows.rooted, strict=True):
            at[(v, num)] = (None if rooted or parent is None else (v, parent), name or "")
            size[(v, num)] = int(n)
        waiting = dict.fromkeys(at, 0)
        for p, _ in at.values():
            if p is not None:
                waiting[p] += 1
        ready = [k for k, n in waiting.items() if not n]
        peeled: list[tuple] = []
        while ready:
            k = ready.pop()
            peeled.append(k)
            p = at[k][0]
            if p is not None:
                size[p] += size[k]
                waiting[p] -= 1
                if not waiting[p]:
                    ready.append(p)
        done: dict[tuple, tuple] = {}  # root, depth
        loops = at.keys() - set(peeled)
        for k in loops:
            if k in done:
                continue
            loop, x = [k], at[k][0]
            while x != k:
                loop.append(x)
                x = at[x][0]
            low = min((x[1] for x in loop), key=lambda t: (len(t), t))
            for x in loop:
                done[x] = (low, -1)
        for k in reversed(peeled):
            p = at[k][0]
            if p is None:
                done[k] = (k[1], 0)
            else:
                root, depth = done[p]
                done[k] = (root, depth if depth < 0 else depth + 1)

        def part(keys: list[tuple], above: list[list[tuple]]) -> pd.DataFrame:
            out = {
                "volume_id": [k[0] for k in keys],
                "num": [k[1] for k in keys],
                "root": [done[k][0] for k in keys],
                "depth": pd.Series([done[k][1] for k in keys], dtype="int32"),
                "subtree": pd.Series([size[k] for k in keys], dtype="int64"),
            }
            if "ancestors" in want:
                out["ancestors"] = [[x[1] for x in a] for a in above]
            if "path" in want:
                out["path"] = [None if done[k][1] < 0 else "\\".join(at[x][1] for x in (*a, k)) for k, a in zip(keys, above, strict=True)]
            return pd.DataFrame(out)

        keys, above, entries = [], [], 0
        for k in at:
            own: list[tuple] = []
            if want and k not in loops:
                x = at[k][0]
                while x is not None:
                    own.append(x)
                    x = None if x in loops else at[x][0]
                own.reverse()
            keys.append(k)
            above.append(own)
            entries += 1 + len(own)
            if entries > 500_000:
                yield part(keys, above)
                keys, above, entries = [], [], 0
        if keys:
            yield part(keys, above)

    return run


def hierarchy(items: DataFrame, finish_rows: int = 50_000, want: Iterable[str] = ("ancestors", "path")) -> DataFrame:
    """``volume_id, num, root, depth, subtree`` and, as ``want`` says, ``ancestors`` and ``path`` of each item of :func:`current_items`.

    An item whose parent is null, itself or not on record on its volume is a root
    of depth 0. ``ancestors`` runs from the root to the parent; ``path`` joins the names
    by ``\\`` (a null name is an empty part); ``subtree`` counts the item and its descendants.
    Items on a loop or below one have depth -1, no path, and as root the smallest number in that loop. On a loop they have no
    ancestors and their ``subtree`` counts what hangs below them; below one their ancestors begin with the item on the loop.
    ``finish_rows`` decides where the work is done and changes no result.
    """
    spark, want = items.sparkSession, frozenset(want)
    scratch = Scratch(spark)
    named = ["item_name"] if "path" in want else []
    items = scratch.keep(items.select("volume_id", "num", "parent", *named))  # read twice: the numbers are not to be parsed twice
    known = items.select("volume_id", F.col("num").alias("parent"), F.lit(True).alias("on_record"))
    rooted = F.col("parent").isNull() | (F.col("parent") == F.col("num")) | F.col("on_record").isNull()
    left = scratch.keep(
        items.join(known, ["volume_id", "parent"], "left")
        .select("volume_id", "num", "parent", *named, rooted.alias("rooted"), F.lit(1).cast("bigint").alias("subtree"))
    )
    layers: list[DataFrame] = []
    count = left.count()
    slow = False
    while count > finish_rows and not slow:
        inner = left.where(~F.col("rooted")).groupBy("volume_id", F.col("parent").alias("num")).agg(F.lit(True).alias("inner"))
        marked = left.join(inner, ["volume_id", "num"], "left")
        layer = scratch.keep(marked.where("inner is null").drop("inner"))
        sent = layer.where(~F.col("rooted")).groupBy("volume_id", F.col("parent").alias("num")).agg(F.sum("subtree").alias("more"))
        after = scratch.keep(
            left.join(layer.select("volume_id", "num"), ["volume_id", "num"], "left_anti")
            .join(sent, ["volume_id", "num"], "left")
            .withColumn("subtree", F.col("subtree") + F.coalesce("more", F.lit(0)))
            .drop("more")
        )
        scratch.drop(left)
        layers.append(layer)
        left, before = after, count
        count = left.count()
        # rounds that take little off would follow the height: chains and loops are left to pointer doubling
        slow = (before - count) * SLOW < before
    if not count:
        solved = spark.createDataFrame([], _schema(want))
    elif count <= finish_rows:
        solved = scratch.keep(left.coalesce(1).mapInPandas(_finish(want), _schema(want)))
    else:
        solved = scratch.keep(_doubled(left, scratch, want))
    scratch.drop(left)
    parts = [solved]
    for k in range(len(layers) - 1, -1, -1):
        above = solved.select("volume_id", F.col("num").alias("parent"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"), *(F.col(c).alias(f"p_{c}") for c in sorted(want)))
        own = layers[k].withColumn("parent", F.when(~F.col("rooted"), F.col("parent")))
        looped = F.col("p_depth") < 0
        cols = [
            "volume_id",
            "num",
            F.when(F.col("rooted"), F.col("num")).otherwise(F.col("p_root")).alias("root"),
            F.when(F.col("rooted"), 0).when(looped, -1).otherwise(F.col("p_depth") + 1).cast("int").alias("depth"),
            "subtree",
        ]
        if "ancestors" in want:
            cols.append(F.when(F.col("rooted"), F.array().cast(_NONE)).otherwise(F.concat("p_ancestors", F.array("parent"))).alias("ancestors"))
        if "path" in want:
            name = F.coalesce("item_name", F.lit(""))
            cols.append(F.when(F.col("rooted"), name).when(looped, None).otherwise(F.concat("p_path", F.lit("\\"), name)).alias("path"))
        got = own.join(above, ["volume_id", "parent"], "left").select(*cols)
        if k:
            got = scratch.keep(got)
            solved = solved.unionByName(got)
        parts.append(got)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _loops(left: DataFrame, scratch: Scratch) -> DataFrame:
    """``volume_id, num, root`` of the items on loops, by pointer doubling in as many rounds as the height has bits.

    After 2**k steps every item that still has a place to be stands above some item; once the places no longer become fewer they are
    the loops. The smallest number of a loop is doubled on those alone.
    """
    step = scratch.keep(left.where(~F.col("rooted")).select("volume_id", "num", F.col("parent").alias("next")))
    places = -1
    while True:
        now = step.select("volume_id", "next").distinct().count()
        if now == places:
            break
        places = now
        there = step.select("volume_id", F.col("num").alias("next"), F.col("next").alias("next2"))
        after = scratch.keep(step.join(there, ["volume_id", "next"]).select("volume_id", "num", F.col("next2").alias("next")))
        scratch.drop(step)
        step = after
    on = scratch.keep(step.select("volume_id", F.col("next").alias("num")).distinct())
    low = scratch.keep(left.join(on, ["volume_id", "num"], "left_semi").select("volume_id", "num", F.col("parent").alias("next"), F.col("num").alias("low")))
    while True:
        there = low.select("volume_id", F.col("num").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        lower = F.least(_order(F.col("low")), _order(F.col("low2")))["num"]
        after = scratch.keep(low.join(there, ["volume_id", "next"]).select("volume_id", "num", F.col("next2").alias("next"), lower.alias("low"), (lower != F.col("low")).alias("fell")))
        more = after.agg(F.max("fell")).first()[0]
        scratch.drop(low)
        low = after.drop("fell") if more else after
        if not more:
            break
        low = scratch.keep(low)
    scratch.drop(step, on)
    return low.select("volume_id", "num", F.col("low").alias("root"))


def _doubled(left: DataFrame, scratch: Scratch, want: frozenset[str]) -> DataFrame:
    """Chains and loops of any length, in as many rounds as the height has bits.

    Each item knows the item 2**k steps up (null beyond the top) and what lies between; a round joins it to what that item knows.
    Sizes go the same way upwards: an item receives the sizes of those that stand 2**k below it, summed before the shuffle.
    Items on loops are tops of their own.
    """
    loops = scratch.keep(_loops(left, scratch))
    x = left.join(loops.withColumnRenamed("root", "low"), ["volume_id", "num"], "left")
    top = F.col("rooted") | F.col("low").isNotNull()
    cols = ["volume_id", "num", F.when(~top, F.col("parent")).alias("up"), F.when(top, 0).otherwise(1).alias("steps"), F.when(top, F.col("num")).otherwise(F.col("parent")).alias("top"), "subtree"]
    if "ancestors" in want:
        cols.append(F.when(top, F.array().cast(_NONE)).otherwise(F.array("parent")).alias("ancestors"))
    if "path" in want:
        name = F.coalesce("item_name", F.lit(""))
        cols.append(F.when(top, name).otherwise(F.concat(F.lit("\\"), name)).alias("path"))
    state = scratch.keep(x.select(*cols))
    while not state.where("up is not null").isEmpty():
        there = state.select("volume_id", F.col("num").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("top").alias("top2"), *(F.col(c).alias(f"{c}2") for c in sorted(want)))
        sent = state.where("up is not null").groupBy("volume_id", F.col("up").alias("num")).agg(F.sum("subtree").alias("more"))
        joined = state.join(there, ["volume_id", "up"], "left").join(sent, ["volume_id", "num"], "left")
        cols = ["volume_id", "num", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.coalesce("top2", "top").alias("top"), (F.col("subtree") + F.coalesce("more", F.lit(0))).alias("subtree")]
        if "ancestors" in want:
            cols.append(F.concat(F.coalesce("ancestors2", F.array().cast(_NONE)), "ancestors").alias("ancestors"))
        if "path" in want:
            cols.append(F.concat(F.coalesce("path2", F.lit("")), "path").alias("path"))
        after = scratch.keep(joined.select(*cols))
        scratch.drop(state)
        state = after
    low = loops.select("volume_id", F.col("num").alias("top"), "root")
    got = state.join(low, ["volume_id", "top"], "left")
    looped = F.col("root").isNotNull()
    cols = ["volume_id", "num", F.coalesce("root", "top").alias("root"), F.when(looped, -1).otherwise(F.col("steps")).cast("int").alias("depth"), "subtree"]
    if "ancestors" in want:
        cols.append("ancestors")
    if "path" in want:
        cols.append(F.when(~looped, F.col("path")).alias("path"))
    return got.select(*cols)


def descendants(tree: DataFrame) -> DataFrame:
    """``volume_id, ancestor, descendant, distance``: one row for each item and each item above it."""
    n = F.size("ancestors")
    return tree.select("volume_id", F.col("num").alias("descendant"), n.alias("n"), F.posexplode("ancestors").alias("pos", "ancestor")).select(
        "volume_id", "ancestor", "descendant", (F.col("n") - F.col("pos")).alias("distance")
    )
