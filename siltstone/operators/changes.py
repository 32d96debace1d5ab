"""Applying a change feed: commit-ordered transactional replay.

A change has an ``id`` (its place in commit order) and one or more deliveries.
The replay

* assembles each transaction from its deliveries: the highest ``delivery_no``
  holds, and a transaction is complete once deliveries 1..n are all there;
* holds gaps: the committed watermark is the highest id below which every id
  has been seen complete or is declared void. A feed that is *sealed* (no more deliveries
  can come) declares its gaps void, range by range: absent ids never were, and an incomplete
  transaction is what its highest delivery says;
* applies the transactions up to the watermark, key by key. Keys do not
  conflict, so each key's changes are reduced on their own: the last change of a
  key decides, which a map-side combined ``max`` finds without sorting or
  gathering a key's history.

Both reductions combine before the shuffle, so a key, a root or an id that holds
a third of the feed sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import Scratch

UPSERT, DELETE = 1, 2
#: Ids per block of the gap search.
BLOCK = 1 << 16


def path_key(path: Column) -> Column:
    r"""The key of a path: lower case, ``\`` for ``/``, no leading ``\\?\``. Null stays null."""
    return F.regexp_replace(F.translate(F.lower(path), "/", "\\"), r"^\\\\\?\\", "")


def transactions(changes: DataFrame) -> DataFrame:
    """One row per ``id``: the delivery with the highest ``delivery_no`` and whether all its deliveries are there.

    Deliveries are reduced to distinct ``(id, delivery_no)`` first, then counted per ``id``; both steps combine before
    their shuffle, and a reader that doesn't ask for ``complete`` pays for neither.

    Ties on ``delivery_no`` go to the later ``delivered_at``, then to the greater
    values, so repeated rows change nothing. Rows with a null ``id`` have no place
    in commit order and are left out; a null ``delivery_no`` counts as lowest.
    """
    last = F.max(F.struct("delivery_no", "delivered_at", "kind", "root_path", "path", "size_bytes"))
    grouped = (
        changes.where("id is not null")
        .groupBy("id")
        .agg(last.alias("d"), F.count_distinct("delivery_no").alias("seen"), F.min("delivery_no").alias("first"))
    )
    complete = (F.col("seen") == F.col("d.delivery_no")) & (F.col("first") == 1)
    return grouped.select("id", "d.delivery_no", "d.kind", "d.root_path", "d.path", "d.size_bytes", F.coalesce(complete, F.lit(False)).alias("complete"))


def _blocks(tx: DataFrame) -> DataFrame:
    """One row per block of ids: ``block, lo, hi, n, next_block``; the next block that holds an id (null for the last).

    Only blocks whose neighbour is absent meet in one window: as many as there are runs of absent blocks, not as there are blocks.
    """
    own = tx.select("id", F.floor(F.col("id") / BLOCK).alias("block")).groupBy("block").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
    here = own.select((F.col("block") - 1).alias("block"), F.lit(True).alias("followed"))
    led = own.select((F.col("block") + 1).alias("block"), F.lit(True).alias("preceded"))
    x = own.join(here, "block", "left").join(led, "block", "left")
    border = x.where("followed is null or preceded is null").withColumn("far", F.lead("block").over(Window.orderBy("block")))
    far = border.where("followed is null").select("block", "far")
    return x.join(far, "block", "left").select("block", "lo", "hi", "n", F.when(F.col("followed"), F.col("block") + 1).otherwise(F.col("far")).alias("next_block"))


def gaps(tx: DataFrame, first_id: int | None = None) -> DataFrame:
    """``lo, hi, reason``: the ranges of ids that hold a feed up, ``absent`` ids and ``incomplete`` transactions.

    Sought block by block (``BLOCK`` ids each), so no task sees more than a block's ids; a range that crosses blocks comes in
    parts. ``first_id`` is where the feed starts (the lowest id if None). A feed without ids has no gaps.
    """
    block = F.floor(F.col("id") / BLOCK)
    inside = tx.select("id", F.lead("id").over(Window.partitionBy(block).orderBy("id")).alias("next")).where(F.col("next") > F.col("id") + 1)
    blocks = _blocks(tx)
    absent = inside.select((F.col("id") + 1).alias("lo"), (F.col("next") - 1).alias("hi"))
    behind = blocks.where("next_block is not null").select((F.col("hi") + 1).alias("lo"), (F.col("next_block") * BLOCK - 1).alias("hi"))
    start = F.lit(first_id).cast("long")
    head = tx.agg(F.min("id").alias("first")).select(F.coalesce(start, "first").alias("lo"), (F.col("first") - 1).alias("hi"))
    before = blocks.join(F.broadcast(tx.agg(F.min("id").alias("first"))), F.col("lo") > F.col("first")).select((F.col("block") * BLOCK).alias("lo"), (F.col("lo") - 1).alias("hi"))
    holes = absent.unionByName(behind).unionByName(head).unionByName(before).where("lo <= hi").withColumn("reason", F.lit("absent"))
    return holes.unionByName(tx.where(~F.col("complete")).select(F.col("id").alias("lo"), F.col("id").alias("hi"), F.lit("incomplete").alias("reason")))


def watermark(tx: DataFrame, first_id: int | None = None, voids: DataFrame | None = None) -> DataFrame:
    """One row: ``first_id, last_id, transactions, missing, watermark``.

    The watermark is the last id below the first gap that isn't void, ``first_id - 1`` if the feed's start is
    absent. ``voids`` has the gaps declared void, as rows of :func:`gaps` (``lo, hi``); a feed that is still open has none.
    """
    held = gaps(tx, first_id)
    if voids is not None:
        held = held.join(voids.select("lo", "hi"), ["lo", "hi"], "left_anti")
    stop = held.agg(F.min("lo").alias("stop"))
    ends = tx.agg(F.min("id").alias("lo"), F.max("id").alias("last_id"), F.count("*").alias("transactions"))
    first = F.coalesce(F.lit(first_id).cast("long"), "lo").alias("first_id")
    return ends.join(F.broadcast(stop), F.lit(True)).select(
        first,
        "last_id",
        "transactions",
        (F.col("last_id") - first + 1 - F.col("transactions")).alias("missing"),
        F.coalesce(F.col("stop") - 1, F.col("last_id")).alias("watermark"),
    )


def apply_changes(tx: DataFrame, up_to: DataFrame) -> DataFrame:
    """The files that exist after the transactions up to the watermark: ``root_path, path_key, id, size_bytes``.

    ``up_to`` is the one row of :func:`watermark`. Kinds other than upsert and delete, null kinds and
    null paths alter no file. A file exists if its last change is an upsert.
    """
    own = tx.where(F.col("path").isNotNull() & F.col("kind").isin(UPSERT, DELETE))
    own = own.join(F.broadcast(up_to.select("watermark")), F.col("id") <= F.col("watermark")).drop("watermark")
    last = own.groupBy("root_path", path_key(F.col("path")).alias("path_key")).agg(F.max(F.struct("id", "kind", "size_bytes")).alias("c"))
    return last.where(F.col("c.kind") == UPSERT).select("root_path", "path_key", F.col("c.id").alias("id"), F.col("c.size_bytes").alias("size_bytes"))


def replay(changes: DataFrame, sealed: bool = True, first_id: int | None = None) -> DataFrame:
    """Current state of the table that ``changes`` describes; see the module's text.

    The transactions are assembled and written once; gaps, watermark and state read them. Sealing a feed declares its gaps void,
    which lets the watermark pass; an open feed is held at its first gap. An empty feed gives no rows.
    Columns beyond those named in the feed's schema are ignored.
    """
    tx = Scratch(changes.sparkSession).keep(transactions(changes))
    return apply_changes(tx, watermark(tx, first_id, gaps(tx, first_id) if sealed else None))
