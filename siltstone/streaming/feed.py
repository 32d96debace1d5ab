"""A change feed applied as it arrives.

Three tables in buckets, of which a micro-batch reads and writes only the buckets it touches:

* ``waiting``, the deliveries above the contiguous watermark (one bucket set by id);
* ``ids``, every delivery at or below it, by id: what a change was, so a late redelivery that moves it to another path
  takes it away from the old one;
* ``keys``, the transaction each id stands for, by file: what a file falls back to when its last change moves away.

All are reductions by maximum, so a repeated, late or re-run batch changes nothing. State becomes visible with the
manifest, in one rename.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import changes
from siltstone.operators.store import SnapshotStore, bucket_of
from siltstone.runtime import Scratch

_COLUMNS = ["id", "delivery_no", "delivered_at", "kind", "root_path", "path", "size_bytes"]
_KEY = ["root_path", "path_key"]


def _by_key(tx: DataFrame) -> DataFrame:
    own = tx.where(F.col("path").isNotNull() & F.col("kind").isin(changes.UPSERT, changes.DELETE))
    return own.select("root_path", changes.path_key(F.col("path")).alias("path_key"), "id", "kind", "size_bytes")


class FeedState:
    """Use ``stream.writeStream.foreachBatch(FeedState(...).apply)``; ``state()`` is what has been committed."""

    def __init__(self, spark: SparkSession, folder: str, first_id: int = 1, sealed: bool = False, buckets: int = 64):
        self.store, self.spark, self.first_id, self.sealed = SnapshotStore(spark, folder, buckets), spark, first_id, sealed

    def _table(self, name: str, schema, only: set[int] | None = None) -> DataFrame:
        return self.store.read(name, only) if self.store.has(name) else self.spark.createDataFrame([], schema)

    def watermark(self) -> int:
        m = self.store.manifest()
        return m["profiles"].get("watermark", self.first_id - 1) if m else self.first_id - 1

    def _touched(self, df: DataFrame, key: list[str]) -> set[int]:
        """Buckets of the rows: at most as many numbers as there are buckets."""
        return {r[0] for r in df.select(bucket_of(key, self.store.buckets())).distinct().collect()}

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        m = self.store.manifest()
        if m and m["profiles"].get("batch", -1) >= batch_id:
            return  # already applied
        scratch, at = Scratch(self.spark), self.watermark()
        feed = scratch.keep(batch.select(_COLUMNS).where("id is not null").distinct())
        late, fresh = feed.where(F.col("id") <= at), feed.where(F.col("id") > at)
        waiting = scratch.keep(self._table("waiting", feed.schema).select(_COLUMNS).unionByName(fresh).distinct())
        tx = changes.transactions(waiting)
        if self.sealed:
            top = waiting.agg(F.max("id")).first()[0]
            new = at if top is None else max(at, top)
        else:
            row = changes.watermark(tx, at + 1).first()
            new = at if row is None or row.watermark is None else max(at, row.watermark)
        # what is now at or below the watermark: deliveries that waited, and late ones of ids applied before
        passed = scratch.keep(waiting.where(F.col("id") <= new).unionByName(late))
        ids_at = self._touched(passed, ["id"])
        known = self._table("ids", feed.schema, ids_at).select(_COLUMNS)
        before = changes.transactions(known.join(passed.select("id"), "id", "left_semi").select(_COLUMNS))
        ids = scratch.keep(known.unionByName(passed).distinct())
        after = changes.transactions(ids.join(passed.select("id"), "id", "left_semi").select(_COLUMNS))
        old, now = scratch.keep(_by_key(before)), scratch.keep(_by_key(after))
        keys_at = self._touched(old.select(_KEY).unionByName(now.select(_KEY)), _KEY)
        # an id stands for one file: rows of the ids concerned are taken out and put in anew
        keys = self._table("keys", now.schema, keys_at).select(now.columns).join(old.select("id"), "id", "left_anti").select(now.columns).unionByName(now)
        held = waiting.where(F.col("id") > new)
        self.store.commit(
            {"waiting": held},
            {"watermark": new, "batch": batch_id},
            keyed={"ids": (ids, ["id"], ids_at), "keys": (keys, _KEY, keys_at)},
        )
        scratch.drop(feed, waiting, passed, ids, old, now)

    def state(self) -> DataFrame:
        """Files that exist up to the watermark: ``root_path, path_key, id``."""
        if not self.store.has("keys"):
            raise LookupError("nothing has been applied")
        last = self.store.read("keys").groupBy("root_path", "path_key").agg(F.max(F.struct("id", "kind")).alias("c"))
        return last.where(F.col("c.kind") == changes.UPSERT).select("root_path", "path_key", F.col("c.id").alias("id"))
