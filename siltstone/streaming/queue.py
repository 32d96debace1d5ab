"""The queue of index work.

Events ``root, path, kind, priority, ts`` (kind ``upsert``, ``delete``, ``refresh``, ``semantic``). Bursts on one key are one item: the last
kind and the best priority hold, and it is due when the burst has been quiet for the debounce time. A refresh of a root takes the place of
the root's other items. ``coalesce`` works on tables and, with a watermark, on streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.store import SnapshotStore, bucket_of
from siltstone.runtime import Scratch

DEBOUNCE, ROOT_DEBOUNCE = "2 seconds", "5 seconds"
ROOT_KINDS = ("refresh", "semantic")


def item_key() -> Column:
    """Files by root and path, refreshes and semantic refreshes by root."""
    return F.when(F.col("kind") == "refresh", F.concat(F.lit("R|"), "root")).when(F.col("kind") == "semantic", F.concat(F.lit("S|"), "root")).otherwise(F.concat(F.lit("F|"), "root", F.lit("|"), F.coalesce("path", F.lit(""))))


def from_watcher(events: DataFrame) -> DataFrame:
    """Watcher events (``created, changed, deleted, renamed, error``; ``old_path`` of a rename) as queue events: a rename deletes and upserts, an error refreshes the root."""
    up = F.struct(F.col("path").alias("path"), F.lit("upsert").alias("kind"))
    gone = lambda p: F.struct(F.col(p).alias("path"), F.lit("delete").alias("kind"))
    again = F.struct(F.lit(None).cast("string").alias("path"), F.lit("refresh").alias("kind"))
    what = F.when(F.col("event") == "renamed", F.array(gone("old_path"), up)).when(F.col("event") == "deleted", F.array(gone("path"))).when(F.col("event") == "error", F.array(again)).otherwise(F.array(up))
    return events.select("root", "priority", "ts", F.explode(what).alias("a")).select("root", "a.path", "a.kind", "priority", "ts")


def coalesce(events: DataFrame, debounce: str = DEBOUNCE) -> DataFrame:
    """``key, root, path, kind, priority, first_ts, due, events`` per burst; two events exactly the debounce time apart are one burst."""
    x = events.withColumn("key", item_key()).groupBy(F.session_window("ts", debounce).alias("w"), "key", "root", "path")
    out = x.agg(F.max_by("kind", F.struct("ts", "kind")).alias("kind"), F.min("priority").alias("priority"), F.min("ts").alias("first_ts"), F.count("*").alias("events"))
    return out.select("key", "root", "path", "kind", "priority", "first_ts", F.col("w.end").alias("due"), "events")


def subsume(items: DataFrame) -> DataFrame:
    """Pending items without those that a refresh of their root makes superfluous: file and semantic items queued before the root's last refresh."""
    last = items.where("kind = 'refresh'").groupBy("root").agg(F.max("due").alias("_refresh"))
    x = items.join(last, "root", "left")
    return x.where((F.col("kind") == "refresh") & (F.col("due") == F.col("_refresh")) | (F.col("kind") != "refresh") & (F.col("_refresh").isNull() | (F.col("first_ts") > F.col("_refresh")))).drop("_refresh")


def dequeue(items: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Due items, the lowest priority number first, then the oldest."""
    due = items.where(F.col("due") <= now).orderBy("priority", "first_ts", "key")
    return due.limit(limit) if limit else due


def pending_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("root").agg(F.count("*").alias("pending"))


def last_actions(journal: DataFrame, batch: int = 512) -> DataFrame:
    """``volume_id, batch, file_ref, usn, reason`` of a journal: in each batch of successive records, the last record of a file holds.

    Records are numbered per volume through ranges of numbers, so a volume's journal is not sorted in one task.
    """
    span = 1 << 16
    x = journal.withColumn("_range", F.floor(F.col("usn") / span))
    sizes = x.groupBy("volume_id", "_range").agg(F.count("*").alias("_n"))
    before = sizes.select("volume_id", "_range", (F.sum("_n").over(Window.partitionBy("volume_id").orderBy("_range")) - F.col("_n")).alias("_before"))
    w = Window.partitionBy("volume_id", "_range").orderBy("usn", "file_ref")
    x = x.withColumn("_i", F.row_number().over(w) - 1).join(before, ["volume_id", "_range"])
    x = x.withColumn("batch", F.floor((F.col("_i") + F.col("_before")) / batch))
    return x.groupBy("volume_id", "batch", "file_ref").agg(F.max(F.struct("usn", "reason")).alias("m")).select("volume_id", "batch", "file_ref", "m.usn", "m.reason")


def resume_point(volume: dict, checkpoint: dict | None) -> str:
    """``replay``, or why the journal can't be replayed and the volume is scanned instead."""
    if not checkpoint or checkpoint.get("usn") is None:
        return "no-checkpoint"
    if volume.get("journal_id") is None:
        return "no-journal"
    if checkpoint.get("journal_id") != volume["journal_id"]:
        return "journal-recreated"
    if checkpoint.get("profile") != volume.get("profile"):
        return "profile-changed"
    if checkpoint["usn"] < volume.get("first_usn", 0):
        return "records-lost"
    if checkpoint["usn"] > volume.get("next_usn", checkpoint["usn"]):
        return "ahead-of-journal"
    return "replay"


_ITEM = "root string, path string, kind string, priority int, events long"


def stateful_queue(events: DataFrame, quiet_ms: int = 2000, most_ms: int = 20_000) -> DataFrame:
    """The queue as a stream with state per root: items come out once the root has been quiet, or has been held for ``most_ms``; a refresh drops and
    blocks the root's other items. For roots with very many items use :class:`PendingQueue`, which keeps each item for itself.

    ``events`` is a stream with ``root, path, kind, priority, ts``; the state of a root is what is pending in it and is dropped when it is emitted.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, since = (dict(state.get[0]), state.get[1]) if state.exists else ({}, None)
        if not state.hasTimedOut:
            for f in frames:
                for path, kind, priority in zip(f["path"], f["kind"], f["priority"], strict=True):
                    at = "\0" + kind if kind in ROOT_KINDS else path or ""
                    if "\0refresh" in pending and kind != "refresh":
                        continue
                    if kind == "refresh":
                        pending = {k: v for k, v in pending.items() if k == at}
                    old = pending.get(at)
                    pending[at] = (kind, min(int(priority), old[1]) if old else int(priority), (old[2] if old else 0) + 1)
            now = state.getCurrentProcessingTimeMs()
            since = now if since is None else since
            if now - since < most_ms:
                state.update(([(k, v) for k, v in pending.items()], since))
                state.setTimeoutDuration(quiet_ms)
                return
        if state.exists:
            state.remove()
        rows = [(key[0], None if k.startswith("\0") else k, v[0], v[1], v[2]) for k, v in pending.items()]
        yield pd.DataFrame(rows, columns=["root", "path", "kind", "priority", "events"])

    kept = "items array<struct<k:string,v:struct<kind:string,priority:int,events:long>>>, since long"
    return events.groupBy("root").applyInPandasWithState(step, _ITEM, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


class PendingQueue:
    """The pending items on disk, each for itself: they outlive a restart, and a root with very many items is spread over buckets.

    Use ``stream.writeStream.foreachBatch(queue.add)``; work off ``due`` and call ``done`` with what was worked off.
    """

    def __init__(self, spark: SparkSession, folder: str, quiet_s: float = 2.0, buckets: int = 64):
        self.spark, self.quiet_s, self.store = spark, quiet_s, SnapshotStore(spark, folder, buckets)

    def items(self) -> DataFrame:
        """``key, root, path, kind, priority, first_ts, last_ts, due, events`` of all that is pending."""
        own = self.store.read("items") if self.store.has("items") else self.spark.createDataFrame([], _PENDING)
        micros = F.unix_micros("last_ts") + int(self.quiet_s * 1_000_000)
        return own.withColumn("due", F.timestamp_micros(micros))

    def _touched(self, keys: DataFrame) -> set[int]:
        return {r[0] for r in keys.select(bucket_of(["key"], self.store.buckets())).distinct().collect()}

    def _old(self, touched: set[int]) -> DataFrame:
        return self.store.read("items", touched) if self.store.has("items") else self.spark.createDataFrame([], _PENDING)

    def add(self, events: DataFrame, batch_id: int) -> None:
        """Merges ``root, path, kind, priority, ts``; a batch that was added before is passed over. The last event of an item names its kind."""
        m = self.store.manifest()
        if m and m["profiles"].get("batch", -1) >= batch_id:
            return
        scratch = Scratch(self.spark)
        one = events.where("root is not null and kind is not null and ts is not null").withColumn("key", item_key()).withColumn("path", F.when(~F.col("kind").isin(*ROOT_KINDS), F.col("path")))
        new = scratch.keep(one.select("key", "root", "path", "kind", "priority", F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), F.lit(1).cast("bigint").alias("events")))
        at = self._touched(new)
        both = self._old(at).unionByName(new)
        merged = both.groupBy("key").agg(F.max(F.struct("last_ts", "kind", "root", "path")).alias("l"), F.min("priority").alias("priority"), F.min("first_ts").alias("first_ts"), F.sum("events").alias("events"))
        rows = merged.select("key", "l.root", "l.path", "l.kind", "priority", "first_ts", "l.last_ts", "events")
        self.store.commit({}, {"batch": batch_id}, keyed={"items": (rows, ["key"], at)})

    def due(self, now: Column, limit: int | None = None) -> DataFrame:
        """Items that have been quiet, in order, without those that a pending refresh of their root makes superfluous."""
        return dequeue(subsume(self.items()), now, limit)

    def done(self, items: DataFrame) -> None:
        """Takes out items as they were when they came due, and what a refresh among them stands for; an item with a later event stays."""
        scratch = Scratch(self.spark)
        did = scratch.keep(items.select("key", "root", "kind", "last_ts", "due"))
        fresh = did.where("kind = 'refresh'").groupBy("root").agg(F.max("due").alias("_until"))
        hidden = self.items().join(fresh, "root").where((F.col("kind") != "refresh") & (F.col("first_ts") <= F.col("_until"))).select("key", "last_ts")
        out = scratch.keep(did.select("key", "last_ts").unionByName(hidden))
        at = self._touched(out)
        if at:
            gone = out.groupBy("key").agg(F.max("last_ts").alias("_done"))
            rest = self._old(at).join(gone, "key", "left").where(F.col("_done").isNull() | (F.col("last_ts") > F.col("_done"))).drop("_done")
            self.store.commit({}, keyed={"items": (rest, ["key"], at)})

    def clear_root(self, root: str) -> None:
        rows = self.items().where(F.col("root") != root).drop("due")
        if self.store.has("items"):
            self.store.commit({}, keyed={"items": (rows, ["key"], None)})


_PENDING = "key string, root string, path string, kind string, priority int, first_ts timestamp, last_ts timestamp, events bigint"
