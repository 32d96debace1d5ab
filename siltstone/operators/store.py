"""Tables as immutable snapshots on any file system Spark can write to.

A manifest names the files of each table and is swapped in one rename, so readers see the last committed snapshot
while a new one is written. One writer at a time holds a lease; a lease that its holder left behind (a crash) runs out and is
taken over. A table may be cut into buckets by a hash of its key: a commit then writes only the buckets that it touches,
and a look-up reads only those its keys fall into.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION, CONTENT_VERSION = "1", "content-1"


def bucket_of(keys: Iterable[str | Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def string_bucket(value: str, buckets: int) -> int:
    """:func:`bucket_of` of a single string, without a job."""
    h = xxhash.xxh64_intdigest(value.encode("utf-8"), seed=42)
    return (h - (1 << 64) if h >= 1 << 63 else h) % buckets


class SnapshotStore:
    """``profile`` describes what was indexed; a stored schema version that differs is refused.

    ``buckets`` is the number of parts of the bucketed tables of a new store (a stored number holds); the manifest has an entry for each.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, lease_seconds: float = 600.0):
        self.spark, self.folder, self.lease_seconds, self._buckets = spark, folder.rstrip("/"), lease_seconds, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    # ------------------------------------------------------------ small files

    def _text(self, name: str) -> str | None:
        p = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(p):
            return None
        s = self._fs.open(p)
        try:
            return bytes(s.readAllBytes()).decode("utf-8")
        finally:
            s.close()

    def _put(self, name: str, text: str) -> None:
        s = self._fs.create(self._path(f"{self.folder}/{name}"), False)
        try:
            s.write(bytearray(text.encode("utf-8")))
        finally:
            s.close()

    def _swap(self, temp: str, name: str) -> None:
        """Renames over an existing file in one step."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        src, dst = (self._fs.makeQualified(self._path(f"{self.folder}/{x}")) for x in (temp, name))
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), self.spark._jsc.hadoopConfiguration()).rename(src, dst, how)

    # ------------------------------------------------------------------ lease

    def _acquire(self) -> str:
        mine = uuid.uuid4().hex
        lock = self._path(f"{self.folder}/.lock")
        if self._fs.exists(lock):
            age = time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000
            if age < self.lease_seconds:
                raise FileExistsError(f"{self.folder} is being written (lease taken {age:.0f} s ago)")
            # only one of several takers can rename the left lease away
            self._fs.rename(lock, self._path(f"{self.folder}/.left-{mine}"))
            self._fs.delete(self._path(f"{self.folder}/.left-{mine}"), False)
        try:
            self._put(".lock", mine)
        except Exception as e:  # noqa: BLE001
            raise FileExistsError(f"{self.folder} is being written") from e
        return mine

    def _release(self, mine: str) -> None:
        if self._text(".lock") == mine:
            self._fs.delete(self._path(f"{self.folder}/.lock"), False)

    # ---------------------------------------------------------------- reading

    def manifest(self) -> dict | None:
        text = self._text("MANIFEST.json")
        if text is None:
            return None
        m = json.loads(text)
        if m.get("schema") != SCHEMA_VERSION:
            raise ValueError(f"index schema {m.get('schema')} can't be read; rebuild it")
        return m

    def buckets(self) -> int:
        m = self.manifest()
        return m.get("buckets", self._buckets) if m else self._buckets

    def has(self, table: str) -> bool:
        m = self.manifest()
        return m is not None and table in m["tables"]

    def read(self, table: str, only: Iterable[int] | None = None) -> DataFrame:
        """The table, or of a bucketed one the buckets ``only``."""
        m = self.manifest()
        if m is None or table not in m["tables"]:
            raise LookupError(f"no snapshot of {table}")
        at = m["tables"][table]
        if isinstance(at, str):
            return self.spark.read.parquet(f"{self.folder}/{at}")
        schema = StructType.fromJson(at["columns"])
        wanted = at["parts"] if only is None else {str(b): at["parts"][str(b)] for b in set(only) if str(b) in at["parts"]}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in sorted(wanted.values())))

    # ---------------------------------------------------------------- writing

    def commit(self, tables: dict[str, DataFrame], profile: dict | None = None, partition_by: str | None = None, keyed: dict[str, tuple[DataFrame, list[str], set[int] | None]] | None = None) -> int:
        """Writes the tables given; the others stay as they are.

        ``keyed`` has bucketed tables as ``name: (rows, key columns, touched)``: of the touched buckets (None: all) the rows are the new
        content, the other buckets stay.
        """
        mine = self._acquire()
        try:
            m = self.manifest() or {"schema": SCHEMA_VERSION, "content": CONTENT_VERSION, "version": 0, "buckets": self._buckets, "tables": {}, "profiles": {}}
            version, n = m["version"] + 1, m.get("buckets", self._buckets)
            run = f"v={version}-{mine[:8]}"
            for name, df in tables.items():
                w = df.write.mode("overwrite")
                (w.partitionBy(partition_by) if partition_by and partition_by in df.columns else w).parquet(f"{self.folder}/{run}/{name}")
                m["tables"][name] = f"{run}/{name}"
            for name, (df, key, touched) in (keyed or {}).items():
                base = f"{self.folder}/{run}/{name}"
                parts = df.withColumn("_bucket", bucket_of(key, n)).repartition("_bucket").sortWithinPartitions("_bucket", *key)
                parts.write.mode("overwrite").partitionBy("_bucket").parquet(base)
                old = m["tables"].get(name)
                kept = dict(old["parts"]) if isinstance(old, dict) and touched is not None else {}
                for b in touched or ():
                    kept.pop(str(b), None)
                for s in self._fs.listStatus(self._path(base)):
                    folder = s.getPath().getName()
                    if folder.startswith("_bucket="):
                        kept[folder[8:]] = f"{run}/{name}/{folder}"
                m["tables"][name] = {"columns": df.schema.jsonValue(), "key": key, "parts": kept}
            m["version"] = version
            m["profiles"] |= profile or {}
            temp = f"MANIFEST.{uuid.uuid4().hex}"
            self._put(temp, json.dumps(m))
            if self._text(".lock") != mine:
                raise FileExistsError(f"the lease on {self.folder} ran out while writing; nothing was committed")
            self._swap(temp, "MANIFEST.json")
            return version
        finally:
            self._release(mine)

    def compact(self, files: int = 1) -> int:
        """Rewrites the current plain tables with few files and commits them."""
        m = self.manifest() or {"tables": {}}
        return self.commit({t: self.read(t).coalesce(files) for t, at in m["tables"].items() if isinstance(at, str)})

    def clear_root(self, table: str, root: str, column: str = "root") -> int:
        return self.commit({table: self.read(table).where(F.col(column) != root)})

    def sweep(self) -> int:
        """Removes folders that the manifest doesn't name; call it when no reader holds an older snapshot."""
        m = self.manifest()
        if m is None:
            return 0
        live = {p.split("/")[0] for at in m["tables"].values() for p in ([at] if isinstance(at, str) else at["parts"].values())}
        gone = [s.getPath() for s in self._fs.listStatus(self._path(self.folder)) if s.getPath().getName().startswith("v=") and s.getPath().getName() not in live]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
