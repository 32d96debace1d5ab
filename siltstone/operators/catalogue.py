"""An index on disk: built once, searched by its postings, changed file by file.

Five bucketed tables of a :class:`SnapshotStore`: ``files`` and ``lines`` by file, ``postings`` by token, ``paths`` and ``identities`` by
what names a file. A search reads the buckets of its tokens only, in which rows are sorted by token, so the token filter prunes what is read. A
change rewrites the buckets it touches and becomes visible in one rename.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import index
from siltstone.operators.search import cap_hits
from siltstone.operators.store import SnapshotStore, bucket_of, string_bucket
from siltstone.query import compile as qc
from siltstone.query.nodes import Node, Unified
from siltstone.runtime import Scratch

#: Candidate lines up to which a search sends them along with the read of the lines; more are joined.
FEW = 10_000
#: What tells that a file is as it was; its row must also be ok.
STATE = ("size_bytes", "created", "modified", "extractor_id", "extractor_version")


class FileIndex:
    """``files`` have ``file_id, path`` and may have ``identity`` (what stays when a file is moved), ``status`` and the columns of ``STATE``;
    ``lines`` have ``file_id, line_number, content``. Further columns of files are kept."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.store = spark, SnapshotStore(spark, folder, buckets)

    # --------------------------------------------------------------- building

    @staticmethod
    def _named(files: DataFrame) -> DataFrame:
        if "identity" not in files.columns:
            files = files.withColumn("identity", F.lit(None).cast("string"))
        return files.withColumn("identity", F.col("identity").cast("string")).withColumn("path_key", F.lower(F.translate("path", "\\", "/")))

    def _tables(self, files: DataFrame, lines: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
        return {
            "files": (files, ["file_id"]),
            "paths": (files.select("path_key", "file_id"), ["path_key"]),
            "identities": (files.where("identity is not null").select("identity", "file_id"), ["identity"]),
            "lines": (lines.select("file_id", "line_number", "content"), ["file_id"]),
            "postings": (index.postings(lines), ["token"]),
        }

    def build(self, files: DataFrame, lines: DataFrame, profile: dict | None = None) -> FileIndex:
        self.store.commit({}, profile, keyed={t: (df, key, None) for t, (df, key) in self._tables(self._named(files), lines).items()})
        return self

    # -------------------------------------------------------------- searching

    def postings(self, tokens: list[str]) -> DataFrame:
        want = sorted({t.lower() for t in tokens})
        return self.store.read("postings", {string_bucket(t, self.store.buckets()) for t in want}).where(F.col("token").isin(*want))

    def lookup(self, tokens: list[str], keys: list[str] | None = None, require_all: bool = True) -> DataFrame:
        """The lines (or files) that hold all, or any, of the tokens."""
        want, line = {t.lower() for t in tokens}, ["file_id", "line_number"]
        if keys and keys != line:
            return index.lookup(self.postings(tokens), tokens, keys, require_all)
        # a line has each of its tokens once
        hit = self.postings(tokens)
        if len(want) == 1:
            return hit.select(*line)
        return hit.groupBy(*line).agg(F.count("*").alias("_n")).where(F.col("_n") >= (len(want) if require_all else 1)).select(*line)

    def search(self, query: Node, cap: int | None = None, names: Node | None = None) -> DataFrame:
        """``file_id, line_number, content`` of the lines that match; a query without whole tokens scans the stored lines."""
        groups = qc.candidate_tokens(query)
        lines = self.store.read("lines")
        if groups:
            found = reduce(DataFrame.unionByName, (self.lookup(list(g)) for g in groups))
            found = found.distinct() if len(groups) > 1 else found
            few = found.select("file_id", "line_number", bucket_of(["file_id"], self.store.buckets()).alias("_b")).limit(FEW + 1).collect()
            if len(few) <= FEW:  # checked: then they are sent along, and only their buckets are read
                own = self.spark.createDataFrame([(r[0], r[1]) for r in few], found.schema)
                lines = self.store.read("lines", {r[2] for r in few}).join(F.broadcast(own), ["file_id", "line_number"], "left_semi")
            else:
                lines = lines.join(found, ["file_id", "line_number"], "left_semi")
        if isinstance(query, Unified) and not query.filters.empty:
            from siltstone.query import filters as flt

            lines = lines.join(self.files().where(flt.to_column(query.filters)).select("file_id"), "file_id", "left_semi")
        hits = lines.where(qc.matches(query, F.col("content")))
        return cap_hits(hits, cap) if cap else hits

    def files(self) -> DataFrame:
        return self.store.read("files").drop("path_key")

    def lines(self) -> DataFrame:
        return self.store.read("lines")

    # --------------------------------------------------------------- changing

    def _touched(self, df: DataFrame, key: list[str]) -> set[int]:
        """Buckets of the rows: at most as many numbers as there are buckets."""
        return {r[0] for r in df.select(bucket_of(key, self.store.buckets())).distinct().collect()}

    def _at(self, table: str, df: DataFrame, key: str) -> DataFrame:
        """The rows of a table by name that ``df`` may meet: those of its buckets."""
        return self.store.read(table, self._touched(df.where(F.col(key).isNotNull()), [key]))

    def upsert(self, files: DataFrame, lines: DataFrame) -> int:
        """Puts files in, in place of what has their identity or else their path; returns how many were changed.

        A file with a known identity keeps its ``file_id`` whatever its path (it was moved), one with a known path keeps that path's; another file
        that stood at the path goes. Files whose state and path are as they were are left alone. ``file_id`` of new files must be new.
        """
        scratch = Scratch(self.spark)
        f = self._named(files)
        by_identity = self._at("identities", f, "identity").groupBy("identity").agg(F.max("file_id").alias("same"))
        by_path = self._at("paths", f, "path_key").groupBy("path_key").agg(F.max("file_id").alias("there"))
        f = f.join(by_identity, "identity", "left").join(by_path, "path_key", "left").withColumn("sent", F.col("file_id")).withColumn("file_id", F.coalesce("same", "there", "file_id"))
        f = scratch.keep(f)
        state = [c for c in STATE if c in f.columns]
        old = self.store.read("files", self._touched(f, ["file_id"]))
        if state and "status" in old.columns and "status" in f.columns:
            was = old.where(F.lower("status") == "ok").select("file_id", "path_key", F.struct(*state).alias("_was"))
            now = f.join(was, ["file_id", "path_key"], "left")
            f = scratch.keep(now.where(~F.coalesce(F.struct(*state).eqNullSafe(F.col("_was")) & F.col("_was").isNotNull(), F.lit(False))).drop("_was"))
        gone = f.select("file_id").unionByName(f.where("there is not null").select(F.col("there").alias("file_id"))).distinct()
        renamed = f.select(F.col("sent").alias("file_id"), F.col("file_id").alias("kept"))
        fresh = lines.join(renamed, "file_id").select(F.col("kept").alias("file_id"), "line_number", "content")
        count = f.count()
        if count:
            self._replace(gone, f.drop("same", "there", "sent").select(*old.columns), fresh, scratch)
        return count

    def delete(self, paths: DataFrame, column: str = "path") -> int:
        """Takes out the files at the paths; paths of no file are passed over. Returns how many there were."""
        scratch = Scratch(self.spark)
        keys = paths.select(F.lower(F.translate(column, "\\", "/")).alias("path_key")).where("path_key is not null").distinct()
        gone = scratch.keep(self._at("paths", keys, "path_key").join(keys, "path_key", "left_semi").select("file_id").distinct())
        count = gone.count()
        if count:
            self._replace(gone, None, None, scratch)
        return count

    def _replace(self, gone: DataFrame, files: DataFrame | None, lines: DataFrame | None, scratch: Scratch) -> None:
        gone = scratch.keep(gone)
        at = self._touched(gone, ["file_id"])
        old_files = scratch.keep(self.store.read("files", at).join(gone, "file_id", "left_semi"))
        old_lines = self.store.read("lines", at).join(gone, "file_id", "left_semi")
        old = self._tables(old_files, scratch.keep(old_lines))
        new = self._tables(scratch.keep(files), scratch.keep(lines)) if files is not None else {}
        keyed = {}
        for table, (rows, key) in old.items():
            added = new[table][0] if new else None
            touched = self._touched(rows if added is None else rows.select(*key).unionByName(added.select(*key)), key)
            if touched:
                kept = self.store.read(table, touched).join(gone, "file_id", "left_anti")
                keyed[table] = (kept if added is None else kept.unionByName(added.select(*kept.columns)), key, touched)
        self.store.commit({}, keyed=keyed)
