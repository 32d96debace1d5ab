"""The index on disk: searches, upserts, moves, deletes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from siltstone.operators.catalogue import FileIndex
from siltstone.operators.store import bucket_of, string_bucket
from siltstone.query import build_query

T = datetime(2030, 1, 1)
FILES = "file_id long, path string, identity string, status string, size_bytes long, modified timestamp, extractor_id string, extractor_version string, note string"
LINES = "file_id long, line_number long, content string, note int"


def row(i, path, identity=None, size=1, status="ok"):
    return (i, path, identity, status, size, T, "e", "1", "x")


def test_buckets_of_strings(spark):
    words = ["", "a", "query", "größe", "日本", "x" * 100]
    df = spark.createDataFrame([(w,) for w in words], "t string").select(bucket_of(["t"], 13))
    assert [r[0] for r in df.collect()] == [string_bucket(w, 13) for w in words]


def test_upsert_move_delete(spark, tmp_path):
    files = lambda *r: spark.createDataFrame(list(r), FILES)
    lines = lambda *r: spark.createDataFrame([(*x, 0) for x in r], LINES)
    ix = FileIndex(spark, str(tmp_path / "ix"), buckets=4)
    ix.build(files(row(1, "C:\\a.txt", "v:1"), row(2, "C:\\b.txt", "v:2"), row(3, "C:\\c.txt"), row(4, "C:\\bad.txt", None, 1, "error")), lines((1, 1, "alpha beta"), (2, 1, "beta"), (3, 1, "gamma"), (3, 2, None)))
    find = lambda q: sorted((r.file_id, r.line_number) for r in ix.search(build_query(q, "boolean")).collect())
    assert find("beta") == [(1, 1), (2, 1)] and find("alpha AND beta") == [(1, 1)] and find("/g.mma/") == [(3, 1)] and find("nothing") == []
    # unchanged; moved under a new number; changed under a new number; in error and sent again; new
    sent = files(row(2, "c:/B.txt", "v:2"), row(11, "C:\\moved\\a.txt", "v:1"), row(13, "c:\\C.TXT", None, 9), row(14, "C:\\bad.txt"), row(15, "C:\\new.txt", "v:9"))
    assert ix.upsert(sent, lines((2, 1, "never read"), (11, 1, "alpha moved"), (13, 1, "delta"), (14, 1, "mended"), (15, 1, "beta new"))) == 4
    assert {(r.file_id, r.path) for r in ix.files().collect()} == {(1, "C:\\moved\\a.txt"), (2, "C:\\b.txt"), (3, "c:\\C.TXT"), (4, "C:\\bad.txt"), (15, "C:\\new.txt")}
    assert find("beta") == [(2, 1), (15, 1)] and find("moved") == [(1, 1)] and find("gamma") == [] and find("mended") == [(4, 1)] and find("delta") == [(3, 1)]
    # a file moved onto another's path takes its place
    assert ix.upsert(files(row(20, "C:\\b.txt", "v:9", 5)), lines((20, 1, "beta over"))) == 1
    assert find("beta") == [(15, 1)] and {r.file_id for r in ix.files().collect()} == {1, 3, 4, 15}
    assert ix.delete(spark.createDataFrame([("c:/moved/A.txt",), ("C:\\unknown",), (None,)], "path string")) == 1
    assert find("moved") == [] and ix.store.read("postings").where(F.col("file_id") == 1).count() == 0
    assert ix.delete(spark.createDataFrame([], "path string")) == 0 and ix.upsert(files().limit(0), lines().limit(0)) == 0
    assert ix.store.manifest()["version"] == 4 and ix.store.sweep() >= 1 and find("delta") == [(3, 1)]


def test_pending_items_are_kept_each_for_itself(spark, tmp_path):
    from siltstone.streaming.queue import PendingQueue

    schema = "root string, path string, kind string, priority int, s double"
    ev = lambda *r: spark.createDataFrame(list(r), schema).withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    q = PendingQueue(spark, str(tmp_path / "q"), quiet_s=2, buckets=4)
    assert q.items().count() == 0
    q.add(ev(("r", "a", "upsert", 2, 0.0), ("r", "a", "delete", 1, 1.0), ("r", "b", "upsert", 1, 0.0), ("s", "c", "upsert", 0, 0.5), (None, "x", "upsert", 1, 0.0)), 0)
    q.add(ev(("r", "z", "upsert", 1, 9.0)), 0)  # the same batch again
    at = lambda s: F.timestamp_micros(F.lit(int(s * 1e6)))
    assert [(r.path, r.kind, r.events) for r in q.due(at(2.6)).collect()] == [("c", "upsert", 1), ("b", "upsert", 1)]
    # a root that never falls quiet doesn't hold its quiet items back
    q.add(ev(*[("r", "a", "upsert", 1, 1.0 + i / 2) for i in range(10)]), 1)
    assert {r.path for r in q.due(at(5)).collect()} == {"b", "c"}
    due = q.due(at(5))
    q.add(ev(("r", "b", "delete", 1, 4.5)), 2)  # changes while it is worked off
    q.done(spark.createDataFrame(due.where("path <> 'b'").collect(), due.schema))
    again = PendingQueue(spark, str(tmp_path / "q"), quiet_s=2)
    assert {(r.path, r.kind) for r in again.items().collect()} == {("a", "upsert"), ("b", "delete")}
    again.add(ev(("r", None, "refresh", 0, 6.0)), 3)
    got = again.due(at(20)).collect()
    assert [(r.kind, r.path) for r in got] == [("refresh", None)]
    again.done(spark.createDataFrame(got, again.due(at(20)).schema))
    assert again.items().count() == 0
    again.add(ev(("r", "n", "upsert", 1, 30.0), ("s", "m", "upsert", 1, 30.0)), 4)
    again.clear_root("r")
    assert [r.path for r in again.items().collect()] == ["m"]
