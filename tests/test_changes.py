"""Change replay against a plain interpreter of the feed."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from siltstone.operators import changes

SCHEMA = "id long, root_path string, path string, kind int, priority int, queued_at timestamp, delivered_at timestamp, delivery_no int, size_bytes long, seen int, d string"


def rows(n: int, seed: int):
    rng, t = random.Random(seed), datetime(2030, 1, 1)
    out = []
    for i in range(1, n + 1):
        if rng.random() < 0.1:
            continue
        path = rng.choice([None, *(f"D:\\a\\F{k}.txt" for k in range(12))])
        root, kind = rng.choice(["D:\\a", "d:\\A"]), rng.choice([None, 0, 1, 1, 1, 2, 3])
        for no in range(1, rng.choice([1, 1, 2, 3]) + 1):
            if no > 1 and rng.random() < 0.3:
                kind = rng.choice([1, 2])
            p = path if path is None or rng.random() < 0.6 else rng.choice([path.upper(), path.replace("\\", "/"), "\\\\?\\" + path])
            row = (i, root, p, kind, 1, t, t + timedelta(hours=rng.randint(0, 500)), no, rng.choice([None, i]), 7, "x")
            out += [row] * rng.choice([1, 1, 2])
    rng.shuffle(out)
    return out


def interpret(data, up_to=None):
    last = {}
    for r in data:
        if r[0] not in last or r[7] > last[r[0]][7]:
            last[r[0]] = r
    state = {}
    for i in sorted(last):
        if up_to is not None and i > up_to:
            break
        _, root, path, kind, *_ = last[i]
        if path is None or kind not in (1, 2):
            continue
        key = path.lower().replace("/", "\\")
        key = key[4:] if key.startswith("\\\\?\\") else key
        state[(root, key)] = (i, kind)
    return {(root, key, i) for (root, key), (i, kind) in state.items() if kind == 1}


def test_replay_matches_the_interpreter(spark):
    for seed in (1, 2):
        data = rows(200, seed)
        got = changes.replay(spark.createDataFrame(data, SCHEMA)).select("root_path", "path_key", "id").collect()
        assert {tuple(r) for r in got} == interpret(data)
        assert len(got) == len({(r.root_path, r.path_key) for r in got})


def test_gaps_and_incomplete_transactions_hold_the_watermark(spark):
    t = datetime(2030, 1, 1)
    row = lambda i, no=1, path="p": (i, "r", path, 1, 1, t, t, no, 1, 0, "")
    mark = lambda data, first=None: changes.watermark(changes.transactions(spark.createDataFrame(data, SCHEMA)), first).first()
    assert mark([row(i) for i in (5, 6, 7, 9)]).watermark == 7
    assert mark([row(i) for i in (5, 6, 7)]).watermark == 7
    assert mark([row(5), row(6, 2), row(7)]).watermark == 5  # delivery 1 of change 6 is missing
    assert mark([row(i) for i in (2, 3)], first=1).watermark == 0
    far = 3 * changes.BLOCK
    assert mark([row(i) for i in (1, 2, far, far + 1)]).watermark == 2
    run = [row(i) for i in range(changes.BLOCK - 2, changes.BLOCK + 3)]
    assert mark(run).watermark == changes.BLOCK + 2
    data = [row(1, path="a"), row(2, path="b"), row(4, path="c")]
    got = changes.replay(spark.createDataFrame(data, SCHEMA), sealed=False)
    assert {r.path_key for r in got.collect()} == {"a", "b"}


def test_an_id_with_very_many_deliveries_completes(spark):
    t = datetime(2030, 1, 1)
    row = lambda i, no=1: (i, "r", f"p{i}", 1, 1, t, t, no, 1, 0, "")
    for n in (61, 62, 63, 64, 200):
        hot = [row(2, no) for no in range(1, n + 1)]
        full = spark.createDataFrame([row(1), *hot, *hot[:5], row(3)], SCHEMA)
        assert changes.watermark(changes.transactions(full)).first().watermark == 3
        assert changes.replay(full, sealed=False).count() == 3
        held = spark.createDataFrame([row(1), *(r for r in hot if r[7] != n - 1), row(3)], SCHEMA)
        assert changes.watermark(changes.transactions(held)).first().watermark == 1


def test_empty_feed_and_null_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert changes.replay(empty).count() == 0
    assert changes.replay(empty, sealed=False).count() == 0
    nulls = spark.createDataFrame([(None,) * 11, (1, None, "A/b", 1, None, None, None, None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in changes.replay(nulls).select("root_path", "path_key", "id").collect()] == [(None, "a\\b", 1)]


def test_feed_as_it_arrives_equals_the_whole(spark, tmp_path):
    from siltstone.streaming.feed import FeedState

    data = rows(120, 5)
    folder = tmp_path / "in"
    third = -(-len(data) // 3)
    for k in range(3):
        spark.createDataFrame(data[k * third : (k + 1) * third], SCHEMA).coalesce(1).write.parquet(str(folder / f"b{k}"))
    feed = FeedState(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    q = stream.writeStream.foreachBatch(feed.apply).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    whole = spark.createDataFrame(data, SCHEMA)
    mark = changes.watermark(changes.transactions(whole), 1).first().watermark
    assert feed.watermark() == mark
    assert {tuple(r) for r in feed.state().collect()} == interpret(data, mark)
    feed.apply(whole, 2)  # a batch that was applied before changes nothing
    assert {tuple(r) for r in feed.state().collect()} == interpret(data, mark)


def test_redelivery_across_batches_that_changes_path_and_kind(spark, tmp_path):
    """A later delivery of an applied change takes it away from its old file, which falls back to its change before."""
    from siltstone.streaming.feed import FeedState

    rng, t = random.Random(11), datetime(2030, 1, 1)
    feed = FeedState(spark, str(tmp_path / "state"), buckets=4)
    all_rows, last_no = [], {}
    for batch in range(5):
        new = []
        for i in range(batch * 12 + 1, batch * 12 + 13):
            last_no[i] = 1
            new.append((i, "r", f"p{rng.randint(0, 7)}", rng.choice([1, 1, 2]), 1, t, t, 1, i, 0, ""))
        for i in rng.sample(sorted(last_no), 6):
            last_no[i] += 1
            new.append((i, "r", f"p{rng.randint(0, 7)}", rng.choice([1, 2, 3]), 1, t, t, last_no[i], i, 0, ""))
        rng.shuffle(new)
        all_rows += new
        feed.apply(spark.createDataFrame(new, SCHEMA), batch)
        assert feed.watermark() == batch * 12 + 12
        assert {tuple(r) for r in feed.state().collect()} == interpret(all_rows), batch


def test_a_sealed_feed_passes_its_void_ids_and_an_open_one_does_not(spark):
    t = datetime(2030, 1, 1)
    row = lambda i, no=1, path="p": (i, "r", path, 1, 1, t, t, no, 1, 0, "")
    b = changes.BLOCK
    df = spark.createDataFrame([row(1, path="a"), row(2, path="b"), row(5, 2, path="c"), row(6, path="d"), row(4 * b + 7, path="e")], SCHEMA)
    tx = changes.transactions(df)
    got = {(r.lo, r.hi, r.reason) for r in changes.gaps(tx, 0).collect()}
    assert got == {(0, 0, "absent"), (3, 4, "absent"), (5, 5, "incomplete"), (7, 4 * b - 1, "absent"), (4 * b, 4 * b + 6, "absent")}
    assert changes.watermark(tx, 0, changes.gaps(tx, 0)).first().watermark == 4 * b + 7
    some = changes.gaps(tx).where("hi < 5")
    assert changes.watermark(tx, None, some).first().watermark == 4
    assert {r.path_key for r in changes.replay(df).collect()} == {"a", "b", "c", "d", "e"}
    assert {r.path_key for r in changes.replay(df, sealed=False).collect()} == {"a", "b"}


def test_a_lease_that_was_left_behind_runs_out(spark, tmp_path):
    import os

    import pytest

    from siltstone.operators.store import SnapshotStore

    store = SnapshotStore(spark, str(tmp_path / "s"), buckets=4)
    df = spark.range(20).withColumn("v", changes.F.col("id") * 2)
    store.commit({"plain": df}, keyed={"own": (df, ["id"], None)})
    lock = tmp_path / "s/.lock"
    lock.write_text("gone")
    with pytest.raises(FileExistsError):
        store.commit({"plain": df})
    os.utime(lock, (1, 1))
    only = {r.b for r in df.where("id = 3").select(changes.F.pmod(changes.F.xxhash64("id"), changes.F.lit(4)).cast("int").alias("b")).collect()}
    part = store.read("own", only)
    store.commit({}, keyed={"own": (part.where("id <> 3").select("id", (changes.F.col("v") + 1).alias("v")), ["id"], only)})
    now = {r.id: r.v for r in store.read("own").collect()}
    moved = {r.id for r in part.collect()}
    assert 3 not in now and all(now[i] == 2 * i + (i in moved) for i in range(20) if i != 3) and len(now) == 19
    assert not lock.exists() and store.sweep() >= 0
