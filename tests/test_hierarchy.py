"""Hierarchies against a walk up from every item."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.operators import hierarchy

SCHEMA = "volume_id long, file_reference_number string, parent_file_reference_number string, last_observed_usn long, item_name string, is_directory boolean, observed_at timestamp, num string, root int"
T = datetime(2030, 1, 1)


def hexed(n: int) -> str:
    return n.to_bytes(16, "little").hex().upper()


def forest(seed: int, n: int = 120):
    rng = random.Random(seed)
    parents = {1: None}
    for i in range(2, n):
        parents[i] = rng.choice([None, i, 10**6, *([rng.randint(max(1, i - 6), i - 1)] * 8)])
    a, b = n + 1, n + 2
    parents |= {a: b, b: a, n + 3: a, n + 4: n + 3, 2**100 + 5: 1}
    rows = []
    for i, p in parents.items():
        spell = lambda x: None if x is None else rng.choice([str(x), "00" + str(x), hexed(x)])
        name = rng.choice([None, f"n{i}"])
        rows.append((1, spell(i), spell(p), 50, name, True, T, "x", 0))
        if rng.random() < 0.3:
            rows.append((1, spell(i), spell(rng.choice(list(parents))), rng.choice([None, 3]), "old", True, T, "x", 0))
        if rng.random() < 0.2:
            rows.append(rows[-1])
    rows.append((2, "1", "2", 1, "other volume", False, T, "x", 0))
    rng.shuffle(rows)
    return rows, parents


def walk(parents: dict) -> dict:
    out = {}
    for x in parents:
        path, seen = [x], {x}
        while True:
            p = parents[path[-1]]
            if p is None or p == path[-1] or p not in parents:
                out[x] = (path[-1], len(path) - 1)
                break
            if p in seen:
                loop = path[path.index(p) :]
                out[x] = (min(loop), -1)
                break
            path.append(p)
            seen.add(p)
    return out


def above(parents: dict, x: int) -> list[int]:
    """The items above one, from the root or from the item on a loop that it hangs from; none for one on a loop."""
    up: list[int] = []
    while not on_loop(parents, x):
        p = parents[x]
        if p is None or p == x or p not in parents:
            break
        up.append(p)
        x = p
    return up[::-1]


def on_loop(parents: dict, x: int) -> bool:
    seen, p = set(), parents[x]
    while p is not None and p in parents and p not in seen and p != parents[p]:
        if p == x:
            return True
        seen.add(p)
        p = parents[p]
    return False


@pytest.mark.parametrize("finish", [0, 20, 50_000])
def test_matches_walking_up(spark, finish):
    rows, parents = forest(3, 60)
    items = hierarchy.current_items(spark.createDataFrame(rows, SCHEMA))
    tree = hierarchy.hierarchy(items, finish_rows=finish)
    got = {int(r.num): r for r in tree.where("volume_id = 1").collect()}
    want = walk(parents)
    assert {k: (int(r.root), r.depth) for k, r in got.items()} == want
    below = {k: 0 for k in parents}
    for k, r in got.items():
        # below a loop the ancestors begin with the item on the loop, so what hangs there has descendants too
        assert [int(a) for a in r.ancestors] == above(parents, k)
        for a in r.ancestors:
            below[int(a)] += 1
        if r.depth >= 0:
            assert r.path.count("\\") == r.depth
    assert all(got[k].subtree == below[k] + 1 for k in parents)
    pairs = {(int(r.ancestor), int(r.descendant), r.distance) for r in hierarchy.descendants(tree).where("volume_id = 1").collect()}
    assert len(pairs) == sum(len(above(parents, k)) for k in parents)
    assert [tuple(r) for r in tree.where("volume_id = 2").select("num", "root", "depth").collect()] == [("1", "1", 0)]


def test_numbers(spark):
    cases = [2**128 - 1, 2**64, 2**64 - 1, 10**18, 0, 281474976710696, 3 * 10**36 + 7]
    df = spark.createDataFrame([(hexed(n), str(n)) for n in cases], "h string, d string")
    for r in df.select(hierarchy.decimal_text(F.col("h")).alias("x"), "d").collect():
        assert r.x == r.d
    odd = spark.createDataFrame([("007",), ("  9 ",), ("",), (None,), ("0",)], "h string")
    assert [r[0] for r in odd.select(hierarchy.decimal_text(F.col("h"))).collect()] == ["7", "9", None, None, "0"]


def test_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy.hierarchy(hierarchy.current_items(empty)).count() == 0
    nulls = spark.createDataFrame([(None,) * 9, (None, "5", None, None, None, None, None, None, None)], SCHEMA)
    got = hierarchy.hierarchy(hierarchy.current_items(nulls)).collect()
    assert [(r.num, r.depth) for r in got] == [("5", 0)]


@pytest.mark.parametrize("finish", [0, 5])
def test_long_chains_and_loops_by_doubling(spark, finish):
    parents: dict = {1: None} | {i: i - 1 for i in range(2, 42)}
    parents |= {100: 106} | {i: i - 1 for i in range(101, 107)}  # a loop of seven
    parents |= {200: 103} | {i: i - 1 for i in range(201, 211)}  # a tail of eleven below it
    parents |= {300: 300, 301: 302, 302: 301, 303: 301, 304: 303, 305: 303}
    items = spark.createDataFrame([(1, str(k), None if p is None else str(p), f"n{k}", True) for k, p in parents.items()], "volume_id long, num string, parent string, item_name string, is_directory boolean")
    got = {int(r.num): r for r in hierarchy.hierarchy(items, finish_rows=finish).collect()}
    want = walk(parents)
    assert {k: (int(r.root), r.depth) for k, r in got.items()} == want
    below = {k: 0 for k in parents}
    for k, r in got.items():
        assert [int(a) for a in r.ancestors] == above(parents, k), k
        assert r.path == (None if r.depth < 0 else "\\".join(f"n{x}" for x in [*above(parents, k), k]))
        for a in r.ancestors:
            below[int(a)] += 1
    assert all(got[k].subtree == below[k] + 1 for k in parents)
    lean = hierarchy.hierarchy(items, finish_rows=finish, want=())
    assert lean.columns == ["volume_id", "num", "root", "depth", "subtree"] and lean.count() == len(parents)
