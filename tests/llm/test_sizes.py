"""Splitting, token sizes, packing and mixing."""

from __future__ import annotations

import base64
import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import mixing, packing, splitting, tokens

needs_files = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"), reason="no tokenizer files")


# ------------------------------------------------------------------ splitting


def test_pieces_round_trip(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12))) + rng.choice([". ", "! ", "; ", ".\n", ".\n\n", "。"])
    texts = ["".join(sentence() for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["x" * 1000, "", " 　\n", None, "𝄞" * 700, " " + "a" * 200 + " ", "é" * 300, "word " * 3000]
    rows = [(i, t, rng.choice([60, 130, 200]), rng.choice([0, 1, 3]), "keep") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string, limit int, overlap_units int, extra string")
    for r in splitting.split_items(df).collect():
        t = (r.text or "").strip(splitting.WHITE)
        assert [p.piece_no for p in r.pieces] == list(range(1, len(r.pieces) + 1))
        assert (len(r.pieces) > 1) == (len(t) > r.limit) and bool(r.pieces) == bool(t) and r.extra == "keep"
        at = 0
        for p in r.pieces:
            assert p.start == at and p.piece_text == t[at - p.overlap_length : at + p.core_length] and len(p.piece_text) <= r.limit
            assert p.overlap_length == 0 if p.piece_no == 1 or r.overlap_units == 0 else 0 < p.overlap_length <= r.limit // 4
            at += p.core_length
        assert at == len(t)


def test_boundaries_and_limits(spark):
    text = "First paragraph here.\n\nSecond one. It has two sentences, and goes on"
    df = spark.createDataFrame([(text, 40, 0)], "text string, limit int, overlap_units int")
    assert [p.piece_text for p in splitting.split_items(df).first().pieces] == ["First paragraph here.\n\n", "Second one. It has two sentences, ", "and goes on"]
    opts = spark.createDataFrame([(1, None, None, None), (2, 40, 60, -1), (3, 10**6, 10**6, 99), (4, 500, 100, 2)], "option_id long, target_characters int, max_characters int, overlap_units int")
    assert {r.option_id: (r.limit, r.overlap_units) for r in splitting.limits(opts).collect()} == {1: (2400, 1), 2: (128, 0), 3: (98304, 32), 4: (500, 2)}
    units = spark.createDataFrame([(1, 1, "a" * 129), (2, 9, "a" * 2401), (3, None, "b" * 2400)], "id long, file_id long, unit_text string")
    files = spark.createDataFrame([(1, 2), (1, 2), (7, None)], "id long, option_id long")
    got = splitting.split_items(splitting.with_limits(units, files, opts), "unit_text")
    assert {r.unit_id: len(r.pieces) > 1 for r in got.collect()} == {1: True, 2: True, 3: False}
    assert splitting.split_items(splitting.with_limits(units.limit(0), files, opts), "unit_text").count() == 0


# --------------------------------------------------------------------- tokens


@needs_files
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t　\x1c\x85ab'sé1."), st.characters(codec="utf-8")), max_size=60))
def test_counts_equal_the_tokenizer(text):
    import tiktoken

    if not hasattr(test_counts_equal_the_tokenizer, "enc"):
        with open(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        test_counts_equal_the_tokenizer.enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert tokens.count_tokens(text) == len(test_counts_equal_the_tokenizer.enc.encode_ordinary(text))


@needs_files
def test_with_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, tokens int")
    assert {r.doc_id: r.tokens for r in tokens.with_tokens(df).collect()} == {1: 2, 2: 0, 3: 0}


# -------------------------------------------------------------------- packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_plan_packs_every_item_once(sizes):
    counts = np.bincount(sizes, minlength=51) if sizes else np.zeros(51, dtype=int)
    used = np.zeros(51, dtype=int)
    n = 0
    for own, times in packing.best_two_fit(counts, 50):
        assert sum(s * k for s, k in own.items()) <= 50 and times >= 1
        n += times
        for s, k in own.items():
            used[s] += k * times
    assert (used == counts).all()
    total = sum(sizes)
    assert n >= -(-total // 50) and (n <= 1 or n <= 1.7 * total / 50 + 1)


def test_two_for_the_smallest():
    # 6 + 3 leaves a gap of 1; 2 + 2 in place of 3 fills it
    assert packing.best_two_fit(np.bincount([6, 3, 2, 2], minlength=11), 10)[0] == ({6: 1, 2: 2}, 1)


def test_pack(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 7, rng.randint(1, 40), rng.randint(1, 300)]) for _ in range(800)]
    docs = spark.createDataFrame([(i, n, 1, 2) for i, n in enumerate(sizes)], "doc_id long, tokens long, size int, n int")
    budgets = spark.createDataFrame([(1, 64), (2, 256), (2, 256), (3, None), (4, 0)], "budget_id long, capacity_tokens int")
    old, packing.BLOCK_ROWS = packing.BLOCK_ROWS, 20  # so that a size is numbered in several blocks
    try:
        rows = packing.pack(spark, docs, budgets).collect()
    finally:
        packing.BLOCK_ROWS = old
    for b, cap in ((1, 64), (2, 256)):
        own = [r for r in rows if r.budget_id == b]
        per, fill = {}, {}
        for r in own:
            per[r.doc_id] = per.get(r.doc_id, 0) + r["size"]
            fill[r.bin] = fill.get(r.bin, 0) + r["size"]
            assert r.part == 1 or sizes[r.doc_id] > cap
        assert per == dict(enumerate(sizes)) and max(fill.values()) <= cap
        assert sum(sizes) / (cap * len(fill)) > 0.97
    assert {r.budget_id for r in rows} == {1, 2}
    assert packing.pack(spark, docs.limit(0), budgets).count() == 0


# --------------------------------------------------------------------- mixing


def test_source_names(spark):
    df = spark.createDataFrame([(x,) for x in ("File-Share", " mailbox ", "CODE notes", None, " ", "a__b")], "s string")
    assert [r[0] for r in df.select(mixing.source_name(F.col("s"))).collect()] == ["file_share", "mailbox", "code_notes", None, None, "a_b"]


def test_draw_matches_brute_force(spark):
    rng = random.Random(6)
    data = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), rng.choice([0, rng.randint(1, 50)]), rng.choice([0.1, 0.5, 1.0]), 1.5, 3) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, source string, tokens long, weight double, k double, upto int")
    mixes = spark.createDataFrame([(1, "A", 0.5, 1, 0.5), (1, "b", 0.3, 2, 0.5), (1, "c", 0.4, None, 0.5), (1, "nowhere", 0.1, 3, 0.5), (2, "b", 3.0, 0, 0.1), (2, "c", None, 1, 0.1)], "mix_id long, source string, target_share double, max_repeats int, size_factor double")
    old, mixing.RANGE_ROWS = mixing.RANGE_ROWS, 40
    try:
        got = {(r.mix_id, r.doc_id): r.copies for r in mixing.draw(spark, docs, mixes).collect()}
        shares = {(r.mix_id, r.source): r for r in mixing.report(docs, mixes, mixing.draw(spark, docs, mixes)).collect()}
    finally:
        mixing.RANGE_ROWS = old
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing.uniform(F.col("doc_id"), 7).alias("u")).collect()}
    total, want = sum(r[2] for r in data), {}
    for mix, src, share, cap in ((1, "a", 0.5 / 1.3, 1), (1, "b", 0.3 / 1.3, 2), (1, "c", 0.4 / 1.3, None), (2, "b", 1.0, 0)):
        own = sorted((-math.log(u[r[0]]) / r[3], r[0], r[2]) for r in data if r[1] == src and r[2] > 0)
        have, budget = sum(x[2] for x in own), share * (0.5 if mix == 1 else 0.1) * total
        epochs = int(budget // have) if cap is None else min(int(budget // have), cap)
        left, upto = (budget - epochs * have if cap is None or epochs < cap else 0.0), 0
        for _, i, n in own:
            upto += n
            copies = epochs + (upto - n / 2 <= left)
            if copies:
                want[(mix, i)] = copies
    assert got == want
    assert shares[(1, "nowhere")].tokens == 0 and shares[(2, "b")].tokens == 0
    assert sum(shares[(1, s)].actual_share for s in "abc") == pytest.approx(1)
    assert shares[(1, "c")].most_copies > 1 and shares[(1, "b")].most_copies <= 2
    assert mixing.draw(spark, docs.limit(0), mixes).count() == 0


def test_weights_bias_the_draw(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("tokens"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("weight"))
    mixes = spark.createDataFrame([(1, "a", 1.0, 1, 0.1)], "mix_id long, source string, target_share double, max_repeats int, size_factor double")
    got = [r.doc_id % 2 for r in mixing.draw(spark, docs, mixes).collect()]
    assert len(got) == 400 and 0.72 < got.count(0) / len(got) < 0.88


def test_key_ranges_hold_alike_many_documents(spark, monkeypatch):
    """However many ranges a source has, and whatever its weights, none is much fuller than the others, and ranges rise with the key."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), (0.05 + 0.95 * F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("weight"))
    k = -F.log(mixing.uniform(F.col("doc_id"), 7)) / F.col("weight")
    x = df.withColumn("k", k).join(mixing.key_shares(df), "source").withColumn("r", F.floor(mixing.share_below(F.col("k"), F.col("shares")) * F.col("ranges")))
    n = x.groupBy("r").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("r").collect()
    assert len(n) > 1150 and max(r.n for r in n) <= 2 * 50
    assert all(a.hi <= b.lo for a, b in zip(n, n[1:], strict=False))


def test_a_long_item_is_cut_in_proportion(spark):
    text = " ".join(f"word{i}" + ("." if i % 9 == 0 else "") for i in range(60_000))
    df = spark.createDataFrame([(1, text, 2400, 2)], "id int, text string, limit int, overlap_units int")
    got = splitting.split_items(df).selectExpr("inline(pieces)").orderBy("piece_no").collect()
    assert "".join(r.piece_text[r.overlap_length :] for r in got) == text and max(len(r.piece_text) for r in got) <= 2400
    assert all(b.start == a.start + a.core_length for a, b in zip(got, got[1:], strict=False)) and all(r.overlap_length > 0 for r in got[1:])
    lens = spark.createDataFrame([([3] * 200,), ([],), ([5],)], "n array<int>")
    sums = [r[0] for r in lens.select(splitting.running(lens["n"])).collect()]
    assert sums == [[3 * i for i in range(1, 201)], [], [5]]
