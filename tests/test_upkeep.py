"""Profiles, coverage, root names and ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import results, upkeep, vectors
from siltstone.operators.store import CONTENT_VERSION
from siltstone.operators.upkeep import Profile, coverage


def test_profiles_round_trip_and_cover():
    p = Profile.of(True, False, ["TXT", ".md"], [".tmp"], ["Src"], ["bin", "obj"], True)
    assert Profile.parse(p.encode()) == p
    assert p.encode() == "v1|recursive=1|hidden=0|include=.md,.txt|exclude=.tmp|includeDirs=src|excludeDirs=bin,obj|ocr=1"
    assert Profile.parse("v0|a|b|c|d") is None and Profile.parse(None) is None and Profile.parse("v1|recursive=1") is None
    assert Profile.parse("v1|recursive=1|hidden=1|include=|exclude=") == Profile.of(True, True)
    whole = Profile.of()
    assert whole.covers(Profile.of(include=[".txt"])) and not Profile.of(include=[".txt"]).covers(whole)
    assert not Profile.of(recursive=False).covers(whole) and not whole.covers(Profile.of(hidden=True)) and not whole.covers(Profile.of(ocr=True))
    assert Profile.of(exclude=[".log"]).covers(Profile.of(exclude=[".log", ".tmp"])) and not Profile.of(exclude_dirs=["bin"]).covers(whole)
    assert Profile.of(include_dirs=["a", "b"]).covers(Profile.of(include_dirs=["A"])) and not Profile.of(include_dirs=["a"]).covers(whole)


def test_coverage_in_its_order():
    asked, row = Profile.of(), {"indexed_at": 5, "content_version": CONTENT_VERSION, "options": Profile.of().encode(), "extractors": "x1", "identity": "v:1"}
    say = lambda r, **k: coverage(asked, ["/d"], r, **k)[0]
    assert coverage(asked, ["/d"], row, use_index=False)[0] == "Disabled" and coverage(asked, ["/a", "/b"], row)[0] == "Unsupported"
    assert say(None) == "Missing" and say(row | {"indexed_at": 0, "content_version": "old"}) == "Missing"
    assert say(row | {"content_version": "old"}) == "Incompatible" and say(row, extractors="x2") == "Incompatible" and say(row, identity="v:2") == "Incompatible"
    assert say(row | {"options": "nonsense"}) == "Incompatible" and say(row | {"options": Profile.of(recursive=False).encode()}) == "Incompatible"
    assert say(row, extractors="x1", identity="v:1") == "Covered" and say(5) == "Error"


def test_root_names(spark):
    df = spark.createDataFrame([("D:/Shares/A/",), ("d:\\shares\\a",), ("C:\\",), ("c:",), (None,)], "p string")
    assert [r[0] for r in df.select(upkeep.root_key(F.col("p"))).collect()] == ["d:\\shares\\a", "d:\\shares\\a", "c:\\", "c:\\", None]


def test_fusion_breaks_ties_by_provider_in_any_case(spark):
    for order in (["live-regex", "Live-Lexical"], ["Live-Lexical", "live-regex"]):
        c = spark.createDataFrame([("p", i, "a.txt", 7.0) for i in order] + [("p", "a-first", "a.txt", None)], "provider string, provider_id string, path string, score double")
        assert results.fuse(c).first().best_provider == "Live-Lexical"


def test_two_levels_fall_back_to_all_chunks(spark):
    # the file's mean points away from the query, one of its chunks doesn't
    df = spark.createDataFrame([(1, 1, [1.0, 0.2]), (2, 1, [-5.0, 0.0])], "id int, file_id int, vector array<double>")
    assert [r.id for r in vectors.two_level(df, [1.0, 0.0]).collect()] == [1]
    assert vectors.two_level(df.limit(0), [1.0, 0.0]).count() == 0
