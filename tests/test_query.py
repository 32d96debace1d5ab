"""Query language: trees, truth tables and spans."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from siltstone.query import And, Fuzzy, MatchAll, Near, Not, Or, Regex, Term, build_query
from siltstone.query import compile as qc
from siltstone.query import filters as flt
from siltstone.query.build import QueryError
from siltstone.query.nodes import FieldFilter, simplify

T = Term


def match(spark, node, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return [r.m for r in df.select("i", qc.matches(node, F.col("line")).alias("m")).orderBy("i").collect()]


def spans(spark, node, line):
    df = spark.createDataFrame([(line,)], "line string")
    return [(s.start, s.length) for s in df.select(qc.spans(node, F.col("line")).alias("s")).first().s]


def test_terms_and_regexes(spark):
    assert match(spark, T("Foo"), "a foo", "bar", None, "FOO", "") == [True, False, False, True, False]
    assert match(spark, T("Foo", True), "a foo", "a Foo") == [False, True]
    assert match(spark, Regex(r"\d+"), "a1", "b") == [True, False]
    assert match(spark, Regex("ÖL"), "Möl", "mol") == [True, False]
    assert match(spark, Not(T("x")), "x", "y", "", None) == [False, True, True, False]
    assert match(spark, And((T("a"), Or((T("b"), T("c"))))), "a b", "a", "c a", "b c") == [True, False, True, False]
    assert match(spark, MatchAll(), "", None) == [True, False]


def test_spans(spark):
    assert spans(spark, T("ab"), "ababab") == [(0, 2), (2, 2), (4, 2)]
    assert spans(spark, Regex("x*"), "axxb") == [(1, 2)]
    assert spans(spark, Or((T("a"), T("zz"))), "cab") == [(1, 1)]
    assert spans(spark, Not(T("a")), "b") == []
    assert spans(spark, T("é"), "𝄞é") == [(1, 1)]
    assert spans(spark, Fuzzy("invoice", 2), "an invioce here") == [(3, 7)]


def test_near(spark):
    n = lambda k: Near(T("alpha"), T("beta"), k)
    assert match(spark, n(2), "alpha x y beta", "beta x y alpha", "alpha x y z beta", "alpha", "alphabeta") == [True, True, False, False, True]
    assert match(spark, n(0), "alpha beta", "alpha, beta", "alpha x beta") == [True, True, False]
    assert match(spark, Near(T("alpha"), Not(T("beta")), 0), "alpha zzz", "alpha beta") == [True, False]
    assert match(spark, Near(T("!!"), T("alpha"), 9), "!! alpha") == [False]


def test_fuzzy(spark):
    assert match(spark, Fuzzy("invoice", 1), "invioce", "invoce", "invoice") == [False, True, True]
    assert match(spark, Fuzzy("invoice", 2), "invioce", "voice") == [True, True]


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a b", And((T("a"), T("b")))),
        ("a AND b AND c", And((T("a"), T("b"), T("c")))),
        ("a OR b c", Or((T("a"), And((T("b"), T("c")))))),
        ("a OR b OR c d", Or((T("a"), T("b"), And((T("c"), T("d")))))),
        ("NOT NOT a", Not(Not(T("a")))),
        ("(a OR b) c", And((Or((T("a"), T("b"))), T("c")))),
        ('"a b" /x\\/y/', And((T("a b"), Regex("x/y")))),
        ("not a", Not(T("a"))),
        ('"q \\" r"', T('q " r')),
        ('a"b', T('a"b')),
    ],
)
def test_boolean_trees(text, tree):
    assert build_query(text, "boolean") == tree


@pytest.mark.parametrize("text", ["", "  ", '"a', "/a", "(a", "a)", "AND a", "a OR", "NOT", "()"])
def test_boolean_errors(text):
    with pytest.raises(QueryError):
        build_query(text, "boolean")


def test_unified():
    q = build_query("name:report ext:pdf,*.docx invoice NEAR/3 total wor?d fuz~2 size:>5mb modified:2029", today=date(2030, 3, 1))
    assert q.content == And((Near(T("invoice"), T("total"), 3), Regex(r"\bwor.d\b"), Fuzzy("fuz", 2)))
    assert q.filters.name == ["report"] and q.filters.extensions == [".pdf", ".docx"] and q.filters.size_min == 5 * 1024**2
    assert (q.filters.modified_from.year, q.filters.modified_before.year) == (2029, 2030)
    assert [c.field for c in q.chips][:3] == ["Name", "Ext", "Content"]
    assert build_query("type:pdf OR foo").content == MatchAll()
    assert build_query("foo NOT type:pdf").content == And((T("foo"), Not(FieldFilter("type", "pdf"))))
    strict = build_query("foo NOT type:pdf", strict_reference=True)
    assert strict.filters.type_extensions == [".pdf"] and strict.content == And((T("foo"), Not(MatchAll())))
    assert build_query("NEAR/3").content == MatchAll()
    assert build_query('name:"a b"').filters.name == ["a b"]
    assert build_query("semantic:budget").has_semantic
    for bad in ("size:abc", "modified:someday", "size:1x"):
        with pytest.raises(QueryError):
            build_query(bad)


def test_sentences():
    q = build_query("pdf files about quarterly budgets modified last month larger than 5mb", today=date(2030, 3, 31))
    assert q.filters.type_extensions == [".pdf"] and q.semantic == ("quarterly budget",) and q.filters.size_min == 5 * 1024**2
    assert q.filters.modified_from.date() == date(2030, 2, 28)
    assert build_query("spreadsheets with invoices").content == T("invoice")
    assert build_query("plain words only").content == And((T("plain"), T("words"), T("only")))
    assert build_query("reports from this week pdf", today=date(2030, 3, 1)).filters.modified_from.date() == date(2030, 2, 25)


def test_values():
    assert flt.size_range("1k..2k") == (1024, 2048) and flt.size_range("<=3") == (None, 3) and flt.size_range("1.5mb") == (1572864, 1572864)
    d = lambda t: tuple(x and x.date() for x in flt.date_range(t, date(2030, 3, 31)))
    assert d("yesterday") == (date(2030, 3, 30), date(2030, 3, 31))
    assert d("<2030-01-05") == (None, date(2030, 1, 6)) and d(">2030") == (date(2030, 1, 1), None)
    assert d("last-winter") == (date(2029, 12, 1), date(2030, 3, 1)) and d("this-fall") == (date(2030, 9, 1), date(2030, 12, 1))
    assert d("2029-01-01..2029-02-01") == (date(2029, 1, 1), date(2029, 2, 2))


def test_simplify_and_candidates():
    assert simplify(And((MatchAll(), T("a")))) == T("a") and simplify(Or((MatchAll(), T("a")))) == MatchAll()
    assert simplify(Near(MatchAll(), T("a"), 1)) == T("a")
    c = qc.candidate_tokens
    assert c(And((T("a b"), Not(T("c"))))) == [frozenset({"a", "b"})]
    assert c(Or((T("a"), Regex("x")))) == [] and c(Or((T("a"), T("b")))) == [frozenset({"a"}), frozenset({"b"})]


def test_own_predicate(spark):
    from dataclasses import dataclass

    from siltstone.query.nodes import Node

    @dataclass(frozen=True)
    class Longer(Node):
        n: int

    qc.register(Longer, lambda node, line: F.char_length(line) > node.n)
    assert match(spark, And((Longer(3), T("a"))), "abcd", "a", "bcde") == [True, False, False]
