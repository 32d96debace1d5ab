"""Query trees as Columns over a line's text.

``matches`` is the predicate, ``spans`` the highlights (``array<struct<start,length>>``, 0-based,
in code points), ``prefilter`` a sound condition on the whole text that lines come from.
All are built-in expressions; no row leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.binding import let
from siltstone.query import filters as flt
from siltstone.query.nodes import And, FieldFilter, FileFilters, Fuzzy, MatchAll, Near, Node, Not, Or, Regex, Term, Unified

#: Fixed value: what a token is.
TOKEN = r"[\p{L}\p{Nd}_]+"
_SPAN = "array<struct<start:int,length:int>>"
_MARK = "\x01"
_compilers: dict[type, Callable[[Node, Column], Column]] = {}


def register(kind: type, matcher: Callable[[Node, Column], Column]) -> None:
    """Adds a predicate for a node type of your own."""
    _compilers[kind] = matcher


def java_pattern(node: Term | Regex) -> str:
    flags = "" if node.case_sensitive else "(?iu)"
    return flags + (re.escape(node.text) if isinstance(node, Term) else node.pattern)


def matches(node: Node, line: Column, today: date | None = None) -> Column:
    """Whether a line matches; null lines match nothing (not even a negation)."""
    return F.coalesce(line.isNotNull() & _matches(node, F.coalesce(line, F.lit("")), today or date(1970, 1, 1)), F.lit(False))


def _matches(node: Node, line: Column, today: date) -> Column:
    rec = lambda n: _matches(n, line, today)
    if type(node) in _compilers:
        return _compilers[type(node)](node, line)
    if isinstance(node, Unified):
        return rec(node.content)
    if isinstance(node, MatchAll):
        return F.lit(True)
    if isinstance(node, Term):
        return F.contains(line, F.lit(node.text)) if node.case_sensitive else F.contains(F.lower(line), F.lit(node.text.lower()))
    if isinstance(node, Regex):
        return line.rlike(java_pattern(node))
    if isinstance(node, Fuzzy):
        text, term = (line, node.text) if node.case_sensitive else (F.lower(line), node.text.lower())
        return F.exists(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.levenshtein(t, F.lit(term), node.distance) >= 0)
    if isinstance(node, And):
        return reduce(lambda a, b: a & b, map(rec, node.children))
    if isinstance(node, Or):
        return reduce(lambda a, b: a | b, map(rec, node.children))
    if isinstance(node, Not):
        return ~rec(node.child)
    if isinstance(node, Near):
        return rec(node.left) & rec(node.right) & _near(node, line, today)
    if isinstance(node, FieldFilter):
        f = FileFilters()
        flt.narrow(f, node.name, node.value, today)
        return F.coalesce(flt.to_column(f), F.lit(False))
    raise TypeError(f"no compiler for {type(node).__name__}")


def regex_spans(line: Column, pattern: str) -> Column:
    """Non-overlapping matches, left to right, without empty ones: the matches are marked, the line is split at the marks and the offsets are added up."""
    parts = F.split(F.regexp_replace(F.translate(line, _MARK, " "), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), none.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        found = (acc["k"] % 2 == 1) & (F.char_length(p) > 0)
        span = F.array(F.struct(acc["at"].alias("start"), F.char_length(p).alias("length")))
        return F.struct((acc["at"] + F.char_length(p)).alias("at"), (acc["k"] + 1).alias("k"), F.when(found, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def spans(node: Node, line: Column, today: date | None = None) -> Column:
    """Highlights of a matching line: of every branch of AND and NEAR, of the matching branches of OR, none of NOT."""
    today = today or date(1970, 1, 1)
    rec = lambda n: spans(n, line, today)
    none = F.array().cast(_SPAN)
    if isinstance(node, Unified):
        return rec(node.content)
    if isinstance(node, (Term, Regex)):
        return regex_spans(line, java_pattern(node))
    if isinstance(node, Fuzzy):
        text, term = (line, node.text) if node.case_sensitive else (F.lower(line), node.text.lower())
        return F.filter(regex_spans(line, TOKEN), lambda s: F.levenshtein(F.substring(text, s["start"] + 1, s["length"]), F.lit(term), node.distance) >= 0)
    if isinstance(node, And):
        return F.concat(*map(rec, node.children))
    if isinstance(node, Near):
        return F.concat(rec(node.left), rec(node.right))
    if isinstance(node, Or):
        return F.concat(*(F.when(_matches(c, line, today), rec(c)).otherwise(none) for c in node.children))
    return none


def _near(node: Near, line: Column, today: date) -> Column:
    """Some pair of spans with at most n tokens between, in either order; a side without spans is near everything, a span that touches no token near nothing."""

    def over(tokens: Column) -> Column:
        def place(found: Column) -> Column:
            # the first and last token that each span touches
            def touched(s: Column) -> Column:
                inside = lambda t: (t["start"] < s["start"] + s["length"]) & (t["start"] + t["length"] > s["start"])
                before = F.size(F.filter(tokens, lambda t: t["start"] + t["length"] <= s["start"]))
                return F.struct(before.alias("first"), (before + F.size(F.filter(tokens, inside)) - 1).alias("last"))

            return F.filter(F.transform(found, touched), lambda p: p["last"] >= p["first"])

        def pair(a: Column, b: Column) -> Column:
            close = lambda x, y: F.greatest(y["first"] - x["last"] - 1, x["first"] - y["last"] - 1, F.lit(0)) <= node.distance
            return F.exists(a, lambda x: F.exists(b, lambda y: close(x, y)))

        def sides(l: Column) -> Column:  # noqa: E741
            return let(spans(node.right, line, today), lambda r: (F.size(l) == 0) | (F.size(r) == 0) | let(place(l), lambda a: let(place(r), lambda b: pair(a, b))))

        return let(spans(node.left, line, today), sides)

    return let(regex_spans(line, TOKEN), over)


def _needs(node: Node) -> list[str] | None:
    """Terms of which one at least must stand in the text of a match; None if no such set is known."""
    if isinstance(node, Unified):
        return _needs(node.content)
    if isinstance(node, Term) and not re.search(r"[\r\n]", node.text):
        return [node.text]
    if isinstance(node, And):
        known = [n for n in map(_needs, node.children) if n]
        return min(known, key=len) if known else None
    if isinstance(node, Near):
        return _needs(And((node.left, node.right)))
    if isinstance(node, Or):
        known = list(map(_needs, node.children))
        return [t for n in known for t in n] if all(known) else None
    return None


def prefilter(node: Node, text: Column) -> Column:
    """A condition that every text with a matching line fulfils; it is checked before the text is cut into lines."""
    terms = _needs(node)
    if not terms:
        return F.lit(True)
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(t.lower())) for t in terms))


def candidate_tokens(node: Node) -> list[frozenset[str]]:
    """Token conjunctions of which one must hold for a match, for a look-up in postings; empty: scan everything."""
    if isinstance(node, Unified):
        return candidate_tokens(node.content)
    if isinstance(node, Term):
        t = frozenset(x.lower() for x in re.findall(r"[^\W]+", node.text))
        return [t] if t else []
    if isinstance(node, Near):
        return candidate_tokens(And((node.left, node.right)))
    if isinstance(node, And):
        needed: frozenset[str] = frozenset()
        for c in node.children:
            own = candidate_tokens(c)
            if own:
                needed |= frozenset.intersection(*own)
        return [needed] if needed else []
    if isinstance(node, Or):
        each = [candidate_tokens(c) for c in node.children]
        return [t for own in each for t in own] if all(each) else []
    return []
