"""The query language: trees, parsers and their compilation to columns."""

from siltstone.query.build import build_query
from siltstone.query.nodes import And, Fuzzy, MatchAll, Near, Not, Or, Regex, Term

__all__ = ["And", "Fuzzy", "MatchAll", "Near", "Not", "Or", "Regex", "Term", "build_query"]
