"""Searching lines, names and metadata."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.query import compile as qc
from siltstone.query import filters as flt
from siltstone.query.nodes import And, Node, Not, Or, Term, Unified
from siltstone.runtime import spread
from siltstone.sources.adapters import text_lines

#: Hits kept of one file.
PER_FILE = 1000


def search_texts(query: Node, texts: DataFrame, key: str, text: str = "text", files: DataFrame | None = None, cap: int | None = PER_FILE, today: date | None = None) -> DataFrame:
    """Content hits ``file_id, line_number, content`` of a query over whole texts.

    The file's conditions come first, then a condition on the uncut text, then the lines;
    at most ``cap`` hits of a file are kept, in line order (None keeps all). A combined query must match on one line.
    """
    if isinstance(query, Unified) and files is not None and not query.filters.empty:
        texts = texts.join(files.where(flt.to_column(query.filters)).select(F.col("file_id").alias(key)), key, "left_semi")
    lines = text_lines(spread(texts.select(key, text).where(qc.prefilter(query, F.col(text)))), key, text)
    hits = lines.where(qc.matches(query, F.col("content"), today))
    return cap_hits(hits, cap) if cap else hits


def search_lines(query: Node, lines: DataFrame, today: date | None = None) -> DataFrame:
    """The lines that match, with their columns."""
    return lines.where(qc.matches(query, F.col("content"), today))


def cap_hits(hits: DataFrame, cap: int = PER_FILE, key: str = "file_id", order: str = "line_number") -> DataFrame:
    """The first ``cap`` hits of each file in line order; the window drops rows beyond the cap while it sorts."""
    return hits.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_rank") <= cap).drop("_rank")


def highlights(query: Node, hits: DataFrame, today: date | None = None) -> DataFrame:
    """One row per highlight: the hit's columns with ``start`` and ``length``."""
    return hits.withColumn("_s", F.explode(qc.spans(query, F.col("content"), today))).select(*hits.columns, F.col("_s.start").alias("start"), F.col("_s.length").alias("length"))


def merge_highlights(found: Column) -> Column:
    """Spans in order of their start, overlaps clipped, for display."""
    kind = "array<struct<start:int,length:int>>"

    def step(acc: Column, s: Column) -> Column:
        end = F.coalesce(F.try_element_at(acc, F.lit(-1))["start"] + F.try_element_at(acc, F.lit(-1))["length"], F.lit(0))
        start = F.greatest(end, s["start"])
        left = s["start"] + s["length"] - start
        return F.when(left > 0, F.concat(acc, F.array(F.struct(start.alias("start"), left.alias("length"))))).otherwise(acc)

    return F.aggregate(F.array_sort(found), F.array().cast(kind), step)


def _scored(query: Node, score: Column, columns: list[tuple[Column, int]]) -> Column:
    out = F.lit(None).cast("int")
    for c, points in reversed(columns):
        out = F.when(qc.matches(query, c), points).otherwise(out)
    return out


def search_names(query: Node, files: DataFrame) -> DataFrame:
    """Files whose name, relative path or path matches: ``file_id, path, text, score`` (900, 600, 300: the first that matches)."""
    body = query.content if isinstance(query, Unified) else query
    own = files if not isinstance(query, Unified) else files.where(flt.to_column(query.filters))
    hits = own.withColumn("score", _scored(body, F.lit(0), [(F.col("file_name"), 900), (F.col("rel_path"), 600), (F.col("path"), 300)])).where("score is not null")
    return hits.select("file_id", "path", F.concat(F.lit("File name match: "), "file_name").alias("text"), "score")


def search_folders(query: Node, files: DataFrame) -> DataFrame:
    """Folders whose name or path matches, each folder once: ``path, text, score``."""
    segments = F.split("directory", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, 1, n), "/"))
    folders = files.select(F.explode(levels).alias("path")).distinct().withColumn("name", F.substring_index("path", "/", -1)).withColumn("rel", F.regexp_replace("path", r"^[^/]*/?", ""))
    hits = folders.withColumn("score", _scored(query, F.lit(0), [(F.col("name"), 900), (F.col("rel"), 600), (F.col("path"), 300)])).where("score is not null")
    return hits.select("path", F.concat(F.lit("Folder name match: "), "name").alias("text"), "score")


# ----------------------------------------------------------------- metadata


def metadata_terms(query: Node, target_names: bool = False, plain: bool = False) -> tuple[list[str], bool, bool] | None:
    """``(terms, all required, dominant)`` if metadata alone can answer the query, else None."""
    clean = lambda t: t.strip().strip('*?"').lower()
    like_path = lambda t: any(c in "/\\.*?" or c.isdigit() for c in t)
    if isinstance(query, Unified):
        if not query.has_content:
            terms = list(dict.fromkeys(filter(None, map(clean, query.metadata_terms))))
            return (terms, True, True) if terms else None
        query = query.content
    need_all = True
    if isinstance(query, Term):
        raw = [query.text]
    elif isinstance(query, And):
        parts = [c for c in query.children if not isinstance(c, Not)]
        if not parts or not all(isinstance(c, Term) for c in parts):
            return None
        raw = [c.text for c in parts]
    elif isinstance(query, Or):
        if not all(isinstance(c, Term) for c in query.children):
            return None
        raw, need_all = [c.text for c in query.children], False
        if not target_names and not any(map(like_path, raw)):
            return None
    else:
        return None
    terms = list(dict.fromkeys(filter(None, map(clean, raw))))
    if not terms:
        return None
    dominant = target_names or isinstance(query, Term) and len(terms) == 1 or any(map(like_path, terms)) or plain
    return (terms, need_all, dominant) if dominant else None


def metadata_score(terms: list[str], need_all: bool = True, names_only: bool = False) -> Column:
    """Points of the terms over name, extension, segments and path, added up; a required term without points makes 0."""
    name, stem = F.lower("file_name"), F.lower("stem")
    path = F.lit("") if names_only else F.lower("path")
    folder = F.lit("") if names_only else F.lower("directory")
    segments = F.split(path, "/")
    total, missing = F.lit(0), F.lit(False)
    def segment(lit: Column) -> Column:
        return F.exists(segments, lambda s: (s == lit) | (F.regexp_replace(s, r"\.[^.]+$", "") == lit))

    for t in terms:
        lit = F.lit(t)
        ext = F.lit(t if t.startswith(".") else f".{t}")
        points = (
            F.when((name == lit) | (stem == lit), 1000)
            .when(F.startswith(name, lit) | F.startswith(stem, lit), 800)
            .when(F.lower("ext") == ext, 700)
            .when(segment(lit), 600)
            .when(F.contains(name, lit), 450)
            .when(F.contains(folder, lit), 300)
            .when(F.contains(path, lit), 200)
            .otherwise(0)
        )
        total, missing = total + points, missing | (points == 0)
    return F.when(missing, 0).otherwise(total) if need_all else total


def recency_boost(modified: Column, as_of: Column) -> Column:
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(modified.cast("timestamp"))) / F.lit(86_400_000_000)
    return F.when(modified.isNull(), 0).when(days <= 7, 50).when(days <= 30, 25).when(days <= 365, 10).otherwise(0)


def usage_boost(opens: Column, last: Column, as_of: Column) -> Column:
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / F.lit(86_400_000_000)
    fresh = F.when(last.isNull(), 0).when(days <= 1, 75).when(days <= 7, 40).when(days <= 30, 20).otherwise(0)
    return F.least(F.lit(100), F.coalesce(opens, F.lit(0)) * 10) + fresh


def record_opens(log: DataFrame, key: str = "path", at: str = "ts") -> DataFrame:
    """``key, open_count, last_opened`` of a log of opens."""
    return log.groupBy(key).agg(F.count("*").alias("open_count"), F.max(at).alias("last_opened"))


def search_metadata(files: DataFrame, terms: list[str], as_of: Column, need_all: bool = True, names_only: bool = False, limit: int = 200, opens: DataFrame | None = None) -> DataFrame:
    """The best files by metadata: ``file_id, path, score``, score descending, then modified (null last), then path; ``limit`` is the feature's size."""
    own = files.where(F.coalesce("status", F.lit("")) != "indexing")
    if opens is not None:
        own = own.join(opens, "path", "left")
    base = metadata_score(terms, need_all, names_only)
    own = own.withColumn("_base", base).where("_base > 0")
    score = F.col("_base") + recency_boost(F.col("modified"), as_of)
    if opens is not None:
        score = score + usage_boost(F.col("open_count"), F.col("last_opened"), as_of)
    ranked = own.withColumn("score", score.cast("bigint")).orderBy(F.desc("score"), F.desc_nulls_last("modified"), F.lower("path"), "file_id").limit(limit)
    return ranked.select("file_id", "path", "score")


def plan_query(query: Node, mode: str = "unified", ocr: bool = False, names: bool = False) -> dict[str, list[str]]:
    """Which candidate providers a query needs, with their layers."""

    def content(n: Node) -> set[str]:
        if isinstance(n, Unified):
            return content(n.content) | ({"semantic"} if n.has_semantic else set())
        if isinstance(n, (And, Or)):
            return set().union(*map(content, n.children))
        if isinstance(n, Not):
            return content(n.child)
        if type(n).__name__ == "Near":
            return {"lexical"} | content(n.left) | content(n.right)
        return {"MatchAll": set(), "Regex": {"regex"}, "Fuzzy": {"fuzzy"}}.get(type(n).__name__, {"lexical"})

    kinds = content(query) | ({"regex"} if mode == "regex" else set()) | ({"ocr"} if ocr else set())
    if names or metadata_terms(query) or isinstance(query, Unified) and not query.filters.empty:
        kinds.add("metadata")
    layer = {"metadata": "instant", "semantic": "smart", "ocr": "smart"}
    order = ("metadata", "lexical", "regex", "fuzzy", "semantic", "ocr")
    return {k: [layer.get(k, "deep")] for k in order if k in kinds}


