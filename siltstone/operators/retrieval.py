"""Hybrid retrieval: plan, providers, fusion, reranking, snippets.

A provider turns a request into candidates, one row each: ``provider, provider_id, path, score, file_id, line_number, text, route``. The plan names the kinds of
providers that a query needs; of each kind the indexed ones run if the index may be used and any of them is available, else the live ones. All
candidates are one DataFrame until they are fused by path, so nothing is gathered before the last sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import results, search, vectors
from siltstone.operators.catalogue import FileIndex
from siltstone.query import compile as qc
from siltstone.query.nodes import Node, Unified

COLUMNS = ["provider", "provider_id", "path", "score", "file_id", "line_number", "text", "route"]
CONTENT_KINDS = ("lexical", "regex", "fuzzy")


@dataclass
class Request:
    """``vector`` is the embedded ``semantic:`` text; ``weights`` are those of the kinds of providers, 1 if not named."""

    query: Node
    text: str
    as_of: Column
    mode: str = "unified"
    use_index: bool = True
    names: bool = False
    ocr: bool = False
    vector: list[float] | None = None
    model: str | None = None
    weights: dict[str, float] = field(default_factory=dict)
    today: date | None = None
    rerank: bool = True

    def kinds(self) -> list[str]:
        """The kinds of providers that the plan enables."""
        return list(search.plan_query(self.query, self.mode, self.ocr, self.names))


@dataclass
class Provider:
    kind: str
    provider_id: str
    find: Callable[[Request], DataFrame]
    indexed: bool = False
    available: Callable[[Request], bool] = lambda r: True

    def candidates(self, request: Request) -> DataFrame:
        own = self.find(request)
        for c, kind in (("score", "double"), ("file_id", "long"), ("line_number", "long"), ("text", "string")):
            own = own.withColumn(c, F.col(c).cast(kind) if c in own.columns else F.lit(None).cast(kind))
        route = F.lit("indexed" if self.indexed else "live")
        return own.withColumn("provider", F.lit(self.kind)).withColumn("provider_id", F.lit(self.provider_id)).withColumn("route", route).select(*COLUMNS)


def select_providers(request: Request, providers: Iterable[Provider]) -> list[Provider]:
    """The providers that run: enabled by the plan, available, and of each kind either the indexed or the others."""
    wanted = request.kinds()
    ready = [p for p in providers if p.kind in wanted and p.available(request)]
    out: list[Provider] = []
    for kind in dict.fromkeys(p.kind for p in ready):
        own = [p for p in ready if p.kind == kind]
        indexed = [p for p in own if p.indexed]
        out += indexed if request.use_index and indexed else [p for p in own if not p.indexed]
    return out


def _metadata(files: Callable[[], DataFrame]) -> Callable[[Request], DataFrame]:
    def find(r: Request) -> DataFrame:
        spec = search.metadata_terms(r.query, r.names)
        if spec:
            return search.search_metadata(files(), spec[0], r.as_of, spec[1], r.names).withColumn("text", F.concat(F.lit("File: "), "path"))
        # conditions on files alone
        from siltstone.query import filters as flt

        own = files().where(flt.to_column(r.query.filters)) if isinstance(r.query, Unified) else files().limit(0)
        return own.select("file_id", "path", (F.lit(700) + search.recency_boost(F.col("modified"), r.as_of)).alias("score"), F.concat(F.lit("File: "), "path").alias("text"))

    return find


def _with_path(hits: DataFrame, files: DataFrame) -> DataFrame:
    return hits.join(files.select("file_id", "path"), "file_id").select("file_id", "path", "line_number", F.col("content").alias("text"), F.lit(0.0).alias("score"))


def live_providers(files: DataFrame, texts: DataFrame, key: str = "doc_id") -> list[Provider]:
    """Providers that look at the files and their texts as they are."""
    content = lambda r: _with_path(search.search_texts(r.query, texts, key, files=files, today=r.today), files)
    return [Provider("metadata", "live-metadata", _metadata(lambda: files)), *(Provider(k, f"live-{k}", content) for k in CONTENT_KINDS)]


def indexed_providers(index: FileIndex, covered: Callable[[Request], bool] = lambda r: True) -> list[Provider]:
    """Providers over an index on disk; ``covered`` says whether it answers a request (see ``upkeep.coverage``)."""
    content = lambda r: _with_path(index.search(r.query, cap=search.PER_FILE), index.files())
    return [Provider("metadata", "indexed-metadata", _metadata(index.files), True, covered), *(Provider(k, f"indexed-{k}", content, True, covered) for k in CONTENT_KINDS)]


def filter_vectors(docs: DataFrame, kind: str | None = None, model: str | None = None, dimension: int | None = None, files: DataFrame | None = None) -> DataFrame:
    """Vectors of a kind and a model (both in any case) and a dimension, of the files given."""
    if kind is not None:
        docs = docs.where(F.lower("kind") == kind.lower())
    if model is not None:
        docs = docs.where(F.lower("model") == model.lower())
    if dimension is not None:
        docs = docs.where(F.size("vector") == dimension)
    return docs if files is None else docs.join(files.select("file_id").distinct(), "file_id", "left_semi")


def semantic_provider(chunks: DataFrame, files: DataFrame, text: str | None = None) -> Provider:
    """Chunks near the request's vector, by files first; available where the request has one. ``chunks``: ``id, file_id, vector``, and ``kind, model`` if they differ."""

    def find(r: Request) -> DataFrame:
        own = filter_vectors(chunks, "ContentChunk" if "kind" in chunks.columns else None, r.model if "model" in chunks.columns else None, len(r.vector))
        near = vectors.two_level(own, r.vector)
        said = chunks.select("id", F.col(text).alias("text")) if text else None
        near = near.join(said, "id", "left") if said is not None else near.withColumn("text", F.lit(None).cast("string"))
        return near.join(files.select("file_id", "path"), "file_id")

    return Provider("semantic", "semantic-vectors", find, False, lambda r: r.vector is not None)


def candidates(request: Request, providers: Iterable[Provider]) -> DataFrame | None:
    """The candidates of all providers that run; None if none does."""
    found = [p.candidates(request) for p in select_providers(request, providers)]
    out = None
    for f in found:
        out = f if out is None else out.unionByName(f)
    return out


def hybrid_search(request: Request, providers: Iterable[Provider], files: DataFrame) -> DataFrame:
    """``rank, path, score, providers, hits, best_provider, text, line_number, route``: files by fused and reranked score.

    ``text``, ``line_number`` and ``route`` are those of the best candidate: the highest score, then the lower provider id, then the first line. A request
    that no provider answers has no rows.
    """
    found = candidates(request, providers)
    if found is None:
        return files.sparkSession.createDataFrame([], "rank long, path string, score double, providers long, hits long, best_provider string, text string, line_number long, route string")
    order = F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), F.lower("provider_id").alias("p"), F.coalesce("line_number", F.lit(0)).alias("n"), F.col("text").alias("text"), F.col("line_number").alias("line"), F.col("route").alias("route"))
    best = found.groupBy(F.lower("path").alias("_k")).agg(F.min(order).alias("_b"))
    fused = results.fuse(found, request.weights).withColumn("_k", F.lower("path")).join(best, "_k")
    when = files.groupBy(F.lower("path").alias("_k")).agg(F.max("modified").alias("modified"))
    x = fused.join(when, "_k", "left").select("rank", "path", "score", "providers", "hits", "best_provider", "modified", F.col("_b.text").alias("text"), F.col("_b.line").alias("line_number"), F.col("_b.route").alias("route"))
    if request.rerank:
        x = results.rerank(x, results.rerank_terms(request.text), request.as_of)
    return x.select("rank", "path", "score", "providers", "hits", "best_provider", "text", "line_number", "route")


def with_snippets(ranked: DataFrame, query: Node, lines: DataFrame, files: DataFrame, around: int = 1) -> DataFrame:
    """Adds ``snippet, highlights``: the best line with its neighbours, or its own text where it has no line."""
    own = files.select("file_id", F.col("path"))
    wanted = ranked.join(own, "path", "left").withColumn("_from", F.col("line_number") - around).withColumn("_to", F.col("line_number") + around)
    near = wanted.where("line_number is not null").select("path", "file_id", F.explode(F.sequence("_from", "_to")).alias("line_number"))
    text = near.join(lines, ["file_id", "line_number"]).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "content"))), lambda s: s["content"]), "\\n").alias("_s"))
    x = ranked.join(text, "path", "left").withColumn("snippet", F.coalesce("_s", "text")).drop("_s")
    return x.withColumn("highlights", qc.spans(query, F.col("snippet")))


# ------------------------------------------------------------------- results


def filter_facets(df: DataFrame, chosen: dict[str, str | None], values: dict[str, Column]) -> DataFrame:
    """Rows that have all chosen facet values, in any case; a null or blank value is ``__none``, a choice of None or All is no condition."""
    for name, value in chosen.items():
        if value is not None and value.lower() != "all":
            v = values[name]
            df = df.where(F.lower(F.when(F.trim(v) == "", None).otherwise(v)).eqNullSafe(F.lit(value.lower())) if value != "__none" else (v.isNull() | (F.trim(v) == "")))
    return df


def grouped(df: DataFrame, by: str, as_of: Column) -> DataFrame:
    """Adds ``group`` and ``group_order``: by ``file``, ``folder``, ``type`` or ``modified`` (day buckets in their order, the others by name)."""
    if by == "modified":
        b = results.modified_bucket(F.col("modified"), as_of)
        return df.withColumn("group", b["label"]).withColumn("group_order", F.lpad(b["o"].cast("string"), 2, "0"))
    value = {"file": F.col("path"), "folder": F.col("directory"), "type": F.coalesce(F.nullif(F.col("ext"), F.lit("")), F.lit("(none)"))}[by]
    return df.withColumn("group", value).withColumn("group_order", F.lower(value))


def distinct_hits(hits: DataFrame) -> DataFrame:
    """Each hit once by path (in any case), kind, line and content."""
    key = F.struct(F.lower("path"), "kind", "line_number", "content")
    return hits.withColumn("_k", key).dropDuplicates(["_k"]).drop("_k")


def files_in_hit_order(hits: DataFrame, order: list[str]) -> DataFrame:
    """``path, first``: the files of hits in the order of their first hit; ``order`` names the columns of a total order."""
    first = hits.groupBy(F.lower("path").alias("_k")).agg(F.min(F.struct(*order, F.col("path").alias("_p"))).alias("b"))
    return results.ranked(first.select(F.col("b._p").alias("path"), *(F.col(f"b.{c}") for c in order)), [F.col(c) for c in order] + [F.col("path")]).select("path", F.col("rank").alias("first"))


def refine(hits: DataFrame, text: str, columns: tuple[str, ...] = ("path", "content")) -> DataFrame:
    """Hits that hold every word of a refinement in one of the columns, in any case; a blank refinement keeps all."""
    for word in text.lower().split():
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(word))
        hits = hits.where(hit)
    return hits


def semantic_status(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file_id, units, covered, ready`` of each file: its text units, how many a chunk covers, and whether all are."""
    own = units.where(F.trim(F.coalesce("unit_text", F.lit(""))) != "").select("file_id", F.col("id").alias("unit")).distinct()
    held = chunks.select("file_id", F.explode("content_unit_ids").alias("unit")).distinct().withColumn("held", F.lit(1))
    return own.join(held, ["file_id", "unit"], "left").groupBy("file_id").agg(F.count("*").alias("units"), F.count("held").alias("covered")).withColumn("ready", F.col("units") == F.col("covered"))


def merged_locators(chunks: DataFrame, units: DataFrame) -> DataFrame:
    """``id, first_line, last_line, page, kind``: where a chunk lies; page and kind where its units agree, else null."""
    own = units.groupBy(F.col("id").alias("unit")).agg(F.max(F.struct("start_line", "page", "kind")).alias("u")).select("unit", "u.*")
    x = chunks.select("id", F.explode("content_unit_ids").alias("unit")).distinct().join(own, "unit")
    same = lambda c: F.when((F.count_distinct(c) == 1) & (F.count(c) == F.count("*")), F.max(c))
    return x.groupBy("id").agg(F.min("start_line").alias("first_line"), F.max("start_line").alias("last_line"), same("page").alias("page"), same("kind").alias("kind"))


