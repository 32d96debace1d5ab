"""Queries of hybrid retrieval and of what becomes of its results, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import retrieval
from siltstone.operators.retrieval import Request
from siltstone.plans.index_queries import _lines, stored_index
from siltstone.plans.search_queries import _AS_OF_US, _DAY, AS_OF, FILES_SQL, LINES_SQL
from siltstone.query import build_query
from siltstone.runtime import read
from siltstone.sources.adapters import document_files

QUERIES, SQL = {}, {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _files(spark: SparkSession, d: str) -> DataFrame:
    return document_files(read(spark, d, "documents"))


def _providers(spark: SparkSession, d: str) -> list[retrieval.Provider]:
    files = _files(spark, d)
    chunks = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("file_id"), F.col("embedding").alias("vector"), F.lit("ContentChunk").alias("kind"), F.lit("M1").alias("model"))
    return [*retrieval.live_providers(files, read(spark, d, "documents").select("doc_id", "text")), *retrieval.indexed_providers(stored_index(spark, d)), retrieval.semantic_provider(chunks, files)]


def _request(text: str, **more) -> Request:
    return Request(build_query(text), text, F.lit(AS_OF), **more)


def _run(spark: SparkSession, d: str, request: Request) -> DataFrame:
    out = retrieval.hybrid_search(request, _providers(spark, d), _files(spark, d))
    return out.select("rank", "path", F.round("score", 6).alias("score"), "providers", "hits", "best_provider", "text", "line_number", "route")


def _fused_sql(candidates: str, terms: list[str], weights: dict[str, float] | None = None) -> str:
    w = " ".join(f"WHEN '{k}' THEN {v}" for k, v in (weights or {}).items())
    weight = f"CASE provider {w} ELSE 1.0 END" if w else "1.0"
    name = " + ".join(f"CASE WHEN stem = '{t}' THEN 0.30 WHEN contains(name, '{t}') THEN 0.18 WHEN contains(lower(path), '{t}') THEN 0.06 ELSE 0 END" for t in terms)
    body = " + ".join(f"CASE WHEN contains(lower(COALESCE(text, '')), '{t}') THEN 0.03 ELSE 0 END" for t in terms)
    return f"""c AS ({candidates}),
  o AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY score DESC, lower(provider_id), COALESCE(line_number, 0), text) AS n FROM c),
  g AS (SELECT lower(path) AS k, min(path) AS path, sum({weight} * CASE WHEN score > 0 THEN score ELSE 1.0 END) AS score, count(DISTINCT provider) AS providers, count(*) AS hits, max(CASE WHEN n = 1 THEN provider_id END) AS best_provider,
     max(CASE WHEN n = 1 THEN text END) AS text, max(CASE WHEN n = 1 THEN line_number END) AS line_number, max(CASE WHEN n = 1 THEN route END) AS route FROM o GROUP BY 1),
  m AS (SELECT lower(path) AS k, max(modified) AS modified FROM files GROUP BY 1),
  b AS (SELECT g.*, lower(split_part(path, '/', -1)) AS name, regexp_replace(lower(split_part(path, '/', -1)), '\\.[^.]+$', '') AS stem, ({_AS_OF_US} - modified) / {_DAY}.0 AS days FROM g LEFT JOIN m USING (k)),
  r AS (SELECT *, score + least(least({name}, 0.45) + least({body}, 0.18) + least(0.05 * (providers - 1), 0.15) + least(0.03 * ln(hits + 1.0), 0.12)
     + CASE WHEN days IS NULL THEN 0 WHEN days <= 7 THEN 0.08 WHEN days <= 30 THEN 0.05 WHEN days <= 365 THEN 0.02 ELSE 0 END, 0.75) AS s FROM b)
  SELECT row_number() OVER (ORDER BY s DESC, lower(path)) AS rank, path, round(CAST(s AS DOUBLE), 6) AS score, providers, hits, best_provider, text, line_number, route FROM r"""


def _lexical_sql(word: str, provider: str, route: str) -> str:
    """Whole tokens where the index is asked, any place in a line where it isn't."""
    token = f" AND list_contains(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{Nd}}_]+'), '{word}')" if route == "indexed" else ""
    return f"SELECT 'lexical' AS provider, '{provider}' AS provider_id, path, 0.0 AS score, line_number, content AS text, '{route}' AS route FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number) AS nth FROM lines WHERE contains(lower(content), '{word}'){token}) l JOIN files USING (file_id) WHERE nth <= 1000"


_META_TERM = """SELECT 'metadata' AS provider, '{id}' AS provider_id, path, CAST(points + CASE WHEN modified IS NULL THEN 0 WHEN ({now} - modified) / {day}.0 <= 7 THEN 50 WHEN ({now} - modified) / {day}.0 <= 30 THEN 25 WHEN ({now} - modified) / {day}.0 <= 365 THEN 10 ELSE 0 END AS DOUBLE) AS score,
    NULL AS line_number, 'File: ' || path AS text, '{route}' AS route FROM (
   SELECT *, CASE WHEN lower(file_name) = '{t}' OR lower(stem) = '{t}' THEN 1000 WHEN starts_with(lower(file_name), '{t}') OR starts_with(lower(stem), '{t}') THEN 800 WHEN ext = '.{t}' THEN 700
     WHEN len(list_filter(string_split(lower(path), '/'), lambda x: x = '{t}' OR regexp_replace(x, '\\.[^.]+$', '') = '{t}')) > 0 THEN 600 WHEN contains(lower(file_name), '{t}') THEN 450 WHEN contains(lower(directory), '{t}') THEN 300 WHEN contains(lower(path), '{t}') THEN 200 ELSE 0 END AS points FROM files WHERE status <> 'indexing')
   WHERE points > 0 ORDER BY score DESC, modified DESC NULLS LAST, lower(path), file_id LIMIT 200"""


def _meta_sql(term: str, provider: str, route: str) -> str:
    return _META_TERM.format(id=provider, now=_AS_OF_US, day=_DAY, t=term, route=route)


for _name, _use, _route in (("hybrid_search", True, "indexed"), ("hybrid_live", False, "live")):
    _add(_name, lambda s, d, u=_use: _run(s, d, _request("depot", use_index=u, weights={"metadata": 2.0})),
         f"WITH {FILES_SQL}, {LINES_SQL}, " + _fused_sql(f"({_meta_sql('depot', f'{_route}-metadata', _route)}) UNION ALL {_lexical_sql('depot', f'{_route}-lexical', _route)}", ["depot"], {"metadata": 2.0}))


def hybrid_filters(spark: SparkSession, d: str) -> DataFrame:
    """Conditions on files with a regular expression: the plan asks for metadata and regex providers."""
    return _run(spark, d, _request("ext:pdf /arch[io]v/"))


_add("hybrid_filters", hybrid_filters, f"WITH {FILES_SQL}, {LINES_SQL}, " + _fused_sql(f"""SELECT 'metadata' AS provider, 'indexed-metadata' AS provider_id, path, CAST(700 + CASE WHEN modified IS NULL THEN 0 WHEN ({_AS_OF_US} - modified) / {_DAY}.0 <= 7 THEN 50 WHEN ({_AS_OF_US} - modified) / {_DAY}.0 <= 30 THEN 25 WHEN ({_AS_OF_US} - modified) / {_DAY}.0 <= 365 THEN 10 ELSE 0 END AS DOUBLE) AS score,
  NULL AS line_number, 'File: ' || path AS text, 'indexed' AS route FROM files WHERE ext = '.pdf'
  UNION ALL SELECT 'regex', 'indexed-regex', path, 0.0, line_number, content, 'indexed' FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number) AS nth FROM lines WHERE regexp_matches(lower(content), 'arch[io]v')) l JOIN files USING (file_id) WHERE nth <= 1000 AND ext = '.pdf'""", ["ext", "pdf", "arch", "io"]))  # fmt: skip


def hybrid_semantic(spark: SparkSession, d: str) -> DataFrame:
    """``semantic:`` alone, over the files and chunks of one vector each."""
    v = read(spark, d, "embeddings").where("vec_id = 3").select("embedding").first()[0]
    return _run(spark, d, _request("semantic:minutes", vector=[float(x) for x in v], model="m1", rerank=False)).drop("text", "line_number", "route")


_add("hybrid_semantic", hybrid_semantic, f"""WITH {FILES_SQL}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, q),
  t AS (SELECT vec_id, s FROM s WHERE s > 0 ORDER BY s DESC, vec_id LIMIT 25), x AS (SELECT path, s AS score FROM t JOIN files ON file_id = vec_id),
  g AS (SELECT min(path) AS path, sum(score) AS score, 1 AS providers, count(*) AS hits, 'semantic-vectors' AS best_provider FROM x GROUP BY lower(path))
  SELECT row_number() OVER (ORDER BY score DESC, lower(path)) AS rank, path, round(score, 6) AS score, providers, hits, best_provider FROM g""")


def provider_routes(spark: SparkSession, d: str) -> DataFrame:
    """Which providers run, with their candidates, for requests of each kind."""
    out = None
    for text, more in (("depot", {}), ("depot", {"use_index": False}), ("archiv~1", {}), ("/arch.v/", {}), ("ext:pdf", {})):
        c = retrieval.candidates(_request(text, **more), _providers(spark, d))
        n = c.groupBy("provider", "provider_id", "route").agg(F.count("*").alias("candidates")).withColumn("request", F.lit(text + "".join(f" {k}" for k in more)))
        out = n if out is None else out.unionByName(n)
    return out.select("request", "provider", "provider_id", "route", F.when(F.col("provider") == "fuzzy", None).otherwise(F.col("candidates")).alias("candidates"))


_add("provider_routes", provider_routes, f"""WITH {FILES_SQL}, {LINES_SQL}, w AS (SELECT count(*) AS n FROM ({_lexical_sql('depot', 'x', 'indexed')}) y), v AS (SELECT count(*) AS n FROM lines JOIN files USING (file_id) WHERE contains(lower(content), 'depot')), r AS (SELECT count(*) AS n FROM lines JOIN files USING (file_id) WHERE regexp_matches(lower(content), 'arch.v'))
  SELECT * FROM (SELECT 'depot' AS request, 'lexical' AS provider, 'indexed-lexical' AS provider_id, 'indexed' AS route, n AS candidates FROM w UNION ALL SELECT 'depot use_index', 'lexical', 'live-lexical', 'live', n FROM v
  UNION ALL SELECT 'depot', 'metadata', 'indexed-metadata', 'indexed', (SELECT count(*) FROM ({_meta_sql('depot', 'x', 'x')}) z) UNION ALL SELECT 'depot use_index', 'metadata', 'live-metadata', 'live', (SELECT count(*) FROM ({_meta_sql('depot', 'x', 'x')}) z)
  UNION ALL SELECT 'archiv~1', 'fuzzy', 'indexed-fuzzy', 'indexed', NULL UNION ALL SELECT '/arch.v/', 'regex', 'indexed-regex', 'indexed', n FROM r
  UNION ALL SELECT 'ext:pdf', 'metadata', 'indexed-metadata', 'indexed', (SELECT count(*) FROM ({_meta_sql('pdf', 'x', 'x')}) z)) WHERE candidates IS NULL OR candidates > 0""")


# ------------------------------------------------------------------- results


def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    values = {"type": F.col("ext"), "status": F.col("status"), "folder": F.col("root")}
    return retrieval.filter_facets(f, {"type": ".PDF", "status": "ok", "folder": "All"}, values).select("file_id", "path")


_add("facet_filter", facet_filter, f"WITH {FILES_SQL} SELECT file_id, path FROM files WHERE ext = '.pdf' AND status = 'ok'")
_add("facet_filter_none", lambda s, d: retrieval.filter_facets(read(s, d, "documents"), {"source": "__none"}, {"source": F.col("source")}).select("doc_id"), "SELECT doc_id FROM documents WHERE source IS NULL OR trim(source) = ''")
for _by, _sql in (("folder", "directory AS \"group\", lower(directory) AS group_order"), ("type", "COALESCE(NULLIF(ext, ''), '(none)') AS \"group\", lower(COALESCE(NULLIF(ext, ''), '(none)')) AS group_order")):
    _add(f"result_groups_{_by}", lambda s, d, b=_by: retrieval.grouped(_files(s, d), b, F.lit(AS_OF)).groupBy("group", "group_order").agg(F.count("*").alias("n")), f"WITH {FILES_SQL} SELECT {_sql}, count(*) AS n FROM files GROUP BY ALL")
_add("result_groups_modified", lambda s, d: retrieval.grouped(_files(s, d), "modified", F.lit(AS_OF)).groupBy("group", "group_order").agg(F.count("*").alias("n")),
     f"""WITH {FILES_SQL}, x AS (SELECT date_diff('day', CAST(make_timestamp(modified) AS DATE), CAST(make_timestamp({_AS_OF_US}) AS DATE)) AS days FROM files)
     SELECT CASE WHEN days <= 0 THEN 'today' WHEN days <= 7 THEN 'last 7 days' WHEN days <= 30 THEN 'last 30 days' WHEN days > 30 THEN 'older' ELSE 'unknown' END AS "group", CASE WHEN days <= 0 THEN '01' WHEN days <= 7 THEN '02' WHEN days <= 30 THEN '03' WHEN days > 30 THEN '04' ELSE '05' END AS group_order, count(*) AS n FROM x GROUP BY ALL""")  # fmt: skip


def _hits(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).where(F.contains(F.lower("content"), F.lit("archive")))
    own = lines.join(_files(spark, d).select("file_id", "path"), "file_id").withColumn("kind", F.lit("line"))
    return own.unionByName(own.withColumn("path", F.upper("path")))


_HITS = f"WITH {FILES_SQL}, {LINES_SQL}, h AS (SELECT path, line_number, content, file_id FROM lines JOIN files USING (file_id) WHERE contains(lower(content), 'archive'))"
_add("distinct_hits", lambda s, d: retrieval.distinct_hits(_hits(s, d)).select(F.lower("path").alias("path"), "line_number", "content"), f"{_HITS} SELECT DISTINCT lower(path) AS path, line_number, content FROM h")
_add("refine_hits", lambda s, d: retrieval.refine(_hits(s, d), "Team  PDF").select("path", "line_number"), f"{_HITS} SELECT p AS path, line_number FROM (SELECT unnest([path, upper(path)]) AS p, line_number, content FROM h) WHERE (contains(lower(p), 'team') OR contains(lower(content), 'team')) AND (contains(lower(p), 'pdf') OR contains(lower(content), 'pdf'))")
_add("files_in_hit_order", lambda s, d: retrieval.files_in_hit_order(_hits(s, d), ["file_id", "line_number"]), f"{_HITS}, g AS (SELECT lower(path) AS k, min((file_id, line_number)) AS b FROM h GROUP BY 1) SELECT (SELECT min(upper(path)) FROM h WHERE lower(path) = k AND h.file_id = b[1]) AS path, row_number() OVER (ORDER BY b) AS first FROM g")
_add("semantic_status", lambda s, d: retrieval.semantic_status(read(s, d, "content_units"), read(s, d, "content_chunks")),
     r"""WITH u AS (SELECT DISTINCT file_id, id FROM content_units WHERE trim(COALESCE(unit_text, '')) <> ''), c AS (SELECT DISTINCT file_id, unnest(content_unit_ids) AS id FROM content_chunks)
     SELECT u.file_id, count(*) AS units, count(c.id) AS covered, count(*) = count(c.id) AS ready FROM u LEFT JOIN c ON c.file_id = u.file_id AND c.id = u.id GROUP BY u.file_id""")  # fmt: skip
_add("chunk_locators", lambda s, d: retrieval.merged_locators(read(s, d, "content_chunks"), read(s, d, "content_units")),
     """WITH x AS (SELECT DISTINCT id, unnest(content_unit_ids) AS unit FROM content_chunks), u AS (SELECT DISTINCT id AS unit, start_line, page, kind FROM content_units)
     SELECT id, min(start_line) AS first_line, max(start_line) AS last_line, CASE WHEN count(DISTINCT page) = 1 AND count(page) = count(*) THEN max(page) END AS page, CASE WHEN count(DISTINCT kind) = 1 AND count(kind) = count(*) THEN max(kind) END AS kind FROM x JOIN u USING (unit) GROUP BY id""")  # fmt: skip
