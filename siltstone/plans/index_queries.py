"""Queries over the index, its results and its vectors, with the SQL they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import index, results, search, upkeep, vectors
from siltstone.operators.catalogue import FileIndex
from siltstone.plans.search_queries import _AS_OF_US, _DAY, AS_OF, FILES_SQL, LINES_SQL
from siltstone.query import build_query
from siltstone.runtime import Scratch, read
from siltstone.sources.adapters import document_files, indexed_files, text_lines

QUERIES, SQL = {}, {}
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{Nd}}_]+')"


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return text_lines(read(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return document_files(read(spark, d, "documents"))


# ------------------------------------------------------------------ tokens, postings

_add("postings_build", lambda s, d: index.postings(_lines(s, d)), f"WITH {LINES_SQL} SELECT DISTINCT unnest({_TOK.format('content')}) AS token, file_id, line_number FROM lines")
_add("postings_counts", lambda s, d: index.postings(_lines(s, d)).groupBy("token").agg(F.count("*").alias("lines"), F.count_distinct("file_id").alias("files")),
     f"WITH {LINES_SQL}, p AS (SELECT DISTINCT unnest({_TOK.format('content')}) AS token, file_id, line_number FROM lines) SELECT token, count(*) AS lines, count(DISTINCT file_id) AS files FROM p GROUP BY token")
_add("metadata_tokens", lambda s, d: index.metadata_tokens(_files(s, d)), f"""WITH {FILES_SQL}, c AS (SELECT *, CASE WHEN ext = '.csv' OR ext IN ('.txt','.docx','.odt','.pdf','.eml') THEN 'document' ELSE 'other' END AS cat FROM files),
  n AS (SELECT DISTINCT file_id, unnest({_TOK.format("file_name || ' ' || stem || ' ' || replace(rel_path, '/', ' ')")}) AS t FROM c)
  SELECT DISTINCT file_id, unnest({_TOK.format("path || ' ' || directory || ' ' || ext || ' ' || cat")}) AS token FROM c
  UNION SELECT file_id, t FROM n UNION SELECT file_id, substr(t, 1, CAST(k AS INTEGER)) FROM n, range(2, least(31, length(t) - 1) + 1) AS r(k)""")
_add("metadata_token_lookup", lambda s, d: index.lookup(index.metadata_tokens(_files(s, d)), ["teams", "pdf"], ["file_id"]), f"WITH {FILES_SQL} SELECT file_id FROM files WHERE list_contains({_TOK.format('path')}, 'teams') AND ext = '.pdf' OR regexp_matches(lower(rel_path), '(^|[^\\p{{L}}\\p{{Nd}}_])teams') AND ext = '.pdf'")
_add("content_units_build", lambda s, d: index.content_units(_lines(s, d)), f"WITH {LINES_SQL} SELECT file_id, line_number, 'Text' AS kind, content AS unit_text, sha256(content) AS content_hash, 'line ' || line_number AS locator FROM lines")


_BUILT: dict[tuple[str, str], FileIndex] = {}


def stored_index(spark: SparkSession, d: str) -> FileIndex:
    """The index of the documents: built once a session and folder of tables, then only read."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        folder = f"{Scratch(spark).base}/index-{uuid.uuid4().hex}"
        _BUILT[key] = FileIndex(spark, folder, buckets=8).build(_files(spark, d), _lines(spark, d))
    return _BUILT[key]


def indexed_term_search(spark: SparkSession, d: str) -> DataFrame:
    return stored_index(spark, d).search(build_query('"query planner" OR (archivist NOT junior)', "boolean"))


_add("indexed_term_search", indexed_term_search, f"""WITH {LINES_SQL}, t AS (SELECT *, {_TOK.format('content')} AS k FROM lines)
  SELECT file_id, line_number, content FROM t WHERE list_has_all(k, ['query', 'planner']) AND contains(lower(content), 'query planner')
  OR list_contains(k, 'archivist') AND NOT contains(lower(content), 'junior')""")

def _own_paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files with a path and an identity of their own, and the documents."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    f = _files(spark, d).select("file_id", F.concat("path", F.lit("#"), "file_id").alias("path"), "size_bytes", "created", "modified", "status", "extractor_id", F.lit("1").alias("extractor_version"))
    return f.withColumn("identity", F.concat(F.lit("v1:"), "file_id")), docs


def _changed_index(spark: SparkSession, d: str) -> FileIndex:
    """An index of four fifths of the documents after upserts, moves and deletes."""
    f, docs = _own_paths(spark, d)
    old = F.col("file_id") % 5 != 0
    own = FileIndex(spark, f"{Scratch(spark).base}/index-{uuid.uuid4().hex}", buckets=8).build(f.where(old), text_lines(docs.where("doc_id % 5 <> 0"), "doc_id"))
    amended = F.col("doc_id") % 7 == 0
    # every document is sent again: a seventh with another text, a thirteenth from another path and under another number; the rest is unchanged
    moved = F.col("file_id") % 13 == 0
    sent = f.withColumn("size_bytes", F.when(F.col("file_id") % 7 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    sent = sent.withColumn("path", F.when(moved, F.concat("path", F.lit(".moved"))).otherwise(F.col("path"))).withColumn("file_id", F.when(moved, F.col("file_id") + 1_000_000_000).otherwise(F.col("file_id")))
    text = docs.withColumn("text", F.when(amended, F.concat(F.col("text"), F.lit("\namended line"))).otherwise(F.col("text"))).withColumn("doc_id", F.when(F.col("doc_id") % 13 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")))
    own.upsert(sent, text_lines(text, "doc_id"))
    own.delete(f.where("file_id % 11 = 0").select("path"))
    return own


def index_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """Files with their lines and tokens after upserts, moves and deletes: what the tables of the index hold, each read for itself."""
    ix = _changed_index(spark, d)
    n = ix.lines().groupBy("file_id").agg(F.count("*").alias("lines"))
    t = ix.store.read("postings").groupBy("file_id").agg(F.count("*").alias("postings"))
    zero = F.lit(0).cast("bigint")
    return ix.files().join(n, "file_id", "left").join(t, "file_id", "left").select("file_id", "path", "size_bytes", F.coalesce("lines", zero).alias("lines"), F.coalesce("postings", zero).alias("postings"))


_CHANGED = f"""{FILES_SQL}, own AS (SELECT CASE WHEN file_id % 13 = 0 AND file_id % 5 = 0 THEN file_id + 1000000000 ELSE file_id END AS file_id, file_id AS doc_id, path || '#' || file_id || CASE WHEN file_id % 13 = 0 THEN '.moved' ELSE '' END AS path, size_bytes + CASE WHEN file_id % 7 = 0 THEN 1 ELSE 0 END AS size_bytes
    FROM files WHERE file_id % 11 <> 0 OR file_id % 13 = 0),
  amended AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'amended line' ELSE text END AS text FROM documents)"""
_add("index_after_changes", index_after_changes, f"""WITH {_CHANGED}, {LINES_SQL.replace('documents', 'amended')}, k AS (SELECT file_id, count(*) AS lines, sum(len(list_distinct({_TOK.format('content')}))) AS postings FROM lines GROUP BY 1)
  SELECT o.file_id, o.path, o.size_bytes, COALESCE(k.lines, 0) AS lines, CAST(COALESCE(k.postings, 0) AS BIGINT) AS postings FROM own o LEFT JOIN k ON k.file_id = o.doc_id""")
_add("index_search_after_changes", lambda s, d: _changed_index(s, d).search(build_query("amended AND line", "boolean")), f"WITH {_CHANGED}, {LINES_SQL.replace('documents', 'amended')} SELECT o.file_id, line_number, content FROM lines l JOIN own o ON o.doc_id = l.file_id WHERE contains(lower(content), 'amended') AND contains(lower(content), 'line')")

# --------------------------------------------------------------------------- joins


def _once(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["id"])


def index_lines_join(spark: SparkSession, d: str) -> DataFrame:
    lines = _once(read(spark, d, "indexed_lines")).select("file_id", "content_unit_id", "line_number", "content")
    units = _once(read(spark, d, "content_units")).select(F.col("id").alias("content_unit_id"), "kind", "extractor_id")
    return index.line_scan(lines, indexed_files(read(spark, d, "indexed_files")), units).select("path", "line_number", "content", "kind", "extractor_id")


_FILES2 = "f AS (SELECT id AS file_id, replace(arg_max(path, indexed_at), '\\', '/') AS path, arg_max(status, indexed_at) AS status, arg_max(root_id, indexed_at) AS root_id, arg_max({'e': error}, indexed_at).e AS error, arg_max(size_bytes, indexed_at) AS size_bytes, arg_max({'m': modified_at}, indexed_at).m AS modified_at, max(indexed_at) AS indexed_at, arg_max(extractor_id, indexed_at) AS extractor_id, arg_max(extractor_version, indexed_at) AS extractor_version FROM indexed_files GROUP BY id)"
_add("index_lines_join", index_lines_join, f"WITH {_FILES2} SELECT f.path, l.line_number, l.content, u.kind, u.extractor_id FROM (SELECT DISTINCT * FROM indexed_lines) l JOIN f ON f.file_id = l.file_id AND f.status = 'ok' LEFT JOIN (SELECT DISTINCT id, kind, extractor_id FROM content_units) u ON u.id = l.content_unit_id")


def failed_files_join(spark: SparkSession, d: str) -> DataFrame:
    roots = read(spark, d, "index_roots").select(F.col("id").alias("root_id"), "root_path").distinct()
    f = indexed_files(read(spark, d, "indexed_files")).where("status in ('error', 'skipped')")
    return f.join(F.broadcast(roots), "root_id").select("root_path", "path", "status", "error")


_add("failed_files_join", failed_files_join, f"WITH {_FILES2} SELECT root_path, path, status, error FROM f JOIN (SELECT DISTINCT id, root_path FROM index_roots) r ON r.id = f.root_id WHERE status IN ('error', 'skipped')")


def path_root_theta_join(spark: SparkSession, d: str) -> DataFrame:
    return index.containing_roots(read(spark, d, "pending_changes").where("path is not null"), read(spark, d, "index_roots"))


_add("path_root_theta_join", path_root_theta_join, r"""SELECT DISTINCT path, r.id AS root_id FROM (SELECT DISTINCT path FROM pending_changes WHERE path IS NOT NULL) p JOIN index_roots r
  ON starts_with(lower(replace(path, '\', '/')) || '/', lower(replace(root_path, '\', '/')) || '/')""")

# -------------------------------------------------------------- differences, reports


def _seen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An index and the tree found later: every fifth file gone, every seventh grown, every eleventh moved."""
    f = indexed_files(read(spark, d, "indexed_files"))
    there = f.where("file_id % 5 <> 0").withColumn("size_bytes", F.when(F.col("file_id") % 7 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return f, there.withColumn("path", F.when(F.col("file_id") % 11 == 0, F.concat("path", F.lit(".bak"))).otherwise(F.col("path")))


_DIFF = f"""WITH {_FILES2}, s AS (SELECT CASE WHEN file_id % 11 = 0 THEN path || '.bak' ELSE path END AS path, size_bytes + CASE WHEN file_id % 7 = 0 THEN 1 ELSE 0 END AS size_bytes, modified_at, extractor_id, extractor_version FROM f WHERE file_id % 5 <> 0),
  x AS (SELECT COALESCE(s.path, f.path) AS path, f.status, CASE WHEN f.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'removed' WHEN f.status = 'ok' AND s.size_bytes IS NOT DISTINCT FROM f.size_bytes AND s.modified_at IS NOT DISTINCT FROM f.modified_at
        AND s.extractor_id IS NOT DISTINCT FROM f.extractor_id AND s.extractor_version IS NOT DISTINCT FROM f.extractor_version THEN 'unchanged' ELSE 'changed' END AS change FROM s FULL JOIN f ON s.path = f.path)"""
_add("index_diff", lambda s, d: index.difference(*reversed(_seen(s, d))), f"{_DIFF} SELECT path, change FROM x")
_add("validate_drift", lambda s, d: index.drifts(*reversed(_seen(s, d))), f"{_DIFF} SELECT path, CASE change WHEN 'new' THEN 'missing' WHEN 'removed' THEN 'orphaned' ELSE CASE WHEN status <> 'ok' THEN 'failed' ELSE 'stale' END END AS kind FROM x WHERE change <> 'unchanged'")
_add("stale_files", lambda s, d: index.stale(*_seen(s, d)).select("file_id", "path"), f"WITH {_FILES2} SELECT file_id, path FROM f WHERE file_id % 5 = 0 OR file_id % 11 = 0")
_add("refreshed_index", lambda s, d: index.refresh(*_seen(s, d)).select("path", "size_bytes"), f"{_DIFF} SELECT path, size_bytes FROM s")
_add("root_stats", lambda s, d: index.root_stats(indexed_files(read(s, d, "indexed_files"))), f"WITH {_FILES2} SELECT root_id, count(*) AS files, count_if(status = 'ok') AS ok_files, count_if(status = 'error') AS failed_files, count_if(status = 'skipped') AS skipped_files, CAST(sum(size_bytes) AS BIGINT) AS bytes, epoch_us(max(indexed_at)) AS last_indexed_us FROM f GROUP BY root_id")

_add("root_lines", lambda s, d: index.root_stats(indexed_files(read(s, d, "indexed_files")), _once(read(s, d, "indexed_lines"))).select("root_id", "ok_files", "lines"),
     f"WITH {_FILES2}, n AS (SELECT file_id, count(*) AS n FROM (SELECT DISTINCT * FROM indexed_lines) GROUP BY 1) SELECT root_id, count_if(status = 'ok') AS ok_files, CAST(COALESCE(sum(CASE WHEN status = 'ok' THEN n END), 0) AS BIGINT) AS lines FROM f LEFT JOIN n USING (file_id) GROUP BY root_id")


def database_info(spark: SparkSession, d: str) -> DataFrame:
    f = indexed_files(read(spark, d, "indexed_files")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.unix_micros(F.max("indexed_at")).alias("last_indexed_us"))
    one = F.lit(1)
    n = lambda t, name: read(spark, d, t).agg(F.count_distinct("id").alias(name))
    return f.join(n("indexed_lines", "lines"), one == one).join(n("content_units", "units"), one == one).join(n("content_chunks", "chunks"), one == one)


_add("database_info", database_info, f"WITH {_FILES2} SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, epoch_us(max(indexed_at)) AS last_indexed_us, (SELECT count(DISTINCT id) FROM indexed_lines) AS lines, (SELECT count(DISTINCT id) FROM content_units) AS units, (SELECT count(DISTINCT id) FROM content_chunks) AS chunks FROM f")
_add("root_health", lambda s, d: index.root_health(read(s, d, "index_roots"), indexed_files(read(s, d, "indexed_files")), read(s, d, "index_volumes"), read(s, d, "pending_changes").where("kind = 0")),
     f"""WITH {_FILES2}, p AS (SELECT root_path, count(*) AS n FROM pending_changes WHERE kind = 0 GROUP BY 1), g AS (SELECT root_id, count_if(status = 'error') AS bad, count_if(status = 'indexing') AS run, count(*) AS n FROM f GROUP BY 1)
     SELECT r.id AS root_id, CASE WHEN v.health IS NULL THEN 'offline' WHEN COALESCE(g.n, 0) = 0 THEN 'empty' WHEN g.run > 0 THEN 'indexing' WHEN g.bad >= 25 THEN 'failing' WHEN v.health <> 'ok' THEN 'stale'
       WHEN r.update_strategy = 'usn' AND v.journal_id IS NULL THEN 'needs-scan' WHEN COALESCE(p.n, 0) > 0 THEN 'pending' WHEN g.bad > 0 THEN 'warnings' ELSE 'healthy' END AS status,
       CASE WHEN r.location_kind IN ('cloud', 'network', 'removable') THEN r.location_kind WHEN v.usn_supported = 1 THEN 'ntfs-usn' ELSE 'snapshot' END AS strategy, COALESCE(p.n, 0) AS pending, COALESCE(g.bad, 0) AS failures
     FROM (SELECT DISTINCT * FROM index_roots) r LEFT JOIN (SELECT DISTINCT * FROM index_volumes) v ON v.id = r.volume_id LEFT JOIN p ON p.root_path = r.root_path LEFT JOIN g ON g.root_id = r.id""")  # fmt: skip

_add("index_health", lambda s, d: upkeep.health(read(s, d, "index_roots"), indexed_files(read(s, d, "indexed_files")), read(s, d, "index_volumes"), read(s, d, "pending_changes")),
     rf"""WITH {_FILES2}, k AS (SELECT DISTINCT id, volume_id, location_kind, regexp_replace(lower(replace(root_path, '/', '\')), '\\+$', '') AS root_key FROM index_roots),
     p AS (SELECT regexp_replace(lower(replace(root_path, '/', '\')), '\\+$', '') AS root_key, count(DISTINCT id) AS n FROM pending_changes GROUP BY 1),
     g AS (SELECT root_id, count(*) AS files, count_if(status IN ('error', 'skipped')) AS bad FROM f GROUP BY 1),
     x AS (SELECT k.id AS root_id, k.root_key, COALESCE(g.files, 0) AS files, COALESCE(p.n, 0) AS queue, COALESCE(g.bad, 0) AS failures, v.id AS vid, v.health, v.journal_id, v.last_committed_usn,
       CASE WHEN k.location_kind IN ('cloud', 'network', 'removable') THEN k.location_kind WHEN v.usn_supported = 1 THEN 'ntfs-usn' ELSE 'snapshot' END AS strategy
       FROM k LEFT JOIN (SELECT DISTINCT * FROM index_volumes) v ON v.id = k.volume_id LEFT JOIN p ON p.root_key = k.root_key LEFT JOIN g ON g.root_id = k.id)
     SELECT root_id, root_key, CASE WHEN queue > 0 THEN 'CatchingUp' WHEN contains(lower(health), 'expired') OR contains(lower(health), 'older than the retained journal') THEN 'JournalExpired'
       WHEN regexp_matches(lower(health), 'journal (unavailable|changed|was recreated)|newer than the journal cursor|does not expose a supported|usn replay is unavailable') THEN 'JournalUnavailable'
       WHEN failures >= 25 THEN 'TooManyExtractorFailures' WHEN strategy = 'ntfs-usn' AND (vid IS NULL OR journal_id IS NULL OR COALESCE(last_committed_usn, 0) <= 0) THEN 'NeedsFullScan' ELSE 'Healthy' END AS status, files, queue, failures, strategy FROM x""")  # fmt: skip


def index_health_runtime(spark: SparkSession, d: str) -> DataFrame:
    """Health with what a running service reports: every state occurs."""
    roots = read(spark, d, "index_roots")
    says = {1: "Access denied to folder", 4: "The checkpoint is OLDER than the retained journal", 5: "The journal was recreated", 8: "root validation scan due"}
    n = F.col("id") % 11
    detail = F.lit(None).cast("string")
    for k, text in says.items():
        detail = F.when(n == k, text).otherwise(detail)
    runtime = roots.select("root_path", detail.alias("detail"), (n != 2).alias("reachable"), (n == 3).alias("paused"), ((n == 3) | (n == 6)).alias("active"), (n == 9).alias("watching"), F.when(n == 7, "DriftDetected").alias("validation"))
    none = read(spark, d, "pending_changes").where("id is null")
    many = indexed_files(read(spark, d, "indexed_files")).withColumn("status", F.when(F.col("root_id") % 11 == 10, "error").otherwise(F.col("status")))
    return upkeep.health(roots, many, read(spark, d, "index_volumes"), none, runtime).select("root_id", "status", "failures")


_add("index_health_runtime", index_health_runtime, f"""WITH {_FILES2}, g AS (SELECT root_id, count_if(status IN ('error', 'skipped') OR root_id % 11 = 10) AS bad FROM f GROUP BY 1),
  x AS (SELECT DISTINCT r.id, r.id % 11 AS n, COALESCE(g.bad, 0) AS bad, v.health, r.location_kind, v.usn_supported, v.journal_id, v.id AS vid, v.last_committed_usn AS usn FROM index_roots r LEFT JOIN g ON g.root_id = r.id LEFT JOIN (SELECT DISTINCT * FROM index_volumes) v ON v.id = r.volume_id)
  SELECT id AS root_id, bad AS failures, CASE n WHEN 1 THEN 'AccessDenied' WHEN 2 THEN 'Offline' WHEN 3 THEN 'Paused' WHEN 6 THEN 'CatchingUp' WHEN 4 THEN 'JournalExpired' WHEN 5 THEN 'JournalUnavailable' WHEN 7 THEN 'NeedsFullScan'
    ELSE CASE WHEN bad >= 25 THEN 'TooManyExtractorFailures' WHEN n = 8 OR location_kind NOT IN ('cloud', 'network', 'removable') AND usn_supported = 1 AND (journal_id IS NULL OR COALESCE(usn, 0) <= 0) THEN 'NeedsFullScan' WHEN n = 9 THEN 'Watching' ELSE 'Healthy' END END AS status FROM x""")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    have, there = _seen(spark, d)
    return upkeep.validate(there.withColumn("trouble", F.when(F.col("file_id") % 13 == 0, "locked")), have, error="trouble")


_CHECKED = f"""WITH {_FILES2}, c AS (SELECT id AS file_id, arg_max({{'c': created_at}}, indexed_at).c AS created FROM indexed_files GROUP BY id),
  s AS (SELECT CASE WHEN file_id % 11 = 0 THEN path || '.bak' ELSE path END AS path, file_id, size_bytes + CASE WHEN file_id % 7 = 0 THEN 1 ELSE 0 END AS size_bytes FROM f WHERE file_id % 5 <> 0),
  x AS (SELECT COALESCE(s.path, f.path) AS path, CASE WHEN s.path IS NULL THEN 'MissingFromDisk' WHEN s.file_id % 13 = 0 THEN 'FailedCheck' WHEN f.path IS NULL THEN 'MissingFromIndex' WHEN s.size_bytes IS DISTINCT FROM f.size_bytes OR f.status = 'indexing' THEN 'ChangedSinceIndex' END AS kind
    FROM s FULL JOIN f ON lower(s.path) = lower(f.path))"""
_add("validation_drifts", lambda s, d: _checked(s, d).where("kind is not null"), f"{_CHECKED} SELECT path, kind FROM x WHERE kind IS NOT NULL")
_add("validation_summary", lambda s, d: upkeep.validation_summary(_checked(s, d)), f"""{_CHECKED} SELECT count_if(kind IS NULL OR kind <> 'MissingFromDisk') AS files_checked, count_if(kind IS NULL) AS files_matched, count_if(kind = 'MissingFromIndex') AS missing_from_index,
  count_if(kind = 'ChangedSinceIndex') AS changed_since_index, count_if(kind = 'MissingFromDisk') AS missing_from_disk, count_if(kind = 'FailedCheck') AS failed_checks, CASE WHEN count(kind) > 0 THEN 'DriftDetected' ELSE 'Passed' END AS status FROM x""")

# ------------------------------------------------------------------------- results


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of two providers: names and content."""
    f = _files(spark, d)
    names = search.search_names(build_query("ia", "plain"), f).select(F.lit("metadata").alias("provider"), F.lit("names").alias("provider_id"), "path", F.col("score").cast("double").alias("score"), "text")
    hits = search.search_texts(build_query("archive", "plain"), read(spark, d, "documents").select("doc_id", "text"), "doc_id", cap=None)
    content = hits.join(f.select("file_id", "path"), "file_id").select(F.lit("lexical").alias("provider"), F.lit("lines").alias("provider_id"), "path", F.lit(0.0).alias("score"), F.col("content").alias("text"))
    return names.unionByName(content)


_CAND = f"""{FILES_SQL}, {LINES_SQL}, c AS (SELECT 'metadata' AS provider, path, CAST(CASE WHEN contains(lower(file_name), 'ia') THEN 900 WHEN contains(lower(rel_path), 'ia') THEN 600 ELSE 300 END AS DOUBLE) AS score FROM files WHERE contains(lower(path), 'ia')
  UNION ALL SELECT 'lexical', path, 0.0 FROM lines JOIN files USING (file_id) WHERE contains(lower(content), 'archive')),
  fused AS (SELECT min(path) AS path, sum(CASE WHEN provider = 'metadata' THEN 2.0 ELSE 1.0 END * CASE WHEN score > 0 THEN score ELSE 1.0 END) AS score, count(DISTINCT provider) AS providers, count(*) AS hits, CASE WHEN max(score) > 0 THEN 'names' ELSE 'lines' END AS best_provider FROM c GROUP BY lower(path))"""
_add("fusion_weighted", lambda s, d: results.fuse(_candidates(s, d), {"metadata": 2.0}), f"WITH {_CAND} SELECT path, CAST(score AS DOUBLE) AS score, providers, hits, best_provider, row_number() OVER (ORDER BY score DESC, lower(path)) AS rank FROM fused")


def _tied(spark: SparkSession, d: str) -> DataFrame:
    """Each document found by four providers, two of them at the best score and alike but for the end of their names."""
    f = _files(spark, d).select("file_id", "path")
    ids = F.array(*(F.struct(F.lit(p).alias("provider"), F.lit(i).alias("provider_id"), F.lit(x).alias("add")) for p, i, x in (("regex", "live-regex", 1), ("lexical", "Live-Lexical", 1), ("fuzzy", "live-fuzzy", 0), ("metadata", "indexed", -50))))
    return f.select("path", "file_id", F.explode(ids).alias("c")).select("c.provider", "c.provider_id", "path", (F.col("file_id") % 40 + F.col("c.add")).cast("double").alias("score"))


_add("fusion_ties", lambda s, d: results.fuse(_tied(s, d), {"regex": 0.5}), f"""WITH {FILES_SQL}, c AS (SELECT path, provider, provider_id, CAST(file_id % 40 + x AS DOUBLE) AS score FROM files, (VALUES ('regex', 'live-regex', 1), ('lexical', 'Live-Lexical', 1), ('fuzzy', 'live-fuzzy', 0), ('metadata', 'indexed', -50)) t(provider, provider_id, x)),
  o AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY score DESC, lower(provider_id)) AS n FROM c),
  g AS (SELECT min(path) AS path, sum(CASE WHEN provider = 'regex' THEN 0.5 ELSE 1.0 END * CASE WHEN score > 0 THEN score ELSE 1.0 END) AS score, count(DISTINCT provider) AS providers, count(*) AS hits, max(CASE WHEN n = 1 THEN provider_id END) AS best_provider FROM o GROUP BY lower(path))
  SELECT path, CAST(score AS DOUBLE) AS score, providers, hits, best_provider, row_number() OVER (ORDER BY score DESC, lower(path)) AS rank FROM g""")


def rerank_heuristic(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).groupBy(F.lower("path").alias("_k")).agg(F.max("modified").alias("modified"))
    fused = results.fuse(_candidates(spark, d), {"metadata": 2.0})
    x = fused.withColumn("_k", F.lower("path")).join(f, "_k").withColumn("text", F.lit(""))
    out = results.rerank(x, results.rerank_terms("ia teams"), F.lit(AS_OF))
    return out.select("path", F.round("score", 6).alias("score"), "rank")


_add("rerank_heuristic", rerank_heuristic, f"""WITH {_CAND}, n AS (SELECT u.*, lower(split_part(u.path, '/', -1)) AS name, m.modified FROM fused u JOIN (SELECT lower(path) AS k, max(modified) AS modified FROM files GROUP BY 1) m ON m.k = lower(u.path)),
  b AS (SELECT path, score, least(CASE WHEN regexp_replace(name, '\\.[^.]+$', '') = 'ia' THEN 0.30 WHEN contains(name, 'ia') THEN 0.18 WHEN contains(lower(path), 'ia') THEN 0.06 ELSE 0 END
    + CASE WHEN regexp_replace(name, '\\.[^.]+$', '') = 'teams' THEN 0.30 WHEN contains(name, 'teams') THEN 0.18 WHEN contains(lower(path), 'teams') THEN 0.06 ELSE 0 END, 0.45) + least(0.05 * (providers - 1), 0.15) + least(0.03 * ln(hits + 1.0), 0.12)
    + CASE WHEN ({_AS_OF_US} - modified) / {_DAY}.0 <= 7 THEN 0.08 WHEN ({_AS_OF_US} - modified) / {_DAY}.0 <= 30 THEN 0.05 WHEN ({_AS_OF_US} - modified) / {_DAY}.0 <= 365 THEN 0.02 ELSE 0 END AS boost FROM n),
  t AS (SELECT path, CAST(score + least(boost, 0.75) AS DOUBLE) AS s FROM b) SELECT path, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, lower(path)) AS rank FROM t""")


def snippet_neighbors(spark: SparkSession, d: str) -> DataFrame:
    out = results.snippets(build_query("archive", "plain"), _lines(spark, d))
    return out.select("file_id", "line_number", "snippet", F.size("highlights").cast("bigint").alias("highlights"))


_add("snippet_neighbors", snippet_neighbors, f"""WITH {LINES_SQL}, n AS (SELECT file_id, line_number, content, concat_ws(chr(10), lag(content) OVER w, content, lead(content) OVER w) AS snippet FROM lines WINDOW w AS (PARTITION BY file_id ORDER BY line_number))
  SELECT file_id, line_number, snippet, CAST((length(snippet) - length(replace(lower(snippet), 'archive', ''))) / 7 AS BIGINT) AS highlights FROM n WHERE contains(lower(content), 'archive')""")
_facet = lambda col: lambda s, d: results.facet(_files(s, d).join(read(s, d, "documents").select(F.col("doc_id").alias("file_id"), "source", "folder"), "file_id"), F.col(col), 50 if col == "folder" else 25)


def _facet_sql(col: str, limit: int) -> str:
    return f"""WITH {FILES_SQL}, x AS (SELECT f.*, d.source, d.folder FROM files f JOIN documents d ON d.doc_id = f.file_id), v AS (SELECT CASE WHEN trim({col}) = '' OR {col} IS NULL THEN '__none' ELSE {col} END AS value FROM x)
      SELECT 'All' AS value, count(*) AS n FROM x UNION ALL SELECT * FROM (SELECT min(value), count(*) FROM v GROUP BY lower(value) ORDER BY 2 DESC, 1 LIMIT {limit})"""


for _c, _n in (("ext", 25), ("folder", 50), ("source", 25)):
    _add(f"facet_{'extension' if _c == 'ext' else _c}", _facet(_c), _facet_sql(_c, _n))
_add("facet_modified", lambda s, d: results.bucket_facet(_files(s, d), results.modified_bucket(F.col("modified"), F.lit(AS_OF))), f"""WITH {FILES_SQL}, b AS (SELECT date_diff('day', CAST(make_timestamp(modified) AS DATE), DATE '2030-02-01') AS n, modified FROM files)
  SELECT CAST(CASE WHEN modified IS NULL THEN 5 WHEN n <= 0 THEN 1 WHEN n <= 7 THEN 2 WHEN n <= 30 THEN 3 ELSE 4 END AS BIGINT) AS position, CASE WHEN modified IS NULL THEN 'unknown' WHEN n <= 0 THEN 'today' WHEN n <= 7 THEN 'last 7 days' WHEN n <= 30 THEN 'last 30 days' ELSE 'older' END AS value, count(*) AS n FROM b GROUP BY ALL""".replace("count(*) AS n FROM b GROUP BY ALL", "count(*) AS n FROM b GROUP BY 1, 2"))
_add("facet_size", lambda s, d: results.bucket_facet(indexed_files(read(s, d, "indexed_files")), results.size_bucket(F.col("size_bytes"))), f"WITH {_FILES2} SELECT CAST(CASE WHEN size_bytes IS NULL THEN 4 WHEN size_bytes < 102400 THEN 1 WHEN size_bytes < 10485760 THEN 2 ELSE 3 END AS BIGINT) AS position, CASE WHEN size_bytes IS NULL THEN 'unknown' WHEN size_bytes < 102400 THEN 'small' WHEN size_bytes < 10485760 THEN 'medium' ELSE 'large' END AS value, count(*) AS n FROM f GROUP BY 1, 2")


def _results(spark: SparkSession, d: str) -> DataFrame:
    hits = search.search_texts(build_query("archive", "plain"), read(spark, d, "documents").select("doc_id", "text"), "doc_id", cap=None).withColumn("score", F.char_length("content").cast("double"))
    return results.file_results(hits).join(_files(spark, d), "file_id")


_RES = f"WITH {FILES_SQL}, {LINES_SQL}, r AS (SELECT file_id, count(*) AS hit_count, CAST(max(length(content)) AS DOUBLE) AS best_score, min(line_number) AS first_line FROM lines WHERE contains(lower(content), 'archive') GROUP BY 1), x AS (SELECT * FROM r JOIN files USING (file_id))"
_top = lambda preset: lambda s, d: results.page(_results(s, d), results.result_order(preset), 0, 50).select("file_id", "path", "hit_count", "best_score", "first_line")
for _p, _o in (("hits", "hit_count DESC, lower(path), file_id"), ("recency", "modified DESC NULLS LAST, lower(path), file_id"), ("relevance", "best_score DESC, lower(path), file_id"), ("filename", "lower(file_name), lower(directory), file_id")):
    _add(f"group_sort_{_p}", _top(_p), f"{_RES} SELECT file_id, path, hit_count, best_score, first_line FROM x ORDER BY {_o} LIMIT 50")
_add("paging", lambda s, d: results.page(_results(s, d), results.result_order("filename"), 2, 30).select("file_id", "path"), f"{_RES} SELECT file_id, path FROM x ORDER BY lower(file_name), lower(directory), file_id LIMIT 30 OFFSET 60")
_add("preview_windows", lambda s, d: results.preview_windows(search.search_texts(build_query("archive", "plain"), read(s, d, "documents").select("doc_id", "text"), "doc_id", cap=None)),
     f"""WITH {LINES_SQL}, h AS (SELECT file_id, line_number, line_number - lag(line_number) OVER (PARTITION BY file_id ORDER BY line_number) AS gap FROM lines WHERE contains(lower(content), 'archive')),
     g AS (SELECT *, sum(CASE WHEN gap <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY line_number) AS n FROM h)
     SELECT file_id, greatest(min(line_number) - 2, 1) AS first_line, max(line_number) + 2 AS last_line FROM g GROUP BY file_id, n""")  # fmt: skip
_add("dedupe_hits", lambda s, d: _lines(s, d).select("file_id", "content").dropDuplicates(), f"WITH {LINES_SQL} SELECT DISTINCT file_id, content FROM lines")
_add("recent_searches", lambda s, d: results.recent_first(read(s, d, "events").withColumn("q", F.concat(F.lit("q"), F.col("user_id") % 60)), "q", "ts").select("q"), "SELECT 'q' || (user_id % 60) AS q FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 20")
_add("latency_percentiles", lambda s, d: results.latency(read(s, d, "events"), "value", "event_type").select("event_type", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99"))), "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")


def relevance_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Queries by source word; relevant are the files of that kind."""
    f = _files(spark, d)
    kinds = ("mail", "report", "contract", "ticket", "log")
    hits = search.search_texts(build_query("archive", "plain"), read(spark, d, "documents").select("doc_id", "text"), "doc_id", cap=None).groupBy("file_id").agg(F.count("*").alias("n"))
    x = hits.join(f, "file_id").withColumn("query", F.explode(F.array(*map(F.lit, kinds))))
    from pyspark.sql import Window

    run = x.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.col("n") + F.when(F.col("file_id") % 3 == F.char_length("query") % 3, 5).otherwise(0)), "file_id"))).where("rank <= 100")
    judged = f.where(F.col("extractor_id").isin(*kinds)).select(F.col("extractor_id").alias("query"), "path")
    out = results.relevance(run.select("query", "path", "rank"), judged)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


_add("relevance_metrics", relevance_metrics, f"""WITH {FILES_SQL}, {LINES_SQL}, h AS (SELECT file_id, count(*) AS n FROM lines WHERE contains(lower(content), 'archive') GROUP BY 1),
  run AS (SELECT q AS query, path, extractor_id, row_number() OVER (PARTITION BY q ORDER BY n + CASE WHEN file_id % 3 = length(q) % 3 THEN 5 ELSE 0 END DESC, file_id) AS rank FROM h JOIN files USING (file_id), unnest(['mail', 'report', 'contract', 'ticket', 'log']) AS t(q) QUALIFY rank <= 100),
  j AS (SELECT DISTINCT extractor_id AS query, path FROM files WHERE extractor_id IN ('mail', 'report', 'contract', 'ticket', 'log')),
  m AS (SELECT run.query, run.rank, CASE WHEN j.path IS NULL THEN 0 ELSE 1 END AS rel FROM run LEFT JOIN j ON j.query = run.query AND j.path = run.path),
  per AS (SELECT query, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(CASE WHEN rel = 1 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count_if(rel = 1 AND rank <= 20) AS found, max(CASE WHEN rank = 1 THEN rel END) AS top FROM m GROUP BY 1),
  w AS (SELECT query, count(*) AS n, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM j GROUP BY 1)
  SELECT round(avg(COALESCE(1.0 / first, 0)), 6) AS mrr, round(avg(COALESCE(dcg / ideal, 0)), 6) AS ndcg, round(avg(COALESCE(found / n, 0)), 6) AS recall, round(avg(CASE WHEN dcg IS NULL THEN 1.0 ELSE 0.0 END), 6) AS zero_result_rate, round(CAST(avg(COALESCE(top, 0)) AS DOUBLE), 6) AS top_accuracy FROM w LEFT JOIN per USING (query)""")


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    hits = search.search_texts(build_query("quote OR \"“\"", "boolean"), read(spark, d, "documents").select("doc_id", "text"), "doc_id", cap=None)
    x = hits.join(_files(spark, d).select("file_id", "path"), "file_id")
    return x.select(F.concat_ws(",", results.csv_field(F.col("path")), results.csv_field(F.col("line_number")), results.csv_field(F.col("content"))).alias("row"))


def _csv_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[,\"\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


_add("export_rows", export_rows, f"WITH {FILES_SQL}, {LINES_SQL} SELECT {_csv_sql('path')} || ',' || line_number || ',' || {_csv_sql('content')} AS row FROM lines JOIN files USING (file_id) WHERE contains(lower(content), 'quote') OR contains(content, '“')")


def grounded_evidence(spark: SparkSession, d: str) -> DataFrame:
    x = _results(spark, d).withColumn("search_rank", F.lit(1)).withColumn("hit_rank", (F.col("file_id") % 7).cast("int"))
    out = results.evidence(x.select("path", "search_rank", "hit_rank", F.col("best_score").alias("score"), F.concat(F.lit("hit in "), "path").alias("text")), 8)
    return out.withColumn("citation", F.col("citation").cast("bigint"))


_add("grounded_evidence", grounded_evidence, f"{_RES} SELECT row_number() OVER (ORDER BY CASE WHEN file_id % 7 = 0 THEN 2147483647 ELSE file_id % 7 END, best_score DESC, path) AS citation, path, 'hit in ' || path AS text FROM x ORDER BY 1 LIMIT 8")
_add("size_labels", lambda s, d: indexed_files(read(s, d, "indexed_files")).select("file_id", results.size_label(F.col("size_bytes")).alias("label")), f"""WITH {_FILES2} SELECT file_id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN format('{{:,.1f}}', size_bytes / 1024) || ' KB' WHEN size_bytes < 1073741824 THEN format('{{:,.1f}}', size_bytes / 1048576) || ' MB' ELSE format('{{:,.1f}}', size_bytes / 1073741824) || ' GB' END AS label FROM f""")
_add("location_labels", lambda s, d: _once(read(s, d, "content_units")).select("id", results.location_label(F.col("page"), F.col("start_line"), F.col("kind")).alias("label")), "SELECT DISTINCT id, concat_ws(', ', 'page ' || page, 'line ' || start_line, 'section ' || kind) AS label FROM content_units")

# ------------------------------------------------------------------------- vectors


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", (F.col("vec_id") / 10).cast("bigint").alias("file_id"), F.col("embedding").alias("vector"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, vec_id // 10 AS file_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_COS = "list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)))"
_add("cosine_topk", lambda s, d: vectors.top_k(_vectors(s, d), _query_vector(s, d), 20, "vec_id").select("vec_id", F.round("score", 6).alias("score")), f"WITH {_Q}, s AS (SELECT vec_id, {_COS} AS score FROM v, q) SELECT vec_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, vec_id LIMIT 20")


def knn_every_hundredth(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 100."""
    v = _vectors(spark, d)
    return vectors.top_k_many(v, v.where("vec_id % 100 = 0"), 10, "vec_id").select("query_id", "vec_id", F.round("score", 5).alias("score"))


_add("knn_every_hundredth", knn_every_hundredth, """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) / (a.n * b.n) AS score FROM n a JOIN n b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
  SELECT query_id, vec_id, round(score, 5) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, vec_id) <= 10""")
_add("vector_stats", lambda s, d: vectors.stats(_vectors(s, d), "vec_id"), "SELECT count(*) AS vectors, count(DISTINCT vec_id // 10) AS files, CAST(min(len(embedding)) AS BIGINT) AS least_dimension, CAST(max(len(embedding)) AS BIGINT) AS most_dimension FROM embeddings")


def file_vectors(spark: SparkSession, d: str) -> DataFrame:
    x = vectors.file_vectors(_vectors(spark, d)).select("file_id", F.posexplode("vector").alias("i", "x"))
    return x.select("file_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


_FV = "e AS (SELECT file_id, i, avg(v[i]) AS x FROM v, range(1, 65) AS t(i) GROUP BY ALL), n AS (SELECT file_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1)"
_add("file_vectors", file_vectors, f"WITH {_Q}, {_FV} SELECT file_id, CAST(i AS BIGINT) - 1 AS i, round(x / n, 6) AS x FROM e JOIN n USING (file_id)")
_add("semantic_two_level", lambda s, d: vectors.two_level(_vectors(s, d), _query_vector(s, d), key="vec_id").select("vec_id", "file_id", F.round("score", 6).alias("score")),
     f"""WITH {_Q}, {_FV}, fv AS (SELECT file_id, list(x / n ORDER BY i) AS v FROM e JOIN n USING (file_id) GROUP BY 1), fs AS (SELECT file_id, {_COS} AS f FROM fv, q WHERE {_COS} > 0 ORDER BY 2 DESC, 1 LIMIT 25),
     c AS (SELECT vec_id, file_id, {_COS} AS s FROM v, q), r AS (SELECT vec_id, file_id, s, f FROM c JOIN fs USING (file_id) WHERE s > 0 ORDER BY s DESC, vec_id LIMIT 50) SELECT vec_id, file_id, round(0.8 * s + 0.2 * f, 6) AS score FROM r""")  # fmt: skip


def lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 100, through the hashed index."""
    v = _vectors(spark, d)
    index = Scratch(spark).keep(vectors.signatures(v, 64, "vec_id"))
    return vectors.hashed_top_k_many(v, index, v.where("vec_id % 100 = 0"), 20, "vec_id")


_add("lsh_topk", lsh_topk)


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    units = read(spark, d, "content_units").select("id", "file_id", F.col("unit_text").alias("text"))
    x = vectors.chunks(units)
    return x.select("file_id", "chunk_no", "first_unit", "last_unit", F.char_length("chunk_text").cast("bigint").alias("length"), "chunk_hash")


_add("chunk_windows", chunk_windows)


def chunk_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per file: its units and text in chunks, and how many chunks are too long with more than one unit, or leave a unit out between them."""
    units = read(spark, d, "content_units").select("id", "file_id", F.col("unit_text").alias("text"))
    x = vectors.chunks(units).withColumn("n", F.size("unit_ids"))
    per = x.groupBy("file_id").agg(F.count_if((F.char_length("chunk_text") > 2400) & (F.col("n") > 1)).alias("too_long"))
    held = x.select("file_id", F.explode("unit_ids").alias("id")).groupBy("file_id").agg(F.count_distinct("id").alias("units"), F.count("*").alias("placed"))
    most = x.groupBy("file_id").agg(F.count("*").alias("chunks")).join(held, "file_id").join(per, "file_id")
    # at most one unit is shared by neighbours
    return most.select("file_id", "units", "too_long", (F.col("placed") - F.col("units") > F.col("chunks") - 1).alias("shared_too_much"))


_add("chunk_rules", chunk_rules, "SELECT file_id, count(DISTINCT id) AS units, 0 AS too_long, false AS shared_too_much FROM content_units WHERE trim(unit_text) <> '' GROUP BY file_id")


def lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    """Queries of the hashed search, and whether it finds at least nine tenths of the 10 nearest that the exact search finds."""
    v = _vectors(spark, d)
    q = v.where("vec_id % 100 = 0")
    index = Scratch(spark).keep(vectors.signatures(v, 64, "vec_id"))
    near = vectors.hashed_top_k_many(v, index, q, 10, "vec_id").select("query_id", "vec_id", F.lit(1).alias("hit"))
    x = vectors.top_k_many(v, q, 10, "vec_id").join(near, ["query_id", "vec_id"], "left")
    return x.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("nine_tenths"))


def knn_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 100, the queries in blocks of two."""
    v = _vectors(spark, d)
    return vectors.top_k_many(v, v.where("vec_id % 100 = 0"), 5, "vec_id", block=2).select("query_id", "vec_id")


_add("knn_in_blocks", knn_in_blocks, """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
  SELECT query_id, vec_id FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 5""")
_add("lsh_recall", lsh_recall, "SELECT count(*) AS queries, true AS nine_tenths FROM embeddings WHERE vec_id % 100 = 0")
_add("chunk_hash", lambda s, d: _once(read(s, d, "content_units")).select("id", F.sha2("unit_text", 256).alias("hash")), "SELECT DISTINCT id, sha256(unit_text) AS hash FROM content_units")
