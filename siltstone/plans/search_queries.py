"""Search queries over the documents, with the SQL they are held against."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import search
from siltstone.query import build_query
from siltstone.query import filters as flt
from siltstone.runtime import read
from siltstone.sources.adapters import document_files, text_lines

AS_OF = datetime(2030, 2, 1)
TODAY = date(2030, 2, 1)

FILES_SQL = r"""
files AS (
  SELECT *, regexp_replace(path, '/[^/]*$', '') AS directory, split_part(path, '/', 1) AS root, regexp_replace(path, '^[^/]*/', '') AS rel_path,
         regexp_replace(regexp_replace(regexp_replace(path, '/[^/]*$', ''), '^[^/]*(/|$)', ''), '^/', '') AS rel_dir,
         lower(regexp_extract(file_name, '\.[^.]+$')) AS ext, regexp_replace(file_name, '\.[^.]+$', '') AS stem
  FROM (SELECT doc_id AS file_id, replace(folder || '\' || file_name, '\', '/') AS path, regexp_extract(file_name, '[^\\/]*$') AS file_name,
               n_chars AS size_bytes, epoch_us(collected_at) AS modified, epoch_us(collected_at) - (doc_id % 100) * 86400000000 AS created,
               CASE WHEN text IS NULL THEN 'error' ELSE 'ok' END AS status, doc_kind AS extractor_id FROM documents))"""
LINES_SQL = r"""
cut AS (SELECT doc_id AS file_id, regexp_split_to_array(text, '\r\n|\r|\n') AS a FROM documents WHERE text IS NOT NULL AND text <> ''),
lines AS (
  SELECT file_id, CAST(i AS BIGINT) AS line_number, a[i] AS content
  FROM cut, range(1, CASE WHEN len(a) > 1 AND a[len(a)] = '' THEN len(a) ELSE len(a) + 1 END) AS t(i))"""
_DAY = 86400000000
_AS_OF_US = 1896134400000000


def _hits(text: str, mode: str = "unified", cs: bool = False, cap: int | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = read(spark, d, "documents")
        q = build_query(text, mode, cs, TODAY)
        return search.search_texts(q, docs.select("doc_id", "text"), "doc_id", files=document_files(docs), cap=cap, today=TODAY)

    return run


def _select(condition: str, cols: str = "file_id, line_number, content") -> str:
    return f"WITH {LINES_SQL} SELECT {cols} FROM lines WHERE {condition}"


QUERIES, SQL = {}, {}


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def scan_files(spark: SparkSession, d: str) -> DataFrame:
    f = document_files(read(spark, d, "documents"))
    return f.select("file_id", "root", "path", "rel_path", "rel_dir", "file_name", "stem", "ext", "size_bytes", F.unix_micros("modified").alias("modified_us"), F.unix_micros("created").alias("created_us"), "status", "extractor_id", flt.category(F.col("ext")).alias("category"))


def _category_sql(ext: str) -> str:
    whens = " ".join(f"WHEN {ext} IN ({', '.join(repr(e) for e in exts)}) THEN '{name}'" for name, exts in flt.CATEGORY_EXTENSIONS.items())
    return f"CASE {whens} ELSE 'other' END"


_add("scan_files", scan_files, f"WITH {FILES_SQL} SELECT file_id, root, path, rel_path, rel_dir, file_name, stem, ext, size_bytes, modified AS modified_us, created AS created_us, status, extractor_id, {_category_sql('ext')} AS category FROM files")
_add("scan_lines", lambda s, d: text_lines(read(s, d, "documents").select("doc_id", "text"), "doc_id"), f"WITH {LINES_SQL} SELECT * FROM lines")
_add("term_search", _hits("archive", "plain"), _select("contains(lower(content), 'archive')"))
_add("term_search_case_sensitive", _hits("The records", "plain", cs=True), _select("contains(content, 'The records')"))
_add("regex_search", _hits(r"\b[A-Z]{2}-\d{4}\b.*\d+\.\d+", "regex", cs=True), _select(r"regexp_matches(content, '\b[A-Z]{2}-\d{4}\b.*\d+\.\d+')"))
_add("regex_search_ignore_case", _hits(r"prüf\w+|archiv[aeio]", "regex"), _select(r"regexp_matches(content, '(?i)prüf\w+|archiv[aeio]')"))
_add("boolean_and", _hits("index AND service", "boolean"), _select("contains(lower(content), 'index') AND contains(lower(content), 'service')"))
_add("boolean_or", _hits("reviewer OR laboratório", "boolean"), _select("contains(lower(content), 'reviewer') OR contains(lower(content), 'laboratório')"))
_add("boolean_not", _hits("the NOT archive", "boolean"), _select("contains(lower(content), 'the') AND NOT contains(lower(content), 'archive')"))
_add("boolean_nested", _hits('(index OR catalogue) NOT (preview OR /\\d{5}/) "the"', "boolean"), _select(r"(contains(lower(content), 'index') OR contains(lower(content), 'catalogue')) AND NOT (contains(lower(content), 'preview') OR regexp_matches(content, '\d{5}')) AND contains(lower(content), 'the')"))
_TOKENS = r"regexp_extract_all(lower(content), '[\p{L}\p{Nd}_]+')"
_add(
    "near_search",
    _hits("archive NEAR/3 replaces"),
    f"""WITH {LINES_SQL}, tok AS (SELECT file_id, line_number, content, {_TOKENS} AS t FROM lines WHERE contains(lower(content), 'archive') AND contains(lower(content), 'replaces')),
    pos AS (SELECT file_id, line_number, content, list_filter(range(1, len(t) + 1), lambda i: contains(t[i], 'archive')) AS a, list_filter(range(1, len(t) + 1), lambda i: contains(t[i], 'replaces')) AS b FROM tok)
    SELECT DISTINCT file_id, line_number, content FROM pos, unnest(a) AS x(i), unnest(b) AS y(j) WHERE greatest(abs(i - j) - 1, 0) <= 3""",
)
_add("fuzzy_search", _hits("archve~2"), _select(f"list_bool_or(list_transform(list_concat({_TOKENS}, ['zzzzzzzzzzzz']), lambda t: levenshtein(t, 'archve') <= 2))"))
_add("wildcard_search", _hits("catalog*e?"), _select(r"regexp_matches(content, '(?i)\bcatalog.*e.\b')"))
_add("unified_phrase", _hits('"query planner" content:merges'), _select("contains(lower(content), 'query planner') AND contains(lower(content), 'merges')"))


def highlight_spans(spark: SparkSession, d: str) -> DataFrame:
    q = build_query("index OR the", "boolean")
    hits = search.search_texts(q, read(spark, d, "documents").select("doc_id", "text"), "doc_id", cap=None)
    return search.highlights(q, hits).select("file_id", "line_number", F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"))


def _spans_sql(term: str) -> str:
    n = len(term)
    return f"""SELECT file_id, line_number, CAST(i AS BIGINT) - 1 AS start, CAST({n} AS BIGINT) AS length FROM lines, range(1, length(content) + 1) AS t(i)
        WHERE substr(lower(content), CAST(i AS INTEGER), {n}) = '{term}'"""


_add("highlight_spans", highlight_spans, f"WITH {LINES_SQL} {_spans_sql('index')} UNION ALL {_spans_sql('the')}")
_add("hits_per_file_cap", _hits("the", "plain", cap=5), f"WITH {LINES_SQL} SELECT file_id, line_number, content FROM lines WHERE contains(lower(content), 'the') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_number) <= 5")


def _files(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        q = build_query(text, "unified", today=TODAY)
        f = document_files(read(spark, d, "documents"))
        return f.where(flt.to_column(q.filters)).select("file_id", "path")

    return run


def _pick(condition: str) -> str:
    return f"WITH {FILES_SQL} SELECT file_id, path FROM files WHERE {condition}"


def us(day: str) -> int:
    return int((datetime.fromisoformat(day) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000


_add("filter_size", _files("size:>1kb size:<4kb"), _pick("size_bytes >= 1024 AND size_bytes <= 4096"))
_add("filter_size_range", _files("size:100..900b"), _pick("size_bytes BETWEEN 100 AND 900"))
_add("filter_modified", _files("modified:>2030-01-10 modified:<2030-01-20"), _pick(f"modified >= {us('2030-01-10')} AND modified < {us('2030-01-21')}"))
_add("filter_modified_relative", _files("modified:last-week"), _pick(f"modified >= {us('2030-01-25')} AND modified < {us('2030-02-02')}"))
_add("filter_created_season", _files("created:last-fall"), _pick(f"created >= {us('2029-09-01')} AND created < {us('2029-12-01')}"))
_add("filter_extension", _files("ext:pdf;*.docx"), _pick("ext IN ('.pdf', '.docx')"))
_add("filter_type", _files("type:word"), _pick("ext IN ('.doc', '.docx', '.rtf', '.odt')"))
_add("filter_type_category", _files("type:document,pdf"), _pick("ext = '.pdf'"))
_add("filter_folder", _files("folder:teams folder:o"), _pick("contains(lower(directory), 'teams') AND contains(lower(directory), 'o')"))
_add("filter_name", _files("name:ia,r"), _pick("(contains(lower(file_name), 'ia') AND contains(lower(file_name), 'r')) OR (contains(lower(stem), 'ia') AND contains(lower(stem), 'r'))"))
_add("filter_path_root", _files("path:projects root:f"), _pick("contains(lower(path), 'projects') AND contains(lower(root), 'f')"))
_add("filter_status_extractor", _files("status:ok extractor:mail"), _pick("contains(status, 'ok') AND contains(extractor_id, 'mail')"))


def filter_glob(spark: SparkSession, d: str) -> DataFrame:
    from siltstone.sources.walker import file_predicate

    f = document_files(read(spark, d, "documents"))
    return f.where(file_predicate(include_globs=["*_s?-*.pdf", "k*.txt"], exclude_globs=["*9*"])).select("file_id", "path")


def filter_directories(spark: SparkSession, d: str) -> DataFrame:
    from siltstone.sources.walker import file_predicate

    f = document_files(read(spark, d, "documents"))
    return f.where(file_predicate(include_dirs=["Projects", "Teams"], exclude_dirs=["Unsorted"])).select("file_id", "path")


_add("filter_glob", filter_glob, _pick(r"(regexp_matches(file_name, '(?i)^.*_s.-.*\.pdf$') OR regexp_matches(file_name, '(?i)^k.*\.txt$')) AND NOT contains(file_name, '9')"))
_add("filter_directories", filter_directories, _pick("list_has_any(string_split(lower(rel_dir), '/'), ['projects', 'teams']) AND NOT list_contains(string_split(lower(rel_dir), '/'), 'unsorted')"))
_JOINED = f"WITH {LINES_SQL}, {FILES_SQL} SELECT l.file_id, l.line_number, l.content FROM lines l JOIN files f USING (file_id) WHERE"
_add("unified_fields", _hits("ext:pdf,odt size:>500 planner"), f"{_JOINED} f.ext IN ('.pdf', '.odt') AND f.size_bytes >= 500 AND contains(lower(content), 'planner')")
_add("unified_name_content", _hits("name:ia reviewer OR archivist"), f"{_JOINED} (contains(lower(f.file_name), 'ia') OR contains(lower(f.stem), 'ia')) AND (contains(lower(content), 'reviewer') OR contains(lower(content), 'archivist'))")
_add("nl_query", _hits("pdfs with query planner modified last month over 1kb"), f"{_JOINED} f.ext = '.pdf' AND f.size_bytes >= 1024 AND f.modified >= {us('2030-01-01')} AND f.modified < {us('2030-02-02')} AND contains(lower(content), 'query') AND contains(lower(content), 'planner')")
_add("file_name_search", lambda s, d: search.search_names(build_query("re", "plain"), document_files(read(s, d, "documents"))).withColumn("score", F.col("score").cast("bigint")),
     f"WITH {FILES_SQL} SELECT file_id, path, 'File name match: ' || file_name AS text, CAST(CASE WHEN contains(lower(file_name), 're') THEN 900 WHEN contains(lower(rel_path), 're') THEN 600 ELSE 300 END AS BIGINT) AS score FROM files WHERE contains(lower(path), 're')")
_add("folder_name_search", lambda s, d: search.search_folders(build_query("ro", "plain"), document_files(read(s, d, "documents"))).withColumn("score", F.col("score").cast("bigint")),
     f"""WITH {FILES_SQL}, seg AS (SELECT DISTINCT string_split(directory, '/') AS a FROM files), f AS (SELECT DISTINCT array_to_string(a[1:i], '/') AS path FROM seg, range(1, len(a) + 1) AS t(i))
     SELECT path, 'Folder name match: ' || split_part(path, '/', -1) AS text, CAST(CASE WHEN contains(lower(split_part(path, '/', -1)), 'ro') THEN 900 WHEN contains(lower(regexp_replace(path, '^[^/]*/?', '')), 'ro') THEN 600 ELSE 300 END AS BIGINT) AS score
     FROM f WHERE contains(lower(path), 'ro')""")  # fmt: skip
_add("metadata_score_topk", lambda s, d: search.search_metadata(document_files(read(s, d, "documents")), ["ia", "teams"], F.lit(AS_OF)),
     f"""WITH {FILES_SQL}, s AS (SELECT *, CASE WHEN file_name = 'ia' OR stem = 'ia' THEN 1000 WHEN starts_with(lower(file_name), 'ia') THEN 800 WHEN ext = '.ia' THEN 700
       WHEN list_contains(string_split(lower(path), '/'), 'ia') THEN 600 WHEN contains(lower(file_name), 'ia') THEN 450 WHEN contains(lower(directory), 'ia') THEN 300 WHEN contains(lower(path), 'ia') THEN 200 ELSE 0 END AS a,
       CASE WHEN lower(file_name) = 'teams' OR lower(stem) = 'teams' THEN 1000 WHEN starts_with(lower(file_name), 'teams') THEN 800 WHEN ext = '.teams' THEN 700
       WHEN list_contains(string_split(lower(path), '/'), 'teams') THEN 600 WHEN contains(lower(file_name), 'teams') THEN 450 WHEN contains(lower(directory), 'teams') THEN 300 WHEN contains(lower(path), 'teams') THEN 200 ELSE 0 END AS b,
       ({_AS_OF_US} - modified) / {_DAY}.0 AS days FROM files)
     SELECT file_id, path, CAST(a + b + CASE WHEN modified IS NULL THEN 0 WHEN days <= 7 THEN 50 WHEN days <= 30 THEN 25 WHEN days <= 365 THEN 10 ELSE 0 END AS BIGINT) AS score
     FROM s WHERE a > 0 AND b > 0 ORDER BY 3 DESC, modified DESC NULLS LAST, lower(path), file_id LIMIT 200""")  # fmt: skip


def usage_boost(spark: SparkSession, d: str) -> DataFrame:
    log = read(spark, d, "events").where("event_type = 'click'").withColumn("path", F.concat(F.lit("p"), F.col("user_id")))
    used = search.record_opens(log)
    return used.select("path", "open_count", search.usage_boost(F.col("open_count"), F.col("last_opened"), F.lit(datetime(2024, 1, 20))).cast("bigint").alias("boost"))


_add("usage_boost", usage_boost, """WITH u AS (SELECT 'p' || user_id AS path, count(*) AS open_count, epoch(TIMESTAMP '2024-01-20' - max(ts)) / 86400.0 AS days FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT path, open_count, CAST(least(100, open_count * 10) + CASE WHEN days <= 1 THEN 75 WHEN days <= 7 THEN 40 WHEN days <= 30 THEN 20 ELSE 0 END AS BIGINT) AS boost FROM u""")
