"""Queries over change streams, extractors and workflows, with the SQL they are held against."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.extract import extract_files
from siltstone.extract.markup import html_text
from siltstone.operators import search
from siltstone.plans.search_queries import FILES_SQL, LINES_SQL, TODAY
from siltstone.query import build_query
from siltstone.runtime import read
from siltstone.sources.adapters import document_files
from siltstone.streaming import queue
from siltstone.workflow import Runner

QUERIES, SQL = {}, {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "refresh").when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "signup", "semantic").otherwise("upsert")
    e = read(spark, d, "events").select(F.concat(F.lit("r"), F.col("user_id") % 4).alias("root"), F.concat(F.lit("p"), F.col("user_id")).alias("path"), kind.alias("kind"), (F.col("event_id") % 3).cast("int").alias("priority"), "ts")
    return e.withColumn("path", F.when(F.col("kind").isin("refresh", "semantic"), None).otherwise(F.col("path")))


_EV = """e AS (SELECT 'r' || (user_id % 4) AS root, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE 'p' || user_id END AS path,
    CASE event_type WHEN 'error' THEN 'refresh' WHEN 'purchase' THEN 'delete' WHEN 'signup' THEN 'semantic' ELSE 'upsert' END AS kind, CAST(event_id % 3 AS INTEGER) AS priority, ts FROM events),
  k AS (SELECT *, CASE kind WHEN 'refresh' THEN 'R|' || root WHEN 'semantic' THEN 'S|' || root ELSE 'F|' || root || '|' || path END AS key FROM e),
  g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '{gap}' THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY key ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts) AS n FROM g),
  items AS (SELECT key, root, path, arg_max(kind, (ts, kind)) AS kind, min(priority) AS priority, min(ts) AS first_ts, max(ts) + INTERVAL '{gap}' AS due, count(*) AS events FROM s GROUP BY key, root, path, n)"""
_GAP = "3600 seconds"
_OUT = "key, root, path, kind, priority, epoch_us(first_ts) AS first_us, epoch_us(due) AS due_us, events"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return queue.coalesce(_events(spark, d), _GAP)


def _flat(x: DataFrame) -> DataFrame:
    return x.select("key", "root", "path", "kind", "priority", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("due").cast("timestamp")).alias("due_us"), "events")


_add("queue_coalesce", lambda s, d: _flat(_items(s, d)), f"WITH {_EV.format(gap=_GAP)} SELECT {_OUT} FROM items")
_add("queue_subsume", lambda s, d: _flat(queue.subsume(_items(s, d))), f"""WITH {_EV.format(gap=_GAP)}, r AS (SELECT root, max(due) AS refresh FROM items WHERE kind = 'refresh' GROUP BY 1)
  SELECT {_OUT} FROM items LEFT JOIN r USING (root) WHERE kind = 'refresh' AND due = refresh OR kind <> 'refresh' AND (refresh IS NULL OR first_ts > refresh)""")
_add("queue_dequeue", lambda s, d: _flat(queue.dequeue(_items(s, d), F.timestamp_micros(F.lit(1705017600000000)), 100)), f"WITH {_EV.format(gap=_GAP)} SELECT {_OUT} FROM items WHERE epoch_us(due) <= 1705017600000000 ORDER BY priority, first_ts, key LIMIT 100")
_add("pending_counts", lambda s, d: queue.pending_counts(_items(s, d)), f"WITH {_EV.format(gap=_GAP)} SELECT root, count(*) AS pending FROM items GROUP BY root")


def replay_last_action(spark: SparkSession, d: str) -> DataFrame:
    j = read(spark, d, "events").select((F.col("user_id") % 3).alias("volume_id"), F.col("event_id").alias("usn"), F.concat(F.lit("f"), F.col("user_id")).alias("file_ref"), F.col("event_type").alias("reason"))
    return queue.last_actions(j)


_add("replay_last_action", replay_last_action, """WITH j AS (SELECT user_id % 3 AS volume_id, event_id AS usn, 'f' || user_id AS file_ref, event_type AS reason FROM events),
  b AS (SELECT *, (row_number() OVER (PARTITION BY volume_id ORDER BY usn, file_ref) - 1) // 512 AS batch FROM j)
  SELECT volume_id, batch, file_ref, max(usn) AS usn, arg_max(reason, usn) AS reason FROM b GROUP BY volume_id, batch, file_ref""")


def plain_text_extract(spark: SparkSession, d: str) -> DataFrame:
    """Documents as bytes through the plain text extractor."""
    files = read(spark, d, "documents").where("text is not null and text <> ''").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return extract_files(files).where("status = 'ok'").select("path", F.col("line_number").cast("bigint").alias("line_number"), "content")


_add("plain_text_extract", plain_text_extract, f"WITH {LINES_SQL} SELECT file_id || '.txt' AS path, line_number, content FROM lines")
_PAGE = ("<html><head><style>p {color: red}</style><script>var a = '<b>';</script></head><body><!-- note --><h1>", "</h1><p>a &lt; b &amp; c</p>", "</body></html>")


def html_extract_text(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit(_PAGE[0]), "file_name", F.lit(_PAGE[1]), F.regexp_replace("text", "\n", "<br/>"), F.lit(_PAGE[2]))
    return read(spark, d, "documents").where("text is not null").select("doc_id", html_text(page).alias("content"))


def _html_sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    from siltstone.extract.markup import _NAMED, _STEPS

    c = f"{q(_PAGE[0])} || file_name || {q(_PAGE[1])} || replace(text, chr(10), '<br/>') || {q(_PAGE[2])}"
    for p, by in _STEPS:
        c = f"regexp_replace({c}, {q(p)}, {q(by)}, 'g')"
    for name, by in _NAMED.items():
        c = f"replace({c}, {q(name)}, {q(by)})"
    return f"SELECT doc_id, trim(regexp_replace({c}, '\\s+', ' ', 'g')) AS content FROM documents WHERE text IS NOT NULL"


_add("html_extract_text", html_extract_text, _html_sql())


def workflow_subsearch(spark: SparkSession, d: str) -> DataFrame:
    """Search, then search again in the files found, with a condition between."""
    docs = read(spark, d, "documents")
    files = document_files(docs)

    def run(query, scope: DataFrame | None) -> DataFrame:
        own = files if scope is None else files.join(scope, "path", "left_semi")
        texts = docs.select("doc_id", "text").join(own.select(F.col("file_id").alias("doc_id"), "path"), "doc_id")
        hits = search.search_texts(query, texts.select("doc_id", "text"), "doc_id", cap=None, today=TODAY)
        return hits.join(own.select("file_id", "path"), "file_id").select("path", "line_number", "content")

    runner = Runner(run)
    runner.run({"name": "narrow", "steps": [
        {"type": "search", "id": "first", "query": "archive", "mode": "plain"},
        {"type": "if", "id": "any", "condition": {"metric": "fileCount", "op": ">", "value": 0, "step": "first"}, "then": [{"type": "search", "id": "second", "query": "records", "mode": "plain", "scope": "first"}]},
    ]})
    return runner.hits.get("second", runner.hits["first"].limit(0))


_add("workflow_subsearch", workflow_subsearch, f"""WITH {FILES_SQL}, {LINES_SQL}, p AS (SELECT DISTINCT path FROM lines JOIN files USING (file_id) WHERE contains(lower(content), 'archive'))
  SELECT path, line_number, content FROM lines JOIN files USING (file_id) WHERE contains(lower(content), 'records') AND path IN (SELECT path FROM p)""")


# ------------------------------------------------------------- office formats


def _plain_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a markup file can hold (no control characters) with their lines."""
    from siltstone.sources.adapters import split_lines

    own = read(spark, d, "documents").where(r"text is not null and not text rlike '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\uFFFE\\uFFFF]'")
    return own.select("doc_id", split_lines(F.col("text")).alias("lines"))


def _office(kind: str):
    """Documents written as files of an office format, one line a paragraph or row, and extracted again."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def pack(lines) -> bytes:
        if kind == "docx":
            parts = {"word/document.xml": "<w>" + "".join(f"<p><r><t>{escape(x)}</t></r></p>" for x in lines) + "</w>"}
        elif kind == "xlsx":
            rows = "".join(f'<row r="{i}"><c t="s"><v>{i - 1}</v></c></row>' for i, x in enumerate(lines, 1))
            parts = {
                "xl/workbook.xml": '<w xmlns:r="rel"><sheets><sheet name="Text" r:id="rId7"/></sheets></w>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="rId7" Target="worksheets/sheet3.xml"/></R>',
                "xl/sharedStrings.xml": "<s>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in lines) + "</s>", "xl/worksheets/sheet3.xml": f"<w><sheetData>{rows}</sheetData></w>",
            }
        else:
            parts = {"inner.txt": "\n".join(lines)}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in parts.items():
                z.writestr(name, text.encode("utf-8"))
        return out.getvalue()

    def query(spark: SparkSession, d: str) -> DataFrame:
        @F.pandas_udf("binary")
        def packed(lines: pd.Series) -> pd.Series:
            return lines.map(pack)

        files = _plain_lines(spark, d).select(F.concat("doc_id", F.lit(f".{kind}")).alias("path"), packed("lines").alias("content"))
        got = extract_files(files).where("line_number is not null")
        return got.select(F.regexp_extract("path", r"^\d+", 0).cast("bigint").alias("doc_id"), F.col("line_number").cast("bigint").alias("line_number"), "content")

    return query


_PLAIN = r"""d AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS a FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{FFFE}\x{FFFF}]')),
  l AS (SELECT doc_id, i, a[i] AS x FROM d, range(1, CASE WHEN len(a) > 1 AND a[len(a)] = '' THEN len(a) ELSE len(a) + 1 END) AS t(i))"""



def _extracted_sql(content: str, where: str) -> str:
    return f"WITH {_PLAIN} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_number, {content} AS content FROM l WHERE {where}"


_BLANK = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
_add("word_extract", _office("docx"), _extracted_sql("x", f"NOT regexp_full_match(x, '{_BLANK}')"))
_add("excel_extract", _office("xlsx"), _extracted_sql("'[Text] ' || x", "x <> ''"))


def watcher_items(spark: SparkSession, d: str) -> DataFrame:
    """Watcher events of the pending changes as items of the queue: renames delete and upsert, errors refresh."""
    e = read(spark, d, "pending_changes").where("path is not null").select(F.col("root_path").alias("root"), "path", F.concat("path", F.lit("~")).alias("old_path"), F.col("priority"), F.col("queued_at").alias("ts"),
        F.element_at(F.array(*(F.lit(x) for x in ("created", "changed", "deleted", "renamed", "error"))), (F.col("id") % 5 + 1).cast("int")).alias("event"))
    return queue.from_watcher(e).groupBy("root", "path", "kind").agg(F.count("*").alias("events"))


_add("watcher_items", watcher_items, """WITH e AS (SELECT root_path AS root, path, id % 5 AS e FROM pending_changes WHERE path IS NOT NULL)
  SELECT root, path, kind, count(*) AS events FROM (SELECT root, path, 'upsert' AS kind FROM e WHERE e IN (0, 1, 3) UNION ALL SELECT root, path, 'delete' FROM e WHERE e = 2 UNION ALL SELECT root, path || '~', 'delete' FROM e WHERE e = 3
  UNION ALL SELECT root, NULL, 'refresh' FROM e WHERE e = 4) GROUP BY ALL""")
_add("match_all", lambda s, d: search.search_texts(build_query("ext:pdf"), read(s, d, "documents").select("doc_id", "text"), "doc_id", files=document_files(read(s, d, "documents")), cap=None).groupBy("file_id").agg(F.count("*").alias("lines")),
     f"WITH {FILES_SQL}, {LINES_SQL} SELECT file_id, count(*) AS lines FROM lines JOIN files USING (file_id) WHERE ext = '.pdf' GROUP BY file_id")
