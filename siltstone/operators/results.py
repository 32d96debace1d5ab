"""From candidates to results: fusion, reranking, snippets, facets, grouping, previews, answers, exports."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.index import nearest
from siltstone.query import compile as qc
from siltstone.query.nodes import Node
from siltstone.runtime import Scratch

KB, MB = 1024, 1024 * 1024
_SEPARATORS = re.compile(r"[\s,;:.!?()\[\]{}\"'/\\|<>=+*]+")


def fuse(candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``path, score, providers, hits, best_provider, rank`` of candidates ``provider, provider_id, path, score``.

    Each candidate adds its provider's weight times its score (1 where the score isn't positive). Paths are one
    in any case. The best candidate has the highest score, ties go to the lower provider id.
    """
    w = F.lit(1.0)
    for name, x in (weights or {}).items():
        w = F.when(F.col("provider") == name, F.lit(float(x))).otherwise(w)
    s = F.when(F.col("score") > 0, F.col("score")).otherwise(1.0).cast("double")
    own = candidates.withColumn("_w", w * s)
    per = own.groupBy(F.lower("path").alias("_key")).agg(
        F.min("path").alias("path"), F.sum("_w").alias("score"), F.count_distinct("provider").alias("providers"), F.count("*").alias("hits"),
        F.min(F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), F.lower("provider_id").alias("o"), "provider_id"))["provider_id"].alias("best_provider"),
    )
    return ranked(per.drop("_key"), [F.desc("score"), F.lower("path")])


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``rank`` from 1 in a total order, without one task that sees all rows.

    The rows are sorted in ranges and written with their place within the range; the ranges' sizes
    (one row a task) give the offsets.
    """
    at = F.col("_at")
    scratch = Scratch(df.sparkSession)
    placed = scratch.keep(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright(at, 33).alias("_part")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = placed.withColumn("_part", F.shiftright(at, 33)).join(F.broadcast(offsets), "_part")
    return out.withColumn("rank", at.bitwiseAND((1 << 33) - 1) + F.col("_before") + 1).drop("_at", "_part", "_before")


def rerank_terms(text: str) -> list[str]:
    """Distinct terms of at least two characters that reranking looks at."""
    return list(dict.fromkeys(t.lower() for t in _SEPARATORS.split(text) if len(t) >= 2))


def rerank(fused: DataFrame, terms: list[str], as_of: Column, text: str = "text", modified: str = "modified") -> DataFrame:
    """Adds a boost of at most 0.75 for names, text, providers, hits and recency, and numbers the results again."""
    name = F.lower(F.substring_index("path", "/", -1))
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    names, body = F.lit(0.0), F.lit(0.0)
    for t in terms:
        names = names + F.when(stem == t, 0.30).when(F.contains(name, F.lit(t)), 0.18).when(F.contains(F.lower("path"), F.lit(t)), 0.06).otherwise(0.0)
        body = body + F.when(F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(t)), 0.03).otherwise(0.0)
    days = (F.unix_micros(as_of) - F.unix_micros(modified)) / F.lit(86_400_000_000)
    fresh = F.when(F.col(modified).isNull(), 0.0).when(days <= 7, 0.08).when(days <= 30, 0.05).when(days <= 365, 0.02).otherwise(0.0)
    boost = F.least(names, F.lit(0.45)) + F.least(body, F.lit(0.18)) + F.least(0.05 * (F.col("providers") - 1), F.lit(0.15)) + F.least(0.03 * F.log(F.col("hits") + 1.0), F.lit(0.12)) + fresh
    return ranked(fused.drop("rank").withColumn("score", F.col("score") + F.least(boost, F.lit(0.75))), [F.desc("score"), F.lower("path")])


def snippets(query: Node, lines: DataFrame, key: str = "file_id", order: str = "line_number", around: int = 1) -> DataFrame:
    """Hits with ``snippet``: the line and its neighbours, and the highlights on the joined text."""
    near = nearest(lines, key, [order], "content", around).withColumn("snippet", F.array_join("around", "\n")).drop("around")
    return near.where(qc.matches(query, F.col("content"))).withColumn("highlights", qc.spans(query, F.col("snippet")))


def facet(df: DataFrame, value: Column, limit: int = 25) -> DataFrame:
    """``value, n`` of an open-valued facet, without regard to case, the most frequent first, with a row for all."""
    v = F.when(F.trim(value) == "", None).otherwise(value)
    per = df.groupBy(F.lower(F.coalesce(v, F.lit("__none"))).alias("_k")).agg(F.min(F.coalesce(v, F.lit("__none"))).alias("value"), F.count("*").alias("n")).drop("_k")
    return df.agg(F.count("*").alias("n")).select(F.lit("All").alias("value"), "n").unionByName(per.orderBy(F.desc("n"), "value").limit(limit))


def _bucket(cases: list[tuple[Column, str]], last: str) -> Column:
    """``(o, label)`` of the first case that holds, with its place."""
    struct = lambda n, label: F.struct(F.lit(n).alias("o"), F.lit(label).alias("label"))
    out = struct(len(cases) + 1, last)
    for n, (when, label) in reversed(list(enumerate(cases, 1))):
        out = F.when(when, struct(n, label)).otherwise(out)
    return out


def modified_bucket(modified: Column, as_of: Column) -> Column:
    """Age buckets; a null date is unknown."""
    days = F.datediff(as_of, modified)
    return _bucket([(days <= 0, "today"), (days <= 7, "last 7 days"), (days <= 30, "last 30 days"), (days > 30, "older")], "unknown")


def size_bucket(size: Column) -> Column:
    return _bucket([(size < 100 * KB, "small"), (size < 10 * MB, "medium"), (size >= 10 * MB, "large")], "unknown")


def bucket_facet(df: DataFrame, bucket: Column) -> DataFrame:
    """``position, value, n`` of a facet with fixed buckets; empty buckets are left out."""
    return df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).select(F.col("b.o").cast("bigint").alias("position"), F.col("b.label").alias("value"), "n")


def file_results(hits: DataFrame) -> DataFrame:
    """Hits as one row per file: ``file_id, hit_count, best_score, first_line``."""
    return hits.groupBy("file_id").agg(F.count("*").alias("hit_count"), F.max("score").alias("best_score"), F.min("line_number").alias("first_line"))


def result_order(preset: str) -> list[Column]:
    """Sort orders: ``relevance``, ``recency``, ``filename`` and ``hits``."""
    tie = [F.lower("path"), F.col("file_id")]
    return {
        "relevance": [F.desc("best_score"), *tie],
        "recency": [F.desc_nulls_last("modified"), *tie],
        "filename": [F.lower("file_name"), F.lower("directory"), F.col("file_id")],
        "hits": [F.desc("hit_count"), *tie],
    }[preset]


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of an ordered result."""
    return df.orderBy(*order).offset(number * size).limit(size)


def preview_windows(hits: DataFrame, around: int = 2, key: str = "file_id", line: str = "line_number") -> DataFrame:
    """``key, first_line, last_line``: windows of lines around hits; windows that overlap or touch are one."""
    w = Window.partitionBy(key).orderBy(line)
    own = hits.select(key, line).distinct().withColumn("_new", F.when(F.col(line) - F.lag(line).over(w) <= 2 * around + 1, 0).otherwise(1))
    own = own.withColumn("_g", F.sum("_new").over(w))
    return own.groupBy(key, "_g").agg(F.greatest(F.min(line) - around, F.lit(1)).alias("first_line"), (F.max(line) + around).alias("last_line")).drop("_g")


def recent_first(log: DataFrame, value: str, at: str, limit: int = 20) -> DataFrame:
    """The most recent values, each once in any case."""
    return log.groupBy(F.lower(value).alias("_k")).agg(F.max_by(value, at).alias(value), F.max(at).alias(at)).drop("_k").orderBy(F.desc(at), value).limit(limit)


def evidence(hits: DataFrame, limit: int = 8, width: int = 700) -> DataFrame:
    """The best passages for an answer: ``citation, path, text``, by search rank, hit rank (none is last) and score."""
    late = F.when(F.col("hit_rank") <= 0, 2**31 - 1).otherwise(F.col("hit_rank"))
    order = ["search_rank", late, F.desc("score"), "path"]
    top = hits.orderBy(*order).limit(max(1, min(50, limit)))
    text = F.when(F.char_length("text") > width, F.concat(F.rtrim(F.left("text", F.lit(width - 1))), F.lit("…"))).otherwise(F.col("text"))
    return top.withColumn("citation", F.row_number().over(Window.orderBy(*order))).select("citation", "path", text.alias("text"))


def answer_markdown(question: str, found: DataFrame) -> str:
    """An extractive answer with citations, from at most 50 rows of :func:`evidence`."""
    rows = found.orderBy("citation").collect()
    if not rows:
        return f"# {question}\n\nNo evidence was found.\n"
    files = len({r.path.lower() for r in rows})
    body = "\n".join(f"{r.citation}. {r.text}\n   — `{r.path}`" for r in rows)
    return f"# {question}\n\n{len(rows)} passages from {files} files.\n\n{body}\n"


def location_label(page_no: Column, line: Column, section: Column | None = None) -> Column:
    """``page 3, line 7, section x`` from what is known."""
    parts = [F.when(page_no.isNotNull(), F.concat(F.lit("page "), page_no.cast("string"))), F.when(line.isNotNull(), F.concat(F.lit("line "), line.cast("string")))]
    if section is not None:
        parts.append(F.when(section.isNotNull(), F.concat(F.lit("section "), section)))
    return F.concat_ws(", ", *parts)


def size_label(n: Column) -> Column:
    return F.when(n < KB, F.concat(n.cast("string"), F.lit(" B"))).when(n < MB, F.concat(F.format_number(n / KB, 1), F.lit(" KB"))).when(n < KB * MB, F.concat(F.format_number(n / MB, 1), F.lit(" MB"))).otherwise(F.concat(F.format_number(n / (KB * MB), 1), F.lit(" GB")))


# ----------------------------------------------------------------------- exports


def csv_field(c: Column) -> Column:
    """A CSV field: quoted if it holds a comma, a quote or a line end, quotes doubled; null is empty."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(v.rlike(r'[,"\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def export(df: DataFrame, folder: str, kind: str = "jsonl") -> None:
    """Writes a result as ``jsonl``, ``csv`` or ``parquet``, in parallel."""
    w = df.write.mode("overwrite")
    if kind == "csv":
        w.option("header", True).option("escape", '"').option("quote", '"').csv(folder)
    elif kind == "jsonl":
        w.json(folder)
    elif kind == "parquet":
        w.parquet(folder)
    else:
        raise ValueError(f"unknown format '{kind}'")


def export_document(df: DataFrame, path: str, kind: str, limit: int = 10_000) -> int:
    """One JSON, CSV or Markdown document of at most ``limit`` hits ``path, line_number, content``; returns how many there are in all."""
    total = df.count()
    rows = df.orderBy("path", "line_number").limit(limit).collect()
    if kind == "json":
        text = json.dumps({"total": total, "truncated": total > len(rows), "hits": [r.asDict() for r in rows]}, ensure_ascii=False, default=str, indent=1)
    elif kind == "csv":
        q = lambda v: '"' + v.replace('"', '""') + '"' if re.search(r'[,"\r\n]', v) else v
        text = "path,lineNumber,line\n" + "".join(",".join(q(str(v)) for v in (r.path, r.line_number, r.content)) + "\n" for r in rows)
    elif kind == "markdown":
        text = "\n".join(_sections(rows))
    else:
        raise ValueError(f"unknown format '{kind}'")
    temp = f"{path}.part"
    with open(temp, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temp, path)
    return total


def _sections(rows: Iterable) -> Iterable[str]:
    last = None
    for r in rows:
        if r.path != last:
            yield f"\n## {r.path}\n"
            last = r.path
        yield f"- {r.line_number}: {r.content}"


# ----------------------------------------------------------------------- measures


def relevance(run: DataFrame, judged: DataFrame, k: int = 10, recall_at: int = 20) -> DataFrame:
    """One row: ``mrr, ndcg, recall, zero_result_rate, top_accuracy`` of ranked results ``query, path, rank`` against ``query, path``."""
    rel = judged.select("query", "path").distinct()
    hits = run.join(rel.withColumn("rel", F.lit(1)), ["query", "path"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    gain = F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    per = hits.groupBy("query").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), gain.alias("dcg"), F.count_if((F.col("rel") == 1) & (F.col("rank") <= recall_at)).alias("found"), F.max(F.when(F.col("rank") == 1, F.col("rel"))).alias("top"))
    want = rel.groupBy("query").agg(F.count("*").alias("n")).withColumn("ideal", F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0)))
    x = want.join(per, "query", "left")
    zero = F.lit(0.0)
    return x.agg(F.avg(F.coalesce(1 / F.col("first"), zero)).alias("mrr"), F.avg(F.coalesce(F.col("dcg") / F.col("ideal"), zero)).alias("ndcg"), F.avg(F.coalesce(F.col("found") / F.col("n"), zero)).alias("recall"), F.avg(F.when(F.col("dcg").isNull(), 1.0).otherwise(0.0)).alias("zero_result_rate"), F.avg(F.coalesce(F.col("top").cast("double"), zero)).alias("top_accuracy"))


def latency(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """``p50, p95, p99`` with linear interpolation."""
    return df.groupBy(*keys).agg(*(F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)))


