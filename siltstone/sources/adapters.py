"""The engine's tables from the tables at hand.

``files``: one row a file, ``file_id, root, path, rel_path, rel_dir, directory, file_name, stem, ext, size_bytes,
modified, created, status, extractor_id`` (paths with ``/``). ``lines``: ``file_id, line_number, content``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_END = r"\r\n|\r|\n"


def path_columns(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds the parts of a path; the root is its first segment."""
    p = F.translate(F.col(path), "\\", "/")
    df = df.withColumn("path", p)
    name = F.substring_index("path", "/", -1)
    df = df.withColumn("file_name", name).withColumn("directory", F.regexp_replace("path", r"/[^/]*$", "")).withColumn("root", F.substring_index("path", "/", 1))
    df = df.withColumn("rel_path", F.regexp_replace("path", r"^[^/]*/", "")).withColumn("rel_dir", F.regexp_replace(F.regexp_replace("directory", r"^[^/]*(/|$)", ""), "^/", ""))
    ext = F.lower(F.regexp_extract("file_name", r"\.[^.]+$", 0))
    return df.withColumn("ext", ext).withColumn("stem", F.regexp_replace("file_name", r"\.[^.]+$", ""))


def document_files(documents: DataFrame) -> DataFrame:
    """Files of the collected documents. A document without text is a file in error."""
    own = documents.select(
        F.col("doc_id").alias("file_id"),
        F.concat("folder", F.lit("\\"), "file_name").alias("path"),
        F.col("n_chars").alias("size_bytes"),
        F.col("collected_at").alias("modified"),
        F.timestamp_add("DAY", -(F.col("doc_id") % 100).cast("int"), F.col("collected_at")).alias("created"),
        F.when(F.col("text").isNull(), "error").otherwise("ok").alias("status"),
        F.col("doc_kind").alias("extractor_id"),
    )
    return path_columns(own)


def split_lines(text: Column) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    parts = F.split(text, LINE_END, -1)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).when(text == "", F.array().cast("array<string>")).otherwise(parts)


def text_lines(texts: DataFrame, key: str, text: str = "text", where: Column | None = None) -> DataFrame:
    """``file_id, line_number, content`` of every text that passes ``where``; null and empty texts have no lines."""
    own = texts.where(F.col(text).isNotNull())
    if where is not None:
        own = own.where(where)
    return own.select(F.col(key).alias("file_id"), F.posexplode(split_lines(F.col(text))).alias("_n", "content")).select("file_id", (F.col("_n") + 1).cast("bigint").alias("line_number"), "content")


def indexed_files(files: DataFrame) -> DataFrame:
    """Files of an index: repeated rows once, the latest ``indexed_at`` of an id."""
    own = files.groupBy("id").agg(F.max_by(F.struct("root_id", "path", "size_bytes", "created_at", "modified_at", "indexed_at", "status", "error", "volume_id", "extractor_id", "extractor_version"), "indexed_at").alias("f"))
    flat = own.select(F.col("id").alias("file_id"), "f.root_id", "f.path", "f.size_bytes", F.col("f.created_at").alias("created"), F.col("f.modified_at").alias("modified"), F.col("f.indexed_at").alias("indexed_at"), "f.status", "f.error", "f.volume_id", "f.extractor_id", "f.extractor_version")
    return path_columns(flat)
