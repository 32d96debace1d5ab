"""Queries of the subpackage and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import encoding, language, mixing, near_duplicates, packing, scans, splitting, tokens
from siltstone.runtime import Scratch, read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_pairs(read(spark, d, "content_chunks"), words=3, threshold=0.6)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Classes of chunks alike at 0.8 or more on sequences of five words."""
    return near_duplicates.groups(read(spark, d, "content_chunks"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    units = splitting.with_limits(read(spark, d, "content_units"), read(spark, d, "indexed_files"), read(spark, d, "chunking_options"))
    return splitting.split_items(units, "unit_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("unit_id", F.explode("pieces").alias("p")).where("p.piece_no = 2").select("unit_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every unit, within the limit of its file's option."""
    units = read(spark, d, "content_units").select("id", "file_id", "unit_text").dropDuplicates(["id"])
    own = splitting.with_limits(units, read(spark, d, "indexed_files"), read(spark, d, "chunking_options"))
    x = splitting.split_items(own, "unit_text").select("unit_id", "limit", F.explode("pieces").alias("p"))
    return x.select("unit_id", "limit", "p.piece_no", "p.start", "p.core_length", "p.overlap_length", "p.piece_text")


def p4_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each unit give back when their cores are put together, and how many break the limit or their overlap."""
    x = p4_pieces(spark, d)
    core = F.right("piece_text", F.char_length("piece_text") - F.col("overlap_length"))
    wrong = F.count_if((F.char_length("piece_text") > F.col("limit")) | (F.char_length(core) != F.col("core_length")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", core.alias("core")))), lambda p: p["core"]), "")
    return x.groupBy("unit_id").agg(F.sha2(whole, 256).alias("text_hash"), wrong.alias("wrong_pieces"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or of each part of one beyond the capacity."""
    docs = Scratch(spark).keep(tokens.with_tokens(read(spark, d, "documents").select("doc_id", "text")))
    return packing.pack(spark, docs, read(spark, d, "pack_budgets"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and filling of each budget."""
    own = read(spark, d, "pack_budgets").select("budget_id", "capacity_tokens")
    x = p7_containers(spark, d).groupBy("budget_id", "bin").agg(F.sum("size").alias("used")).groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return x.join(F.broadcast(own), "budget_id").withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed in each budget, and how many containers are too full or documents cut without need."""
    own = F.broadcast(read(spark, d, "pack_budgets").groupBy("budget_id").agg(F.max("capacity_tokens").alias("cap")))
    x = p7_containers(spark, d).join(own, "budget_id")
    full = x.groupBy("budget_id", "bin").agg(F.sum("size").alias("used"), F.max("cap").alias("cap")).groupBy("budget_id").agg(F.count_if(F.col("used") > F.col("cap")).alias("too_full"))
    docs = x.groupBy("budget_id", "doc_id").agg(F.count("*").alias("parts"), F.max("part").alias("last"), F.sum("size").alias("size"), F.max("cap").alias("cap"))
    cut = F.count_if((F.col("parts") != F.col("last")) | (F.col("parts") > F.greatest(F.ceil(F.col("size") / F.col("cap")), F.lit(1))))
    return docs.groupBy("budget_id").agg(F.count("*").alias("documents"), cut.alias("cut_wrongly")).join(full, "budget_id")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").select("doc_id", mixing.source_name(F.col("source")).alias("source"), mixing.quality(F.col("text")).alias("weight"), "text")
    return Scratch(spark).keep(tokens.with_tokens(own))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents that each mix takes, with their copies."""
    return mixing.draw(spark, _sized(spark, d), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    docs, mixes = _sized(spark, d), read(spark, d, "mix_targets")
    return mixing.report(docs, mixes, mixing.draw(spark, docs, mixes))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """The normalised target of each source in each mix, and whether the draw broke a cap or missed its budget by more than a document."""
    docs, mixes = _sized(spark, d), read(spark, d, "mix_targets")
    most = docs.groupBy("source").agg(F.max("tokens").alias("largest"))
    x = mixing.report(docs, mixes, mixing.draw(spark, docs, mixes)).join(F.broadcast(most), "source", "left")
    x = x.join(F.broadcast(mixing.targets(mixes).select("mix_id", "source", "max_repeats")), ["mix_id", "source"])
    cap = F.coalesce(F.col("max_repeats").cast("double"), F.lit(1e18))
    due = F.least(F.col("budget"), F.col("available") * cap)
    missed = F.abs(F.col("tokens") - due) > F.coalesce("largest", F.lit(0)) + 1e-6
    return x.select("mix_id", "source", F.round("share", 9).alias("share"), (F.col("most_copies") > cap).alias("above_cap"), missed.alias("missed"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_passages(read(spark, d, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every garbled passage with its original text, null where characters were lost."""
    return encoding.garbled_passages(read(spark, d, "documents"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every garbled document with its text restored as far as it can be had, and whether all of it could."""
    return encoding.restored_documents(read(spark, d, "documents"))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_lines(read(spark, d, "content_units"), read(spark, d, "indexed_lines"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    defects = F.array_compact(F.array(*(F.when(F.col(c), F.lit(c)) for c in ("furniture", "broken", "misread"))))
    return _scans(spark, d).select(F.col("id").alias("line_id"), F.explode(defects).alias("defect"))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Continuous repaired paragraphs of every scanned page."""
    return scans.paragraphs(_scans(spark, d)).withColumnRenamed("unit", "unit_id")


def _segments(units: DataFrame) -> DataFrame:
    once = units.select("id", "unit_text", "unit_language")
    taught = language.labelled_sentences(once, "id", "unit_text", "unit_language")
    return language.segments(once, language.fit(*taught), temperature=language.calibrate(*taught))


def _languages(units: DataFrame) -> DataFrame:
    return language.units_by_language(_segments(units).drop("segment").distinct())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    units = read(spark, d, "content_units")
    return language.relabelled(units, _languages(units)).select(F.col("id").alias("unit_id"), "lang")


def p6_units(spark: SparkSession, d: str) -> DataFrame:
    """The language of each unit with running text and how sure it is."""
    return language.main_language(_languages(read(spark, d, "content_units"))).withColumnRenamed("id", "unit_id")


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of each stretch of every unit that is in one language."""
    return _segments(read(spark, d, "content_units")).withColumnRenamed("id", "unit_id").dropDuplicates(["unit_id", "segment_no"])


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p4_found, p4_pieces, p4_rejoined, p7_containers, p7_fill, p7_whole, p8_mixture, p8_shares, p8_kept, p9_found, p9_restored, p9_documents, p6_found, p6_units, p6_segments, p3_found, p3_paragraphs)}

_WHITE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)||" + "||".join(f"chr({c})" for c in range(0x2000, 0x200B))

SQL = {
    "p2_found": r"""
WITH own AS (SELECT DISTINCT id, list_filter(regexp_split_to_array(lower(chunk_text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM content_chunks WHERE chunk_text IS NOT NULL),
sh AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM own, range(1, len(w) - 1) AS t(i)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM pairs JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE m >= 0.6 * (x.n + y.n - m)""",
    "p2_groups": r"""
WITH RECURSIVE own AS MATERIALIZED (SELECT DISTINCT id, list_filter(regexp_split_to_array(lower(chunk_text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM content_chunks),
sh AS MATERIALIZED (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM own, range(1, len(w) - 3) AS t(i)),
sets AS MATERIALIZED (SELECT id, list(s ORDER BY s) AS l, count(*) AS n FROM sh GROUP BY id),
reps AS MATERIALIZED (SELECT id, n, min(id) OVER (PARTITION BY l) AS rep, count(*) OVER (PARTITION BY l) AS copies FROM sets),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN reps x ON x.id = a AND x.rep = a JOIN reps y ON y.id = b AND y.rep = b WHERE m >= 0.8 * (x.n + y.n - m)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS links FROM ways GROUP BY a)
SELECT o.id, COALESCE(class_id, o.id) AS class_id, COALESCE(links, 0) AS links, COALESCE(copies, 0) AS copies
FROM (SELECT DISTINCT id FROM content_chunks) o LEFT JOIN reps r ON r.id = o.id LEFT JOIN class c ON c.a = r.rep LEFT JOIN degree d ON d.a = r.rep""",
    "p4_found": f"""
WITH f AS (SELECT id, max(option_id) AS option_id FROM indexed_files GROUP BY id),
o AS (SELECT option_id, least(greatest(COALESCE(target_characters, 1600), 128), 65536) AS t, COALESCE(max_characters, 2400) AS m FROM chunking_options)
SELECT DISTINCT u.id AS unit_id FROM content_units u LEFT JOIN f ON f.id = u.file_id LEFT JOIN o ON o.option_id = f.option_id
WHERE length(trim(u.unit_text, {_WHITE})) > COALESCE(least(greatest(m, t), 98304), 2400)""",
    "p4_rejoined": f"""
SELECT DISTINCT id AS unit_id, sha256(trim(unit_text, {_WHITE})) AS text_hash, 0 AS wrong_pieces FROM content_units WHERE length(trim(unit_text, {_WHITE})) > 0""",
    "p7_whole": """
SELECT budget_id, (SELECT count(*) FROM documents) AS documents, 0 AS cut_wrongly, 0 AS too_full FROM pack_budgets WHERE capacity_tokens >= 1 GROUP BY budget_id""",
    "p8_kept": r"""
WITH t AS (SELECT mix_id, NULLIF(regexp_replace(regexp_replace(lower(source), '^[\s\-_]+|[\s\-_]+$', '', 'g'), '[\s\-_]+', '_', 'g'), '') AS source,
  sum(greatest(COALESCE(target_share, 0), 0)) AS target FROM mix_targets GROUP BY ALL),
w AS (SELECT *, sum(target) OVER (PARTITION BY mix_id) AS whole FROM t)
SELECT mix_id, source, round(CASE WHEN whole > 0 THEN target / whole ELSE 0 END, 9) AS share, false AS above_cap, false AS missed FROM w WHERE source IS NOT NULL""",
}
