"""The index: tokens, postings, look-ups, joins, differences, validation, health, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.search import cap_hits
from siltstone.operators.store import CONTENT_VERSION, SnapshotStore  # noqa: F401
from siltstone.query import compile as qc
from siltstone.query.filters import category
from siltstone.query.nodes import Node

TABLES = ("files", "lines", "content_units", "postings", "metadata_tokens", "chunks", "vectors", "issues", "drifts")


# ------------------------------------------------------------------ building


def tokens_of(c: Column) -> Column:
    """Distinct tokens of a text in lower case; null gives none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(qc.TOKEN), F.lit(0)))


def with_prefixes(tokens: Column) -> Column:
    """The tokens and their prefixes of 2 to 31 characters that are shorter than the token."""
    shorter = lambda t: F.when(F.char_length(t) > 2, F.transform(F.sequence(F.lit(2), F.least(F.lit(31), F.char_length(t) - 1)), lambda n: F.left(t, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, shorter))))


def metadata_tokens(files: DataFrame) -> DataFrame:
    """``file_id, token``: tokens of path, folder, extension and category, and of name, stem and segments with their prefixes."""
    whole = F.concat(tokens_of(F.col("path")), tokens_of(F.col("directory")), tokens_of(F.col("ext")), tokens_of(category(F.col("ext"))))
    names = tokens_of(F.concat_ws(" ", "file_name", "stem", F.regexp_replace("rel_path", "/", " ")))
    return files.select("file_id", F.explode(F.array_distinct(F.concat(whole, with_prefixes(names)))).alias("token"))


def postings(lines: DataFrame) -> DataFrame:
    """``token, file_id, line_number``: each token of a line once."""
    return lines.select(F.explode(tokens_of(F.col("content"))).alias("token"), "file_id", "line_number")


def content_units(lines: DataFrame) -> DataFrame:
    """One unit per line, with the hash of its text."""
    return lines.select("file_id", "line_number", F.lit("Text").alias("kind"), F.col("content").alias("unit_text"), F.sha2("content", 256).alias("content_hash"), F.concat(F.lit("line "), "line_number").alias("locator"))


# -------------------------------------------------------------------- look-up


def lookup(posts: DataFrame, tokens: list[str], keys: list[str], require_all: bool = True) -> DataFrame:
    """The keys that hold all (or any) of the tokens. The token filter reaches the scan; only matching postings are grouped."""
    want = sorted({t.lower() for t in tokens})
    hit = posts.where(F.col("token").isin(*want)).groupBy(*keys).agg(F.count_distinct("token").alias("_n"))
    return hit.where(F.col("_n") >= (len(want) if require_all else 1)).select(*keys)


def search_indexed(query: Node, lines: DataFrame, posts: DataFrame, cap: int | None = None) -> DataFrame:
    """Hits by postings and recheck; a query without whole tokens scans the lines.

    Each token conjunction of the query gives candidate lines; the predicate then decides on the line itself. Tokens
    are whole: a term that starts or ends inside a token is found only where it is a token of its own.
    """
    groups = qc.candidate_tokens(query)
    if groups:
        found = [lookup(posts, list(g), ["file_id", "line_number"]) for g in groups]
        keys = reduce(lambda a, b: a.unionByName(b), found)
        lines = lines.join(keys.distinct() if len(found) > 1 else keys, ["file_id", "line_number"], "left_semi")
    hits = lines.where(qc.matches(query, F.col("content")))
    return cap_hits(hits, cap) if cap else hits


def line_scan(lines: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """Lines with their files (status ok) and units: the scan that index searches read."""
    ok = files.where("status = 'ok'").select("file_id", "path")
    return lines.join(ok, "file_id").join(units, "content_unit_id", "left")


# ------------------------------------------------------- difference, validation

_STATE = ("size_bytes", "modified", "extractor_id", "extractor_version")


def difference(seen: DataFrame, index: DataFrame, key: str = "path", state: tuple[str, ...] = _STATE, status: str = "status") -> DataFrame:
    """``key, change`` of a full outer comparison: ``new``, ``changed``, ``removed`` or ``unchanged``.

    Rows are unchanged if all of ``state`` are equal (null equals null) and the indexed row is ok; rows in error are retried.
    Keys are unique on both sides.
    """
    s = seen.select(key, F.struct(*state).alias("_s"))
    i = index.select(key, F.struct(*state).alias("_i"), F.col(status).alias("_status"))
    same = F.col("_s").eqNullSafe(F.col("_i")) & (F.col("_status") == "ok")
    change = F.when(F.col("_i").isNull(), "new").when(F.col("_s").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return s.join(i, key, "full_outer").select(key, change.alias("change"))


def refresh(index: DataFrame, seen: DataFrame, key: str = "path") -> DataFrame:
    """The index after a refresh: unchanged rows kept, new and changed rows taken from ``seen``, the rest gone."""
    d = difference(seen, index, key)
    kept = index.join(d.where("change = 'unchanged'"), key, "left_semi")
    return kept.unionByName(seen.join(d.where("change in ('new', 'changed')"), key, "left_semi"), allowMissingColumns=True)


def drifts(seen: DataFrame, index: DataFrame, key: str = "path") -> DataFrame:
    """Validation: ``key, kind`` for every file that the index has wrong (``missing``, ``stale``, ``orphaned``, ``failed``)."""
    d = difference(seen, index, key).join(index.select(key, F.col("status").alias("_st")), key, "left")
    kind = F.when(F.col("change") == "new", "missing").when(F.col("change") == "removed", "orphaned").when((F.col("change") == "changed") & (F.col("_st") != "ok"), "failed").when(F.col("change") == "changed", "stale")
    return d.select(key, kind.alias("kind")).where("kind is not null")


def stale(index: DataFrame, seen: DataFrame, key: str = "path") -> DataFrame:
    """Indexed rows whose file is no longer there."""
    return index.join(seen.select(key), key, "left_anti")


# --------------------------------------------------------------------- reports


def root_stats(files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Per root: files by status, bytes and the latest index time; with ``lines`` (``file_id``) also how many lines its files that are ok have."""
    ok = F.col("status") == "ok"
    out = files.groupBy("root_id").agg(
        F.count("*").alias("files"), F.count_if(ok).alias("ok_files"), F.count_if(F.col("status") == "error").alias("failed_files"), F.count_if(F.col("status") == "skipped").alias("skipped_files"),
        F.sum("size_bytes").alias("bytes"), F.unix_micros(F.max("indexed_at")).alias("last_indexed_us"),
    )
    if lines is None:
        return out
    per = lines.groupBy("file_id").agg(F.count("*").alias("n")).join(files.where(ok).select("file_id", "root_id"), "file_id").groupBy("root_id").agg(F.sum("n").alias("lines"))
    return out.join(per, "root_id", "left").withColumn("lines", F.coalesce("lines", F.lit(0)).cast("bigint"))


def strategy(kind: Column, usn: Column) -> Column:
    """How a location is kept up to date, the first that applies."""
    return F.when(kind == "cloud", "cloud").when(kind == "network", "network").when(kind == "removable", "removable").when(usn == 1, "ntfs-usn").otherwise("snapshot")


def root_health(roots: DataFrame, files: DataFrame, volumes: DataFrame, pending: DataFrame, most_failures: int = 25) -> DataFrame:
    """``root_id, status, pending, failures``: the first of the checks that fails names the status."""
    waiting = pending.groupBy("root_path").agg(F.count("*").alias("pending"))
    failed = files.groupBy("root_id").agg(F.count_if(F.col("status") == "error").alias("failures"), F.count_if(F.col("status") == "indexing").alias("running"), F.count("*").alias("known"))
    own = roots.groupBy("id").agg(F.max(F.struct("root_path", "volume_id", "update_strategy", "location_kind")).alias("r")).select(F.col("id").alias("root_id"), "r.*")
    vol = volumes.groupBy("id").agg(F.max(F.struct("health", "journal_id", "usn_supported")).alias("v")).select(F.col("id").alias("volume_id"), "v.*")
    x = own.join(F.broadcast(vol), "volume_id", "left").join(waiting, "root_path", "left").join(failed, "root_id", "left")
    status = (
        F.when(F.col("health").isNull(), "offline")
        .when(F.coalesce("known", F.lit(0)) == 0, "empty")
        .when(F.col("running") > 0, "indexing")
        .when(F.col("failures") >= most_failures, "failing")
        .when(F.col("health") != "ok", "stale")
        .when((F.col("update_strategy") == "usn") & F.col("journal_id").isNull(), "needs-scan")
        .when(F.coalesce("pending", F.lit(0)) > 0, "pending")
        .when(F.col("failures") > 0, "warnings")
        .otherwise("healthy")
    )
    return x.select("root_id", status.alias("status"), strategy(F.col("location_kind"), F.col("usn_supported")).alias("strategy"), F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("failures", F.lit(0)).alias("failures"))


def containing_roots(paths: DataFrame, roots: DataFrame, most_roots: int = 100_000) -> DataFrame:
    """``path, root_id`` for every root that a path lies under (or is).

    The path's ancestors are made rows and meet the roots in an equi-join: no comparison of every path with every root.
    """
    r = roots.groupBy(F.lower(F.translate("root_path", "\\", "/")).alias("_at")).agg(F.collect_set("id").alias("_ids"))
    seg = F.split(F.lower(F.translate("path", "\\", "/")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(seg)), lambda n: F.array_join(F.slice(seg, 1, n), "/"))
    return paths.select("path").distinct().select("path", F.explode(up).alias("_at")).join(r, "_at").select("path", F.explode("_ids").alias("root_id"))


# -------------------------------------------------------------------- coverage


def covers(profile: dict, request: dict) -> str:
    """Whether an index profile answers a request: ``covered`` or the first reason against it."""
    if not profile:
        return "missing"
    if profile.get("content") not in (None, CONTENT_VERSION):
        return "outdated"
    if request.get("recursive", True) and not profile.get("recursive", True):
        return "not-recursive"
    if request.get("hidden", False) and not profile.get("hidden", False):
        return "without-hidden"
    have, want = profile.get("include") or None, request.get("include") or None
    if have and (not want or not set(want) <= set(have)):
        return "narrower"
    if set(profile.get("exclude") or ()) - set(request.get("exclude") or ()):
        return "excludes-more"
    return "covered"


def nearest(c: DataFrame, key: str, order: list[str], value: str, n: int = 1) -> DataFrame:
    """Adds ``around``: the values of the rows up to ``n`` before and after, in order."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-n, n)
    return c.withColumn("around", F.collect_list(value).over(w))
