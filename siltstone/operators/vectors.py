"""Vectors: exact and hashed nearest neighbours, file vectors, two-level retrieval, chunking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.binding import let
from siltstone.runtime import Scratch

#: Hyperplanes, bands of the hash, and vectors from which hashing pays.
PLANES, BANDS, HASHED_FROM = 64, 8, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, added up in double; null if a vector is null, zero, or the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def _literal(q: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in q))


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """The k vectors most like the query: ``key, score``, positive scores only, ties by key. Each task keeps k rows."""
    scored = vectors.select(key, cosine(F.col(vector), _literal(query)).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(k)


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vector", block: int = 256) -> DataFrame:
    """The k nearest vectors of each query: ``query_id, key, score``; equal keys are skipped.

    Queries come in blocks of fixed size to every task; a block is one matrix product per batch of vectors and each task keeps k rows a query,
    so what is shuffled is tasks x queries x k rows.
    """
    return _nearest(vectors, queries, k, key, vector, block)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str, block: int, candidates=None) -> DataFrame:
    """``candidates`` gives, for a block of query vectors, ``key, _c``: the numbers of the queries that a vector is scored for; without it, all are."""
    qs = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q"))
    rows = qs.count()
    kind = vectors.schema[key].dataType.simpleString()
    parts = max(1, -(-rows // block))
    cut = qs.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    # many blocks are worked off one by one and written to one table: the plan doesn't grow with them
    table = Scratch(vectors.sparkSession).table() if parts > 1 else None
    out = None
    for i in range(parts):
        own = cut.where(F.col("_b") == i).collect()
        if not own:
            continue
        ids, m = [r.query_id for r in own], np.array([r.q for r in own], dtype=np.float64)
        chosen = vectors if candidates is None else vectors.join(candidates(m), key)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, m))

        def near(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            best: list[list[tuple[float, object]]] = [[] for _ in ids]
            for f in frames:
                f = f[f["v"].map(lambda v: v is not None and len(v) == m.shape[1])]
                if not len(f):
                    continue
                x = np.array(f["v"].tolist(), dtype=np.float64)
                s = m @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                if "c" in f:
                    scored = np.zeros(s.shape, dtype=bool)
                    for j, c in enumerate(f["c"]):
                        scored[c, j] = True
                    s[~scored] = -1.0
                keys = f["k"].tolist()
                for q in range(len(ids)):
                    n = min(len(keys), k + 1)
                    top = np.argpartition(-s[q], n - 1)[:n] if n < len(keys) else range(len(keys))
                    # ties at the edge are kept, so the last key decides as everywhere
                    edge = min(s[q][j] for j in top)
                    top = np.flatnonzero(s[q] >= edge)
                    best[q] = sorted(best[q] + [(-s[q][j], keys[j]) for j in top if keys[j] != ids[q] and s[q][j] > 0])[:k]
            yield pd.DataFrame([(ids[q], kk, -s) for q in range(len(ids)) for s, kk in best[q]], columns=["query_id", key, "score"])

        own_columns = [F.col(key).alias("k"), F.col(vector).alias("v"), *([] if candidates is None else [F.col("_c").alias("c")])]
        got = chosen.select(*own_columns).mapInPandas(near, f"query_id {kind}, {key} {kind}, score double")
        if table is None:
            out = got
        else:
            got.write.mode("append").parquet(table)
            out = vectors.sparkSession.read.schema(got.schema).parquet(table)
    if out is None:
        return qs.select("query_id", F.col("query_id").alias(key), F.lit(0.0).alias("score")).limit(0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def planes(dimension: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((PLANES, dimension))


def signatures(vectors: DataFrame, dimension: int, key: str = "id", vector: str = "vector", seed: int = 17) -> DataFrame:
    """``key, band, value`` of every vector: the index of the hashed search. Signs come from one product with the hyperplanes per batch."""
    h = vectors.sparkSession.sparkContext.broadcast(planes(dimension, seed))
    kind = vectors.schema[key].dataType.simpleString()

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["v"].map(lambda v: v is not None and len(v) == dimension)]
            if len(f):
                up = (np.array(f["v"].tolist(), dtype=np.float64) @ h.value.T >= 0).reshape(len(f), BANDS, -1)
                value = (up * (1 << np.arange(up.shape[2]))).sum(axis=2)
                yield pd.DataFrame({key: np.repeat(f["k"].to_numpy(), BANDS), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(f)), "value": value.ravel().astype(np.int32)})

    return vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(sign, f"{key} {kind}, band int, value int")


def _near_values(value: int, flips: int) -> set[int]:
    """The values up to ``flips`` (at most 2) bits apart from ``value``."""
    per = PLANES // BANDS
    return {value} | {value ^ (1 << i) for i in range(per) if flips > 0} | {value ^ (1 << i) ^ (1 << j) for i in range(per) for j in range(i) if flips > 1}


def _band_values(m: np.ndarray, seed: int) -> np.ndarray:
    """The value of each band of each row of ``m``, as in :func:`signatures`."""
    up = (m @ planes(m.shape[1], seed).T >= 0).reshape(len(m), BANDS, -1)
    return (up * (1 << np.arange(up.shape[2]))).sum(axis=2)


def hashed_top_k(vectors: DataFrame, index: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector", seed: int = 17, flips: int = 2) -> DataFrame:
    """The k nearest among the vectors that share a band with the query, up to ``flips`` bits apart in it; scored exactly.

    ``index`` comes from :func:`signatures`. If there are fewer than ``HASHED_FROM`` vectors, or fewer than k candidates share a band, the exact
    search answers.
    """
    if index.where("band = 0").limit(HASHED_FROM).count() < HASHED_FROM:
        return top_k(vectors, query, k, key, vector)
    probes = None
    for b, value in enumerate(_band_values(np.array([query], dtype=np.float64), seed)[0]):
        own = (F.col("band") == b) & F.col("value").isin(*sorted(_near_values(int(value), flips)))
        probes = own if probes is None else probes | own
    found = index.where(probes).select(key).distinct()
    if found.limit(k).count() < k:
        return top_k(vectors, query, k, key, vector)
    return top_k(vectors.join(found, key, "left_semi"), query, k, key, vector)


def hashed_top_k_many(vectors: DataFrame, index: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "vector", seed: int = 17, flips: int = 2, block: int = 256) -> DataFrame:
    """:func:`hashed_top_k` of each query: ``query_id, key, score``; equal keys are skipped.

    The probed values of a block of queries meet the index on band and value: one row for each value that occurs, with the numbers of
    its queries. A query that finds fewer than k is answered by the exact search.
    """
    spark = vectors.sparkSession

    def candidates(m: np.ndarray) -> DataFrame:
        at: dict[tuple[int, int], list[int]] = {}
        for q, row in enumerate(_band_values(m, seed)):
            for b, value in enumerate(row):
                for x in _near_values(int(value), flips):
                    at.setdefault((b, x), []).append(q)
        probes = spark.createDataFrame([(b, x, qs) for (b, x), qs in at.items()], "band int, value int, q array<int>")
        return index.join(F.broadcast(probes), ["band", "value"]).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("q"))).alias("_c"))

    got = Scratch(spark).keep(_nearest(vectors, queries, k, key, vector, block, candidates))
    full = got.groupBy("query_id").count().where(F.col("count") >= k)
    short = queries.join(full, queries[key] == full["query_id"], "left_anti")
    return got.join(full, "query_id", "left_semi").unionByName(top_k_many(vectors, short, k, key, vector, block))


def file_vectors(chunks: DataFrame, file: str = "file_id", vector: str = "vector") -> DataFrame:
    """The normalised mean of each file's vectors. Means are built per position, combined before the shuffle."""
    per = chunks.select(file, F.posexplode(vector).alias("i", "x")).groupBy(file, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    own = per.groupBy(file).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return own.select(file, let(F.col("v"), lambda v: let(F.sqrt(dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))).alias(vector))


def two_level(chunks: DataFrame, query: list[float], files: int = 25, k: int = 50, key: str = "id", file: str = "file_id", vector: str = "vector") -> DataFrame:
    """The best chunks within the best files, blended 0.8 to 0.2: ``key, file, score``; where no file or no chunk of one is near, the best chunks anywhere."""
    top = top_k(file_vectors(chunks, file, vector), query, files, file, vector).withColumnRenamed("score", "file_score")
    scored = chunks.select(key, file, cosine(F.col(vector), _literal(query)).alias("s")).where("s > 0")
    inside = scored.join(F.broadcast(top), file).orderBy(F.desc("s"), key).limit(k)
    if inside.isEmpty():
        return scored.orderBy(F.desc("s"), key).limit(k).select(key, file, F.col("s").alias("score"))
    blended = inside.select(key, file, (0.8 * F.col("s") + 0.2 * F.col("file_score")).alias("score"))
    return blended.orderBy(F.desc("score"), key)


def stats(vectors: DataFrame, key: str = "id", file: str = "file_id") -> DataFrame:
    return vectors.agg(F.count("*").alias("vectors"), F.count_distinct(file).alias("files"), F.min(F.size("vector")).cast("bigint").alias("least_dimension"), F.max(F.size("vector")).cast("bigint").alias("most_dimension"))


def hashing_embedder(dimension: int = 64):
    """A deterministic embedder of words, as a pandas UDF: signed hashes of the words, normalised. Blank and null texts give zeros."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places: dict[str, tuple[int, float]] = {}
        for s in texts:
            out = []
            for t in s:
                v = np.zeros(dimension, dtype=np.float32)
                for w in (t or "").lower().split():
                    if w not in places:
                        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                        places[w] = (h % dimension, 1.0 if h >> 40 & 1 else -1.0)
                    i, sign = places[w]
                    v[i] += sign
                n = float(np.linalg.norm(v))
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return embed


# ------------------------------------------------------------------- chunk windows


def first_window(sizes: list[int], target: int, most: int) -> int:
    """How many units the first window takes: it grows to the target, never beyond ``most`` unless one unit alone is longer."""
    length = end = 0
    while end < len(sizes) and length < target and (end == 0 or length + 1 + sizes[end] <= most):
        length += sizes[end] + (end > 0)
        end += 1
    return end


def _windows(file, no: int, held: list[tuple], target: int, most: int, overlap: int, last: bool) -> tuple[int, list[tuple]]:
    """Cuts the windows that are complete off ``held``; all of them at a file's end. The next window starts ``overlap`` units back, one further at least."""
    rows: list[tuple] = []
    while held:
        n = first_window([s for _, s in held], target, most)
        if n == len(held) and not last:
            break  # it may grow, or it is the file's last
        no += 1
        rows += [(file, no, uid) for uid, _ in held[:n]]
        del held[: len(held) if n == len(held) else max(1, n - min(overlap, n - 1))]
    return no, rows


def chunks(units: DataFrame, target: int = 1600, most: int = 2400, overlap: int = 1) -> DataFrame:
    """``file_id, chunk_no, first_unit, last_unit, unit_ids, chunk_text, chunk_hash`` of units ``id, file_id, text``.

    Units are trimmed and blank ones left out; they follow each other by id. Only lengths go through Python, once a file; the texts are joined by
    built-in functions. Settings are held within their ranges.
    """
    target = min(max(target, 128), 65536)
    most = min(max(most, target), 98304)
    overlap = min(max(overlap, 0), 32)
    own = units.withColumn("text", F.trim("text")).where("text <> ''").select("file_id", "id", "text").dropDuplicates(["file_id", "id"])
    kind = units.schema["id"].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, no, held = None, 0, []
        for f in frames:
            rows: list[tuple] = []
            for fid, uid, n in zip(f["file_id"], f["id"], f["n"], strict=True):
                if fid != file:
                    rows += _windows(file, no, held, target, most, overlap, True)[1]
                    file, no, held = fid, 0, []
                held.append((uid, n))
                no, out = _windows(file, no, held, target, most, overlap, False)
                rows += out
            yield pd.DataFrame(rows, columns=["file_id", "chunk_no", "id"])
        rows = _windows(file, no, held, target, most, overlap, True)[1]
        if rows:
            yield pd.DataFrame(rows, columns=["file_id", "chunk_no", "id"])

    # a file's units stream through one task in order; what is held is one window
    file_kind = units.schema["file_id"].dataType.simpleString()
    ordered = own.select("file_id", "id", F.char_length("text").alias("n")).repartition("file_id").sortWithinPartitions("file_id", "id")
    at = ordered.mapInPandas(cut, f"file_id {file_kind}, chunk_no int, id {kind}")
    parts = F.array_sort(F.collect_list(F.struct("id", "text")))
    got = at.join(own, ["file_id", "id"]).groupBy("file_id", "chunk_no").agg(parts.alias("p"))
    text = F.array_join(F.transform("p", lambda s: s["text"]), "\n")
    got = got.select("file_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.transform("p", lambda s: s["id"]).alias("unit_ids"), text.alias("chunk_text"))
    return got.select("file_id", "chunk_no", F.get("unit_ids", F.lit(0)).alias("first_unit"), F.element_at("unit_ids", -1).alias("last_unit"), "unit_ids", "chunk_text", F.sha2("chunk_text", 256).alias("chunk_hash"))
