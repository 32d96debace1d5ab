"""Queries p1 and p5 with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import changes, hierarchy
from siltstone.runtime import Scratch, read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.replay(read(spark, d, "pending_changes")).select("root_path", "path_key", "id")


def p1_watermark(spark: SparkSession, d: str) -> DataFrame:
    """How far an unsealed feed would be shown."""
    return changes.watermark(changes.transactions(read(spark, d, "pending_changes")))


def p1_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What holds the open feed up: runs of absent ids and incomplete transactions."""
    return changes.gaps(changes.transactions(read(spark, d, "pending_changes")))


def p1_visible(spark: SparkSession, d: str) -> DataFrame:
    """Files of the feed up to the contiguous watermark, gaps held."""
    return changes.replay(read(spark, d, "pending_changes"), sealed=False).select("root_path", "path_key", "id")


def p1_half_sealed(spark: SparkSession, d: str) -> DataFrame:
    """Files of a feed whose first half is sealed: its gaps are void, the first gap after it holds."""
    tx = Scratch(spark).keep(changes.transactions(read(spark, d, "pending_changes")))
    holes = changes.gaps(tx)
    half = tx.agg(F.floor((F.min("id") + F.max("id")) / 2).alias("half"))
    voids = holes.join(F.broadcast(half), F.col("hi") < F.col("half")).select("lo", "hi")
    return changes.apply_changes(tx, changes.watermark(tx, None, voids)).select("root_path", "path_key", "id")


def p1_roots(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes that each root holds after all changes."""
    return (
        changes.replay(read(spark, d, "pending_changes"))
        .groupBy("root_path")
        .agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max("id").alias("last_id"))
    )


def _tree(spark: SparkSession, d: str, *want: str, finish_rows: int = 50_000) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.current_items(read(spark, d, "file_identities")), finish_rows, want)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("volume_id", F.col("num").alias("file_reference_number"), F.col("root").alias("root_reference_number"), "depth")


def p5_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Paths, depths, roots and sizes by rounds alone: no part is finished in one task."""
    tree = _tree(spark, d, "path", finish_rows=0)
    return tree.select("volume_id", F.col("num").alias("file_reference_number"), F.col("root").alias("root_reference_number"), "path", "depth", F.col("subtree").alias("subtree_items"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path and subtree size of each item."""
    return _tree(spark, d, "path").select("volume_id", F.col("num").alias("file_reference_number"), "path", "depth", F.col("subtree").alias("subtree_items"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """One row for each item and each of its descendants."""
    return hierarchy.descendants(_tree(spark, d, "ancestors"))


QUERIES = {f.__name__: f for f in (p1_found, p1_watermark, p1_gaps, p1_visible, p1_half_sealed, p1_roots, p5_found, p5_paths, p5_descendants, p5_rounds)}

_TX = r"""
tx AS (
  SELECT id, max(delivery_no) AS delivery_no,
         count(DISTINCT delivery_no) = max(delivery_no) AND min(delivery_no) = 1 AS complete,
         arg_max(root_path, delivery_no) AS root_path, arg_max({'p': path}, delivery_no).p AS path,
         arg_max({'k': kind}, delivery_no).k AS kind, arg_max({'s': size_bytes}, delivery_no).s AS size_bytes
  FROM pending_changes GROUP BY id)"""
_KEYED = r"""
keyed AS (
  SELECT root_path, regexp_replace(replace(lower(path), '/', '\'), '^\\\\\?\\', '') AS path_key, id, kind, size_bytes
  FROM tx WHERE path IS NOT NULL AND kind IN (1, 2) {extra}),
state AS (
  SELECT root_path, path_key, max(id) AS id, arg_max(kind, id) AS kind, arg_max({{'s': size_bytes}}, id).s AS size_bytes
  FROM keyed GROUP BY root_path, path_key)"""
_MARK = r"""
mark AS (
  SELECT min(id) AS first_id, max(id) AS last_id, count(*) AS transactions,
         min(CASE WHEN NOT complete THEN id - 1 WHEN nxt > id + 1 THEN id END) AS stop
  FROM (SELECT id, complete, lead(id) OVER (ORDER BY id) AS nxt FROM tx))"""

_ITEMS = r"""
digits(x, n) AS MATERIALIZED (
  SELECT r, sum(CAST(('0x' || substr(r, CAST(2 * i + 1 AS INTEGER), 2)) AS HUGEINT) * (1::HUGEINT << CAST(8 * i AS INTEGER)))
  FROM (SELECT DISTINCT r FROM (SELECT trim(file_reference_number) AS r FROM file_identities UNION ALL
        SELECT trim(parent_file_reference_number) FROM file_identities) WHERE length(r) = 32), range(16) AS t(i) GROUP BY r),
items AS MATERIALIZED (
  SELECT volume_id, num, parent, item_name FROM (
    SELECT volume_id, COALESCE(CAST(a.n AS VARCHAR), regexp_replace(trim(file_reference_number), '^0+([0-9])', '\1')) AS num,
           COALESCE(CAST(b.n AS VARCHAR), regexp_replace(trim(parent_file_reference_number), '^0+([0-9])', '\1')) AS parent,
           item_name, last_observed_usn, observed_at
    FROM file_identities f LEFT JOIN digits a ON trim(f.file_reference_number) = a.x
         LEFT JOIN digits b ON trim(f.parent_file_reference_number) = b.x) s
  WHERE num IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY volume_id, num ORDER BY last_observed_usn DESC NULLS LAST, observed_at DESC) = 1),
linked AS MATERIALIZED (
  SELECT i.volume_id, i.num, i.item_name, CASE WHEN i.parent <> i.num THEN p.num END AS parent
  FROM items i LEFT JOIN items p ON p.volume_id = i.volume_id AND p.num = i.parent),
down AS (
  SELECT volume_id, num, num AS root, 0 AS depth, COALESCE(item_name, '') AS path FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT l.volume_id, l.num, d.root, d.depth + 1, d.path || '\' || COALESCE(l.item_name, '')
  FROM linked l JOIN down d ON l.volume_id = d.volume_id AND l.parent = d.num)"""
#: Items that no root reaches, each with all items above it; the loop is what is reached again.
_LOOPED = r"""
lost AS MATERIALIZED (SELECT l.* FROM linked l ANTI JOIN down d ON l.volume_id = d.volume_id AND l.num = d.num),
up AS (
  SELECT volume_id, num, parent AS above FROM lost
  UNION
  SELECT u.volume_id, u.num, l.parent FROM up u JOIN lost l ON u.volume_id = l.volume_id AND u.above = l.num),
onloop AS MATERIALIZED (SELECT volume_id, num FROM up WHERE num = above),
low AS MATERIALIZED (
  SELECT u.volume_id, u.num, CAST(min(CAST(u.above AS HUGEINT)) AS VARCHAR) AS root
  FROM up u JOIN onloop o ON u.volume_id = o.volume_id AND u.above = o.num GROUP BY ALL)"""

SQL = {
    "p1_found": f"WITH {_TX}, {_KEYED.format(extra='')} SELECT root_path, path_key, id FROM state WHERE kind = 1",
    "p1_watermark": f"""WITH {_TX}, {_MARK}
        SELECT first_id, last_id, transactions, last_id - first_id + 1 - transactions AS missing, COALESCE(stop, last_id) AS watermark FROM mark""",
    "p1_gaps": f"""WITH {_TX}
        SELECT lo, least(hi, lo - lo % 65536 + 65535) AS hi, 'absent' AS reason FROM (
          SELECT greatest(id + 1, b * 65536) AS lo, nxt - 1 AS hi FROM (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM tx), range(4096) AS t(b)
          WHERE nxt > id + 1 AND (b = (id + 1) // 65536 OR (b > (id + 1) // 65536 AND b <= (nxt - 1) // 65536)))
        UNION ALL SELECT id, id, 'incomplete' FROM tx WHERE NOT complete""",
    "p1_visible": f"""WITH {_TX}, {_MARK}, {_KEYED.format(extra='AND id <= (SELECT COALESCE(stop, last_id) FROM mark)')}
        SELECT root_path, path_key, id FROM state WHERE kind = 1""",
    "p1_half_sealed": f"""WITH {_TX},
        half AS (SELECT (min(id) + max(id)) // 2 AS half FROM tx),
        holes AS (SELECT id AS lo, id AS hi FROM tx WHERE NOT complete UNION ALL SELECT id + 1, nxt - 1 FROM (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM tx) WHERE nxt > id + 1),
        mark AS (SELECT COALESCE((SELECT min(lo) - 1 FROM holes, half WHERE hi >= half), (SELECT max(id) FROM tx)) AS stop),
        {_KEYED.format(extra='AND id <= (SELECT stop FROM mark)')}
        SELECT root_path, path_key, id FROM state WHERE kind = 1""",
    "p1_roots": f"""WITH {_TX}, {_KEYED.format(extra='')}
        SELECT root_path, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(id) AS last_id FROM state WHERE kind = 1 GROUP BY root_path""",
    "p5_found": f"""WITH RECURSIVE {_ITEMS}, {_LOOPED}
        SELECT volume_id, num AS file_reference_number, root AS root_reference_number, depth FROM down
        UNION ALL SELECT volume_id, num, root, -1 FROM low""",
    "p5_descendants": f"""WITH RECURSIVE {_ITEMS}, {_LOOPED},
        pairs AS (
          SELECT volume_id, parent AS ancestor, num AS descendant, 1 AS distance FROM linked WHERE parent IS NOT NULL
            AND (volume_id, num) NOT IN (SELECT (volume_id, num) FROM onloop)
          UNION ALL
          SELECT p.volume_id, l.parent, p.descendant, p.distance + 1 FROM pairs p JOIN linked l
            ON l.volume_id = p.volume_id AND l.num = p.ancestor WHERE l.parent IS NOT NULL
            AND (p.volume_id, p.ancestor) NOT IN (SELECT (volume_id, num) FROM onloop))
        SELECT volume_id, ancestor, descendant, distance FROM pairs""",
}
SQL["p5_paths"] = f"""WITH RECURSIVE {_ITEMS}, {_LOOPED},
        pairs AS (
          SELECT volume_id, parent AS ancestor, num AS descendant FROM linked WHERE parent IS NOT NULL
            AND (volume_id, num) NOT IN (SELECT (volume_id, num) FROM onloop)
          UNION ALL
          SELECT p.volume_id, l.parent, p.descendant FROM pairs p JOIN linked l ON l.volume_id = p.volume_id AND l.num = p.ancestor
          WHERE l.parent IS NOT NULL AND (p.volume_id, p.ancestor) NOT IN (SELECT (volume_id, num) FROM onloop)),
        sized AS (SELECT volume_id, ancestor AS num, count(*) AS n FROM pairs GROUP BY ALL)
        SELECT a.volume_id, a.num AS file_reference_number, path, depth, 1 + COALESCE(n, 0) AS subtree_items
        FROM (SELECT volume_id, num, path, depth FROM down UNION ALL SELECT volume_id, num, NULL, -1 FROM low) a
        LEFT JOIN sized s ON s.volume_id = a.volume_id AND s.num = a.num"""

SQL["p5_rounds"] = SQL["p5_paths"].replace("SELECT a.volume_id, a.num AS file_reference_number, path", "SELECT a.volume_id, a.num AS file_reference_number, a.root AS root_reference_number, path").replace(
    "SELECT volume_id, num, path, depth FROM down UNION ALL SELECT volume_id, num, NULL, -1 FROM low", "SELECT volume_id, num, root, path, depth FROM down UNION ALL SELECT volume_id, num, root, NULL, -1 FROM low"
)
