"""Queries over the change log and the snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.changefeed import ChangeLog
from ..operators.snapshot_diff import snapshot_changes
from ..session import scratch_path, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ChangeLog(spark, scratch_path(spark, "changelog")).append(table(spark, sf_dir, "wal_entries"), payload=False)
    return log.keys().select("collection", "vector_id", "entry_id")


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt table itself, with its payload."""
    log = ChangeLog(spark, scratch_path(spark, "changelog")).append(table(spark, sf_dir, "wal_entries"))
    r = log.rows()
    total = F.aggregate(F.col("data"), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return r.select("collection", "vector_id", F.size("data").cast("bigint").alias("dims"), F.round(total, 4).alias("total"), "metadata")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "snapshot_vectors")).select("snapshot_name", "id", "change")


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each snapshot adds, removes and changes."""
    c = snapshot_changes(table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "snapshot_vectors"))
    return c.groupBy("collection", "snapshot_name", "change").agg(F.count("*").alias("records"))


def _uuid(c: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower(trim({c})), '^urn:uuid:', ''), '[^0-9a-f]', '', 'g')"
    return f"""regexp_replace({bare}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"""


_WAL = f"""
WITH e AS (
  SELECT {_uuid("id")} AS entry_id, CASE WHEN "timestamp" >= 100000000000 THEN "timestamp" // 1000 ELSE "timestamp" END AS ts,
         regexp_replace(lower(operation), '[^a-z]', '', 'g') AS op, collection, {_uuid("vector_id")} AS vector_id, vectors
  FROM wal_entries WHERE "timestamp" IS NOT NULL AND id IS NOT NULL),
t AS (SELECT entry_id, min(ts) AS ts FROM e GROUP BY entry_id),
one AS (SELECT DISTINCT ON (entry_id) entry_id, op, collection, vector_id, vectors FROM e),
o AS (SELECT one.*, t.ts FROM one JOIN t USING (entry_id)),
x AS (SELECT entry_id, collection, ts, unnest(vectors) AS v, unnest(range(len(vectors))) AS ordinal FROM o WHERE op IN ('insertvector', 'batchinsert')),
i AS (SELECT entry_id, collection, ts, {_uuid("v.id")} AS vector_id, v, ordinal FROM x),
l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY collection, vector_id ORDER BY ts DESC, entry_id DESC, ordinal DESC) = 1),
live AS (
  SELECT * FROM l WHERE NOT EXISTS (
    SELECT 1 FROM o WHERE o.collection = l.collection AND (o.op = 'deletecollection' OR (o.op = 'deletevector' AND o.vector_id = l.vector_id))
      AND (o.ts > l.ts OR (o.ts = l.ts AND o.entry_id > l.entry_id))))
"""

_DIFF = f"""
WITH m AS (SELECT DISTINCT name, lower(trim(collection)) AS collection, created_at FROM snapshots),
s AS (SELECT name, collection, row_number() OVER w AS idx, lead(name) OVER w AS next_name FROM m WINDOW w AS (PARTITION BY collection ORDER BY created_at, name)),
j AS (SELECT DISTINCT metadata FROM snapshot_vectors WHERE metadata IS NOT NULL),
k AS (SELECT metadata, CASE WHEN json_valid(metadata) THEN 'j' || coalesce((SELECT string_agg(e.key || chr(1) || CASE WHEN e.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')
        THEN 'n' || CAST(CAST(e.atom AS VARCHAR) AS DOUBLE) ELSE e.type || chr(1) || coalesce(e.value ->> '$', '') END, chr(2) ORDER BY e.key) FROM json_each(metadata) AS e), '')
      ELSE 't' || metadata END AS text FROM j),
r AS (SELECT DISTINCT ON (v.snapshot_name, id) v.snapshot_name, {_uuid("v.id")} AS id, list_transform(v.data, lambda x: x + 0) AS data, k.text AS text FROM snapshot_vectors v LEFT JOIN k ON v.metadata = k.metadata),
f AS (SELECT r.*, s.collection, s.idx, s.next_name FROM r JOIN s ON r.snapshot_name = s.name),
p AS (SELECT s.name, s.collection, s.idx, s2.name AS later FROM s JOIN s AS s2 ON s.collection = s2.collection AND s2.idx = s.idx + 1),
d AS (
  SELECT p.later AS snapshot_name, b.id, 'added' AS change FROM p JOIN r b ON b.snapshot_name = p.later LEFT JOIN r a ON a.snapshot_name = p.name AND a.id = b.id WHERE a.id IS NULL
  UNION ALL SELECT p.later, a.id, 'removed' FROM p JOIN r a ON a.snapshot_name = p.name LEFT JOIN r b ON b.snapshot_name = p.later AND a.id = b.id WHERE b.id IS NULL
  UNION ALL SELECT p.later, a.id, 'changed' FROM p JOIN r a ON a.snapshot_name = p.name JOIN r b ON b.snapshot_name = p.later AND a.id = b.id
    WHERE a.data IS DISTINCT FROM b.data OR a.text IS DISTINCT FROM b.text)
"""

QUERIES = {"p1_found": p1_found, "p1_rows": p1_rows, "p4_found": p4_found, "p4_summary": p4_summary}
SQL = {
    "p1_found": _WAL + "SELECT collection, vector_id, entry_id FROM live",
    "p1_rows": _WAL + "SELECT collection, vector_id, CAST(len(v.data) AS BIGINT) AS dims, round(list_sum(list_transform(v.data, lambda x: x::DOUBLE)), 4) AS total, v.metadata AS metadata FROM live",
    "p4_found": _DIFF + "SELECT snapshot_name, id, change FROM d",
    "p4_summary": _DIFF + "SELECT s.collection, d.snapshot_name, d.change, count(*) AS records FROM d JOIN s ON s.name = d.snapshot_name GROUP BY ALL",
}
