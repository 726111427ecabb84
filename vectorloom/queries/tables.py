"""Changes of tables, catalogs, snapshots, logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import InvalidDimension
from ..functions import sql as sqlf
from ..operators import dml
from ..session import scratch_path, table
from ..sources import logs
from ..sources.store import CollectionConfig, Store
from ..streaming.replay import current, limit_rate, stream_upserts
from .common import embeddings, r_sql, rounded, with_payload

QUERIES, SQL = {}, {}


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _base(spark, sf):
    return embeddings(spark, sf).select(F.col("vec_id").alias("id"), "embedding", "label")


def _new(spark, sf):
    """Every third row again with another label, and as many new ids."""
    b = _base(spark, sf).where("id % 3 = 0").withColumn("label", F.col("label") + 100)
    return b.unionByName(b.withColumn("id", F.col("id") + 1_000_000))


_NEW = "n AS (SELECT vec_id AS id, label + 100 AS label FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, label + 100 FROM embeddings WHERE vec_id % 3 = 0)"


def _upserted(spark, sf):
    """A store with one collection of all embeddings, the label as payload, and new rows for it."""
    st = Store(spark, scratch_path(spark, "store"))
    st.create_collection(CollectionConfig("all", 64))
    shape = lambda df: df.select(F.col("id").cast("string").alias("id"), F.col("embedding").alias("data"), F.col("label").cast("string").alias("metadata"))
    st.insert("all", shape(_base(spark, sf)))
    return st, shape(_new(spark, sf))


def _bad(spark, sf):
    d = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    return _base(spark, sf).withColumn("embedding", d)


@add("insert_validate", "SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'null_data' WHEN vec_id % 11 = 0 THEN 'wrong_dimension' ELSE 'ok' END AS verdict, (SELECT count(*) FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0) AS stored FROM embeddings")
def insert_validate(spark, sf):
    """The verdicts; the store refuses the whole batch, and takes the good rows."""
    st = Store(spark, scratch_path(spark, "store"))
    st.create_collection(CollectionConfig("some", 64))
    rows = _bad(spark, sf).select(F.col("id").cast("string").alias("id"), F.col("embedding").alias("data"))
    try:
        st.insert("some", rows)
    except InvalidDimension:
        st.insert("some", rows.where(F.size("data") == 64))
    return dml.validate(_bad(spark, sf), 64, "id", "embedding").withColumn("stored", F.lit(st.read("some").count()))


@add("batch_insert", "SELECT label::BIGINT AS label, 2 * count(*) AS rows FROM embeddings GROUP BY 1")
def batch_insert(spark, sf):
    """Two batches inserted into a collection, and counted as they are read back."""
    st, _ = _upserted(spark, sf)
    b = _base(spark, sf)
    st.insert("all", b.select((F.col("id") + 1_000_000).cast("string").alias("id"), F.col("embedding").alias("data"), F.col("label").cast("string").alias("metadata")))
    return st.read("all").groupBy(F.col("metadata").cast("bigint").alias("label")).agg(F.count("data").alias("rows"))


@add("batch_upsert", f"WITH {_NEW} SELECT id, label FROM n UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM n)")
def batch_upsert(spark, sf):
    st, new = _upserted(spark, sf)
    st.upsert("all", new)
    return st.read("all").select(F.col("id").cast("bigint").alias("id"), F.col("metadata").cast("int").alias("label"))


@add("batch_delete", "SELECT 'stay' AS side, vec_id AS id FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT 'gone', vec_id FROM embeddings WHERE vec_id % 5 = 0")
def batch_delete(spark, sf):
    st, _ = _upserted(spark, sf)
    before = st.read("all").select("id")
    b = _base(spark, sf).where("id % 5 = 0")
    n = st.delete("all", b.select("id").unionByName(b.select((F.col("id") + 1_000_000).alias("id"))))
    stay = st.read("all").select("id")
    gone = before.join(stay, "id", "left_anti")
    if n != gone.count():
        raise AssertionError("the number of deleted rows")
    side = lambda df, name: df.select(F.lit(name).alias("side"), F.col("id").cast("bigint").alias("id"))
    return side(stay, "stay").unionByName(side(gone, "gone"))


@add("point_get", "SELECT vec_id AS id, label + 100 AS label FROM embeddings WHERE vec_id = 3")
def point_get(spark, sf):
    """One id, after it was replaced."""
    st, new = _upserted(spark, sf)
    st.upsert("all", new)
    return st.get("all", "3").select(F.col("id").cast("bigint").alias("id"), F.col("metadata").cast("int").alias("label"))


@add("index_search", "SELECT vec_id AS id, label + 100 AS label FROM embeddings WHERE vec_id = 3 UNION ALL SELECT vec_id + 1000000, label + 100 FROM embeddings WHERE vec_id = 3")
def index_search(spark, sf):
    """The two nearest of a vector by the collection's own index and what was written since: the replaced row and its new copy, and not the old one."""
    st, new = _upserted(spark, sf)
    st.build_index("all")
    st.upsert("all", new)
    q = list(_base(spark, sf).where("id = 3").first()["embedding"])
    return st.search_index("all", q, 2).select(F.col("id").cast("bigint").alias("id"), F.col("metadata").cast("int").alias("label"))


@add("version_updates", "SELECT vec_id AS id, 2::BIGINT AS version FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, CASE WHEN vec_id % 3 = 1 THEN 1 ELSE 0 END FROM embeddings WHERE vec_id % 3 <> 0")
def version_updates(spark, sf):
    """Batches that send ids again with a higher version, out of order and repeated: the latest by (version, sequence) wins."""
    b = _base(spark, sf).select("id")
    sent = [b.where("id % 3 <= 1").withColumn("version", F.lit(1)), b.where("id % 3 = 0").withColumn("version", F.lit(2)), b.withColumn("version", F.lit(0)), b.where("id % 3 = 0").withColumn("version", F.lit(1))]
    rows = None
    for i, part in enumerate(sent):
        part = part.withColumn("seq", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return dml.latest(rows, ["id"], F.col("version"), F.col("seq")).select("id", F.col("version").cast("bigint").alias("version"))


@add("consistency_check", "WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN 10 ELSE 64 END AS n FROM embeddings UNION ALL SELECT vec_id, 64 FROM embeddings WHERE vec_id % 13 = 0) SELECT count(*) AS row_count, count(*) FILTER (n IS NULL) AS null_data, count(*) FILTER (n <> 64) AS wrong_dimension, count(*) - count(DISTINCT id) AS duplicate_ids FROM v")
def consistency_check(spark, sf):
    d = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
    b = _base(spark, sf)
    return dml.consistency(b.withColumn("embedding", d).unionByName(b.where("id % 13 = 0")), 64, "id", "embedding")


def _store(spark, sf):
    """A store with a collection of each parity of the ids."""
    st = Store(spark, scratch_path(spark, "store"))
    e = embeddings(spark, sf).select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("data"), F.col("vec_id"))
    for i, name in enumerate(("even", "odd")):
        st.create_collection(CollectionConfig(name, 64, ("cosine", "euclidean")[i]))
        st.insert(name, e.where(F.col("vec_id") % 2 == i))
    return st


@add("collection_stats", "SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS name, count(*) AS vector_count, 64::INT AS dimension, CASE WHEN vec_id % 2 = 0 THEN 'cosine' ELSE 'euclidean' END AS distance_metric FROM embeddings GROUP BY ALL")
def collection_stats(spark, sf):
    return _store(spark, sf).stats().drop("disk_bytes")


@add("server_stats", "SELECT count(*) AS total_vectors, 2::BIGINT AS total_collections FROM embeddings")
def server_stats(spark, sf):
    return _store(spark, sf).server_stats().drop("disk_usage")


@add("snapshot_checksum", "SELECT count(*) AS rows, true AS same_in_any_order, true AS tells_a_change FROM embeddings")
def snapshot_checksum(spark, sf):
    """The checksum of a table, of its rows in another order and partitioning, and of the table with one row changed."""
    e = embeddings(spark, sf)
    one = lambda df, name: dml.checksum(df).withColumnRenamed("checksum", name)
    changed = e.withColumn("label", F.when(F.col("vec_id") == 0, F.col("label") + 1).otherwise(F.col("label")))
    sums = one(e, "a").join(one(e.repartition(7).orderBy(F.desc("label")), "b"), "rows").join(one(changed, "c"), "rows")
    return sums.select("rows", (F.col("a") == F.col("b")).alias("same_in_any_order"), (F.col("a") != F.col("c")).alias("tells_a_change"))


@add("snapshot_restore", "SELECT vec_id::VARCHAR AS id FROM embeddings WHERE vec_id % 2 = 0")
def snapshot_restore(spark, sf):
    """A snapshot, a loss, and the snapshot restored under another name after its checksum."""
    st = _store(spark, sf)
    snap = st.create_snapshot("even")["name"]
    st.delete("even", st.read("even").select("id"))
    return st.read(st.restore_snapshot(snap, "again")).select("id")


@add("snapshot_retention", "SELECT name, lower(trim(collection)) AS collection, created_at FROM (SELECT DISTINCT name, collection, created_at FROM snapshots) QUALIFY row_number() OVER (PARTITION BY lower(trim(collection)) ORDER BY created_at DESC, name) <= 2")
def snapshot_retention(spark, sf):
    s = table(spark, sf, "snapshots").select("name", F.lower(F.trim("collection")).alias("collection"), "created_at").distinct()
    return dml.newest(s, ["collection"], "created_at", 2, "name")


@add("retention_cleanup", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def retention_cleanup(spark, sf):
    e = table(spark, sf, "events")
    return dml.retention(e, "ts", F.lit(e.agg(F.max("ts")).first()[0]), 24).select("event_id")


_OPS = "SELECT user_id AS id, event_id AS seq, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'"


@add("oplog_replay", _OPS)
def oplog_replay(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "value")
    return dml.replay(log, "id", "seq", F.col("event_type") == "error").select("id", "seq", "value")


@add("oplog_corrupt_skip", "SELECT user_id AS id, count(*) AS records, sum(event_id)::BIGINT AS seqs FROM events WHERE event_id % 10 <> 3 GROUP BY 1")
def oplog_corrupt_skip(spark, sf):
    """A tenth of the sealed records is damaged, and skipped."""
    log = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "value")
    hurt = logs.sealed(log).withColumn("payload", F.when(F.get_json_object("payload", "$.seq").cast("bigint") % 10 == 3, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
    path = scratch_path(spark, "oplog")
    hurt.write.json(path)
    return logs.read_log(spark, path, "id bigint, seq bigint, value double").groupBy("id").agg(F.count("*").alias("records"), F.sum("seq").alias("seqs"))


@add("read_jsonl", "SELECT vec_id::VARCHAR AS id, len(embedding)::BIGINT AS dims FROM embeddings WHERE vec_id % 9 <> 4")
def read_jsonl(spark, sf):
    """Vectors in JSON lines, some of them cut off."""
    e = embeddings(spark, sf).select("vec_id", F.to_json(F.struct(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("data"))).alias("value"))
    path = scratch_path(spark, "lines")
    e.select(F.when(F.col("vec_id") % 9 == 4, F.expr("substring(value, 1, length(value) - 7)")).otherwise(F.col("value")).alias("value")).write.text(path)
    return logs.read_vectors(spark, path).select("id", F.size("data").cast("bigint").alias("dims"))


@add("stream_replay", _OPS)
def stream_replay(spark, sf):
    """The same state by Structured Streaming: several micro-batches, each folded into the keyed table."""
    src, out = scratch_path(spark, "feed"), scratch_path(spark, "state")
    log = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"), "value")
    log.repartition(4).write.parquet(src)
    feed = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(src)
    stream_upserts(feed, out, scratch_path(spark, "offsets"), "id", "seq", "deleted").awaitTermination()
    return current(spark, out, "id", "seq", "deleted").where("NOT deleted").select("id", "seq", "value")


@add("rate_limit_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS requests FROM events")
def rate_limit_window(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("s").rangeBetween(-3599, 0)
    e = table(spark, sf, "events").withColumn("s", F.floor(F.col("ts").cast("timestamp").cast("double")).cast("bigint"))
    return e.select("event_id", F.count("*").over(w).alias("requests"))


_ALLOWED = """WITH RECURSIVE a(user_id, ts) AS (
  SELECT user_id, min(ts) FROM events GROUP BY 1
  UNION ALL SELECT n.user_id, n.ts FROM (SELECT a.user_id, min(e.ts) AS ts FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 60 SECOND GROUP BY a.user_id) n),
t AS (SELECT user_id, count(*) AS requests FROM events GROUP BY 1), s AS (SELECT user_id, count(*) AS allowed FROM a GROUP BY 1)
SELECT user_id, true AS allowed, allowed AS requests FROM s UNION ALL SELECT t.user_id, false, requests - allowed FROM t JOIN s USING (user_id) WHERE requests > allowed"""


@add("rate_limit_decisions", _ALLOWED)
def rate_limit_decisions(spark, sf):
    """Which requests a limiter of one a minute allows; refused ones don't count."""
    d = limit_rate(table(spark, sf, "events"), "user_id", "ts", 1)
    return d.groupBy("user_id", "allowed").agg(F.count("*").alias("requests"))


_RUNNING = """WITH RECURSIVE n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
a(user_id, i, busy, ok) AS (
  SELECT user_id, i, ts + INTERVAL 2 HOUR, true FROM n WHERE i = 1
  UNION ALL SELECT n.user_id, n.i, CASE WHEN n.ts >= a.busy THEN n.ts + INTERVAL 2 HOUR ELSE a.busy END, n.ts >= a.busy FROM a JOIN n ON n.user_id = a.user_id AND n.i = a.i + 1)
SELECT user_id, ok AS allowed, count(*) AS requests FROM a GROUP BY 1, 2"""


@add("rate_limit_concurrent", _RUNNING)
def rate_limit_concurrent(spark, sf):
    """Requests of two hours each, of which a user may have one running."""
    e = table(spark, sf, "events").select("user_id", "ts", (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("till"))
    d = limit_rate(e, "user_id", "ts", 1_000_000, "till", 1)
    return d.groupBy("user_id", "allowed").agg(F.count("*").alias("requests"))


@add("latency_percentiles", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{int(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + " FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(*(F.round(F.percentile("value", p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)))


@add("threshold_bucket", "SELECT event_id, CASE WHEN value < 8 THEN 'healthy' WHEN value < 12 THEN 'degraded' ELSE 'unhealthy' END AS state FROM events")
def threshold_bucket(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.when(v < 8, "healthy").when(v < 12, "degraded").otherwise("unhealthy").alias("state"))


_SHARD = "(('0x' || md5(vec_id::VARCHAR)[1:8])::BIGINT % 16)::INT"


@add("latency_percentiles_approx", "SELECT event_type, true AS near FROM events GROUP BY 1")
def latency_percentiles_approx(spark, sf):
    """A sketch instead of all values of a group: each percentile's rank is within a thousandth (accuracy 10,000 gives a ten-thousandth) of the exact one."""
    e, ps = table(spark, sf, "events"), (0.5, 0.9, 0.95, 0.99)
    q = e.groupBy("event_type").agg(F.percentile_approx("value", list(ps), 10_000).alias("q"), F.count("value").alias("n"))
    below = e.join(F.broadcast(q), "event_type").groupBy("event_type", "n").agg(*(F.sum((F.col("value") <= F.col("q")[i]).cast("bigint")).alias(f"b{i}") for i in range(4)))  # a row an event type
    near = [F.abs(F.col(f"b{i}") / F.col("n") - p) <= 0.001 + 1 / F.col("n") for i, p in enumerate(ps)]
    return below.select("event_type", (near[0] & near[1] & near[2] & near[3]).alias("near"))


@add("shard_assign", f"SELECT vec_id, {_SHARD} AS shard FROM embeddings")
def shard_assign(spark, sf):
    return embeddings(spark, sf).select("vec_id", dml.shard(F.col("vec_id"), 16).alias("shard"))


@add("shard_replicas", f"SELECT vec_id, unnest([0, 1, 2]) AS replica, ({_SHARD} + unnest([0, 1, 2])) % 5 AS node FROM embeddings")
def shard_replicas(spark, sf):
    """The three of five nodes that hold each id's shard."""
    s = embeddings(spark, sf).select("vec_id", F.posexplode(dml.replicas(dml.shard(F.col("vec_id"), 16), 3, 5)).alias("replica", "node"))
    return s.select("vec_id", "replica", "node")


_POINTS = ", ".join(f"('{n}', {i})" for n in ("n0", "n1", "n2") for i in range(64))


@add("ring_assign", f"""WITH p AS (SELECT n AS node, ('0x' || md5(n || '#' || i)[1:8])::BIGINT AS spot FROM (VALUES {_POINTS}) v(n, i)),
h AS (SELECT vec_id, ('0x' || md5(vec_id::VARCHAR)[1:8])::BIGINT AS h FROM embeddings),
j AS (SELECT vec_id, node, min(CASE WHEN spot >= h THEN spot - h ELSE spot - h + 4294967296 END) AS away FROM h, p GROUP BY ALL)
SELECT vec_id, node, row_number() OVER (PARTITION BY vec_id ORDER BY away, node) - 1 AS place FROM j QUALIFY place < 2""")
def ring_assign(spark, sf):
    """The two nodes of each id on a consistent-hash ring of three."""
    s = embeddings(spark, sf).select("vec_id", F.posexplode(dml.ring_nodes(F.col("vec_id"), ["n0", "n1", "n2"], 2)).alias("place", "node"))
    return s.select("vec_id", F.col("place").cast("bigint").alias("place"), "node")


@add("sql_functions", f"SELECT vec_id, {r_sql('list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])')} AS dot, {r_sql('sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))')} AS magnitude, {r_sql('embedding[1]::DOUBLE * embedding[1]::DOUBLE')} AS sparse FROM embeddings WHERE vec_id % 17 <> 0 AND vec_id % 2 = 0")
def sql_functions(spark, sf):
    """The registered SQL functions, and a payload filter, in SQL text."""
    sqlf.register(spark)
    sqlf.filtered_view(with_payload(spark, sf), {"must": [{"match": {"key": "active", "value": True}}]}, "vectorloom_embeddings")
    r = spark.sql("""SELECT vec_id, vec_dot(d, d) AS dot, vec_magnitude(d) AS magnitude, sparse_dot(named_struct('indices', array(0, 3), 'values', array(d[0], 1D)), named_struct('indices', array(0, 4), 'values', array(d[0], 1D))) AS sparse
      FROM (SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS d FROM vectorloom_embeddings)""")
    return r.select("vec_id", *(rounded(F.col(c)).alias(c) for c in ("dot", "magnitude", "sparse")))
