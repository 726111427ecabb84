import json

import pytest
from pyspark.sql import functions as F

from vectorloom.functions.canonical import canonical_json_text as cj
from vectorloom.functions.ids import plain_uuid
from vectorloom.operators import dml
from vectorloom.operators.changefeed import ChangeLog
from vectorloom.operators.snapshot_diff import snapshot_changes
from vectorloom.streaming.replay import current, fold_parts, limit_rate, stream_to_changelog, stream_upserts

U = [f"0000000{i}-0000-4000-8000-00000000000a" for i in range(10)]
LOG = "id string, timestamp bigint, checksum bigint, operation string, collection string, vector_id string, vectors array<struct<id:string,data:array<float>,metadata:string>>, received_at timestamp, ts string, seq int"


def entry(e, ts, op, c="c", vid=None, vs=None):
    return (e, ts, None, op, c, vid, vs, None, "other", 1)


def brute(rows):
    """One entry after the other."""
    norm = lambda i: None if i is None else i.lower().strip("{}").replace("urn:uuid:", "")
    first = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and r[4] is not None:
            t = r[1] // 1000 if r[1] >= 10**11 else r[1]
            k = norm(r[0])
            if k not in first or t < first[k][0]:
                first[k] = (t, r)
    live = {}
    for k, (_t, r) in sorted(first.items(), key=lambda x: (x[1][0], x[0])):
        op = "".join(c for c in r[3].lower() if c.isalpha())
        if op in ("insertvector", "batchinsert"):
            for v in r[6] or []:
                live[r[4], norm(v[0])] = k
        elif op == "deletevector":
            live.pop((r[4], norm(r[5])), None)
        elif op == "deletecollection":
            live = {x: y for x, y in live.items() if x[0] != r[4]}
    return {(*k, e) for k, e in live.items()}


def feed():
    import random

    rng, rows = random.Random(3), []
    for i in range(400):
        e, t = f"{rng.randrange(1, 150):08x}-0000-4000-8000-000000000001", rng.randrange(1000, 1040)
        rng2 = random.Random(e)  # an entry has one content
        op = rng2.choice(["InsertVector", "BATCH_INSERT", "deleteVector", "Delete_Collection", "CreateCollection", " insert-vector"])
        c, vid = rng2.choice("cd"), rng2.choice(U)
        vs = [(rng2.choice(U), [1.0], None) for _ in range(rng2.choice([0, 1, 3]))] if "nsert" in op or "INSERT" in op else None
        e = rng.choice([e, e.upper(), "{" + e + "}", "urn:uuid:" + e])
        rows.append(entry(e, rng.choice([t, t * 1000 + 7 + 10**12, None]), op, c, vid if "elete" in op else None, vs))
    rows += [entry(None, 1, "InsertVector", "c", None, [(U[0], None, None)]), entry(U[0], 5, None), entry(U[1], 5, "odd"), entry(U[2], 5, "InsertVector", None), entry(U[3], 5, "InsertVector", "c", None, [(None, None, None)])]
    return rows


def test_change_log_against_brute_force(spark, tmp_path):
    rows = feed()
    df = spark.createDataFrame(rows, LOG)
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    for part in df.randomSplit([1.0, 1.0, 1.0], 5):  # in several batches, in any order
        log.append(part)
    want = brute([r for r in rows if r[3] is not None and r[0] is not None and r[3] != "odd" and not (r[6] and r[6][0][0] is None)])
    got = {(r.collection, r.vector_id, r.entry_id) for r in log.keys().collect()}
    assert got == want and log.keys().count() == len(want)
    assert {(r.collection, r.vector_id, r.entry_id) for r in log.rows().collect()} == want
    log.append(df)  # once more: nothing changes
    assert {(r.collection, r.vector_id, r.entry_id) for r in log.keys().collect()} == want
    assert {(r.collection, r.vector_id, r.entry_id) for r in log.compact(f"file://{tmp_path}/new").keys().collect()} == want


def test_change_log_ties_and_empty(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/a").append(spark.createDataFrame([], LOG))
    assert log.keys().count() == 0 and log.rows().count() == 0
    rows = [entry(U[1], 5, "InsertVector", "c", None, [(U[9], [1.0], "x"), (U[9], [2.0], "y")]), entry(U[2], 5, "DeleteVector", "c", U[9]), entry(U[3], 5, "InsertVector", "c", None, [(U[8].upper(), [1.0], None)]), entry(U[0], 5, "DeleteCollection")]
    log = ChangeLog(spark, f"file://{tmp_path}/b").append(spark.createDataFrame(rows, LOG))
    assert [tuple(r) for r in log.keys().select("vector_id", "entry_id").collect()] == [(U[8], U[3])]
    log.append(spark.createDataFrame([entry(U[4], 6, "InsertVector", "c", None, [(U[9], [1.0], "x"), (U[9], [2.0], "y")])], LOG))
    assert {r.vector_id: r.metadata for r in log.rows().collect()} == {U[8]: None, U[9]: "y"}


def test_streamed_change_log(spark, tmp_path):
    df = spark.createDataFrame(feed(), LOG)
    df.repartition(3).write.parquet(f"file://{tmp_path}/feed")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/feed")
    stream_to_changelog(src, f"file://{tmp_path}/log", f"file://{tmp_path}/cp").awaitTermination()
    whole = ChangeLog(spark, f"file://{tmp_path}/whole").append(df)
    assert {tuple(r) for r in ChangeLog(spark, f"file://{tmp_path}/log").keys().collect()} == {tuple(r) for r in whole.keys().collect()}


def test_streamed_upserts_keep_tombstones(spark, tmp_path):
    d = f"file://{tmp_path}"
    kind = "id int, seq int, deleted boolean, value string"
    for rows in ([(1, 5, True, None), (2, 1, False, "a")], [(1, 3, False, "late"), (2, 2, False, "b"), (2, 2, False, "b")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(d + "/feed")
        src = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(d + "/feed")
        stream_upserts(src, d + "/out", d + "/cp", "id", "seq", "deleted").awaitTermination()
    now = lambda: [tuple(r) for r in current(spark, d + "/out", "id", "seq", "deleted").where("NOT deleted").collect()]
    assert now() == [(2, 2, False, "b")] and current(spark, d + "/none", "id", "seq", "deleted") is None
    parts = lambda: sorted(x.name for x in tmp_path.joinpath("out").iterdir())
    fold_parts(spark, d + "/out", "id", "seq", "deleted", 0)
    assert now() == [(2, 2, False, "b")] and "v=0" in parts()
    fold_parts(spark, d + "/out", "id", "seq", "deleted", 1)
    fold_parts(spark, d + "/out", "id", "seq", "deleted", 1)
    assert now() == [(2, 2, False, "b")] and {"v=0", "v=1"} <= set(parts()) and "b=0" not in parts()
    # a fold that broke off doesn't count
    tmp_path.joinpath("out/v=9").mkdir()
    assert now() == [(2, 2, False, "b")]


def test_rate_limit(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:00:20", "2024-01-01 00:01:05", "2024-01-01 00:01:08"]
    df = spark.createDataFrame([("u", t) for t in times], "u string, t string").select("u", F.to_timestamp("t").alias("t"))
    assert [r.allowed for r in limit_rate(df, "u", "t", 2).orderBy("t").collect()] == [True, True, False, True, False]
    # a null user is one of its own, a request without a time is refused, other columns don't matter
    odd = df.union(df.selectExpr("CAST(NULL AS STRING)", "t")).union(df.limit(1).selectExpr("u", "CAST(NULL AS TIMESTAMP)")).withColumn("allowed", F.lit("x"))
    got = limit_rate(odd, "u", "t", 2).collect()
    assert sorted(str(r.t) for r in got if r.u is None and r.allowed) == [times[0], times[1], times[3]] and [r.allowed for r in got if r.t is None] == [False] and len(got) == 11
    assert limit_rate(df.limit(0), "u", "t", 2).count() == 0


def test_rate_limit_in_small_batches(spark):
    """A user's requests come to the limiter in many batches: the last minute is carried on."""
    df = spark.range(500).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("u"), F.timestamp_seconds(F.col("id") * 7).alias("t"))
    def brute(times):
        kept = []
        for t in times:
            kept += [t] if sum(t - x < 60 for x in kept) < 2 else []
        return kept
    want = brute([7 * i for i in range(500) if i % 3])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = sorted(r.s for r in limit_rate(df, "u", "t", 2).where("u = 'hot' AND allowed").select(F.unix_seconds("t").alias("s")).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def test_concurrent_requests(spark):
    rows = [("u", 0, 100), ("u", 10, 20), ("u", 15, 90), ("u", 20, 30), ("u", 95, 99), ("u", 100, None), ("u", 100, 110)]
    df = spark.createDataFrame(rows, "u string, a int, b int").select("u", F.timestamp_seconds("a").alias("t"), F.timestamp_seconds("b").alias("e"))
    got = limit_rate(df, "u", "t", 1000, "e", 2).select(F.unix_seconds("t").alias("s"), "allowed").collect()
    assert [r.allowed for r in sorted(got, key=lambda r: r.s)] == [True, True, False, True, True, True, True]


def test_shards_and_ring(spark):
    ids = spark.range(3000)
    n = ["a", "b", "c", "d"]
    got = ids.select("id", dml.ring_nodes(F.col("id"), n, 2).alias("with_d"), dml.ring_nodes(F.col("id"), n[:3], 2).alias("without"), dml.shard(F.col("id"), 8).alias("s"), dml.replicas(dml.shard(F.col("id"), 8), 9, 3).alias("r")).collect()
    assert all(len(set(r.with_d)) == 2 == len(set(r.without)) and sorted(r.r) == [0, 1, 2] and 0 <= r.s < 8 for r in got)
    # only what the missing node held moves
    assert all(r.with_d == r.without for r in got if "d" not in r.with_d) and min(sum(r.with_d[0] == x for r in got) for x in n) > 300


SNAP = "snapshot_name string, id string, data array<float>, metadata string, hash int, collection string"


def test_snapshots(spark):
    man = [("s2", " Docs", 20), ("s1", "docs", 10), ("s1", "docs", 10), ("s3", "DOCS ", 30), ("s4", "docs", 40), ("s5", "docs", 50), ("t1", "alone", 5), ("x", None, 5)]
    manifest = spark.createDataFrame([(n, c, t, 1, "k") for n, c, t in man], "name string, collection string, created_at bigint, idx int, change string")
    r = lambda s, i, d, m: (s, i, d, m, 1, "z")
    rows = [
        r("s1", U[0], [1.0, -0.0], '{"a": 1.50, "b": "é"}'), r("s1", U[1], None, None), r("s1", U[2], [1.0], None), r("s1", U[4], [1.0], "{cut"),
        r("s2", U[0].upper(), [1.0, 0.0], ' {"b":"\\u00e9","a":15e-1}'), r("s2", "{" + U[0] + "}", [1.0, 0.0], '{"a": 1.5, "b": "é"}'), r("s2", U[1], None, None), r("s2", U[2], [1.0], "null"), r("s2", U[3], [2.0], None), r("s2", U[4], [1.0], "{cut "),
        r("s3", U[0], [1.0, 0.0], '{"a": 1.5, "b": "é", "c": null}'), r("s3", U[1], [0.0], None), r("s3", None, None, None),
        r("s4", U[0], [1.0, 0.0], '{"a": 1.5, "b": "é", "c": null}'), r("s4", U[2], [1.0], "null"),
        r("t1", U[0], None, None), r("unknown", U[0], None, None),
    ]
    got = {(x.snapshot_name, x.id, x.change) for x in snapshot_changes(manifest, spark.createDataFrame(rows, SNAP)).collect()}
    assert got == {
        ("s2", U[2], "changed"), ("s2", U[3], "added"), ("s2", U[4], "changed"),
        ("s3", U[0], "changed"), ("s3", U[1], "changed"), ("s3", U[2], "removed"), ("s3", U[3], "removed"), ("s3", U[4], "removed"),
        ("s4", U[1], "removed"), ("s4", U[2], "added"), ("s5", U[0], "removed"), ("s5", U[2], "removed"),
    }
    assert snapshot_changes(manifest, spark.createDataFrame([], SNAP)).count() == 0
    assert snapshot_changes(manifest.limit(0), spark.createDataFrame(rows, SNAP)).count() == 0


def test_canonical_json():
    assert cj('{"b": 1.0, "a": [1e2, true]}') == cj(' {"a":[100,true],"b":1}') and cj('{"a": null}') != cj("{}")
    assert cj("1") != cj('"1"') and cj("true") != cj("1") and cj(None) is None and cj("") != cj('""') and cj("0.1") == cj("1e-1") and cj("-0") == cj("0.0")
    assert cj("1e99999") == cj("10e99998") and cj("NaN") == "tNaN" and cj("[" * 100_000).startswith("t")
    assert cj('{"a": 1, "a": 2}') == cj('{"a": 2}')


def test_ids(spark):
    rows = [U[5], U[5].upper(), U[5].replace("-", ""), "{" + U[5] + "}", "urn:uuid:" + U[5], " " + U[5] + " ", "plain 7", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(plain_uuid(F.col("x"))).collect()]
    assert got == [U[5]] * 6 + ["plain 7", "", None]


def test_dml(spark):
    base = spark.createDataFrame([(i, "old") for i in range(5)], "id int, v string")
    new = spark.createDataFrame([(i, "new") for i in range(10)] + [(9, "new")], "id int, v string")
    up = dml.upsert(base, new)
    assert up.count() == 10 and up.where("v = 'new'").count() == 10
    stay, gone = dml.delete(up, spark.createDataFrame([(1,), (2,), (3,), (3,), (77,)], "id int"))
    assert (stay.count(), gone.count()) == (7, 3)
    assert dml.checksum(base).first() == dml.checksum(base.repartition(3)).first() != dml.checksum(up).first()
    assert dml.checksum(base.limit(0)).first()["rows"] == 0
    v = spark.createDataFrame([(1, [1.0]), (2, None), (3, [1.0, 2.0]), (None, [1.0])], "id int, data array<double>")
    assert [r.verdict for r in dml.validate(v, 1).collect()] == ["ok", "null_data", "wrong_dimension", "null_id"]
    with pytest.raises(Exception, match="expected 1 dimensions"):
        dml.check_dimension(v, 1).collect()
    assert tuple(dml.consistency(v.limit(0), 1).first()) == (0, 0, 0, 0)
    assert json.loads(json.dumps(tuple(dml.consistency(v, 1).first()))) == [4, 1, 1, 0]
