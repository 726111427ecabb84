import pytest

from vectorloom.client import Client
from vectorloom.errors import CollectionAlreadyExists, CollectionNotFound, ConfigurationError, Corruption, InvalidDimension, InvalidInput, NotFound
from vectorloom.sources import logs
from vectorloom.sources.store import CollectionConfig


@pytest.fixture
def client(spark, tmp_path):
    c = Client(spark, f"file://{tmp_path}/store")
    c.create_collection("docs", 2, "euclidean")
    return c


def rows(*ids):
    return [{"id": i, "data": [float(n), 1.0], "metadata": {"n": n}} for n, i in enumerate(ids)]


def test_life_of_vectors(client):
    assert client.insert_vectors("docs", rows("a", "b", "c", "d", "e")) == 5
    assert client.insert_vectors("docs", rows("d", "e", "f")) == 3  # two of them again
    assert client.count("docs") == 6 and client.count("docs", {"n": 0}) == 2
    assert client.get_vector("docs", "d")["data"] == [0.0, 1.0]
    assert client.delete_vectors("docs", ["a", "b", "zz"]) == 2 and client.count("docs") == 4 and not client.delete_vector("docs", "a")
    assert [r.id for r in client.search("docs", [0.0, 1.0], 2).collect()] == ["d", "e"]
    client.update_vector("docs", "d", [9.0, 1.0])
    assert client.get_vector("docs", "d")["data"] == [9.0, 1.0]
    client.store.compact("docs", 1)
    assert client.count("docs") == 4 and len([x for x in client.store.files.children(f"{client.store.root}/docs") if x.startswith("gen-")]) == 1
    assert client.get_collection_stats("docs")["vector_count"] == 4 and client.get_server_stats()["total_vectors"] == 4
    assert tuple(client.store.check("docs").first()) == (4, 0, 0, 0)
    assert client.ping() and client.get_info()["collections"] == 1
    assert [r.id for r in client.scroll("docs", limit=2).collect()] == ["c", "d"]
    assert client.insert_vectors("docs", []) == 0


def test_errors(client):
    with pytest.raises(InvalidDimension):
        client.insert_vectors("docs", [{"id": "a", "data": [1.0, 2.0]}, {"id": "b", "data": [1.0]}])
    assert client.count("docs") == 0  # all or nothing
    for error, call in (
        (CollectionAlreadyExists, lambda: client.create_collection("docs", 2)), (CollectionNotFound, lambda: client.count("no")), (NotFound, lambda: client.get_vector("docs", "x")),
        (InvalidDimension, lambda: client.search("docs", [1.0])), (InvalidInput, lambda: client.search("docs", [1.0, 2.0], 0)), (ConfigurationError, lambda: CollectionConfig("x", 0).check()), (InvalidInput, lambda: CollectionConfig("a/b", 1).check()),
    ):
        with pytest.raises(error):
            call()


def test_deleted_backups_snapshots(client, spark, tmp_path):
    client.insert_vectors("docs", rows("a", "b"))
    saved = client.store.backup("docs")
    snap = client.create_snapshot("docs")
    assert snap["vector_count"] == 2 and client.list_snapshots("docs") == [snap] and client.list_snapshots("other") == []
    client.delete_collection("docs")
    assert client.list_collections() == [] and [n for n, _, _ in client.store.list_deleted()] == ["docs"]
    assert client.store.restore(saved) == "docs" and client.count("docs") == 2
    assert client.restore_snapshot(snap["name"], "again") == "again" and client.count("again") == 2
    file = client.store.export_snapshot(snap["name"], f"{tmp_path}/s.tar.gz")
    client.delete_snapshot(snap["name"])
    with pytest.raises(NotFound):
        client.get_snapshot(snap["name"])
    assert client.store.import_snapshot(file) == snap["name"] and client.restore_snapshot(snap["name"], "third") == "third"
    more = client.store.read("docs").limit(1)
    more.write.mode("append").parquet(f"{client.store.root}/.snapshots/{snap['name']}/rows")
    with pytest.raises(Corruption):
        client.restore_snapshot(snap["name"], "fourth")
    client.create_snapshot("docs")
    assert client.store.cleanup_snapshots(1) == 1
    assert client.store.cleanup_deleted(24) == [] and client.store.cleanup_deleted(-1) == ["docs"]
    client.delete_collection("again", hard=True)
    assert client.list_collections() == ["docs", "third"]


def test_logs(spark, tmp_path):
    log = spark.createDataFrame([(1, "a"), (2, None)], "seq int, v string")
    logs.write_log(log, f"file://{tmp_path}/log")
    (tmp_path / "log" / "bad.json").write_text('{"payload": "{\\"seq\\": 3}", "crc": 1}\nnot json\n')
    assert {tuple(r) for r in logs.read_log(spark, f"file://{tmp_path}/log", "seq int, v string").collect()} == {(1, "a"), (2, None)}
    (tmp_path / "v.jsonl").write_text('{"id": "a", "data": [1, 2], "metadata": {"k": 1}}\n{"id": "b", "da\n')
    assert [(r.id, list(r.data), r.metadata) for r in logs.read_vectors(spark, f"file://{tmp_path}/v.jsonl").collect()] == [("a", [1.0, 2.0], '{"k": 1}')]


def names(client, kind):
    return {x for x in client.store.files.children(f"{client.store.root}/docs") if x.startswith(kind)}


def test_changes_rewrite_nothing(client):
    client.insert_vectors("docs", rows("a", "b", "c"))
    first = names(client, "gen-")
    client.insert_vectors("docs", rows("c", "d"))
    client.delete_vectors("docs", ["a"])
    assert first < names(client, "gen-") and len(names(client, "gen-")) == 2 and len(names(client, "del-")) == 2
    assert {r.id: r.data for r in client.store.read("docs").collect()} == {"b": [1.0, 1.0], "c": [0.0, 1.0], "d": [1.0, 1.0]}
    client.insert_vectors("docs", rows("a"))  # deleted, and back again
    assert client.count("docs") == 4 and client.get_vector("docs", "a")["data"] == [0.0, 1.0]
    client.store.compact("docs")
    assert client.count("docs") == 4 and len(names(client, "gen-")) == 1 and not names(client, "del-")


def test_a_batch_of_one_id_twice_counts_once(client, spark):
    twice = spark.createDataFrame([("a", [1.0, 2.0], None, 7), ("a", [3.0, 4.0], None, 7), (None, [5.0, 6.0], None, 7)], "id string, data array<float>, metadata string, number_ int")
    assert client.insert_vectors("docs", twice) == 3
    assert client.store.read("docs").where("id = 'a'").count() == 1


def test_a_write_that_breaks_off_before_its_commit_changes_nothing(client, monkeypatch):
    client.insert_vectors("docs", rows("a", "b"))

    def broken(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(type(client.store), "commit", broken)
        for change in (lambda: client.insert_vectors("docs", rows("b", "c")), lambda: client.delete_vectors("docs", ["a"]), lambda: client.store.compact("docs")):
            with pytest.raises(KeyboardInterrupt):
                change()
    assert sorted(r.id for r in client.store.read("docs").collect()) == ["a", "b"]
    client.insert_vectors("docs", rows("c"))
    assert client.count("docs") == 3


def test_two_writers_of_one_number(client, monkeypatch):
    """Another writer commits between this one's look at the state and its commit: neither change is lost."""
    client.insert_vectors("docs", rows("a"))
    store, d = client.store, f"{client.store.root}/docs"
    create, raced = store.files.create, []

    def first_another(p, text):
        if not raced and "/manifests/" in p:
            raced.append(p)
            Client(client.spark, store.root).insert_vectors("docs", rows("x", "b"))
        return create(p, text)

    monkeypatch.setattr(store.files, "create", first_another)
    client.insert_vectors("docs", rows("b", "c"))
    assert sorted((r.id, r.data[0]) for r in store.read("docs").collect()) == [("a", 0.0), ("b", 0.0), ("c", 1.0), ("x", 0.0)]
    assert store.manifest(d)["number"] == 3 and not create(f"{d}/manifests/{3:010d}.json", "{}")


def test_readers_keep_what_they_began_with(client):
    client.insert_vectors("docs", rows("a", "b"))
    seen = client.store.read("docs")
    client.delete_vectors("docs", ["a"])
    assert seen.count() == 2 and client.count("docs") == 1


def test_index_of_a_collection(client, spark):
    rows_ = spark.range(400).selectExpr("CAST(id AS STRING) AS id", "array(CAST(id AS FLOAT), CAST(id % 7 AS FLOAT)) AS data", "to_json(named_struct('n', id)) AS metadata")
    with pytest.raises(NotFound):
        client.store.search_index("docs", [1.0, 1.0])
    assert client.build_index("docs")["rows"] == 0 and client.search("docs", [1.0, 1.0], 3, exact=False).count() == 0
    client.insert_vectors("docs", rows_)
    info = client.build_index("docs", 10)
    assert info["rows"] == 400 and len(info["centres"]) == 10
    client.insert_vectors("docs", [{"id": "new", "data": [100.0, 2.0]}, {"id": "100", "data": [0.0, 0.0]}])
    client.delete_vectors("docs", ["99"])
    ids = lambda **k: [r.id for r in client.search("docs", [100.0, 2.0], 3, **k).collect()]
    assert ids(exact=False) == ids() == ["new", "101", "102"]
    assert [r.id for r in client.search("docs", [100.0, 2.0], 2, {"n": 101}, exact=False).collect()] == ["101"]
    plan = client.store.search_index("docs", [100.0, 2.0], 3)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan


@pytest.mark.parametrize("kind", ["scalar", "binary"])
def test_quantized_search(spark, tmp_path, kind):
    c = Client(spark, f"file://{tmp_path}/store")
    c.create_collection("q", 8, quantization={"kind": kind, "always_ram": True})
    c.insert_vectors("q", spark.range(300).selectExpr("CAST(id AS STRING) AS id", "transform(sequence(1, 8), i -> CAST(sin(id * i) AS FLOAT)) AS data"))
    q = [float(x) for x in c.get_vector("q", "17")["data"]]
    near, exact = [r.id for r in c.search("q", q, 5, exact=False, oversample=10).collect()], [r.id for r in c.search("q", q, 5).collect()]
    assert near[0] == "17" and len(set(near) & set(exact)) >= 4


def test_more_of_the_client(client, spark):
    meta = lambda i: {"kind": ["x", "y"][i % 2], "text": f"river stone {'lantern' if i == 3 else ''}", "sparse": {"indices": [i, 50], "values": [1.0, 1.0]}}
    client.insert_vectors("docs", [{"id": str(i), "data": [float(i), 1.0], "metadata": meta(i)} for i in range(7)])
    assert [tuple(r) for r in client.facet("docs", "kind").collect()] == [("x", 4), ("y", 3)]
    groups = client.search_groups("docs", [3.0, 1.0], "kind", 2, 2).collect()
    assert {(r.grp, r.id) for r in groups} == {("y", "3"), ("x", "2"), ("x", "4"), ("y", "1")}
    assert [r.id for r in client.prefetch("docs", [3.0, 1.0], 1, per_prefetch=5).collect()] == ["3"]
    assert client.hybrid_search("docs", [3.0, 1.0], {"lantern": 1.0}, limit=1).first().id == "3"
    assert client.search_sparse("docs", {4: 1.0}).first().doc == "4"
    saved = client.backup("docs")
    client.delete_collection("docs")
    assert client.list_deleted()[0][0] == "docs" and client.restore(saved, "copy") == "copy" and client.count("copy") == 7 and client.cleanup_deleted(-1) == ["docs"]
    assert client.live() and client.ready()["ready"]
    client.store.commit(f"{client.store.root}/copy", lambda m, _: {**m, "rows": {**m["rows"], "gen-" + "0" * 32: 9}})  # a generation that isn't there
    client.create_collection("ok", 2)
    deep = client.deep_health()
    assert deep["collections"]["ok"]["status"] == "healthy" and deep["collections"]["copy"]["status"] == "unhealthy" and deep["status"] == "unhealthy"
    m = {(r.name, r.collection): r for r in client.get_metrics().collect()}
    assert m["insert", "docs"]["count"] == 1 and m["vectors_inserted", "docs"]["count"] == 7 and sum(m["insert", "docs"].buckets) == 1
    import numpy as np

    assert client.insert_vectors("ok", np.arange(10.0).reshape(5, 2)) == 5 and client.count("ok") == 5


def test_orphans_and_migration(client, spark, tmp_path):
    client.insert_vectors("docs", rows("a", "b"))
    client.delete_vectors("docs", ["a"])
    other = Client(spark, f"file://{tmp_path}/other")
    assert other.store.import_orphaned(f"{client.store.root}/docs", "mine") == "mine" and other.count("mine") == 1
    assert other.get_collection("mine").distance_metric == "euclidean"  # the folder's own configuration
    client.store.read("docs").write.parquet(f"file://{tmp_path}/bare")
    assert other.store.import_orphaned(f"file://{tmp_path}/bare") == "bare" and other.get_collection("bare").dimension == 2
    from pyspark.sql import functions as F

    def wider(df, config):
        config.dimension = 3
        return df.withColumn("data", F.concat("data", F.array(F.lit(0.0).cast("float")))), config

    assert other.store.migrate("bare", "wide", wider) == 1 and other.get_vector("wide", "b")["data"] == [1.0, 1.0, 0.0]


def test_keys(client, spark):
    from vectorloom.access import Access, Grant
    from vectorloom.errors import AccessDenied

    client.insert_vectors("docs", rows("a", "b", "c"))
    access = Access()
    reader = access.create_key("reader", [Grant("read", "docs", {"n": 1})])
    writer, brief = access.create_key("writer", [Grant("write", "docs")]), access.create_key("brief", [Grant("admin")], seconds=0)
    at = lambda key: Client(spark, client.store.root, access, key)
    assert at(reader).count("docs") == 1 and [r.id for r in at(reader).search("docs", [0.0, 1.0], 5).collect()] == ["b"] and at(reader).get_vector("docs", "b")["id"] == "b"
    with pytest.raises(NotFound):
        at(reader).get_vector("docs", "a")
    assert at(writer).delete_vectors("docs", ["a"]) == 1 and at(writer).count("docs") == 2
    for call in (lambda: at(reader).insert_vectors("docs", rows("z")), lambda: at(writer).delete_collection("docs"), lambda: at(brief).count("docs"), lambda: at(None).count("docs"), lambda: at(reader).count("other")):
        with pytest.raises(AccessDenied):
            call()
    assert access.revoke(writer) and not access.revoke(writer) and [k[0] for k in access.list_keys()] == ["reader", "brief"]
    with pytest.raises(AccessDenied):
        at(writer).count("docs")
