"""Collections of vectors in Parquet.

A collection is a folder with ``metadata.json`` (its configuration), generations of rows, files of deleted ids, and numbered manifests. A manifest names
what makes up the state of its number; it is created whole and never overwritten, and the highest number is the present state. So a reader sees all of a
change or nothing of it, one that has begun keeps what it began with, and of two writers of the same number one finds it taken and tries the next.

Nothing is rewritten by a change. An upsert appends its rows and, as equality deletes, their ids; a delete appends ids. Both carry the number of their manifest:
a row is live unless its id was deleted with a greater number. ``compact`` folds it all into one generation, sorted by id.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..errors import CollectionAlreadyExists, CollectionNotFound, ConfigurationError, Corruption, InvalidDimension, InvalidInput, NotFound
from ..functions.vector import metric
from ..operators import dml
from .fs import Files

ROWS = "id string, data array<float>, metadata string"


@dataclass
class IndexConfig:
    max_connections: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    max_layer: int = 16

    def check(self) -> None:
        for name, lo, hi in (("max_connections", 2, 512), ("ef_construction", 16, 2000), ("ef_search", 1, 1000), ("max_layer", 1, 32)):
            if not lo <= getattr(self, name) <= hi:
                raise ConfigurationError(f"{name} must be from {lo} to {hi}")


@dataclass
class CollectionConfig:
    name: str
    dimension: int
    distance_metric: str = "cosine"
    vector_type: str = "float32"
    index_config: IndexConfig = field(default_factory=IndexConfig)
    quantization: dict | None = None

    def check(self) -> "CollectionConfig":
        if not re.fullmatch(r"[^/\\.][^/\\]{0,63}", self.name):
            raise InvalidInput("a collection's name has 1 to 64 characters, no slash, and no dot in front")
        if not 1 <= self.dimension <= 65_536:
            raise ConfigurationError("a dimension is from 1 to 65536")
        self.distance_metric = metric(self.distance_metric)
        self.index_config.check()
        return self


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    # the catalog

    def _dir(self, name: str, must: bool = True) -> str:
        d = f"{self.root}/{name}"
        if must and not self.files.exists(f"{d}/metadata.json"):
            raise CollectionNotFound(name)
        return d

    def create_collection(self, config: CollectionConfig) -> CollectionConfig:
        config.check()
        d = self._dir(config.name, False)
        if self.files.exists(f"{d}/metadata.json") or not self.files.create(f"{d}/metadata.json", json.dumps(asdict(config), indent=2)):
            raise CollectionAlreadyExists(config.name)
        return config

    def config(self, name: str) -> CollectionConfig:
        c = json.loads(self.files.read(f"{self._dir(name)}/metadata.json"))
        return CollectionConfig(**{**c, "index_config": IndexConfig(**c["index_config"])})

    def list_collections(self) -> list[str]:
        return [n for n in self.files.children(self.root) if not n.startswith(".") and self.files.exists(f"{self.root}/{n}/metadata.json")]

    def manifest(self, d: str) -> dict:
        """The present state: ``number``, ``rows`` and ``deleted`` (name and number of each), ``index``."""
        there = [x for x in self.files.children(f"{d}/manifests") if re.fullmatch(r"\d{10}\.json", x)]
        return json.loads(self.files.read(f"{d}/manifests/{there[-1]}")) if there else {"number": 0, "rows": {}, "deleted": {}, "index": None}

    def commit(self, d: str, change) -> dict:
        """The next state, ``change(the present one, its number)``; made anew from the then present one as long as other writers come first."""
        while True:
            old = self.manifest(d)
            number = old["number"] + 1
            new = {**change(old, number), "number": number, "at": time.time()}
            if self.files.create(f"{d}/manifests/{number:010d}.json", json.dumps(new)):
                return new

    def _scan(self, d: str, names: dict[str, int]) -> DataFrame:
        """Rows of some generations with their number."""
        if not names:
            return self.spark.createDataFrame([], f"{ROWS}, number_ bigint")
        rows = self.spark.read.schema(ROWS).parquet(*(f"{d}/{n}" for n in names))
        if len(set(names.values())) == 1:
            return rows.withColumn("number_", F.lit(next(iter(names.values()))).cast("bigint"))
        number = F.create_map(*(F.lit(x) for n, k in names.items() for x in (n, k)))
        return rows.withColumn("number_", F.element_at(number, F.regexp_extract("_metadata.file_path", r"/(gen-[0-9a-f]{32})/", 1)).cast("bigint"))

    def _live(self, d: str, m: dict, names: dict[str, int] | None = None, rows: DataFrame | None = None) -> DataFrame:
        """The rows that no later delete names. Deletes older than all the rows aren't read."""
        names = m["rows"] if names is None else names
        rows = self._scan(d, names) if rows is None else rows
        late = {n: k for n, k in m["deleted"].items() if k > min(names.values(), default=0)}
        if late:
            number = F.create_map(*(F.lit(x) for n, k in late.items() for x in (n, k)))
            gone = self.spark.read.schema("id string").parquet(*(f"{d}/{n}" for n in late))
            gone = gone.select("id", F.element_at(number, F.regexp_extract("_metadata.file_path", r"/(del-[0-9a-f]{32})/", 1)).cast("bigint").alias("later_"))
            gone = gone.groupBy("id").agg(F.max("later_").alias("later_")).withColumnRenamed("id", "gone_")
            rows = rows.join(gone, (F.col("id") == F.col("gone_")) & (F.col("later_") > F.col("number_")), "left_anti")
        return rows.drop("number_")

    def read(self, name: str) -> DataFrame:
        d = self._dir(name)
        return self._live(d, self.manifest(d))

    def stats(self) -> DataFrame:
        """``name, vector_count, dimension, distance_metric, disk_bytes`` of each collection."""
        out = self.spark.createDataFrame([], "name string, vector_count bigint, dimension int, distance_metric string, disk_bytes bigint")
        for n in self.list_collections():
            c, size = self.config(n), self.files.bytes(f"{self.root}/{n}")
            out = out.unionByName(self.read(n).agg(F.count("*").alias("vector_count")).select(F.lit(n).alias("name"), "vector_count", F.lit(c.dimension).alias("dimension"), F.lit(c.distance_metric).alias("distance_metric"), F.lit(size).cast("bigint").alias("disk_bytes")))
        return out

    def server_stats(self) -> DataFrame:
        s = self.stats()
        return s.agg(F.coalesce(F.sum("vector_count"), F.lit(0)).alias("total_vectors"), F.count("*").alias("total_collections"), F.coalesce(F.sum("disk_bytes"), F.lit(0)).alias("disk_usage"))

    # rows

    def _rows(self, rows: DataFrame) -> DataFrame:
        meta = F.col("metadata") if "metadata" in rows.columns else F.lit(None).cast("string")
        return rows.select(F.col("id").cast("string").alias("id"), F.col("data").cast("array<float>").alias("data"), meta.cast("string").alias("metadata"))

    def _write(self, d: str, rows: DataFrame) -> str:
        """A generation; sorted by id and with a bloom filter of it, so that a look for one id reads next to nothing."""
        g = f"gen-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("id").write.option("parquet.bloom.filter.enabled#id", "true").parquet(f"{d}/{g}")
        return g

    def insert(self, name: str, rows: DataFrame) -> int:
        """Append rows, all or none; ids that exist are replaced, so ids stay unique. The number of rows given."""
        return self.upsert(name, rows)

    def upsert(self, name: str, rows: DataFrame) -> int:
        """Rows are checked and counted while they are written, once; they take part only when the manifest names them. Of a batch's rows of an id one counts."""
        d, c = self._dir(name), self.config(name)
        wrong = F.col("data").isNull() | (F.size("data") != c.dimension)
        seen = Observation()
        checked = self._rows(rows).observe(seen, F.count("*").alias("n"), F.max(F.when(wrong, F.coalesce(F.size("data"), F.lit(-1)))).alias("wrong"))
        g = self._write(d, dml.latest(checked, ["id"], F.xxhash64("data", "metadata")))
        if seen.get["wrong"] is not None or not seen.get["n"]:
            self.files.delete(f"{d}/{g}")
            if seen.get["wrong"] is not None:
                raise InvalidDimension(c.dimension, seen.get["wrong"])
            return 0
        keys = None
        if self.manifest(d)["rows"]:
            keys = f"del-{uuid.uuid4().hex}"
            self.spark.read.schema(ROWS).parquet(f"{d}/{g}").select("id").write.parquet(f"{d}/{keys}")

        def change(m: dict, number: int) -> dict:
            nonlocal keys
            if m["rows"] and keys is None:  # another writer came first
                keys = f"del-{uuid.uuid4().hex}"
                self.spark.read.schema(ROWS).parquet(f"{d}/{g}").select("id").write.parquet(f"{d}/{keys}")
            return {**m, "rows": {**m["rows"], g: number}, "deleted": {**m["deleted"], **({keys: number} if keys else {})}}

        self.commit(d, change)
        return seen.get["n"]

    update = batch_upsert = batch_insert = upsert

    def delete(self, name: str, ids: DataFrame) -> int:
        """Delete ids; how many of them there were. Only the ids are written."""
        d = self._dir(name)
        keys, seen = f"del-{uuid.uuid4().hex}", Observation()
        there = self.read(name).select("id").join(ids.select(F.col("id").cast("string").alias("id")), "id", "left_semi").distinct()
        there.observe(seen, F.count("*").alias("n")).write.parquet(f"{d}/{keys}")
        if seen.get["n"]:
            self.commit(d, lambda m, number: {**m, "deleted": {**m["deleted"], keys: number}})
        else:
            self.files.delete(f"{d}/{keys}")
        return seen.get["n"]

    def get(self, name: str, id_: str) -> DataFrame:
        """The rows of one id; sorted generations and their bloom filters let the scan skip the rest."""
        d = self._dir(name)
        m = self.manifest(d)
        return self._live(d, m, rows=self._scan(d, m["rows"]).where(F.col("id") == id_)).where(F.col("id") == id_)

    def compact(self, name: str, files: int | None = None) -> None:
        """Fold rows and deletes into one generation in ranges of ids. Changes that are committed meanwhile stay as they are; what no manifest names any more is deleted."""
        d = self._dir(name)
        base = self.manifest(d)
        rows = self._live(d, base)
        g = self._write(d, rows.repartitionByRange(files, "id") if files else rows.repartitionByRange("id"))
        later = lambda names: {n: k for n, k in names.items() if k > base["number"]}
        new = self.commit(d, lambda m, _: {**m, "rows": {g: base["number"], **later(m["rows"])}, "deleted": later(m["deleted"])})
        used = {*new["rows"], *new["deleted"], (new["index"] or {}).get("name")}
        old = {*base["rows"], *base["deleted"]}
        for x in self.files.children(d):
            if x in old - used:
                self.files.delete(f"{d}/{x}")

    # the index

    def build_index(self, name: str, cells: int | None = None) -> dict:
        """An inverted-file index that the collection owns: its live rows by coarse cell, built from storage, replacing an older one.

        It holds the state of its manifest; ``search_index`` adds what was written later. Without ``cells`` there are about as many as the square root of the rows, 4,096 at most.
        """
        from ..operators.quantizers import IvfIndex

        d = self._dir(name)
        m = self.manifest(d)
        rows = self._live(d, m)
        n = rows.count()
        cells = cells or int(min(4096, max(1, round(n**0.5))))
        label = f"idx-{uuid.uuid4().hex}"
        index = IvfIndex.build(rows, cells).save(f"{d}/{label}") if n else None
        info = {"name": label, "number": m["number"], "centres": index.centres.tolist() if index else [], "rows": n}
        self.commit(d, lambda now, _: {**now, "index": info})
        return info

    def index_of(self, name: str) -> dict | None:
        return self.manifest(self._dir(name))["index"]

    def search_index(self, name: str, query, k: int = 10, probe: int | None = None, where=None) -> DataFrame:
        """``id, distance, metadata`` of the k nearest rows in the ``probe`` nearest cells and among the rows written since the index was built.

        ``probe`` defaults to the share ef_search / ef_construction of the cells (a quarter by default).
        """
        import math

        import numpy as np

        from ..operators.quantizers import IvfIndex
        from ..operators.search import knn

        d, c = self._dir(name), self.config(name)
        m = self.manifest(d)
        index = m["index"]
        if not index:
            raise NotFound(f"{name} has no index")
        later = {n: k for n, k in m["rows"].items() if k > index["number"]}
        rows = self._live(d, m, later)
        if index["rows"]:
            centres = np.array(index["centres"])
            probe = probe or max(1, math.ceil(len(centres) * min(1, c.index_config.ef_search / c.index_config.ef_construction)))
            near = self.spark.read.schema(f"{ROWS}, cell int").parquet(f"{d}/{index['name']}").where(F.col("cell").isin(IvfIndex.nearest_cells(centres, query, probe)))
            near = self._live(d, m, {index["name"]: index["number"]}, near.drop("cell").withColumn("number_", F.lit(index["number"]).cast("bigint")))
            rows = near.unionByName(rows)
        return knn(rows, query, k, c.distance_metric, where)

    # deleting, backups

    def delete_collection(self, name: str) -> str:
        """Put away; it can be restored until it is cleaned up."""
        away = f"{self.root}/.deleted/{name}_{int(time.time() * 1000)}"
        d = self._dir(name)
        self.files.fs.mkdirs(self.files.path(f"{self.root}/.deleted"))
        self.files.rename(d, away)
        return away

    def hard_delete_collection(self, name: str) -> None:
        self.files.delete(self._dir(name))

    def list_deleted(self) -> list[tuple[str, str, float]]:
        """(name, path, time in seconds) of what was put away."""
        out = []
        for x in self.files.children(f"{self.root}/.deleted"):
            c = json.loads(self.files.read(f"{self.root}/.deleted/{x}/metadata.json"))
            out.append((c["name"], f"{self.root}/.deleted/{x}", int(x.rsplit("_", 1)[1]) / 1000))
        return out

    def cleanup_deleted(self, hours: float = 24, now: float | None = None) -> list[str]:
        old = [(n, p) for n, p, t in self.list_deleted() if (now or time.time()) - t > hours * 3600]
        for _, p in old:
            self.files.delete(p)
        return [n for n, _ in old]

    def backup(self, name: str) -> str:
        to = f"{self.root}/.backups/{name}_{int(time.time() * 1000)}"
        self.files.fs.mkdirs(self.files.path(f"{self.root}/.backups"))
        self.files.copy(self._dir(name), to)
        return to

    def restore(self, path: str, name: str | None = None) -> str:
        """Bring back a backup or a deleted collection, under its own or another name."""
        if not self.files.exists(f"{path}/metadata.json"):
            raise NotFound(path)
        c = json.loads(self.files.read(f"{path}/metadata.json"))
        c["name"] = name or c["name"]
        d = self._dir(c["name"], False)
        if self.files.exists(d):
            raise CollectionAlreadyExists(c["name"])
        self.files.copy(path, d)
        self.files.write(f"{d}/metadata.json", json.dumps(c, indent=2))
        return c["name"]

    def import_parquet(self, path: str, config: CollectionConfig) -> int:
        """Adopt foreign rows (id, data, metadata) under a configuration."""
        self.create_collection(config)
        return self.insert(config.name, self.spark.read.parquet(path))

    def import_orphaned(self, path: str, name: str | None = None, config: CollectionConfig | None = None) -> str:
        """Adopt a folder that the catalog doesn't know: under its own configuration if it has one, else the given one, or one of the rows' dimension.

        A folder with manifests is taken as it is; one of bare Parquet files is read and inserted.
        """
        if self.files.exists(f"{path}/manifests"):
            return self.restore(path, name)
        if self.files.exists(f"{path}/metadata.json"):
            c = json.loads(self.files.read(f"{path}/metadata.json"))
            config = CollectionConfig(**{**c, "index_config": IndexConfig(**c["index_config"])})
        rows = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
        if config is None:
            first = rows.where(F.size("data") > 0).select(F.size("data")).first()
            if first is None:
                raise InvalidInput(f"{path} holds no vectors")
            config = CollectionConfig(path.rstrip("/").rsplit("/", 1)[-1], first[0])
        config.name = name or config.name
        self.create_collection(config)
        self.insert(config.name, rows)
        return config.name

    def migrate(self, name: str, to: str, convert) -> int:
        """Rewrite a collection's rows in another form, as a new collection: ``convert(rows)`` gives (rows, configuration); the rows' number is checked."""
        rows, config = convert(self.read(name), self.config(name))
        config.name = to
        self.create_collection(config)
        n = self.insert(to, rows)
        if n != self.read(name).count():
            self.hard_delete_collection(to)
            raise Corruption(f"{name} has another number of rows than its new form")
        return n

    def check(self, name: str) -> DataFrame:
        return dml.consistency(self.read(name), self.config(name).dimension)

    # snapshots

    def create_snapshot(self, name: str) -> dict:
        d, at = self._dir(name), time.time()
        snap = f"{name}_{int(at)}"
        while self.files.exists(f"{self.root}/.snapshots/{snap}"):
            at += 1
            snap = f"{name}_{int(at)}"
        to = f"{self.root}/.snapshots/{snap}"
        self.read(name).write.parquet(f"{to}/rows")
        rows = dml.checksum(self.spark.read.parquet(f"{to}/rows"), "id", "data", "metadata").first()
        info = {"name": snap, "collection": name, "created_at": int(at), "size_bytes": self.files.bytes(f"{to}/rows"), "vector_count": rows["rows"], "checksum": rows["checksum"]}
        self.files.copy(f"{d}/metadata.json", f"{to}/metadata.json")
        self.files.write(f"{to}/snapshot.json", json.dumps(info))
        return info

    def list_snapshots(self, collection: str | None = None) -> list[dict]:
        """Newest first."""
        all_ = [json.loads(self.files.read(f"{self.root}/.snapshots/{x}/snapshot.json")) for x in self.files.children(f"{self.root}/.snapshots")]
        return sorted((s for s in all_ if collection in (None, s["collection"])), key=lambda s: (-s["created_at"], s["name"]))

    def get_snapshot(self, snap: str) -> dict:
        p = f"{self.root}/.snapshots/{snap}/snapshot.json"
        if not self.files.exists(p):
            raise NotFound(snap)
        return json.loads(self.files.read(p))

    def delete_snapshot(self, snap: str) -> None:
        self.get_snapshot(snap)
        self.files.delete(f"{self.root}/.snapshots/{snap}")

    def restore_snapshot(self, snap: str, name: str | None = None) -> str:
        """Check the rows against the manifest, then make them a collection."""
        info, p = self.get_snapshot(snap), f"{self.root}/.snapshots/{snap}"
        rows = self.spark.read.schema(ROWS).parquet(f"{p}/rows")
        if dml.checksum(rows, "id", "data", "metadata").first()["checksum"] != info["checksum"]:
            raise Corruption(snap)
        c = json.loads(self.files.read(f"{p}/metadata.json"))
        config = CollectionConfig(**{**c, "name": name or c["name"], "index_config": IndexConfig(**c["index_config"])})
        self.create_collection(config)
        d = self._dir(config.name)
        g = self._write(d, rows)
        self.commit(d, lambda m, number: {**m, "rows": {**m["rows"], g: number}})
        return config.name

    def cleanup_snapshots(self, keep: int, collection: str | None = None) -> int:
        old = self.list_snapshots(collection)[keep:]
        for s in old:
            self.delete_snapshot(s["name"])
        return len(old)

    def export_snapshot(self, snap: str, path: str) -> str:
        """A tar.gz of a snapshot on the driver's disk."""
        import tarfile
        import tempfile

        self.get_snapshot(snap)
        with tempfile.TemporaryDirectory() as tmp, tarfile.open(path, "w:gz") as tar:
            self.files.fs.copyToLocalFile(self.files.path(f"{self.root}/.snapshots/{snap}"), self.files.path(tmp))
            tar.add(f"{tmp}/{snap}", arcname=snap)
        return path

    def import_snapshot(self, path: str) -> str:
        import os
        import tarfile
        import tempfile

        with tempfile.TemporaryDirectory() as tmp, tarfile.open(path) as tar:
            tar.extractall(tmp, filter="data")
            snap = os.listdir(tmp)[0]
            to = f"{self.root}/.snapshots/{snap}"
            if self.files.exists(to):
                raise CollectionAlreadyExists(snap)
            self.files.fs.mkdirs(self.files.path(f"{self.root}/.snapshots"))
            self.files.fs.copyFromLocalFile(self.files.path(f"{tmp}/{snap}"), self.files.path(to))
        return snap
