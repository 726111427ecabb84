"""One object for all of it, by the names a client of a vector store knows."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .access import Access
from .errors import InvalidDimension, InvalidInput, NotFound
from .metrics import Metrics
from .operators import bm25, fusion, search as s
from .plans.filters import compile_filter
from .sources.store import CollectionConfig, Store


def payload_value(metadata: Column, key: str) -> Column:
    """A key of a payload as text; null where it is missing."""
    return F.get_json_object(metadata, f"$['{key}']")


class Client:
    def __init__(self, spark: SparkSession, root: str, access: Access | None = None, key: str | None = None):
        """Without ``access`` everything is allowed; with it, what ``key`` is granted."""
        self.spark, self.store, self.metrics, self.access, self.key = spark, Store(spark, root), Metrics(), access, key

    def _require(self, action: str, name: str) -> list[dict]:
        return self.access.require(self.key, action, name) if self.access else []

    def _read(self, name: str) -> DataFrame:
        """The rows of a collection that the key may read."""
        some = [compile_filter(w, F.col("metadata")) for w in self._require("read", name)]
        rows = self.store.read(name)
        return rows.where(reduce(lambda a, b: a | b, some)) if some else rows

    def create_collection(self, name: str, dimension: int, distance_metric: str = "cosine", **more) -> CollectionConfig:
        self._require("admin", name)
        return self.store.create_collection(CollectionConfig(name, dimension, distance_metric, **more))

    create_collection_simple = create_collection

    def delete_collection(self, name: str, hard: bool = False) -> None:
        self._require("admin", name)
        (self.store.hard_delete_collection if hard else self.store.delete_collection)(name)

    def get_collection(self, name: str) -> CollectionConfig:
        return self.store.config(name)

    def list_collections(self) -> list[str]:
        return self.store.list_collections()

    def get_collection_stats(self, name: str) -> dict:
        return self.store.stats().where(F.col("name") == name).first().asDict()

    def get_server_stats(self) -> dict:
        return self.store.server_stats().first().asDict()

    def _frame(self, vectors) -> DataFrame:
        if isinstance(vectors, DataFrame):
            return vectors
        if isinstance(vectors, np.ndarray):
            # a matrix goes to Spark as one Arrow table, not element by element
            data = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(vectors, np.float32).ravel()), vectors.shape[1])
            ids = pa.array([str(uuid.uuid4()) for _ in range(len(vectors))])
            return self.spark.createDataFrame(pa.table({"id": ids, "data": data.cast(pa.list_(pa.float32()))}))
        rows = [(str(v.get("id") or uuid.uuid4()), [float(x) for x in v["data"]], v.get("metadata")) for v in vectors]
        import json

        return self.spark.createDataFrame([(i, d, m if m is None or isinstance(m, str) else json.dumps(m)) for i, d, m in rows], "id string, data array<float>, metadata string")

    def insert_vectors(self, name: str, vectors) -> int:
        """Dicts (id, data, metadata) or a DataFrame; of any number, so there is nothing to batch."""
        self._require("write", name)
        with self.metrics.timed("insert", name):
            n = self.store.insert(name, self._frame(vectors))
        self.metrics.add("vectors_inserted", name, n)
        return n

    batch_insert_simple = upsert_vectors = insert_vectors

    def insert_vector(self, name: str, data: Sequence[float], id: str | None = None, metadata=None) -> str:  # noqa: A002
        id = id or str(uuid.uuid4())  # noqa: A001
        self.insert_vectors(name, [{"id": id, "data": data, "metadata": metadata}])
        return id

    insert_simple = insert_vector

    def update_vector(self, name: str, id: str, data: Sequence[float], metadata=None) -> None:  # noqa: A002
        self.insert_vectors(name, [{"id": id, "data": data, "metadata": metadata}])

    def get_vector(self, name: str, id: str) -> dict:  # noqa: A002
        row = self.store.get(name, id)
        some = [compile_filter(w, F.col("metadata")) for w in self._require("read", name)]
        row = (row.where(reduce(lambda a, b: a | b, some)) if some else row).first()
        if row is None:
            raise NotFound(id)
        return row.asDict()

    def delete_vectors(self, name: str, ids: Sequence[str]) -> int:
        self._require("write", name)
        return self.store.delete(name, self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def delete_vector(self, name: str, id: str) -> bool:  # noqa: A002
        return self.delete_vectors(name, [id]) == 1

    def search(self, name: str, query: Sequence[float], limit: int = 10, filter: dict | None = None, offset: int = 0, exact: bool = True, oversample: int = 4) -> DataFrame:  # noqa: A002
        """The nearest rows. Not ``exact`` is by the collection's index if it has one; else, if its configuration names a quantization (``kind`` scalar or binary), the
        ``oversample`` times as many rows that are nearest by quantized distance are searched exactly.
        """
        c = self.store.config(name)
        if len(query) != c.dimension:
            raise InvalidDimension(c.dimension, len(query))
        if not 1 <= limit <= 10_000:
            raise InvalidInput("a limit is from 1 to 10000")
        with self.metrics.timed("search", name):
            some = self._require("read", name)
            if not exact and not offset:
                if self.store.index_of(name) and not some:
                    return self.store.search_index(name, query, limit, where=filter)
                kind = (c.quantization or {}).get("kind")
                if kind in ("scalar", "binary"):
                    rows = s._kept(self._read(name), s.Columns(), filter)
                    return s.prefetch_rescore(rows, query, [s.quantized_distance(kind, F.col("data"), query, c.distance_metric)], oversample * limit, limit, c.distance_metric)
            return s.knn(self._read(name), query, limit, c.distance_metric, filter, offset)

    search_simple = search

    def build_index(self, name: str, cells: int | None = None) -> dict:
        self._require("admin", name)
        with self.metrics.timed("build_index", name):
            return self.store.build_index(name, cells)

    rebuild_index = build_index

    def facet(self, name: str, key: str, limit: int = 10, filter: dict | None = None) -> DataFrame:  # noqa: A002
        """``value, count`` of a payload key's most frequent values."""
        where = compile_filter(filter, F.col("metadata")) if filter else None
        return s.facet(self._read(name), payload_value(F.col("metadata"), key), limit, where)

    def search_groups(self, name: str, query: Sequence[float], group_by: str, group_size: int = 3, limit: int = 10, filter: dict | None = None) -> DataFrame:  # noqa: A002
        return s.search_groups(self._read(name), query, payload_value(F.col("metadata"), group_by), group_size, limit, self.store.config(name).distance_metric, filter)

    def prefetch(self, name: str, query: Sequence[float], limit: int = 10, kind: str = "scalar", per_prefetch: int = 100) -> DataFrame:
        by = self.store.config(name).distance_metric
        return s.prefetch_rescore(self._read(name), query, [s.quantized_distance(kind, F.col("data"), query, by)], per_prefetch, limit, by)

    def hybrid_search(self, name: str, query: Sequence[float], terms: dict[str, float], text_key: str = "text", limit: int = 10, per_list: int = 100, method: str = "relative_score") -> DataFrame:
        """``id, score`` of vectors and of the words of a payload key together."""
        rows = self._read(name)
        dense = s.knn(rows, query, per_list, self.store.config(name).distance_metric)
        texts = rows.select("id", payload_value(F.col("metadata"), text_key).alias("text"))
        return fusion.hybrid(dense.select("id", "distance"), bm25.search_texts(texts, terms, per_list, "id").withColumnRenamed("doc", "id"), limit, method)

    def search_sparse(self, name: str, query: dict[int, float], key: str = "sparse", limit: int = 10) -> DataFrame:
        """``doc, score`` of BM25 over the sparse vector ``{indices, values}`` of a payload key."""
        kind = "struct<indices:array<int>,values:array<double>>"
        rows = self._read(name).select("id", F.from_json(payload_value(F.col("metadata"), key), kind).alias("sparse")).where("sparse.indices IS NOT NULL")
        return bm25.search(bm25.sparse_postings(rows, "id", "sparse"), query, limit)

    def backup(self, name: str) -> str:
        self._require("admin", name)
        return self.store.backup(name)

    def restore(self, path: str, name: str | None = None) -> str:
        self._require("admin", name or "*")
        return self.store.restore(path, name)

    def list_deleted(self) -> list[tuple[str, str, float]]:
        return self.store.list_deleted()

    def cleanup_deleted(self, hours: float = 24) -> list[str]:
        return self.store.cleanup_deleted(hours)

    def cleanup_snapshots(self, keep: int, name: str | None = None) -> int:
        return self.store.cleanup_snapshots(keep, name)

    def batch_search(self, name: str, queries: DataFrame, limit: int = 10) -> DataFrame:
        return s.batch_knn(self._read(name), queries, limit, self.store.config(name).distance_metric)

    def recommend(self, name: str, positive, negative=(), limit: int = 10, **more) -> DataFrame:
        return s.recommend(self._read(name), positive, negative, limit, self.store.config(name).distance_metric, **more)

    def discover(self, name: str, target, context=(), limit: int = 10, **more) -> DataFrame:
        return s.discover(self._read(name), target, context, limit, self.store.config(name).distance_metric, **more)

    def scroll(self, name: str, **more) -> DataFrame:
        return s.scroll(self._read(name), **more)

    def count(self, name: str, filter: dict | None = None, exact: bool = True) -> int:  # noqa: A002
        return s.count(self._read(name), filter, exact).first()[0]

    def live(self) -> bool:
        """Whether the session runs."""
        return self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped()

    def ready(self) -> dict:
        """Whether a job runs and the store's folder can be listed, and how long each takes."""
        out = {}
        for part, call in (("job", lambda: self.spark.range(1).count() == 1), ("storage", lambda: self.store.list_collections() is not None)):
            began = time.perf_counter()
            try:
                ok, error = bool(call()), None
            except Exception as e:  # noqa: BLE001
                ok, error = False, str(e)
            out[part] = {"ok": ok, "ms": round(1000 * (time.perf_counter() - began), 1), "error": error}
        return {"ready": all(x["ok"] for x in out.values()), "checks": out}

    def deep_health(self, degraded_ms: float = 5_000, unhealthy_ms: float = 30_000) -> dict:
        """Each collection's manifest, rows and consistency, judged by faults and by the time a pass over it takes: healthy, degraded or unhealthy, the worst for all."""
        order, parts = ("healthy", "degraded", "unhealthy"), {}
        for name in self.list_collections():
            began = time.perf_counter()
            try:
                c = self.store.check(name).first().asDict()
                ms = 1000 * (time.perf_counter() - began)
                faults = c["null_data"] + c["wrong_dimension"] + c["duplicate_ids"]
                state = order[2] if ms >= unhealthy_ms or faults > c["row_count"] / 2 else order[1] if ms >= degraded_ms or faults else order[0]
                parts[name] = {"status": state, "ms": round(ms, 1), **c}
            except Exception as e:  # noqa: BLE001
                parts[name] = {"status": order[2], "error": str(e)}
        ready = self.ready()
        worst = max((order.index(p["status"]) for p in parts.values()), default=0)
        return {"status": order[worst] if ready["ready"] else order[2], **ready, "collections": parts}

    def health_check(self) -> dict:
        try:
            return {"healthy": True, "collections": len(self.list_collections())}
        except Exception as e:  # noqa: BLE001
            return {"healthy": False, "error": str(e)}

    def ping(self) -> bool:
        return self.health_check()["healthy"]

    def get_info(self) -> dict:
        return self.health_check() | {"spark": self.spark.version}

    def get_metrics(self) -> DataFrame:
        return self.metrics.frame(self.spark)

    def create_snapshot(self, name: str) -> dict:
        self._require("admin", name)
        return self.store.create_snapshot(name)

    def list_snapshots(self, name: str | None = None) -> list[dict]:
        return self.store.list_snapshots(name)

    def get_snapshot(self, snap: str) -> dict:
        return self.store.get_snapshot(snap)

    def delete_snapshot(self, snap: str) -> None:
        self.store.delete_snapshot(snap)

    def restore_snapshot(self, snap: str, name: str | None = None) -> str:
        self._require("admin", name or "*")
        return self.store.restore_snapshot(snap, name)
