"""Product quantization, and an inverted-file index of coarse cells. Both learn from a bounded sample and then treat every row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..errors import ConfigurationError, InvalidDimension, InvalidInput
from ..functions.vector import metric
from .search import Columns, block_distances, k_nearest, knn, query_blocks

#: Rows from which codebooks and cells are learned, those of the smallest hash of their id.
TRAIN_ROWS = 10_000
#: Queries by which the number of probed cells is chosen, those of the smallest hash of their id.
TRIED = 256


def k_means(x: np.ndarray, k: int, rounds: int = 10, eps: float = 1e-6) -> np.ndarray:
    """Deterministic: the first centres are evenly spaced rows (padded with the first), an empty cluster keeps its centre, ties go to the first centre."""
    n = len(x)
    if not n:
        return np.zeros((k, x.shape[1]))
    step = max(1, n // min(k, n))
    centres = x[[min(i * step, n - 1) if i < n else 0 for i in range(k)]].astype(np.float64)
    for _ in range(rounds):
        d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]
        near = d.argmin(axis=1)
        new = centres.copy()
        for j in np.unique(near):
            new[j] = x[near == j].mean(axis=0)
        done = np.abs(new - centres).max() < eps
        centres = new
        if done:
            break
    return centres


def sample(df: DataFrame, c: Columns, rows: int = TRAIN_ROWS) -> np.ndarray:
    part = df.where(F.col(c.data).isNotNull()).orderBy(F.xxhash64(c.id), c.id).limit(rows).select(F.col(c.data).cast("array<double>").alias("v"), F.col(c.id).alias("i")).toPandas().sort_values("i")
    return np.stack(part["v"].to_numpy()) if len(part) else np.empty((0, 0))


class ProductQuantizer:
    """``segments`` parts of a vector, each replaced by the number of its nearest centre."""

    def __init__(self, codebooks: list[np.ndarray]):
        self.codebooks = codebooks

    @classmethod
    def train(cls, df: DataFrame, segments: int, centres: int = 256, c: Columns = Columns(), rows: int = TRAIN_ROWS) -> "ProductQuantizer":
        """The segments are learned in parallel, one task each, from one bounded sample."""
        x = sample(df, c, rows)
        if not x.size or x.shape[1] % segments:
            raise ConfigurationError(f"{x.shape[1] if x.size else 0} dimensions can't be cut into {segments} segments")
        if not 0 < centres <= 256:
            raise ConfigurationError("a codebook has 1 to 256 centres")
        spark, width = df.sparkSession, x.shape[1] // segments
        shared = spark.sparkContext.broadcast(x)

        def learn(batches):
            for pdf in batches:
                for s in pdf["id"]:
                    book = k_means(shared.value[:, s * width : (s + 1) * width], centres)
                    yield pd.DataFrame({"segment": s, "code": range(centres), "centre": list(book)})

        books = spark.range(segments, numPartitions=segments).mapInPandas(learn, "segment bigint, code int, centre array<double>").orderBy("segment", "code").toPandas()
        return cls([np.stack(g["centre"].to_numpy()) for _, g in books.groupby("segment")])

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(s, i, [float(v) for v in row]) for s, b in enumerate(self.codebooks) for i, row in enumerate(b)], "segment int, code int, centre array<double>")

    def encode(self, df: DataFrame, c: Columns = Columns()) -> DataFrame:
        books = self.codebooks
        width = books[0].shape[1]

        def code(batches):
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["data"].to_numpy()).astype(np.float64)
                    codes = np.stack([((x[:, None, i * width : (i + 1) * width] - b[None]) ** 2).sum(axis=2).argmin(axis=1) for i, b in enumerate(books)], axis=1)
                    yield pd.DataFrame({"id": pdf["id"], "codes": list(codes.astype(np.int16))})

        rows = df.where(F.col(c.data).isNotNull()).select(F.col(c.id).alias("id"), F.col(c.data).alias("data"))
        return rows.mapInPandas(code, f"id {rows.schema['id'].dataType.simpleString()}, codes array<smallint>")

    def decode(self, encoded: DataFrame) -> DataFrame:
        books = F.array(*(F.array(*(F.lit([float(v) for v in row]).cast("array<double>") for row in b)) for b in self.codebooks))
        return encoded.select("id", F.flatten(F.transform("codes", lambda x, i: F.get(F.get(books, i), x.cast("int")))).alias("data"))


class IvfIndex:
    """Rows by their nearest of ``cells`` coarse centres; a search reads only the cells nearest to the query."""

    def __init__(self, df: DataFrame, centres: np.ndarray, c: Columns):
        self.centres, self.c = centres, c
        shared = centres

        @F.pandas_udf("int")
        def cell(v: pd.Series) -> pd.Series:
            return pd.Series(block_distances(np.stack(v.to_numpy()).astype(np.float64), shared, "euclidean").argmin(axis=1))

        self.rows = df.where(F.col(c.data).isNotNull()).withColumn("cell", cell(F.col(c.data)))

    @classmethod
    def build(cls, df: DataFrame, cells: int = 32, c: Columns = Columns(), rows: int = TRAIN_ROWS) -> "IvfIndex":
        return cls(df, k_means(sample(df, c, rows), cells), c)

    def save(self, path: str) -> "IvfIndex":
        """Write the rows by cell, so that a search's cells are pruned partitions."""
        spark = self.rows.sparkSession
        self.rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
        self.rows = spark.read.parquet(path)
        return self

    @staticmethod
    def nearest_cells(centres: np.ndarray, query: Sequence[float], probe: int) -> list[int]:
        return [int(i) for i in block_distances(np.asarray([query], np.float64), centres, "euclidean")[0].argsort(kind="stable")[:probe]]

    def search(self, query: Sequence[float], k: int = 10, probe: int = 8, by: str = "cosine", where=None) -> DataFrame:
        return knn(self.rows.where(F.col("cell").isin(self.nearest_cells(self.centres, query, probe))), query, k, by, where, 0, self.c)

    def search_batch(self, queries: DataFrame, k: int = 10, probe: int = 8, by: str = "cosine", query_id: str = "qid", query_vector: str = "query") -> DataFrame:
        """``qid, id, distance, rank`` of the k nearest rows of each query within the ``probe`` cells nearest to it; queries without a vector have none."""
        return self._near(queries, k, probe, by, query_id, query_vector).drop("cell")

    def probes(self, queries: DataFrame, k: int = 10, recall: float = 0.9, by: str = "cosine", query_id: str = "qid", query_vector: str = "query") -> int:
        """The fewest cells that find the share ``recall`` of the k nearest rows, measured by an exact search for TRIED of the queries.

        Of more queries than these, two standard errors of the mean are taken off what was measured.
        """
        if not 0 < recall <= 1:
            raise InvalidInput("a recall is above 0 and at most 1")
        some = queries.where(F.col(query_vector).isNotNull())
        n = some.count()
        some = some.orderBy(F.xxhash64(query_id), query_id).limit(TRIED)
        tried = some.select(F.col(query_id).alias("qid"), F.col(query_vector).cast("array<double>").alias("query")).toPandas()
        true = self._near(queries.sparkSession.createDataFrame(tried.assign(qid=range(len(tried)))), k, len(self.centres), by).select("qid", "cell").toPandas() if len(tried) else tried
        if not len(true):
            return len(self.centres)
        order = block_distances(np.stack(tried["query"].to_numpy()), self.centres, "euclidean").argsort(axis=1, kind="stable")
        place = order.argsort(axis=1)[true["qid"], true["cell"]]
        of = true.groupby("qid").size()
        for probe in range(1, len(self.centres)):
            found = np.bincount(true["qid"], place < probe, minlength=len(tried))[of.index] / of.to_numpy()
            error = found.std(ddof=1) / np.sqrt(len(found)) * np.sqrt(1 - len(tried) / n) if n > len(tried) else 0
            if found.mean() - 2 * error >= recall - 1e-9:
                return probe
        return len(self.centres)

    def _near(self, queries: DataFrame, k: int, probe: int, by: str, query_id: str = "qid", query_vector: str = "query") -> DataFrame:
        """As ``batch_knn``, with the products of a row only for the queries that probe its cell."""
        spark, name, c, centres = queries.sparkSession, metric(by), self.c, self.centres
        rows = self.rows.select(F.col(c.id).alias("id"), F.col(c.data).alias("data"), "cell")
        kind = T.StructType([T.StructField("qid", queries.schema[query_id].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])
        found = spark.createDataFrame([], kind)
        for ids, q in query_blocks(queries.where(F.col(query_vector).isNotNull()), query_id, query_vector):
            if q.shape[1] != centres.shape[1]:
                raise InvalidDimension(centres.shape[1], q.shape[1])
            probed = np.zeros((len(q), len(centres)), bool)
            np.put_along_axis(probed, block_distances(q, centres, "euclidean").argsort(axis=1, kind="stable")[:, :probe], True, axis=1)
            shared = spark.sparkContext.broadcast((ids, q, probed))

            def near(batches, shared=shared):
                ids, q, probed = shared.value
                for pdf in batches:
                    parts = []
                    for cell, rows in pdf.sort_values("id", kind="stable").groupby("cell"):  # sorted, so that ties go to the smaller id
                        ask = np.flatnonzero(probed[:, cell])
                        x = np.stack(rows["data"].to_numpy()).astype(np.float64)
                        d = block_distances(q[ask], x, name)
                        top = k_nearest(d, k)
                        parts.append(pd.DataFrame({"at": np.repeat(ask, top.shape[1]), "id": rows["id"].to_numpy()[top].ravel(), "cell": cell, "distance": np.take_along_axis(d, top, 1).ravel()}))
                    if parts:
                        best = pd.concat(parts).sort_values(["at", "distance", "id"]).groupby("at").head(k)
                        yield best.assign(qid=ids[best["at"].to_numpy()])[["qid", "id", "cell", "distance"]]

            found = found.unionByName(rows.mapInPandas(near, kind))
        w = W.partitionBy("qid").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
