"""Nearest neighbours and what is built on them.

A collection is a DataFrame with an id, a vector and a payload column; other columns are ignored. Ties go to the smaller id. Filters are applied before
the search, so a search gives k rows whenever that many match.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..errors import InvalidDimension, InvalidInput, NotFound
from ..functions import quantize as z
from ..functions.vector import discovery_vector, distance, metric, recommend_vector, vector
from ..plans.filters import compile_filter

#: Queries that are sent to every task at once (16 MB at 64 dimensions); more of them run as several passes, each of this bounded size.
QUERY_BLOCK = 32_768
#: Queries that a task multiplies with a batch of rows at a time.
QUERY_ROWS = 256
#: Rows of the smaller side of a matrix of all distances.
MATRIX_ROWS = 4096


@dataclass(frozen=True)
class Columns:
    id: str = "id"
    data: str = "data"
    metadata: str | None = "metadata"


def _kept(df: DataFrame, c: Columns, where: dict | Column | None) -> DataFrame:
    if where is None:
        return df
    return df.where(compile_filter(where, F.col(c.metadata)) if isinstance(where, dict) else where)


def knn(df: DataFrame, query: Sequence[float], k: int = 10, by: str = "cosine", where: dict | Column | None = None, offset: int = 0, c: Columns = Columns()) -> DataFrame:
    """``id, distance`` (and the payload) of the k nearest rows, nearest first, after ``offset`` of them. Null vectors aren't found."""
    if k < 0 or offset < 0:
        raise InvalidInput("limit and offset must not be negative")
    rows = _kept(df, c, where).where(F.col(c.data).isNotNull())
    out = rows.select(F.col(c.id).alias("id"), distance(F.col(c.data), query, by).alias("distance"), *([F.col(c.metadata).alias("metadata")] if c.metadata else []))
    ordered = out.orderBy("distance", "id")
    return (ordered.offset(offset) if offset else ordered).limit(k)


def knn_postfilter(df: DataFrame, query: Sequence[float], k: int, where: dict | Column, by: str = "cosine", oversample: int = 3, c: Columns = Columns()) -> DataFrame:
    """The filter after the search, on ``oversample`` times k rows: it may give fewer than k."""
    near = knn(df, query, k * oversample, by, None, 0, c)
    cond = compile_filter(where, F.col("metadata")) if isinstance(where, dict) else where
    return near.where(cond).orderBy("distance", "id").limit(k)


def query_blocks(queries: DataFrame, query_id: str, query_vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids and vectors of the queries, about QUERY_BLOCK at a time; as many as fit one block are fetched by one job."""
    asked = queries.select(F.col(query_id).alias("qid"), F.col(query_vector).cast("array<double>").alias("q"))
    first = asked.limit(QUERY_BLOCK + 1).toPandas()
    if len(first) <= QUERY_BLOCK:
        if len(first):
            yield first["qid"].to_numpy(), np.stack(first["q"].to_numpy())
        return
    blocks = -(-queries.count() // QUERY_BLOCK)
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    for b in range(blocks):
        block = numbered.where(F.col("block") == b).toPandas()
        if len(block):
            yield block["qid"].to_numpy(), np.stack(block["q"].to_numpy())


def k_nearest(d: np.ndarray, k: int) -> np.ndarray:
    """For each row of distances the places of the k least, least first, ties to the smaller place."""
    if k >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    if k < 1:
        return np.empty((len(d), 0), np.int64)
    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    take = d <= kth
    # of places that equal the k-th least as many as there is room for, the smaller first
    for row in np.flatnonzero(np.count_nonzero(take, axis=1) > k):
        equal = np.flatnonzero(d[row] == kth[row])
        take[row, equal[k - np.count_nonzero(d[row] < kth[row]) :]] = False
    top = np.nonzero(take)[1].reshape(len(d), k)
    return np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1)


def batch_knn(df: DataFrame, queries: DataFrame, k: int = 10, by: str = "cosine", c: Columns = Columns(), query_id: str = "qid", query_vector: str = "query") -> DataFrame:
    """``qid, id, distance, rank`` of the k nearest rows of each query.

    The queries are taken in blocks of QUERY_BLOCK; a block, of bounded size, is sent to every task, which multiplies it, some hundred queries at a time, with
    its rows and keeps k rows of each query; only those are shuffled. The rows are scanned once for each block.
    """
    spark = df.sparkSession
    name = metric(by)
    rows = df.select(F.col(c.id).alias("id"), F.col(c.data).alias("data")).where(F.col(c.data).isNotNull())
    kind = T.StructType([T.StructField("qid", queries.schema[query_id].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    parts = []
    for ids, q in query_blocks(queries, query_id, query_vector):
        shared = spark.sparkContext.broadcast((ids, q))

        def near(batches, shared=shared):
            ids, q = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                lengths = pdf["data"].map(len)
                if (lengths != q.shape[1]).any():
                    raise InvalidDimension(q.shape[1], int(lengths[lengths != q.shape[1]].iloc[0]))
                own = pdf["id"].to_numpy()
                order = np.argsort(own, kind="stable")  # so that ties go to the smaller id
                x, own = np.stack(pdf["data"].to_numpy()).astype(np.float64)[order], own[order]
                for at in range(0, len(q), QUERY_ROWS):
                    d = block_distances(q[at : at + QUERY_ROWS], x, name)
                    top = k_nearest(d, k)
                    yield pd.DataFrame({"qid": np.repeat(ids[at : at + QUERY_ROWS], top.shape[1]), "id": own[top].ravel(), "distance": np.take_along_axis(d, top, 1).ravel()})

        parts.append(rows.mapInPandas(near, kind))
    found = parts[0] if parts else spark.createDataFrame([], kind)
    for p in parts[1:]:
        found = found.unionByName(p)
    w = W.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def block_distances(q: np.ndarray, x: np.ndarray, by: str) -> np.ndarray:
    """All distances of two blocks."""
    if by == "manhattan":
        return np.stack([np.abs(x - one).sum(axis=1) for one in q]) if len(q) else np.empty((0, len(x)))
    dot = q @ x.T
    if by == "dot_product":
        return -dot
    if by == "euclidean":
        return np.stack([np.sqrt(((x - one) ** 2).sum(axis=1)) for one in q]) if len(q) else np.empty((0, len(x)))
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    return 1 - np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)


def quantized_distance(kind: str, data: Column, query: Sequence[float], by: str = "cosine") -> Column:
    """The distance as a quantizer sees it: of 8-bit codes decoded again, or the number of bits that differ (``kind``: scalar, binary)."""
    if kind == "binary":
        return z.hamming(z.binary_quantize(data, len(query))["words"], z.binary_quantize(vector(query), len(query))["words"]).cast("double")
    return F.round(distance(z.scalar_dequantize(z.scalar_quantize(data)), query, by), 9)


def distance_matrix(df: DataFrame, queries: DataFrame, by: str = "cosine", c: Columns = Columns(), query_id: str = "qid", query_vector: str = "query") -> DataFrame:
    """``qid, id, distance`` of every query and row, for a stated query set in one block."""
    if queries.limit(MATRIX_ROWS + 1).count() > MATRIX_ROWS:
        raise InvalidInput(f"a distance matrix takes at most {MATRIX_ROWS} queries; use batch_knn")
    q = F.broadcast(queries.select(F.col(query_id).alias("qid"), F.col(query_vector).alias("query")))
    rows = df.select(F.col(c.id).alias("id"), F.col(c.data).alias("data"))
    return rows.crossJoin(q).select("qid", "id", distance(F.col("query"), F.col("data"), by).alias("distance"))


def vectors_of(df: DataFrame, ids: Sequence, c: Columns = Columns()) -> dict:
    """The vectors of a few ids; ids that don't exist are absent."""
    rows = df.where(F.col(c.id).isin(list(ids))).select(c.id, c.data).dropDuplicates([c.id]).collect()
    return {r[0]: list(r[1]) for r in rows if r[1] is not None}


def recommend(df: DataFrame, positive: Sequence, negative: Sequence = (), k: int = 10, by: str = "cosine", where: dict | Column | None = None, offset: int = 0, strategy: str = "average", c: Columns = Columns()) -> DataFrame:
    """The rows nearest to what the positive examples have beyond the negative ones, the examples included.

    ``average`` searches with one vector, ``best_score`` takes the least distance to any positive. Missing ids are skipped; no positive at all is an error.
    """
    have = vectors_of(df, [*positive, *negative], c)
    pos, neg = [have[i] for i in positive if i in have], [have[i] for i in negative if i in have]
    if not pos:
        raise NotFound("none of the positive examples exists")
    if strategy == "best_score":
        rows = _kept(df, c, where).where(F.col(c.data).isNotNull())
        best = F.least(*(distance(F.col(c.data), p, by) for p in pos), *([distance(F.col(c.data), pos[0], by)] if len(pos) == 1 else []))
        ordered = rows.select(F.col(c.id).alias("id"), best.alias("distance")).orderBy("distance", "id")
        return (ordered.offset(offset) if offset else ordered).limit(k)
    q = recommend_vector(pos, neg)
    if q is None:
        raise InvalidInput("examples of unequal dimensions")
    return knn(df, q, k, by, where, offset, c)


def discover(df: DataFrame, target, context: Sequence[tuple] = (), k: int = 10, by: str = "cosine", where: dict | Column | None = None, offset: int = 0, c: Columns = Columns()) -> DataFrame:
    """The rows nearest to a target (an id or a vector) moved from the negative to the positive of each pair of ids; every id must exist."""
    given = isinstance(target, (list, tuple, np.ndarray))
    ids = [i for pair in context for i in pair] + ([] if given else [target])
    have = vectors_of(df, ids, c) if ids else {}
    if missing := [i for i in ids if i not in have]:
        raise NotFound(f"no vector of id {missing[0]}")
    q = discovery_vector(target if given else have[target], [(have[p], have[n]) for p, n in context])
    if q is None:
        raise InvalidInput("vectors of unequal dimensions")
    return knn(df, q, k, by, where, offset, c)


def scroll(df: DataFrame, limit: int = 10, offset: str | int | None = None, where: dict | Column | None = None, with_vectors: bool = True, with_payload: bool = True, after=None, c: Columns = Columns()) -> DataFrame:
    """A page of the rows in the order of their ids: ``id, score`` and what is asked for. An offset that isn't a number is 0; ``after`` continues behind an id, which costs no skipping."""
    rows = _kept(df, c, where)
    if after is not None:
        rows = rows.where(F.col(c.id) > after)
    try:
        skip = max(0, int(offset or 0))
    except ValueError:
        skip = 0
    out = rows.select(F.col(c.id).alias("id"), F.lit(0.0).alias("score"), *([F.col(c.data).alias("vector")] if with_vectors else []), *([F.col(c.metadata).alias("payload")] if with_payload and c.metadata else []))
    ordered = out.orderBy("id")
    return (ordered.offset(skip) if skip else ordered).limit(limit)


def count(df: DataFrame, where: dict | Column | None = None, exact: bool = True, c: Columns = Columns()) -> DataFrame:
    """How many rows match; not ``exact`` counts distinct ids approximately."""
    rows = _kept(df, c, where)
    return rows.agg((F.count("*") if exact else F.approx_count_distinct(c.id)).alias("count"))


def search_groups(df: DataFrame, query: Sequence[float], group: Column, group_size: int = 3, limit: int = 10, by: str = "cosine", where: dict | Column | None = None, c: Columns = Columns()) -> DataFrame:
    """``group_rank, grp, rank, id, distance``: the nearest rows of each of the groups that have the nearest rows. Rows without a group are left out."""
    rows = _kept(df, c, where).where(F.col(c.data).isNotNull() & group.isNotNull())
    near = rows.select(group.alias("grp"), F.col(c.id).alias("id"), distance(F.col(c.data), query, by).alias("distance"))
    w = W.partitionBy("grp").orderBy("distance", "id")
    near = near.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= group_size)
    best = near.where(F.col("rank") == 1).orderBy("distance", "id").limit(limit).select("grp", F.row_number().over(W.orderBy("distance", "id")).cast("bigint").alias("group_rank"))
    return near.join(best, "grp").select("group_rank", "grp", "rank", "id", "distance")


def facet(df: DataFrame, value: Column, limit: int = 10, where: Column | None = None) -> DataFrame:
    """``value, count`` of the most frequent values; ties go to the smaller value, null isn't one."""
    rows = df if where is None else df.where(where)
    return rows.select(value.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def prefetch_rescore(df: DataFrame, query: Sequence[float], prefetch: Sequence[Column], per_prefetch: int = 100, k: int = 10, by: str = "cosine", c: Columns = Columns()) -> DataFrame:
    """The exact k nearest among the rows that cheap first stages (columns of approximate distances) put first."""
    first = None
    for p in prefetch:
        part = df.select(F.col(c.id).alias("id"), p.alias("d")).orderBy("d", "id").limit(per_prefetch).select("id")
        first = part if first is None else first.unionByName(part)
    return knn(df.join(first.dropDuplicates().withColumnRenamed("id", c.id), c.id, "left_semi"), query, k, by, None, 0, c)
