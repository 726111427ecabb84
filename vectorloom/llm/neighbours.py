"""The most similar vectors for every vector, by collision counting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize
from .kernels import matrix, nearest
from .vectors import BLOCK_ROWS, groups, usable_vectors

#: A set of equal vectors of more than k + 1 members is represented by its k + 1 smallest ids in the search.
SALTS = 32


def similar_vectors(vectors: DataFrame, k: int = 5, least: float = 0.86, dims: int = 64, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``collection, id, other, similarity``: for each usable vector its up to ``k`` most similar ones of the same collection.

    Ids are packed (see ``pack_id``). Similarity is the cosine in double precision to 6 decimals, ``least`` or more; ties go to the smaller id. A vector without such a
    neighbour gives no row. Null, empty, non-finite, zero or otherwise unusable data is left out; an empty table gives no rows.
    """
    u = materialize(usable_vectors(vectors, dims), "usable")
    keys = u.select("collection", "id", F.xxhash64("data").alias("h"), F.xxhash64(F.lit(1), "data").alias("g"))
    same = ["collection", "h", "g"]
    many = keys.groupBy(*same).agg(F.count("*").alias("n")).where(F.col("n") > k + 1).drop("n")
    extra = None
    if not many.isEmpty():
        # equal vectors see the same neighbours: beyond the first k + 1 they copy the last of those
        members = keys.join(many, same, "left_semi")
        first = members.withColumn("r", F.row_number().over(W.partitionBy(*same).orderBy("id"))).where(F.col("r") <= k + 1)
        model = first.where(F.col("r") == k + 1).select(*same, F.col("id").alias("model"))
        salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        model = model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        extra = materialize(salted.join(model, [*same, "salt"]).where(F.col("id") > F.col("model")).select("collection", "id", "model"), "equal")
        u = materialize(u.join(extra.select("collection", "id"), ["collection", "id"], "left_anti"), "distinct")

    def search(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["id"]))
        seed = table["cell"][0].as_py() if len(table) else 0  # each cell draws its own projections, so a pair that one misses is tried anew in the next
        q, o, s = nearest(matrix(table["data"]), k, least, seed)
        ids = table["id"].combine_chunks()
        name = table["collection"].combine_chunks()
        return pa.table({"collection": name.take(pa.array(q)), "id": ids.take(pa.array(q)), "other": ids.take(pa.array(o)), "similarity": pa.array(s)})

    g = groups(u.select("collection", "id", "data"), block_rows)
    found = g.groupBy("collection", "cell", "a", "b").applyInArrow(search, "collection string, id binary, other binary, similarity double")
    best = found.dropDuplicates(["collection", "id", "other"])
    order = W.partitionBy("collection", "id").orderBy(F.desc("similarity"), "other")
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    if extra is not None:
        best = materialize(best, "found")
        salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
        models = best.join(extra.select("collection", F.col("model").alias("id")).distinct(), ["collection", "id"], "left_semi")
        models = models.select("collection", F.col("id").alias("model"), "other", "similarity").withColumn("salt", salt)
        copies = extra.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(models, ["collection", "model", "salt"])
        best = best.unionByName(copies.select("collection", "id", "other", "similarity"))
    return best


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.86, dims: int = 64, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id_a, id_b`` (packed, a before b), each pair once, of which at least one is among the ``k`` most similar of the other."""
    n = similar_vectors(vectors, k, least, dims, block_rows)
    return n.select("collection", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "similarity").dropDuplicates(["collection", "id_a", "id_b"])


def exact_neighbours(x: np.ndarray, k: int, least: float) -> set[tuple[int, int]]:
    """Brute force for tests: pairs (row, other) of unit rows."""
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    out = set()
    for i, row in enumerate(s):
        order = np.lexsort((np.arange(len(row)), -row))[:k]
        out |= {(i, int(j)) for j in order if row[j] >= least}
    return out
