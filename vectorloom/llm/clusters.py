"""Grouping records into similarity clusters by power-iteration spectral clustering.

1. Records meet in groups of bounded size (see ``vectors.groups``). Sparse affinities of a group: links of similarity ``least`` or more, weighted by the cosine,
   of which a hot set of g mutually similar records takes a few times g.
2. Several vectors, one entry a record, are multiplied by the normalised affinities (half a step of the random walk, half staying), all groups
   at once, until the clusters no longer change. They approach the eigenvectors of the eigenvalue 1, which are constant on each linked set.
3. k-means clusters the rows of this embedding, with as many centres as it has clumps.
4. An exact check follows (see ``kernels.spectral_sets``): clusters that links join are merged, clusters that links don't hold together are parted; ``spectral_report``
   tells how many clusters were right as they stood. Clusters of several groups that share a record are one.
5. Members are ranked by their internal affinity, the mean cosine to the other members, computed from the sum of the unit vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize
from .kernels import k_means, matrix, spectral_sets
from .vectors import BLOCK_ROWS, groups, usable_vectors

#: More equal vectors than these are represented by one while links are sought; their joins are spread over so many salts.
COPIES, SALTS = 6, 32


def group_clusters(u: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``collection, id, low`` of each record that is linked to another in one of its groups: the smallest id of its cluster there."""

    def cluster(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["id"]))
        root, _ = spectral_sets(matrix(table["data"]), least)
        at = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        ids, name = table["id"].combine_chunks(), table["collection"].combine_chunks()
        return pa.table({"collection": name.take(pa.array(at)), "id": ids.take(pa.array(at)), "low": ids.take(pa.array(root[at]))})

    g = groups(u.select("collection", "id", "data"), block_rows)
    return g.groupBy("collection", "cell", "a", "b").applyInArrow(cluster, "collection string, id binary, low binary")


def spectral_report(vectors: DataFrame, least: float = 0.86, dims: int = 64, block_rows: int = BLOCK_ROWS, cluster=k_means) -> DataFrame:
    """``collection, sets, right, parted, across`` summed over the groups: what the exact check finds (see ``kernels.spectral_sets``)."""
    names = ("sets", "right", "parted", "across")

    def look(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["id"]))
        _, m = spectral_sets(matrix(table["data"]), least, cluster)
        return pa.table({"collection": table["collection"].combine_chunks()[:1], **{n: pa.array([m[n]], pa.int64()) for n in names}})

    u = materialize(usable_vectors(vectors, dims), "usable")
    g = groups(u.select("collection", "id", "data"), block_rows)
    found = g.groupBy("collection", "cell", "a", "b").applyInArrow(look, "collection string, " + ", ".join(f"{n} bigint" for n in names))
    return found.groupBy("collection").agg(*(F.sum(n).alias(n) for n in names))


def connect(edges: DataFrame, label: str) -> DataFrame:
    """``node, low`` of each node of ``edges`` (a, b): the smallest node linked to it, directly or through others.

    Alternating large-star and small-star steps: each node's neighbours are pointed at the smallest, so the number of rounds
    grows with the logarithm of the longest path; a round is two aggregations, and no set is ever collected.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    e = materialize(e, label)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        e = materialize(small.select("e.*").where("a != b").distinct(), label)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return e.select(F.col("a").alias("node"), F.col("b").alias("low"))


def similarity_clusters(vectors: DataFrame, least: float = 0.86, dims: int = 64, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, usable): members has ``collection, id, cluster_id``, one row for each record linked to another; ids are packed.

    Two records of a collection are linked at a cosine of ``least`` or more; a cluster is a linked set of two or more, named by its
    smallest id. Records with unusable data are left out; an empty table gives no rows.
    """
    u = materialize(usable_vectors(vectors, dims), "usable")
    extra = equal_copies(u, COPIES)
    if extra is None:
        return _members(u, least, block_rows), u
    # of many equal vectors the first stands for all, so a hot set of copies isn't compared with itself
    found = materialize(_members(materialize(u.join(extra.select("collection", "id"), ["collection", "id"], "left_anti"), "distinct"), least, block_rows), "members")
    models = extra.select("collection", F.col("model").alias("id")).distinct().join(found, ["collection", "id"], "left")
    models = materialize(models.select("collection", "id", F.coalesce("cluster_id", "id").alias("cluster_id"), F.col("cluster_id").isNull().alias("alone")), "models")
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    named = models.select("collection", F.col("id").alias("model"), "cluster_id", salts.alias("salt"))
    copies = extra.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(named, ["collection", "model", "salt"])
    found = found.unionByName(models.where("alone").select("collection", "id", "cluster_id"))
    return found.unionByName(copies.select("collection", "id", "cluster_id")), u


def equal_copies(u: DataFrame, most: int) -> DataFrame | None:
    """``collection, id, model`` of all but the first of more than ``most`` equal vectors of a collection, the model being the first; None if there are none."""
    keys = u.select("collection", "id", F.xxhash64("data").alias("h"), F.xxhash64(F.lit(1), "data").alias("g"))
    same = ["collection", "h", "g"]
    many = materialize(keys.groupBy(*same).agg(F.count("*").alias("n"), F.min("id").alias("model")).where(F.col("n") > most).drop("n"), "many")
    if many.isEmpty():
        return None
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    rows = keys.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(many, [*same, "salt"])
    return materialize(rows.where("id != model").select("collection", "id", "model"), "equal")


def _members(u: DataFrame, least: float, block_rows: int) -> DataFrame:
    own = group_clusters(u, least, block_rows).groupBy("collection", "id").agg(F.min("low").alias("low"), F.collect_set("low").alias("lows"))
    own = materialize(own, "own")
    # a record's groups are few (see ``groups``), and where they name its cluster differently the clusters are one
    key = lambda c: F.struct("collection", F.col(c).alias("id"))
    apart = own.where(F.size("lows") > 1).select("collection", "low", F.explode("lows").alias("other")).where("low != other").distinct()
    merged = connect(apart.select(key("low").alias("a"), key("other").alias("b")), "merge")
    merged = merged.select(F.col("node.collection").alias("collection"), F.col("node.id").alias("low"), F.col("low.id").alias("to"))
    final = own.select("collection", "id", "low").join(merged, ["collection", "low"], "left")
    return final.select("collection", "id", F.coalesce("to", "low").alias("cluster_id"))


def describe_clusters(members: DataFrame, usable: DataFrame, typical: int = 3) -> DataFrame:
    """``collection, cluster_id, size, affinity, rank, id, member_affinity``: each cluster's size, mean affinity and ``typical`` most typical members.

    A member's affinity is its mean cosine to the others, (u . sum(u) - 1) / (size - 1); ties (at 9 decimals) go to the smaller id.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    norm = F.sqrt(F.aggregate("data", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = members.join(usable.select("collection", "id", "data"), ["collection", "id"]).withColumn("norm", norm)
    rows = rows.select("collection", "cluster_id", "id", F.transform("data", lambda x: x.cast("double") / F.col("norm")).alias("u"))
    sums = rows.groupBy("collection", "cluster_id").agg(F.count("*").alias("size"), vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("total"))
    dot = F.aggregate(F.zip_with("u", "total", lambda a, b: a * b), F.lit(0.0).cast("double"), lambda a, x: a + x)
    rows = rows.join(sums, ["collection", "cluster_id"]).select("collection", "cluster_id", "id", "size", ((dot - 1) / (F.col("size") - 1)).alias("member_affinity"))
    means = rows.groupBy("collection", "cluster_id").agg(F.avg("member_affinity").alias("affinity"))
    w = W.partitionBy("collection", "cluster_id").orderBy(F.desc(F.round("member_affinity", 9)), "id")
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)
    return top.join(means, ["collection", "cluster_id"]).select("collection", "cluster_id", "size", "affinity", "rank", "id", "member_affinity")
