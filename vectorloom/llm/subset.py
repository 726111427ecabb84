"""Choosing a varied subset: distributed farthest-first k-center."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize
from .kernels import SEED, farthest_first, matrix
from .vectors import usable_vectors

#: A block holds at most about so many rows; as many as a FANIN-th of it can be chosen at once, so each round shrinks the pool FANIN times.
BLOCK_ROWS, FANIN = 4096, 4
SALTS = 16


def group_value(metadata: Column, key: Column) -> Column:
    """A metadata key's value without case and outer blanks; null where the key is null, absent, null or in damaged JSON."""
    text = F.when(F.try_parse_json(metadata).isNotNull(), F.call_function("get_json_object", metadata, F.concat(F.lit("$['"), key, F.lit("']"))))
    return F.lower(F.regexp_replace(text, "^\\s+|\\s+$", ""))


def water_fill(g: DataFrame, key: list[str], order: list[Column], held: Column, *ties: Column) -> DataFrame:
    """``g`` (a row a group, with ``n``) and ``share``: ``held`` places spread evenly over the groups of a key, what small groups can't fill going to the larger ones.

    With the groups in ascending size, a group is taken whole as long as it is no larger than an even share of what is left; the
    others get that share, the first of them by ``ties`` one more until the places are met. ``order`` tells groups of a size apart.
    """
    g = g.withColumn("k_", held.cast("bigint"))
    up = W.partitionBy(*key).orderBy("n", *order)
    g = g.withColumn("before_", F.coalesce(F.sum("n").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    g = g.withColumn("others_", F.count("*").over(W.partitionBy(*key)) - F.row_number().over(up) + 1)
    whole = F.col("n") * F.col("others_") <= F.col("k_") - F.col("before_")
    first = F.min(F.when(~whole, F.struct("before_", "others_"))).over(W.partitionBy(*key))
    g = g.withColumn("whole_", whole).withColumn("cut_", first)
    left = F.col("k_") - F.col("cut_.before_")
    share, more = F.floor(left / F.col("cut_.others_")), left % F.col("cut_.others_")
    place = F.row_number().over(W.partitionBy(*key).orderBy(*ties))
    g = g.withColumn("share", F.when(F.col("whole_"), F.col("n")).otherwise(share + (place <= more).cast("int")).cast("bigint"))
    return g.drop("k_", "before_", "others_", "whole_", "cut_")


def reserves(rows: DataFrame) -> DataFrame:
    """``request_id, grp, reserve``: half of the size, or a place for each group if that is more (the whole size at most), spread evenly
    over the groups (see ``water_fill``), larger groups first, ties by value, rows without a value last.
    """
    g = rows.groupBy("request_id", "grp").agg(F.count("*").alias("n"), F.first("subset_size").alias("s"))
    held = F.greatest(F.ceil(F.col("s") / 2), F.least(F.col("s"), F.count("*").over(W.partitionBy("request_id"))))
    g = water_fill(g, ["request_id"], [F.desc("grp")], held, F.col("grp") == "", F.desc("n"), F.col("grp"))
    return g.select("request_id", "grp", F.col("share").alias("reserve"))


def _choose(table: pa.Table) -> pa.Table:
    table = table.take(pc.sort_indices(table["id"]))
    group = table["grp"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    reserve = np.zeros(int(group.max()) + 1, np.int64)
    reserve[group] = table["reserve"].to_numpy()
    rows, dist = farthest_first(matrix(table["data"]).astype(np.float32), table["quota"][0].as_py(), reserve, group)
    out = table.take(pa.array(rows))
    columns = {c: out[c] for c in table.column_names if c != "block"}
    return pa.table(columns | {"rank": pa.array(np.arange(1, len(rows) + 1)), "distance": pa.array(dist.astype(np.float64))})


_POOL = "request_id int, part string, id binary, data array<float>, quota bigint, grp string, reserve bigint"


def _k_center(pool: DataFrame, block_rows: int) -> DataFrame:
    """``quota`` rows of each part (request_id, part), farthest first within blocks, pooled, and chosen again until a pool fits one block.

    A part's quota is at most block_rows / FANIN, or the part is no larger than a block: so no task sees more than a block.
    """
    names = [c.split()[0] for c in _POOL.split(", ")]
    while True:
        n = pool.groupBy("request_id", "part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        n = materialize(n, "counts")
        blocks = n.agg(F.max("blocks")).first()[0] or 1
        cut = pool.select(*names).join(n, ["request_id", "part"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        pool = cut.groupBy("request_id", "part", "block").applyInArrow(_choose, _POOL + ", rank bigint, distance double")
        if blocks == 1:
            return pool
        pool = materialize(pool, "pool")


def _nearest_representative(rows: pa.Table, reps: pa.Table) -> pa.Table:
    """The rows with the representative they are nearest to; among equally near ones a row's own choice, so copies spread evenly."""
    names = [c.split()[0] for c in _POOL.split(", ")]
    rows = rows.select(names)
    if not rows.num_rows or not reps.num_rows:
        return rows.slice(0, 0).append_column("rep", pa.array([], pa.int32()))
    rows, reps = rows.take(pc.sort_indices(rows["id"])), reps.take(pc.sort_indices(reps["id"]))
    near = np.round(matrix(rows["data"]).astype(np.float32) @ matrix(reps["data"]).astype(np.float32).T, 5)
    best = near == near.max(axis=1, keepdims=True)
    turn = np.random.default_rng(SEED).random(len(near))  # a place among the equally near, row by row
    wanted = (turn * best.sum(axis=1)).astype(np.int64) + 1
    rep = (np.cumsum(best, axis=1) >= wanted[:, None]).argmax(axis=1).astype(np.int32)
    return rows.append_column("rep", pa.array(rep))


def _solve(parts: DataFrame, block_rows: int) -> DataFrame:
    """The chosen rows of all parts with ``rank`` and ``distance`` within their (last) part. ``parts`` must be cheap to read again.

    A part of more than a block whose quota a block can't choose is split by its own representatives (a k-center of block_rows / FANIN rows): each row goes to the
    nearest one's part, and the quota is spread evenly over the parts, small ones being taken whole, so large groups don't weigh more. A part that is wanted
    whole is split by hash.
    """
    names = [c.split()[0] for c in _POOL.split(", ")]
    most, done = max(1, block_rows // FANIN), []
    while True:
        n = materialize(parts.groupBy("request_id", "part").agg(F.count("*").alias("n"), F.first("quota").alias("q")), "parts")
        fits = (F.col("n") <= block_rows) | (F.col("q") <= most)
        small = parts.join(n.where(fits).select("request_id", "part"), ["request_id", "part"], "left_semi")
        done.append(materialize(_k_center(small, block_rows), "chosen"))
        if n.where(~fits).isEmpty():
            break
        pieces = []
        whole = n.where(~fits & (F.col("q") >= F.col("n"))).select("request_id", "part", F.ceil(F.col("n") / block_rows * 2).alias("m"))
        whole = parts.join(whole, ["request_id", "part"]).withColumn("part", F.concat_ws("/", "part", F.concat(F.lit("h"), F.pmod(F.xxhash64("id"), F.col("m")).cast("string"))))
        pieces.append(whole.withColumn("quota", F.lit(2 * block_rows).cast("bigint")).select(*names))
        large = n.where(~fits & (F.col("q") < F.col("n"))).select("request_id", "part", "q", F.ceil(F.col("n") / block_rows).alias("m"))
        rows = parts.join(large.drop("q"), ["request_id", "part"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("m"))).drop("m")
        reps = materialize(_k_center(rows.drop("block").withColumn("quota", F.lit(most).cast("bigint")), block_rows), "representatives")
        reps = reps.select("request_id", "part", "id", "data").join(large.drop("q"), ["request_id", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))).drop("m")
        key = ["request_id", "part", "block"]
        near = rows.groupBy(*key).cogroup(reps.groupBy(*key)).applyInArrow(_nearest_representative, _POOL + ", rep int")
        near = materialize(near, "nearest")
        shares = near.groupBy("request_id", "part", "rep").agg(F.count("*").alias("n"), F.first("quota").alias("q"))
        shares = water_fill(shares, ["request_id", "part"], [F.col("rep")], F.col("q"), F.desc("n"), F.col("rep"))  # at most ``most`` rows a part
        near = near.drop("quota").join(shares.select("request_id", "part", "rep", F.col("share").alias("quota")), ["request_id", "part", "rep"])
        near = near.where("quota > 0").withColumn("part", F.concat_ws("/", "part", F.col("rep").cast("string")))
        pieces.append(near.select(*names))
        parts = materialize(pieces[0].unionByName(pieces[1]), "split")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _ranked(chosen: DataFrame) -> DataFrame:
    """One order of each request's rows: first the first of each part, then the second ones, and so on. The windows are over numbers of rows a rank, and over the parts."""
    per_rank = chosen.groupBy("request_id", "stage", "rank").agg(F.count("*").alias("n"))
    up = W.partitionBy("request_id").orderBy("stage", "rank").rowsBetween(W.unboundedPreceding, -1)
    per_rank = per_rank.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).drop("n")
    place = F.row_number().over(W.partitionBy("request_id", "stage", "rank").orderBy("part"))
    return chosen.join(per_rank, ["request_id", "stage", "rank"]).withColumn("rank", F.col("before") + place)


def varied_subsets(vectors: DataFrame, requests: DataFrame, dims: int = 64, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``request_id, rank, id (packed), grp, distance`` of the subset of each request (request_id, collection, subset_size, group_key).

    Representatives are chosen farthest first (by cosine distance) within blocks, pooled, and chosen again, until a pool fits one
    block and the last choice gives the subset. A size that one block can't choose is parted among the surroundings of representatives (see ``_solve``), so no
    task sees more than a block, whatever the size and the collection; ``distance`` is then that to the rows chosen before in the same part. With a
    group key about half of the size is reserved for its values evenly (see ``reserves``), a missing value being one of them, served after the others. The first
    place of a value is kept whatever its vectors are like; no further one is spent on a vector near a chosen one. Large sets of similar vectors don't count more than small ones: what is near a chosen vector is chosen last.

    Only usable vectors are chosen, each once; a size above what a collection holds gives all of it; a size that is null or
    below 1, a null or unknown collection, and empty tables give no rows. A request that occurs twice counts once.
    """
    asked = requests.select("request_id", "collection", "subset_size", "group_key").where(F.col("subset_size") >= 1).dropDuplicates(["request_id"])
    rows = usable_vectors(vectors, dims, "metadata").join(asked, "collection")
    rows = rows.select("request_id", "id", "data", "subset_size", F.coalesce(group_value(F.col("metadata"), F.col("group_key")), F.lit("")).alias("grp"))
    rows = materialize(rows, "asked")
    # written, the reserves have a known size: small ones are broadcast, others joined over salts for the sake of a hot value
    held = materialize(reserves(rows.select("request_id", "grp", "subset_size")), "reserves")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pool = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(held, ["request_id", "grp", "salt"]).drop("salt")
    pool = pool.select("request_id", F.lit("").alias("part"), "id", "data", F.col("subset_size").cast("bigint").alias("quota"), "grp", "reserve")
    n = materialize(rows.groupBy("request_id").agg(F.count("*").alias("n"), F.first("subset_size").alias("s")), "sizes")
    large = n.where((F.col("n") > block_rows) & (F.col("s") > block_rows // FANIN)).select("request_id")
    out = _k_center(pool.join(large, "request_id", "left_anti"), block_rows).select("request_id", "rank", "id", "grp", "distance")
    if large.isEmpty():
        return out
    # of large sizes the reserved places are chosen first, a part for each value; then what is left of the size among all other rows
    pool = materialize(pool.join(large, "request_id", "left_semi"), "large")
    first = _solve(pool.where("reserve > 0").withColumn("part", F.col("grp")).withColumn("quota", F.col("reserve")), block_rows)
    taken = materialize(first.groupBy("request_id").agg(F.count("*").alias("taken")), "taken")
    rest = pool.join(first.select("request_id", "id"), ["request_id", "id"], "left_anti").join(taken, "request_id").withColumn("quota", F.col("quota") - F.col("taken")).drop("taken")
    rest = materialize(rest.where("quota > 0").withColumn("reserve", F.lit(0).cast("bigint")).select(*[c.split()[0] for c in _POOL.split(", ")]), "rest")
    both = first.withColumn("stage", F.lit(0)).unionByName(_solve(rest, block_rows).withColumn("stage", F.lit(1)))
    return out.unionByName(_ranked(both).select("request_id", "rank", "id", "grp", "distance"))
