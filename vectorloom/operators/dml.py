"""Changes of a table of vectors as DataFrames: each returns the new state, so a store can commit it as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..errors import InvalidDimension


def check_dimension(rows: DataFrame, dim: int, data: str = "data") -> DataFrame:
    """The rows, failing when run if a vector is null or not of ``dim`` elements."""
    n = F.coalesce(F.size(F.col(data)), F.lit(-1))
    bad = F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), n.cast("string")))
    return rows.withColumn(data, F.when(n == dim, F.col(data)).otherwise(bad.cast(rows.schema[data].dataType)))


def validate(rows: DataFrame, dim: int, id_: str = "id", data: str = "data") -> DataFrame:
    """``id, verdict`` of each row to insert: ok, null_id, null_data or wrong_dimension."""
    v = F.when(F.col(id_).isNull(), "null_id").when(F.col(data).isNull(), "null_data").when(F.size(data) != dim, "wrong_dimension").otherwise("ok")
    return rows.select(F.col(id_).alias("id"), v.alias("verdict"))


def require_dimension(rows: DataFrame, dim: int, data: str = "data") -> None:
    """All or nothing: raise before anything is written."""
    bad = rows.where(F.col(data).isNull() | (F.size(data) != dim)).select(F.coalesce(F.size(data), F.lit(-1))).first()
    if bad is not None:
        raise InvalidDimension(dim, bad[0])


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by ``order``, nulls first; rows are reduced before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*(o.desc_nulls_last() for o in order))
    return rows.withColumn("latest_rank_", F.row_number().over(w)).where("latest_rank_ = 1").drop("latest_rank_")


def upsert(base: DataFrame, new: DataFrame, key: str = "id", *order: Column) -> DataFrame:
    """New rows replace those of the same key; of several new rows of a key the last by ``order`` counts."""
    new = latest(new, [key], *(order or (F.xxhash64(*[F.col(c).cast("string") for c in new.columns if c != key]),)))
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def delete(base: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(what stays, the distinct ids that were there)."""
    ids = ids.select(key).distinct()
    return base.join(ids, key, "left_anti"), base.join(ids, key, "left_semi").select(key).distinct()


def replay(log: DataFrame, key: str, seq: str, is_delete: Column) -> DataFrame:
    """The state after an operation log: the last operation of each key by ``seq``, unless that is a delete. Replaying twice changes nothing."""
    return latest(log.withColumn("is_delete_", is_delete), [key], F.col(seq)).where("NOT is_delete_").drop("is_delete_")


def checksum(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows, checksum``: independent of the order of the rows, and of how they are partitioned."""
    h = F.xxhash64(*(columns or rows.columns))
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("sum")).select(
        "rows", F.concat_ws("-", F.hex("xor"), F.col("sum").cast("string")).alias("checksum")
    )


def consistency(rows: DataFrame, dim: int, id_: str = "id", data: str = "data") -> DataFrame:
    """One row: how many rows, null vectors, wrong dimensions and superfluous rows of an id a table has."""
    per_id = rows.groupBy(id_).agg(
        F.count("*").alias("n"), F.sum(F.col(data).isNull().cast("bigint")).alias("nulls"), F.sum((F.col(data).isNotNull() & (F.size(data) != dim)).cast("bigint")).alias("wrong")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return per_id.agg(zero(F.sum("n")).alias("row_count"), zero(F.sum("nulls")).alias("null_data"), zero(F.sum("wrong")).alias("wrong_dimension"), zero(F.sum(F.col("n") - 1)).alias("duplicate_ids"))


def retention(rows: DataFrame, at: str, now: Column, hours: float) -> DataFrame:
    """The rows older than so many hours; exactly as old isn't older."""
    return rows.where((now.cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double")) > hours * 3600)


def newest(rows: DataFrame, keys: list[str], at: str, keep: int, *ties: str) -> DataFrame:
    """``keep`` newest rows of each key."""
    w = W.partitionBy(*keys).orderBy(F.desc(at), *ties)
    return rows.withColumn("newest_rank_", F.row_number().over(w)).where(F.col("newest_rank_") <= keep).drop("newest_rank_")


def shard(id_: Column, shards: int) -> Column:
    """The shard of an id: its MD5 in plain text form, first 32 bits, modulo the number of shards; any engine can compute it."""
    return (F.conv(F.substring(F.md5(id_.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % shards).cast("int")


def replicas(shard_: Column, copies: int, nodes: int) -> Column:
    """The nodes that hold a shard: the next ``copies`` ones from its own on, each once."""
    return F.transform(F.sequence(F.lit(0), F.lit(min(copies, nodes) - 1)), lambda r: ((shard_ + r) % nodes).cast("int"))


def ring_nodes(id_: Column, nodes: list[str], copies: int = 1, points: int = 64) -> Column:
    """The ``copies`` nodes of an id on a consistent-hash ring: the owners of the next points from the id's hash on, each node once.

    A node has ``points`` points on the ring, at the MD5 of ``node#i``. If a node leaves, only the ids that it held move. The ring is a literal of the plan, sorted once.
    """
    import hashlib

    at = sorted((int(hashlib.md5(f"{n}#{i}".encode()).hexdigest()[:8], 16), n) for n in nodes for i in range(points))
    # for each point the nodes from there on
    owners = [list(dict.fromkeys(n for _, n in at[i:] + at[:i]))[:copies] for i in range(len(at))]
    ring = F.array(*(F.lit(p).cast("bigint") for p, _ in at))
    held = F.array(*(F.array(*(F.lit(n) for n in o)) for o in owners))
    h = F.conv(F.substring(F.md5(id_.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    behind = F.size(F.filter(ring, lambda p: p < h))
    return F.get(held, F.when(behind == len(at), 0).otherwise(behind))
