"""Applying a stream of inserts, updates and deletes.

The log is kept as three append-only sets of files with sequence numbers, in the manner of equality-delete files: ``inserts``,
``vector_deletes`` and ``collection_deletes``, which are partitions of one table, so that a batch is read and written once and committed as a whole. Appending a batch needs no state and no look at earlier batches, so it is the
same for a batch job and a stream. A reader takes the last insert of each key and anti-joins it against later delete keys.

A row's sequence number is (timestamp in whole seconds, entry id in plain form). An entry that is delivered several times counts
once, at the smallest timestamp with which it came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ids import epoch_seconds, letters, plain_uuid

#: A collection's deletes are copied to so many salts, so that a collection that holds most rows is spread over as many tasks.
SALTS = 32

#: Spellings are reduced to letters first.
OPERATIONS = ("createcollection", "deletecollection", "insertvector", "batchinsert", "deletevector")


def normalize_entries(log: DataFrame) -> DataFrame:
    """The log with one spelling of operations, ids and times.

    Entries without an id, a collection or a known operation, and deliveries without a timestamp, are left out: such a delivery
    has no place in the order, and if its entry came with a timestamp too, that delivery counts. Other columns of ``log`` are ignored.
    """
    e = log.select(
        plain_uuid(F.col("id")).alias("entry_id"),
        epoch_seconds(F.col("timestamp")).alias("ts"),
        letters(F.col("operation")).alias("op"),
        F.col("collection"),
        plain_uuid(F.col("vector_id")).alias("vector_id"),
        F.col("vectors"),
    )
    return e.where(F.col("entry_id").isNotNull() & F.col("collection").isNotNull() & F.col("ts").isNotNull() & F.col("op").isin(*OPERATIONS))


#: Columns of the log's table; ``kind`` is its partition.
ROWS = "collection string, vector_id string, entry_id string, ts bigint, ordinal int, data array<float>, metadata string, kind string"


def changes_of(entries: DataFrame, payload: bool = True) -> DataFrame:
    """One row for each change of a delivery, with its ``kind``: a vector inserted (``ordinal`` is its place in the batch) or deleted, or a collection deleted.

    Vectors without an id are left out.
    """
    data = [v.alias(n) for n, v in (("data", F.lit(None).cast("array<float>")), ("metadata", F.lit(None).cast("string")))] if payload else []

    def insert(v: Column, i: Column) -> Column:
        return F.struct(F.lit("inserts").alias("kind"), plain_uuid(v["id"]).alias("vector_id"), i.cast("int").alias("ordinal"), *([v["data"].alias("data"), v["metadata"].alias("metadata")] if payload else []))

    def delete(kind: str, vector_id: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), vector_id.alias("vector_id"), F.lit(0).alias("ordinal"), *data))

    rows = F.when(F.col("op").isin("insertvector", "batchinsert"), F.transform("vectors", insert))
    rows = rows.when(F.col("op") == "deletevector", delete("vector_deletes", F.col("vector_id"))).when(F.col("op") == "deletecollection", delete("collection_deletes", F.lit(None).cast("string")))
    changes = entries.select("collection", "entry_id", "ts", F.explode(rows).alias("c"))
    return changes.where((F.col("c.kind") == "collection_deletes") | F.col("c.vector_id").isNotNull()).select("collection", "c.vector_id", "entry_id", "ts", *[f"c.{n}" for n in ("ordinal", "data", "metadata")[: 3 if payload else 1]], "c.kind")


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest sequence number of each key, an entry counting at its smallest time.

    Both steps aggregate before the shuffle, so neither a key nor an entry that holds most rows meets in one task.
    """
    once = rows.groupBy("entry_id", *keys).agg(F.min("ts").alias("ts"))
    return once.groupBy(*keys).agg(F.max(F.struct("ts", "entry_id")).alias("seq")).select(*keys, F.col("seq.ts").alias("ts"), F.col("seq.entry_id").alias("entry_id"))


def _later(a: Column, a_id: Column, b: Column, b_id: Column) -> Column:
    return (a > b) | ((a == b) & (a_id > b_id))


def live_keys(inserts: DataFrame, vector_deletes: DataFrame, collection_deletes: DataFrame) -> DataFrame:
    """``collection, vector_id, entry_id, ts`` of each live vector: its last insert, unless a later delete names it or its collection."""
    i = _last(inserts, ["collection", "vector_id"]).withColumn("salt", F.pmod(F.xxhash64("vector_id"), F.lit(SALTS)).cast("int")).alias("i")
    d = _last(vector_deletes, ["collection", "vector_id"]).alias("d")
    c = _last(collection_deletes, ["collection"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("c")
    col = F.col
    left = i.join(
        d,
        (col("i.collection") == col("d.collection")) & (col("i.vector_id") == col("d.vector_id")) & _later(col("d.ts"), col("d.entry_id"), col("i.ts"), col("i.entry_id")),
        "left_anti",
    )
    left = left.join(
        c,
        (col("i.collection") == col("c.collection")) & (col("i.salt") == col("c.salt")) & _later(col("c.ts"), col("c.entry_id"), col("i.ts"), col("i.entry_id")),
        "left_anti",
    )
    return left.select("collection", "vector_id", "entry_id", "ts")


def live_rows(inserts: DataFrame, keys: DataFrame) -> DataFrame:
    """The data and metadata of the live vectors: of a batch that names a vector twice, the later one."""
    k = keys.select("collection", "vector_id", "entry_id").alias("k")
    rows = inserts.alias("i").join(k, ["collection", "vector_id", "entry_id"], "left_semi")
    best = rows.groupBy("collection", "vector_id", "entry_id").agg(F.max_by(F.struct("data", "metadata"), "ordinal").alias("r"))
    return best.select("collection", "vector_id", "entry_id", F.col("r.data").alias("data"), F.col("r.metadata").alias("metadata"))


class ChangeLog:
    """The log's table under a path, a partition for each kind of change."""

    TABLES = ("inserts", "vector_deletes", "collection_deletes")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, log: DataFrame, payload: bool = True, mode: str = "append") -> "ChangeLog":
        """Append a batch of deliveries in one pass. Without ``payload`` the inserts hold keys only."""
        return self._write(changes_of(normalize_entries(log), payload), mode)

    def _write(self, changes: DataFrame, mode: str = "append") -> "ChangeLog":
        changes.write.mode(mode).option("compression", "zstd").partitionBy("kind").parquet(f"{self.path}/log")
        return self

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/log").where(F.col("kind") == name).drop("kind")

    def keys(self) -> DataFrame:
        return live_keys(*(self.read(t) for t in self.TABLES))

    def rows(self) -> DataFrame:
        return live_rows(self.read("inserts"), self.keys())

    def compact(self, path: str) -> "ChangeLog":
        """A new log that holds only the last insert of each live key, with its sequence number, and the last delete of each key: an entry that comes late may still precede it."""
        rows = self.rows().join(self.keys().select("collection", "vector_id", "ts"), ["collection", "vector_id"])
        new = rows.select("collection", "vector_id", "entry_id", "ts", F.lit(0).alias("ordinal"), "data", "metadata", F.lit("inserts").alias("kind"))
        for name, keys in (("vector_deletes", ["collection", "vector_id"]), ("collection_deletes", ["collection"])):
            new = new.unionByName(_last(self.read(name), keys).withColumn("kind", F.lit(name)), allowMissingColumns=True)
        return ChangeLog(self.spark, path)._write(new)
