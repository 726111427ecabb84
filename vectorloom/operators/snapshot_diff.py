"""What changed between full snapshots of a table.

Each key's rows are windowed by the index of their snapshot: the hash of the row before reveals a change, and a gap in the
indexes reveals a removal and a later addition. All snapshots are compared in one pass, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.canonical import canonical_json, content_hash, numbers_text
from ..functions.ids import epoch_seconds, plain_name, plain_uuid


def snapshot_order(manifest: DataFrame) -> DataFrame:
    """``snapshot_name, collection, idx, last_idx, next_name`` of each snapshot.

    Snapshots of a collection follow each other by ``created_at``, ties by name; a snapshot named several times counts once, at its
    smallest time. Rows without name, collection or time are left out. Manifests hold a row for each snapshot, not for each record.
    """
    m = manifest.select(F.col("name").alias("snapshot_name"), plain_name(F.col("collection")).alias("collection"), epoch_seconds(F.col("created_at")).alias("at"))
    m = m.dropna().groupBy("snapshot_name", "collection").agg(F.min("at").alias("at"))
    w = W.partitionBy("collection").orderBy("at", "snapshot_name")
    return m.select(
        "snapshot_name", "collection", F.row_number().over(w).alias("idx"), F.count("*").over(W.partitionBy("collection")).alias("last_idx"), F.lead("snapshot_name").over(w).alias("next_name")
    )


def snapshot_changes(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """``snapshot_name, collection, id, change`` for every two consecutive snapshots of each collection.

    ``rows`` has snapshot_name, id, data and metadata; other columns are ignored. Ids are compared in plain form; a row without id or
    of a snapshot that the manifest doesn't name is left out. A row that a snapshot holds several times counts once (if the copies differ, the one with the smallest hash). Data
    compares by numeric value, metadata as JSON values; null equals null only. An empty snapshot is one of the manifest without
    rows: everything before it is removed.
    """
    order = snapshot_order(manifest)
    r = rows.select(
        "snapshot_name",
        plain_uuid(F.col("id")).alias("id"),
        content_hash(numbers_text(F.col("data")), canonical_json(F.col("metadata"))).alias("hash"),
    ).where(F.col("id").isNotNull())
    # copies are dropped before the manifest's columns are added: it halves what is shuffled
    once = r.groupBy("snapshot_name", "id").agg(F.min("hash").alias("hash"))
    k = once.join(order, "snapshot_name")
    w = W.partitionBy("collection", "id").orderBy("idx")
    k = k.select("snapshot_name", "next_name", "collection", "id", "idx", "last_idx", "hash", F.lag("idx").over(w).alias("p"), F.lag("hash").over(w).alias("p_hash"), F.lead("idx").over(w).alias("n"))
    came = (
        F.when((F.col("idx") > 1) & (F.col("p").isNull() | (F.col("p") < F.col("idx") - 1)), "added")
        .when((F.col("p") == F.col("idx") - 1) & (F.col("p_hash") != F.col("hash")), "changed")
    )
    went = F.when((F.col("idx") < F.col("last_idx")) & (F.col("n").isNull() | (F.col("n") > F.col("idx") + 1)), "removed")
    events = F.array(
        F.struct(F.col("snapshot_name").alias("snapshot_name"), came.alias("change")),
        F.struct(F.col("next_name").alias("snapshot_name"), went.alias("change")),
    )
    return (
        k.select("collection", "id", F.explode(F.filter(events, lambda e: e["change"].isNotNull())).alias("e"))
        .select(F.col("e.snapshot_name").alias("snapshot_name"), "collection", "id", F.col("e.change").alias("change"))
    )
