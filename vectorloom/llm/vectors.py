"""Usable vectors, and their bounded groups in which every similar pair meets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import plain_uuid
from ..session import materialize
from .kernels import SEED, matrix, nearest_centres, spread

#: Rows of one block of a group. A group is one or two blocks.
BLOCK_ROWS = 32_768
#: Beyond so many coarse cells of a collection (some 100 million rows), cells grow instead.
MOST_CELLS = 4096


def pack_id(c: Column) -> Column:
    """An id in few bytes whose order is that of the text: ``u`` and the 16 bytes of a UUID in plain form, or ``t`` and the text."""
    uuid = c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(uuid, F.concat(F.lit(b"u"), F.unhex(F.replace(c, F.lit("-"), F.lit(""))))).otherwise(F.concat(F.lit(b"t"), c.cast("binary")))


def unpack_id(c: Column) -> Column:
    rest = F.substring(c, 2, 1 << 30)
    h = F.lower(F.hex(rest))
    plain = F.concat_ws("-", *(F.substring(h, *at) for at in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(F.substring(c, 1, 1) == F.lit(b"u"), plain).otherwise(rest.cast("string"))


def usable_vectors(vectors: DataFrame, dims: int = 64, *extra: str) -> DataFrame:
    """``collection, id, data``: each id of a collection once, in packed form.

    Usable is data of exactly ``dims`` finite elements that aren't all zero. Rows without id or collection are left out. Of
    several usable rows of an id the last by ``ingested_at`` counts. ``extra`` columns come from the same row.
    """
    square = F.aggregate(F.col("data"), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = vectors.select("collection", plain_uuid(F.col("id")).alias("id"), "data", "ingested_at", *extra)
    rows = rows.where(F.col("collection").isNotNull() & F.col("id").isNotNull() & (F.size("data") == dims))
    rows = rows.withColumn("square", square).where((F.col("square") > 0) & (F.col("square") < float("inf")))
    rows = rows.select("collection", pack_id(F.col("id")).alias("id"), F.struct("data", *extra).alias("r"), "ingested_at")
    last = rows.groupBy("collection", "id").agg(F.max_by("r", F.struct("ingested_at", F.xxhash64("r"))).alias("r"))
    return last.select("collection", "id", "r.*")


def cells_for(n: Column, block_rows: int) -> Column:
    """Into how many coarse cells a collection of ``n`` rows is cut: as many as need the fewest copies of a row, at most MOST_CELLS.

    With C cells a row is in ``spread(C)`` of them, and in each of those in a group with every other block of the cell.
    """
    blocks = lambda c: F.ceil(n * (spread(c) / c / block_rows))
    copies = lambda c: F.greatest(F.lit(1).cast("bigint"), blocks(c) - 1) * spread(c)
    return F.array_min(F.array(*(F.struct(copies(1 << i).alias("copies"), F.lit(1 << i).alias("cells")) for i in range(MOST_CELLS.bit_length()))))["cells"]


def groups(u: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``u`` with the key ``collection, cell, a, b`` of each group a row belongs to. ``u`` must be cheap to read again.

    A row is in the coarse cells whose random directions it is most similar to, as many as it takes that a pair at a similarity of 0.86 has one in common but
    for 0.4 % (see ``kernels.spread``). A cell of more than a block is cut into blocks by the hash of the id, and each two blocks form a
    group: no row is dropped, and no group holds more than about two blocks. The number of cells follows from the collection's size by one formula;
    a small collection has one, and each copy of a row goes through one shuffle.
    """
    # written, the counts and the sizes have a known size, so they are broadcast as long as they are small, and the vectors aren't shuffled for them
    counts = materialize(u.groupBy("collection").agg(F.count("*").alias("n")), "counts")
    rows = u.join(counts.select("collection", cells_for(F.col("n"), block_rows).alias("cells")), "collection")
    # the cells are found twice, which costs less than to write each copy of each vector
    sizes = _cut(rows.select("collection", "data", "cells")).groupBy("collection", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("m"))
    sizes = materialize(sizes, "cells")
    rows = _cut(rows).join(sizes, ["collection", "cell"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    others = F.when(F.col("m") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda b: b != F.col("own")))
    rows = rows.withColumn("o", F.explode(others))
    return rows.select(*u.columns, "cell", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"))


def _cut(rows: DataFrame) -> DataFrame:
    """The rows, once for each coarse cell; without an id only the collection and the cell."""
    kept = [c for c in rows.columns if c != "cells"] if "id" in rows.columns else ["collection"]
    schema = rows.select(*kept, F.lit(0).alias("cell")).schema

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t, cells = pa.Table.from_batches([batch]), batch["cells"].to_numpy()
            x = matrix(t["data"]).astype(np.float32) if cells.max() > 1 else None
            t = t.select(kept)
            for c in np.unique(cells):
                at = np.flatnonzero(cells == c)
                top = nearest_centres(x[at], int(c), SEED + 7) if c > 1 else np.zeros((len(at), 1), np.int32)
                out = t.take(pa.array(np.repeat(at, top.shape[1])))
                yield from out.append_column("cell", pa.array(top.ravel())).to_batches()

    return rows.mapInArrow(cut, schema)
