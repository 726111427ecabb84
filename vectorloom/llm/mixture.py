"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source's documents fall into blocks by a hash. What a source must give, in tokens, is met by whole passes over its blocks,
   then by whole blocks in a random order, then by single documents of one last block: sizes are met to half a document.
2. The blocks of all sources are dealt to output shards: a tree halves the shards again and again, and draws how many blocks
   of each source go left from the multivariate hypergeometric distribution. So each shard has the composition of a random sample without
   replacement, all blocks are dealt exactly once, and no more than a table of counts is ever in one place.
3. A shard takes the next blocks of each source's random order, and is shuffled by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.ids import plain_name
from ..session import materialize
from .encode import TOKENIZERS, encode_texts

BLOCK_DOCS, SHARD_BLOCKS, SEED = 256, 64, 11
#: Blocks of a source that are put in order by one task.
RANGE_BLOCKS = 4096


def deal(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """How many of ``counts[s]`` blocks of source s go to each of ``shards`` shards of (nearly) equal size: an array [shard, source].

    The number of blocks must stay under 10^9 (``numpy``'s bound for this distribution).
    """
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    ends = np.arange(shards + 1) * total // shards
    out = np.zeros((shards, len(counts)), np.int64)
    stack = [(0, shards, counts)]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])  # a node's draw doesn't depend on the order of the walk
        left = rng.multivariate_hypergeometric(have, int(ends[mid] - ends[lo])) if have.sum() else have
        stack += [(lo, mid, left), (mid, hi, have - left)]
    return out


def clean_targets(targets: DataFrame) -> DataFrame:
    """``mix, source, weight, max_repeats``: sources compared without case and outer blanks, each once in a mix (the greatest values count).

    A weight that is null, negative or not finite is 0; null repeats are 1.
    """
    w, r = F.col("weight"), F.col("max_repeats")
    t = targets.where(F.col("mix").isNotNull() & F.col("source").isNotNull())
    t = t.select("mix", plain_name(F.col("source")).alias("source"), F.when((w > 0) & (w < float("inf")), w).otherwise(0.0).alias("weight"), F.coalesce(r, F.lit(1)).alias("max_repeats"))
    return t.groupBy("mix", "source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


def token_sizes(documents: DataFrame, targets: DataFrame, name: str, folder: str) -> DataFrame:
    """``doc_id, source, tokens`` of the documents of the sources that a mix wants; documents without tokens or source are left out."""
    wanted = clean_targets(targets).where("weight > 0 AND max_repeats > 0").select("source").distinct()
    d = documents.select("doc_id", plain_name(F.col("source")).alias("source"), "text").join(wanted, "source", "left_semi")
    return encode_texts(d, "doc_id", "text", "tokens", counts=True, name=name, folder=folder, keep=("source",)).where("tokens > 0")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """``mix, source, weight, max_repeats, share, available, wanted`` in tokens.

    The total of a mix is the largest at which every source meets its share within its repeats (or ``total_tokens`` if that is
    less). A source without documents, weight or repeats can't take part: its share is null and the other weights are scaled up.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    t = clean_targets(targets).join(have, "source", "left")
    can = (F.col("weight") > 0) & (F.col("max_repeats") > 0) & F.col("available").isNotNull()
    w = W.partitionBy("mix")
    t = t.withColumn("share", F.when(can, F.col("weight") / F.sum(F.when(can, F.col("weight"))).over(w)))
    most = F.min(F.col("available") * F.col("max_repeats") / F.col("share")).over(w)
    most = F.least(most, F.lit(float("inf") if total_tokens is None else float(total_tokens)))
    return t.withColumn("wanted", F.col("share") * most).select("mix", "source", "weight", "max_repeats", "share", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("wanted", F.lit(0.0)).alias("wanted"))


def _in_order(units: DataFrame, range_blocks: int) -> DataFrame:
    """Each unit's place (from 1) and the tokens before it, in the order of ``order`` within its pass (mix, source, copy).

    Prefix sums in two steps: the order's hash is cut into ranges of about ``range_blocks`` units; the ranges' sums are added up, and each range by itself.
    """
    key = ["mix", "source", "copy"]
    ranges = F.ceil(F.col("blocks") / range_blocks)
    units = units.withColumn("range", F.least(ranges - 1, F.floor((F.col("order") / 2.0**64 + 0.5) * ranges)))
    sums = units.groupBy(*key, "range").agg(F.count("*").alias("n"), F.sum("block_tokens").alias("t"))
    up = W.partitionBy(*key).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(up), F.lit(0))
    sums = sums.select(*key, "range", before("n").alias("n_before"), before("t").alias("t_before"))
    within = W.partitionBy(*key, "range").orderBy("order", "block")
    units = units.join(sums, [*key, "range"]).withColumn("place", F.col("n_before") + F.row_number().over(within))
    inner = F.coalesce(F.sum("block_tokens").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return units.withColumn("tokens_before", F.col("t_before") + inner).drop("range", "n_before", "t_before")


def draw(sizes: DataFrame, planned: DataFrame, block_docs: int = BLOCK_DOCS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """``mix, shard, position, doc_id, source, copy, tokens``: the documents of each mix, in shards that are each in random order.

    ``sizes`` (doc_id, source, tokens) must be cheap to read again. ``copy`` counts a document's uses from 1.
    """
    n = sizes.groupBy("source").agg(F.ceil(F.count("*") / block_docs).alias("n_blocks"))
    docs = sizes.join(n, "source").select("doc_id", "source", "tokens", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_blocks")).alias("block"))
    blocks = materialize(docs.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens")), "blocks")
    q = planned.where("wanted > 0").select("mix", "source", "wanted", "available", "max_repeats")
    passes = F.least(F.floor(F.col("wanted") / F.col("available") + 1e-9), F.col("max_repeats").cast("bigint"))
    q = q.withColumn("whole", passes).withColumn("rest", F.when(F.col("whole") < F.col("max_repeats"), F.greatest(F.col("wanted") - F.col("whole") * F.col("available"), F.lit(0.0))).otherwise(0.0))
    per_source = materialize(blocks.groupBy("source").agg(F.count("*").alias("blocks")), "per_source")
    units = q.join(blocks, "source").join(per_source, "source").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("whole") + 1)))
    units = _in_order(units.withColumn("order", F.xxhash64(F.lit(seed), "mix", "source", "copy", "block")), range_blocks)
    # the last pass takes blocks as long as there is room for tokens
    last = F.col("copy") > F.col("whole")
    units = units.withColumn("room", F.col("rest") - F.col("tokens_before"))
    units = units.where(~last | (F.col("room") > 0)).withColumn("room", F.when(last & (F.col("room") < F.col("block_tokens")), F.col("room")))
    units = units.withColumn("unit", (F.col("copy") - 1) * F.col("blocks") + F.col("place"))
    units = materialize(units.select("mix", "source", "copy", "block", "unit", "room"), "units")

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source").reset_index(drop=True)
        shards = max(1, -(-int(pdf["units"].sum()) // shard_blocks))
        dealt = deal(pdf["units"].to_numpy(), shards, seed)
        ends = np.cumsum(dealt, axis=0)
        shard, source = np.nonzero(dealt)
        return pd.DataFrame({"mix": pdf["mix"].iloc[0], "source": pdf["source"].to_numpy()[source], "shard": shard, "lo": ends[shard, source] - dealt[shard, source] + 1, "hi": ends[shard, source]})

    dealt = units.groupBy("mix", "source").agg(F.count("*").alias("units")).groupBy("mix").applyInPandas(split, "mix string, source string, shard bigint, lo bigint, hi bigint")
    to = dealt.select("mix", "source", "shard", F.explode(F.sequence("lo", "hi")).alias("unit"))
    drawn = units.join(to, ["mix", "source", "unit"]).join(docs, ["source", "block"])
    within = W.partitionBy("mix", "source", "copy", "block").orderBy(F.xxhash64(F.lit(seed + 1), "mix", "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    whole = drawn.where(F.col("room").isNull())
    part = drawn.where(F.col("room").isNotNull()).withColumn("upto", F.sum("tokens").over(within) - F.col("tokens") / 2).where("upto <= room").drop("upto")
    drawn = whole.unionByName(part)
    shuffled = W.partitionBy("mix", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "mix", "doc_id", "copy"), "doc_id", "copy")
    return drawn.select("mix", "shard", F.row_number().over(shuffled).cast("bigint").alias("position"), "doc_id", "source", "copy", "tokens")


def mix_documents(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(drawn, planned): see ``draw`` and ``plan``. Sizes are tokens of a public tokenizer; empty tables give no rows."""
    sizes = materialize(token_sizes(documents, targets, name, folder), "sizes")
    planned = materialize(plan(sizes, targets, total_tokens), "plan")
    return draw(sizes, planned), planned


def mix_report(drawn: DataFrame, planned: DataFrame) -> DataFrame:
    """Each source of each mix: its target and its actual share of the tokens, its documents, draws and most uses of one document."""
    uses = drawn.groupBy("mix", "source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    s = uses.groupBy("mix", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.sum("uses").alias("draws"), F.max("uses").alias("most_uses"))
    r = planned.join(s, ["mix", "source"], "left").fillna(0, ["tokens", "documents", "draws", "most_uses"])
    all_weight, all_tokens = F.sum("weight").over(W.partitionBy("mix")), F.sum("tokens").over(W.partitionBy("mix"))
    return r.select(
        "mix", "source", F.round(F.try_divide("weight", all_weight), 6).alias("target_share"), F.round(F.coalesce("share", F.lit(0.0)), 6).alias("reachable_share"),
        F.round(F.coalesce(F.try_divide("tokens", all_tokens), F.lit(0.0)), 6).alias("actual_share"), "available", "tokens", "documents", "draws", "most_uses", "max_repeats",
    )
