"""Fusion of two ranked lists (id, score; higher is better)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

RRF_K = 60


def _scaled(df: DataFrame, bounds, name: str) -> DataFrame:
    """Scores from 0 to 1 between two bounds; 0.5 where the bounds meet. The lists are top-k results, so the bounds come from a window over them: each list is evaluated once."""
    lo, hi = bounds(W.partitionBy(F.lit(0)))
    scaled = F.when(F.col("hi") == F.col("lo"), F.lit(0.5)).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return df.select("id", "score", lo.alias("lo"), hi.alias("hi")).select("id", scaled.alias(name))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "id", "full_outer").select("id", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), (F.col("a") + F.col("b")) / 2).otherwise(F.coalesce("a", "b")).alias("score"))


def relative_score(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """The mean of both lists' scores scaled by their least and greatest; an id of one list keeps that list's score."""
    bounds = lambda w: (F.min("score").over(w), F.max("score").over(w))
    return _both(_scaled(dense, bounds, "a"), _scaled(sparse, bounds, "b"))


def distribution_based(dense: DataFrame, sparse: DataFrame, deviations: float | None = None) -> DataFrame:
    """As ``relative_score``; with ``deviations`` the bounds are the mean plus and minus so many standard deviations."""
    if deviations is None:
        return relative_score(dense, sparse)
    def bounds(w):
        mean, spread = F.avg("score").over(w), F.stddev_pop("score").over(w)
        return mean - deviations * spread, mean + deviations * spread

    return _both(_scaled(dense, bounds, "a"), _scaled(sparse, bounds, "b"))


def reciprocal_rank(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """The sum of 1 / (k + rank) over the lists, ranks from 1 and ties to the smaller id. The lists are top-k results, ranked in one task."""
    w = W.orderBy(F.desc("score"), "id")
    parts = [df.select("id", (1.0 / (k + F.row_number().over(w))).alias("part")) for df in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


FUSIONS = {"relative_score": relative_score, "rrf": reciprocal_rank, "distribution_based": distribution_based}


def hybrid(dense: DataFrame, sparse: DataFrame, k: int = 10, method: str = "relative_score") -> DataFrame:
    """The k best of both lists; ``dense`` holds distances (id, distance), which become similarities first."""
    similar = dense.select("id", (-F.col("distance")).alias("score"))
    return FUSIONS[method](similar, sparse).orderBy(F.desc("score"), "id").limit(k)
