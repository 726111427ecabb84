"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from .encode import decode_ids, encode_texts
from .clusters import describe_clusters, similarity_clusters
from .mixture import mix_documents, mix_report
from .neighbours import similar_pairs, similar_vectors
from .subset import group_value, varied_subsets
from .toxicity import THRESHOLD, source_rates, toxicity_scores
from .vectors import unpack_id, usable_vectors


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = similarity_clusters(table(spark, sf_dir, "vectors"))
    return members.select(unpack_id(F.col("cluster_id")).alias("cluster_id"), unpack_id(F.col("id")).alias("id"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster by its size and its three most typical members."""
    d = describe_clusters(*similarity_clusters(table(spark, sf_dir, "vectors")))
    return d.select("collection", unpack_id(F.col("cluster_id")).alias("cluster_id"), "size", F.round("affinity", 6).alias("affinity"), "rank", unpack_id(F.col("id")).alias("id"), F.round("member_affinity", 6).alias("member_affinity"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(table(spark, sf_dir, "vectors"))
    return pairs.select(unpack_id(F.col("id_a")).alias("id_a"), unpack_id(F.col("id_b")).alias("id_b"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list itself: each vector's five most similar with their similarity."""
    n = similar_vectors(table(spark, sf_dir, "vectors"))
    return n.select("collection", unpack_id(F.col("id")).alias("id"), unpack_id(F.col("other")).alias("other"), "similarity")


def p3_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen vectors of every request, in the order of choice."""
    s = varied_subsets(table(spark, sf_dir, "vectors"), table(spark, sf_dir, "subset_requests"))
    return s.select("request_id", F.col("rank").cast("bigint").alias("rank"), unpack_id(F.col("id")).alias("id"), "grp", F.round("distance", 6).alias("distance"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document decoded again, and whether that gives its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = decode_ids(encode_texts(docs), out="decoded")
    return docs.join(decoded, "doc_id").select("doc_id", F.length("decoded").cast("bigint").alias("n_chars"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of every mix."""
    return mix_report(*mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), keep=())
    return s.where(F.col("p_toxic") >= THRESHOLD).select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores."""
    s = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))
    return s.select("doc_id", "source", *(F.round(c, 4).alias(c) for c in s.columns if c.startswith("p_")))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of each source."""
    return source_rates(toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels")))


def p3_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each request: how many were chosen, whether each counts once and is of the collection, and how many values of the key have a place."""
    vectors, requests = table(spark, sf_dir, "vectors"), table(spark, sf_dir, "subset_requests")
    usable = usable_vectors(vectors, 64, "metadata").join(requests.dropDuplicates(["request_id"]).select("request_id", "collection", "group_key"), "collection")
    chosen = varied_subsets(vectors, requests).join(usable.select("request_id", "id", group_value(F.col("metadata"), F.col("group_key")).alias("value")), ["request_id", "id"], "left")
    c = chosen.groupBy("request_id").agg(F.count("*").alias("chosen"), F.count_distinct("id").alias("different"), F.count_distinct("value").alias("values"))
    return c.select("request_id", "chosen", (F.col("chosen") == F.col("different")).alias("once"), "values")


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each mix and source: whether its tokens are its share to a document, and whether no document is drawn too often."""
    drawn, planned = mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    drawn = drawn.select("mix", "source", "doc_id", "tokens")
    longest = drawn.groupBy("mix", "source").agg(F.max("tokens").alias("longest"))
    r = mix_report(drawn, planned).join(planned.select("mix", "source", "wanted"), ["mix", "source"]).join(longest, ["mix", "source"], "left")
    met = F.abs(F.col("tokens") - F.col("wanted")) <= F.coalesce("longest", F.lit(0)) / 2 + 1
    return r.select("mix", "source", met.alias("met"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: its documents, and whether its rates are those of its scores."""
    s = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))
    r = source_rates(s)
    ok = (F.col("rate") == F.round(F.col("toxic") / F.col("documents"), 6)) & F.col("rate").between(0, 1)
    return r.select("source", "documents", ok.alias("rate_of_scores"))


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters, "p3_subsets": p3_subsets, "p3_check": p3_check, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_drawn": p7_drawn, "p7_shares": p7_shares, "p7_check": p7_check, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates, "p8_check": p8_check}
from .oracles import SQL  # noqa: E402, F401
