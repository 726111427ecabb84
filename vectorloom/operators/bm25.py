"""BM25 over postings (doc, term, tf). Terms are words or numbers; the length of a document is the number of its distinct terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F

from ..session import materialize

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, term, tf``, counted before the shuffle."""
    return docs.select(F.col(doc).alias("doc"), F.explode(tokens(F.col(text))).alias("term")).groupBy("doc", "term").agg(F.count("*").cast("double").alias("tf"))


def sparse_postings(rows: DataFrame, doc: str, sparse: str) -> DataFrame:
    return rows.select(F.col(doc).alias("doc"), F.explode(F.arrays_zip(F.col(f"{sparse}.indices").alias("term"), F.col(f"{sparse}.values").alias("tf"))).alias("p")).select("doc", "p.term", "p.tf")


def corpus_stats(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df), and one row (n, avg_len) over the documents that have terms."""
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    lengths = p.groupBy("doc").agg(F.count("*").alias("len"))
    return df, lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def search(p: DataFrame, query: dict, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """``doc, score`` of the k best documents for {term: weight}; a term that no document has adds nothing, ties go to the smaller doc.

    Only the postings of the query's terms are scored; df comes from them too.
    """
    spark = p.sparkSession
    if not query:
        return p.select("doc", F.lit(0.0).alias("score")).limit(0)
    q = spark.createDataFrame(list(query.items()), f"term {p.schema['term'].dataType.simpleString()}, weight double")
    lengths = p.groupBy("doc").agg(F.count("*").alias("len"))
    total = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    hits = p.join(F.broadcast(q), "term")  # a query's terms
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    hits = hits.join(F.broadcast(df), "term").join(lengths, "doc").crossJoin(F.broadcast(total))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))) * F.col("weight")
    return hits.groupBy("doc").agg(F.sum(score).alias("score")).orderBy(F.desc("score"), "doc").limit(k)


def _score(df: Column, tf: Column, n: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def search_texts(docs: DataFrame, query: dict[str, float], k: int = 10, doc: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """The same over texts, each document once, without an index: one scan, which writes the numbers of the documents that have a term and observes the statistics of all. For
    many queries over the same texts build a ``Bm25Index``.
    """
    if not query:
        return docs.select(F.col(doc).alias("doc"), F.lit(0.0).alias("score")).limit(0)
    names = {t: f"tf{i}" for i, t in enumerate(query)}
    # the words of a text are bound once, in the lambda
    count = lambda t: F.struct(F.size(F.array_distinct(t)).alias("len"), *((F.size(t) - F.size(F.array_remove(t, term))).alias(n) for term, n in names.items()))
    rows = docs.select(F.col(doc).alias("doc"), F.inline(F.transform(F.array(tokens(F.col(text))), count))).where(F.col("len") > 0)
    seen = Observation()
    rows = rows.observe(seen, F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.sum((F.col(n) > 0).cast("bigint")).alias(f"df_{n}") for n in names.values()))
    hits = materialize(rows.where(sum((F.col(n) for n in names.values()), F.lit(0)) > 0), "hits")
    total = seen.get
    score = F.lit(0.0)
    for term, n in names.items():
        part = _score(F.lit(total[f"df_{n}"] or 0), F.col(n), F.lit(total["n"]), F.col("len"), F.lit(total["avg_len"]), k1, b)
        score = score + F.when(F.col(n) > 0, part * float(query[term])).otherwise(0.0)
    return hits.select("doc", score.alias("score")).orderBy(F.desc("score"), "doc").limit(k)


class Bm25Index:
    """Postings on disk, by buckets of terms and sorted by term, each with its document's length: a search reads the buckets of its terms, and of these the
    row groups that may hold them.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    def build(self, docs: DataFrame, doc: str = "doc_id", text: str = "text", buckets: int = BUCKETS, salts: int = 64) -> "Bm25Index":
        """Write the index; texts without terms, and null ones, aren't documents of it. A document that comes in several rows counts as their union."""
        words = docs.select(F.col(doc).alias("doc"), F.explode(tokens(F.col(text))).alias("term"))
        # a frequent term's postings are spread over ``salts`` parts of its bucket by document
        tf = words.groupBy("doc", "term").agg(F.count("*").cast("double").alias("tf"))
        tf = tf.withColumn("len", F.count("*").over(W.partitionBy("doc"))).withColumn("bucket", self.bucket(F.col("term"), buckets))
        tf = tf.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc"), F.lit(salts))).sortWithinPartitions("bucket", "term", "doc")
        tf.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tf.schema)
        lengths = self.spark.read.schema(kind).parquet(f"{self.path}/postings").select("doc", "len").distinct()
        stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), F.lit(buckets).alias("buckets"), F.lit(kind).alias("kind"))
        stats.write.mode("overwrite").parquet(f"{self.path}/stats")
        return self

    def search(self, query: dict[str, float], k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
        """``doc, score`` of the k best documents; as ``search``."""
        stats = self.spark.read.parquet(f"{self.path}/stats").first()
        p = self.spark.read.schema(stats["kind"]).parquet(f"{self.path}/postings")
        if not query:
            return p.select("doc", F.lit(0.0).alias("score")).limit(0)
        terms = list(query)
        places = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self.bucket(F.col("term"), stats["buckets"])).distinct().collect()]  # as many as the query has terms
        hits = p.where(F.col("bucket").isin(places) & F.col("term").isin(terms))
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        weight = F.create_map(*(F.lit(x) for t in terms for x in (t, float(query[t]))))
        score = _score(F.col("df"), F.col("tf"), F.lit(stats["n"]), F.col("len"), F.lit(stats["avg_len"]), k1, b) * F.element_at(weight, F.col("term"))
        return hits.join(F.broadcast(df), "term").groupBy("doc").agg(F.sum(score).alias("score")).orderBy(F.desc("score"), "doc").limit(k)
