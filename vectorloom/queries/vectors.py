"""Vector arithmetic, nearest neighbours and what is built on them."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import vector as v
from ..operators import search as s
from ..session import table
from .common import E, E_SQL, P, d_sql, embeddings, first_vector, r_sql, rounded, with_payload

QUERIES, SQL = {}, {}
_METRIC = {"cosine": "cosine", "euclidean": "euclidean", "dot": "dot_product", "manhattan": "manhattan"}
_RANKED = ", row_number() OVER (ORDER BY dist, vec_id) AS rk"


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _near(df):
    return df.select(F.col("id"), rounded(F.col("distance")).alias("distance"))


for _short, _by in _METRIC.items():

    @add(f"dist_{_short}", f"WITH {E_SQL} SELECT vec_id, {r_sql(d_sql(_by))} AS distance FROM e, q")
    def _dist(spark, sf, by=_by):
        return embeddings(spark, sf).select("vec_id", rounded(v.distance(F.col("embedding"), first_vector(spark, sf), by)).alias("distance"))

    @add(f"knn_{_short}", f"WITH {E_SQL} SELECT vec_id AS id, {r_sql('dist')} AS distance FROM (SELECT vec_id, {d_sql(_by)} AS dist FROM e, q) ORDER BY dist, vec_id LIMIT 10")
    def _knn(spark, sf, by=_by):
        return _near(s.knn(embeddings(spark, sf), first_vector(spark, sf), 10, by, c=E))


@add("batch_distances", f"WITH {E_SQL} SELECT vec_id, {r_sql(d_sql('cosine'))} AS cosine, {r_sql(d_sql('euclidean'))} AS euclidean, {r_sql(d_sql('dot_product'))} AS dot_product, {r_sql(d_sql('manhattan'))} AS manhattan FROM e, q")
def batch_distances(spark, sf):
    q = first_vector(spark, sf)
    return embeddings(spark, sf).select("vec_id", *(rounded(v.distance(F.col("embedding"), q, m)).alias(m) for m in v.METRICS))


@add("vector_magnitude", f"WITH {E_SQL} SELECT vec_id, {r_sql('sqrt(list_dot_product(d, d))')} AS magnitude FROM e")
def vector_magnitude(spark, sf):
    return embeddings(spark, sf).select("vec_id", rounded(v.magnitude(F.col("embedding"))).alias("magnitude"))


@add("vector_normalize", f"WITH {E_SQL}, n AS (SELECT vec_id, sqrt(list_dot_product(d, d)) AS m, unnest(d) AS x, unnest(range(len(d))) AS pos FROM e) SELECT vec_id, pos::BIGINT AS pos, {r_sql('CASE WHEN m = 0 THEN x ELSE x / m END')} AS x FROM n")
def vector_normalize(spark, sf):
    return embeddings(spark, sf).select("vec_id", F.posexplode(v.normalize(F.col("embedding"))).alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("x")).alias("x"))


@add("vector_stats", f"WITH {E_SQL} SELECT vec_id, {r_sql('list_avg(d)')} AS mean, {r_sql('list_stddev_pop(d)')} AS std, {r_sql('sqrt(list_dot_product(d, d))')} AS magnitude FROM e")
def vector_stats(spark, sf):
    x = F.col("embedding")
    return embeddings(spark, sf).select("vec_id", rounded(v.mean(x)).alias("mean"), rounded(v.stddev(x)).alias("std"), rounded(v.magnitude(x)).alias("magnitude"))


@add("geo_haversine", f"WITH p AS (SELECT vec_id, radians((vec_id * 7 % 180 - 90)::DOUBLE) AS la, radians((vec_id * 13 % 360 - 180)::DOUBLE) AS lo, radians(40.7128) AS a, radians(-74.006) AS b FROM embeddings), h AS (SELECT vec_id, sin((la - a) / 2) ** 2 + cos(a) * cos(la) * sin((lo - b) / 2) ** 2 AS x FROM p) SELECT vec_id, (round(2 * 6371000.0 * atan2(sqrt(x), sqrt(1 - x)), 3) + 0.0) AS metres FROM h")
def geo_haversine(spark, sf):
    i = F.col("vec_id")
    lat, lon = (i * 7 % 180 - 90).cast("double"), (i * 13 % 360 - 180).cast("double")
    return embeddings(spark, sf).select("vec_id", (F.round(v.haversine(F.lit(40.7128), F.lit(-74.006), lat, lon), 3) + 0.0).alias("metres"))


def _queries(spark, sf):
    """The stated query set: every row whose id is divisible by 100."""
    return embeddings(spark, sf).where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


_MANY = "m AS (SELECT vec_id AS qid, d AS q FROM e WHERE vec_id % 100 = 0)"


@add("distance_matrix", f"WITH {E_SQL}, {_MANY} SELECT qid, vec_id AS id, {r_sql(d_sql('cosine', 'd', 'm.q'))} AS distance FROM e, m")
def distance_matrix(spark, sf):
    return s.distance_matrix(embeddings(spark, sf), _queries(spark, sf), c=E).select("qid", "id", rounded(F.col("distance")).alias("distance"))


@add("batch_search", f"WITH {E_SQL}, {_MANY}, x AS (SELECT qid, vec_id, {d_sql('cosine', 'd', 'm.q')} AS dist FROM e, m), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM x) SELECT qid, vec_id AS id, {r_sql('dist')} AS distance, rk AS rank FROM r WHERE rk <= 10")
def batch_search(spark, sf):
    return s.batch_knn(embeddings(spark, sf), _queries(spark, sf), 10, c=E).select("qid", "id", rounded(F.col("distance")).alias("distance"), "rank")


@add("similarity_threshold", f"WITH {E_SQL}, {_MANY}, x AS (SELECT qid, vec_id, {d_sql('cosine', 'd', 'm.q')} AS dist FROM e, m WHERE vec_id <> qid), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM x), t AS (SELECT qid, max(1 - dist) AS top FROM r WHERE rk <= 3 GROUP BY qid) SELECT qid, {r_sql('top')} AS max_similarity, CASE WHEN top >= 0.8 THEN 'match' WHEN top >= 0.35 THEN 'review' ELSE 'none' END AS decision FROM t")
def similarity_threshold(spark, sf):
    n = s.batch_knn(embeddings(spark, sf), _queries(spark, sf), 4, c=E).where(F.col("qid") != F.col("id"))
    n = n.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("distance", "id"))).where("r <= 3")
    t = n.groupBy("qid").agg(F.max(1 - F.col("distance")).alias("top"))
    return t.select("qid", rounded(F.col("top")).alias("max_similarity"), F.when(F.col("top") >= 0.8, "match").when(F.col("top") >= 0.35, "review").otherwise("none").alias("decision"))


_FILTER = {"must": [{"match": {"key": "active", "value": True}}, {"range": {"key": "price", "gte": 20, "lt": 80}}]}
_FILTER_SQL = "vec_id % 17 <> 0 AND vec_id % 2 = 0 AND (vec_id % 100) + 0.5 >= 20 AND (vec_id % 100) + 0.5 < 80"


@add("knn_filtered", f"WITH {E_SQL} SELECT vec_id AS id, {r_sql('dist')} AS distance FROM (SELECT vec_id, {d_sql('cosine')} AS dist FROM e, q WHERE {_FILTER_SQL}) ORDER BY dist, vec_id LIMIT 10")
def knn_filtered(spark, sf):
    return _near(s.knn(with_payload(spark, sf), first_vector(spark, sf), 10, where=_FILTER, c=P))


@add("knn_postfilter3x", f"WITH {E_SQL}, n AS (SELECT vec_id, {d_sql('cosine')} AS dist FROM e, q ORDER BY dist, vec_id LIMIT 30) SELECT vec_id AS id, {r_sql('dist')} AS distance FROM n WHERE {_FILTER_SQL} ORDER BY dist, vec_id LIMIT 10")
def knn_postfilter3x(spark, sf):
    return _near(s.knn_postfilter(with_payload(spark, sf), first_vector(spark, sf), 10, _FILTER, c=P))


@add("knn_offset", f"WITH {E_SQL} SELECT vec_id AS id, {r_sql('dist')} AS distance FROM (SELECT vec_id, {d_sql('euclidean')} AS dist FROM e, q) ORDER BY dist, vec_id LIMIT 10 OFFSET 20")
def knn_offset(spark, sf):
    return _near(s.knn(embeddings(spark, sf), first_vector(spark, sf), 10, "euclidean", offset=20, c=E))


def _vector_rows(spark, values):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "pos bigint, x double").select("pos", rounded(F.col("x")).alias("x"))


def _mean_sql(ids: str) -> str:
    return f"SELECT pos, avg(x) AS x FROM (SELECT unnest(d) AS x, unnest(range(len(d))) AS pos FROM e WHERE vec_id IN ({ids})) GROUP BY pos"


def _some(spark, sf, ids):
    have = s.vectors_of(embeddings(spark, sf), ids, E)
    return [have[i] for i in ids]


@add("average_vectors", f"WITH e AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) SELECT label::BIGINT AS label, pos, {r_sql('avg(x)')} AS x FROM e GROUP BY label, pos")
def average_vectors(spark, sf):
    """The mean vector of every label, over all rows."""
    rows = embeddings(spark, sf).select(F.col("label").cast("bigint").alias("label"), F.posexplode(v.doubles(F.col("embedding"))).alias("pos", "x"))
    return rows.groupBy("label", F.col("pos").cast("bigint").alias("pos")).agg(rounded(F.avg("x")).alias("x"))


@add("recommend_vector", f"WITH {E_SQL}, p AS ({_mean_sql('1, 2, 3')}), n AS ({_mean_sql('4, 5')}) SELECT pos, {r_sql('2 * p.x - n.x')} AS x FROM p JOIN n USING (pos)")
def recommend_vector(spark, sf):
    return _vector_rows(spark, v.recommend_vector(_some(spark, sf, [1, 2, 3]), _some(spark, sf, [4, 5])))


_DISC_SQL = f"t AS ({_mean_sql('7')}), p AS ({_mean_sql('1, 2')}), n AS ({_mean_sql('4, 5')}), g AS (SELECT pos, t.x + p.x - n.x AS x FROM t JOIN p USING (pos) JOIN n USING (pos))"


@add("discovery_vector", f"WITH {E_SQL}, {_DISC_SQL} SELECT pos, {r_sql('x')} AS x FROM g")
def discovery_vector(spark, sf):
    a, b, c, d = _some(spark, sf, [1, 4, 2, 5])
    return _vector_rows(spark, v.discovery_vector(_some(spark, sf, [7])[0], [(a, b), (c, d)]))


@add("recommend_avg", f"WITH {E_SQL}, p AS ({_mean_sql('1, 2, 3')}), n AS ({_mean_sql('4, 5')}), g AS (SELECT list(2 * p.x - n.x ORDER BY pos) AS w FROM p JOIN n USING (pos)) SELECT vec_id AS id, {r_sql('dist')} AS distance FROM (SELECT vec_id, {d_sql('cosine', 'd', 'w')} AS dist FROM e, g) ORDER BY dist, vec_id LIMIT 10")
def recommend_avg(spark, sf):
    return _near(s.recommend(embeddings(spark, sf), [1, 2, 3], [4, 5], 10, c=E))


@add("recommend_best_score", f"WITH {E_SQL}, w AS (SELECT d AS w FROM e WHERE vec_id IN (1, 2, 3)) SELECT vec_id AS id, {r_sql('dist')} AS distance FROM (SELECT vec_id, min({d_sql('cosine', 'd', 'w')}) AS dist FROM e, w GROUP BY vec_id) ORDER BY dist, vec_id LIMIT 10")
def recommend_best_score(spark, sf):
    return _near(s.recommend(embeddings(spark, sf), [1, 2, 3], k=10, strategy="best_score", c=E))


@add("discover", f"WITH {E_SQL}, {_DISC_SQL}, w AS (SELECT list(x ORDER BY pos) AS w FROM g) SELECT vec_id AS id, {r_sql('dist')} AS distance FROM (SELECT vec_id, {d_sql('cosine', 'd', 'w')} AS dist FROM e, w) ORDER BY dist, vec_id LIMIT 10")
def discover(spark, sf):
    return _near(s.discover(embeddings(spark, sf), 7, [(1, 4), (2, 5)], 10, c=E))


@add("scroll_page", "SELECT vec_id AS id, 0.0::DOUBLE AS score FROM embeddings ORDER BY vec_id LIMIT 50 OFFSET 100")
def scroll_page(spark, sf):
    return s.scroll(embeddings(spark, sf), 50, "100", with_vectors=False, c=E)


@add("scroll_filtered", f"SELECT vec_id AS id, 0.0::DOUBLE AS score FROM embeddings WHERE {_FILTER_SQL} ORDER BY vec_id LIMIT 20 OFFSET 5")
def scroll_filtered(spark, sf):
    return s.scroll(with_payload(spark, sf), 20, 5, _FILTER, with_vectors=False, with_payload=False, c=P)


@add("count_all", "SELECT count(*) AS count FROM embeddings")
def count_all(spark, sf):
    return s.count(embeddings(spark, sf), c=E)


@add("count_filtered", f"SELECT count(*) AS count FROM embeddings WHERE {_FILTER_SQL}")
def count_filtered(spark, sf):
    return s.count(with_payload(spark, sf), _FILTER, c=P)


@add("get_by_id", "SELECT vec_id, label, len(embedding)::BIGINT AS dims FROM embeddings WHERE vec_id = 42")
def get_by_id(spark, sf):
    return embeddings(spark, sf).where(F.col("vec_id") == 42).select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims"))


@add("scan", "SELECT vec_id, label, len(embedding)::BIGINT AS dims FROM embeddings")
def scan(spark, sf):
    return embeddings(spark, sf).select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims"))


@add("facet", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def facet(spark, sf):
    return s.facet(table(spark, sf, "events"), F.col("event_type"))


@add("search_group_by", f"WITH {E_SQL}, x AS (SELECT label AS grp, vec_id AS id, {d_sql('cosine')} AS dist FROM e, q), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY dist, id) AS rank FROM x), b AS (SELECT grp, row_number() OVER (ORDER BY dist, id) AS group_rank FROM r WHERE rank = 1) SELECT group_rank, grp, rank, id, {r_sql('dist')} AS distance FROM r JOIN b USING (grp) WHERE rank <= 3 AND group_rank <= 5")
def search_group_by(spark, sf):
    g = s.search_groups(embeddings(spark, sf), first_vector(spark, sf), F.col("label"), 3, 5, c=E)
    return g.withColumn("distance", rounded(F.col("distance")))


# filters over the derived payload: name -> (filter, SQL condition on vec_id and label)
_LAT, _LON = "(vec_id * 7 % 180 - 90)", "(vec_id * 13 % 360 - 180)"
_CAT = {"match": {"key": "category", "value": "cat_3"}}
_LABEL = {"match": {"key": "label", "value": 2}}
_ACTIVE = {"match": {"key": "active", "value": True}}
_HAV = f"2 * 6371000.0 * asin(least(1.0, sqrt(sin(radians({_LAT} - 10.0) / 2) ** 2 + cos(radians(10.0)) * cos(radians({_LAT})) * sin(radians({_LON} - 20.0) / 2) ** 2)))"
FILTERS = {
    "must": ({"must": [_CAT, {"match": {"key": "active", "value": False}}]}, "vec_id % 10 = 3 AND vec_id % 2 = 1"),
    "should": ({"should": [_CAT, _LABEL]}, "vec_id % 10 = 3 OR label = 2"),
    "must_not": ({"must_not": [_CAT, _ACTIVE]}, "NOT (vec_id % 10 = 3 OR vec_id % 2 = 0)"),
    "min_should": ({"min_should": {"conditions": [_CAT, _LABEL, {"range": {"key": "price", "lt": 50}}], "min_count": 2}}, "(vec_id % 10 = 3)::INT + (label = 2)::INT + (vec_id % 100 < 50)::INT >= 2"),
    "nested": ({"must": [_ACTIVE, {"filter": {"should": [_LABEL, {"must_not": [{"range": {"key": "price", "gte": 30}}]}]}}]}, "vec_id % 2 = 0 AND (label = 2 OR NOT (vec_id % 100 + 0.5 >= 30))"),
    "match_keyword": ({"must": [{"match": {"key": "label", "value": 4}}]}, "label = 4"),
    "match_any": ({"must": [{"match_any": {"key": "category", "any": ["cat_1", "cat_7", "no"]}}]}, "vec_id % 10 IN (1, 7)"),
    "range": ({"must": [{"range": {"key": "price", "gt": 10.5, "lte": 40.5}}]}, "vec_id % 100 > 10 AND vec_id % 100 <= 40"),
    "geo_radius": ({"must": [{"geo_radius": {"key": "location", "center": {"lat": 10.0, "lon": 20.0}, "radius_meters": 5000000.0}}]}, f"{_HAV} <= 5000000.0"),
    "geo_bbox": ({"must": [{"geo_bounding_box": {"key": "location", "top_left": {"lat": 40.0, "lon": -60.0}, "bottom_right": {"lat": -20.0, "lon": 70.0}}}]}, f"{_LAT} BETWEEN -20 AND 40 AND {_LON} BETWEEN -60 AND 70"),
    "values_count": ({"must": [{"values_count": {"key": "tags", "gte": 2}}]}, "vec_id % 4 >= 2"),
    "is_empty": ({"should": [{"is_empty": {"key": "note"}}, {"is_empty": {"key": "location"}}]}, "vec_id % 4 = 0"),
    "is_null": ({"must": [{"is_null": {"key": "note"}}]}, "vec_id % 4 = 2"),
    "flat": ({"category": "cat_3", "active": False}, "vec_id % 10 = 3 AND vec_id % 2 = 1"),
}
for _name, (_spec, _cond) in FILTERS.items():

    @add(f"filter_{_name}", f"SELECT vec_id AS id FROM embeddings WHERE vec_id % 17 <> 0 AND ({_cond})")
    def _filter(spark, sf, spec=_spec):
        from ..plans.filters import compile_filter

        return with_payload(spark, sf).where(compile_filter(spec, F.col("metadata"))).select(F.col("vec_id").alias("id"))


@add("filter_events", "SELECT event_id AS id FROM events WHERE CAST(props ->> '$.k' AS BIGINT) >= 90 OR CAST(props ->> '$.k' AS BIGINT) = 7")
def filter_events(spark, sf):
    from ..plans.filters import compile_filter

    spec = {"should": [{"range": {"key": "k", "gte": 90}}, {"match": {"key": "k", "value": 7}}]}
    return table(spark, sf, "events").where(compile_filter(spec, F.col("props"))).select(F.col("event_id").alias("id"))


@add("filter_match_text", "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'lantern')")
def filter_match_text(spark, sf):
    from ..plans.filters import compile_filter

    docs = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("text")).alias("metadata"))
    return docs.where(compile_filter({"must": [{"match_text": {"key": "text", "text": "Lantern"}}]}, F.col("metadata"))).select(F.col("doc_id").alias("id"))
