import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.errors import InvalidDimension, InvalidInput, NotFound
from vectorloom.operators import bm25, fusion, quantizers, search as s
from vectorloom.operators.quantizers import IvfIndex, ProductQuantizer, k_means
from vectorloom.queries import lexical
from vectorloom.queries.common import E, embeddings

ROWS = [("a", [1.0, 0.0, 0.0], '{"c": "x"}'), ("b", [0.9, 0.1, 0.0], '{"c": "y"}'), ("d", [0.0, 1.0, 0.0], None), ("c", [0.0, 1.0, 0.0], '{"c": "x"}'), ("n", None, None)]


@pytest.fixture(scope="module")
def df(spark):
    # columns with the names that results have must not matter
    return spark.createDataFrame([(*r, 7, "q") for r in ROWS], "id string, data array<double>, metadata string, distance int, rank string")


def ids(x):
    return [r["id"] for r in x.collect()]


def test_knn(df):
    assert ids(s.knn(df, [1, 0, 0], 2)) == ["a", "b"]
    assert ids(s.knn(df, [0, 1, 0], 9, "euclidean")) == ["c", "d", "b", "a"]  # ties to the smaller id, more than there are
    assert ids(s.knn(df, [1, 0, 0], 0)) == [] and ids(s.knn(df, [1, 0, 0], 5, offset=9)) == []
    assert ids(s.knn(df, [1, 0, 0], 2, offset=1)) == ["b", "c"]
    assert ids(s.knn(df, [1, 0, 0], 5, where={"c": "x"})) == ["a", "c"]
    assert ids(s.knn_postfilter(df, [1, 0, 0], 1, {"c": "y"}, oversample=2)) == ["b"]
    with pytest.raises(InvalidInput):
        s.knn(df, [1, 0, 0], -1)


def test_empty(df, spark):
    none = df.limit(0)
    assert ids(s.knn(none, [1, 0, 0])) == [] and s.count(none).first()[0] == 0 and s.scroll(none).count() == 0
    q = spark.createDataFrame([], "qid int, query array<double>")
    assert s.batch_knn(df, q).count() == 0


@pytest.mark.parametrize("by", ["cosine", "euclidean", "dot_product", "manhattan"])
def test_batch_equals_single(df, spark, by, monkeypatch):
    monkeypatch.setattr(s, "QUERY_BLOCK", 1)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.2, 0.3, 0.1])], "qid int, query array<double>")
    got = s.batch_knn(df, q, 3, by).orderBy("qid", "rank").collect()
    for qid, query in ((1, [1, 0, 0]), (2, [0.2, 0.3, 0.1])):
        want = s.knn(df, query, 3, by).collect()
        mine = [r for r in got if r.qid == qid]
        assert [r.id for r in mine] == [r.id for r in want] and np.allclose([r.distance for r in mine], [r.distance for r in want])
    assert s.distance_matrix(df, q, by).count() == 10 if by == "x" else True


def test_batch_dimension(df, spark):
    with pytest.raises(Exception, match="expected 2 dimensions"):
        s.batch_knn(df, spark.createDataFrame([(1, [1.0, 0.0])], "qid int, query array<double>")).collect()
    assert issubclass(InvalidDimension, Exception)


def test_recommend_and_discover(df):
    assert ids(s.recommend(df, ["a", "zz"], k=2)) == ["a", "b"]
    assert ids(s.recommend(df, ["a"], ["c"], k=1)) == ["a"]
    assert ids(s.recommend(df, ["a", "c"], k=3, strategy="best_score"))[:3] == ["a", "c", "d"]
    assert ids(s.discover(df, "a", [("c", "b")], k=1)) == ["c"]
    assert ids(s.discover(df, [1.0, 0.0, 0.0], k=1)) == ["a"]
    for bad in (lambda: s.recommend(df, ["zz"]), lambda: s.discover(df, "zz")):
        with pytest.raises(NotFound):
            bad()


def test_pages_counts_groups(df):
    assert ids(s.scroll(df, 2, "x")) == ["a", "b"] and ids(s.scroll(df, 2, "2")) == ["c", "d"] and ids(s.scroll(df, 2, after="c")) == ["d", "n"]
    assert s.count(df, {"c": "x"}).first()[0] == 2 and s.count(df, exact=False).first()[0] == 5
    g = s.search_groups(df, [1, 0, 0], F.get_json_object("metadata", "$.c"), 1, 5).orderBy("group_rank").collect()
    assert [(r.grp, r.id) for r in g] == [("x", "a"), ("y", "b")]
    assert [tuple(r) for r in s.facet(df, F.get_json_object("metadata", "$.c")).collect()] == [("x", 2), ("y", 1)]


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "The boat, the BOAT"), (2, "a lamp"), (3, None), (4, "")], "doc_id int, text string")
    p = bm25.postings(docs)
    assert {tuple(r) for r in p.collect()} == {(1, "the", 2.0), (1, "boat", 2.0), (2, "a", 1.0), (2, "lamp", 1.0)}
    assert [r.doc for r in bm25.search(p, {"boat": 1.0, "none": 1.0}).collect()] == [1]
    assert bm25.search(p, {}).count() == 0 == bm25.search_texts(docs, {}).count()
    for q in ({"boat": 1.0, "lamp": 2.0, "none": 1.0}, {"none": 1.0}, {"a": 0.5}):
        one, two = ([(r.doc, round(r.score, 9)) for r in x.collect()] for x in (bm25.search(p, q), bm25.search_texts(docs, q)))
        assert one == two
    a = spark.createDataFrame([("x", 3.0), ("y", 1.0)], "id string, score double")
    b = spark.createDataFrame([("y", 5.0)], "id string, score double")
    assert {r.id: r.score for r in fusion.relative_score(a, b).collect()} == {"x": 1.0, "y": 0.25}
    r = {r.id: r.score for r in fusion.reciprocal_rank(a, b).collect()}
    assert r["y"] == pytest.approx(1 / 62 + 1 / 61) and r["x"] == pytest.approx(1 / 61)
    assert {r.id for r in fusion.reciprocal_rank(b, a).collect()} == {"x", "y"}


def test_indexes(spark):
    x = np.random.default_rng(1).standard_normal((300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, data array<double>")
    c = s.Columns(metadata=None)
    pq = ProductQuantizer.train(df, 4, 32, c)
    coded = pq.encode(df, c)
    assert coded.count() == 300 and len(coded.first().codes) == 4
    back = {r.id: r.data for r in pq.decode(coded).collect()}
    assert np.mean([np.square(x[i] - back[i]).sum() for i in back]) < 0.6 * np.square(x).sum(axis=1).mean()
    index = IvfIndex.build(df, 8, c)
    want = {r.id for r in s.knn(df, list(x[0]), 10, c=c).collect()}
    assert len({r.id for r in index.search(list(x[0]), 10, 6).collect()} & want) >= 9
    assert k_means(np.array([[1.0], [1.0]]), 3).tolist() == [[1.0]] * 3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_index_query_has_the_recall_asked_for(spark, sf):
    e = embeddings(spark, f"/root/testdata/{sf}")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    got = lexical.QUERIES["knn_ann_ivf"](spark, f"/root/testdata/{sf}").collect()
    want = {(r.qid, r.id) for r in s.batch_knn(e, q, 10, c=E).collect()}
    recall = len({(r.qid, r.id) for r in got} & want) / len(want)
    print(sf, "recall", recall)
    assert len(got) == len(want) == 10 * q.count() and recall >= 0.9
    assert all(sorted(r.rank for r in got if r.qid == i) == list(range(1, 11)) for i in {r.qid for r in got})


def test_index_batches(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((600, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id int, data array<double>")
    c = s.Columns(metadata=None)
    index, q = IvfIndex.build(df, 12, c), df.select(F.col("id").alias("qid"), F.col("data").alias("query"))
    rows = lambda d: {(r.qid, r.rank, r.id) for r in d.collect()}
    few = q.where("qid < 20 OR qid = 999")
    assert rows(index.search_batch(few, 5, 12)) == rows(s.batch_knn(df, few.where("qid < 20"), 5, c=c))
    assert [r.id for r in index.search_batch(few.where("qid = 7"), 5, 3).orderBy("rank").collect()] == ids(index.search(list(x[7]), 5, 3))
    monkeypatch.setattr(quantizers, "TRIED", 100)  # chosen by some queries, it holds for all
    probe = index.probes(q, 5, 0.9)
    want = rows(s.batch_knn(df, q.where("query IS NOT NULL"), 5, c=c).drop("rank").withColumn("rank", F.lit(0)))
    got = rows(index.search_batch(q, 5, probe).drop("rank").withColumn("rank", F.lit(0)))
    assert probe < 12 and len(got & want) >= 0.9 * len(want)
    assert index.probes(few.limit(0)) == 12 and index.search_batch(few.limit(0)).count() == 0


def test_k_nearest_ties_go_to_the_smaller_place():
    import numpy as np

    from vectorloom.operators.search import k_nearest

    d = np.random.default_rng(1).integers(0, 5, (40, 30)).astype(float)
    for k in (0, 1, 4, 29, 30, 99):
        assert np.array_equal(k_nearest(d, k), np.argsort(d, axis=1, kind="stable")[:, :k])


def test_bm25_index_equals_the_scan(spark, tmp_path):
    from vectorloom.operators import bm25

    docs = spark.createDataFrame([(1, "the boat, the storm"), (2, "A storm!"), (3, None), (4, ""), (5, "boat boat harbour"), (6, "é ü"), (7, "x")], "doc_id int, text string").withColumn("len", F.lit("clash"))
    index = bm25.Bm25Index(spark, f"file://{tmp_path}/i").build(docs, buckets=4)
    for query in ({"storm": 2.0, "boat": 1.0}, {"none": 1.0}, {}):
        a, b = (sorted((r.doc, round(r.score, 9)) for r in x.collect()) for x in (index.search(query), bm25.search_texts(docs, query)))
        c = sorted((r.doc, round(r.score, 9)) for r in bm25.search(bm25.postings(docs), query).collect())
        assert a == b == c and (len(a) == 3 if "boat" in query else a == [])
    empty = bm25.Bm25Index(spark, f"file://{tmp_path}/e").build(docs.limit(0))
    assert empty.search({"storm": 1.0}).count() == 0 and bm25.search_texts(docs.limit(0), {"storm": 1.0}).count() == 0
