import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vectorloom.functions import quantize as z, sparse as sp, vector as v
from vectorloom.operators.search import block_distances


def one(spark, *columns):
    r = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return [r[i] for i in range(len(columns))]


def test_metrics_by_known_values(spark):
    x = v.vector
    got = one(
        spark, v.cosine_similarity(x([1, 0, 0]), x([1, 0, 0])), v.distance(x([1, 0, 0]), x([0, 1, 0])), v.euclidean_distance(x([0, 0]), x([3, 4])), v.dot_product(x([1, 2, 3, 4]), x([2, 3, 4, 5])),
        v.manhattan_distance(x([1, 2]), x([4, 6])), v.magnitude(x([3, 4])), v.normalize(x([3, 4])), v.distance(x([0, 0]), x([1, 1])), v.distance(x([1, 2]), x([3, 4]), "dot"), v.normalize(x([0, 0])),
    )
    assert got == [1, 1, 5, 40, 7, 5, [0.6, 0.8], 1, -11, [0, 0]]


def test_unequal_lengths_raise_and_null_gives_null(spark):
    assert one(spark, v.dot_product(F.lit(None).cast("array<double>"), v.vector([1]))) == [None]
    with pytest.raises(Exception, match="unequal length"):
        one(spark, v.dot_product(v.vector([1, 2]), v.vector([1])))


def test_metric_names():
    assert [v.metric(m) for m in ("Euclidean", "DOT_PRODUCT", 4, 9, None, "odd")] == ["euclidean", "dot_product", "manhattan", "cosine", "cosine", "cosine"]


def test_composed_vectors():
    assert v.average_vectors([[1, 2, 3], [3, 4, 5]]) == [2, 3, 4]
    assert v.average_vectors([]) is None and v.average_vectors([[1], [1, 2]]) is None
    assert v.recommend_vector([[1, 0], [0.9, 0.1]], [[-1, 0]]) == pytest.approx([2.9, 0.1])
    assert v.recommend_vector([[1, 0], [3, 0]]) == [2, 0]
    assert v.discovery_vector([0, 0], [([1, 0], [-1, 0]), ([0, 1], [0, -1])]) == [1, 1]
    assert v.discovery_vector([1, 2], []) == [1, 2] and v.discovery_vector([1], [([1, 2], [1, 2])]) is None


def test_sparse(spark):
    s = lambda i, x: F.struct(F.array(*map(F.lit, i)).alias("indices"), F.array(*(F.lit(float(y)) for y in x)).alias("values"))
    a, b = s([0, 2, 4], [1, 2, 3]), s([1, 2, 4], [1, 2, 3])
    f = sp.from_dense(v.vector([0.1, 0, 0.5, 0, 0.9]), 0.2)
    got = one(spark, sp.dot(a, b), sp.dot(a, a), f["indices"], f["values"], sp.to_dense(s([1, 3, 9], [2, 4, 5]), 5), sp.nnz(a), sp.cosine(a, s([7], [0])))
    assert got == [13, 14, [2, 4], [0.5, 0.9], [0, 2, 0, 4, 0], 3, 0]


def test_quantizers(spark):
    q = z.scalar_quantize(v.vector([1, 2, 3, 4, 5]))
    b = z.binary_quantize(v.vector([1, 2, 3, 4]), 4)
    got = one(spark, z.scalar_dequantize(q), z.scalar_quantize(v.vector([2, 2]))["codes"], b["words"], z.binary_dequantize(b, 4), z.hamming(b["words"], z.binary_quantize(v.vector([4, 3, 2, 1]), 4)["words"]))
    assert max(abs(x - y) for x, y in zip(got[0], [1, 2, 3, 4, 5], strict=True)) < 0.1
    assert got[1:] == [[-128, -128], [0b1100], [1.5, 1.5, 3.5, 3.5], 4]
    long = one(spark, z.binary_quantize(v.vector([0] * 100 + [1] * 30), 130)["words"])[0]
    assert len(long) == 3 and long[0] == 0


def test_haversine(spark):
    d = one(spark, v.haversine(F.lit(40.7128), F.lit(-74.006), F.lit(51.5074), F.lit(-0.1278)))[0]
    assert 5.5e6 < d < 5.6e6


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.floats(-5, 5), min_size=3, max_size=3), min_size=2, max_size=4))
def test_block_distances_are_symmetric(rows):
    import numpy as np

    x = np.array(rows)
    for m in v.METRICS:
        d = block_distances(x, x, m)
        assert np.allclose(d, d.T, atol=1e-9) and not math.isnan(d.sum())
