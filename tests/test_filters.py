import json
import math
import random

import pytest
from pyspark.sql import functions as F

from vectorloom.errors import InvalidInput
from vectorloom.plans.filters import Clause, Leaf, compile_filter, parse


def plain(node, m):
    """The same rules, row by row."""
    if m is None:
        return False
    if isinstance(node, Clause):
        hits = [plain(p, m) for p in node.parts]
        return {"must": all(hits), "should": any(hits), "must_not": not any(hits), "min_should": sum(hits) >= node.least}[node.kind]
    x, a = m.get(node.key, KeyError), node.args
    num = isinstance(x, (int, float)) and not isinstance(x, bool)
    inside = lambda y: all({"gte": y >= b, "gt": y > b, "lte": y <= b, "lt": y < b}[k] for k, b in a.items())
    if node.kind == "match":
        return type(x) is type(a) and x == a
    if node.kind == "match_any":
        return any(type(x) is type(w) and x == w for w in a)
    if node.kind == "match_text":
        return isinstance(x, str) and a.lower() in x.lower()
    if node.kind == "range":
        return num and inside(x)
    if node.kind == "values_count":
        return isinstance(x, list) and inside(len(x))
    if node.kind == "is_empty":
        return x == [] or x == ""
    if node.kind == "is_null":
        return x is None
    raise AssertionError(node.kind)


def check(spark, spec, rows):
    df = spark.createDataFrame([(i, None if m is None else json.dumps(m)) for i, m in enumerate(rows)], "i int, m string")
    got = {r[0] for r in df.where(compile_filter(spec, F.col("m"))).collect()}
    assert got == {i for i, m in enumerate(rows) if plain(parse(spec), m)}, spec


ROWS = [None, {}, {"k": 3}, {"k": 3.0}, {"k": "3"}, {"k": True}, {"k": None}, {"k": []}, {"k": ""}, {"k": {}}, {"k": [1, "a"]}, {"a.b": 1}, {"a": {"b": 1}}, {"k": "Café NOIR %_"}, {"k": -1e3}, {"j": 3, "k": 4}]


@pytest.mark.parametrize(
    "cond",
    [
        {"match": {"key": "k", "value": 3}}, {"match": {"key": "k", "value": "3"}}, {"match": {"key": "k", "value": True}}, {"match": {"key": "a.b", "value": 1}}, {"match_any": {"key": "k", "any": [4, "3", False]}},
        {"match_text": {"key": "k", "text": "noir %"}}, {"range": {"key": "k", "gte": 3}}, {"range": {"key": "k"}}, {"range": {"key": "k", "lt": 4, "gt": -2000}}, {"values_count": {"key": "k", "gte": 1}},
        {"values_count": {"key": "k"}}, {"is_empty": {"key": "k"}}, {"is_null": {"key": "k"}},
    ],
)
def test_leaves(spark, cond):
    check(spark, {"must": [cond]}, ROWS)
    check(spark, {"must_not": [cond]}, ROWS)


def test_clauses_without_conditions(spark):
    for spec in ({"must": []}, {"should": []}, {"must_not": []}, {"min_should": {"conditions": [], "min_count": 0}}):
        check(spark, spec, ROWS)


def test_random_trees(spark):
    rng = random.Random(4)
    leaves = [{"match": {"key": k, "value": x}} for k in "jk" for x in (3, "3", True)] + [{"range": {"key": "k", "gt": 0}}, {"is_null": {"key": "k"}}, {"is_empty": {"key": "k"}}]

    def tree(depth):
        if depth == 0:
            return rng.choice(leaves)
        kind = rng.choice(["must", "should", "must_not", "min_should"])
        parts = [tree(depth - 1) for _ in range(rng.randint(1, 3))]
        return {"filter": {kind: {"conditions": parts, "min_count": 2} if kind == "min_should" else parts}}

    for _ in range(12):
        check(spark, tree(2)["filter"], ROWS)


def test_geo_and_damage(spark):
    rows = [('{"location": {"lat": 40.7128, "lon": -74.006}}',), ('{"location": {"lat": 0, "lon": 0}}',), ('{"location": {"lat": 1}}',), ("{broken",), (None,)]
    df = spark.createDataFrame(rows, "m string")
    near = {"must": [{"geo_radius": {"key": "location", "center": {"lat": 40.7, "lon": -74.0}, "radius_meters": 10000}}]}
    box = {"must": [{"geo_bounding_box": {"key": "location", "top_left": {"lat": 41, "lon": -75}, "bottom_right": {"lat": 40.7128, "lon": -74.006}}}]}
    assert [df.where(compile_filter(f, F.col("m"))).count() for f in (near, box)] == [1, 1]


def test_bad_filters():
    for spec in ({"must": [{"odd": {"key": "k"}}]}, {"must": [{"match": 3}]}, 5):
        with pytest.raises(InvalidInput):
            parse(spec)
    assert parse({"a": 1, "b": "x"}) == Clause("must", (Leaf("match", "a", 1), Leaf("match", "b", "x")))
