"""Vector arithmetic as columns. All sums are in double precision; arrays of unequal length raise an error, null gives null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

METRICS = ("cosine", "euclidean", "dot_product", "manhattan")
EARTH_RADIUS_M = 6_371_000.0


def metric(name: str | int | None) -> str:
    """A metric by its name in any spelling or its wire number (1-4); whatever isn't known is cosine."""
    if isinstance(name, int):
        return METRICS[name - 1] if 1 <= name <= 4 else "cosine"
    key = "".join(c for c in (name or "").lower() if c.isalpha())
    return {"euclidean": "euclidean", "dotproduct": "dot_product", "dot": "dot_product", "manhattan": "manhattan"}.get(key, "cosine")


def vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.lit([float(v) for v in values]).cast("array<double>")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: inside a lambda Spark would compute it again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _pairs(a: Column, b: Column, f) -> Column:
    """The sum of f over the pairs of elements."""
    same = F.size(a) == F.size(b)
    bad = F.raise_error(F.concat(F.lit("vectors of unequal length: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))).cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(same, _total(F.zip_with(doubles(a), doubles(b), f))).otherwise(bad)


def dot_product(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either vector is all zero."""
    return let(magnitude(a) * magnitude(b), lambda norms: F.when(norms == 0, F.lit(0.0)).otherwise(dot_product(a, b) / norms))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan_distance(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y))


def distance(a: Column, b: Column | Sequence[float], by: str = "cosine") -> Column:
    """Smaller is nearer in each metric: 1 - cosine, and the negative dot product. The norm of a literal vector is computed here and not for each row."""
    if not isinstance(b, Column):
        b, values = vector(b), [float(x) for x in b]
        if metric(by) == "cosine":
            norm = F.lit(sum(x * x for x in values) ** 0.5)
            return 1 - let(magnitude(a) * norm, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot_product(a, b) / n))
    return {
        "cosine": lambda: 1 - cosine_similarity(a, b),
        "euclidean": lambda: euclidean_distance(a, b),
        "dot_product": lambda: -dot_product(a, b),
        "manhattan": lambda: manhattan_distance(a, b),
    }[metric(by)]()


def normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays."""
    return let(magnitude(v), lambda norm: F.when(norm == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / norm)))


def mean(v: Column) -> Column:
    return F.try_divide(_total(doubles(v)), F.size(v))


def stddev(v: Column) -> Column:
    """Of the whole vector as a population."""
    return let(mean(v), lambda m: F.sqrt(F.try_divide(F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + (x - m) * (x - m)), F.size(v))))


def average_vectors(vectors: Sequence[Sequence[float]]) -> list[float] | None:
    """The element-wise mean of a few vectors; None if there are none or their lengths differ."""
    if not vectors or len({len(v) for v in vectors}) != 1:
        return None
    return [sum(x) / len(vectors) for x in zip(*vectors, strict=True)]


def recommend_vector(positive: Sequence[Sequence[float]], negative: Sequence[Sequence[float]] = ()) -> list[float] | None:
    """Twice the mean of the positives less that of the negatives; without negatives the mean of the positives."""
    p = average_vectors(positive)
    if p is None or not negative:
        return p
    n = average_vectors(negative)
    return None if n is None or len(n) != len(p) else [2 * a - b for a, b in zip(p, n, strict=True)]


def discovery_vector(target: Sequence[float], pairs: Sequence[tuple[Sequence[float], Sequence[float]]]) -> list[float] | None:
    """The target moved by the mean of (positive - negative); None if lengths differ."""
    if not pairs:
        return list(target)
    if any(len(v) != len(target) for pair in pairs for v in pair):
        return None
    return [t + sum(p[i] - n[i] for p, n in pairs) / len(pairs) for i, t in enumerate(target)]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees."""
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(d_lat / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(d_lon / 2) ** 2
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))
