"""Sparse vectors: ``STRUCT<indices ARRAY<INT>, values ARRAY<DOUBLE>>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .vector import let

_TYPE = "struct<indices:array<int>,values:array<double>>"


def from_dense(v: Column, threshold: float = 0.0) -> Column:
    """The elements whose absolute value is above the threshold, indices from 0."""
    pairs = F.filter(F.transform(v.cast("array<double>"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.abs(p["x"]) > threshold)
    return F.struct(F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["x"]).alias("values")).cast(_TYPE)


def to_dense(s: Column, dim: int) -> Column:
    """``dim`` elements; indices beyond are ignored, of a repeated index the last counts."""
    pairs = F.arrays_zip(s["indices"], s["values"])
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.aggregate(pairs, F.lit(None).cast("double"), lambda a, p: F.when(p["indices"] == i, p["values"]).otherwise(a)), F.lit(0.0)),
    )


def nnz(s: Column) -> Column:
    """The number of stored entries, explicit zeros included."""
    return F.size(s["indices"])


def dot(a: Column, b: Column) -> Column:
    """The sum of the products at common indices, in any order of the indices."""
    find = lambda theirs: F.aggregate(F.arrays_zip(a["indices"], a["values"]), F.lit(0.0), lambda t, p: t + p["values"] * F.coalesce(F.try_element_at(theirs, p["indices"]), F.lit(0.0)))
    return let(F.map_from_arrays(b["indices"], b["values"]), find)


def norm(s: Column) -> Column:
    return F.sqrt(F.aggregate(s["values"], F.lit(0.0), lambda t, x: t + x * x))


def normalize(s: Column) -> Column:
    unit = let(norm(s), lambda n: F.when(n == 0, s["values"]).otherwise(F.transform(s["values"], lambda x: x / n)))
    return F.struct(s["indices"].alias("indices"), unit.alias("values"))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
