"""The vector functions for SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_SUM = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, x) -> s + x)"
_NORM = "sqrt(aggregate({}, 0D, (s, x) -> s + x * x))"
FUNCTIONS = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _SUM.format("x * y")),
    "vec_magnitude": ("a ARRAY<DOUBLE>", "DOUBLE", _NORM.format("a")),
    "vec_cosine_similarity": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"coalesce(try_divide({_SUM.format('x * y')}, {_NORM.format('a')} * {_NORM.format('b')}), 0D)"),
    "vec_euclidean": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"sqrt({_SUM.format('(x - y) * (x - y)')})"),
    "vec_manhattan": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _SUM.format("abs(x - y)")),
    "sparse_dot": ("a STRUCT<indices: ARRAY<INT>, `values`: ARRAY<DOUBLE>>, b STRUCT<indices: ARRAY<INT>, `values`: ARRAY<DOUBLE>>", "DOUBLE", "aggregate(map_values(map_zip_with(map_from_arrays(a.indices, a.values), map_from_arrays(b.indices, b.values), (i, x, y) -> coalesce(x * y, 0D))), 0D, (s, x) -> s + x)"),
    "scalar_dequantize": ("codes ARRAY<TINYINT>, lo DOUBLE, hi DOUBLE", "ARRAY<DOUBLE>", "transform(codes, c -> lo + (c + 128) * (hi - lo) / 255D)"),
    "haversine_m": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", "2 * 6371000D * asin(least(1D, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))"),
}


def filtered_view(rows: DataFrame, where: dict, name: str, metadata: str = "metadata") -> None:
    """Make the rows that a payload filter keeps a temporary view, for SQL text; the filter is part of the view's plan."""
    from ..plans.filters import compile_filter

    rows.where(compile_filter(where, F.col(metadata))).createOrReplaceTempView(name)


def register(spark: SparkSession) -> None:
    """Create the functions as temporary SQL functions of the session."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
