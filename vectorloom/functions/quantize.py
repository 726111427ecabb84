"""Scalar and binary quantization of vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .vector import let, mean


def scalar_quantize(v: Column) -> Column:
    """``codes`` from -128 to 127 between the vector's own ``lo`` and ``hi``, truncated; a constant vector has code -128."""
    d = v.cast("array<double>")
    bounds = F.struct(F.array_min(d).alias("lo"), F.array_max(d).alias("hi"))

    def quantized(r: Column) -> Column:
        scale = F.when(r["hi"] == r["lo"], F.lit(1.0)).otherwise(255.0 / (r["hi"] - r["lo"]))
        codes = let(scale, lambda k: F.transform(d, lambda x: (F.greatest(F.lit(0), F.least(F.lit(255), ((x - r["lo"]) * k).cast("int"))) - 128).cast("tinyint")))
        return F.struct(codes.alias("codes"), r["lo"].alias("lo"), r["hi"].alias("hi"))

    return let(bounds, quantized)


def scalar_dequantize(q: Column) -> Column:
    return let(q, lambda r: F.transform(r["codes"], lambda c: r["lo"] + (c.cast("double") + 128) * (r["hi"] - r["lo"]) / 255.0))


def binary_quantize(v: Column, dim: int) -> Column:
    """``words`` of 64 bits, the lowest first: whether an element is above the mean."""
    d = v.cast("array<double>")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def word(at: int, m: Column) -> Column:
        bit = lambda a, i: a.bitwiseOR(F.when(F.get(d, i + at) > m, F.call_function("shiftleft", one, i)).otherwise(zero))
        return F.aggregate(F.sequence(F.lit(0), F.lit(min(64, dim - at) - 1)), zero, bit)

    return let(mean(v), lambda m: F.struct(F.array(*(word(at, m) for at in range(0, dim, 64))).alias("words"), m.alias("mean")))


def binary_dequantize(q: Column, dim: int) -> Column:
    """The mean plus 1 where the bit is set, minus 1 elsewhere."""
    one = F.lit(1).cast("bigint")
    bit = lambda r, i: F.call_function("shiftrightunsigned", F.get(r["words"], F.floor(i / 64).cast("int")), (i % 64).cast("int")).bitwiseAND(one)
    return let(q, lambda r: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: r["mean"] + F.when(bit(r, i) == 1, 1.0).otherwise(-1.0)))


def hamming(a: Column, b: Column) -> Column:
    """How many bits of two lists of words differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda t, x: t + x)


def int8_distance(a: Column, b: Column, by: str = "dot_product") -> Column:
    """On raw codes: the negative dot product, the Euclidean distance, or 1 - cosine (1 for a zero vector)."""
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("bigint"), lambda t, x: t + x)
    long = lambda x: x.cast("bigint")
    if by == "euclidean":
        return F.sqrt(total(lambda x, y: (long(x) - long(y)) * (long(x) - long(y))).cast("double"))
    dot = total(lambda x, y: long(x) * long(y)).cast("double")
    if by == "dot_product":
        return -dot
    norms = F.sqrt(total(lambda x, y: long(x) * long(x)).cast("double")) * F.sqrt(total(lambda x, y: long(y) * long(y)).cast("double"))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - dot / norms)


def memory_size(kind: str, dim: Column, segments: int = 0) -> Column:
    """Bytes of one vector in each form."""
    return {"float32": lambda: dim * 4, "scalar": lambda: dim + 8, "product": lambda: F.lit(segments + 4), "binary": lambda: F.ceil(dim / 8) + 4}[kind]().cast("bigint")
