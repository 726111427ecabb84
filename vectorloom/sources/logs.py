"""Operation logs in JSON lines with a CRC32 of each record, and vectors in JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

VECTOR_LINES = "id string, data array<float>, metadata string"


def read_vectors(spark: SparkSession, path: str, schema: str = VECTOR_LINES) -> DataFrame:
    """Vectors of JSON lines; lines that aren't JSON are left out. Metadata may be an object, which is kept as text."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path).where(F.col("id").isNotNull()).drop("_corrupt_record")


def sealed(log: DataFrame, *columns: str) -> DataFrame:
    """``payload, crc`` of each record."""
    payload = F.to_json(F.struct(*(columns or log.columns)))
    return log.select(payload.alias("payload"), F.crc32(payload.cast("binary")).alias("crc"))


def write_log(log: DataFrame, path: str) -> None:
    sealed(log).write.mode("append").json(path)


def intact(lines: DataFrame) -> DataFrame:
    """The sealed records whose checksum is right; damaged ones are skipped."""
    return lines.where(F.col("payload").isNotNull() & (F.crc32(F.col("payload").cast("binary")) == F.col("crc")))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = spark.read.schema("payload string, crc bigint").json(path)
    return intact(lines).select(F.from_json("payload", schema).alias("r")).select("r.*")
