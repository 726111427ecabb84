"""Session helpers: tables, the shared scratch folder, and lineage cuts.

Long plans are cut by writing a Parquet table into the folder that the
cluster names in ``spark.checkpoint.dir``. Such a table survives the loss of
any executor, is columnar and compressed, and is computed once (an RDD
checkpoint computes its input twice).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def _at_exit() -> None:
    """No result outlives the program, so its scratch tables go with it, if the session still runs; ``release`` is for programs that run long."""
    for spark, path in _WRITTEN:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended; what is left is for the cluster's own cleaning
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="vectorloom-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return "file://" + _OWN[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    path = f"{shared_dir(spark)}/vectorloom/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every scratch table written so far; call it when no result built on them is needed."""
    for _, path in _WRITTEN:
        delete_path(spark, path)
    _WRITTEN.clear()
