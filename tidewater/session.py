"""Small helpers around a SparkSession that every part of the library shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to a Python worker at a time, so that long texts don't add up in it.
BATCH_BYTES = 8 << 20
_shipped: set[str] = set()
_local_roots: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, and bound what a Python worker gets at a time.

    Workers on other machines then import it from Spark's own file distribution instead of relying on an installed copy.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(size).rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:  # a setting with a unit is the user's own
        spark.conf.set(size, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a fresh local one only where that is unset and Spark runs on one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage at a copy that outlives any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over every core, for work that is heavy for its bytes: a small file is one task otherwise, and
    adaptive execution joins partitions by bytes, but not those of a number that was asked for."""
    n = max(shuffle_width(df.sparkSession), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
