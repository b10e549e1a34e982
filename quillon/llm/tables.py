"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of `[^\x20\x09-\x0D]+` as a Java pattern.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str | None] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in tests, where it is unset and all runs on one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _own_dirs.setdefault(app, None) or "file://" + tempfile.mkdtemp(prefix="spark-")
        _own_dirs[app] = found
    return found


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder, in a folder for each value of `by` if it is given, and read again: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def hashed_fold(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
