"""Where jobs keep tables between steps: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.economics import key_hash

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, as in tests, below a temporary folder if all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="spark-")
        _own[app] = base
    return f"{base}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    path, schema = shared_path(df.sparkSession, label), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def write_training_set(df: DataFrame, path: str, by: str = "segment_id") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_sorted(df: DataFrame, path: str, keys: list[str]) -> None:
    """df in the order of its keys, over the files by name and within each."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_batch(df: DataFrame, path: str, number: int) -> None:
    """A micro-batch's rows in a folder of their own: a batch that is tried again replaces what it left."""
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def batches_before(spark: SparkSession, path: str, number: int) -> int | None:
    """The last batch before `number` that has a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    found = [int(n.split("=")[1]) for n in names if n.startswith("batch=")]
    return max((n for n in found if n < number), default=None)


def write_reports(reports: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """Small result tables, one folder each, as CSV with a header or JSON lines."""
    for name, df in reports.items():
        w = df.coalesce(1).write.mode("overwrite")
        w.option("header", True).csv(f"{folder}/{name}") if kind == "csv" else w.json(f"{folder}/{name}")


def read_csv_sample(spark: SparkSession, path: str, schema: str, key: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """A CSV file; with n, the n rows with the smallest hashes of their keys."""
    d = spark.read.schema(schema).option("header", True).csv(path)
    return d if n is None else d.orderBy(key_hash(key, seed=seed), key).limit(n)


def upsert(updates: DataFrame, path: str, keys: list[str], *, buckets: int = 16, newest: str | None = None) -> None:
    """Merges rows into a Parquet table by key; only the buckets that the updates touch are rewritten.

    The merged buckets are written aside first, so that a lost executor or a failed write never
    leaves a bucket half replaced by what is still being read.
    """
    spark = updates.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rest = [c for c in updates.columns if c not in keys]
    order = F.col(newest) if newest else F.lit(0)
    new = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest]).withColumn("bucket", bucket)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    if exists:
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).join(new.select(*keys), keys, "left_anti")
        new = old.select(*new.columns).unionByName(new)
    staged = written(new, "upsert")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
