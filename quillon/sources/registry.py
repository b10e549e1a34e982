"""Versions of feature definitions, and back-fills of one version over a range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "feature string, version int, definition string, registered_by string, description string"


def empty(spark: SparkSession) -> DataFrame:
    return with_hash(spark.createDataFrame([], SCHEMA))


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("definition_hash", F.sha2("definition", 256))


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new(feature, version, ...); raises unless each version exceeds its feature's latest."""
    rows = with_hash(new)
    newest = registry.groupBy("feature").agg(F.max("version").alias("_latest"))
    bad = rows.join(newest, "feature").where("version <= _latest").select("feature", "version", "_latest").limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r.feature}: version {r.version} is not above {r._latest}" for r in bad))
    return registry.unionByName(rows)


def latest(registry: DataFrame) -> DataFrame:
    rest = [c for c in registry.columns if c != "feature"]
    return registry.groupBy("feature").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("feature", *[f"r.{c}" for c in rest])


def versions(registry: DataFrame, feature: str) -> DataFrame:
    return registry.where(F.col("feature") == feature).orderBy("version")


def get(registry: DataFrame, feature: str, version: int) -> DataFrame:
    return registry.where((F.col("feature") == feature) & (F.col("version") == version))


def features(registry: DataFrame) -> DataFrame:
    return registry.select("feature").distinct()


def request_id(fields: dict[str, Column]) -> Column:
    """The same id for the same fields: 16 hex digits of the hash of sorted name=value pairs."""
    pairs = F.array_sort(F.array(*[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields.items()]))
    return F.substring(F.sha2(F.concat_ws("|", pairs), 256), 1, 16)


def backfill(tx: DataFrame, view: Callable[[DataFrame], DataFrame], path: str, *, feature: str, version: int, start: str, end: str, at: str = "event_time") -> DataFrame:
    """Writes one version of a view over [start, end) below path/feature=/version=, and gives the progress row. Running it again replaces that version only."""
    d = view(tx.where((F.col(at) >= F.lit(start).cast("timestamp_ntz")) & (F.col(at) < F.lit(end).cast("timestamp_ntz"))))
    out = d.withColumns({"feature": F.lit(feature), "version": F.lit(version)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature", "version").parquet(path)
    ident = request_id({"feature": F.lit(feature), "version": F.lit(version), "start": F.lit(start), "end": F.lit(end)})
    done = tx.sparkSession.read.parquet(path).where((F.col("feature") == feature) & (F.col("version") == version))
    return done.agg(F.count("*").alias("rows")).select(ident.alias("request_id"), F.lit(feature).alias("feature"), F.lit(version).alias("version"), "rows")
