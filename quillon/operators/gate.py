"""The data gate: is a training frame fit to learn from? And tables that describe one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import ranks as r

LEAST_ROWS, CV, AUC, LOW, HIGH = 100, 0.7, 0.85, 0.3, 0.9


def _criterion(d: DataFrame, name: str, value, passed, note: str) -> DataFrame:
    return d.select(F.lit(name).alias("criterion"), value.cast("double").alias("value"), F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(note).alias("note"))


def rate_heterogeneity(df: DataFrame) -> DataFrame:
    """Coefficient of variation of velocity_24h (velocity_5m where it is missing) above CV, from LEAST_ROWS rows on."""
    column = "velocity_24h" if "velocity_24h" in df.columns else "velocity_5m"
    d = df.agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
    v = F.when((F.col("n") >= LEAST_ROWS) & (F.col("m") != 0), F.col("s") / F.when(F.col("m") != 0, F.col("m")))
    return _criterion(d, "rate_heterogeneity", v, v > CV, f"cv of {column}")


def temporal_signal(df: DataFrame, key: str = "customer_id", at: str = "as_of") -> DataFrame:
    """Mean correlation of velocity_5m and velocity_24h over customers with 5 rows, of which 10 are needed; else lag-1 autocorrelation over those with 10."""
    both = df.where(F.col("velocity_5m").isNotNull() & F.col("velocity_24h").isNotNull())
    lag = F.lag("velocity_5m").over(Window.partitionBy(key).orderBy(at))
    d = both.withColumn("_lag", lag).groupBy(key).agg(F.count("*").alias("n"), r.correlation(F.col("velocity_5m").cast("double"), F.col("velocity_24h").cast("double")).alias("c"), r.correlation(F.col("velocity_5m").cast("double"), F.col("_lag").cast("double")).alias("a"))
    clean = F.col
    s = d.agg(F.avg(F.when(F.col("n") >= 5, clean("c"))).alias("c"), F.count(F.when(F.col("n") >= 5, clean("c"))).alias("nc"), F.avg(F.when(F.col("n") >= 10, clean("a"))).alias("a"), F.count(F.when(F.col("n") >= 10, clean("a"))).alias("na"))
    v = F.when(F.col("nc") >= 10, F.col("c")).when(F.col("na") >= 10, F.col("a"))
    return _criterion(s, "temporal_signal", v, (v >= LOW) & (v <= HIGH), "mean correlation over customers")


def run(criteria: Sequence[DataFrame]) -> DataFrame:
    out = criteria[0]
    for c in criteria[1:]:
        out = out.unionByName(c)
    return out


def assert_passes(criteria: DataFrame) -> None:
    bad = [f"{c.criterion} = {c.value} ({c.note})" for c in criteria.where("not passed").collect()]
    if bad:
        raise ValueError("data gate: " + "; ".join(bad))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, nulls, mean, sd, least, greatest) of numeric columns, in one pass."""
    stats = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(F.col(c).cast("double")).alias("least"), F.max(F.col(c).cast("double")).alias("greatest"))
    return df.agg(F.array(*[stats(c) for c in columns]).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def segment_means(df: DataFrame, segment: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(segment).agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"))])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for each pair, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    d = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr")) for a, b in pairs]).alias("p"))
    return d.select(F.explode("p").alias("p")).select("p.*")


def decile_grid(df: DataFrame, x: str, y: str, value: str, n_bins: int = 10) -> DataFrame:
    """Mean of `value` over deciles of x (rows) and y (columns d0, d1, ...)."""
    d = r.qcut(r.qcut(df, x, n_bins, out="_a"), y, n_bins, out="_b")
    return d.groupBy(F.col("_a").alias("x_bin")).pivot("_b", list(range(n_bins))).agg(F.avg(value)).toDF("x_bin", *[f"d{i}" for i in range(n_bins)])


def buckets(df: DataFrame, x: str, y: str, n_bins: int = 10) -> DataFrame:
    """n, means of x and y and the spread of y by quantile bucket of x."""
    return r.qcut(df, x, n_bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.stddev_samp(y).alias("sd_y"))


def monotonicity(rows: DataFrame) -> DataFrame:
    """Rank correlation of bucket means and what it says."""
    d = r.spearman(rows, "mean_x", "mean_y")
    s = F.col("spearman")
    return d.select("spearman", F.when(s >= 0.7, "increasing").when(s <= -0.7, "decreasing").when(F.abs(s) < 0.3, "flat").otherwise("mixed").alias("verdict"))
