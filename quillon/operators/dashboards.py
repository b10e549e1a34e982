"""The decision log over time, and the rule that takes a model back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAST_N, LEAST = 200, 10
ERROR_MAX, LATENCY_RISE, PROFIT_DROP = 0.01, 0.20, 0.10


def _start(width: str):
    return F.window("ts", width)["start"].alias("window_start")


def volume(log: DataFrame, width: str = "1 minute") -> DataFrame:
    """Requests, error rate and latency quantiles by window."""
    return log.groupBy(_start(width)).agg(F.count("*").alias("n"), F.avg(F.col("is_error").cast("int")).alias("error_rate"), F.percentile("latency_ms", 0.5).alias("p50"), F.percentile("latency_ms", 0.99).alias("p99"))


def action_mix(log: DataFrame, width: str = "5 minutes") -> DataFrame:
    d = log.groupBy(_start(width), "action").agg(F.count("*").alias("n"))
    return d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("window_start")))


def alias_profit(log: DataFrame, width: str = "5 minutes") -> DataFrame:
    return log.groupBy(_start(width), "alias").agg(F.count("*").alias("n"), F.avg("reward").alias("mean_profit"))


def rolling_profit(log: DataFrame, width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Mean profit by alias over sliding windows."""
    w = F.window("ts", width, slide)
    return log.groupBy(w.alias("w"), "alias").agg(F.count("*").alias("n"), F.avg("reward").alias("mean_profit")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "alias", "n", "mean_profit")


def latest(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("decision_id")).limit(n)


def _cut(log: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Rows by group that are no older than the group's 2n-th newest minute allows: a bound from counts, so no group is sorted whole."""
    minute = F.date_trunc("minute", "ts")
    counts = log.groupBy(*by, minute.alias("_minute")).agg(F.count("*").alias("_n"))
    newer = Window.partitionBy(*by).orderBy(F.desc("_minute")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    kept = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).withColumn("_all", F.sum("_n").over(whole)).where(F.col("_newer") < 2 * n)
    return log.withColumn("_minute", minute).join(kept.select(*by, "_minute", "_all"), [*by, "_minute"]).drop("_minute")


def windows(log: DataFrame, *, by: Sequence[str] = (), n: int = LAST_N) -> DataFrame:
    """Metrics of the last n rows and of the n before, by group; null below LEAST rows, baseline from n + LEAST rows on."""
    by = list(by)
    if not by:
        log, by = log.withColumn("_one", F.lit(1)), ["_one"]
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("decision_id")))
    d = _cut(log, by, n).withColumn("_k", nth)
    now, before = F.col("_k") <= n, (F.col("_k") > n) & (F.col("_k") <= 2 * n)
    pick = lambda c, x: F.when(c, x)
    m = d.groupBy(*by).agg(
        F.first("_all").alias("n_rows"),
        F.percentile(pick(now, F.col("latency_ms")), 0.99).alias("p99"), F.avg(pick(now, F.col("reward"))).alias("mean_profit"), F.avg(pick(now, F.col("is_error").cast("int"))).alias("error_rate"),
        F.percentile(pick(before, F.col("latency_ms")), 0.99).alias("base_p99"), F.avg(pick(before, F.col("reward"))).alias("base_profit"),
    )
    return m.drop("_one")


def rollback(log: DataFrame, *, by: Sequence[str] = (), n: int = LAST_N) -> DataFrame:
    """Whether errors, latency or profit of the last n rows call for the previous model, and which; zero baselines are not divided by, bounds are strict."""
    m = windows(log, by=by, n=n).where(F.col("n_rows") >= n + LEAST)
    slow = (F.col("base_p99") > 0) & ((F.col("p99") - F.col("base_p99")) / F.col("base_p99") > LATENCY_RISE)
    poor = (F.col("base_profit") > 0) & ((F.col("base_profit") - F.col("mean_profit")) / F.col("base_profit") > PROFIT_DROP)
    reason = F.when(F.col("error_rate") > ERROR_MAX, "error_rate").when(slow, "p99").when(poor, "profit")
    return m.withColumn("reason", reason).withColumn("rollback", F.col("reason").isNotNull()).drop("n_rows")
