"""Feature views: a function per view, DataFrame to DataFrame, for batch and streaming inputs.

Windows are aligned to the epoch. closed_only leaves out the windows that are still open at the
newest event, as a stream in append mode does; by default open windows show, as in update mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.carry import running

CASH_ADVANCE_MCC = 6010
GAP_CAP_S = 3600
HORIZONS = {"5m": "5 minutes", "1h": "1 hour", "24h": "24 hours", "7d": "7 days", "30d": "30 days"}
#: What training reads of each view.
PROJECTIONS = {
    "5m": ("customer_id", "window_end", "velocity_5m", "total_spend_5m", "avg_spend_5m", "utilization"),
    "1h": ("customer_id", "window_end", "velocity_1h", "total_spend_1h", "avg_spend_1h", "mcc_entropy_1h"),
    "24h": ("customer_id", "window_end", "velocity_24h", "total_spend_24h", "avg_spend_24h", "pct_late_night_24h", "avg_interarrival_24h"),
    "7d": ("customer_id", "window_end", "velocity_7d", "total_spend_7d", "geo_variance_7d"),
    "30d": ("customer_id", "window_end", "velocity_30d", "total_spend_30d", "paydown_rate_30d", "pct_cash_advance_30d", "avg_utilization_30d"),
    "attributes": ("customer_id", "credit_score", "annual_income", "account_tenure_months", "n_products", "prev_delinquency_count"),
}
#: The order of a model's inputs; fixed values.
FEATURES = tuple(c for h in ("5m", "1h", "24h", "7d", "30d") for c in PROJECTIONS[h][2:]) + PROJECTIONS["attributes"][1:]


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return F.when(y != 0, x / y)


def enrich(tx: DataFrame, first_gap: str = "null") -> DataFrame:
    """Each event with its customer's previous balance and time, and what follows from them.

    first_gap: what a customer's first event has as time since the last, "null" or "cap".
    """
    d = running(tx.withColumn("_now", F.struct("current_balance", "event_time")), ["customer_id"], ["event_time", "event_id"], last={"_before": "_now"}, own=False)
    d = d.withColumns({"prev_balance": F.col("_before.current_balance"), "prev_time": F.col("_before.event_time")}).drop("_now", "_before")
    return enriched_columns(d, first_gap)


def enriched_columns(d: DataFrame, first_gap: str = "null") -> DataFrame:
    """The columns that follow from prev_balance and prev_time."""
    gap = F.expr("timestampdiff(SECOND, prev_time, event_time)").cast("double")
    capped = F.least(gap, F.lit(float(GAP_CAP_S)))
    hour = F.hour("event_time")
    return d.withColumns(
        {
            "is_paydown": F.when(F.col("prev_balance").isNotNull() & (F.col("prev_balance") > F.col("current_balance")) & (gap <= GAP_CAP_S), 1).otherwise(0),
            "is_cash_advance": F.when(F.col("mcc") == CASH_ADVANCE_MCC, 1).otherwise(0),
            "is_late_night": F.when((hour >= 22) | (hour < 4), 1).otherwise(0),
            "time_since_last_s": F.when(F.col("prev_time").isNull(), F.lit(None) if first_gap == "null" else F.lit(float(GAP_CAP_S))).otherwise(capped),
        }
    )


def _windowed(d: DataFrame, horizon: str, *more: str):
    return d.groupBy("customer_id", F.window("event_time", HORIZONS[horizon]).alias("w"), *more)


def _flat(d: DataFrame, closed_before: DataFrame | None) -> DataFrame:
    out = d.select("customer_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in d.columns if c not in ("customer_id", "w")])
    if closed_before is None:
        return out
    newest = closed_before.agg(F.max("event_time").alias("newest"))
    return out.join(F.broadcast(newest), F.col("window_end") <= F.col("newest")).drop("newest")


def _spend(h: str) -> list[Column]:
    return [F.count("*").cast("int").alias(f"velocity_{h}"), F.sum("amount").alias(f"total_spend_{h}"), F.avg("amount").alias(f"avg_spend_{h}")]


def view_5m(tx: DataFrame, *, closed_only: bool = False) -> DataFrame:
    d = _windowed(tx, "5m").agg(*_spend("5m"), ratio(F.max("current_balance"), F.max("credit_limit")).alias("utilization"))
    return _flat(d, tx if closed_only else None)


def mcc_counts_1h(tx: DataFrame) -> DataFrame:
    d = _windowed(tx, "1h", "mcc").agg(F.count("*").alias("mcc_cnt"), F.sum("amount").alias("mcc_spend"))
    return _flat(d, None)


def view_1h(tx: DataFrame, *, closed_only: bool = False) -> DataFrame:
    """One pass: counts by category first, then entropy as ln N - sum(c ln c) / N, with no join back."""
    by_mcc = _windowed(tx, "1h", "mcc").agg(F.count("*").alias("c"), F.sum("amount").alias("s"))
    n = F.sum("c")
    entropy = F.round(F.ln(n) - F.sum(F.col("c") * F.ln("c")) / n, 12) + 0.0
    d = by_mcc.groupBy("customer_id", "w").agg(n.cast("int").alias("velocity_1h"), F.sum("s").alias("total_spend_1h"), (F.sum("s") / n).alias("avg_spend_1h"), entropy.alias("mcc_entropy_1h"))
    return _flat(d, tx if closed_only else None)


def view_24h(enriched: DataFrame, *, closed_only: bool = False) -> DataFrame:
    d = _windowed(enriched, "24h").agg(*_spend("24h"), F.avg("is_late_night").alias("pct_late_night_24h"), F.avg("time_since_last_s").alias("avg_interarrival_24h"))
    return _flat(d, enriched if closed_only else None)


def view_7d(tx: DataFrame, *, closed_only: bool = False) -> DataFrame:
    d = _windowed(tx, "7d").agg(*_spend("7d")[:2], (F.var_pop("geo_lat") + F.var_pop("geo_lon")).alias("geo_variance_7d"))
    return _flat(d, tx if closed_only else None)


def view_30d(enriched: DataFrame, *, closed_only: bool = False) -> DataFrame:
    use = ratio(F.col("current_balance"), F.col("credit_limit"))
    d = _windowed(enriched, "30d").agg(*_spend("30d")[:2], F.avg("is_paydown").alias("paydown_rate_30d"), F.avg("is_cash_advance").alias("pct_cash_advance_30d"), F.avg(use).alias("avg_utilization_30d"))
    return _flat(d, enriched if closed_only else None)


def attributes(tx: DataFrame) -> DataFrame:
    """Constants of each customer, as the greatest value seen."""
    return tx.groupBy("customer_id").agg(*[F.max(c).alias(c) for c in PROJECTIONS["attributes"][1:]])


def latest(view: DataFrame, at: str = "window_end") -> DataFrame:
    """Each customer's row of greatest window_end."""
    rest = [c for c in view.columns if c not in ("customer_id", at)]
    d = view.groupBy("customer_id").agg(F.max_by(F.struct(at, *rest), F.col(at)).alias("r"))
    return d.select("customer_id", *[f"r.{c}" for c in (at, *rest)])


def all_views(tx: DataFrame, with_attributes: DataFrame, *, closed_only: bool = False) -> dict[str, DataFrame]:
    """Every view, lazily, cut to what training reads. All but the first group the same enriched events by customer."""
    e = enrich(tx)
    made = {"5m": view_5m(tx, closed_only=closed_only), "1h": view_1h(tx, closed_only=closed_only), "24h": view_24h(e, closed_only=closed_only), "7d": view_7d(tx, closed_only=closed_only), "30d": view_30d(e, closed_only=closed_only), "attributes": attributes(with_attributes)}
    return {h: d.select(*PROJECTIONS[h]) for h, d in made.items()}


def serving(views: dict[str, DataFrame]) -> DataFrame:
    """One row per customer: the latest row of each horizon with its window's end as as_of_<h>, and the attributes."""
    out = None
    for h in HORIZONS:
        part = latest(views[h]).withColumnRenamed("window_end", f"as_of_{h}")
        out = part if out is None else out.join(part, "customer_id", "full_outer")
    return out.join(views["attributes"], "customer_id", "full_outer")


def model_vector(serving_rows: DataFrame) -> DataFrame:
    """The model's inputs in their fixed order, nulls as 0."""
    return serving_rows.select("customer_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])
