"""Queries on behavioural features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import asof, views
from quillon.plans.catalog import register
from quillon.sources import adapter as a


def rounded(df: DataFrame, digits: int = 6, *shifted: str) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show.

    Products, means and variances of values with few decimals often end in an exact 5, which
    either side may round its way; such columns are named, and shifted by a fraction of the last digit.
    """
    shift = lambda n: F.lit(3.719 * 10.0 ** -(digits + 2)) if n in shifted else F.lit(0.0)
    return df.select(*[F.round(F.col(f"`{f.name}`") + shift(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def _bucket(seconds: int) -> str:
    """Epoch-aligned start of a window of so many seconds."""
    return f"make_timestamp((epoch_us(event_time) // {seconds * 10**6}::BIGINT) * {seconds * 10**6}::BIGINT)"


SECONDS = {"5m": 300, "1h": 3600, "24h": 86400, "7d": 604800, "30d": 2592000}

ENRICHED_SQL = f"""{a.TX_SQL},
lagged AS (
  SELECT *, lag(current_balance) OVER w AS prev_balance, lag(event_time) OVER w AS prev_time FROM tx WINDOW w AS (PARTITION BY customer_id ORDER BY event_time, event_id)),
enriched AS (
  SELECT *, CASE WHEN prev_balance IS NOT NULL AND prev_balance > current_balance AND epoch(event_time) - epoch(prev_time) <= 3600 THEN 1 ELSE 0 END AS is_paydown,
         CASE WHEN mcc = 6010 THEN 1 ELSE 0 END AS is_cash_advance,
         CASE WHEN hour(event_time) >= 22 OR hour(event_time) < 4 THEN 1 ELSE 0 END AS is_late_night,
         CASE WHEN prev_time IS NULL THEN NULL ELSE least(epoch(event_time) - epoch(prev_time), 3600.0::DOUBLE) END AS time_since_last_s
  FROM lagged)"""


def _view_sql(h: str, select: str, source: str = "tx", by: str = "") -> str:
    w = _bucket(SECONDS[h])
    return f"SELECT customer_id, {w} AS window_start, {w} + INTERVAL {SECONDS[h]} SECOND AS window_end, {select} FROM {source} GROUP BY customer_id, {w}{by}"


def _spend(h: str, avg: bool = True) -> str:
    out = f"count(*)::INT AS velocity_{h}, round(sum(amount), 6) AS total_spend_{h}"
    return out + f", round(avg(amount), 6) AS avg_spend_{h}" if avg else out


V5M = _view_sql("5m", _spend("5m") + ", round(max(current_balance) / nullif(max(credit_limit), 0), 6) AS utilization")
MCC = _view_sql("1h", "mcc, count(*) AS mcc_cnt, round(sum(amount), 6) AS mcc_spend", by=", mcc")
V1H = f"""SELECT customer_id, window_start, window_end, sum(mcc_cnt)::INT AS velocity_1h, round(sum(s), 6) AS total_spend_1h, round(sum(s) / sum(mcc_cnt), 6) AS avg_spend_1h,
       round(round(-sum(mcc_cnt / n * ln(mcc_cnt / n)), 9) + 0.0, 6) + 0.0 AS mcc_entropy_1h
FROM (SELECT *, sum(mcc_cnt) OVER (PARTITION BY customer_id, window_start) AS n FROM (
  {_view_sql("1h", "mcc, count(*) AS mcc_cnt, sum(amount) AS s", by=", mcc")})) GROUP BY ALL"""
V24H = _view_sql("24h", _spend("24h") + ", round(avg(is_late_night), 6) AS pct_late_night_24h, round(avg(time_since_last_s), 6) AS avg_interarrival_24h", "enriched")
V7D = _view_sql("7d", _spend("7d", False) + ", round(var_pop(geo_lat) + var_pop(geo_lon) + 3.719e-8::DOUBLE, 6) AS geo_variance_7d")
V30D = _view_sql("30d", _spend("30d", False) + ", round(avg(is_paydown), 6) AS paydown_rate_30d, round(avg(is_cash_advance), 6) AS pct_cash_advance_30d, round(avg(current_balance / nullif(credit_limit, 0)), 6) AS avg_utilization_30d", "enriched")
ATTRIBUTES = "SELECT customer_id, max(c.credit_score) AS credit_score, round(max(c.annual_income), 6) AS annual_income, max(c.account_tenure_months) AS account_tenure_months, max(c.n_products) AS n_products, max(c.prev_delinquency_count) AS prev_delinquency_count FROM tx JOIN cust c USING (customer_id) GROUP BY customer_id"
VIEWS_SQL = f"""{ENRICHED_SQL}, {a.CUSTOMERS_SQL}, v5m AS ({V5M}), v1h AS ({V1H}), v24h AS ({V24H}), v7d AS ({V7D}), v30d AS ({V30D}), attrs AS ({ATTRIBUTES})"""


def _latest_sql(h: str, columns: tuple[str, ...], name: str | None = None) -> str:
    shown = ", ".join(["customer_id", f"window_end AS {name or 'window_end'}", *columns])
    return f"SELECT {shown} FROM v{h} QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY window_end DESC) = 1"


_H = ("5m", "1h", "24h", "7d", "30d")
SERVING_SQL = VIEWS_SQL + "".join(f", l{h} AS ({_latest_sql(h, views.PROJECTIONS[h][2:], f'as_of_{h}')})" for h in _H) + ", serving AS (SELECT * FROM l5m " + " ".join(f"FULL JOIN l{h} USING (customer_id)" for h in _H[1:]) + " FULL JOIN attrs USING (customer_id))"
TRAINING_SQL = VIEWS_SQL + ", training AS (SELECT b.customer_id, b.window_end AS as_of, " + ", ".join(f"b.{c}" for c in views.PROJECTIONS["5m"][2:]) + "".join(f", v{h}.window_end AS as_of_{h}, " + ", ".join(f"v{h}.{c}" for c in views.PROJECTIONS[h][2:]) for h in _H[1:]) + ", " + ", ".join(f"attrs.{c}" for c in views.PROJECTIONS["attributes"][1:]) + " FROM v5m b " + " ".join(f"ASOF LEFT JOIN v{h} ON b.customer_id = v{h}.customer_id AND b.window_end >= v{h}.window_end" for h in _H[1:]) + " LEFT JOIN attrs ON b.customer_id = attrs.customer_id)"


@register("events_enriched", f"WITH {ENRICHED_SQL} SELECT event_id, customer_id, event_time, mcc, prev_balance, prev_time, is_paydown, is_cash_advance, is_late_night, time_since_last_s FROM enriched")
def events_enriched(spark, sf_dir):
    return views.enrich(a.transactions(spark, sf_dir)).select("event_id", "customer_id", "event_time", "mcc", "prev_balance", "prev_time", "is_paydown", "is_cash_advance", "is_late_night", "time_since_last_s")


@register("view_5m", f"WITH {a.TX_SQL} {V5M}")
def view_5m(spark, sf_dir):
    return rounded(views.view_5m(a.transactions(spark, sf_dir)))


@register("view_5m_closed", f"WITH {a.TX_SQL} SELECT * FROM ({V5M}) WHERE window_end <= (SELECT max(event_time) FROM tx)")
def view_5m_closed(spark, sf_dir):
    return rounded(views.view_5m(a.transactions(spark, sf_dir), closed_only=True))


@register("mcc_counts_1h", f"WITH {a.TX_SQL} {MCC}")
def mcc_counts_1h(spark, sf_dir):
    return rounded(views.mcc_counts_1h(a.transactions(spark, sf_dir)))


@register("view_1h", f"WITH {a.TX_SQL} {V1H}")
def view_1h(spark, sf_dir):
    return rounded(views.view_1h(a.transactions(spark, sf_dir)))


@register("view_24h", f"WITH {ENRICHED_SQL} {V24H}")
def view_24h(spark, sf_dir):
    return rounded(views.view_24h(views.enrich(a.transactions(spark, sf_dir))))


@register("view_7d", f"WITH {a.TX_SQL} {V7D}")
def view_7d(spark, sf_dir):
    return rounded(views.view_7d(a.transactions(spark, sf_dir)), 6, "geo_variance_7d")


@register("view_30d", f"WITH {ENRICHED_SQL} {V30D}")
def view_30d(spark, sf_dir):
    return rounded(views.view_30d(views.enrich(a.transactions(spark, sf_dir))))


@register("customer_attributes", f"WITH {a.TX_SQL}, {a.CUSTOMERS_SQL} {ATTRIBUTES}")
def customer_attributes(spark, sf_dir):
    return rounded(views.attributes(a.transactions_with_attributes(spark, sf_dir)))


@register("latest_5m", f"WITH {a.TX_SQL}, v5m AS ({V5M}) " + _latest_sql("5m", ("window_start", *views.PROJECTIONS["5m"][2:])))
def latest_5m(spark, sf_dir):
    return rounded(views.latest(views.view_5m(a.transactions(spark, sf_dir))))


def _all(spark, sf_dir):
    return views.all_views(a.transactions(spark, sf_dir), a.transactions_with_attributes(spark, sf_dir))


def _training(spark, sf_dir):
    return asof.assemble(_all(spark, sf_dir), events=a.transactions(spark, sf_dir))


@register("serving_features", f"WITH {SERVING_SQL} SELECT * FROM serving")
def serving_features(spark, sf_dir):
    return rounded(views.serving(_all(spark, sf_dir)), 6, "geo_variance_7d")


@register("model_vector", f"WITH {SERVING_SQL} SELECT customer_id, " + ", ".join(f"round(coalesce({c}, 0)::DOUBLE, 6) AS {c}" for c in views.FEATURES) + " FROM serving")
def model_vector(spark, sf_dir):
    return rounded(views.model_vector(views.serving(_all(spark, sf_dir))), 6, "geo_variance_7d")


@register("training_frame", f"WITH {TRAINING_SQL} SELECT * FROM training")
def training_frame(spark, sf_dir):
    return rounded(_training(spark, sf_dir), 6, "geo_variance_7d")


@register("point_in_time_violations", f"WITH {TRAINING_SQL} " + " UNION ALL ".join(f"SELECT 'as_of_{h}' AS \"column\", count(*) FILTER (as_of_{h} > as_of) AS violations FROM training" for h in _H[1:]))
def point_in_time_violations(spark, sf_dir):
    return asof.violations(_training(spark, sf_dir))


@register("asof_orders_to_events", """SELECT o_orderkey, o_custkey, o_orderdate, e.event_id, e.ts AS seen_at FROM orders ASOF LEFT JOIN (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY ALL) e ON o_custkey = e.user_id AND o_orderdate >= e.ts""")
def asof_orders_to_events(spark, sf_dir):
    base = a.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey"), "o_orderdate")
    right = a.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("o_custkey"), "ts").agg(F.min("event_id").alias("event_id"))
    return asof.asof_join(base, right, by="o_custkey", left_on="o_orderdate", right_on="ts", freshness="seen_at")


@register("customer_lookup", f"WITH {SERVING_SQL} SELECT customer_id, velocity_5m, velocity_30d FROM serving WHERE customer_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def customer_lookup(spark, sf_dir):
    wanted = a.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("customer_id")).distinct()
    own = lambda d: d.join(wanted, "customer_id", "left_semi")
    v = views.all_views(own(a.transactions(spark, sf_dir)), own(a.transactions_with_attributes(spark, sf_dir)))
    return views.serving(v).select("customer_id", "velocity_5m", "velocity_30d")


@register("feature_coverage", f"WITH {TRAINING_SQL}, r AS (SELECT (customer_id % 6)::INT AS segment_id, * FROM training) SELECT segment_id, count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, round(avg((avg_interarrival_24h IS NOT NULL)::INT), 6) AS avg_interarrival_24h, round(avg((geo_variance_7d IS NOT NULL)::INT), 6) AS geo_variance_7d, round(avg((mcc_entropy_1h IS NOT NULL)::INT), 6) AS mcc_entropy_1h FROM r GROUP BY 1")
def feature_coverage(spark, sf_dir):
    d = _training(spark, sf_dir).withColumn("segment_id", (F.col("customer_id") % 6).cast("int"))
    cover = [F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in ("avg_interarrival_24h", "geo_variance_7d", "mcc_entropy_1h")]
    return rounded(d.groupBy("segment_id").agg(F.count("*").alias("n_rows"), F.countDistinct("customer_id").alias("n_customers"), *cover))
