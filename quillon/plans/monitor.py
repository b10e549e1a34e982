"""Queries on drift, fairness and the decision log, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import dashboards, drift, fairness
from quillon.plans.catalog import register
from quillon.plans.features import rounded
from quillon.plans.risk import bin_sql, edges_sql
from quillon.sources import adapter as a

FEATURES = ("quantity", "price", "discount")
MIDDLE = "1998-06-01"
LONG_SQL = f"{a.SCORED_SQL}, long AS (" + " UNION ALL ".join(f"SELECT segment, '{f}' AS feature, {f}::DOUBLE AS x, (ts >= TIMESTAMP '{MIDDLE}')::INT AS c FROM scored" for f in FEATURES) + ")"


def _halves(spark, sf_dir):
    d = a.scored_accounts(spark, sf_dir)
    late = F.col("ts") >= F.lit(MIDDLE).cast("timestamp_ntz")
    return d.where(~late), d.where(late)


def _left(x: str) -> str:
    return f"len(list_filter(edges[2:len(edges) - 1], lambda e: e <= {x}))"


def _psi_sql(keys: str, name: str, smooth: str, inside: bool) -> str:
    outside = "WHERE x >= edges[1] AND x <= edges[-1]" if inside else ""
    return f"""{edges_sql('(SELECT * FROM long WHERE c = 0)', 'x', keys, name='edges')},
hist AS (SELECT {keys}, {_left('x')} AS bin, count(*) FILTER (c = 0) AS r, count(*) FILTER (c = 1) AS q FROM long JOIN edges USING ({keys}) {outside} GROUP BY ALL),
spine AS (SELECT {keys}, unnest(range(0, greatest(len(edges) - 1, 1))) AS bin FROM edges),
full_hist AS (SELECT {keys}, bin, coalesce(r, 0) AS r, coalesce(q, 0) AS q FROM spine LEFT JOIN hist USING ({keys}, bin)),
share AS (SELECT {keys}, r, q, {smooth.format(x=f'(r::DOUBLE / greatest(sum(r) OVER (PARTITION BY {keys}), 1))')} AS pr, {smooth.format(x=f'(q::DOUBLE / greatest(sum(q) OVER (PARTITION BY {keys}), 1))')} AS pq FROM full_hist),
{name} AS (SELECT {keys}, sum((pq - pr) * ln(pq / pr)) AS v, sum(r)::BIGINT AS ref, sum(q)::BIGINT AS cur FROM share GROUP BY {keys})"""


@register("drift_psi", f"WITH {LONG_SQL}, {_psi_sql('feature', 'psi', '({x} + 1e-6::DOUBLE)', True)} SELECT 'psi' AS detector, feature, round(v, 6) AS statistic, 0.2::DOUBLE AS threshold, v > 0.2 AS is_drifting FROM psi")
def drift_psi(spark, sf_dir):
    return rounded(drift.psi(*_halves(spark, sf_dir), FEATURES))


@register("drift_psi_by_segment", f"WITH {LONG_SQL}, {_psi_sql('segment, feature', 'psi', '({x} + 1e-6::DOUBLE)', True)} SELECT 'psi' AS detector, feature || '@segment_' || segment AS feature, round(v, 6) AS statistic, 0.2::DOUBLE AS threshold, v > 0.2 AS is_drifting FROM psi")
def drift_psi_by_segment(spark, sf_dir):
    return rounded(drift.psi(*_halves(spark, sf_dir), FEATURES, by=["segment"]))


@register("csi_report", f"WITH {LONG_SQL}, {_psi_sql('feature', 'psi', 'greatest({x}, 1e-6::DOUBLE)', False)} SELECT feature, round(v, 6) AS csi, CASE WHEN v < 0.1 THEN 'stable' WHEN v < 0.25 THEN 'minor_shift' ELSE 'major_shift' END AS classification, ref, cur FROM psi")
def csi_report(spark, sf_dir):
    return rounded(drift.csi(*_halves(spark, sf_dir), FEATURES))


KS_SQL = "SELECT feature, max(abs(cr / nr - cc / nc)) AS d, any_value(nr) AS nr, any_value(nc) AS nc FROM (SELECT feature, x, sum(sum(1 - c)) OVER (PARTITION BY feature ORDER BY x)::DOUBLE AS cr, sum(sum(c)) OVER (PARTITION BY feature ORDER BY x)::DOUBLE AS cc, sum(sum(1 - c)) OVER (PARTITION BY feature)::DOUBLE AS nr, sum(sum(c)) OVER (PARTITION BY feature)::DOUBLE AS nc FROM long GROUP BY feature, x) GROUP BY feature"


@register("drift_ks_distance", f"WITH {LONG_SQL} SELECT feature, round(d, 6) AS d FROM ({KS_SQL})")
def drift_ks_distance(spark, sf_dir):
    return rounded(drift.ks_distance(*_halves(spark, sf_dir), FEATURES))


@register("drift_ks", f"WITH {LONG_SQL}, t AS (SELECT feature, d * sqrt(nr * nc / (nr + nc)) AS t FROM ({KS_SQL})), p AS (SELECT feature, CASE WHEN t < 0.2 THEN 1.0::DOUBLE ELSE greatest(0, least(1, 2 * (SELECT sum((CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * i * i * t * t)) FROM range(1, 101) r(i)))) END AS p FROM t) SELECT 'ks' AS detector, feature, round(p, 6) AS statistic, 0.05::DOUBLE AS threshold, p < 0.05 AS is_drifting FROM p")
def drift_ks(spark, sf_dir):
    return rounded(drift.ks(*_halves(spark, sf_dir), FEATURES))


@register("drift_js", f"WITH {LONG_SQL}, rg AS (SELECT feature, min(x) AS lo, max(x) AS hi, sum(1 - c)::DOUBLE AS nr, sum(c)::DOUBLE AS nc FROM long GROUP BY 1), h AS (SELECT feature, least(floor((x - lo) / ((hi - lo) / 20)), 19)::INT AS bin, sum(1 - c) AS r, sum(c) AS q FROM long JOIN rg USING (feature) GROUP BY ALL), f AS (SELECT feature, (coalesce(r, 0) + 1e-9::DOUBLE) / (nr + 20 * 1e-9::DOUBLE) AS p, (coalesce(q, 0) + 1e-9::DOUBLE) / (nc + 20 * 1e-9::DOUBLE) AS q FROM (SELECT *, unnest(range(0, 20))::INT AS bin FROM rg) LEFT JOIN h USING (feature, bin)), j AS (SELECT feature, sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0)) AS v FROM f GROUP BY 1) SELECT 'js_divergence' AS detector, feature, round(v, 6) AS statistic, 0.1::DOUBLE AS threshold, v > 0.1 AS is_drifting FROM j")
def drift_js(spark, sf_dir):
    return rounded(drift.js(*_halves(spark, sf_dir), FEATURES))


def _with_gaps(d):
    return d.withColumn("price", F.when((F.col("l_orderkey") % 10 < 1) & (F.year("ts") >= 1999), None).otherwise(F.col("price")))


@register("drift_missingness", f"WITH {a.SCORED_SQL} SELECT 'schema' AS detector, 'price' AS feature, round(avg(CASE WHEN late THEN m END) - avg(CASE WHEN NOT late THEN m END), 6) AS statistic, 0.05::DOUBLE AS threshold, avg(CASE WHEN late THEN m END) - avg(CASE WHEN NOT late THEN m END) > 0.05 AS is_drifting FROM (SELECT ts >= TIMESTAMP '{MIDDLE}' AS late, (l_orderkey % 10 < 1 AND year(ts) >= 1999)::INT AS m FROM scored)")
def drift_missingness(spark, sf_dir):
    ref, cur = _halves(spark, sf_dir)
    return rounded(drift.missingness(_with_gaps(ref), _with_gaps(cur), ["price"]))


@register("performance_gap", f"WITH {a.DECISIONS_SQL} SELECT 'performance_gap' AS detector, 'overall@segment_' || segment_id AS feature, round(abs(avg(mu_logged) - avg(reward)) / abs(avg(mu_logged)), 6) AS statistic, 0.15::DOUBLE AS threshold, abs(avg(mu_logged) - avg(reward)) / abs(avg(mu_logged)) > 0.15 AS is_drifting FROM dec GROUP BY segment_id")
def performance_gap(spark, sf_dir):
    return rounded(drift.performance_gap(a.decisions(spark, sf_dir), "mu_logged", "reward", by=["segment_id"]))


@register("count_windows", f"WITH {a.TX_SQL}, k AS (SELECT *, (row_number() OVER (ORDER BY event_time, event_id) - 1) // 500 AS win, count(*) OVER () AS n FROM tx) SELECT win, count(*) AS n, round(avg(amount), 6) AS mean_amount FROM k WHERE win < n // 500 GROUP BY win")
def count_windows(spark, sf_dir):
    d = drift.count_windows(a.transactions(spark, sf_dir), ["event_time", "event_id"], 500)
    return rounded(d.groupBy("win").agg(F.count("*").alias("n"), F.avg("amount").alias("mean_amount")))


def _windows_sql(*features: str) -> str:
    sides = " UNION ALL ".join(f"SELECT w AS win, '{f}' AS feature, {f}::DOUBLE AS x, 1 AS c FROM k WHERE w < n // 500 AND w > 0 UNION ALL SELECT w + 1, '{f}', {f}::DOUBLE, 0 FROM k WHERE w + 1 < n // 500" for f in features)
    return f"{a.TX_SQL}, k AS (SELECT *, (row_number() OVER (ORDER BY event_time, event_id) - 1) // 500 AS w, count(*) OVER () AS n FROM tx), long AS ({sides})"


MONITOR_SQL = _windows_sql("amount")


@register("windowed_psi", f"WITH {MONITOR_SQL}, {_psi_sql('win, feature', 'psi', '({x} + 1e-6::DOUBLE)', True)} SELECT win, 'psi' AS detector, feature, round(v, 6) AS statistic, 0.2::DOUBLE AS threshold, v > 0.2 AS is_drifting FROM psi")
def windowed_psi(spark, sf_dir):
    d = drift.windowed_monitor(a.transactions(spark, sf_dir), ["amount"], ["event_time", "event_id"])
    return rounded(d.where("detector = 'psi'"))


#: Columns of the transactions that the windowed monitor watches.
WATCHED = ("amount", "mcc", "current_balance", "credit_limit", "geo_lat", "geo_lon", "segment_id", "customer_id")
_KS_BY = KS_SQL.replace("PARTITION BY feature", "PARTITION BY win, feature").replace("SELECT feature, ", "SELECT win, feature, ").replace("GROUP BY feature", "GROUP BY win, feature")


def signals_sql(*features: str) -> str:
    return f"""{_windows_sql(*features)}, {_psi_sql('win, feature', 'psi', '({x} + 1e-6::DOUBLE)', True)},
t AS (SELECT win, feature, d * sqrt(nr * nc / (nr + nc)) AS t FROM ({_KS_BY})), ksp AS (SELECT win, feature, CASE WHEN t < 0.2 THEN 1.0::DOUBLE ELSE greatest(0, least(1, 2 * (SELECT sum((CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * i * i * t * t)) FROM range(1, 101) r(i)))) END AS p FROM t),
rg AS (SELECT win, feature, min(x) AS lo, max(x) AS hi, sum(1 - c)::DOUBLE AS nr, sum(c)::DOUBLE AS nc FROM long GROUP BY ALL),
h AS (SELECT win, feature, CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 20)), 19) ELSE 10 END::INT AS bin, sum(1 - c) AS r, sum(c) AS q FROM long JOIN rg USING (win, feature) GROUP BY ALL),
f AS (SELECT win, feature, (coalesce(r, 0) + 1e-9::DOUBLE) / (nr + 20 * 1e-9::DOUBLE) AS p, (coalesce(q, 0) + 1e-9::DOUBLE) / (nc + 20 * 1e-9::DOUBLE) AS q FROM (SELECT *, unnest(range(0, 20))::INT AS bin FROM rg) LEFT JOIN h USING (win, feature, bin)),
jsd AS (SELECT win, feature, sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0)) AS v FROM f GROUP BY ALL),
sig AS (SELECT win, 'psi' AS detector, feature, v AS statistic, 0.2::DOUBLE AS threshold, v > 0.2 AS is_drifting FROM psi
  UNION ALL SELECT win, 'ks', feature, p, 0.05, p < 0.05 FROM ksp UNION ALL SELECT win, 'js_divergence', feature, v, 0.1, v > 0.1 FROM jsd
  UNION ALL SELECT win, 'schema', feature, 0.0, 0.05, false FROM rg)"""



@register("windowed_monitor", f"WITH {signals_sql(*WATCHED)} SELECT win, detector, feature, round(statistic, 5) AS statistic, threshold, is_drifting FROM sig")
def windowed_monitor(spark, sf_dir):
    return rounded(drift.windowed_monitor(a.transactions(spark, sf_dir), WATCHED, ["event_time", "event_id"]), 5)


@register("adwin_shifts")
def adwin_shifts(spark, sf_dir):
    d = a.transactions(spark, sf_dir).withColumn("tens", F.col("amount") / 10.0)
    return drift.adwin(d, "customer_id", ["event_time", "event_id"], "tens")


RATES_SQL = f"{a.SCORED_SQL}, rates AS (SELECT segment, grp, count(*) AS n, sum(y)::BIGINT AS n_positive, count(*) FILTER (p >= 0.5) AS n_selected, avg((p >= 0.5)::INT) AS selection_rate, avg(CASE WHEN y = 1 THEN (p >= 0.5)::INT END) AS tpr, avg(CASE WHEN y = 0 THEN (p >= 0.5)::INT END) AS fpr, avg(CASE WHEN p >= 0.5 THEN y END) AS ppv FROM scored GROUP BY ALL), rep AS (SELECT segment, count(*) AS n_groups, CASE WHEN max(selection_rate) = 0 THEN 1 ELSE min(selection_rate) / max(selection_rate) END AS parity_ratio, max(tpr) - min(tpr) AS tpr_gap, max(fpr) - min(fpr) AS fpr_gap, max(ppv) - min(ppv) AS ppv_gap FROM rates GROUP BY segment)"


def _rates(spark, sf_dir):
    return fairness.group_rates(a.scored_accounts(spark, sf_dir), "y", "p", "grp", by=["segment"])


@register("fairness_rates", f"WITH {RATES_SQL} SELECT segment, grp, n, n_positive, n_selected, round(selection_rate, 6) AS selection_rate, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(ppv, 6) AS ppv FROM rates")
def fairness_rates(spark, sf_dir):
    return rounded(_rates(spark, sf_dir))


@register("fairness_parity", f"WITH {RATES_SQL} SELECT segment, n_groups, round(parity_ratio, 6) AS parity_ratio, round(tpr_gap, 6) AS tpr_gap, round(fpr_gap, 6) AS fpr_gap, round(ppv_gap, 6) AS ppv_gap, parity_ratio >= 0.8 AS passes_ratio, coalesce(tpr_gap, 0) <= 0.1 AND coalesce(fpr_gap, 0) <= 0.1 AS passes_odds, coalesce(ppv_gap, 0) <= 0.1 AS passes_precision FROM rep")
def fairness_parity(spark, sf_dir):
    return rounded(fairness.parity(_rates(spark, sf_dir), by=["segment"]))


@register("fairness_gauges", f"WITH {RATES_SQL}, r1 AS (SELECT grp, count(*) AS n, avg((p >= 0.5)::INT) AS selection_rate, avg(CASE WHEN y = 1 THEN (p >= 0.5)::INT END) AS tpr, avg(CASE WHEN y = 0 THEN (p >= 0.5)::INT END) AS fpr, avg(CASE WHEN p >= 0.5 THEN y END) AS ppv FROM scored GROUP BY 1) SELECT 'linestatus' AS dimension, grp, metric, round(value, 6) AS value FROM (UNPIVOT r1 ON selection_rate, tpr, fpr, ppv INTO NAME metric VALUE value)")
def fairness_gauges(spark, sf_dir):
    return rounded(fairness.gauges(fairness.group_rates(a.scored_accounts(spark, sf_dir), "y", "p", "grp"), "linestatus"))


@register("score_buckets", f"WITH {a.ACCOUNTS_SQL}, {edges_sql('acc', 'credit_score', n=5)} SELECT account_id, {bin_sql('credit_score')}::INT AS bucket FROM acc, edges")
def score_buckets(spark, sf_dir):
    return fairness.score_buckets(a.accounts(spark, sf_dir), "credit_score").select("account_id", "bucket")


def _win(minutes: int) -> str:
    us = minutes * 60 * 10**6
    return f"make_timestamp((epoch_us(ts) // {us}::BIGINT) * {us}::BIGINT)"


DAY = 24 * 60
LOG_SQL = f"WITH {a.DECISIONS_SQL} "


@register("log_volume", LOG_SQL + f"SELECT {_win(DAY)} AS window_start, count(*) AS n, round(avg(is_error::INT), 6) AS error_rate, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM dec GROUP BY 1")
def log_volume(spark, sf_dir):
    return rounded(dashboards.volume(a.decisions(spark, sf_dir), "1 day"))


@register("log_action_mix", LOG_SQL + f"SELECT *, round(n / sum(n) OVER (PARTITION BY window_start), 6) AS share FROM (SELECT {_win(DAY * 30)} AS window_start, action, count(*) AS n FROM dec GROUP BY ALL)")
def log_action_mix(spark, sf_dir):
    return rounded(dashboards.action_mix(a.decisions(spark, sf_dir), "30 days"))


@register("log_alias_profit", LOG_SQL + f"SELECT {_win(DAY * 30)} AS window_start, alias, count(*) AS n, round(avg(reward) + 3.719e-6::DOUBLE, 4) AS mean_profit FROM dec GROUP BY ALL")
def log_alias_profit(spark, sf_dir):
    return rounded(dashboards.alias_profit(a.decisions(spark, sf_dir), "30 days"), 4, "mean_profit")


@register("rolling_profit", LOG_SQL + f"SELECT w AS window_start, w + INTERVAL 10 DAY AS window_end, alias, count(*) AS n, round(avg(reward) + 3.719e-6::DOUBLE, 4) AS mean_profit FROM (SELECT *, {_win(DAY * 2)} - to_days((2 * i)::INT) AS w FROM dec, range(0, 5) r(i)) GROUP BY ALL")
def rolling_profit(spark, sf_dir):
    return rounded(dashboards.rolling_profit(a.decisions(spark, sf_dir), "10 days", "2 days"), 4, "mean_profit")


ROLL_SQL = a.DECISIONS_SQL + ", o AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY ts DESC, decision_id DESC) AS k, count(*) OVER (PARTITION BY alias) AS n FROM dec), m AS (SELECT alias, quantile_cont(latency_ms, 0.99) FILTER (k <= 200) AS c99, avg(reward) FILTER (k <= 200) AS cp, avg(is_error::INT) FILTER (k <= 200) AS ce, quantile_cont(latency_ms, 0.99) FILTER (k > 200 AND k <= 400) AS b99, avg(reward) FILTER (k > 200 AND k <= 400) AS bp FROM o WHERE n >= 210 GROUP BY alias)"


@register("rollback_check", f"WITH {ROLL_SQL} SELECT alias, round(c99, 4) AS p99, round(cp, 4) AS mean_profit, round(ce, 4) AS error_rate, round(b99, 4) AS base_p99, round(bp, 4) AS base_profit, ce > 0.01 OR (b99 > 0 AND (c99 - b99) / b99 > 0.2) OR (bp > 0 AND (bp - cp) / bp > 0.1) AS rollback, CASE WHEN ce > 0.01 THEN 'error_rate' WHEN b99 > 0 AND (c99 - b99) / b99 > 0.2 THEN 'p99' WHEN bp > 0 AND (bp - cp) / bp > 0.1 THEN 'profit' END AS reason FROM m")
def rollback_check(spark, sf_dir):
    return rounded(dashboards.rollback(a.decisions(spark, sf_dir), by=["alias"]), 4)


@register("latest_decisions", LOG_SQL + "SELECT decision_id, ts, action, alias FROM dec ORDER BY ts DESC, decision_id DESC LIMIT 20")
def latest_decisions(spark, sf_dir):
    return dashboards.latest(a.decisions(spark, sf_dir), 20).select("decision_id", "ts", "action", "alias")
