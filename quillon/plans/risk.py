"""Queries on credit-risk statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import ranks
from quillon.functions.economics import uniform_sql
from quillon.operators import risk
from quillon.plans.catalog import register
from quillon.plans.features import rounded
from quillon.sources import adapter as a

FEATURES = ("quantity", "price", "discount", "p")
LONG_SQL = f"{a.SCORED_SQL}, long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS x, y FROM scored" for f in FEATURES) + ")"


def edges_sql(source: str, x: str, by: str = "", n: int = 10, name: str = "edges") -> str:
    """A CTE of distinct quantile edges, ascending."""
    qs = ", ".join(str(i / n) for i in range(n + 1))
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"{name} AS (SELECT {key}list_sort(list_distinct(quantile_cont({x}, [{qs}]))) AS edges FROM {source}{group})"


def bin_sql(x: str) -> str:
    return f"len(list_filter(edges[2:len(edges) - 1], lambda e: e < {x}))"


WOE_SQL = f"""{LONG_SQL}, {edges_sql("long", "x", "feature")},
nvals AS (SELECT feature, count(DISTINCT x) AS n_values FROM long GROUP BY 1),
binned AS (SELECT l.*, CASE WHEN n_values <= 10 THEN NULL ELSE {bin_sql("x")} END AS bin, CASE WHEN n_values <= 10 THEN x END AS own FROM long l JOIN edges USING (feature) JOIN nvals USING (feature)),
bins0 AS (SELECT feature, bin, own, min(x) AS lo, max(x) AS hi, count(*) AS n, sum(y)::BIGINT AS events FROM binned GROUP BY 1, 2, 3),
shares AS (SELECT *, n - events AS non_events,
  (CASE WHEN events > 0 THEN events ELSE 0.5 END)::DOUBLE / sum(events) OVER (PARTITION BY feature) AS e,
  (CASE WHEN n - events > 0 THEN n - events ELSE 0.5 END)::DOUBLE / sum(n - events) OVER (PARTITION BY feature) AS o FROM bins0),
woe AS (SELECT feature, lo, hi, n, events, non_events, events / n AS event_rate, ln(o / e) AS woe, (o - e) * ln(o / e) AS iv FROM shares)"""


@register("woe_bins", f"WITH {WOE_SQL} SELECT feature, round(lo, 6) AS lo, round(hi, 6) AS hi, n, events, non_events, round(event_rate, 6) AS event_rate, round(woe, 6) AS woe, round(iv, 6) AS iv FROM woe")
def woe_bins(spark, sf_dir):
    return rounded(risk.woe_bins(a.scored_accounts(spark, sf_dir), FEATURES, "y"))


IV_SQL = "SELECT feature, round(sum(iv), 6) AS iv, (count(*) FILTER (step < 0) = 0) OR (count(*) FILTER (step > 0) = 0) AS monotone, count(*) AS n_bins, CASE WHEN sum(iv) < 0.02 THEN 'unpredictive' WHEN sum(iv) < 0.10 THEN 'weak' WHEN sum(iv) < 0.30 THEN 'medium' WHEN sum(iv) < 0.50 THEN 'strong' ELSE 'suspicious' END AS strength FROM (SELECT *, event_rate - lag(event_rate) OVER (PARTITION BY feature ORDER BY lo) AS step FROM woe) GROUP BY feature"


@register("iv_ranking", f"WITH {WOE_SQL} {IV_SQL}")
def iv_ranking(spark, sf_dir):
    return rounded(risk.iv_table(risk.woe_bins(a.scored_accounts(spark, sf_dir), FEATURES, "y")))


def _apply_sql(f: str) -> str:
    b = f"(SELECT list({{'lo': lo, 'hi': hi, 'woe': woe}} ORDER BY lo) FROM woe WHERE feature = '{f}')"
    return f"round(coalesce(list_filter(b_{f}, lambda v: v.lo <= {f} AND {f} <= v.hi)[1].woe, CASE WHEN {f} < b_{f}[1].lo THEN b_{f}[1].woe ELSE b_{f}[-1].woe END), 6) AS {f}_woe", f"{b} AS b_{f}"


_APPLIED = [_apply_sql(f) for f in ("quantity", "discount")]


@register("woe_encoded", f"WITH {WOE_SQL}, held AS (SELECT {', '.join(x[1] for x in _APPLIED)}) SELECT l_orderkey, l_linenumber, {', '.join(x[0] for x in _APPLIED)} FROM scored, held")
def woe_encoded(spark, sf_dir):
    d = a.scored_accounts(spark, sf_dir)
    bins = risk.woe_bins(d, ("quantity", "discount"), "y")
    return rounded(risk.apply_woe(d, bins, ("quantity", "discount")).select("l_orderkey", "l_linenumber", "quantity_woe", "discount_woe"))


@register("brier_score", f"WITH {a.SCORED_SQL} SELECT segment, round(avg(pow(y - p, 2)), 6) AS brier FROM scored GROUP BY segment")
def brier_score(spark, sf_dir):
    return rounded(risk.brier(a.scored_accounts(spark, sf_dir), "y", "p", ["segment"]))


CAL_SQL = f"{a.SCORED_SQL}, {edges_sql('scored', 'p')}, cal AS (SELECT bin, count(*) AS n, avg(p) AS mean_score, avg(y) AS event_rate, min(p) AS lo, max(p) AS hi, sum(y)::BIGINT AS observed, sum(p) AS expected FROM (SELECT *, {bin_sql('p')}::INT AS bin FROM scored, edges) GROUP BY bin)"
HL_SQL = "sum(pow(observed - expected, 2) / greatest(expected, 1e-9) + pow(expected - observed, 2) / greatest(n - expected, 1e-9))"


@register("calibration_curve", f"WITH {CAL_SQL} SELECT bin, n, round(mean_score, 6) AS mean_score, round(event_rate, 6) AS event_rate, round(lo, 6) AS lo, round(hi, 6) AS hi, observed, round(expected, 6) AS expected FROM cal")
def calibration_curve(spark, sf_dir):
    return rounded(risk.calibration_bins(a.scored_accounts(spark, sf_dir), "y", "p"))


@register("hosmer_lemeshow", f"WITH {CAL_SQL} SELECT round({HL_SQL}, 4) AS statistic, greatest(count(*) - 2, 1)::INT AS df FROM cal")
def hosmer_lemeshow(spark, sf_dir):
    d = risk.hosmer_lemeshow(risk.calibration_bins(a.scored_accounts(spark, sf_dir), "y", "p"))
    return rounded(d.select("statistic", "df"), 4)


CAL_SEG_SQL = f"{a.SCORED_SQL}, {edges_sql('scored', 'p', 'segment')}, cal AS (SELECT segment, bin, count(*) AS n, avg(p) AS mean_score, avg(y) AS event_rate, sum(y)::BIGINT AS observed, sum(p) AS expected FROM (SELECT s.*, {bin_sql('p')} AS bin FROM scored s JOIN edges USING (segment)) GROUP BY ALL), sums AS (SELECT segment, sum(n * abs(mean_score - event_rate)) / sum(n) AS ece, sum(n)::BIGINT AS n, {HL_SQL} AS statistic, greatest(count(*) - 2, 1)::INT AS df FROM cal GROUP BY 1), whole AS (SELECT segment, avg(pow(y - p, 2)) AS brier, avg(p) AS mean_score, avg(y) AS event_rate FROM scored GROUP BY 1)"


@register("segment_calibration", f"WITH {CAL_SEG_SQL} SELECT segment, round(brier, 5) AS brier, round(whole.mean_score, 5) AS mean_score, round(whole.event_rate, 5) AS event_rate, round(ece, 5) AS ece, n, round(statistic, 5) AS statistic, df FROM sums JOIN whole USING (segment) WHERE n >= 10")
def segment_calibration(spark, sf_dir):
    return rounded(risk.calibration_summary(a.scored_accounts(spark, sf_dir), "y", "p", ["segment"]).drop("p_value"), 5)


GINI_SQL = "SELECT segment, n_events, n, (sum_rank - n_events * (n_events + 1) / 2) / (n_events * (n - n_events)) AS auc FROM (SELECT segment, sum(y)::BIGINT AS n_events, count(*) AS n, sum(CASE WHEN y = 1 THEN rk END) AS sum_rank FROM (SELECT segment, y, rank() OVER (PARTITION BY segment ORDER BY p) + (count(*) OVER (PARTITION BY segment, p) - 1) / 2.0::DOUBLE AS rk FROM scored) GROUP BY 1)"


@register("gini_by_segment", f"WITH {a.SCORED_SQL} SELECT segment, round(auc, 6) AS auc, n, n_events, round(2 * auc - 1, 6) AS gini FROM ({GINI_SQL})")
def gini_by_segment(spark, sf_dir):
    return rounded(risk.gini(a.scored_accounts(spark, sf_dir), "y", "p", ["segment"]))


KS_SQL = "SELECT {key}p, round(abs(sum(sum(y)) OVER ({part}ORDER BY p)::DOUBLE / sum(sum(y)) OVER ({all}) - sum(count(*) - sum(y)) OVER ({part}ORDER BY p)::DOUBLE / sum(count(*) - sum(y)) OVER ({all})), 12) AS gap FROM scored GROUP BY {key}p"


@register("ks_by_segment", f"WITH {a.SCORED_SQL}, g AS ({KS_SQL.format(key='segment, ', part='PARTITION BY segment ', all='PARTITION BY segment')}) SELECT segment, round(gap, 6) AS ks, round(p, 6) AS threshold FROM g QUALIFY row_number() OVER (PARTITION BY segment ORDER BY gap DESC, p) = 1")
def ks_by_segment(spark, sf_dir):
    return rounded(risk.ks(a.scored_accounts(spark, sf_dir), "y", "p", ["segment"]))


LORENZ_SQL = f"""{a.SCORED_SQL}, pos AS (SELECT y, p, greatest(ceil((row_number() OVER (ORDER BY p DESC, l_orderkey * 10 + l_linenumber) - 1)::DOUBLE * 10 / (count(*) OVER () - 1)) - 1, 0) AS bin FROM scored),
lor AS (SELECT (bin + 1)::INT AS bin, count(*) AS n, sum(y)::BIGINT AS events, min(p) AS cutoff FROM pos GROUP BY 1),
lorenz AS (SELECT bin, n, events, cutoff, events / n AS event_rate, sum(n) OVER (ORDER BY bin)::DOUBLE / sum(n) OVER () AS cum_population, sum(events) OVER (ORDER BY bin)::DOUBLE / sum(events) OVER () AS cum_events FROM lor)"""


def _keyed(spark, sf_dir):
    return a.scored_accounts(spark, sf_dir).withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@register("lorenz_curve", f"WITH {LORENZ_SQL} SELECT bin, n, events, round(cum_population, 6) AS cum_population, round(cum_events, 6) AS cum_events, round(cutoff, 6) AS cutoff, round(event_rate, 6) AS event_rate FROM lorenz")
def lorenz_curve(spark, sf_dir):
    return rounded(risk.lorenz(_keyed(spark, sf_dir), "y", "p", "key"))


@register("discrimination_summary", f"""WITH {LORENZ_SQL}, g AS ({KS_SQL.format(key='', part='', all='')}), k AS (SELECT gap AS ks, p AS threshold FROM g ORDER BY gap DESC, p LIMIT 1),
au AS (SELECT n, n_events, (sum_rank - n_events * (n_events + 1) / 2) / (n_events * (n - n_events)) AS auc FROM (SELECT sum(y)::BIGINT AS n_events, count(*) AS n, sum(CASE WHEN y = 1 THEN rk END) AS sum_rank FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM scored)))
SELECT round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, n, n_events, round(ks, 6) AS ks, round(threshold, 6) AS threshold, round((SELECT cum_events FROM lorenz WHERE bin = 1), 6) AS top_decile_capture,
CASE WHEN 2 * auc - 1 >= 0.55 THEN 'excellent' WHEN 2 * auc - 1 >= 0.4 THEN 'good (deployable application PD)' WHEN 2 * auc - 1 >= 0.3 THEN 'marginal' ELSE 'insufficient for regulator-grade decisioning' END AS gini_label,
CASE WHEN ks >= 0.5 THEN 'excellent' WHEN ks >= 0.3 THEN 'deployable' ELSE 'insufficient' END AS ks_label FROM au, k""")
def discrimination_summary(spark, sf_dir):
    return rounded(risk.discrimination_summary(_keyed(spark, sf_dir), "y", "p", "key"))


CURVES_SQL = f"""{a.VINTAGES_SQL}, coh AS (SELECT strftime(origination_date, '%Y-%m') AS cohort, * FROM vintage),
sizes AS (SELECT cohort, count(*) AS accounts FROM coh GROUP BY 1),
curves AS (SELECT cohort, mob, accounts, (SELECT count(*) FROM coh c WHERE c.cohort = s.cohort AND c.defaulted = 1 AND c.default_month <= mob) AS defaults FROM sizes s, (SELECT unnest(range(1, 25))::INT AS mob)),
rates AS (SELECT *, defaults::DOUBLE / accounts AS default_rate FROM curves)"""


def _curves(spark, sf_dir):
    return risk.vintage_curves(a.vintages(spark, sf_dir), "origination_date", "defaulted", "default_month")


@register("vintage_curves", f"WITH {CURVES_SQL} SELECT cohort, mob, accounts, defaults, round(default_rate, 6) AS default_rate FROM rates")
def vintage_curves(spark, sf_dir):
    return rounded(_curves(spark, sf_dir))


@register("vintage_summary", f"WITH {CURVES_SQL} SELECT cohort, any_value(accounts) AS accounts, round(arg_max(default_rate, mob), 6) AS final_rate, max(mob) AS horizon, (SELECT min(mob) FROM rates q WHERE q.cohort = r.cohort AND q.default_rate = max(r.default_rate)) AS peak_month FROM rates r GROUP BY cohort")
def vintage_summary(spark, sf_dir):
    return rounded(risk.vintage_summary(_curves(spark, sf_dir)))


@register("vintage_drift", f"WITH {CURVES_SQL} SELECT older, newer, round((new_rate - old_rate) / old_rate, 6) AS change FROM (SELECT lag(cohort) OVER (ORDER BY cohort) AS older, cohort AS newer, lag(default_rate) OVER (ORDER BY cohort) AS old_rate, default_rate AS new_rate FROM rates WHERE mob = 12) WHERE old_rate > 0 AND abs((new_rate - old_rate) / old_rate) >= 0.5")
def vintage_drift(spark, sf_dir):
    return rounded(risk.vintage_drift(_curves(spark, sf_dir)))


LOSS_SQL = f"{a.ACCOUNTS_SQL}, ead AS (SELECT *, current_balance + 0.6::DOUBLE * greatest(credit_limit - current_balance, 0) AS ead, 0.8::DOUBLE AS lgd FROM acc), loss AS (SELECT *, pd * lgd * ead AS expected_loss, ead * lgd * sqrt(greatest(pd * (1 - pd), 0)) AS unexpected_loss FROM ead)"
PORTFOLIO_SQL = "count(*) AS accounts, round(sum(ead), 3) AS total_ead, round(sum(expected_loss), 3) AS expected_loss, round(sqrt(sum(pow(unexpected_loss, 2))), 3) AS unexpected_loss, round(sum(expected_loss) / greatest(sum(ead), 1), 3) AS loss_rate, round(sum(pd * ead) / greatest(sum(ead), 1), 3) AS weighted_pd, round(sum(lgd * ead) / greatest(sum(ead), 1), 3) AS weighted_lgd"


@register("loss_components", f"WITH {LOSS_SQL} SELECT account_id, round(ead, 6) AS ead, round(expected_loss + 3.719e-8::DOUBLE, 6) AS expected_loss, round(unexpected_loss + 3.719e-8::DOUBLE, 6) AS unexpected_loss FROM loss")
def loss_components(spark, sf_dir):
    d = risk.loss_columns(a.accounts(spark, sf_dir), "pd", "current_balance", "credit_limit")
    return rounded(d.select("account_id", "ead", "expected_loss", "unexpected_loss"), 6, "expected_loss", "unexpected_loss")


@register("portfolio_loss", f"WITH {LOSS_SQL} SELECT {PORTFOLIO_SQL} FROM loss")
def portfolio_loss(spark, sf_dir):
    return rounded(risk.portfolio(risk.loss_columns(a.accounts(spark, sf_dir), "pd", "current_balance", "credit_limit"), "pd"), 3)


@register("loss_by_segment", f"WITH {LOSS_SQL} SELECT segment, {PORTFOLIO_SQL} FROM loss GROUP BY segment")
def loss_by_segment(spark, sf_dir):
    return rounded(risk.portfolio(risk.loss_columns(a.accounts(spark, sf_dir), "pd", "current_balance", "credit_limit"), "pd", ["segment"]), 3)


def _score(df):
    """A simple PD that rises with use and delinquencies and falls with income and paydowns."""
    x = 0.02 + 0.1 * F.col("utilization") + 0.03 * F.col("prev_delinquency_count") + 2000.0 / F.col("annual_income") - 0.02 * F.col("paydown_rate_30d")
    return df.withColumn("pd", F.least(F.greatest(x, F.lit(0.001)), F.lit(0.6)))


STRESS_SQL = f"""{a.ACCOUNTS_SQL}, sc AS (SELECT * FROM (VALUES ('baseline', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.8::DOUBLE), ('adverse', 0.9::DOUBLE, 1.15::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 0.02::DOUBLE, 0.85::DOUBLE), ('severely_adverse', 0.8::DOUBLE, 1.35::DOUBLE, 0.6::DOUBLE, 2.0::DOUBLE, 0.05::DOUBLE, 0.9::DOUBLE)) t(scenario, f_income, f_use, f_pay, more, floor, lgd)),
s0 AS (SELECT scenario, current_balance, credit_limit, lgd, floor, 0.02::DOUBLE + 0.1::DOUBLE * (utilization * f_use) + 0.03::DOUBLE * (prev_delinquency_count + more) + 2000.0::DOUBLE / (annual_income * f_income) - 0.02::DOUBLE * (paydown_rate_30d * f_pay) AS x FROM acc, sc),
s1 AS (SELECT scenario, lgd, greatest(least(greatest(x, 0.001), 0.6), floor) AS pd, current_balance + 0.6::DOUBLE * greatest(credit_limit - current_balance, 0) AS ead FROM s0),
loss AS (SELECT *, pd * lgd * ead AS expected_loss, ead * lgd * sqrt(greatest(pd * (1 - pd), 0)) AS unexpected_loss FROM s1)"""


@register("stress_test", f"WITH {STRESS_SQL} SELECT scenario, {PORTFOLIO_SQL} FROM loss GROUP BY scenario")
def stress_test(spark, sf_dir):
    return rounded(risk.stress(a.accounts(spark, sf_dir), _score, "current_balance", "credit_limit"), 3)


@register("adverse_scenario", f"WITH {a.ACCOUNTS_SQL} SELECT account_id, round(annual_income * 0.9::DOUBLE, 6) AS annual_income, round(utilization * 1.15::DOUBLE, 6) AS utilization, prev_delinquency_count + 1 AS prev_delinquency_count, paydown_rate_30d FROM acc")
def adverse_scenario(spark, sf_dir):
    return rounded(risk.shocked(a.accounts(spark, sf_dir), "adverse").select("account_id", "annual_income", "utilization", "prev_delinquency_count", "paydown_rate_30d"))


PERIODS_SQL = f"{a.ACCOUNTS_SQL}, lst AS (SELECT account_id, defaulted, default_month, least(CASE WHEN defaulted = 1 THEN greatest(default_month, 1) ELSE 24 END, 24) AS last FROM acc), periods AS (SELECT account_id, unnest(range(1, last + 1))::INT AS month, last, defaulted FROM lst), pp AS (SELECT account_id, month, (month = last AND defaulted = 1)::INT AS event FROM periods)"


@register("person_periods", f"WITH {PERIODS_SQL} SELECT * FROM pp")
def person_periods(spark, sf_dir):
    return risk.person_periods(a.accounts(spark, sf_dir), "defaulted", "default_month").select("account_id", "month", "event")


@register("survival_table", f"WITH {PERIODS_SQL}, hz AS (SELECT (account_id % 6)::INT AS segment, month, avg(event) AS hazard, count(*) AS at_risk FROM pp GROUP BY ALL) SELECT segment, month, at_risk, round(hazard, 6) AS hazard, round(CASE WHEN max((hazard >= 1)::INT) OVER w = 1 THEN 0 ELSE exp(coalesce(sum(CASE WHEN hazard < 1 THEN ln(1 - hazard) END) OVER w, 0)) END, 6) AS survival FROM hz WINDOW w AS (PARTITION BY segment ORDER BY month)")
def survival_table(spark, sf_dir):
    d = risk.person_periods(a.accounts(spark, sf_dir), "defaulted", "default_month").groupBy((F.col("account_id") % 6).cast("int").alias("segment"), "month").agg(F.avg("event").alias("hazard"), F.count("*").alias("at_risk"))
    return rounded(risk.survival(d, "segment", "month", "hazard").select("segment", "month", "at_risk", "hazard", "survival"))


@register("survival_summary", f"WITH {PERIODS_SQL}, hz AS (SELECT (account_id % 6)::INT AS segment, month, avg(event) AS hazard FROM pp GROUP BY ALL), sv AS (SELECT segment, month, hazard, CASE WHEN max((hazard >= 1)::INT) OVER w = 1 THEN 0 ELSE exp(coalesce(sum(CASE WHEN hazard < 1 THEN ln(1 - hazard) END) OVER w, 0)) END AS survival FROM hz WINDOW w AS (PARTITION BY segment ORDER BY month)) SELECT segment, round(sum(survival), 6) AS expected_lifetime, arg_max(month, (hazard, -month)) AS peak_month, round(max(1 - survival), 6) AS final_default FROM sv GROUP BY 1")
def survival_summary(spark, sf_dir):
    d = risk.person_periods(a.accounts(spark, sf_dir), "defaulted", "default_month").groupBy((F.col("account_id") % 6).cast("int").alias("segment"), "month").agg(F.avg("event").alias("hazard"))
    return rounded(risk.survival_summary(risk.survival(d, "segment", "month", "hazard"), "segment", "month", "hazard"))


@register("fuzzy_parcel", f"WITH {a.ACCOUNTS_SQL} SELECT utilization, defaulted AS y, 1.0::DOUBLE AS weight FROM acc WHERE pd >= 0.1 UNION ALL SELECT utilization, 1, round(pd, 6) FROM acc WHERE pd < 0.1 UNION ALL SELECT utilization, 0, round(1 - pd, 6) FROM acc WHERE pd < 0.1")
def fuzzy_parcel(spark, sf_dir):
    yes, no = risk.split_population(a.accounts(spark, sf_dir), "pd", 0.1)
    return rounded(risk.fuzzy_parcel(yes, no, "defaulted", "pd", ["utilization"]))


@register("reject_population", f"WITH {a.PARAMETERS_SQL} SELECT customer_id, coalesce(true_p_accept_cli >= 0.3, false) AS accepted FROM params")
def reject_population(spark, sf_dir):
    yes, no = risk.split_population(a.parameters(spark, sf_dir), "true_p_accept_cli")
    return yes.select("customer_id", F.lit(True).alias("accepted")).unionByName(no.select("customer_id", F.lit(False).alias("accepted")))


PRE_SQL = f"{LONG_SQL}, {edges_sql('long', 'x', 'feature')}, b AS (SELECT feature, bin, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y FROM (SELECT l.*, {bin_sql('x')} AS bin FROM long l JOIN edges USING (feature)) GROUP BY ALL), rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY mean_x) + (count(*) OVER (PARTITION BY feature, mean_x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY feature ORDER BY mean_y) + (count(*) OVER (PARTITION BY feature, mean_y) - 1) / 2.0::DOUBLE AS ry FROM b), rho AS (SELECT feature, count(*) AS n_bins, corr(rx, ry) AS spearman FROM rk GROUP BY 1)"


@register("monotone_preconditions", f"WITH {PRE_SQL} SELECT feature, n_bins, round(spearman, 6) AS spearman, CASE WHEN n_bins < 3 THEN 'too_few' WHEN spearman >= 0.5 THEN 'ok' WHEN spearman > 0 THEN 'weak' ELSE 'wrong' END AS status FROM rho")
def monotone_preconditions(spark, sf_dir):
    from quillon.operators.models import preconditions

    return rounded(preconditions(a.scored_accounts(spark, sf_dir), "y", {f: 1 for f in FEATURES}))


@register("kendall_tau", f"WITH t AS (SELECT o_totalprice AS x, (o_orderkey * 7919 % 1009)::DOUBLE AS y FROM orders), p AS (SELECT sum((sign(a.x - b.x) * sign(a.y - b.y) > 0)::INT)::BIGINT AS concordant, sum((sign(a.x - b.x) * sign(a.y - b.y) < 0)::INT)::BIGINT AS discordant, sum((a.x = b.x)::INT) AS tx, sum((a.y = b.y)::INT) AS ty FROM (SELECT *, row_number() OVER () AS k FROM t) a JOIN (SELECT *, row_number() OVER () AS k FROM t) b ON a.k < b.k), c AS (SELECT count(*) AS n FROM t) SELECT n, concordant, discordant, round((concordant - discordant) / sqrt((n * (n - 1) / 2 - tx)::DOUBLE * (n * (n - 1) / 2 - ty)), 6) AS tau FROM p, c")
def kendall_tau(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("x"), (F.col("o_orderkey") * 7919 % 1009).alias("y"))
    return rounded(ranks.kendall_tau(o, "x", "y"))


@register("binary_target", f"WITH {a.PARAMETERS_SQL} SELECT customer_id, ({uniform_sql('customer_id', repr('target'))} < true_p_default)::INT AS y FROM params")
def binary_target(spark, sf_dir):
    return risk.binary_target(a.parameters(spark, sf_dir), "true_p_default", ["customer_id"]).select("customer_id", "y")
