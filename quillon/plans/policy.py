"""Queries on economics, decisions, off-policy evaluation, models and the data gate, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import economics as e
from quillon.operators import asof, boosting, decide, gate, models, ope, pooled, shapley, views
from quillon.plans.catalog import register
from quillon.plans import monitor as monitor_plans
from quillon.plans import risk as risk_plans
from quillon.plans.features import TRAINING_SQL, rounded
from quillon.plans.risk import edges_sql
from quillon.sources import adapter as a
from quillon.sources import storage

JOINED_SQL = f"""{a.DECISIONS_SQL}, {a.PARAMETERS_SQL},
j AS (SELECT d.*, p.true_p_accept_cli, p.true_delta_spend_monthly, p.true_p_default, p.credit_limit,
  greatest(least(true_p_accept_cli + 0.3::DOUBLE * (utilization - 0.5::DOUBLE) + 0.1::DOUBLE * least(velocity_24h / 20.0::DOUBLE, 1), 0.95), 0.01) AS pa,
  greatest(least(true_p_default + 0.2::DOUBLE * greatest(utilization - 0.6::DOUBLE, 0) + 0.1::DOUBLE * greatest(0.5::DOUBLE - paydown_rate_30d, 0), 0.6), 0.001) AS pdef,
  least(greatest(credit_limit * (1 - utilization), 0), 5000) AS exposed
  FROM dec d JOIN params p USING (customer_id))"""


def _joined(spark, sf_dir):
    d = a.decisions(spark, sf_dir).join(a.parameters(spark, sf_dir).drop("segment_id"), "customer_id")
    return d.withColumns({
        "pa": e.effective_p_accept(F.col("true_p_accept_cli"), F.col("utilization"), F.col("velocity_24h")),
        "pdef": e.effective_p_default(F.col("true_p_default"), F.col("utilization"), F.col("paydown_rate_30d")),
        "exposed": e.exposure(F.col("credit_limit"), F.col("utilization")),
    })


@register("effective_probabilities", f"WITH {JOINED_SQL} SELECT decision_id, round(pa, 6) AS p_accept, round(pdef, 6) AS p_default, round(exposed, 6) AS exposure, round(pa * (true_delta_spend_monthly * 12 * 0.12::DOUBLE * 0.95::DOUBLE - pdef * exposed * 0.8::DOUBLE - exposed * 0.0064::DOUBLE), 4) AS expected_profit FROM j")
def effective_probabilities(spark, sf_dir):
    d = _joined(spark, sf_dir)
    return d.select("decision_id", F.round("pa", 6).alias("p_accept"), F.round("pdef", 6).alias("p_default"), F.round("exposed", 6).alias("exposure"), F.round(e.expected_profit(F.col("pa"), F.col("pdef"), F.col("true_delta_spend_monthly"), F.col("exposed")), 4).alias("expected_profit"))


CHOICE_SQL = f"""{JOINED_SQL}, pr AS (SELECT decision_id, pa * (12 * true_delta_spend_monthly * 0.12::DOUBLE * 0.95::DOUBLE - pdef * exposed * 0.8::DOUBLE - exposed * 0.0064::DOUBLE) AS offer, fraud_score * 500.0::DOUBLE - (1 - fraud_score) * 40.0::DOUBLE AS fraud FROM j),
ch AS (SELECT *, greatest(0, offer, fraud) AS best FROM pr)"""


@register("action_choice", f"WITH {CHOICE_SQL} SELECT decision_id, CASE WHEN best <= 0 THEN 0 WHEN offer = best THEN 1 ELSE 2 END AS action, ['NOTHING', 'OFFER_CLI', 'FRAUD_CHECK'][CASE WHEN best <= 0 THEN 0 WHEN offer = best THEN 1 ELSE 2 END + 1] AS action_name, round(1 / (exp((0 - best) / 10) + exp((offer - best) / 10) + exp((fraud - best) / 10)), 6) AS propensity, round(best, 4) AS expected_profit FROM ch")
def action_choice(spark, sf_dir):
    d = _joined(spark, sf_dir).withColumn("offer", e.profit_treated(F.col("pa"), F.col("true_delta_spend_monthly"), F.col("pdef"), F.col("exposed"))).withColumn("fraud", e.profit_fraud_check(F.col("fraud_score")))
    c = decide.choose(d.drop("action", "propensity"), "offer", "fraud")
    return c.select("decision_id", "action", "action_name", F.round("propensity", 6).alias("propensity"), F.round("expected_profit", 4).alias("expected_profit"))


@register("canary_cohort", "SELECT c_custkey AS customer_id, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 10000 AS bucket, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 10000 < 1500 AS in_canary FROM customer")
def canary_cohort(spark, sf_dir):
    c = a.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    return c.select("customer_id", e.cohort_bucket(F.col("customer_id")).alias("bucket"), e.in_canary(F.col("customer_id"), 0.15).alias("in_canary"))


@register("namespace_seeds", "SELECT c_custkey AS customer_id, ('0x' || substr(sha256('42|' || c_name), 1, 8))::BIGINT % 2147483647 AS seed FROM customer")
def namespace_seeds(spark, sf_dir):
    c = a.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"), e.namespace_seed(F.lit(42), F.col("c_name")).alias("seed"))


def _ope_terms(spark, sf_dir):
    return ope.terms(a.decisions(spark, sf_dir), action="action", propensity="propensity", reward="reward", new_action="new_action", mu_new="mu_new", mu_logged="mu_logged")


OPE_SQL = f"{a.DECISIONS_SQL}, t AS (SELECT segment_id, reward, mu_new, mu_logged, CASE WHEN action = new_action THEN 1 / propensity ELSE 0 END AS w FROM dec)"


@register("ope_estimates", f"WITH {OPE_SQL} SELECT segment_id, unnest(['ips', 'snips', 'dr']) AS estimator, round(unnest([avg(w * reward), sum(w * reward) / sum(w), avg(mu_new + w * (reward - mu_logged))]), 4) AS estimate, count(*) AS n_logged FROM t GROUP BY segment_id")
def ope_estimates(spark, sf_dir):
    return rounded(ope.estimates(_ope_terms(spark, sf_dir), ["segment_id"]), 4)


@register("ope_suite")
def ope_suite(spark, sf_dir):
    return ope.suite(a.decisions(spark, sf_dir), "decision_id", action="action", propensity="propensity", reward="reward", new_action="new_action", mu_new="mu_new", mu_logged="mu_logged")


@register("promotion_gate")
def promotion_gate(spark, sf_dir):
    return ope.promotion(ope_suite(spark, sf_dir))


POLICY_SQL = f"""{JOINED_SQL}, pol AS (SELECT 1 AS always, 0 AS never, ({e.uniform_sql('decision_id', "'policy'")} < 0.5)::INT AS random, (utilization > 0.5)::INT AS by_use, pa * (true_delta_spend_monthly * 12 * 0.12::DOUBLE * 0.95::DOUBLE - pdef * exposed * 0.8::DOUBLE - exposed * 0.0064::DOUBLE) AS profit FROM j), opt AS (SELECT *, (profit > 0)::INT AS optimal FROM pol), rep AS (SELECT policy, act, profit, optimal FROM (SELECT profit, optimal, unnest(['always', 'never', 'random', 'by_use']) AS policy, unnest([always, never, random, by_use]) AS act FROM opt))"""
REPORT_SQL = "SELECT policy, avg(CASE WHEN act = 1 THEN profit ELSE 0 END) AS mean_profit, avg(act) AS act_rate, avg((act = optimal)::INT) AS agreement FROM rep GROUP BY policy"


def _policies(spark, sf_dir):
    d = _joined(spark, sf_dir).withColumn("profit", e.expected_profit(F.col("pa"), F.col("pdef"), F.col("true_delta_spend_monthly"), F.col("exposed")))
    d = d.withColumns({**decide.baselines("decision_id"), "by_use": (F.col("utilization") > 0.5).cast("int"), "optimal": (F.col("profit") > 0).cast("int")})
    return decide.policy_report(d, ["always", "never", "random", "by_use"], "profit", "optimal")


@register("policy_report", f"WITH {POLICY_SQL} SELECT policy, round(mean_profit, 6) AS mean_profit, round(act_rate, 6) AS act_rate, round(agreement, 6) AS agreement FROM ({REPORT_SQL})")
def policy_report(spark, sf_dir):
    return rounded(_policies(spark, sf_dir))


@register("champion_policy", f"WITH {POLICY_SQL} SELECT policy, round(mean_profit, 6) AS mean_profit FROM ({REPORT_SQL}) ORDER BY mean_profit DESC, policy LIMIT 1")
def champion_policy(spark, sf_dir):
    return rounded(decide.champion(_policies(spark, sf_dir)))


BANDIT = ("utilization", "paydown_rate_30d")


@register("bandit_statistics", f"WITH {a.DECISIONS_SQL}, x AS (SELECT action AS arm, reward AS r, [1.0::DOUBLE, utilization, paydown_rate_30d] AS x FROM dec), ij AS (SELECT arm, r, x, unnest([0, 0, 0, 1, 1, 1, 2, 2, 2]) AS i, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2]) AS j FROM x) SELECT arm, i, j, round(sum(x[i + 1] * x[j + 1]), 4) AS a, round(sum(CASE WHEN j = 0 THEN r * x[i + 1] END), 3) AS b, count(*) AS n FROM ij GROUP BY ALL")
def bandit_statistics(spark, sf_dir):
    s = decide.arm_statistics(a.decisions(spark, sf_dir), "action", "reward", BANDIT)
    return s.select("arm", "i", "j", F.round("a", 4).alias("a"), F.round("b", 3).alias("b"), "n")


#: The inverse of each arm's 3 by 3 matrix by cofactors, then mean and spread of every decision.
BANDIT_SQL = f"""{a.DECISIONS_SQL},
st AS (SELECT action AS arm, 1.0::DOUBLE + count(*) AS a, sum(utilization) AS b, sum(paydown_rate_30d) AS c, 1.0::DOUBLE + sum(utilization * utilization) AS d, sum(utilization * paydown_rate_30d) AS e, 1.0::DOUBLE + sum(paydown_rate_30d * paydown_rate_30d) AS f,
  sum(reward) AS r0, sum(reward * utilization) AS r1, sum(reward * paydown_rate_30d) AS r2 FROM dec GROUP BY action),
det AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM st),
inv AS (SELECT arm, r0, r1, r2, (d * f - e * e) / det AS i00, (c * e - b * f) / det AS i01, (b * e - c * d) / det AS i02, (a * f - c * c) / det AS i11, (b * c - a * e) / det AS i12, (a * d - b * b) / det AS i22 FROM det),
th AS (SELECT *, i00 * r0 + i01 * r1 + i02 * r2 AS t0, i01 * r0 + i11 * r1 + i12 * r2 AS t1, i02 * r0 + i12 * r1 + i22 * r2 AS t2 FROM inv),
sc AS (SELECT decision_id, arm, t0 + t1 * u + t2 * p + sqrt(greatest(i00 + 2 * i01 * u + 2 * i02 * p + i11 * u * u + 2 * i12 * u * p + i22 * p * p, 0)) AS score FROM (SELECT decision_id, utilization AS u, paydown_rate_30d AS p FROM dec), th)"""


@register("bandit_scores", f"WITH {BANDIT_SQL} SELECT decision_id, arg_max(arm, (score, arm)) AS arm, round(max(score) FILTER (arm = 0), 3) AS score_0, round(max(score) FILTER (arm = 1), 3) AS score_1, round(max(score) FILTER (arm = 2), 3) AS score_2 FROM sc GROUP BY decision_id")
def bandit_scores(spark, sf_dir):
    d = a.decisions(spark, sf_dir)
    s = decide.arm_statistics(d, "action", "reward", BANDIT)
    return decide.bandit_scores(d, s, BANDIT).select("decision_id", "arm", *[F.round(F.col("scores")[k]["score"], 3).alias(f"score_{k}") for k in range(3)])


_Z = lambda j: f"sqrt(-2 * ln(1 - {e.uniform_sql('decision_id', 'arm', str(j), repr('r'))})) * cos(2 * pi() * {e.uniform_sql('decision_id', 'arm', str(j), repr('angle'))})"
#: The Cholesky factor of each arm's 3 by 3 covariance, and a draw for each decision.
THOMPSON_SQL = f"""{BANDIT_SQL},
l1 AS (SELECT *, sqrt(i00) AS l00, i01 / sqrt(i00) AS l10, i02 / sqrt(i00) AS l20 FROM th),
l2 AS (SELECT *, sqrt(i11 - l10 * l10) AS l11, (i12 - l20 * l10) / sqrt(i11 - l10 * l10) AS l21 FROM l1),
l3 AS (SELECT *, sqrt(i22 - l20 * l20 - l21 * l21) AS l22 FROM l2),
ts AS (SELECT decision_id, arm, t0 + t1 * u + t2 * p + ({_Z(0)}) * (l00 + l10 * u + l20 * p) + ({_Z(1)}) * (l11 * u + l21 * p) + ({_Z(2)}) * l22 * p AS score
  FROM (SELECT decision_id, utilization AS u, paydown_rate_30d AS p FROM dec), l3)"""


@register("thompson_scores", f"WITH {THOMPSON_SQL} SELECT decision_id, arg_max(arm, (score, arm)) AS arm, round(max(score) FILTER (arm = 0), 3) AS score_0, round(max(score) FILTER (arm = 1), 3) AS score_1, round(max(score) FILTER (arm = 2), 3) AS score_2 FROM ts GROUP BY decision_id")
def thompson_scores(spark, sf_dir):
    d = a.decisions(spark, sf_dir)
    s = decide.arm_statistics(d, "action", "reward", BANDIT)
    return decide.thompson_scores(d, s, BANDIT, "decision_id").select("decision_id", "arm", *[F.round(F.col("scores")[k]["score"], 3).alias(f"score_{k}") for k in range(3)])


@register("softmax_arms", f"""WITH {a.DECISIONS_SQL}, m AS (SELECT action AS arm, avg(reward) AS q FROM dec GROUP BY 1), w AS (SELECT arm, exp((q - max(q) OVER ()) / 50.0::DOUBLE) AS w FROM m),
s AS (SELECT arm, w / sum(w) OVER () AS p, sum(w) OVER (ORDER BY arm) / sum(w) OVER () AS upto FROM w)
SELECT decision_id, coalesce(min(arm) FILTER ({e.uniform_sql("decision_id", "'softmax'")} < upto), max(arm)) AS arm, round(max(p) FILTER (arm = 0), 6) AS p_0, round(max(p) FILTER (arm = 1), 6) AS p_1, round(max(p) FILTER (arm = 2), 6) AS p_2 FROM dec, s GROUP BY decision_id""")
def softmax_arms(spark, sf_dir):
    d = a.decisions(spark, sf_dir)
    means = d.groupBy(F.col("action").alias("arm")).agg(F.avg("reward").alias("mean"))
    return decide.softmax_arms(d, "decision_id", means, temperature=50.0).select("decision_id", "arm", *[F.round(F.col("probabilities")[k], 6).alias(f"p_{k}") for k in range(3)])


SHAPLEY_BACKGROUND = {"utilization": 0.4, "velocity_24h": 2.0, "paydown_rate_30d": 0.3}


def _shapley_score(df):
    offer = (0.3 + 0.2 * F.col("utilization")) * (12 * (60.0 + F.col("velocity_24h")) * 0.12 * 0.95 - (0.02 + 0.05 * F.col("utilization") * (1.3 - F.col("paydown_rate_30d"))) * 4000.0 - 32.0)
    return df.withColumn("profit", offer)


@register("shapley_attributions", f"""WITH {a.DECISIONS_SQL}, c AS (SELECT decision_id, m, bit_count(m) AS s, CASE WHEN m & 1 = 1 THEN utilization ELSE 0.4::DOUBLE END AS u, CASE WHEN m & 2 = 2 THEN velocity_24h::DOUBLE ELSE 2.0::DOUBLE END AS v, CASE WHEN m & 4 = 4 THEN paydown_rate_30d ELSE 0.3::DOUBLE END AS p FROM dec, (SELECT unnest(range(8)) AS m)),
v AS (SELECT *, (0.3::DOUBLE + 0.2::DOUBLE * u) * (12 * (60 + v) * 0.12::DOUBLE * 0.95::DOUBLE - (0.02::DOUBLE + 0.05::DOUBLE * u * (1.3::DOUBLE - p)) * 4000 - 32) AS profit FROM c),
w AS (SELECT decision_id, m, profit, CASE s WHEN 2 THEN 1 / 6.0::DOUBLE ELSE 1 / 3.0::DOUBLE END AS inside, CASE s WHEN 1 THEN -1 / 6.0::DOUBLE ELSE -1 / 3.0::DOUBLE END AS outside FROM v)
SELECT decision_id, round(max(profit) FILTER (m = 0), 4) AS base, round(max(profit) FILTER (m = 7), 4) AS profit, {", ".join(f"round(sum(profit * CASE WHEN m & {1 << j} > 0 THEN inside ELSE outside END), 4) AS phi_{f}" for j, f in enumerate(("utilization", "velocity_24h", "paydown_rate_30d")))} FROM w GROUP BY decision_id""")
def shapley_attributions(spark, sf_dir):
    return rounded(shapley.attributions(a.decisions(spark, sf_dir), "decision_id", list(SHAPLEY_BACKGROUND), _shapley_score, SHAPLEY_BACKGROUND), 4)


def _rule(shift: float):
    def score(df):
        return df.withColumns({"p_accept": F.lit(0.3) + 0.2 * F.col("utilization"), "spend": F.lit(60.0 + shift) + F.col("velocity_24h"), "p_default": F.lit(0.02) + 0.05 * F.col("utilization")})

    return score


DECIDE_SQL = f"""{a.DECISIONS_SQL}, sc AS (SELECT decision_id, customer_id, alias, 0.3::DOUBLE + 0.2::DOUBLE * utilization AS pa, s + velocity_24h AS spend, 0.02::DOUBLE + 0.05::DOUBLE * utilization AS pdef, fraud_score FROM (SELECT * EXCLUDE (alias), unnest(['champion', 'challenger']) AS alias, unnest([60.0::DOUBLE, 70.0::DOUBLE]) AS s FROM dec)),
pr AS (SELECT *, pa * (12 * spend * 0.12::DOUBLE * 0.95::DOUBLE - pdef * 5000.0::DOUBLE * 0.8::DOUBLE - 5000.0::DOUBLE * 0.0064::DOUBLE) AS offer, fraud_score * 500.0::DOUBLE - (1 - fraud_score) * 40.0::DOUBLE AS fraud FROM sc)"""


@register("batch_decisions", f"WITH {DECIDE_SQL} SELECT decision_id, alias, CASE WHEN greatest(0, offer, fraud) <= 0 THEN 0 WHEN offer = greatest(0, offer, fraud) THEN 1 ELSE 2 END AS action, round(greatest(0, offer, fraud), 4) AS expected_profit, (('0x' || substr(md5(customer_id::VARCHAR), 1, 8))::BIGINT % 10000 < 1000) = (alias = 'challenger') AS acts FROM pr")
def batch_decisions(spark, sf_dir):
    d = a.decisions(spark, sf_dir).drop("action", "propensity", "alias")
    out = decide.decide(d, _rule(0.0), _rule(10.0), key="customer_id", fraction=0.1)
    return out.select("decision_id", "alias", "action", F.round("expected_profit", 4).alias("expected_profit"), "acts")


REASON_SQL = f"""{a.ACCOUNTS_SQL}, m AS (SELECT avg(utilization) AS mu, avg(paydown_rate_30d) AS mp, avg(prev_delinquency_count) AS md, avg(credit_score) AS mc FROM acc),
v AS (SELECT account_id, unnest(['utilization', 'paydown_rate_30d', 'prev_delinquency_count', 'credit_score']) AS feature, unnest([-80 * (utilization - mu), 30 * (paydown_rate_30d - mp), -15 * (prev_delinquency_count - md), 0.1::DOUBLE * (credit_score - mc)]) AS v, unnest([utilization, paydown_rate_30d, prev_delinquency_count, credit_score]) AS x FROM acc, m)"""
WORDS_SQL = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{w}'" for f, w in decide.REASONS.items()) + " END"


@register("adverse_reasons", f"WITH {REASON_SQL} SELECT account_id, (row_number() OVER (PARTITION BY account_id ORDER BY v, feature))::INT AS rank, feature, {WORDS_SQL} AS description, round(v, 4) AS attribution, round(x, 4) AS feature_value FROM v WHERE v < -1e-9 QUALIFY rank <= 4")
def adverse_reasons(spark, sf_dir):
    d = a.accounts(spark, sf_dir)
    f = ("utilization", "paydown_rate_30d", "prev_delinquency_count", "credit_score")
    mean = d.agg(*[F.avg(c).alias(c) for c in f]).first().asDict()
    return decide.reasons(d, "account_id", f, _account_profit, mean)


def _account_profit(d):
    return d.withColumn("profit", 100 - 80 * F.col("utilization") + 30 * F.col("paydown_rate_30d") - 15 * F.col("prev_delinquency_count") + 0.1 * F.col("credit_score"))


@register("adverse_reason_counts", f"WITH {REASON_SQL} SELECT feature, count(*) AS n FROM v WHERE v < -1e-6 GROUP BY feature")
def adverse_reason_counts(spark, sf_dir):
    return adverse_reasons(spark, sf_dir).where("attribution < -1e-6").groupBy("feature").agg(F.count("*").alias("n"))


@register("decision_json_round_trip", f"WITH {a.DECISIONS_SQL} SELECT decision_id::VARCHAR AS decision_id, customer_id::VARCHAR AS customer_id, alias, segment_id, round(utilization, 2) AS current_utilization FROM dec")
def decision_json_round_trip(spark, sf_dir):
    d = a.decisions(spark, sf_dir).select("decision_id", "customer_id", F.lit(1).cast("long").alias("timestamp_ms"), F.col("action").cast("string").alias("action"), F.when(F.col("alias") != "champion", F.col("alias")).alias("alias"), "segment_id", F.col("utilization").alias("current_utilization"))
    text = d.select(*[F.col(c).cast("string").alias(c) if c.endswith("_id") and c != "segment_id" else F.col(c) for c in d.columns])
    back = decide.decode_decisions(decide.encode(text, "customer_id", ["current_utilization"]))
    return back.select("decision_id", "customer_id", "alias", "segment_id", "current_utilization")


def _u(tag: str, *key: str) -> str:
    return e.uniform_sql(*key, f"'{tag}'")


OUTCOMES_SQL = f"""{JOINED_SQL},
drawn AS (SELECT *, action = 1 AND {_u('accept', 'decision_id')} < pa AS accepted, {_u('default', 'decision_id')} < pdef AS may_default,
  true_delta_spend_monthly * exp(0.3::DOUBLE * ({_u('a', 'decision_id')} + {_u('b', 'decision_id')} + {_u('c', 'decision_id')} - 1.5::DOUBLE) * 2) AS may_spend FROM j),
outcome AS (SELECT *, accepted AND may_default AS defaulted, CASE WHEN accepted THEN may_spend ELSE 0 END AS spend FROM drawn),
paid AS (SELECT *, CASE WHEN accepted THEN spend * 0.12::DOUBLE * 0.95::DOUBLE - CASE WHEN defaulted THEN least(spend * 12, 5000) * 0.8::DOUBLE ELSE 0 END - least(spend * 12, 5000) * 0.0064::DOUBLE ELSE 0 END AS profit FROM outcome)"""
PAID = "decision_id, customer_id, accepted, defaulted, round(spend, 6) AS spend, round(profit, 6) AS profit"


@register("simulated_outcomes", f"WITH {OUTCOMES_SQL} SELECT {PAID} FROM paid")
def simulated_outcomes(spark, sf_dir):
    return rounded(decide.outcomes(a.decisions(spark, sf_dir), a.parameters(spark, sf_dir)))


@register("decision_outcomes", f"WITH {OUTCOMES_SQL} SELECT {PAID}, alias, segment_id, action, round(propensity, 6) AS propensity FROM paid")
def decision_outcomes(spark, sf_dir):
    d = a.decisions(spark, sf_dir)
    return rounded(decide.decision_outcomes(d, decide.outcomes(d, a.parameters(spark, sf_dir))))


def _training(spark, sf_dir, *horizons):
    """The labelled frame, from features as they would be stored, with six decimals; with horizons, those views' features only."""
    return decide.labels(rounded(_frame(spark, sf_dir, *horizons), 6, "geo_variance_7d"), a.parameters(spark, sf_dir))


LABELS_SQL = f"""{TRAINING_SQL}, {a.PARAMETERS_SQL},
chances AS (SELECT t.*, p.segment_id, p.true_delta_spend_monthly, p.credit_limit AS own_limit, {_u('treat', 't.customer_id', 't.as_of')} AS u_treat, {_u('accept', 't.customer_id', 't.as_of')} AS u_accept, {_u('default', 't.customer_id', 't.as_of')} AS u_default, {_u('spend', 't.customer_id', 't.as_of')} AS u_spend,
  greatest(least(true_p_accept_cli + 0.3::DOUBLE * (coalesce(utilization, 0.5) - 0.5::DOUBLE) + 0.1::DOUBLE * least(coalesce(velocity_24h, 0) / 20.0::DOUBLE, 1), 0.95), 0.01) AS pa,
  greatest(least(true_p_default + 0.2::DOUBLE * greatest(coalesce(utilization, 0.5) - 0.6::DOUBLE, 0) + 0.1::DOUBLE * greatest(0.5::DOUBLE - coalesce(paydown_rate_30d, 0.5), 0), 0.6), 0.001) AS pdef
  FROM training t JOIN params p ON t.customer_id = p.customer_id),
treated AS (SELECT *, (u_treat < 0.5)::INT AS "T", (u_treat < 0.5 AND u_accept < pa)::INT AS accepted, (u_treat < 0.5 AND u_accept < pa AND u_default < pdef)::INT AS defaulted,
  CASE WHEN u_treat < 0.5 AND u_accept < pa THEN true_delta_spend_monthly * (0.7::DOUBLE + 0.6::DOUBLE * u_spend) ELSE 0 END AS spend_delta, least(greatest(own_limit * (1 - coalesce(utilization, 0.5)), 0), 5000) AS exposed FROM chances),
labelled AS (SELECT * EXCLUDE (true_delta_spend_monthly, own_limit, u_treat, u_accept, u_default, u_spend, pa, pdef, exposed),
  CASE WHEN accepted = 1 THEN spend_delta * 12 * 0.12::DOUBLE * 0.95::DOUBLE - CASE WHEN defaulted = 1 THEN exposed * 0.8::DOUBLE ELSE 0 END - exposed * 0.0064::DOUBLE ELSE 0 END AS profit FROM treated)"""


@register("labelled_training_frame", f"WITH {LABELS_SQL} SELECT * REPLACE (round(spend_delta, 4) AS spend_delta, round(profit, 4) AS profit) FROM labelled")
def labelled_training_frame(spark, sf_dir):
    return _training(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("spend_delta", "profit")})


@register("treatment_balance", f"""WITH {LABELS_SQL} SELECT segment_id, count(*) AS n, round(avg("T"), 6) AS treated, round(avg(CASE WHEN "T" = 0 THEN profit END), 6) AS control_profit FROM labelled GROUP BY segment_id""")
def treatment_balance(spark, sf_dir):
    return rounded(_training(spark, sf_dir).groupBy("segment_id").agg(F.count("*").alias("n"), F.avg("T").alias("treated"), F.avg(F.when(F.col("T") == 0, F.col("profit"))).alias("control_profit")))


PROFILE = ("quantity", "price", "discount", "p")


@register("column_profile", f"WITH {a.SCORED_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS nulls, round(avg({c}) + 3.719e-8::DOUBLE, 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(min({c})::DOUBLE, 6) AS least, round(max({c})::DOUBLE, 6) AS greatest FROM scored" for c in PROFILE))
def column_profile(spark, sf_dir):
    return rounded(gate.profile(a.scored_accounts(spark, sf_dir), PROFILE), 6, "mean")


@register("segment_means", f"WITH {a.SCORED_SQL} SELECT segment, round(avg(price), 4) AS price_mean, round(stddev_samp(price), 4) AS price_sd, round(avg(discount), 4) AS discount_mean, round(stddev_samp(discount), 4) AS discount_sd FROM scored GROUP BY segment")
def segment_means(spark, sf_dir):
    return rounded(gate.segment_means(a.scored_accounts(spark, sf_dir), "segment", ["price", "discount"]), 4)


@register("correlation_matrix", f"WITH {a.SCORED_SQL} " + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, round(corr({x}, {y}), 6) AS corr FROM scored" for i, x in enumerate(PROFILE) for y in PROFILE[i:]))
def correlation_matrix(spark, sf_dir):
    return rounded(gate.correlations(a.scored_accounts(spark, sf_dir), PROFILE))


def _bin(x: str, edges: str) -> str:
    return f"len(list_filter({edges}[2:len({edges}) - 1], lambda e: e < {x}))"


@register("decile_grid", f"WITH {a.SCORED_SQL}, {edges_sql('scored', 'price', n=10, name='e1')}, {edges_sql('scored', 'p', n=10, name='e2')}, b AS (SELECT {_bin('price', 'e1.edges')} AS x_bin, {_bin('p', 'e2.edges')} AS y_bin, y FROM scored, e1, e2) SELECT x_bin::INT AS x_bin, " + ", ".join(f"round(avg(y) FILTER (y_bin = {i}), 6) AS d{i}" for i in range(10)) + " FROM b GROUP BY x_bin")
def decile_grid(spark, sf_dir):
    return rounded(gate.decile_grid(a.scored_accounts(spark, sf_dir), "price", "p", "y"))


BUCKET_SQL = f"WITH {a.SCORED_SQL}, {edges_sql('scored', 'price', n=10, name='e1')}, b AS (SELECT {_bin('price', 'e1.edges')}::INT AS bin, price, y FROM scored, e1), g AS (SELECT bin, count(*) AS n, avg(price) AS mean_x, avg(y) AS mean_y, stddev_samp(y) AS sd_y FROM b GROUP BY bin)"


@register("bucket_statistics", BUCKET_SQL + " SELECT bin, n, round(mean_x + 3.719e-6::DOUBLE, 4) AS mean_x, round(mean_y, 4) AS mean_y, round(sd_y, 4) AS sd_y FROM g")
def bucket_statistics(spark, sf_dir):
    return rounded(gate.buckets(a.scored_accounts(spark, sf_dir), "price", "y"), 4, "mean_x")


@register("monotonicity_verdict", BUCKET_SQL + ", r AS (SELECT rank() OVER (ORDER BY mean_x)::DOUBLE AS rx, rank() OVER (ORDER BY mean_y) + (count(*) OVER (PARTITION BY mean_y) - 1) / 2.0::DOUBLE AS ry FROM g), s AS (SELECT corr(rx, ry) AS spearman FROM r) SELECT round(spearman, 6) AS spearman, CASE WHEN spearman >= 0.7 THEN 'increasing' WHEN spearman <= -0.7 THEN 'decreasing' WHEN abs(spearman) < 0.3 THEN 'flat' ELSE 'mixed' END AS verdict FROM s")
def monotonicity_verdict(spark, sf_dir):
    return rounded(gate.monotonicity(gate.buckets(a.scored_accounts(spark, sf_dir), "price", "y")))


def _frame(spark, sf_dir, *horizons):
    every = views.all_views(a.transactions(spark, sf_dir), a.transactions_with_attributes(spark, sf_dir))
    return asof.assemble({h: v for h, v in every.items() if not horizons or h in horizons}, events=a.transactions(spark, sf_dir))


@register("rate_heterogeneity", f"WITH {TRAINING_SQL}, s AS (SELECT stddev_samp(velocity_24h) / avg(velocity_24h) AS v FROM training) SELECT 'rate_heterogeneity' AS criterion, round(v, 6) AS value, v > 0.7 AS passed, 'cv of velocity_24h' AS note FROM s")
def rate_heterogeneity(spark, sf_dir):
    return rounded(gate.rate_heterogeneity(_frame(spark, sf_dir)))


@register("temporal_signal", f"WITH {TRAINING_SQL}, l AS (SELECT customer_id, velocity_5m::DOUBLE AS x, velocity_24h::DOUBLE AS y, (lag(velocity_5m) OVER (PARTITION BY customer_id ORDER BY as_of))::DOUBLE AS z FROM training WHERE velocity_5m IS NOT NULL AND velocity_24h IS NOT NULL), g AS (SELECT customer_id, count(*) AS n, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS c, CASE WHEN count(z) > 1 AND var_pop(x) FILTER (z IS NOT NULL) > 0 AND var_pop(z) > 0 THEN corr(x, z) END AS a FROM l GROUP BY 1), s AS (SELECT avg(c) FILTER (n >= 5) AS c, count(c) FILTER (n >= 5) AS nc, avg(a) FILTER (n >= 10) AS a, count(a) FILTER (n >= 10) AS na FROM g), v AS (SELECT CASE WHEN nc >= 10 THEN c WHEN na >= 10 THEN a END AS v FROM s) SELECT 'temporal_signal' AS criterion, round(v, 6) AS value, coalesce(v >= 0.3 AND v <= 0.9, false) AS passed, 'mean correlation over customers' AS note FROM v")
def temporal_signal(spark, sf_dir):
    return rounded(gate.temporal_signal(_frame(spark, sf_dir)))


# Models: no SQL can fit these; tests hold their properties.

ACCOUNT = ["utilization", "prev_delinquency_count", "credit_score"]


def _scaled(spark, sf_dir):
    d = a.accounts(spark, sf_dir)
    return d.withColumn("credit_score", (F.col("credit_score") - 650) / 100)


@register("isotonic_scores")
def isotonic_scores(spark, sf_dir):
    d = a.scored_accounts(spark, sf_dir)
    return models.apply_isotonic(models.isotonic(d, "y", "p"), d, "p").select("l_orderkey", "l_linenumber", "p", "calibrated")


@register("hazard_curves")
def hazard_curves(spark, sf_dir):
    from quillon.operators import risk

    d = _scaled(spark, sf_dir)
    m = models.fit_hazard(risk.person_periods(d, "defaulted", "default_month"), ACCOUNT)
    return risk.survival(models.hazards(m, d, ACCOUNT), "account_id", "month", "hazard").select("account_id", "month", "hazard", "survival", "cumulative_default")


@register("fuzzy_parcel_scores")
def fuzzy_parcel_scores(spark, sf_dir):
    from quillon.operators import risk

    d = _scaled(spark, sf_dir)
    yes, no = risk.split_population(d, "pd", 0.1)
    m = models.logistic(risk.fuzzy_parcel(yes, no, "defaulted", "pd", ACCOUNT), ACCOUNT, "y", weight="weight")
    return models.probability(m, d, ACCOUNT, "score").select("account_id", "score")


@register("heckman_pd")
def heckman_pd(spark, sf_dir):
    d = _scaled(spark, sf_dir).withColumn("accepted", (F.col("paydown_rate_30d") + F.col("utilization") < 1.1).cast("int"))
    m = models.heckman(d, "accepted", "defaulted", ["utilization", "paydown_rate_30d"], ["prev_delinquency_count", "credit_score"])
    return models.heckman_scores(m, d, ["utilization", "paydown_rate_30d"], ["prev_delinquency_count", "credit_score"]).select("account_id", "pd")


def _pooled(spark, sf_dir):
    d = _scaled(spark, sf_dir)
    return d, pooled.fit(d, ACCOUNT, "segment", "defaulted")


@register("segment_pd")
def segment_pd(spark, sf_dir):
    d, m = _pooled(spark, sf_dir)
    return pooled.predict(m, d, "account_id", "segment")


@register("credible_intervals")
def credible_intervals(spark, sf_dir):
    d, m = _pooled(spark, sf_dir)
    return pooled.intervals(m, d, "account_id", "segment")


@register("portfolio_tail_loss")
def portfolio_tail_loss(spark, sf_dir):
    d, m = _pooled(spark, sf_dir)
    return models.tail_loss(pooled.portfolio_losses(m, d, "segment", "current_balance", 0.8))


@register("monotone_pd")
def monotone_pd(spark, sf_dir):
    d = _scaled(spark, sf_dir)
    m = boosting.fit(d, ACCOUNT, "defaulted", {c: s for c, s in models.CONSTRAINTS.items() if c in ACCOUNT}, trees=20)
    return boosting.score(m, d, "account_id")


@register("monotone_linear_pd")
def monotone_linear_pd(spark, sf_dir):
    d = _scaled(spark, sf_dir)
    return models.probability(models.monotone_pd(d, ACCOUNT, "defaulted"), d, ACCOUNT, "score").select("account_id", "score")


UPLIFT = ["utilization", "velocity_24h", "paydown_rate_30d", "credit_score"]
#: The views that UPLIFT and the labels' outcomes come from.
UPLIFT_VIEWS = ("5m", "24h", "30d", "attributes")


def _learned(df, *columns):
    """The columns that a model reads, written: fits and splits read their frame many times, and each reading would make all views again."""
    return storage.written(df.select(*dict.fromkeys(columns)), "training")


@register("t_learner_uplift")
def t_learner_uplift(spark, sf_dir):
    d = _learned(_training(spark, sf_dir, *UPLIFT_VIEWS), "customer_id", "as_of", *UPLIFT, "T", "profit")
    return models.uplift(models.t_learner(d, UPLIFT, "T", "profit"), d, UPLIFT).select("customer_id", "as_of", "uplift", (F.col("uplift") > 0).cast("int").alias("action"))


@register("segment_importance")
def segment_importance(spark, sf_dir):
    return models.importances(models.forest(_segments(spark, sf_dir), SEPARATING, "segment_id", trees=10, depth=5), SEPARATING, spark)


SEPARATING = ["credit_score", "annual_income", "account_tenure_months", "total_spend_30d"]


def _segments(spark, sf_dir):
    return _learned(_training(spark, sf_dir, *UPLIFT_VIEWS), "customer_id", *SEPARATING, "segment_id")


def _separable(spark, sf_dir):
    return models.separability(_segments(spark, sf_dir), "customer_id", SEPARATING, "segment_id")


@register("segment_separability")
def segment_separability(spark, sf_dir):
    return _separable(spark, sf_dir)


@register("separability_verdict")
def separability_verdict(spark, sf_dir):
    return models.separability_verdict(_separable(spark, sf_dir))


@register("customer_split", f"WITH {a.TX_SQL}, keys AS (SELECT DISTINCT customer_id FROM tx), nth AS (SELECT customer_id, row_number() OVER (ORDER BY {e.key_hash_sql('customer_id')}, customer_id) AS k, count(*) OVER () AS n FROM keys) SELECT event_id, customer_id, k <= greatest(1, floor(n * 0.2::DOUBLE)) AS held_out FROM tx JOIN nth USING (customer_id)")
def customer_split(spark, sf_dir):
    rest, held = models.group_split(a.transactions(spark, sf_dir), "customer_id", 0.2)
    return rest.select("event_id", "customer_id", F.lit(False).alias("held_out")).unionByName(held.select("event_id", "customer_id", F.lit(True).alias("held_out")))


@register("feature_vector_hash")
def feature_vector_hash(spark, sf_dir):
    d = a.accounts(spark, sf_dir)
    return d.select("account_id", decide.feature_hash("utilization", "credit_score", "annual_income").alias("feature_hash"))


@register("best_profit_so_far", f"WITH {a.DECISIONS_SQL} SELECT decision_id, round(max(reward) OVER (PARTITION BY customer_id ORDER BY ts, decision_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS best FROM dec")
def best_profit_so_far(spark, sf_dir):
    from quillon.operators.evaluate import best_so_far

    return rounded(best_so_far(a.decisions(spark, sf_dir), ["customer_id"], ["ts", "decision_id"], "reward").select("decision_id", "best"), 4)


def _pairs(part: str, item: str, source: str, **metrics: str) -> str:
    names, values = ", ".join(f"'{m}'" for m in metrics), ", ".join(f"({v})::DOUBLE" for v in metrics.values())
    return f"SELECT '{part}' AS part, {item} AS item, unnest([{names}]) AS metric, round(unnest([{values}]) + 3.719e-6::DOUBLE, 4) AS value FROM {source}"


EVALUATED = ("utilization", "credit_score", "paydown_rate_30d")
_OWN_SCORED = f"{a.ACCOUNTS_SQL}, scored AS (SELECT account_id AS l_orderkey, 0 AS l_linenumber, account_id, segment, defaulted AS y, pd AS p, (segment % 2)::VARCHAR AS grp, {', '.join(EVALUATED)}, account_id % 2 AS half FROM acc)"
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS x, y, half AS c FROM scored" for f in EVALUATED) + ")"
_after = lambda sql, head: sql.split(head, 1)[1]
_NO_BY = "SELECT round(abs(sum(sum(y)) OVER (ORDER BY p)::DOUBLE / sum(sum(y)) OVER () - sum(count(*) - sum(y)) OVER (ORDER BY p)::DOUBLE / sum(count(*) - sum(y)) OVER ()), 12) AS gap, p FROM scored GROUP BY p"
_COHORTS = "coh AS (SELECT strftime(originated, '%Y-%m') AS cohort, defaulted, default_month FROM acc), sizes AS (SELECT cohort, count(*) AS accounts FROM coh GROUP BY 1), r12 AS (SELECT cohort, count(*) FILTER (defaulted = 1 AND default_month <= 12) / accounts AS rate FROM coh JOIN sizes USING (cohort) GROUP BY cohort, accounts), moves AS (SELECT cohort AS newer, lag(rate) OVER (ORDER BY cohort) AS was, rate FROM r12)"
FULL_SQL = f"""WITH {_OWN_SCORED}, {_LONG}, {_after(risk_plans.CAL_SQL, a.SCORED_SQL + ", ")},
lor AS (SELECT bin, count(*) AS n, sum(y)::BIGINT AS events, min(p) AS cutoff FROM (SELECT y, p, (greatest(ceil((row_number() OVER (ORDER BY p DESC, l_orderkey) - 1)::DOUBLE * 10 / (count(*) OVER () - 1)) - 1, 0) + 1)::INT AS bin FROM scored) GROUP BY 1),
lorenz AS (SELECT *, sum(n) OVER (ORDER BY bin)::DOUBLE / sum(n) OVER () AS cum_population, sum(events) OVER (ORDER BY bin)::DOUBLE / sum(events) OVER () AS cum_events FROM lor),
k AS (SELECT gap AS ks, p AS threshold FROM ({_NO_BY}) ORDER BY gap DESC, p LIMIT 1),
au AS (SELECT n, n_events, (sum_rank - n_events * (n_events + 1) / 2) / (n_events * (n - n_events)) AS auc FROM (SELECT sum(y)::BIGINT AS n_events, count(*) AS n, sum(CASE WHEN y = 1 THEN rk END) AS sum_rank FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM scored))),
cs AS (SELECT sum(n * abs(mean_score - event_rate)) / sum(n) AS ece, sum(n) AS n, {risk_plans.HL_SQL} AS statistic, greatest(count(*) - 2, 1) AS df FROM cal),
whole AS (SELECT avg(pow(y - p, 2)) AS brier, avg(p) AS mean_score, avg(y) AS event_rate FROM scored),
{_after(risk_plans.LOSS_SQL, a.ACCOUNTS_SQL + ", ")},
st AS (SELECT * FROM (VALUES ('baseline', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.8::DOUBLE), ('adverse', 0.9::DOUBLE, 1.15::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 0.02::DOUBLE, 0.85::DOUBLE), ('severely_adverse', 0.8::DOUBLE, 1.35::DOUBLE, 0.6::DOUBLE, 2.0::DOUBLE, 0.05::DOUBLE, 0.9::DOUBLE)) t(scenario, f_income, f_use, f_pay, more, floor, lgd)),
s1 AS (SELECT scenario, lgd, greatest(least(greatest(0.02::DOUBLE + 0.1::DOUBLE * (utilization * f_use) + 0.03::DOUBLE * (prev_delinquency_count + more) + 2000.0::DOUBLE / (annual_income * f_income) - 0.02::DOUBLE * (paydown_rate_30d * f_pay), 0.001), 0.6), floor) AS pd, current_balance + 0.6::DOUBLE * greatest(credit_limit - current_balance, 0) AS ead FROM acc, st),
stressed AS (SELECT scenario, count(*) AS accounts, sum(ead) AS total_ead, sum(pd * lgd * ead) AS expected_loss, sqrt(sum(pow(ead * lgd * sqrt(greatest(pd * (1 - pd), 0)), 2))) AS unexpected_loss, sum(pd * lgd * ead) / greatest(sum(ead), 1) AS loss_rate, sum(pd * ead) / greatest(sum(ead), 1) AS weighted_pd, sum(lgd * ead) / greatest(sum(ead), 1) AS weighted_lgd FROM s1 GROUP BY scenario),
{_COHORTS}, {_after(risk_plans.WOE_SQL, risk_plans.LONG_SQL + ", ").replace('edges', 'wedges')},
{_after(risk_plans.PRE_SQL, risk_plans.LONG_SQL + ", ").replace('edges', 'pedges')},
{monitor_plans._psi_sql('feature', 'csi', 'greatest({x}, 1e-6::DOUBLE)', False).replace('edges', 'cedges')},
rates AS (SELECT grp, count(*) AS n, sum(y) AS n_positive, count(*) FILTER (p >= 0.2) AS n_selected, avg((p >= 0.2)::INT) AS selection_rate, avg(CASE WHEN y = 1 THEN (p >= 0.2)::INT END) AS tpr, avg(CASE WHEN y = 0 THEN (p >= 0.2)::INT END) AS fpr, avg(CASE WHEN p >= 0.2 THEN y END) AS ppv FROM scored GROUP BY grp)
""" + " UNION ALL ".join([
    _pairs("calibration", "NULL", "cs, whole", brier="brier", mean_score="whole.mean_score", event_rate="whole.event_rate", ece="ece", n="cs.n", statistic="statistic", df="df"),
    _pairs("discrimination", "NULL", "au, k", auc="auc", gini="2 * auc - 1", n="n", n_events="n_events", ks="ks", threshold="threshold", top_decile_capture="(SELECT cum_events FROM lorenz WHERE bin = 1)"),
    _pairs("gains", "bin::VARCHAR", "lorenz", n="n", events="events", cum_population="cum_population", cum_events="cum_events", cutoff="cutoff", event_rate="events / n"),
    _pairs("calibration_bins", "bin::VARCHAR", "cal", n="n", mean_score="mean_score", event_rate="event_rate", lo="lo", hi="hi", observed="observed", expected="expected"),
    _pairs("loss", "NULL", "(SELECT count(*) AS accounts, sum(ead) AS total_ead, sum(expected_loss) AS expected_loss, sqrt(sum(pow(unexpected_loss, 2))) AS unexpected_loss, sum(pd * ead) AS pe, sum(lgd * ead) AS le FROM loss)", accounts="accounts", total_ead="total_ead", expected_loss="expected_loss", unexpected_loss="unexpected_loss", loss_rate="expected_loss / greatest(total_ead, 1)", weighted_pd="pe / greatest(total_ead, 1)", weighted_lgd="le / greatest(total_ead, 1)"),
    _pairs("stress", "scenario", "stressed", **{c: c for c in ("accounts", "total_ead", "expected_loss", "unexpected_loss", "loss_rate", "weighted_pd", "weighted_lgd")}),
    _pairs("vintage_drift", "newer", "moves WHERE was > 0 AND abs((rate - was) / was) >= 0.5", change="(rate - was) / was"),
    _pairs("information_value", "feature", f"({risk_plans.IV_SQL})", iv="iv", n_bins="n_bins"),
    _pairs("monotonicity", "feature", "rho", n_bins="n_bins", spearman="spearman"),
    _pairs("csi", "feature", "csi", csi="v", ref="ref", cur="cur"),
    _pairs("fairness_rates", "grp", "rates", **{c: c for c in ("n", "n_positive", "n_selected", "selection_rate", "tpr", "fpr", "ppv")}),
    _pairs("fairness", "NULL", "(SELECT count(*) AS n_groups, CASE WHEN max(selection_rate) = 0 THEN 1 ELSE min(selection_rate) / max(selection_rate) END AS parity_ratio, max(tpr) - min(tpr) AS tpr_gap, max(fpr) - min(fpr) AS fpr_gap, max(ppv) - min(ppv) AS ppv_gap FROM rates)", n_groups="n_groups", parity_ratio="parity_ratio", tpr_gap="tpr_gap", fpr_gap="fpr_gap", ppv_gap="ppv_gap"),
])


@register("full_evaluation", FULL_SQL)
def full_evaluation(spark, sf_dir):
    from quillon.operators import evaluate

    d = a.accounts(spark, sf_dir).withColumn("grp", (F.col("segment") % 2).cast("string"))
    half = lambda k: d.where(F.col("account_id") % 2 == k)
    tables = evaluate.full_evaluation(d, y="defaulted", p="pd", key="account_id", balance="current_balance", limit="credit_limit", score=risk_plans._score, origination="originated", default_month="default_month", group="grp", group_threshold=0.2, reference=half(0), current=half(1), features=EVALUATED)
    return evaluate.headline(tables).where("metric <> 'p_value'").withColumn("value", F.round(F.col("value") + 3.719e-6, 4))


@register("random_policy", f"""WITH {a.DECISIONS_SQL} SELECT decision_id, ({e.uniform_sql('decision_id', "'policy'")} < 0.5)::INT AS act FROM dec""")
def random_policy(spark, sf_dir):
    return a.decisions(spark, sf_dir).select("decision_id", decide.random_policy("decision_id").alias("act"))


def _true_uplift(d):
    """What an offer is worth by the customer's own parameters."""
    pa = e.effective_p_accept(F.col("true_p_accept_cli"), F.col("utilization"), F.col("velocity_24h"))
    pdef = e.effective_p_default(F.col("true_p_default"), F.col("utilization"), F.col("paydown_rate_30d"))
    return e.expected_profit(pa, pdef, F.col("true_delta_spend_monthly"), e.exposure(F.col("own_limit"), F.col("utilization")))


def _with_truth(spark, sf_dir):
    p = a.parameters(spark, sf_dir).drop("segment_id").withColumnRenamed("credit_limit", "own_limit")
    d = _training(spark, sf_dir, *UPLIFT_VIEWS).join(p, "customer_id")
    return _learned(d.withColumn("truth", _true_uplift(d)), "customer_id", "segment_id", *UPLIFT, "T", "accepted", "spend_delta", "defaulted", "profit", "truth")


@register("per_segment_uplift")
def per_segment_uplift(spark, sf_dir):
    found = models.train_per_segment(_with_truth(spark, sf_dir), "customer_id", "segment_id", UPLIFT, "T", "truth")
    return spark.createDataFrame([(int(s), float(r), float(t)) for s, (r, t, *_) in found.items()], "segment_id int, reg double, tau double")


@register("baseline_report")
def baseline_report(spark, sf_dir):
    """Always, never, random and the linear T-learner, on customers that the learner has not seen."""
    train, test = models.group_split(_with_truth(spark, sf_dir), "customer_id", 0.2)
    d = models.uplift(models.t_learner(train, UPLIFT, "T", "profit"), test, UPLIFT)
    d = d.withColumns({**decide.baselines("customer_id"), "t_learner": (F.col("uplift") > 0).cast("int"), "optimal": (F.col("truth") > 0).cast("int")})
    return rounded(decide.policy_report(d, ["always", "never", "random", "t_learner"], "truth", "optimal"))
