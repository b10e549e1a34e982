"""Decisions in batch: scores, canary, choice and the record that is kept; outcomes and reasons."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import economics as e

#: Wordings of adverse-action reasons, and of all others; fixed values.
REASONS = {
    "velocity_5m": "High recent transaction frequency",
    "velocity_1h": "Elevated short-term spending velocity",
    "velocity_24h": "High daily transaction count",
    "avg_amount_30d": "Average transaction amount outside expected range",
    "utilization": "High credit utilization ratio",
    "pct_cash_advance_30d": "Elevated cash advance activity",
    "paydown_rate_30d": "Low monthly payment rate",
    "mcc_entropy_24h": "Unusual merchant category diversity",
    "credit_score": "Low credit score",
    "annual_income": "Insufficient income for requested credit",
    "account_tenure_months": "Limited account history",
    "n_products": "Limited product relationship",
    "prev_delinquency_count": "Previous delinquency on record",
}
OTHER_REASON = "Model factor outside favorable range"
#: Coded reasons of the notices that follow denials; fixed values.
REASON_CODES = {
    "velocity_5m": "R001: High recent transaction frequency",
    "velocity_1h": "R002: Elevated short-term spending velocity",
    "velocity_24h": "R003: High daily transaction count",
    "avg_amount_30d": "R004: Average transaction amount outside expected range",
    "utilization": "R005: High credit utilization ratio",
    "pct_cash_advance_30d": "R006: Elevated cash advance activity",
    "paydown_rate_30d": "R007: Low monthly payment rate",
    "mcc_entropy_24h": "R008: Unusual merchant category diversity",
    "total_spend_5m": "R009: High short-term total spending",
    "total_spend_1h": "R010: Elevated hourly spending total",
    "avg_spend_5m": "R011: High average per-transaction amount (5m)",
    "avg_spend_1h": "R012: High average per-transaction amount (1h)",
    "total_spend_24h": "R013: High daily spending total",
    "avg_spend_24h": "R014: High average per-transaction amount (24h)",
    "pct_late_night_24h": "R015: Unusual late-night transaction pattern",
    "avg_interarrival_24h": "R016: Unusual transaction timing pattern",
    "velocity_7d": "R017: High weekly transaction frequency",
    "total_spend_7d": "R018: High weekly spending total",
    "geo_variance_7d": "R019: High geographic variance in transactions",
    "velocity_30d": "R020: High monthly transaction frequency",
    "total_spend_30d": "R021: High monthly spending total",
    "avg_utilization_30d": "R022: Sustained high utilization over 30 days",
}
OTHER_CODE = "R099: Model factor outside favorable range"
Scorer = Callable[[DataFrame], DataFrame]


def choose(df: DataFrame, offer: str, fraud: str) -> DataFrame:
    """df with action, action_name, propensity, expected_profit and rationale."""
    return df.withColumns(e.choice(F.col(offer), F.col(fraud)))


def decide(df: DataFrame, champion: Scorer, challenger: Scorer, *, key: str, fraction: float, fraud: str = "fraud_score", exposed: float = e.EXPOSURE_CAP) -> DataFrame:
    """Two records for each row, the champion's and the challenger's, with `acts` on the one whose action is taken.

    A scorer adds p_accept, spend and p_default. Records keep the feature vector in `features`.
    """
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")]
    kept = df.withColumn("features", F.map_from_arrays(F.array(*[F.lit(c) for c in numeric]), F.array(*[F.col(c).cast("double") for c in numeric])))

    def one(alias: str, score: Scorer) -> DataFrame:
        d = score(kept).withColumn("offer_profit", e.profit_treated(F.col("p_accept"), F.col("spend"), F.col("p_default"), F.lit(float(exposed))))
        d = choose(d.withColumn("fraud_profit", e.profit_fraud_check(F.col(fraud))), "offer_profit", "fraud_profit")
        mine = e.in_canary(F.col(key), fraction) == F.lit(alias == "challenger")
        return d.withColumns({"alias": F.lit(alias), "acts": mine, "eligible": F.col("action") == 0})

    return one("champion", champion).unionByName(one("challenger", challenger))


def decode_decisions(raw: DataFrame, value: str = "value") -> DataFrame:
    """Decisions from JSON: records without id, customer, time or action are dropped; missing optional fields get their defaults."""
    schema = "decision_id string, customer_id string, timestamp_ms long, action string, alias string, segment_id int, current_utilization double, velocity_24h double, paydown_rate_30d double"
    d = raw.select(F.from_json(F.col(value), schema).alias("d")).select("d.*")
    d = d.where(F.col("decision_id").isNotNull() & F.col("customer_id").isNotNull() & F.col("timestamp_ms").isNotNull() & F.col("action").isNotNull())
    return d.withColumns({"alias": F.coalesce("alias", F.lit("champion")), "segment_id": F.coalesce("segment_id", F.lit(0)), "current_utilization": F.coalesce("current_utilization", F.lit(0.5))})


def encode(df: DataFrame, key: str | None = None, money: Sequence[str] = ()) -> DataFrame:
    """Rows as (key, value) records of a topic: JSON, amounts with two decimals."""
    d = df.withColumns({c: F.round(c, 2) for c in money})
    return d.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), F.to_json(F.struct(*d.columns)).alias("value"))


def outcomes(decisions: DataFrame, parameters: DataFrame, *, seed: int = 42) -> DataFrame:
    """Each offer's outcome, drawn from hashes of its decision; customers without parameters are left out."""
    d = decisions.join(parameters.drop("segment_id"), "customer_id")
    accept = e.effective_p_accept(F.col("true_p_accept_cli"), F.col("utilization"), F.col("velocity_24h"))
    default = e.effective_p_default(F.col("true_p_default"), F.col("utilization"), F.col("paydown_rate_30d"))
    u = lambda tag: e.uniform("decision_id", F.lit(tag), seed=seed)
    d = d.withColumn("accepted", (F.col("action") == 1) & (u("accept") < accept)).withColumn("defaulted", F.col("accepted") & (u("default") < default))
    spend = F.when(F.col("accepted"), F.col("true_delta_spend_monthly") * F.exp(0.3 * (u("a") + u("b") + u("c") - 1.5) * 2)).otherwise(0.0)
    d = d.withColumn("spend", spend)
    return d.withColumn("profit", F.when(F.col("accepted"), e.realized_profit(F.col("spend"), F.col("defaulted"), variant="outcome")).otherwise(0.0)).select("decision_id", "customer_id", "accepted", "defaulted", "spend", "profit")


def decision_outcomes(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes with their decisions' fields; defaults where the decision is unknown."""
    d = outcomes.join(decisions.select("decision_id", "alias", "segment_id", "action", "propensity"), "decision_id", "left")
    return with_defaults(d)


def with_defaults(d: DataFrame) -> DataFrame:
    """Outcomes' fields of the decision, defaults where it is unknown."""
    return d.withColumns({"alias": F.coalesce("alias", F.lit("champion")), "segment_id": F.coalesce("segment_id", F.lit(0)), "propensity": F.coalesce("propensity", F.lit(1.0))})


def labels(features: DataFrame, parameters: DataFrame, *, seed: int = 42) -> DataFrame:
    """Features with a randomised treatment T and its outcome: accepted, spend_delta, defaulted, profit. Unknown customers are left out."""
    keep = features.drop("segment_id")
    d = keep.join(parameters.withColumnRenamed("credit_limit", "_limit"), "customer_id")
    u = lambda tag: e.uniform("customer_id", "as_of", F.lit(tag), seed=seed)
    accept = e.effective_p_accept(F.col("true_p_accept_cli"), F.col("utilization"), F.col("velocity_24h"))
    default = e.effective_p_default(F.col("true_p_default"), F.col("utilization"), F.col("paydown_rate_30d"))
    d = d.withColumn("T", (u("treat") < 0.5).cast("int")).withColumn("accepted", ((F.col("T") == 1) & (u("accept") < accept)).cast("int"))
    d = d.withColumn("defaulted", ((F.col("accepted") == 1) & (u("default") < default)).cast("int"))
    d = d.withColumn("spend_delta", F.when(F.col("accepted") == 1, F.col("true_delta_spend_monthly") * (0.7 + 0.6 * u("spend"))).otherwise(0.0))
    profit = e.realized_profit(F.col("spend_delta"), F.col("defaulted"), e.exposure(F.col("_limit"), F.col("utilization")))
    d = d.withColumn("profit", F.when(F.col("accepted") == 1, profit).otherwise(0.0))
    return d.drop("_limit", "true_p_accept_cli", "true_delta_spend_monthly", "true_p_default")


def reasons(df: DataFrame, key: str, features: Sequence[str], score: Scorer, background: dict[str, float], *, top: int = 4, wordings: dict[str, str] = REASONS, other: str = OTHER_REASON) -> DataFrame:
    """(key, reasons): for each row, the features that lower its profit most against the background, at most `top`.

    Each row is scored as it is and once with each feature at its background value, in one pass.
    """
    names = [None, *features]
    d = df.withColumn("_f", F.explode(F.array(*[F.lit(n).cast("string") for n in names])))
    d = d.withColumns({f"_own_{f}": F.col(f).cast("double") for f in features})
    d = d.withColumns({f: F.when(F.col("_f") == f, F.lit(float(background[f]))).otherwise(F.col(f).cast("double")) for f in features})
    d = score(d)
    value = F.coalesce(*[F.when(F.col("_f") == f, F.col(f"_own_{f}")) for f in features])
    whole = Window.partitionBy(key)
    base = F.max(F.when(F.col("_f").isNull(), F.col("profit"))).over(whole)
    d = d.withColumn("_v", base - F.col("profit")).withColumn("_value", value).where(F.col("_f").isNotNull() & (F.col("_v") < -1e-9))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_v", "_f"))).where(F.col("_k") <= top)
    words = F.coalesce(F.create_map(*[F.lit(x) for kv in wordings.items() for x in kv])[F.col("_f")], F.lit(other))
    return d.select(key, F.col("_k").alias("rank"), F.col("_f").alias("feature"), words.alias("description"), F.round("_v", 4).alias("attribution"), F.round("_value", 4).alias("feature_value"))


def denials(decisions: DataFrame) -> DataFrame:
    """Decisions that call for a notice of reasons."""
    return decisions.where(F.coalesce(F.col("regulatory_flags")["adverse_action_eligible"], F.lit(False)))


def notices(decisions: DataFrame, features: Sequence[str], score: Scorer, background: dict[str, float], *, top: int = 4) -> DataFrame:
    """One notice for each denied decision: its id, customer and alias, and the coded reasons, the weightiest first.

    Decisions carry their features; one without any lowering feature has an empty list.
    """
    d = denials(decisions).withColumn("acted_on_alias", F.coalesce("acted_on_alias", F.lit("champion")))
    found = reasons(d.select("decision_id", *features), "decision_id", features, score, background, top=top, wordings=REASON_CODES, other=OTHER_CODE)
    listed = found.groupBy("decision_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "description"))), lambda r: r["description"]).alias("reason_codes"))
    none = F.array().cast("array<string>")
    return d.select("decision_id", "customer_id", "acted_on_alias").join(listed, "decision_id", "left").withColumn("reason_codes", F.coalesce("reason_codes", none))


def sentiment_rows(df: DataFrame, scores: str = "scores") -> DataFrame:
    """One row for each coin's score of an item."""
    rest = [c for c in df.columns if c != scores]
    return df.select(*rest, F.explode(scores).alias("_s")).select(*rest, "_s.*")


def sentiment_agreement(df: DataFrame, ours: str, theirs: str) -> DataFrame:
    """Mean agreement of two score columns: both 0 or missing agree, both non-zero agree if equal, else not."""
    x, y = F.coalesce(F.col(ours), F.lit(0)), F.coalesce(F.col(theirs), F.lit(0))
    return df.agg(F.avg(F.when((x == 0) & (y == 0), 1.0).when((x != 0) & (y != 0) & (x == y), 1.0).otherwise(0.0)).alias("agreement"))


def baselines(key: str) -> dict[str, Column]:
    """Actions of the policies that need no model."""
    return {"always": F.lit(1), "never": F.lit(0), "random": random_policy(key)}


def policy_report(df: DataFrame, actions: Sequence[str], profit: str, optimal: str) -> DataFrame:
    """(policy, mean_profit, act_rate, agreement) of columns that hold each policy's action; profit counts where it acts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("policy"), F.col(a).cast("int").alias("act")) for a in actions]))
    d = df.select(profit, optimal, pairs.alias("_p")).select(profit, optimal, "_p.*")
    return d.groupBy("policy").agg(F.avg(F.when(F.col("act") == 1, F.col(profit)).otherwise(0.0)).alias("mean_profit"), F.avg("act").alias("act_rate"), F.avg((F.col("act") == F.col(optimal)).cast("int")).alias("agreement"))


def champion(report: DataFrame) -> DataFrame:
    """The policy with the highest mean profit, the first by name of equals."""
    return report.agg(F.min_by("policy", F.struct(-F.col("mean_profit"), F.col("policy"))).alias("policy"), F.max("mean_profit").alias("mean_profit"))


def arm_statistics(df: DataFrame, arm: str, reward: str, features: Sequence[str]) -> DataFrame:
    """(arm, i, j, a, b, n): sums of x_i x_j and of reward x_i for each arm of a linear bandit, the constant being x_0."""
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    d = df.select(F.col(arm).alias("arm"), F.col(reward).alias("r"), x.alias("x")).select("arm", "r", "x", F.posexplode("x").alias("i", "xi"))
    d = d.select("arm", "r", "i", "xi", F.posexplode("x").alias("j", "xj"))
    return d.groupBy("arm", "i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("a"), F.sum(F.when(F.col("j") == 0, F.col("r") * F.col("xi"))).alias("b"), F.count("*").alias("n"))


def bandit_scores(df: DataFrame, statistics: DataFrame, features: Sequence[str], *, alpha: float = 1.0) -> DataFrame:
    """df with `scores`, each arm's upper confidence value, and `arm`, the best; the statistics are arms times features squared."""
    import numpy as np

    size = len(features) + 1
    arms: dict = {}
    for r in statistics.collect():
        a, b = arms.setdefault(r.arm, (np.eye(size), np.zeros(size)))
        a[r.i, r.j] += r.a
        if r.j == 0:
            b[r.i] += r.b
    x = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]
    scores = []
    for arm in sorted(arms):
        inverse = np.linalg.inv(arms[arm][0])
        theta = inverse @ arms[arm][1]
        mean = sum((F.lit(float(t)) * c for t, c in zip(theta, x, strict=True)), F.lit(0.0))
        spread = sum((F.lit(float(inverse[i, j])) * x[i] * x[j] for i in range(size) for j in range(size)), F.lit(0.0))
        scores.append(F.struct((mean + alpha * F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("score"), F.lit(arm).alias("arm")))
    d = df.withColumn("scores", F.array(*scores))
    return d.withColumn("arm", F.array_max("scores")["arm"])


def normal(*parts) -> Column:
    """A standard normal number from a key, by the polar form of two uniform ones."""
    u, v = e.uniform(*parts, F.lit("r")), e.uniform(*parts, F.lit("angle"))
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def thompson_scores(df: DataFrame, statistics: DataFrame, features: Sequence[str], key: str, *, prior_variance: float = 1.0) -> DataFrame:
    """df with `scores`, each arm's value under coefficients drawn from its posterior for this row, and `arm`, the best.

    Draws are mean + L z with the Cholesky factor L of the posterior covariance and z from hashes of (key, arm, place), so
    a row's draw is the same on any partitioning. The statistics are arms times features squared.
    """
    import numpy as np

    size = len(features) + 1
    arms: dict = {}
    for r in statistics.collect():
        a, b = arms.setdefault(r.arm, (np.eye(size) / prior_variance, np.zeros(size)))
        a[r.i, r.j] += r.a
        if r.j == 0:
            b[r.i] += r.b
    x = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]
    scores = []
    for arm in sorted(arms):
        covariance = np.linalg.inv(arms[arm][0])
        mean, factor = covariance @ arms[arm][1], np.linalg.cholesky(covariance)
        value = sum((F.lit(float(m)) * c for m, c in zip(mean, x, strict=True)), F.lit(0.0))
        for j in range(size):
            value = value + normal(key, F.lit(arm), F.lit(j)) * sum((F.lit(float(factor[i, j])) * x[i] for i in range(j, size)), F.lit(0.0))
        scores.append(F.struct(value.alias("score"), F.lit(arm).alias("arm")))
    d = df.withColumn("scores", F.array(*scores))
    return d.withColumn("arm", F.array_max("scores")["arm"])


def softmax_arms(df: DataFrame, key: str, means: DataFrame, *, temperature: float = 1.0) -> DataFrame:
    """df with `probabilities` of the arms (ascending) by exp(mean / temperature), and `arm`, drawn by a hash of the key. means(arm, mean) has a row an arm."""
    rows = sorted((r.arm, r.mean) for r in means.select("arm", "mean").collect())
    top = max(m for _, m in rows)
    weights = [math.exp((m - top) / max(temperature, 1e-6)) for _, m in rows]
    shares = [w / sum(weights) for w in weights]
    u, arm, below = e.uniform(key, F.lit("softmax")), F.lit(rows[-1][0]), 1.0
    for (name, _), share in zip(reversed(rows[:-1]), reversed(shares[1:]), strict=True):
        below -= share
        arm = F.when(u < below, F.lit(name)).otherwise(arm)
    return df.withColumn("probabilities", F.array(*[F.lit(s) for s in shares])).withColumn("arm", arm)


def feature_hash(*columns: str):
    """16-byte blake2b of the features as %.6g, joined by commas; nulls count as 0. C's %g has no counterpart in Spark, so this is an Arrow UDF."""
    @F.pandas_udf("string")
    def digest(parts: pd.DataFrame) -> pd.Series:
        rows = parts.fillna(0.0).itertuples(index=False)
        return pd.Series([hashlib.blake2b(",".join(f"{v:.6g}" for v in r).encode(), digest_size=16).hexdigest() for r in rows])

    return digest(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]))


def random_policy(key: str, *, share: float = 0.5, seed: int = 42):
    """1 for about `share` of the keys, always the same ones."""
    return (e.uniform(key, F.lit("policy"), seed=seed) < share).cast("int")
