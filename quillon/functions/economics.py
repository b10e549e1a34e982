"""What an offer is worth: column expressions of behaviour, exposure and profit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the cost-benefit table.
NIM_ANNUAL, LGD, DISCOUNT_FACTOR, CAPITAL_COST_RATE = 0.12, 0.8, 0.95, 0.0064
EXPOSURE_CAP, FRAUD_LOSS, FRAUD_FRICTION, TEMPERATURE = 5000.0, 500.0, 40.0, 10.0
#: What unknown behaviour counts as.
UTILIZATION, VELOCITY, PAYDOWN = 0.5, 0.0, 0.5
ACTIONS = ("NOTHING", "OFFER_CLI", "FRAUD_CHECK")


def known(x: Column, neutral: float) -> Column:
    """x, or a neutral value where it is null or not a number; zeros stay."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(neutral))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def effective_p_accept(p: Column, utilization: Column, velocity: Column) -> Column:
    u, v = known(utilization, UTILIZATION), known(velocity, VELOCITY)
    return clip(p + 0.3 * (u - 0.5) + 0.1 * F.least(v / 20.0, F.lit(1.0)), 0.01, 0.95)


def effective_p_default(p: Column, utilization: Column, paydown: Column) -> Column:
    u, r = known(utilization, UTILIZATION), known(paydown, PAYDOWN)
    return clip(p + 0.2 * F.greatest(u - 0.6, F.lit(0.0)) + 0.1 * F.greatest(0.5 - r, F.lit(0.0)), 0.001, 0.60)


def exposure(limit: Column, utilization: Column) -> Column:
    return F.least(F.greatest(limit * (1.0 - known(utilization, UTILIZATION)), F.lit(0.0)), F.lit(EXPOSURE_CAP))


def expected_profit(p_accept: Column, p_default: Column, monthly_spend: Column, exposed: Column) -> Column:
    """Expected profit of an offer from the customer's own parameters; default and capital only cost where it is accepted."""
    revenue = monthly_spend * 12 * NIM_ANNUAL * DISCOUNT_FACTOR
    return p_accept * (revenue - p_default * exposed * LGD - exposed * CAPITAL_COST_RATE)


def realized_profit(spend: Column, defaulted: Column, exposed: Column | None = None, variant: str = "label") -> Column:
    """Profit of an accepted offer with its outcome known.

    variant "label": a year of spend against the given exposure; "outcome": one month's spend
    against twelve of them, up to the cap.
    """
    if variant == "label":
        revenue, at_risk = spend * 12 * NIM_ANNUAL * DISCOUNT_FACTOR, exposed
    else:
        revenue, at_risk = spend * NIM_ANNUAL * DISCOUNT_FACTOR, F.least(spend * 12.0, F.lit(EXPOSURE_CAP))
    return revenue - F.when(defaulted.cast("int") == 1, at_risk * LGD).otherwise(0.0) - at_risk * CAPITAL_COST_RATE


def profit_treated(p_accept: Column, spend: Column, p_default: Column, exposed: Column) -> Column:
    """Expected profit of an offer from a model's predictions."""
    return p_accept * (12 * spend * NIM_ANNUAL * DISCOUNT_FACTOR - p_default * exposed * LGD - exposed * CAPITAL_COST_RATE)


def profit_fraud_check(score: Column) -> Column:
    p = clip(score, 0.0, 1.0)
    return p * FRAUD_LOSS - (1 - p) * FRAUD_FRICTION


def choice(offer: Column, fraud: Column) -> dict[str, Column]:
    """The most profitable of nothing, offer and fraud check, the first of equals; its softmax propensity, profit and rationale."""
    best = F.greatest(F.lit(0.0), offer, fraud)
    action = F.when(best <= 0.0, 0).when(offer == best, 1).otherwise(2)
    z = lambda x: F.exp((x - best) / TEMPERATURE)
    total = z(F.lit(0.0)) + z(offer) + z(fraud)
    name = F.element_at(F.array(*[F.lit(x) for x in ACTIONS]), action + 1)
    return {"action": action, "action_name": name, "propensity": 1.0 / total, "expected_profit": best, "rationale": F.format_string("argmax(offer=%.2f, fraud=%.2f, nothing=0.00) → %s", offer, fraud, name)}


def cohort_bucket(key: Column) -> Column:
    """Stable bucket 0..9999 of an id."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 10000


def in_canary(key: Column, fraction: float) -> Column:
    if fraction <= 0:
        return F.lit(False)
    return F.lit(True) if fraction >= 1 else cohort_bucket(key) < int(fraction * 10000)


def key_hash(*parts: Column | str, seed: int = 42) -> Column:
    """52 bits of a hash of a key, as a long: the same on any partitioning and in any engine that has md5. Null parts are left out."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def uniform(*parts: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) from a key."""
    return key_hash(*parts, seed=seed).cast("double") / float(1 << 52)


def key_hash_sql(*parts: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(f'({p})::VARCHAR' for p in parts)}, '{seed}')), 1, 13))::BIGINT"


def uniform_sql(*parts: str, seed: int = 42) -> str:
    """uniform() in DuckDB's SQL."""
    return f"({key_hash_sql(*parts, seed=seed)}::DOUBLE / {1 << 52}.0::DOUBLE)"


def namespace_seed(master: Column, namespace: Column) -> Column:
    """A seed below 2**31 - 1 from the first four bytes of sha256("seed|namespace")."""
    h = F.sha2(F.concat_ws("|", master.cast("string"), namespace), 256)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 2147483647
