"""The whole evaluation of a PD model on a holdout, as far as its columns allow."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.carry import running
from quillon.operators import drift, fairness, models, risk


def full_evaluation(df: DataFrame, *, y: str, p: str, key: str, balance: str | None = None, limit: str | None = None, score: Callable | None = None, origination: str | None = None, default_month: str | None = None, group: str | None = None, group_threshold: float = 0.5, reference: DataFrame | None = None, current: DataFrame | None = None, features: Sequence[str] = (), constraints: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Result tables by name; parts whose columns are not given are left out. current: what the reference is compared with, df if it is None."""
    out = {"calibration": risk.calibration_summary(df, y, p), "calibration_bins": risk.calibration_bins(df, y, p), "discrimination": risk.discrimination_summary(df, y, p, key), "gains": risk.lorenz(df, y, p, key)}
    if balance and limit:
        out["loss"] = risk.portfolio(risk.loss_columns(df, p, balance, limit), p)
        if score:
            out["stress"] = risk.stress(df, score, balance, limit)
    if origination and default_month:
        curves = risk.vintage_curves(df, origination, y, default_month)
        out |= {"vintage": curves, "vintage_summary": risk.vintage_summary(curves), "vintage_drift": risk.vintage_drift(curves)}
    if features:
        out["information_value"] = risk.iv_table(risk.woe_bins(df, features, y))
        out["monotonicity"] = models.preconditions(df, y, constraints if constraints is not None else {f: 1 for f in features})
    if reference is not None and features:
        out["csi"] = drift.csi(reference, df if current is None else current, features)
    if group:
        rates = fairness.group_rates(df, y, p, group, threshold=group_threshold)
        out |= {"fairness_rates": rates, "fairness": fairness.parity(rates)}
    return out


#: What names a row in the parts that have several.
ITEMS = {"calibration": None, "discrimination": None, "loss": None, "fairness": None, "gains": "bin", "calibration_bins": "bin", "stress": "scenario", "vintage_drift": "newer", "information_value": "feature", "monotonicity": "feature", "csi": "feature", "fairness_rates": "grp"}


def headline(tables: dict[str, DataFrame]) -> DataFrame:
    """(part, item, metric, value): every numeric column of the parts, in long form; item is null in parts of one row."""
    parts = []
    for name, item in ITEMS.items():
        if name in tables:
            d = tables[name]
            numeric = [f.name for f in d.schema.fields if f.dataType.typeName() in ("double", "long", "integer") and f.name != item]
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric]))
            own = F.col(item).cast("string") if item else F.lit(None).cast("string")
            parts.append(d.select(F.lit(name).alias("part"), own.alias("item"), pairs.alias("m")).select("part", "item", "m.metric", "m.value"))
    return reduce(DataFrame.unionByName, parts)


def best_so_far(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with the greatest value up to each row of its group."""
    return running(df, by, order, most={"best": value})


def by_pattern(df: DataFrame, include: str, exclude: str | None = None) -> list[str]:
    """Names of columns that match one pattern and not the other."""
    import re

    return [c for c in df.columns if re.search(include, c) and not (exclude and re.search(exclude, c))]
