"""Group fairness of binary decisions: rates by group, and the gaps between groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import ranks as r

RATIO_FLOOR, TOLERANCE = 0.8, 0.1


def group_rates(df: DataFrame, y: str, p: str, group: str, *, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """n, positives, selection rate, true and false positive rate and precision of each group; null where a rate has no rows."""
    yes, true = F.col(p) >= threshold, F.col(y) == 1
    n = lambda c: F.count(F.when(c, 1))
    rate = lambda x, t: F.when(t > 0, x / t)
    return df.groupBy(*by, F.col(group).cast("string").alias("grp")).agg(
        F.count("*").alias("n"),
        n(true).alias("n_positive"),
        n(yes).alias("n_selected"),
        (n(yes) / F.count("*")).alias("selection_rate"),
        rate(n(yes & true), n(true)).alias("tpr"),
        rate(n(yes & ~true), n(~true)).alias("fpr"),
        rate(n(yes & true), n(yes)).alias("ppv"),
    )


def parity(rates: DataFrame, *, by: Sequence[str] = (), floor: float = RATIO_FLOOR, tolerance: float = TOLERANCE) -> DataFrame:
    """Ratio of the least to the greatest selection rate (1 if none is selected), gaps of the other rates (null with fewer than two groups), and whether each is in bounds."""
    gap = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c))
    top = F.max("selection_rate")
    d = rates.groupBy(*by).agg(F.count("*").alias("n_groups"), F.when(top == 0, 1.0).otherwise(F.min("selection_rate") / F.when(top > 0, top)).alias("parity_ratio"), gap("tpr").alias("tpr_gap"), gap("fpr").alias("fpr_gap"), gap("ppv").alias("ppv_gap"))
    fine = lambda c: F.col(c).isNull() | (F.col(c) <= tolerance)
    return d.withColumns({"passes_ratio": F.col("parity_ratio") >= floor, "passes_odds": fine("tpr_gap") & fine("fpr_gap"), "passes_precision": fine("ppv_gap")})


def violations(report: DataFrame, dimension: str, floor: float = RATIO_FLOOR, tolerance: float = TOLERANCE) -> DataFrame:
    """A line for each bound that is not kept."""
    line = lambda ok, text, c, bound: F.when(~F.col(ok), F.format_string(f"{dimension}: {text} %.3f beyond {bound}", F.col(c)))
    lines = F.array(
        line("passes_ratio", "parity ratio", "parity_ratio", floor),
        F.when(F.col("tpr_gap") > tolerance, F.format_string(f"{dimension}: true positive gap %.3f beyond {tolerance}", F.col("tpr_gap"))),
        F.when(F.col("fpr_gap") > tolerance, F.format_string(f"{dimension}: false positive gap %.3f beyond {tolerance}", F.col("fpr_gap"))),
        line("passes_precision", "precision gap", "ppv_gap", tolerance),
    )
    return report.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("line"))


def gauges(rates: DataFrame, dimension: str) -> DataFrame:
    """Rates in long form, as gauges: dimension, grp, metric, value."""
    metrics = ("selection_rate", "tpr", "fpr", "ppv")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    return rates.select(F.lit(dimension).alias("dimension"), "grp", pairs.alias("m")).select("dimension", "grp", "m.metric", "m.value").where("value is not null")


def score_buckets(df: DataFrame, column: str, n: int = 5, out: str = "bucket") -> DataFrame:
    """df with its quantile bucket of a score, -1 where there is none."""
    x = F.col(column).cast("double")
    counts = r.value_counts(df, column)
    edges = r.quantile_edges(counts, r.steps(n)).select("edges")
    d = r.joined_by(df, edges, ())
    return d.withColumn(out, F.when(x.isNull() | F.isnan(x), -1).otherwise(r.bin_right_closed(x, F.col("edges"), n))).drop("edges")
