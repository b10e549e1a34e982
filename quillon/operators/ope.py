"""Off-policy evaluation from logged decisions: each estimator is one aggregation.

Intervals come from a Poisson bootstrap: every row has a Poisson(1) weight in each resample, drawn
from a hash of its key. Tasks add up their rows' weighted sums for all resamples, so the shuffle
carries resamples, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weight(action: str, propensity: str, new_action: str, new_propensity: str | None = None) -> Column:
    """Importance weight, 0 where the logged propensity is not positive."""
    w = F.when((F.col(propensity) > 0) & (F.col(action) == F.col(new_action)), 1.0 / F.when(F.col(propensity) > 0, F.col(propensity))).otherwise(0.0)
    return w * F.col(new_propensity) if new_propensity else w


def terms(df: DataFrame, *, action: str, propensity: str, reward: str, new_action: str, new_propensity: str | None = None, mu_new: str | None = None, mu_logged: str | None = None) -> DataFrame:
    """df with w (weight), wr (weighted reward) and, with an outcome model, dr."""
    d = df.withColumn("w", weight(action, propensity, new_action, new_propensity)).withColumn("wr", F.col("w") * F.col(reward))
    return d.withColumn("dr", F.col(mu_new) + F.col("w") * (F.col(reward) - F.col(mu_logged))) if mu_new else d


def estimates(t: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, estimator, estimate, n_logged) of ips, snips and, if there, dr."""
    some = F.sum("w") != 0
    found = [("ips", F.avg("wr")), ("snips", F.when(some, F.sum("wr") / F.when(some, F.sum("w"))).otherwise(0.0))]
    if "dr" in t.columns:
        found.append(("dr", F.avg("dr")))
    d = t.groupBy(*by).agg(F.count("*").alias("n_logged"), *[x.alias(n) for n, x in found])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("estimator"), F.coalesce(F.col(n), F.lit(0.0)).alias("estimate")) for n, _ in found]))
    return d.select(*by, "n_logged", pairs.alias("e")).select(*by, "e.estimator", "e.estimate", "n_logged")


def bootstrap(t: DataFrame, key: str, *, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """(estimator, ci_low_95, ci_high_95) by Poisson resampling of the rows of terms()."""
    columns = ["w", "wr"] + (["dr"] if "dr" in t.columns else [])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_boot, len(columns) + 1))
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            x = np.stack([np.ones(len(h)), *(batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns)))], 1)
            for at in range(0, len(h), 4096):
                own, part = h[at : at + 4096], x[at : at + 4096]
                z = own[:, None] + np.arange(n_boot, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
                total += np.searchsorted(_POISSON, u.reshape(-1), side="right").reshape(u.shape).T.astype(float) @ part
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot), pa.int64()), *(pa.array(total[:, i]) for i in range(total.shape[1]))], ["b", "n", *columns])

    hashed = t.select(F.xxhash64(key, F.lit(seed)).alias("h"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    d = hashed.mapInArrow(sums, "b long, n double, " + ", ".join(f"{c} double" for c in columns)).groupBy("b").agg(*[F.sum(c).alias(c) for c in ("n", *columns)])
    n = F.when(F.col("n") > 0, F.col("n"))
    made = [("ips", F.col("wr") / n), ("snips", F.when(F.col("w") != 0, F.col("wr") / F.when(F.col("w") != 0, F.col("w"))).otherwise(0.0))] + ([("dr", F.col("dr") / n)] if "dr" in columns else [])
    pairs = F.explode(F.array(*[F.struct(F.lit(e).alias("estimator"), F.coalesce(x, F.lit(0.0)).alias("v")) for e, x in made]))
    return d.select(pairs.alias("p")).groupBy(F.col("p.estimator").alias("estimator")).agg(F.percentile("p.v", 0.025).alias("ci_low_95"), F.percentile("p.v", 0.975).alias("ci_high_95"))


_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(16)])


def suite(df: DataFrame, key: str, *, n_boot: int = 1000, seed: int = 42, **columns) -> DataFrame:
    """All estimators with their intervals."""
    t = terms(df, **columns)
    return estimates(t).join(F.broadcast(bootstrap(t, key, n_boot=n_boot, seed=seed)), "estimator")


def promotion(rows: DataFrame, least: int = 2) -> DataFrame:
    """Is a challenger fit for promotion: at least `least` estimators whose interval lies above 0."""
    return rows.agg(F.count(F.when(F.col("ci_low_95") > 0, 1)).alias("n_positive"), F.count("*").alias("n_estimators")).withColumn("promote", F.col("n_positive") >= least)
