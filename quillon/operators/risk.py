"""Credit-risk statistics as aggregations: scorecards, calibration, discrimination, vintages, losses, stress.

`by` columns stand in every group key, so one plan serves the whole table and its segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import ranks as r
from quillon.functions.economics import uniform
from quillon.functions.special import chi2_sf
from quillon.sources.storage import written

ZERO_COUNT = 0.5
FLOOR = 1e-9


def unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    """(keep..., feature, x): one row for each feature, by one pass over df."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    return df.select(*keep, pairs.alias("_p")).select(*[c for c in df.select(*keep).columns], "_p.feature", "_p.x")


# Weight of evidence


def iv_label(iv: Column) -> Column:
    """Strength of an information value; fixed values."""
    return F.when(iv < 0.02, "unpredictive").when(iv < 0.10, "weak").when(iv < 0.30, "medium").when(iv < 0.50, "strong").otherwise("suspicious")


def woe_bins(df: DataFrame, features: Sequence[str], target: str, n_bins: int = 10) -> DataFrame:
    """One row for each feature and bin: lo, hi, n, events, non_events, event_rate, woe, iv. All features in one pass."""
    y = F.col(target).cast("int")
    long = unpivot(df.where(y.isNotNull()), features, [y.alias("y")])
    counts = r.value_counts(long, "x", ["feature"], [F.sum("y").alias("events")])
    edges = r.quantile_edges(counts, r.steps(n_bins), ["feature"]).select("feature", "edges")
    distinct = counts.groupBy("feature").agg(F.count("*").alias("n_values"))
    d = r.joined_by(counts, written(edges.join(distinct, "feature"), "edges"), ["feature"])
    few = F.col("n_values") <= n_bins
    d = d.withColumn("bin", F.when(few, F.lit(None)).otherwise(r.bin_right_closed(F.col("x"), F.col("edges"), n_bins))).withColumn("own", F.when(few, F.col("x")))
    b = d.groupBy("feature", "bin", "own").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("n"), F.sum("events").alias("events"))
    total = Window.partitionBy("feature")
    share = lambda c, t: F.greatest(F.when(c > 0, c).otherwise(ZERO_COUNT), F.lit(0.0)) / F.when(t > 0, t).otherwise(ZERO_COUNT)
    b = b.withColumn("non_events", F.col("n") - F.col("events"))
    event, other = share(F.col("events"), F.sum("events").over(total)), share(F.col("non_events"), F.sum("non_events").over(total))
    b = b.withColumn("_e", event).withColumn("_o", other).withColumn("woe", F.log(F.col("_o") / F.col("_e")))
    return b.select("feature", "lo", "hi", "n", "events", "non_events", (F.col("events") / F.col("n")).alias("event_rate"), "woe", ((F.col("_o") - F.col("_e")) * F.col("woe")).alias("iv"))


def binary_target(df: DataFrame, p: str, key: Sequence[str], out: str = "y", *, seed: int = 42) -> DataFrame:
    """df with one draw, 0 or 1, of each row's probability; the same for the same key and seed. Null probabilities count as 0."""
    return df.withColumn(out, (uniform(*key, F.lit("target"), seed=seed) < F.coalesce(F.col(p).cast("double"), F.lit(0.0))).cast("int"))


def iv_table(bins: DataFrame) -> DataFrame:
    """One row for each feature, best first: total IV, its label, whether event rates are monotone, number of bins."""
    w = Window.partitionBy("feature").orderBy("lo")
    d = bins.withColumn("step", F.col("event_rate") - F.lag("event_rate").over(w))
    monotone = (F.count(F.when(F.col("step") < 0, 1)) == 0) | (F.count(F.when(F.col("step") > 0, 1)) == 0)
    return d.groupBy("feature").agg(F.sum("iv").alias("iv"), monotone.alias("monotone"), F.count("*").alias("n_bins")).withColumn("strength", iv_label(F.col("iv"))).orderBy(F.desc("iv"), "feature")


def _woe_of(x: Column, bins: Column) -> Column:
    holds = F.filter(bins, lambda v: (v["lo"] <= x) & (x <= v["hi"]))
    edge = F.when(x < F.get(bins, F.lit(0))["lo"], F.get(bins, F.lit(0))["woe"]).otherwise(F.element_at(bins, -1)["woe"])
    found = F.when(F.size(holds) > 0, F.get(holds, F.lit(0))["woe"]).otherwise(edge)
    return F.when(x.isNull() | F.isnan(x), None).when(F.size(bins) == 0, 0.0).otherwise(found)


def apply_woe(df: DataFrame, bins: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with <feature>_woe: the bin that holds the value, the first below all, the last for gaps and above; null for no number."""
    row = F.array_sort(F.collect_list(F.struct("lo", "hi", "woe")))
    kept = bins.groupBy().pivot("feature", list(features)).agg(row)
    out = df.join(F.broadcast(kept.select(*[F.col(f).alias(f"_bins_{f}") for f in features])))
    for f in features:
        x, b = F.col(f).cast("double"), F.col(f"_bins_{f}")
        out = out.withColumn(f"{f}_woe", _woe_of(x, b))
    return out.drop(*[f"_bins_{f}" for f in features])


# Calibration


def brier(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.pow(F.col(y) - F.col(p), 2)), F.lit(0.0)).alias("brier"))


def calibration_bins(df: DataFrame, y: str, p: str, by: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """One row for each bin of the score: n, mean score, event rate, sums."""
    counts = r.value_counts(df, p, by, [F.sum(y).alias("events")])
    edges = r.quantile_edges(counts, r.steps(n_bins), by).select(*by, "edges")
    d = r.joined_by(counts, edges, by).withColumn("bin", r.bin_right_closed(F.col("x"), F.col("edges"), n_bins))
    n = F.sum("n")
    return d.groupBy(*by, "bin").agg(n.alias("n"), (F.sum(F.col("x") * F.col("n")) / n).alias("mean_score"), (F.sum("events") / n).alias("event_rate"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("events").alias("observed"), F.sum(F.col("x") * F.col("n")).alias("expected"))


def hosmer_lemeshow(bins: DataFrame, by: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """statistic, df and p_value from calibration_bins."""
    o, e, n = F.col("observed"), F.col("expected"), F.col("n")
    part = F.pow(o - e, 2) / F.greatest(e, F.lit(FLOOR)) + F.pow((n - o) - (n - e), 2) / F.greatest(n - e, F.lit(FLOOR))
    d = bins.groupBy(*by).agg(F.sum(part).alias("statistic"), F.greatest(F.count("*") - 2, F.lit(1)).cast("int").alias("df"))
    p = F.lit(None).cast("double")
    for k in range(1, max(n_bins - 1, 2)):
        p = F.when(F.col("df") == k, chi2_sf(F.col("statistic"), k)).otherwise(p)
    return d.withColumn("p_value", p)


def calibration_summary(df: DataFrame, y: str, p: str, by: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Brier score, expected calibration error, Hosmer-Lemeshow, mean score and event rate; groups of fewer than n_bins rows are left out."""
    bins = calibration_bins(df, y, p, by, n_bins)
    ece = bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("event_rate"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
    whole = df.groupBy(*by).agg(F.avg(F.pow(F.col(y) - F.col(p), 2)).alias("brier"), F.avg(p).alias("mean_score"), F.avg(y).alias("event_rate"))
    # one row per group on either side
    one = lambda d, small: d.join(small, list(by)) if by else d.join(F.broadcast(small))
    out = one(one(whole, ece), hosmer_lemeshow(bins, by, n_bins))
    return out.where(F.col("n") >= n_bins)


# Discrimination


def gini(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC and Gini from average ranks, exact with ties; null where one class is missing."""
    d = r.average_ranks(r.value_counts(df, p, by, [F.sum(y).alias("events")]), by)
    pos, n = F.sum("events"), F.sum("n")
    auc = (F.sum(F.col("events") * F.col("rank")) - pos * (pos + 1) / 2) / F.when((pos > 0) & (pos < n), pos * (n - pos))
    return d.groupBy(*by).agg(auc.alias("auc"), n.alias("n"), pos.alias("n_events")).withColumn("gini", 2 * F.col("auc") - 1)


def ks(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Greatest distance between the classes' distributions over distinct scores, and the (lowest) score where it is reached."""
    counts = r.value_counts(df, p, by, [F.sum(y).alias("events")]).withColumn("others", F.col("n") - F.col("events"))
    d = r.prefix_sum(counts, "x", ["events", "others"], by)
    totals = counts.groupBy(*by).agg(F.sum("events").alias("_e"), F.sum("others").alias("_o"))
    d = r.joined_by(d, written(totals, "totals"), by)
    gap = F.abs(F.col("cum_events") / F.col("_e") - F.col("cum_others") / F.col("_o"))
    d = d.withColumn("gap", F.round(gap, 12))
    return d.groupBy(*by).agg(F.max("gap").alias("ks"), F.max_by(-F.col("x"), F.struct("gap", -F.col("x"))).alias("_t")).withColumn("threshold", -F.col("_t")).drop("_t")


def lorenz(df: DataFrame, y: str, p: str, key: str, n_bins: int = 10) -> DataFrame:
    """Gains by position in descending score (ties by key): shares of rows and events up to each bin, its least score and event rate."""
    # positions: rows before the score's group, then within the group by key
    counts = r.value_counts(df, p, (), [F.sum(y).alias("events")]).withColumn("minus", -F.col("x"))
    starts = r.prefix_sum(counts, "minus", ["n"]).select(F.col("x").alias("_x"), (F.col("cum_n") - F.col("n")).alias("before"), F.col("n").alias("_n"))
    total = counts.agg(F.sum("n").alias("total"), F.sum("events").alias("all_events"))
    # a group of equal scores that lies within one bin needs no order; only those across an edge are ranked
    d = df.withColumn("_x", F.col(p).cast("double")).join(starts, "_x").join(F.broadcast(total))
    at = lambda i: F.greatest(F.ceil(i * n_bins / (F.col("total") - 1)) - 1, F.lit(0))
    split = at(F.col("before").cast("double")) != at((F.col("before") + F.col("_n") - 1).cast("double"))
    whole = d.where(~split).select(at(F.col("before").cast("double")).alias("bin"), F.col(y).alias("y"), F.col("_x").alias("p"))
    nth = F.row_number().over(Window.partitionBy("_x").orderBy(key)) - 1
    apart = d.where(split).withColumn("_i", F.col("before") + nth).select(at(F.col("_i").cast("double")).alias("bin"), F.col(y).alias("y"), F.col("_x").alias("p"))
    b = whole.unionAll(apart).groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("events"), F.min("p").alias("cutoff"))
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole_range = Window.partitionBy(F.lit(1))
    return b.select((F.col("bin") + 1).cast("int").alias("bin"), "n", "events", (F.sum("n").over(run) / F.sum("n").over(whole_range)).alias("cum_population"), (F.sum("events").over(run) / F.greatest(F.sum("events").over(whole_range), F.lit(1))).alias("cum_events"), "cutoff", (F.col("events") / F.col("n")).alias("event_rate"))


def gini_label(g: Column) -> Column:
    """Class of a Gini coefficient; fixed values."""
    return F.when(g >= 0.55, "excellent").when(g >= 0.40, "good (deployable application PD)").when(g >= 0.30, "marginal").otherwise("insufficient for regulator-grade decisioning")


def ks_label(k: Column) -> Column:
    """Class of a Kolmogorov-Smirnov distance; fixed values."""
    return F.when(k >= 0.50, "excellent").when(k >= 0.30, "deployable").otherwise("insufficient")


def discrimination_summary(df: DataFrame, y: str, p: str, key: str, n_bins: int = 10) -> DataFrame:
    top = lorenz(df, y, p, key, n_bins).where("bin = 1").select(F.col("cum_events").alias("top_decile_capture"))
    d = gini(df, y, p).select("auc", "gini", "n", "n_events").join(F.broadcast(ks(df, y, p))).join(F.broadcast(top))
    return d.withColumns({"gini_label": gini_label(F.col("gini")), "ks_label": ks_label(F.col("ks"))})


# Vintages


def cohort(date: Column, freq: str = "M") -> Column:
    quarter = F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))
    return {"M": F.date_format(date, "yyyy-MM"), "Q": quarter, "Y": F.year(date).cast("string")}[freq]


def vintage_curves(df: DataFrame, origination: str, defaulted: str, default_month: str, *, months: int = 24, freq: str = "M") -> DataFrame:
    """Cumulative default rate of each cohort at each month on book."""
    d = df.groupBy(cohort(F.col(origination), freq).alias("cohort"), F.when(F.col(defaulted) == 1, F.greatest(F.col(default_month), F.lit(1))).alias("month")).agg(F.count("*").alias("n"))
    sizes = d.groupBy("cohort").agg(F.sum("n").alias("accounts"))
    spine = sizes.select("cohort", "accounts", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("mob"))
    at = d.where("month is not null").select("cohort", F.col("month").alias("mob"), F.col("n").alias("new"))
    run = Window.partitionBy("cohort").orderBy("mob")
    c = spine.join(at, ["cohort", "mob"], "left").withColumn("defaults", F.coalesce(F.sum("new").over(run), F.lit(0)))
    return c.select("cohort", "mob", "accounts", "defaults", (F.col("defaults") / F.col("accounts")).alias("default_rate"))


def vintage_summary(curves: DataFrame) -> DataFrame:
    """Each cohort's size, final rate, horizon and the first month of the highest rate."""
    return curves.groupBy("cohort").agg(F.first("accounts").alias("accounts"), F.max_by("default_rate", "mob").alias("final_rate"), F.max("mob").alias("horizon"), F.max_by("mob", F.struct("default_rate", -F.col("mob"))).alias("peak_month"))


def vintage_drift(curves: DataFrame, *, threshold: float = 0.5, mob: int = 12) -> DataFrame:
    """Consecutive cohorts whose rates at `mob` differ by at least `threshold` of the older one's; older rates of 0 are skipped."""
    at = curves.where(F.col("mob") == mob)
    w = Window.orderBy("cohort")
    d = at.select(F.lag("cohort").over(w).alias("older"), F.col("cohort").alias("newer"), F.lag("default_rate").over(w).alias("old_rate"), F.col("default_rate").alias("new_rate"))
    change = (F.col("new_rate") - F.col("old_rate")) / F.col("old_rate")
    return d.where("old_rate > 0").withColumn("change", change).where(F.abs("change") >= threshold).select("older", "newer", "change")


# Losses

DRAW_FACTOR, LGD = 0.6, 0.8


def ead(balance: Column, limit: Column, draw: float = DRAW_FACTOR) -> Column:
    return balance + draw * F.greatest(limit - balance, F.lit(0.0))


def loss_columns(df: DataFrame, pd: str, balance: str, limit: str, *, lgd: float | Column = LGD, draw: float = DRAW_FACTOR) -> DataFrame:
    """df with ead, lgd, expected_loss and unexpected_loss."""
    d = df.withColumns({"ead": ead(F.col(balance), F.col(limit), draw), "lgd": lgd if isinstance(lgd, Column) else F.lit(float(lgd))})
    p = F.col(pd)
    return d.withColumns({"expected_loss": p * F.col("lgd") * F.col("ead"), "unexpected_loss": F.col("ead") * F.col("lgd") * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)))})


def portfolio(df: DataFrame, pd: str, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a frame with loss_columns."""
    weight = F.greatest(F.sum("ead"), F.lit(1.0))
    return df.groupBy(*by).agg(F.count("*").alias("accounts"), F.sum("ead").alias("total_ead"), F.sum("expected_loss").alias("expected_loss"), F.sqrt(F.sum(F.pow("unexpected_loss", F.lit(2)))).alias("unexpected_loss"), (F.sum("expected_loss") / weight).alias("loss_rate"), (F.sum(F.col(pd) * F.col("ead")) / weight).alias("weighted_pd"), (F.sum(F.col("lgd") * F.col("ead")) / weight).alias("weighted_lgd"))


#: Stress scenarios: factors, additions, least PD and LGD; fixed values.
SCENARIOS = {
    "baseline": ({}, {}, 0.0, None),
    "adverse": ({"annual_income": 0.90, "utilization": 1.15, "avg_utilization_30d": 1.15}, {"prev_delinquency_count": 1.0}, 0.02, 0.85),
    "severely_adverse": ({"annual_income": 0.80, "utilization": 1.35, "avg_utilization_30d": 1.35, "paydown_rate_30d": 0.60}, {"prev_delinquency_count": 2.0}, 0.05, 0.90),
}


def shocked(df: DataFrame, name: str, scenarios: dict = SCENARIOS) -> DataFrame:
    """df under one scenario: factors first, then additions; columns that df lacks are skipped."""
    factors, additions, _, _ = scenarios[name]
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short")}
    d = df.withColumns({c: F.col(c) * v for c, v in factors.items() if c in numeric})
    return d.withColumns({c: F.col(c) + v for c, v in additions.items() if c in numeric})


def stress(df: DataFrame, score, balance: str, limit: str, *, scenarios: dict = SCENARIOS, draw: float = DRAW_FACTOR, lgd: float = LGD) -> DataFrame:
    """The portfolio under every scenario, in one pass: each row is exploded to its shocked versions.

    score(df) returns df with a column pd.
    """
    every = df.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios])))
    pick = lambda i, c, neutral: F.coalesce(*[F.when(F.col("scenario") == s, F.lit(float(v[i][c]))) for s, v in scenarios.items() if c in v[i]], F.lit(neutral))
    touched = sorted({c for f, a, _, _ in scenarios.values() for c in (*f, *a)} & set(df.columns))
    has = lambda i, c: any(c in v[i] for v in scenarios.values())
    for c in touched:
        x = F.col(c)
        x = x * pick(0, c, 1.0) if has(0, c) else x
        every = every.withColumn(c, x + pick(1, c, 0.0) if has(1, c) else x)
    floor = F.coalesce(*[F.when(F.col("scenario") == s, F.lit(float(v[2]))) for s, v in scenarios.items()])
    own_lgd = F.coalesce(*[F.when(F.col("scenario") == s, F.lit(float(lgd if v[3] is None else v[3]))) for s, v in scenarios.items()])
    d = score(every).withColumn("pd", F.greatest(F.col("pd"), floor))
    return portfolio(loss_columns(d, "pd", balance, limit, lgd=own_lgd, draw=draw), "pd", ["scenario"])


# Survival and reject inference


def person_periods(df: DataFrame, defaulted: str, month: str, horizon: int = 24) -> DataFrame:
    """One row for each month under observation, event = 1 in the month of default."""
    last = F.least(F.when(F.col(defaulted) == 1, F.greatest(F.col(month), F.lit(1))).otherwise(F.lit(horizon)), F.lit(horizon))
    d = df.withColumn("_last", last).withColumn("month", F.explode(F.sequence(F.lit(1), F.col("_last"))))
    return d.withColumn("event", ((F.col("month") == F.col("_last")) & (F.col(defaulted) == 1) & (F.col(month) <= horizon)).cast("int")).drop("_last")


def survival(df: DataFrame, key: str, month: str, hazard: str) -> DataFrame:
    """df with survival and cumulative default after each month; a hazard of 1 ends it."""
    w = Window.partitionBy(key).orderBy(month)
    logs = F.sum(F.when(F.col(hazard) < 1, F.log(1 - F.col(hazard)))).over(w)
    dead = F.max((F.col(hazard) >= 1).cast("int")).over(w)
    s = F.when(dead == 1, 0.0).otherwise(F.exp(F.coalesce(logs, F.lit(0.0))))
    return df.withColumn("survival", s).withColumn("cumulative_default", 1 - F.col("survival"))


def survival_summary(curves: DataFrame, key: str, month: str, hazard: str) -> DataFrame:
    """Expected lifetime in months and the first month of the highest hazard."""
    return curves.groupBy(key).agg(F.sum("survival").alias("expected_lifetime"), F.max_by(month, F.struct(F.col(hazard), -F.col(month))).alias("peak_month"), F.max("cumulative_default").alias("final_default"))


def fuzzy_parcel(accepted: DataFrame, rejected: DataFrame, y: str, p: str, features: Sequence[str]) -> DataFrame:
    """(features, y, weight): accepts as they are, each reject as a default of weight p and a non-default of weight 1 - p."""
    a = accepted.select(*features, F.col(y).cast("int").alias("y"), F.lit(1.0).alias("weight"))
    both = F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col(p).alias("weight")), F.struct(F.lit(0).alias("y"), (1 - F.col(p)).alias("weight"))))
    return a.unionByName(rejected.select(*features, both.alias("_b")).select(*features, "_b.y", "_b.weight"))


def split_population(df: DataFrame, column: str, threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): at or above the threshold, and below it or unknown."""
    ok = F.coalesce(F.col(column) >= threshold, F.lit(False))
    return df.where(ok), df.where(~ok)
