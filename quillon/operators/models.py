"""Models on MLlib: hazards, reject inference, uplift, monotone and segment PD models, separability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import ranks as r
from quillon.functions import special
from quillon.functions.economics import EXPOSURE_CAP, key_hash, profit_treated, uniform
from quillon.operators.risk import unpivot
from quillon.sources.storage import written

#: Direction in which a feature may move the PD; fixed values.
CONSTRAINTS = {"credit_score": -1, "annual_income": -1, "account_tenure_months": -1, "prev_delinquency_count": 1, "utilization": 1, "avg_utilization_30d": 1, "pct_cash_advance_30d": 1, "paydown_rate_30d": -1}


def vectors(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """df with a vector of its features, nulls as 0."""
    clean = df.withColumns({f"_v_{f}": F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=[f"_v_{f}" for f in features], outputCol=out).transform(clean).drop(*[f"_v_{f}" for f in features])


def logistic(df: DataFrame, features: Sequence[str], label: str, *, weight: str | None = None, total: float | None = None):
    """L2-regularised logistic regression of strength 1 over all rows: regParam = 1 / sum of weights."""
    n = total if total is not None else df.agg(F.sum(weight) if weight else F.count("*")).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol="_y", regParam=1.0 / max(n or 1, 1), elasticNetParam=0.0, standardization=False, maxIter=50)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(vectors(df, features).withColumn("_y", F.col(label).cast("double")))


def probability(model, df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    d = model.transform(vectors(df, features))
    return d.withColumn(out, F.element_at(vector_to_array("probability"), 2)).drop("features", "rawPrediction", "probability", "prediction")


def margin(model, df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    d = model.transform(vectors(df, features))
    return d.withColumn(out, F.element_at(vector_to_array("rawPrediction"), 2)).drop("features", "rawPrediction", "probability", "prediction")


def isotonic(df: DataFrame, y: str, p: str):
    return IsotonicRegression(featuresCol="_f", labelCol="_y").fit(df.select(F.col(p).cast("double").alias("_f"), F.col(y).cast("double").alias("_y")))


def apply_isotonic(model, df: DataFrame, p: str, out: str = "calibrated") -> DataFrame:
    d = model.transform(df.withColumn("_f", F.col(p).cast("double")))
    return d.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("_f", "prediction")


def fit_hazard(periods: DataFrame, features: Sequence[str]):
    """Discrete-time hazard: logistic regression on features and month of person-period rows."""
    return logistic(periods, [*features, "month"], "event")


def hazards(model, df: DataFrame, features: Sequence[str], horizon: int = 24) -> DataFrame:
    every = df.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return probability(model, every, [*features, "month"], "hazard")


def heckman(df: DataFrame, accepted: str, y: str, selection: Sequence[str], outcome: Sequence[str]):
    """(selection model, outcome model with the inverse Mills ratio); scores by heckman_scores."""
    first = logistic(df, selection, accepted)
    d = mills(first, df.where(F.col(accepted) == 1), selection)
    return first, logistic(d, [*outcome, "imr"], y)


def mills(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with imr, the normal density over its distribution at the selection model's margin."""
    d = margin(model, df, features, "_z")
    return d.withColumn("imr", special.norm_pdf(F.col("_z")) / F.greatest(special.norm_cdf(F.col("_z")), F.lit(1e-9))).drop("_z")


def heckman_scores(models, df: DataFrame, selection: Sequence[str], outcome: Sequence[str]) -> DataFrame:
    first, second = models
    return probability(second, mills(first, df, selection), [*outcome, "imr"], "pd")


def segment_pd(df: DataFrame, features: Sequence[str], segment: str, label: str):
    """PD with an intercept of its own for each segment: a pipeline model that adds `probability`."""
    n = df.count()
    stages = [OneHotEncoder(inputCols=[segment], outputCols=["_segment"], handleInvalid="keep", dropLast=False), VectorAssembler(inputCols=[*features, "_segment"], outputCol="features"), LogisticRegression(labelCol=label, regParam=1.0 / max(n, 1), standardization=False)]
    return Pipeline(stages=stages).fit(df)


def pd_draws(df: DataFrame, key: str, features: Sequence[str], label: str, *, draws: int = 20, seed: int = 42) -> DataFrame:
    """(draw, intercept, coefficients): refits on Poisson-weighted rows, which stand in for posterior draws."""
    spark, rows = df.sparkSession, []
    base = written(vectors(df, features).select(key, "features", F.col(label).cast("double").alias("_y")), "base")
    n = base.count()
    for b in range(draws):
        u = uniform(key, F.lit(b), seed=seed)
        k = sum((F.when(u > t, 1.0).otherwise(0.0) for t in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015)), F.lit(0.0))
        m = LogisticRegression(labelCol="_y", weightCol="_w", regParam=1.0 / max(n, 1), standardization=False, maxIter=20).fit(base.withColumn("_w", k))
        rows.append((b, float(m.intercept), [float(c) for c in m.coefficients]))
    return spark.createDataFrame(rows, "draw int, intercept double, coefficients array<double>")


def draw_predictions(df: DataFrame, draws: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with `pds`, the PD under each draw, in one pass; there are as many draws as were fitted."""
    every = draws.agg(F.array_sort(F.collect_list(F.struct("draw", "intercept", "coefficients"))).alias("_draws"))
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    d = df.withColumn("_x", x).join(F.broadcast(every))
    pd = F.transform("_draws", lambda w: 1 / (1 + F.exp(-(w["intercept"] + F.aggregate(F.zip_with(w["coefficients"], "_x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))))
    return d.withColumn("pds", pd).drop("_draws", "_x")


def credible_intervals(df: DataFrame, key: str) -> DataFrame:
    """Mean, median, spread and 95 % interval of `pds` for each row."""
    s = F.array_sort("pds")
    at = lambda q: F.element_at(s, F.greatest(F.lit(1), F.ceil(q * F.size("pds"))).cast("int"))
    mean = F.aggregate("pds", F.lit(0.0), lambda a, v: a + v) / F.size("pds")
    spread = F.sqrt(F.aggregate("pds", F.lit(0.0), lambda a, v: a + v * v) / F.size("pds") - F.pow("mean", F.lit(2)) + 1e-18)
    return df.withColumn("mean", mean).select(key, "mean", at(0.5).alias("median"), spread.alias("sd"), at(0.025).alias("low"), at(0.975).alias("high"))


def portfolio_draws(df: DataFrame, ead: str, lgd: float) -> DataFrame:
    """(draw, loss): the portfolio's expected loss under each draw."""
    return df.select(F.posexplode("pds").alias("draw", "pd"), F.col(ead).alias("e")).groupBy("draw").agg(F.sum(F.col("pd") * F.col("e") * lgd).alias("loss"))


def tail_loss(draws: DataFrame, q: float = 0.99) -> DataFrame:
    return draws.agg(F.avg("loss").alias("mean_loss"), F.percentile("loss", q).alias("tail_loss"))


def monotone_pd(df: DataFrame, features: Sequence[str], label: str, constraints: dict[str, int] | None = None):
    """Logistic PD whose coefficients keep the signs of `constraints`."""
    signs = CONSTRAINTS if constraints is None else constraints
    low = [0.0 if signs.get(f, 0) > 0 else float("-inf") for f in features]
    high = [0.0 if signs.get(f, 0) < 0 else float("inf") for f in features]
    lr = LogisticRegression(labelCol="_y", standardization=True, maxIter=50, lowerBoundsOnCoefficients=DenseMatrix(1, len(features), low), upperBoundsOnCoefficients=DenseMatrix(1, len(features), high), lowerBoundsOnIntercepts=DenseVector([float("-inf")]), upperBoundsOnIntercepts=DenseVector([float("inf")]))
    return lr.fit(vectors(df, features).withColumn("_y", F.col(label).cast("double")))


def preconditions(df: DataFrame, target: str, constraints: dict[str, int], *, n_bins: int = 10, least: float = 0.5) -> DataFrame:
    """(feature, n_bins, spearman, status): does the target move with the feature's bins in the direction that is asked for? Features that df lacks are `missing`."""
    have = [f for f in constraints if f in df.columns]
    long = unpivot(df, have, [F.col(target).cast("double").alias("y")])
    counts = r.value_counts(long, "x", ["feature"], [F.sum("y").alias("y"), F.count("y").alias("n_y")])
    edges = r.quantile_edges(counts, r.steps(n_bins), ["feature"]).select("feature", "edges")
    binned = r.joined_by(counts, edges, ["feature"]).withColumn("bin", r.bin_right_closed(F.col("x"), F.col("edges"), n_bins))
    d = binned.groupBy("feature", "bin").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean_x"), F.try_divide(F.sum("y"), F.sum("n_y")).alias("mean_y"))
    rho = r.spearman(d, "mean_x", "mean_y", ["feature"]).join(d.groupBy("feature").agg(F.count("*").alias("n_bins")), "feature")
    sign = F.coalesce(*[F.when(F.col("feature") == f, F.lit(s)) for f, s in constraints.items()])
    own = F.col("spearman") * sign
    status = F.when(F.col("n_bins") < 3, "too_few").when(own >= least, "ok").when(own > 0, "weak").otherwise("wrong")
    out = rho.select("feature", "n_bins", "spearman", status.alias("status"))
    lacking = [f for f in constraints if f not in df.columns]
    if lacking:
        out = out.unionByName(df.sparkSession.createDataFrame([(f, 0, None, "missing") for f in lacking], "feature string, n_bins long, spearman double, status string"))
    return out


def t_learner(df: DataFrame, features: Sequence[str], treatment: str, reward: str, *, reg: float = 0.0, least: int = 10):
    """(model of untreated, model of treated) rewards, None where an arm has fewer than `least` rows."""
    counts = {x[0]: x[1] for x in df.groupBy(treatment).count().collect()}
    if any(counts.get(a, 0) < least for a in (0, 1)):
        return None
    v = vectors(df, features).withColumn("_y", F.col(reward).cast("double"))
    fit = lambda a: LinearRegression(labelCol="_y", regParam=reg).fit(v.where(F.col(treatment) == a))
    return fit(0), fit(1)


def uplift(models, df: DataFrame, features: Sequence[str], out: str = "uplift") -> DataFrame:
    if models is None:
        return df.withColumn(out, F.lit(0.0))
    v = vectors(df, features)
    d = models[0].transform(v).withColumnRenamed("prediction", "_p0")
    d = models[1].transform(d).withColumn(out, F.col("prediction") - F.col("_p0"))
    return d.drop("features", "_p0", "prediction")


def group_split(df: DataFrame, key: str, fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rest, held out): max(1, int(n * fraction)) keys with all their rows are held out."""
    keys = df.select(key).distinct().select(key, key_hash(key, seed=seed).alias("_hash")).withColumn("_bucket", F.shiftright("_hash", 36))
    sizes = sorted((r["_bucket"], r["count"]) for r in keys.groupBy("_bucket").count().collect())
    n = max(1, int(sum(c for _, c in sizes) * fraction))
    # whole buckets of hashes below a threshold; only the one in which the count is reached is put in order
    edge, left = -1, n
    for edge, count in sizes:
        if left <= count:
            break
        left -= count
    out = keys.where(F.col("_bucket") < edge).select(key).unionAll(keys.where(F.col("_bucket") == edge).orderBy("_hash", key).limit(left).select(key))
    return df.join(out, key, "left_anti"), df.join(out, key, "left_semi")


#: The heads of an arm: what each predicts, and of which rows of the arm it learns.
HEADS = (("p_accept", "accepted", None, "logistic"), ("spend", "spend_delta", "accepted", "linear"), ("p_default", "defaulted", "accepted", "logistic"))


def segment_vectors(df: DataFrame, features: Sequence[str], segment: str, segments: Sequence, out: str = "features") -> DataFrame:
    """df with a constant and its features in the block of its segment, zeros elsewhere: one fit of them is a fit of each segment."""
    x = [F.lit(1.0), *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features]]
    columns = {f"_b_{k}_{i}": F.when(F.col(segment) == s, v).otherwise(0.0) for k, s in enumerate(segments) for i, v in enumerate(x)}
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df.withColumns(columns)).drop(*columns)


def arm_heads(v: DataFrame, reg: float) -> dict:
    """For each of HEADS a model on the rows of one arm, or a constant where its label does not vary."""
    found = {}
    for name, label, among, kind in HEADS:
        rows = (v if among is None else v.where(F.col(among) == 1)).withColumn("_y", F.col(label).cast("double"))
        low, high, n = rows.agg(F.min("_y"), F.max("_y"), F.count("*")).first()
        if n == 0 or low == high:
            found[name] = float(low or 0.0)
        elif kind == "logistic":
            found[name] = LogisticRegression(labelCol="_y", regParam=reg / n, fitIntercept=False, standardization=False, maxIter=50).fit(rows)
        else:
            found[name] = LinearRegression(labelCol="_y", regParam=reg / n, fitIntercept=False, standardization=False).fit(rows)
    return found


def arm_profit(heads: dict, v: DataFrame, out: str, exposed: float = EXPOSURE_CAP) -> DataFrame:
    """v with the profit that an arm's heads expect."""
    d = v
    for name, m in heads.items():
        if isinstance(m, float):
            d = d.withColumn(f"_{name}", F.lit(m))
        else:
            logistic_head = hasattr(m, "numClasses")
            d = m.transform(d)
            d = d.withColumn(f"_{name}", F.element_at(vector_to_array("probability"), 2) if logistic_head else F.col("prediction")).drop("prediction", "probability", "rawPrediction")
    d = d.withColumn(out, profit_treated(F.col("_p_accept"), F.col("_spend"), F.col("_p_default"), F.lit(float(exposed))))
    return d.drop(*[f"_{name}" for name in heads])


def train_per_segment(df: DataFrame, key: str, segment: str, features: Sequence[str], treatment: str, truth: str, *, regs: Sequence[float] = (1.0, 100.0), fraction: float = 0.2) -> dict:
    """{segment: (reg, tau, heads of the untreated, heads of the treated)}: T-learners with three heads an arm, and for each segment
    the penalty with the best Kendall tau of uplift and truth on held-out customers. A fit serves all segments at once.

    df has accepted, spend_delta and defaulted. A segment without held-out rows, or whose tau is not defined, has tau 0 like one without rank correlation.
    """
    segments = sorted(x[0] for x in df.where(F.col(segment).isNotNull()).select(segment).distinct().collect())
    train, test = (written(segment_vectors(d, features, segment, segments), "split") for d in group_split(df, key, fraction))
    found: dict = {}
    for reg in regs:
        arms = [arm_heads(train.where(F.col(treatment) == t), reg) for t in (0, 1)]
        d = arm_profit(arms[1], arm_profit(arms[0], test, "_p0"), "_p1")
        scored = written(d.select(segment, (F.col("_p1") - F.col("_p0")).alias("uplift"), truth), "scored")
        for s in segments:
            tau = r.kendall_tau(scored.where(F.col(segment) == s), "uplift", truth).first().tau
            tau = 0.0 if tau is None else tau
            if s not in found or tau > found[s][1]:
                found[s] = (reg, tau, *arms)
    return found


def select_columns(df: DataFrame, *, exclude: Sequence[str] = (), least: float = 0.5) -> list[str]:
    """Numeric columns that are no key, label or as_of mark and are known in at least half the rows; one pass."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short") and f.name not in exclude and not f.name.startswith("as_of")]
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in numeric]).first()
    return [c for c in numeric if (shares[c] or 0) >= least]


def forest(df: DataFrame, features: Sequence[str], label: str, *, trees: int = 50, depth: int = 8, seed: int = 42):
    # a level's work is rows times trees, so small files are dealt to all cores
    rows = vectors(df.select(*features, label), features).select("features", label).repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    return RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def importances(model, features: Sequence[str], spark) -> DataFrame:
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def separability(df: DataFrame, key: str, features: Sequence[str], label: str, *, trees: int = 200, depth: int = 8) -> DataFrame:
    """(segment, auc): one against the rest, by a forest's votes on held-out customers."""
    train, test = group_split(df, key, 0.3)
    scored = forest(train, features, label, trees=trees, depth=depth).transform(vectors(test, features)).withColumn("votes", vector_to_array("probability"))
    d = scored.select(F.col(label).cast("int").alias("own"), F.posexplode("votes").alias("segment", "p")).withColumn("y", (F.col("own") == F.col("segment")).cast("int"))
    from quillon.operators.risk import gini

    return gini(d, "y", "p", ["segment"]).select("segment", "auc")


def separability_verdict(aucs: DataFrame, least: float = 0.85) -> DataFrame:
    """The gate's row: the mean AUC over segments, and whether it is above `least`."""
    d = aucs.agg(F.avg("auc").alias("value"), F.count("auc").alias("_n"))
    return d.select(F.lit("segment_separability").alias("criterion"), F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce(F.col("value") > least, F.lit(False)).alias("passed"), F.format_string("mean one-against-rest AUC of %d segments", "_n").alias("note"))
