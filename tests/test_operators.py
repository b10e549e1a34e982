"""Exact values and properties of single operators."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import economics as e
from quillon.functions import carry, ranks, special
from quillon.operators import asof, dashboards, decide, drift, evaluate, fairness, gate, models, ope, risk
from quillon.sources import events, registry, storage
from quillon.streaming import features as live


def one(df):
    return df.first()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_effective_probabilities(spark):
    d = frame(spark, [(0.5, 0.5, 0.04), (0.9, 0.5, 0.04), (0.5, 0.0, 0.04), (0.5, 0.5, 0.99), (None, None, 0.04)], "u double, r double, p double")
    got = [x[0] for x in d.select(F.round(e.effective_p_default(F.col("p"), F.col("u"), F.col("r")), 9)).collect()]
    assert got == [0.04, 0.10, 0.09, 0.60, 0.04]
    a = frame(spark, [(0.3, 0.5, 0.0)], "p double, u double, v double")
    assert one(a.select(e.effective_p_accept(F.col("p"), F.col("u"), F.col("v"))))[0] == pytest.approx(0.3)


def test_choice(spark):
    d = frame(spark, [(0.9, 500.0, 0.001, 0.0), (0.0, 0.0, 0.0, 0.95), (0.0, 0.0, 0.0, 0.0)], "pa double, ds double, pd double, fraud double")
    d = d.withColumn("offer", e.profit_treated(F.col("pa"), F.col("ds"), F.col("pd"), F.lit(5000.0))).withColumn("f", e.profit_fraud_check(F.col("fraud")))
    rows = decide.choose(d, "offer", "f").collect()
    assert [r.action_name for r in rows] == ["OFFER_CLI", "FRAUD_CHECK", "NOTHING"]
    assert all(0 < r.propensity <= 1 for r in rows)


def test_ips_of_the_logged_policy(spark):
    d = frame(spark, [(i, i % 3, 1 / 3, float(i), i % 3, (i + 1) % 3) for i in range(30)], "id int, a int, p double, r double, same int, other int")
    t = ope.terms(d, action="a", propensity="p", reward="r", new_action="same")
    got = {r.estimator: r.estimate for r in ope.estimates(t).collect()}
    assert got["ips"] == pytest.approx(3 * 14.5) and got["snips"] == pytest.approx(14.5)
    t = ope.terms(d, action="a", propensity="p", reward="r", new_action="other")
    assert {r.estimate for r in ope.estimates(t).collect()} == {0.0}


@pytest.mark.parametrize("hot", ["month", "timestamp"])
def test_hot_customers_are_cut(spark, hot):
    """One customer with nine tenths of all rows, in one month or at one moment: no piece holds more than a few times its share."""
    rng = random.Random(hot)
    when = lambda: "2024-03-05 10:00:00" if hot == "timestamp" else f"2024-03-{rng.randrange(1, 28):02d} 10:{rng.randrange(60):02d}:00"
    rows = [(1, when(), i, rng.choice([None, i])) if i % 10 else (rng.randrange(2, 9), f"2024-0{rng.randrange(1, 7)}-01 00:00:00", i, i) for i in range(2000)]
    d = frame(spark, rows, "k int, t string, i int, v int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    order = ["k", "t", "i"]
    sizes = [r["count"] for r in carry._cut(d, carry.cuts(d, order, 16), 1, order, 16).groupBy("_piece").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 4 * 2000 / 16
    jobs = spark.sparkContext.statusTracker()
    group = f"plan of {hot}"
    spark.sparkContext.setJobGroup(group, group)
    got = carry.running(d, ["k"], ["t", "i"], last={"seen": "v"}, sums={"total": "v"}, most={"best": "v"}, own=False, pieces=16)
    assert not jobs.getJobIdsForGroup(group), "no job before the result is asked for"
    spark.sparkContext.setJobGroup("rest", "rest")
    want, state = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen, total, best = state.get(k, (None, 0, None))
        want[i] = (seen, total, best)
        if v is not None:
            state[k] = (v, total + v, v if best is None else max(best, v))
    assert {r.i: (r.seen, r.total, r.best) for r in got.collect()} == want


@pytest.mark.parametrize("parts", [1, 7])
def test_bootstrap_holds_the_estimate(spark, parts):
    d = frame(spark, [(i, i % 3, 1 / 3, float(i % 7), i % 2) for i in range(600)], "id int, a int, p double, r double, n int").repartition(parts)
    rows = ope.suite(d, "id", n_boot=200, action="a", propensity="p", reward="r", new_action="n").collect()
    assert all(r.ci_low_95 <= r.estimate <= r.ci_high_95 for r in rows)


def test_gini(spark):
    up = [(0, 0.1), (0, 0.2), (0, 0.3), (1, 0.7), (1, 0.8), (1, 0.9)]
    assert one(risk.gini(frame(spark, up, "y int, p double"), "y", "p")).gini == 1.0
    assert one(risk.gini(frame(spark, [(1 - y, p) for y, p in up], "y int, p double"), "y", "p")).gini == -1.0
    assert one(risk.gini(frame(spark, [(1, p) for _, p in up], "y int, p double"), "y", "p")).gini is None
    ks = one(risk.ks(frame(spark, [(0, x) for x in (0.1, 0.2, 0.3, 0.4)] + [(1, x) for x in (0.6, 0.7, 0.8, 0.9)], "y int, p double"), "y", "p"))
    assert ks.ks == 1.0 and ks.threshold == 0.4


def test_brier_and_calibration(spark):
    d = frame(spark, [(1, 1.0), (0, 0.0)], "y int, p double")
    assert one(risk.brier(d, "y", "p")).brier == 0.0
    assert one(risk.brier(d.withColumn("p", 1 - F.col("p")), "y", "p")).brier == 1.0
    rng = random.Random(3)
    rows = [(int(rng.random() < p), p) for p in (rng.random() for _ in range(2000))]
    hl = one(risk.hosmer_lemeshow(risk.calibration_bins(frame(spark, rows, "y int, p double"), "y", "p")))
    assert hl.df == 8 and hl.p_value > 0.01


def test_vintage_curve(spark):
    months = [6] * 5 + [12] * 10 + [18] * 3
    rows = [("2026-01-05", int(i < len(months)), months[i] if i < len(months) else 0) for i in range(100)]
    c = risk.vintage_curves(frame(spark, rows, "d string, y int, m int").withColumn("d", F.col("d").cast("date")), "d", "y", "m")
    got = {r.mob: r.defaults for r in c.collect()}
    assert len(got) == 24 and got[5] == 0 and got[6] == 5 and got[18] == 18 and got[24] == 18
    rows = [("2026-01-05", int(i < 4), 6 if i < 2 else 12) for i in range(200)] + [("2026-02-05", int(i < 20), 6 if i < 10 else 12) for i in range(200)]
    c = risk.vintage_curves(frame(spark, rows, "d string, y int, m int").withColumn("d", F.col("d").cast("date")), "d", "y", "m")
    (flag,) = risk.vintage_drift(c).collect()
    assert (flag.older, flag.newer) == ("2026-01", "2026-02") and flag.change == pytest.approx(4.0)


def test_losses(spark):
    d = risk.loss_columns(frame(spark, [(0.10, 500.0, 1000.0)], "pd double, b double, l double"), "pd", "b", "l")
    assert one(d).ead == 800 and one(d).expected_loss == pytest.approx(64)
    p = frame(spark, [(0.1, 1000.0), (0.2, 4000.0)], "pd double, ead double").withColumn("lgd", F.lit(0.8))
    p = p.withColumn("expected_loss", F.col("pd") * 0.8 * F.col("ead")).withColumn("unexpected_loss", F.col("ead") * 0.8 * F.sqrt(F.col("pd") * (1 - F.col("pd"))))
    s = one(risk.portfolio(p, "pd"))
    assert (s.total_ead, round(s.expected_loss, 6), round(s.weighted_pd, 6), round(s.loss_rate, 6)) == (5000, 720, 0.18, 0.144)


def test_scenarios(spark):
    d = frame(spark, [("a", 100.0)], "id string, annual_income double")
    assert risk.shocked(d, "baseline").collect() == d.collect()
    assert one(risk.shocked(d, "adverse")).annual_income == 90.0


def test_fuzzy_parcel(spark):
    yes = frame(spark, [(float(i), i % 2) for i in range(10)], "x double, y int")
    no = frame(spark, [(float(i), p) for i, p in enumerate((0.1, 0.2, 0.5, 0.8, 0.9))], "x double, p double")
    rows = risk.fuzzy_parcel(yes, no, "y", "p", ["x"]).collect()
    assert len(rows) == 20 and sum(r.weight for r in rows) == pytest.approx(15)


def test_woe(spark):
    rows = [(float(v), y) for v, y in zip((1, 2, 3, 4, 5) * 50, (0, 0, 1, 1, 1) * 50, strict=True)]
    d = frame(spark, rows, "x double, y int")
    bins = risk.woe_bins(d, ["x"], "y")
    ordered = bins.orderBy("lo").collect()
    assert len(ordered) == 5 and one(risk.iv_table(bins)).iv > 0.5
    got = risk.apply_woe(frame(spark, [(-10.0,), (99.0,), (None,), (float("nan"),)], "x double"), bins, ["x"]).collect()
    assert [r.x_woe for r in got] == [ordered[0].woe, ordered[-1].woe, None, None]
    labels = frame(spark, [(v,) for v in (0.019, 0.02, 0.099, 0.10, 0.29, 0.30, 0.49, 0.50)], "iv double").select(risk.iv_label(F.col("iv"))).collect()
    assert [r[0] for r in labels] == ["unpredictive", "weak", "weak", "medium", "medium", "strong", "strong", "suspicious"]


def test_survival(spark):
    d = frame(spark, [("a", 1, 0.5), ("a", 2, 1.0), ("a", 3, 0.5)], "id string, month int, h double")
    got = [r.survival for r in risk.survival(d, "id", "month", "h").orderBy("month").collect()]
    assert got == [0.5, 0.0, 0.0]


def test_fairness(spark):
    rows = [(1, 1.0 if i < 8 else 0.0) for i in range(10)] + [(0, 1.0 if i < 2 else 0.0) for i in range(10)]
    r = one(fairness.group_rates(frame(spark, [(*x, "g") for x in rows], "y int, p double, g string"), "y", "p", "g"))
    assert (r.tpr, r.fpr, r.ppv, r.selection_rate) == (0.8, 0.2, 0.8, 0.5)
    two = frame(spark, [(1, float(i < 50), "a") for i in range(100)] + [(1, float(i < 40), "b") for i in range(100)], "y int, p double, g string")
    p = one(fairness.parity(fairness.group_rates(two, "y", "p", "g")))
    assert p.parity_ratio == pytest.approx(0.8) and p.passes_ratio
    buckets = fairness.score_buckets(frame(spark, [(float(i),) for i in range(10)] + [(None,)], "s double"), "s").collect()
    assert buckets[-1].bucket == -1 and {b.bucket for b in buckets} == {-1, 0, 1, 2, 3, 4}


def test_drift(spark):
    rng = random.Random(1)
    base = frame(spark, [(rng.gauss(0, 1), i % 2) for i in range(1000)], "x double, segment_id int")
    same = frame(spark, [(rng.gauss(0, 1), i % 2) for i in range(1000)], "x double, segment_id int")
    moved = frame(spark, [(rng.gauss(3 if i % 2 else 0, 1), i % 2) for i in range(1000)], "x double, segment_id int")
    assert one(drift.psi(base, same, ["x"])).statistic < 0.2
    assert one(drift.psi(base, moved, ["x"])).is_drifting and one(drift.ks(base, moved, ["x"])).is_drifting and one(drift.js(base, moved, ["x"])).is_drifting
    assert {r.feature: r.is_drifting for r in drift.psi(base, moved, ["x"], by=["segment_id"]).collect()} == {"x@segment_0": False, "x@segment_1": True}
    assert one(drift.csi(base, same, ["x", "absent"])).classification == "stable"
    empty = base.where("false")
    assert drift.psi(empty, same, ["x"]).collect() == []
    labels = frame(spark, [(v,) for v in (0.0, 0.05, 0.10, 0.20, 0.25, 1.5)], "v double").select(drift.csi_label(F.col("v"))).collect()
    assert [r[0] for r in labels] == ["stable"] * 2 + ["minor_shift"] * 2 + ["major_shift"] * 2


def test_adwin(spark):
    d = frame(spark, [("a", i, 0.0 if i < 60 else 1.0) for i in range(120)] + [("b", i, 0.5) for i in range(120)], "k string, i int, v double")
    found = drift.adwin(d, "k", ["i"], "v").collect()
    assert found and {r.k for r in found} == {"a"} and found[0].mean_after > found[0].mean_before


def test_rollback(spark):
    def log(base, now):
        rows = []
        for i in range(210):
            rows.append((i, i, *base))
        for i in range(210, 410):
            rows.append((i, i, *now))
        return frame(spark, rows, "decision_id int, s int, latency_ms double, reward double, is_error boolean").withColumn("ts", F.timestamp_seconds("s"))

    assert not one(dashboards.rollback(log((50.0, 100.0, False), (55.0, 95.0, False)))).rollback
    assert one(dashboards.rollback(log((50.0, 100.0, False), (65.0, 100.0, False)))).reason == "p99"
    assert one(dashboards.rollback(log((50.0, 100.0, False), (50.0, 85.0, False)))).reason == "profit"
    assert one(dashboards.rollback(log((50.0, 100.0, False), (50.0, 100.0, True)))).reason == "error_rate"
    assert not one(dashboards.rollback(log((50.0, 100.0, False), (60.0, 90.0, False)))).rollback
    assert not one(dashboards.rollback(log((0.0, 0.0, False), (60.0, 0.0, False)))).rollback


def test_point_in_time(spark):
    base = frame(spark, [(1, 10), (1, 20), (2, 5)], "k int, t int")
    right = frame(spark, [(1, 9, "a"), (1, 20, "b"), (2, 6, "c")], "k int, u int, v string")
    got = {(r.k, r.t): (r.v, r.as_of_x) for r in asof.asof_join(base, right, by="k", left_on="t", right_on="u", freshness="as_of_x").collect()}
    assert got == {(1, 10): ("a", 9), (1, 20): ("b", 20), (2, 5): (None, None)}
    asof.assert_point_in_time(frame(spark, [(1, 5, 4)], "customer_id int, as_of int, as_of_x int"))
    with pytest.raises(ValueError, match="future"):
        asof.assert_point_in_time(frame(spark, [(1, 5, 6)], "customer_id int, as_of int, as_of_x int"))


@pytest.mark.parametrize("pieces", [2, 70, None])
def test_last_known_across_months(spark, pieces):
    rng = random.Random(11)
    rows = [(rng.choice([1, 2, None]), f"2024-{rng.randrange(1, 7):02d}-{rng.randrange(1, 28):02d} 10:00:00", i, rng.choice([None, i])) for i in range(300)]
    d = frame(spark, rows, "k int, t string, i int, v int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    for own in (True, False):
        got = {r.i: r.seen for r in carry.running(d, ["k"], ["t", "i"], last={"seen": "v"}, own=own, pieces=pieces).collect()}
        seen, want = {}, {}
        for k, _, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
            if own and v is not None:
                seen[k] = v
            want[i] = seen.get(k)
            if v is not None:
                seen[k] = v
        assert got == want


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_ranks_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(5)
    rows = [(rng.choice([None, float("nan"), *[float(i) for i in range(40)]]), rng.random()) for _ in range(500)]
    d = frame(spark, rows, "x double, y double").repartition(parts)
    values = sorted(x for x, _ in rows if x is not None and not math.isnan(x))
    edges = one(ranks.quantile_edges(ranks.value_counts(d, "x"), ranks.steps(10))).edges
    n = len(values)
    expected = sorted({values[int(q * (n - 1))] + (values[min(n - 1, int(q * (n - 1)) + 1)] - values[int(q * (n - 1))]) * (q * (n - 1) % 1) for q in ranks.steps(10)})
    assert edges == pytest.approx(expected)
    t = one(ranks.kendall_tau(d.where("not isnan(x)"), "x", "y"))
    pairs = [(x, y) for x, y in rows if x is not None and not math.isnan(x)]
    sign = [((a[0] > b[0]) - (a[0] < b[0])) * ((a[1] > b[1]) - (a[1] < b[1])) for i, a in enumerate(pairs) for b in pairs[i + 1 :]]
    assert t.concordant == sum(s > 0 for s in sign) and t.discordant == sum(s < 0 for s in sign)


def brute_tau(pairs):
    sign = [((a[0] > b[0]) - (a[0] < b[0])) * ((a[1] > b[1]) - (a[1] < b[1])) for i, a in enumerate(pairs) for b in pairs[i + 1 :]]
    return sum(x > 0 for x in sign), sum(x < 0 for x in sign)


@pytest.mark.parametrize("largest", [7, 50, 10**6])
def test_kendall_tau_in_buckets(spark, largest):
    rng = random.Random(largest)
    pairs = [(float(rng.randrange(90)), float(rng.randrange(-40, 40))) for _ in range(400)] + [(1e18, -1e18), (-1e18, 1e18)]
    t = one(ranks.kendall_tau(frame(spark, [*pairs, (None, 1.0)], "x double, y double"), "x", "y", largest))
    assert (t.n, t.concordant, t.discordant) == (402, *brute_tau(pairs))
    assert one(ranks.kendall_tau(frame(spark, [], "x double, y double"), "x", "y")).n == 0
    assert one(ranks.kendall_tau(frame(spark, [(1.0, 2.0)] * 5, "x double, y double"), "x", "y")).tau is None


def test_pairs_beyond_32_digits_count(spark):
    """Points whose ranks would need more than 32 binary digits to tell apart are weighed by their counts."""
    n = 3_000_000_000
    more, less = ranks._ordered_pairs(np.array([0.0, 1.0, 2.0]), np.array([0.0, 2.0, 1.0]), np.array([n, n, n]))
    assert (more, less) == (2 * n * n, n * n)


@pytest.mark.parametrize("pieces", [2, 40, None])
def test_running_sums_in_buckets(spark, pieces):
    rng = random.Random(3)
    rows = [(g, float(x), rng.randrange(9)) for g, size in (("a", 300), ("b", 20), ("c", 1)) for x in rng.sample(range(1000), size)]
    got = {(r.g, r.x): r.cum_n for r in ranks.prefix_sum(frame(spark, rows, "g string, x double, n long"), "x", ["n"], ["g"], pieces).collect()}
    assert got == {(g, x): sum(m for h, y, m in rows if h == g and y <= x) for g, x, _ in rows}


def test_special_functions(spark):
    d = frame(spark, [(0.0,), (1.96,), (-1.0,)], "x double")
    got = [r[0] for r in d.select(special.norm_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.5, 0.9750021, 0.1586553], abs=1e-6)
    c = frame(spark, [(3.84,)], "x double").select(special.chi2_sf(F.col("x"), 1), special.chi2_sf(F.col("x"), 2)).first()
    assert c[0] == pytest.approx(0.05004, abs=1e-4) and c[1] == pytest.approx(math.exp(-1.92))


def test_registry_and_backfill(spark, tmp_path):
    reg = registry.empty(spark)
    row = lambda v: frame(spark, [("f", v, "SELECT 1", "me", "")], registry.SCHEMA)
    reg = registry.register(registry.register(reg, row(1)), row(3))
    assert one(registry.latest(reg)).version == 3 and registry.versions(reg, "f").count() == 2
    with pytest.raises(ValueError, match="not above"):
        registry.register(reg, row(2))


def test_upsert(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    storage.upsert(frame(spark, [(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    storage.upsert(frame(spark, [(2, "c"), (3, "d")], "k int, v string"), path, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_lenient_decode(spark):
    d = frame(spark, [('{"decision_id":"1","customer_id":"c","timestamp_ms":5,"action":"NOTHING"}',), ('{"decision_id":"1"}',), ("no json",)], "value string")
    (r,) = decide.decode_decisions(d).collect()
    assert (r.alias, r.segment_id, r.current_utilization) == ("champion", 0, 0.5)


def test_quality_rules(spark):
    good = {"amount": 5.0, "segment_id": 1, "credit_limit": 10.0, "current_balance": 1.0, "geo_lat": 0.0, "geo_lon": 0.0, "event_time": 1, "credit_score": 700, "annual_income": 1.0, "account_tenure_months": 3, "n_products": 1, "prev_delinquency_count": 0}
    d = frame(spark, [tuple(good.values()), tuple({**good, "amount": -1.0, "credit_score": None}.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in good.items()))
    c = events.check(d)
    assert events.valid(c).count() == 1 and set(one(events.quarantine(c)).violations) == {"amount", "credit_score"}


def test_canary_only_grows(spark):
    d = spark.range(2000)
    small, large = ({r.id for r in d.where(e.in_canary(F.col("id"), f)).collect()} for f in (0.1, 0.3))
    assert small < large and 100 < len(small) < 300


def test_monotone_model_keeps_signs(spark):
    rng = random.Random(2)
    rows = [(x := rng.random(), rng.random(), int(rng.random() < 0.2 + 0.5 * x)) for _ in range(500)]
    m = models.monotone_pd(frame(spark, rows, "a double, b double, y int"), ["a", "b"], "y", {"a": 1, "b": -1})
    assert m.coefficients[0] >= 0 >= m.coefficients[1]


def test_group_split_orders_few_keys(spark):
    d = spark.range(20000).select(F.col("id").alias("k"))
    rest, held = models.group_split(d, "k", 0.25)
    least = [r.k for r in d.orderBy(e.key_hash("k"), "k").limit(5000).collect()]
    assert {r.k for r in held.collect()} == set(least) and rest.count() == 15000
    limits = [int(x) for x in re.findall(r"(?:GlobalLimit|TakeOrderedAndProject\(limit=) ?(\d+)", held._jdf.queryExecution().toString())]
    assert limits and max(limits) < 100


def test_group_split(spark):
    d = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    rest, held = models.group_split(d, "k", 0.2)
    a, b = ({r.k for r in x.select("k").distinct().collect()} for x in (rest, held))
    assert not a & b and len(b) == 10 and rest.count() + held.count() == 1000


def test_gate_raises(spark):
    d = frame(spark, [("x", 0.1, False, "n")], "criterion string, value double, passed boolean, note string")
    with pytest.raises(ValueError, match="x = 0.1"):
        gate.assert_passes(d)


def test_reasons(spark):
    d = frame(spark, [(1, 0.9, 3.0)], "id int, utilization double, other double")
    score = lambda x: x.withColumn("profit", -10 * F.col("utilization") - F.col("other"))
    rows = decide.reasons(d, "id", ["utilization", "other"], score, {"utilization": 0.1, "other": 1.0}).orderBy("rank").collect()
    assert [r.feature for r in rows] == ["utilization", "other"] and rows[0].attribution == pytest.approx(-8)
    assert rows[0].description == "High credit utilization ratio"


def test_sentiment(spark):
    d = frame(spark, [(0, None), (1, 1), (1, -1), (0, 1)], "a int, b int")
    assert one(decide.sentiment_agreement(d, "a", "b")).agreement == 0.5


def test_sentiment_rows(spark):
    d = frame(spark, [("n1", [("btc", 1), ("eth", -1)]), ("n2", [])], "item string, scores array<struct<coin:string,score:int>>")
    assert [tuple(r) for r in decide.sentiment_rows(d).collect()] == [("n1", "btc", 1), ("n1", "eth", -1)]


def test_feature_hash(spark):
    d = frame(spark, [(0.5, 650, None), (1 / 3, 1234567, 1e-7)], "a double, b int, c double")
    got = [r[0] for r in d.select(decide.feature_hash("a", "b", "c")).collect()]
    assert got == [hashlib.blake2b(x, digest_size=16).hexdigest() for x in (b"0.5,650,0", b"0.333333,1.23457e+06,1e-07")]


def test_notices(spark):
    flags = "struct<adverse_action_eligible:boolean>"
    rows = [(1, "c", None, (True,), 0.9, 1.0), (2, "c", "challenger", (False,), 0.9, 1.0), (3, "d", "challenger", (True,), 0.1, 0.0), (4, "e", None, None, 0.9, 1.0)]
    d = frame(spark, rows, f"decision_id int, customer_id string, acted_on_alias string, regulatory_flags {flags}, utilization double, odd double")
    score = lambda x: x.withColumn("profit", -10 * F.col("utilization") - F.col("odd"))
    assert {r.decision_id for r in decide.denials(d).collect()} == {1, 3}
    got = {r.decision_id: (r.acted_on_alias, r.reason_codes) for r in decide.notices(d, ["utilization", "odd"], score, {"utilization": 0.1, "odd": 0.0}).collect()}
    assert got == {1: ("champion", ["R005: High credit utilization ratio", decide.OTHER_CODE]), 3: ("challenger", [])}
    assert len(decide.REASON_CODES) == 22 and sorted(v[:4] for v in decide.REASON_CODES.values()) == [f"R{i:03d}" for i in range(1, 23)]


def test_lines(spark):
    report = frame(spark, [("a", 0.3, "major_shift"), ("b", 0.01, "stable")], "feature string, csi double, classification string")
    assert [r.line for r in drift.csi_violations(report).collect()] == ["a: CSI=0.3000 (major_shift)"]
    rates = frame(spark, [("x", 0.5, 0.9, 0.1, 0.8), ("y", 0.3, 0.7, 0.15, 0.75)], "grp string, selection_rate double, tpr double, fpr double, ppv double")
    lines = [r.line for r in fairness.violations(fairness.parity(rates), "segment").collect()]
    assert lines == ["segment: parity ratio 0.600 beyond 0.8", "segment: true positive gap 0.200 beyond 0.1"]


def test_columns(spark):
    d = frame(spark, [(1, 2.0, None, "x", 3), (2, None, None, "y", 4)], "id int, a double, b double, c string, as_of_1h int")
    assert models.select_columns(d, exclude=["id"]) == ["a"]
    assert evaluate.by_pattern(d, "^[ab]", "_") == ["a", "b"]


def test_binary_target(spark):
    d = spark.range(4000).select("id", F.lit(0.3).alias("p"))
    got = {r.id: r.y for r in risk.binary_target(d, "p", ["id"]).collect()}
    assert got == {r.id: r.y for r in risk.binary_target(d.repartition(7), "p", ["id"]).collect()} and 0.27 < sum(got.values()) / 4000 < 0.33
    assert {r.y for r in risk.binary_target(d.withColumn("p", F.lit(None)), "p", ["id"]).collect()} == {0}


def test_gains_have_cutoffs(spark):
    d = frame(spark, [(i, i / 100, int(i >= 90)) for i in range(100)], "k int, p double, y int")
    rows = risk.lorenz(d, "y", "p", "k").orderBy("bin").collect()
    assert rows[0].cutoff == pytest.approx(0.9) and rows[0].event_rate == 1 and rows[1].event_rate == 0 and rows[-1].cum_events == 1 and rows[-1].cutoff == 0
    none = risk.lorenz(d.withColumn("y", F.lit(0)), "y", "p", "k").collect()
    assert {r.cum_events for r in none} == {0.0}


def test_tables_round_trip(spark, tmp_path):
    d = frame(spark, [(i, i % 3, float(i)) for i in range(30)], "k int, segment_id int, x double")
    storage.write_training_set(d, f"file://{tmp_path}/train")
    back = spark.read.parquet(f"file://{tmp_path}/train")
    assert {tuple(r) for r in back.select(*d.columns).collect()} == {tuple(r) for r in d.collect()} and (tmp_path / "train" / "segment_id=2").is_dir()
    storage.write_reports({"r": d}, f"file://{tmp_path}/csv")
    storage.write_reports({"r": d}, f"file://{tmp_path}/json", "json")
    assert storage.read_csv_sample(spark, f"file://{tmp_path}/csv/r", "k int, segment_id int, x double", "k").orderBy("k").collect() == d.orderBy("k").collect()
    few = storage.read_csv_sample(spark, f"file://{tmp_path}/csv/r", "k int, segment_id int, x double", "k", n=7)
    assert few.count() == 7 and {r.k for r in few.collect()} == {r.k for r in storage.read_csv_sample(spark, f"file://{tmp_path}/csv/r", "k int, segment_id int, x double", "k", n=7).collect()}
    (part,) = (tmp_path / "json" / "r").glob("part-*")
    assert [json.loads(line)["k"] for line in part.read_text().splitlines()] == list(range(30))


def test_sorted_table(spark, tmp_path):
    d = spark.range(500).select(((F.col("id") * 7919) % 503).alias("a"), "id")
    storage.write_sorted(d, f"file://{tmp_path}/t", ["a", "id"])
    rows = [tuple(r) for f in sorted((tmp_path / "t").glob("part-*")) for r in spark.read.parquet(f"file://{f}").collect()]
    assert rows == sorted(tuple(r) for r in d.collect())


def test_folder_of_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_path(Session(), "x")


def test_drift_monitor_goes_on_where_it_stopped(spark, tmp_path):
    """Windows run on over batches and restarts, and a batch that is tried again does not count twice."""
    path, source, mark = (f"file://{tmp_path}/{x}" for x in ("out", "in", "checkpoint"))
    rng = random.Random(1)
    rows = [(i, rng.gauss(0 if i < 250 else 6, 1)) for i in range(480)]
    schema = "i int, x double"
    for a, b in ((0, 130), (130, 180), (180, 480)):
        frame(spark, rows[a:b], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        live.start_drift_monitor(stream, ["x"], ["i"], path, mark, size=100).awaitTermination()
    found = {(r.win, r.detector) for r in spark.read.parquet(f"{path}/events").collect()}
    assert {(2, "psi"), (2, "ks"), (3, "ks")} <= found and {w for w, d in found if d in ("psi", "ks")} == {2, 3} and max(found)[0] == 3
    assert spark.read.parquet(f"{path}/carry/batch=2").count() == 180
    report = lambda d: d.agg(F.count("*").alias("n"), F.min("i").alias("least"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    live.start_monitor(stream, report, f"{path}/m", f"{mark}-m", at="i", key="i", last=100).awaitTermination()
    last = storage.batches_before(spark, f"{path}/m/report", 99)
    assert tuple(one(spark.read.parquet(f"{path}/m/report/batch={last}"))) == (100, 380) and spark.read.parquet(f"{path}/m/buffer/batch={last}").count() == 100


def test_profit_heads(spark):
    """Three heads an arm: offers that are worth more to some are found on held-out customers."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        x, s, t = rng.random(), i % 2, rng.randrange(2)
        a = int(t and rng.random() < (x if s else 1 - x))
        rows.append((i // 2, s, x, t, a, 1000.0 * a, int(a and rng.random() < 0.05), x if s else 1 - x))
    d = frame(spark, rows, "k int, s int, x double, T int, accepted int, spend_delta double, defaulted int, truth double")
    found = models.train_per_segment(d, "k", "s", ["x"], "T", "truth", regs=(1.0,))
    assert set(found) == {0, 1} and all(tau > 0.9 for _, tau, *_ in found.values())


def test_separability_verdict(spark):
    aucs = frame(spark, [(0, 0.9), (1, 0.84), (2, None)], "segment int, auc double")
    r = one(models.separability_verdict(aucs))
    assert (r.value, r.passed) == (pytest.approx(0.87), True) and not one(models.separability_verdict(aucs.where("false"))).passed


@pytest.fixture(scope="module")
def loans(spark):
    """Defaults that rise with x and differ by segment; month 1 to 6 for those who default."""
    rng = random.Random(21)
    rows = []
    for i in range(3000):
        x, s = rng.random(), i % 3
        y = int(rng.random() < 0.05 + 0.3 * x + 0.2 * (s == 2))
        rows.append((i, x, s, y, rng.randrange(1, 7) if y else 0, int(rng.random() < 0.3 + 0.5 * x)))
    return spark.createDataFrame(rows, "id int, x double, s int, y int, m int, ok int").cache()


def rate(rows):
    rows = list(rows)
    return sum(rows) / len(rows)


def test_isotonic_scores(loans):
    got = models.apply_isotonic(models.isotonic(loans, "y", "x"), loans, "x").orderBy("x").collect()
    values = [r.calibrated for r in got]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1
    assert sum(values) == pytest.approx(sum(r.y for r in got), rel=0.02)


def test_hazards(loans):
    periods = risk.person_periods(loans, "y", "m", 6)
    m = models.fit_hazard(periods, ["x"])
    curves = risk.survival(models.hazards(m, loans, ["x"], 6), "id", "month", "hazard")
    last = curves.where("month = 6").select("id", "x", "cumulative_default").collect()
    want = rate(r.y for r in loans.collect())
    assert rate(r.cumulative_default for r in last) == pytest.approx(want, abs=0.03)
    assert rate(r.cumulative_default for r in last if r.x > 0.8) > rate(r.cumulative_default for r in last if r.x < 0.2) + 0.1


def test_segment_pd(loans):
    from pyspark.ml.functions import vector_to_array

    got = models.segment_pd(loans, ["x"], "s", "y").transform(loans).select("s", "y", F.element_at(vector_to_array("probability"), 2).alias("p")).collect()
    for s in range(3):
        assert rate(r.p for r in got if r.s == s) == pytest.approx(rate(r.y for r in got if r.s == s), abs=0.02)


def test_heckman_and_fuzzy_parcel(loans):
    d = loans.withColumn("z", F.col("x") * 2)
    scores = models.heckman_scores(models.heckman(d, "ok", "y", ["x"], ["z"]), d, ["x"], ["z"]).select("x", "pd").collect()
    assert all(0 < r.pd < 1 for r in scores) and rate(r.pd for r in scores if r.x > 0.7) > rate(r.pd for r in scores if r.x < 0.3)
    yes, no = d.where("ok = 1"), d.where("ok = 0").withColumn("p", F.lit(0.25))
    m = models.logistic(risk.fuzzy_parcel(yes, no, "y", "p", ["x"]), ["x"], "y", weight="weight")
    got = models.probability(m, d, ["x"], "score").collect()
    want = (sum(r.y for r in yes.collect()) + 0.25 * no.count()) / d.count()
    assert rate(r.score for r in got) == pytest.approx(want, abs=0.02)


def test_draws(loans):
    d = models.draw_predictions(loans, models.pd_draws(loans, "id", ["x"], "y", draws=4), ["x"])
    rows = models.credible_intervals(d, "id").collect()
    assert all(0 < r.low <= r.median <= r.high < 1 and r.low <= r.mean <= r.high for r in rows)
    want = rate(r.y for r in loans.collect())
    assert rate(r.mean for r in rows) == pytest.approx(want, abs=0.03)
    tail = one(models.tail_loss(models.portfolio_draws(d.withColumn("e", F.lit(100.0)), "e", 0.8)))
    assert tail.tail_loss >= tail.mean_loss == pytest.approx(3000 * 100 * 0.8 * want, rel=0.1)


def test_forest(loans):
    d = loans.withColumn("noise", F.rand(1)).withColumn("own", F.col("s") + 0.1 * F.col("x"))
    got = {r.feature: r.importance for r in models.importances(models.forest(d, ["own", "noise"], "s", trees=8, depth=4), ["own", "noise"], d.sparkSession).collect()}
    assert got["own"] > 0.9 and sum(got.values()) == pytest.approx(1)
    aucs = models.separability(d, "id", ["own", "noise"], "s", trees=8, depth=4).collect()
    assert len(aucs) == 3 and all(r.auc > 0.99 for r in aucs)


def test_linear_t_learner(spark):
    rows = [(i, float(i % 7), i % 2, (3.0 + 2.0 * (i % 7)) if i % 2 else 1.0) for i in range(140)]
    d = frame(spark, rows, "i int, x double, T int, profit double")
    got = models.uplift(models.t_learner(d, ["x"], "T", "profit"), d, ["x"]).collect()
    assert all(r.uplift == pytest.approx(2.0 + 2.0 * r.x, abs=1e-6) for r in got)
    assert models.t_learner(d.where("i < 15"), ["x"], "T", "profit") is None and {r.uplift for r in models.uplift(None, d, ["x"]).collect()} == {0.0}


def test_lag_state_outlives_a_restart(spark, tmp_path):
    """Three files, a query started anew for each: late rows take their place, and an idle customer is forgotten."""
    from datetime import datetime, timedelta

    start, schema = datetime(2024, 3, 1, 12), live.ENRICHED
    row = lambda i, k, minutes, balance: (i, k, start + timedelta(minutes=minutes), 1.0, 1, balance, 9.0, 0.0, 0.0, 0)
    files = [
        [row(1, 1, 0, 100.0), row(2, 1, 10, 90.0), row(3, 2, 0, 7.0)],
        [row(5, 1, 30, 60.0), row(4, 1, 9.9, 95.0), row(6, 1, 20, None)],  # the fourth is late, within the delay
        [row(7, 2, 60 * 50, 8.0), row(8, 1, 60 * 2, 50.0), row(9, 3, 60 * 50, 1.0)],
        [row(10, 2, 60 * 60, 9.0), row(11, 3, 60 * 80, 2.0)],
        [row(12, 3, 60 * 90, 3.0)],
    ]
    out, mark = f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        live.start(live.enrich(live.watermarked(stream, "1 minute"), idle=timedelta(hours=24)).select("event_id", "prev_balance", "prev_time"), out, mark).awaitTermination()
        if n == 0:
            assert spark.read.parquet(out).count() == 2, "rows above the watermark wait"
    got = {r.event_id: (r.prev_balance, r.prev_time and int((r.prev_time - start).total_seconds() / 6)) for r in spark.read.parquet(out).collect()}
    assert got[1] == (None, None) and got[4] == (100.0, 0) and got[2] == (95.0, 99) and got[6] == (90.0, 100) and got[5] == (None, 200)
    assert got[3] == (None, None) and got[7] == (None, None), "after two idle days nothing is left of the second customer"
    assert got[8] == (60.0, 300) and got[10] == (8.0, 30000) and got[11] == (None, None)
