"""What grows with the input is dealt to many tasks, or computed once: few groups, slices of streams, training frames, windows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import carry, ranks
from quillon.operators import drift, models
from quillon.plans import catalog, policy, streams  # noqa: F401


@pytest.fixture
def no_broadcast(spark):
    """Spark broadcasts nothing by its own size checks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_groups_are_broadcast_and_many_dealt_out(spark, no_broadcast, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 4).alias("g"), "id")
    small = ranks.written(rows.groupBy("g").agg(F.count("*").alias("n")), "groups")
    few = ranks.joined_by(rows, small, ["g"])
    assert "BroadcastHashJoin" in _plan(few)
    monkeypatch.setattr(ranks, "FEW_GROUPS", 3)
    many = ranks.joined_by(rows, small, ["g"])
    assert "BroadcastHashJoin" not in _plan(many)
    assert sorted(few.collect()) == sorted(many.collect())


def test_preconditions_bin_counts_of_values(spark, no_broadcast):
    """No step of it shuffles rows by the feature alone; unknown targets count in no bin's mean."""
    d = spark.range(4000).select((F.col("id") % 40).cast("double").alias("x"), F.when(F.col("id") % 7 > 0, ((F.col("id") % 40) > 19).cast("int")).alias("y"))
    found = models.preconditions(d, "y", {"x": 1, "absent": 1})
    got = {r.feature: r for r in found.collect()}
    rows = [(r.x, r.y) for r in d.collect()]
    means = [sum(y for x, y in rows if x // 4 == b and y is not None) / sum(1 for x, y in rows if x // 4 == b and y is not None) for b in range(10)]
    assert means == sorted(means) and got["x"].n_bins == 10 and got["x"].status == "ok" and got["absent"].status == "missing"
    assert got["x"].spearman == pytest.approx(0.8703882797784892, abs=1e-9)  # five bins of mean 0, five of mean 1


def test_preconditions_shuffle_values_not_rows(spark, no_broadcast):
    """Values meet their feature's edges without a shuffle by feature."""
    d = spark.range(1000).select((F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    plan = _plan(models.preconditions(d, "y", {"x": 1}))
    assert "BroadcastHashJoin [feature" in plan


def test_slices_are_whole_batches_of_many_files(spark, tmp_path, monkeypatch):
    """A slice is one batch, however many tasks write it, and none gathers it."""
    monkeypatch.setattr(streams.storage, "shared_path", lambda _, label: f"{tmp_path}/{label}")
    batches, d = [], spark.range(0, 1000, 1, 4)

    def start(stream):
        note = lambda df, n: batches.append((n, df.count(), df.agg(F.min("id")).first()[0], len(list(tmp_path.glob("slices/*.parquet")))))
        return stream.writeStream.option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).foreachBatch(note).start()

    streams._sliced(spark, [d.where("id % 2 = 0"), d.where("id % 2 = 1")], start)
    assert batches == [(0, 500, 0, 4), (1, 500, 1, 8)]


def test_windows_in_a_task_give_the_signals_of_counts(spark):
    """Ties, gaps, a constant, a window without a feature's values: both ways agree, and windows take one shuffle."""
    i = F.col("i")
    d = spark.range(800).select(F.col("id").alias("i")).select("i", (i * 37 % 11).alias("x"), F.when(i % 9 > 0, i * 7919 % 101 / 7.0).alias("y"), F.lit(3.0).alias("z"), F.when((i >= 300) | (i < 100), i % 5 / 2.0).alias("gap"))
    w = d.withColumn("win", F.floor(i / 100).cast("long"))
    ref, cur, names = w.withColumn("win", F.col("win") + 1).where("win < 8"), w.where("win > 0"), ["x", "y", "z", "gap"]
    quick = drift.signals(ref, cur, names, size=100)
    assert _plan(quick).count("Exchange") == 1
    key = lambda r: (r.win, r.feature, r.detector)
    got, want = ({key(r): r for r in f.collect()} for f in (quick, drift.signals(ref, cur, names)))
    assert set(got) == set(want) and len(got) > 100
    for k, r in want.items():
        assert got[k].statistic == pytest.approx(r.statistic, abs=1e-9) and (got[k].threshold, got[k].is_drifting) == (r.threshold, r.is_drifting), k


def test_models_read_a_written_frame(spark, sf_dir):
    """What fits and splits read again and again is files, with the rows of the whole frame."""
    d = policy._segments(spark, sf_dir)
    assert "Exchange" not in _plan(d) and "FileScan" in _plan(d)
    whole = policy._training(spark, sf_dir).select(*d.columns)
    assert d.exceptAll(whole).count() == 0 and d.count() == whole.count()


def test_no_lambda_runs_on_each_row(spark):
    """Pieces and bins of rows are compiled conditions; they equal a bisection of the cuts and edges."""
    d = spark.range(600).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 601 / 4.0).alias("x"))
    bounds = ranks.written(carry.cuts(d, ["g", "x"], 13), "bounds")
    cut = carry._cut(d, bounds, 1, ["g", "x"], 13)
    assert "lambdafunction" not in _plan(cut)
    place = lambda g, x: (g, x is not None, x or 0.0)
    at = [place(*c) for c in bounds.first()[0]]
    rows = cut.collect()
    assert len(at) > 10 and all(r._piece == bisect_right(at, place(r.g, r.x)) for r in rows)
    # every piece of a key that a cut runs through is shared, so that totals need no filter
    assert {r._shared for r in rows if any(c[0] == r.g for c in at)} == {True}
    edges = [[1.0], [1.0, 2.0], [0.0, 1.0, 2.5, 2.75], [float(i) for i in range(11)]]
    b = spark.createDataFrame([(e, x / 4.0) for e in edges for x in range(-2, 46)], "edges array<double>, x double")
    x, e = F.col("x"), F.col("edges")
    b = b.select("*", ranks.bin_right_closed(x, e, 10).alias("right"), ranks.bin_open(x, e, 10).alias("open"), ranks.bin_left_closed(x, e, 10).alias("left"))
    assert "lambdafunction" not in _plan(b)
    for r in b.collect():
        inner = r.edges[1:-1]
        want = bisect_right(inner, r.x)
        assert (r.right, r.open, r.left) == (bisect_left(inner, r.x), want, want if r.edges[0] <= r.x <= r.edges[-1] else None)


def test_drift_bins_without_lambdas(spark):
    d = spark.range(400).select((F.col("id") % 4).alias("g"), (F.col("id") % 37).cast("double").alias("x"))
    assert "lambdafunction" not in _plan(drift.psi(d.where("x < 30"), d, ["x"], by=["g"]))


@pytest.mark.parametrize("few", [3, 10_000])
def test_quantiles_order_only_the_pieces_that_hold_them(spark, monkeypatch, few):
    """Heavy ties, a group of one value, a large group: edges are those of numpy; of the large group's pieces only those with a place go on."""
    tables, write = {}, ranks.written
    monkeypatch.setattr(ranks, "written", lambda df, label: tables.setdefault(label, write(df, label)))
    monkeypatch.setattr(ranks, "FEW_GROUPS", few)
    values = {"one": [3.5], "two": [1.0, 1.0, 9.0], "ties": [float(i % 7 if i % 3 else 2) for i in range(500)], "large": [i * 7919 % 20011 / 8.0 for i in range(20000)]}
    d = spark.createDataFrame([(g, x) for g, xs in values.items() for x in xs], "g string, x double")
    got = {r.g: r for r in ranks.quantile_edges(ranks.value_counts(d, "x", ["g"]), ranks.steps(4), ["g"]).collect()}
    assert set(got) == set(values)
    for g, xs in values.items():
        assert got[g].total == len(xs) and got[g].edges == pytest.approx(sorted(set(np.quantile(xs, ranks.steps(4)).tolist()))), g
    large = tables["pieces"].where("g = 'large'")
    assert large.count() <= 10 and large.agg(F.sum("size")).first()[0] < 5000
