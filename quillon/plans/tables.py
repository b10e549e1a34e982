"""Queries on what is written and read back, on lines for people, and on the choice of columns, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import economics as e
from quillon.operators import asof, decide, drift, evaluate, fairness, gate, models, views
from quillon.plans import catalog, monitor, policy
from quillon.plans.catalog import register
from quillon.plans.features import TRAINING_SQL, rounded
from quillon.sources import adapter as a
from quillon.sources import storage


def _frame(spark, sf_dir):
    d = asof.assemble(views.all_views(a.transactions(spark, sf_dir), a.transactions_with_attributes(spark, sf_dir)), events=a.transactions(spark, sf_dir))
    return rounded(d.withColumn("segment_id", (F.col("customer_id") % 6).cast("int")), 6, "geo_variance_7d")


_FRAME_SQL = f"WITH {TRAINING_SQL} SELECT *, (customer_id % 6)::INT AS segment_id FROM training"


@register("training_set_round_trip", _FRAME_SQL)
def training_set_round_trip(spark, sf_dir):
    """The training frame as it comes back from its files, one folder a segment."""
    d, path = _frame(spark, sf_dir), storage.shared_path(spark, "training-set")
    storage.write_training_set(d, path)
    return spark.read.schema(d.schema).parquet(path).select(*d.columns)


@register("sorted_serving_rows", f"WITH {a.TX_SQL} SELECT customer_id, event_time, event_id, amount FROM tx")
def sorted_serving_rows(spark, sf_dir):
    """Transactions from files that are in order of customer, time and id."""
    path = storage.shared_path(spark, "sorted")
    storage.write_sorted(a.transactions(spark, sf_dir).select("customer_id", "event_time", "event_id", "amount"), path, ["customer_id", "event_time", "event_id"])
    return spark.read.parquet(path)


@register("report_round_trip", f"WITH {a.SCORED_SQL} SELECT segment, round(avg(price), 4) AS price_mean, round(stddev_samp(price), 4) AS price_sd FROM scored GROUP BY segment")
def report_round_trip(spark, sf_dir):
    """A report as it comes back from CSV."""
    d, path = rounded(gate.segment_means(a.scored_accounts(spark, sf_dir), "segment", ["price"]), 4), storage.shared_path(spark, "reports")
    storage.write_reports({"segments": d}, path)
    return spark.read.schema(d.schema).option("header", True).csv(f"{path}/segments")


@register("csv_sample", f"WITH {a.TX_SQL} SELECT event_id, customer_id, amount FROM tx ORDER BY {e.key_hash_sql('event_id')}, event_id LIMIT 200")
def csv_sample(spark, sf_dir):
    """A sample of 200 events of a CSV file, always the same ones."""
    d, path = a.transactions(spark, sf_dir).select("event_id", "customer_id", "amount"), storage.shared_path(spark, "csv")
    d.write.option("header", True).csv(path)
    return storage.read_csv_sample(spark, path, d.schema.simpleString()[7:-1].replace(":", " "), "event_id", n=200)


_SPARSE = {"avg_interarrival_24h": "velocity_5m > 1", "utilization": "customer_id % 3 > 0", "total_spend_7d": "velocity_7d > 2", "credit_score": "true"}


@register("selected_columns", f"WITH {TRAINING_SQL}, c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", avg(CASE WHEN {w} AND {n} IS NOT NULL THEN 1 ELSE 0 END) AS share FROM training" for n, w in _SPARSE.items()) + ') SELECT "column" FROM c WHERE share >= 0.5')
def selected_columns(spark, sf_dir):
    """Columns that are known in at least half the rows."""
    d = _frame(spark, sf_dir)
    d = d.select(*[F.when(F.expr(w), F.col(n)).alias(n) for n, w in _SPARSE.items()], "customer_id")
    return spark.createDataFrame([(c,) for c in models.select_columns(d, exclude=["customer_id"])], "column string")


@register("pattern_columns", f"WITH {TRAINING_SQL} SELECT column_name AS \"column\" FROM (DESCRIBE SELECT * FROM training) WHERE regexp_matches(column_name, '^(avg|total)_') AND NOT regexp_matches(column_name, '_5m$')")
def pattern_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in evaluate.by_pattern(_frame(spark, sf_dir), "^(avg|total)_", "_5m$")], "column string")


@register("gate_report", f"SELECT * FROM ({catalog.oracle_sql()['rate_heterogeneity']}) UNION ALL SELECT * FROM ({catalog.oracle_sql()['temporal_signal']})")
def gate_report(spark, sf_dir):
    d = storage.written(policy._frame(spark, sf_dir), "frame")
    return rounded(gate.run([gate.rate_heterogeneity(d), gate.temporal_signal(d)]))


_SCORES_SQL = "s AS (SELECT o_orderkey AS item, unnest([{'coin': 'btc', 'score': (o_orderkey % 3 - 1)::INT}, {'coin': 'eth', 'score': (o_custkey % 3 - 1)::INT}]) AS s FROM orders)"


@register("sentiment_scores", f"WITH {_SCORES_SQL} SELECT item, s.coin, s.score FROM s")
def sentiment_scores(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    one = lambda coin, k: F.struct(F.lit(coin).alias("coin"), (F.col(k) % 3 - 1).cast("int").alias("score"))
    return decide.sentiment_rows(o.select(F.col("o_orderkey").alias("item"), F.array(one("btc", "o_orderkey"), one("eth", "o_custkey")).alias("scores")))


@register("sentiment_agreement", "SELECT round(avg(CASE WHEN x = 0 AND y = 0 THEN 1 WHEN x <> 0 AND y <> 0 AND x = y THEN 1 ELSE 0 END), 6) AS agreement FROM (SELECT o_orderkey % 3 - 1 AS x, coalesce(nullif(o_custkey % 4, 3) - 1, 0) AS y FROM orders)")
def sentiment_agreement(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3 - 1).alias("ours"), (F.expr("nullif(o_custkey % 4, 3)") - 1).alias("theirs"))
    return rounded(decide.sentiment_agreement(o, "ours", "theirs"))


_MOVED_SQL = monitor.LONG_SQL.replace("'price' AS feature, price::DOUBLE AS x", f"'price' AS feature, CASE WHEN ts >= TIMESTAMP '{monitor.MIDDLE}' THEN price * 3 ELSE price END::DOUBLE AS x")


@register("csi_lines", f"WITH {_MOVED_SQL}, {monitor._psi_sql('feature', 'psi', 'greatest({x}, 1e-6::DOUBLE)', False)} SELECT feature, feature || ': CSI=' || printf('%.4f', v) || ' (' || CASE WHEN v < 0.25 THEN 'minor_shift' ELSE 'major_shift' END || ')' AS line FROM psi WHERE v >= 0.1")
def csi_lines(spark, sf_dir):
    """Features that are not stable, the later half's prices being three times what they are."""
    ref, cur = monitor._halves(spark, sf_dir)
    moved = cur.withColumn("price", F.col("price") * 3)
    return drift.csi_violations(drift.csi(ref, moved, monitor.FEATURES))


_RATES = monitor.RATES_SQL
_LINES = """SELECT segment, unnest(list_filter([
  CASE WHEN parity_ratio < 0.95 THEN 'segment: parity ratio ' || printf('%.3f', parity_ratio) || ' beyond 0.95' END,
  CASE WHEN tpr_gap > 0.001 THEN 'segment: true positive gap ' || printf('%.3f', tpr_gap) || ' beyond 0.001' END,
  CASE WHEN fpr_gap > 0.001 THEN 'segment: false positive gap ' || printf('%.3f', fpr_gap) || ' beyond 0.001' END,
  CASE WHEN ppv_gap > 0.001 THEN 'segment: precision gap ' || printf('%.3f', ppv_gap) || ' beyond 0.001' END], lambda x: x IS NOT NULL)) AS line FROM rep"""


@register("fairness_lines", f"WITH {_RATES} SELECT line FROM ({_LINES})")
def fairness_lines(spark, sf_dir):
    report = fairness.parity(monitor._rates(spark, sf_dir), by=["segment"], floor=0.95, tolerance=0.001)
    return fairness.violations(report, "segment", 0.95, 0.001)
