"""Queries on sources, the registry and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import decide, fairness, views
from quillon.plans import monitor as monitor_plans
from quillon.plans.catalog import register
from quillon.plans.features import ENRICHED_SQL, V5M, rounded
from quillon.plans.risk import bin_sql, edges_sql
from quillon.sources import adapter as a
from quillon.sources import events, registry, storage
from quillon.streaming import features as live


@register("event_quality", f"""WITH {a.TX_SQL}, {a.CUSTOMERS_SQL}, j AS (SELECT tx.*, c.credit_score, c.annual_income, c.account_tenure_months, c.n_products, c.prev_delinquency_count FROM tx JOIN cust c USING (customer_id)),
r AS (SELECT unnest(list_filter([CASE WHEN NOT coalesce(amount > 50, false) THEN 'amount' END, CASE WHEN NOT coalesce(current_balance <= credit_limit * 0.3, false) THEN 'balance' END, CASE WHEN NOT coalesce(geo_lat BETWEEN -60 AND 60, false) THEN 'geo_lat' END, CASE WHEN NOT coalesce(annual_income > 22000, false) THEN 'annual_income' END], lambda x: x IS NOT NULL)) AS rule FROM j)
SELECT rule, count(*) AS n FROM r GROUP BY rule""")
def event_quality(spark, sf_dir):
    rules = {"amount": "amount > 50", "balance": "current_balance <= credit_limit * 0.3", "geo_lat": "geo_lat BETWEEN -60 AND 60", "annual_income": "annual_income > 22000"}
    return events.violation_counts(events.check(a.transactions_with_attributes(spark, sf_dir), rules))


@register("event_quarantine", f"WITH {a.TX_SQL}, {a.CUSTOMERS_SQL} SELECT count(*) FILTER (NOT ok) AS n_bad, count(*) FILTER (ok) AS n_good FROM (SELECT coalesce(amount > 0 AND tx.segment_id BETWEEN 0 AND 5 AND credit_limit > 0 AND current_balance >= 0 AND current_balance <= credit_limit * 1.01 AND geo_lat BETWEEN -90 AND 90 AND geo_lon BETWEEN -180 AND 180 AND event_time IS NOT NULL AND c.credit_score BETWEEN 300 AND 850 AND c.annual_income > 0 AND c.account_tenure_months BETWEEN 0 AND 360 AND c.n_products BETWEEN 0 AND 10 AND c.prev_delinquency_count BETWEEN 0 AND 20, false) AS ok FROM tx JOIN cust c USING (customer_id))")
def event_quarantine(spark, sf_dir):
    d = events.check(a.transactions_with_attributes(spark, sf_dir))
    return d.agg(F.count(F.when(F.size("violations") > 0, 1)).alias("n_bad"), F.count(F.when(F.size("violations") == 0, 1)).alias("n_good"))


@register("event_routing", f"WITH {a.TX_SQL} SELECT topic, count(*) AS n FROM (SELECT CASE WHEN epoch(TIMESTAMP '2024-01-15') - epoch(event_time) < 300 THEN 'transactions-live' ELSE 'transactions-historical' END AS topic FROM tx) GROUP BY topic")
def event_routing(spark, sf_dir):
    d = events.route(a.transactions(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return d.groupBy("topic").agg(F.count("*").alias("n"))


@register("json_transactions", "SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS customer_id, date_trunc('second', ts) AS event_time, value AS amount FROM events")
def json_transactions(spark, sf_dir):
    e = a.table(spark, sf_dir, "events")
    raw = e.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("customer_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.col("value").alias("amount"))).alias("value"))
    return events.parse_transactions(raw).select("event_id", "customer_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "amount")


@register("iso_to_millis", "SELECT o_orderkey, epoch_ms(o_orderdate) AS ms FROM orders")
def iso_to_millis(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", events.iso_millis(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("ms"))


@register("high_water_mark", "SELECT count(*) AS n_new, max(ts) AS mark FROM events WHERE ts > TIMESTAMP '2024-01-20'")
def high_water_mark(spark, sf_dir):
    stored = a.table(spark, sf_dir, "events").where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")).agg(F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias("mark"))
    new, mark = events.newer_than(a.table(spark, sf_dir, "events"), stored, "ts")
    return new.agg(F.count("*").alias("n_new")).join(F.broadcast(mark))


@register("latest_upsert", "SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_upsert(spark, sf_dir):
    d = a.table(spark, sf_dir, "events").select("user_id", "ts", "value", F.struct("ts", "event_id").alias("at"))
    return events.latest_per_key(d, ["user_id"], "at").select("user_id", "ts", "value")


@register("feature_registry", "SELECT p_brand AS feature, (max(p_partkey))::INT AS version, sha256(arg_max(p_name, p_partkey)) AS definition_hash FROM part GROUP BY p_brand")
def feature_registry(spark, sf_dir):
    p = a.table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature"), F.col("p_partkey").cast("int").alias("version"), F.col("p_name").alias("definition"), F.lit("job").alias("registered_by"), F.lit("").alias("description"))
    return registry.latest(registry.register(registry.empty(spark), p)).select("feature", "version", "definition_hash")


@register("feature_backfill", f"WITH {a.TX_SQL}, b AS ({V5M.replace('FROM tx', chr(10) + 'FROM (SELECT * FROM tx WHERE event_time >= TIMESTAMP ' + repr('2024-01-05') + ' AND event_time < TIMESTAMP ' + repr('2024-01-15') + ')')}) SELECT substr(sha256('end=2024-01-15|feature=view_5m|start=2024-01-05|version=3'), 1, 16) AS request_id, 'view_5m' AS feature, 3 AS version, count(*) AS rows FROM b")
def feature_backfill(spark, sf_dir):
    return registry.backfill(a.transactions(spark, sf_dir), views.view_5m, storage.shared_path(spark, "backfill"), feature="view_5m", version=3, start="2024-01-05", end="2024-01-15")


def _stream(spark, sf_dir):
    e = a.table(spark, sf_dir, "events")
    return a.events_as_transactions(events.files(spark, f"{sf_dir}/event[s].parquet", e.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")))


def _run(spark, view, label):
    path = storage.shared_path(spark, label)
    live.start(view, path, storage.shared_path(spark, label + "-checkpoint")).awaitTermination()
    return spark.read.schema(view.schema).parquet(path)


def _plain(df):
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema.fields])


@register("stream_view_5m", f"WITH {a.TX_SQL} SELECT * FROM ({V5M}) WHERE window_end <= (SELECT max(event_time) FROM tx) - INTERVAL 10 SECOND")
def stream_view_5m(spark, sf_dir):
    return rounded(_plain(_run(spark, views.view_5m(live.watermarked(_stream(spark, sf_dir))), "stream-5m")))


@register("stream_view_5m_open", f"WITH {a.TX_SQL} {V5M}")
def stream_view_5m_open(spark, sf_dir):
    view = views.view_5m(live.watermarked(_stream(spark, sf_dir)))
    path = storage.shared_path(spark, "serving")
    live.start_upserts(view, path, storage.shared_path(spark, "serving-checkpoint"), ["customer_id", "window_start"]).awaitTermination()
    return rounded(_plain(spark.read.parquet(path).select(*view.columns)))


@register("stream_enriched", f"WITH {ENRICHED_SQL} SELECT event_id, prev_balance, is_paydown, is_cash_advance, is_late_night, time_since_last_s FROM enriched WHERE event_time <= (SELECT max(event_time) FROM tx) - INTERVAL 10 SECOND")
def stream_enriched(spark, sf_dir):
    d = live.enrich(live.watermarked(_stream(spark, sf_dir)))
    return _run(spark, d.select("event_id", "prev_balance", "is_paydown", "is_cash_advance", "is_late_night", "time_since_last_s"), "stream-enriched")


@register("live_union_historical", f"WITH {a.TX_SQL} SELECT count(*) AS n, count(DISTINCT customer_id) AS n_customers FROM tx")
def live_union_historical(spark, sf_dir):
    tx = _stream(spark, sf_dir).withColumn("event_time", F.col("event_time").cast("timestamp")).withColumn("late", F.col("event_time") < F.lit("2024-01-16").cast("timestamp"))
    both = events.live_and_historical(tx.where("not late"), tx.where("late"))
    d = _run(spark, both.select("event_id", "customer_id"), "stream-union")
    return d.agg(F.count("*").alias("n"), F.countDistinct("customer_id").alias("n_customers"))


@register("stream_unmatched_outcomes", f"WITH {a.DECISIONS_SQL} SELECT decision_id, CASE WHEN decision_id % 4 = 0 THEN 'champion' ELSE coalesce(alias, 'champion') END AS alias, CASE WHEN decision_id % 4 = 0 THEN NULL ELSE action END AS action, CASE WHEN decision_id % 4 = 0 THEN 1 ELSE round(coalesce(propensity, 1), 6) END AS propensity, round(reward, 4) AS reward FROM dec WHERE decision_id % 3 <> 0")
def stream_unmatched_outcomes(spark, sf_dir):
    """A fourth of the decisions never comes, a third has no outcome; a last pair of rows, far ahead in time, closes the streams."""
    d = a.decisions(spark, sf_dir).withColumn("decided_at", F.col("ts").cast("timestamp")).select("decision_id", "decided_at", "alias", "segment_id", "action", "propensity", "reward")
    end = d.agg(F.lit(-1).cast(d.schema["decision_id"].dataType).alias("decision_id"), (F.max("decided_at") + F.expr("INTERVAL 60 DAYS")).alias("decided_at"), *[F.lit(None).cast(d.schema[c].dataType).alias(c) for c in d.columns[2:]])
    rows = d.unionByName(end)
    made = storage.written(rows.where("decision_id % 4 <> 0").drop("reward"), "decisions")
    seen = storage.written(rows.where("decision_id % 3 <> 0").select("decision_id", (F.col("decided_at") + F.expr("INTERVAL 1 DAY")).alias("observed_at"), "reward"), "outcomes")
    stream = lambda t: spark.readStream.schema(t.schema).parquet(t.inputFiles()[0].rsplit("/", 1)[0])
    found = live.outcomes_or_defaults(stream(made), stream(seen))
    return rounded(rounded(_run(spark, found.select("decision_id", "alias", "action", "propensity", "reward"), "stream-unmatched").where("decision_id >= 0"), 6).withColumn("reward", F.round("reward", 4)))


@register("stream_decision_outcomes", f"WITH {a.DECISIONS_SQL} SELECT decision_id, action, round(reward, 4) AS reward FROM dec WHERE decision_id % 4 <> 0")
def stream_decision_outcomes(spark, sf_dir):
    d = a.decisions(spark, sf_dir).withColumn("decided_at", F.col("ts").cast("timestamp")).select("decision_id", "customer_id", "decided_at", "action", "reward")
    made = storage.written(d.drop("reward"), "decisions")
    seen = storage.written(d.where("decision_id % 4 <> 0").select("decision_id", "customer_id", (F.col("decided_at") + F.expr("INTERVAL 1 DAY")).alias("observed_at"), "reward"), "outcomes")
    stream = lambda t: spark.readStream.schema(t.schema).parquet(t.inputFiles()[0].rsplit("/", 1)[0])
    joined = live.join_outcomes(stream(made), stream(seen))
    return rounded(_run(spark, joined.select("decision_id", "action", "reward"), "stream-join"), 4)


def _sliced(spark, slices, start):
    """Runs a stream that gets the frames one after the other, one a batch; start(stream) starts it with a checkpoint of its own.

    A slice has as many files as tasks wrote it: each is added once the stream is through with the one before,
    and the stream, started again, takes all files that are new.
    """
    path = storage.shared_path(spark, "slices")
    for d in slices:
        d.write.mode("append").parquet(path)
        start(spark.readStream.schema(d.schema).parquet(path)).awaitTermination()


LATE = "event_id % 50 = 0 AND ts < TIMESTAMP '2024-01-05'"


@register("stream_late_events", f"WITH {a.TX_SQL.replace('FROM events)', f'FROM events WHERE NOT ({LATE}))')} SELECT * FROM ({V5M}) WHERE window_end <= (SELECT max(event_time) FROM tx) - INTERVAL 10 SECOND")
def stream_late_events(spark, sf_dir):
    """Events that come more than two weeks late are dropped; their windows were emitted without them."""
    e = a.table(spark, sf_dir, "events")
    late = F.expr(LATE.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    last = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    path, mark = storage.shared_path(spark, "stream-late"), storage.shared_path(spark, "stream-late-checkpoint")
    view = lambda stream: views.view_5m(live.watermarked(a.events_as_transactions(stream)))
    _sliced(spark, [e.where(~late & ~last), e.where(last), e.where(late)], lambda stream: live.start(view(stream), path, mark))
    return rounded(_plain(spark.read.schema(view(e).schema).parquet(path)))


STREAM_WATCHED = ["amount", "mcc"]


@register("stream_drift_monitor", f"WITH {monitor_plans.signals_sql(*STREAM_WATCHED)} SELECT win, detector, feature, round(statistic, 5) AS statistic, threshold, is_drifting, 500 AS window_size FROM sig WHERE is_drifting")
def stream_drift_monitor(spark, sf_dir):
    """Windows of 500 events against the ones before, over a stream of three batches; drifting ones only."""
    tx = a.transactions(spark, sf_dir).select("event_id", "event_time", *STREAM_WATCHED)
    cut = lambda x: F.lit(x).cast("timestamp_ntz")
    at = F.col("event_time")
    slices = [tx.where(at < cut("2024-01-10")), tx.where((at >= cut("2024-01-10")) & (at < cut("2024-01-20"))), tx.where(at >= cut("2024-01-20"))]
    path, mark = storage.shared_path(spark, "drift-monitor"), storage.shared_path(spark, "drift-checkpoint")
    _sliced(spark, slices, lambda stream: live.start_drift_monitor(stream, STREAM_WATCHED, ["event_time", "event_id"], path, mark))
    return rounded(spark.read.parquet(f"{path}/events").drop("batch"), 5)


NEWEST_SQL = f"""{a.DECISIONS_SQL}, j AS (SELECT decision_id, segment_id, (reward > 5000)::INT AS y, fraud_score AS p, mu_new AS score, ts FROM dec),
newest AS (SELECT * FROM j ORDER BY ts DESC, decision_id DESC LIMIT 5000), {edges_sql('newest', 'score', n=5)},
scored AS (SELECT 'segment_id' AS dimension, segment_id::VARCHAR AS grp, y, p FROM newest UNION ALL SELECT 'score_bucket', ({bin_sql('score')})::VARCHAR, y, p FROM newest, edges),
r AS (SELECT dimension, grp, avg((p >= 0.5)::INT) AS selection_rate, avg(CASE WHEN y = 1 THEN (p >= 0.5)::INT END) AS tpr, avg(CASE WHEN y = 0 THEN (p >= 0.5)::INT END) AS fpr, avg(CASE WHEN p >= 0.5 THEN y END) AS ppv FROM scored GROUP BY ALL)"""


def _fairness_report(d):
    by = {"segment_id": d.withColumn("g", F.col("segment_id")), "score_bucket": fairness.score_buckets(d, "score", out="g")}
    parts = [fairness.gauges(fairness.group_rates(x, "y", "p", "g"), name) for name, x in by.items()]
    return parts[0].unionByName(parts[1])


@register("stream_fairness_monitor", f"WITH {NEWEST_SQL} SELECT dimension, grp, metric, round(value, 6) AS value FROM (UNPIVOT r ON selection_rate, tpr, fpr, ppv INTO NAME metric VALUE value)")
def stream_fairness_monitor(spark, sf_dir):
    """The report on the 5000 newest decisions with outcomes, after a stream's last batch."""
    d = a.decisions(spark, sf_dir).select("decision_id", "segment_id", (F.col("reward") > 5000).cast("int").alias("y"), F.col("fraud_score").alias("p"), F.col("mu_new").alias("score"), "ts")
    path, mark = storage.shared_path(spark, "fairness-monitor"), storage.shared_path(spark, "fairness-checkpoint")
    _sliced(spark, [d.where(F.col("decision_id") % 3 == k) for k in range(3)], lambda stream: live.start_monitor(stream, _fairness_report, path, mark, at="ts", key="decision_id"))
    last = storage.batches_before(spark, f"{path}/report", 1 << 62)
    return rounded(spark.read.parquet(f"{path}/report/batch={last}"))


NOTICE_FEATURES = ("utilization", "velocity_24h", "paydown_rate_30d", "fraud_score")
#: Weights without common multiples, so that no two features weigh the same.
_WEIGHTS = {"utilization": -80.1237, "velocity_24h": -1.0451, "paydown_rate_30d": 30.7893, "fraud_score": -10.6319}
_NEUTRAL = {"utilization": 0.5, "velocity_24h": 20.0, "paydown_rate_30d": 0.5, "fraud_score": 0.25}


def _code_sql(f: str) -> str:
    return f"{{'v': {_WEIGHTS[f]}::DOUBLE * ({f} - {_NEUTRAL[f]}::DOUBLE), 'f': '{f}', 'code': '{decide.REASON_CODES.get(f, decide.OTHER_CODE)}'}}"


@register("stream_notices", f"WITH {a.DECISIONS_SQL}, n AS (SELECT decision_id, customer_id, alias, list_filter([{', '.join(_code_sql(f) for f in NOTICE_FEATURES)}], lambda x: x.v < -1e-9) AS low FROM dec WHERE action = 0) SELECT decision_id, customer_id, alias AS acted_on_alias, array_to_string(list_transform(list_sort(low), lambda x: x.code), '; ') AS reason_codes FROM n")
def stream_notices(spark, sf_dir):
    """Coded reasons of the denied decisions of a stream."""
    d = a.decisions(spark, sf_dir).select("decision_id", "customer_id", F.when(F.col("alias") != "champion", F.col("alias")).alias("acted_on_alias"), F.struct((F.col("action") == 0).alias("adverse_action_eligible")).alias("regulatory_flags"), *NOTICE_FEATURES)
    score = lambda x: x.withColumn("profit", sum((F.lit(w) * F.col(f) for f, w in _WEIGHTS.items()), F.lit(0.0)))
    path, mark = storage.shared_path(spark, "notices"), storage.shared_path(spark, "notices-checkpoint")
    _sliced(spark, [d.where(F.col("decision_id") % 2 == k) for k in range(2)], lambda stream: live.start_notices(stream, list(NOTICE_FEATURES), score, _NEUTRAL, path, mark))
    return spark.read.parquet(path).select("decision_id", "customer_id", "acted_on_alias", F.array_join("reason_codes", "; ").alias("reason_codes"))
