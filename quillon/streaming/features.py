"""Feature views on streams: the batch functions over streaming frames, stateful enrichment and serving tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import decide, drift, views
from quillon.sources.storage import batches_before, upsert, write_batch, written
from quillon.streaming import states

ENRICHED = "event_id long, customer_id long, event_time timestamp, amount double, mcc int, current_balance double, credit_limit double, geo_lat double, geo_lon double, segment_id int"

#: A customer without events for so long is forgotten.
IDLE = timedelta(days=400)


def watermarked(tx: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Events of a stream with a zoned event time, which watermarks need."""
    return tx.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", delay)


def start(view: DataFrame, path: str, checkpoint: str, *, mode: str = "append", once: bool = True):
    """A view to Parquet files; append emits a window once it is closed."""
    q = view.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()


def start_upserts(view: DataFrame, path: str, checkpoint: str, keys: list[str], *, newest: str | None = None, once: bool = True):
    """A view in update mode to a keyed table: every batch's rows replace those of the same key, so open windows show."""
    q = view.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upsert(df, path, keys, newest=newest))
    return (q.trigger(availableNow=True) if once else q).start()


def enrich(tx: DataFrame, *, idle: timedelta = IDLE) -> DataFrame:
    """The previous balance and time of each customer's events on a stream, in event-time order.

    A customer's events wait until the watermark has passed them, so that late ones within the delay
    take their place; what has been emitted leaves only the last balance and time behind, and nothing once a customer has been idle for so long.
    """
    states.use_rocksdb(tx.sparkSession)
    columns = dict(c.split(" ") for c in ENRICHED.split(", "))
    lag = states.Lag(columns, time="event_time", tie="event_id", value="current_balance", outputs=("prev_balance", "prev_time"), idle_ms=int(idle.total_seconds() * 1000))
    d = tx.select(*columns).groupBy("customer_id").transformWithStateInPandas(lag, ENRICHED + ", prev_balance double, prev_time timestamp", "Append", "EventTime")
    return views.enriched_columns(d)


def join_outcomes(decisions: DataFrame, outcomes: DataFrame, *, within: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """Decisions with the outcome that came within a time of them, in whichever order the two arrived."""
    d = decisions.withWatermark("decided_at", delay)
    o = outcomes.withColumnsRenamed({"decision_id": "_d", "customer_id": "_c"}).withWatermark("observed_at", delay)
    on = (F.col("decision_id") == F.col("_d")) & (F.col("customer_id") == F.col("_c")) & F.expr(f"observed_at >= decided_at AND observed_at <= decided_at + INTERVAL {within}")
    return d.join(o, on).drop("_d", "_c")


def outcomes_or_defaults(decisions: DataFrame, outcomes: DataFrame, *, within: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """Every outcome of a stream with its decision's fields, in whichever order the two arrived; one whose decision never came has the defaults, once
    the watermark says that none can come any more. What is kept of either side is bounded by `within` and `delay`."""
    fields = ["alias", "segment_id", "action", "propensity"]
    d = decisions.select(F.col("decision_id").alias("_d"), F.col("decided_at").alias("_at"), *fields).withWatermark("_at", delay)
    o = outcomes.withWatermark("observed_at", delay)
    joined = o.join(d, (F.col("decision_id") == F.col("_d")) & F.expr(f"_at <= observed_at AND _at >= observed_at - INTERVAL {within}"), "left_outer")
    return decide.with_defaults(joined.drop("_d", "_at"))


def _started(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None):
    q = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (q.trigger(processingTime=every) if every else q.trigger(availableNow=True)).start()


def start_monitor(joined: DataFrame, report: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, *, at: str, key: str, last: int = 5000, every: str | None = None):
    """Each batch, a report on the `last` newest joined rows (ties by key), under the batch's number.

    What is kept between batches is those rows alone. A batch that is tried again starts from
    the one before it and replaces its own buffer and report.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark, before = df.sparkSession, batches_before(df.sparkSession, f"{path}/buffer", number)
        rows = df if before is None else df.unionByName(spark.read.schema(df.schema).parquet(f"{path}/buffer/batch={before}"))
        write_batch(rows.orderBy(F.desc(at), F.desc(key)).limit(last), f"{path}/buffer", number)
        write_batch(report(spark.read.schema(df.schema).parquet(f"{path}/buffer/batch={number}")), f"{path}/report", number)

    return _started(joined, batch, checkpoint, every)


def start_drift_monitor(stream: DataFrame, features: list[str], order: list[str], path: str, checkpoint: str, *, size: int = 500, every: str | None = None):
    """Every `size` rows of a stream, in the order of their batches and within a batch by `order`, against the `size` before; drifting signals are kept.

    Between batches lie the last full window and the rows after it, with their places. A batch that is tried again replaces its own.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark, before = df.sparkSession, batches_before(df.sparkSession, f"{path}/carry", number)
        new, _ = drift.numbered(written(df.select(*dict.fromkeys([*order, *features])), "batch"), order, "_nth")
        schema = new.withColumn("_nth", F.col("_nth").cast("long")).schema
        done = 0
        if before is not None:
            carry = spark.read.schema(schema).parquet(f"{path}/carry/batch={before}")
            low, high = carry.agg(F.min("_nth"), F.max("_nth")).first()
            if high is not None:
                new = new.withColumn("_nth", F.col("_nth") + (high + 1)).unionByName(carry)
                done = (high + 1) // size
        rows = written(new.withColumn("_nth", F.col("_nth").cast("long")), "rows")
        full = ((rows.agg(F.max("_nth")).first()[0] if not rows.isEmpty() else -1) + 1) // size
        write_batch(rows.where(F.col("_nth") >= max(0, full - 1) * size), f"{path}/carry", number)
        w = rows.withColumn("win", F.floor(F.col("_nth") / size).cast("long")).where(F.col("win") < full).drop("_nth", *[c for c in order if c not in features])
        ref, cur = w.withColumn("win", F.col("win") + 1), w
        new_windows = lambda d: d.where((F.col("win") >= max(1, done)) & (F.col("win") < full))
        found = drift.signals(new_windows(ref), new_windows(cur), features, by="win", size=size).where("is_drifting")
        write_batch(found.withColumn("window_size", F.lit(size)), f"{path}/events", number)

    return _started(stream, batch, checkpoint, every)


def start_notices(decisions: DataFrame, features: list[str], score: Callable, background: dict[str, float], path: str, checkpoint: str, *, every: str | None = None):
    """The notices of reasons for the denied decisions of a stream, by batch."""

    def batch(df: DataFrame, number: int) -> None:
        write_batch(decide.notices(df, features, score, background), path, number)

    return _started(decisions, batch, checkpoint, every)
