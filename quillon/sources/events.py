"""Streams of transactions, decisions and outcomes: schemas, parsing, quality rules, routing, high-water marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSACTION = "event_id string, customer_id string, timestamp_ms long, amount double, mcc int, merchant_id string, geo_lat double, geo_lon double, is_card_present boolean, current_balance double, credit_limit double, segment_id int, credit_score int, annual_income double, account_tenure_months int, n_products int, prev_delinquency_count int, payload_version int"
OUTCOME = "decision_id string, customer_id string, timestamp_ms long, accepted boolean, defaulted boolean, spend double, profit double"
DRIFT_EVENT = "win long, detector string, feature string, statistic double, threshold double, is_drifting boolean"
WATERMARK = "10 seconds"
LIVE_SECONDS = 300


def event_time(ms: Column) -> Column:
    """Whole seconds of a time in milliseconds; the rest is dropped."""
    return F.timestamp_seconds(F.floor(ms / 1000))


def iso_millis(text: Column) -> Column:
    return F.unix_millis(F.to_timestamp(text))


def kafka(spark: SparkSession, servers: str, topic: str, start: str = "latest") -> DataFrame:
    """A topic as a stream of value strings."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).load().select(F.col("key").cast("string"), F.col("value").cast("string"))


def files(spark: SparkSession, path: str, schema: str, kind: str = "parquet", *, stream: bool = True, per_batch: int | None = None) -> DataFrame:
    """A folder of files as a stream or, for back-fills and tests, as a table."""
    reader = (spark.readStream if stream else spark.read).schema(schema)
    if stream and per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.format(kind).load(path)


def parse_transactions(raw: DataFrame, value: str = "value", watermark: str | None = WATERMARK) -> DataFrame:
    """Transactions from JSON records with their event time and, on streams, the watermark."""
    d = raw.select(F.from_json(F.col(value), TRANSACTION).alias("t")).select("t.*").withColumn("event_time", event_time(F.col("timestamp_ms")))
    return d.withWatermark("event_time", watermark) if watermark and d.isStreaming else d


def sink(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Records (key, value) to a topic."""
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


#: The rules that a transaction has to keep, by name.
RULES = {
    "amount": "amount > 0",
    "segment_id": "segment_id BETWEEN 0 AND 5",
    "credit_limit": "credit_limit > 0",
    "balance_negative": "current_balance >= 0",
    "balance_over_limit": "current_balance <= credit_limit * 1.01",
    "geo_lat": "geo_lat BETWEEN -90 AND 90",
    "geo_lon": "geo_lon BETWEEN -180 AND 180",
    "timestamp": "event_time IS NOT NULL",
    "credit_score": "credit_score BETWEEN 300 AND 850",
    "annual_income": "annual_income > 0",
    "account_tenure_months": "account_tenure_months BETWEEN 0 AND 360",
    "n_products": "n_products BETWEEN 0 AND 10",
    "prev_delinquency_count": "prev_delinquency_count BETWEEN 0 AND 20",
}


def check(df: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """df with `violations`, the names of the rules that a row breaks; unknown values break them."""
    rules = RULES if rules is None else rules
    broken = F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items()])
    return df.withColumn("violations", F.filter(broken, lambda x: x.isNotNull()))


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") > 0)


def violation_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def route(df: DataFrame, now: Column, at: str = "event_time") -> DataFrame:
    """df with the topic of each event: live if younger than LIVE_SECONDS, else historical."""
    age = F.expr(f"timestampdiff(SECOND, {at}, _now)")
    d = df.withColumn("_now", now)
    return d.withColumn("topic", F.when(age < LIVE_SECONDS, "transactions-live").otherwise("transactions-historical")).drop("_now")


def live_and_historical(live: DataFrame, historical: DataFrame, at: str = "event_time", live_delay: str = WATERMARK, historical_delay: str = "30 days") -> DataFrame:
    """Both streams, each with a watermark of its own; the slower one holds the whole back."""
    return live.withWatermark(at, live_delay).unionByName(historical.withWatermark(at, historical_delay))


def newer_than(df: DataFrame, mark: DataFrame, at: str = "published_at", kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items newer than the stored mark, the mark to store next); the mark is one row, or none at first."""
    best = mark.agg(F.max("mark").alias("_mark"))
    d = df if kind is None else df.where(F.col("kind") == kind)
    d = d.join(F.broadcast(best)).where(F.col("_mark").isNull() | (F.col(at) > F.col("_mark"))).drop("_mark")
    return d, d.agg(F.max(at).alias("mark")).unionByName(mark.select("mark")).agg(F.max("mark").alias("mark"))


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])
