"""The given tables seen as card transactions, decisions, scores and vintages.

events become transactions of customers; orders and lineitem become logged decisions with their
rewards; lineitem becomes scored accounts; customers with their orders become vintages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Merchant category codes by index; fixed values.
MCC_CODES = (5411, 5812, 5541, 5311, 5912, 5651, 4900, 4814, 7011, 6010, 5999, 0)
CREDIT_LIMIT = 1000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: str):
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, nation = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    return c.select(
        k.alias("customer_id"),
        (k % 6).cast("int").alias("segment_id"),
        (500 + k * 37 % 300).cast("int").alias("credit_score"),
        (F.col("c_acctbal") + 20000.0).alias("annual_income"),
        (k * 7 % 240).cast("int").alias("account_tenure_months"),
        (nation % 5 + 1).cast("int").alias("n_products"),
        (k % 4).cast("int").alias("prev_delinquency_count"),
    )


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth behaviour of each customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("customer_id"),
        (k % 6).cast("int").alias("segment_id"),
        (0.05 + (k * 13 % 80) / 100.0).alias("true_p_accept_cli"),
        (50.0 + (k * 17 % 400)).alias("true_delta_spend_monthly"),
        (0.01 + (k * 29 % 20) / 100.0).alias("true_p_default"),
        (F.lit(500.0) + (k * 31 % 50) * 100.0).alias("credit_limit"),
    )


def events_as_transactions(events: DataFrame) -> DataFrame:
    """The transaction's own columns, from rows of events; usable on streams."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    e = F.col("event_id")
    return events.select(
        e.alias("event_id"),
        F.col("user_id").alias("customer_id"),
        F.date_trunc("second", "ts").cast(events.schema["ts"].dataType).alias("event_time"),
        F.col("value").alias("amount"),
        F.element_at(F.array(*[F.lit(m) for m in MCC_CODES]), k % len(MCC_CODES) + 1).alias("mcc"),
        F.col("value").alias("current_balance"),
        F.lit(CREDIT_LIMIT).alias("credit_limit"),
        ((e * 7919 % 18001) / 100.0 - 90).alias("geo_lat"),
        ((e * 104729 % 36001) / 100.0 - 180).alias("geo_lon"),
        (F.col("user_id") % 6).cast("int").alias("segment_id"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_transactions(table(spark, sf_dir, "events"))


def transactions_with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).join(customers(spark, sf_dir).drop("segment_id"), "customer_id")


def scored_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary outcomes and scores with heavy ties, and two groups."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        ((F.col("l_quantity") * 7 + F.col("l_linenumber")) / 400.0).alias("p"),
        F.col("l_linestatus").alias("grp"),
        (F.col("l_suppkey") % 4).cast("int").alias("segment"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_shipdate").alias("ts"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: PD, balance, limit and segment of an account."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("account_id"),
        F.col("o_custkey").alias("customer_id"),
        (0.01 + (k * 31 % 97) / 400.0).alias("pd"),
        (F.col("o_totalprice") / 100.0).alias("current_balance"),
        (F.col("o_totalprice") / 100.0 * (1.0 + (k % 7) / 4.0)).alias("credit_limit"),
        (k % 6).cast("int").alias("segment"),
        (20000.0 + k * 13 % 50000).alias("annual_income"),
        ((k * 11 % 100) / 100.0).alias("utilization"),
        ((k * 19 % 100) / 100.0).alias("paydown_rate_30d"),
        (k % 4).cast("double").alias("prev_delinquency_count"),
        (500.0 + k * 37 % 300).alias("credit_score"),
        (F.col("o_orderstatus") == "F").cast("int").alias("defaulted"),
        (k % 12 + 1).cast("int").alias("default_month"),
        F.col("o_orderdate").alias("originated"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged decisions: action, propensity, reward and what a new policy would do; one row per order."""
    rewards = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("reward"))
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d = o.join(rewards, "o_orderkey")
    return d.select(
        k.alias("decision_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("ts"),
        (k % 3).cast("int").alias("action"),
        F.lit(1.0 / 3.0).alias("propensity"),
        F.col("reward"),
        (F.col("o_custkey") % 3).cast("int").alias("new_action"),
        (F.col("o_totalprice") / 100.0).alias("mu_new"),
        (F.col("o_totalprice") / 120.0).alias("mu_logged"),
        F.when(k % 5 == 0, "challenger").otherwise("champion").alias("alias"),
        (F.col("o_custkey") % 6).cast("int").alias("segment_id"),
        (k * 37 % 1000 / 10.0).alias("latency_ms"),
        (k % 83 == 0).alias("is_error"),
        ((F.col("o_custkey") * 11 % 100) / 100.0).alias("utilization"),
        (k % 40).cast("double").alias("velocity_24h"),
        ((k * 19 % 100) / 100.0).alias("paydown_rate_30d"),
        ((k * 7 % 100) / 100.0).alias("fraud_score"),
    )


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' first order, whether an order of theirs ended in F, and how many months later the first did."""
    o = table(spark, sf_dir, "orders")
    d = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("origination_date"), F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("default_date"))
    months = (F.year("default_date") - F.year("origination_date")) * 12 + F.month("default_date") - F.month("origination_date")
    return d.select(F.col("o_custkey").alias("customer_id"), "origination_date", F.col("default_date").isNotNull().cast("int").alias("defaulted"), (months + 1).alias("default_month"))


TX_SQL = """tx AS (
  SELECT event_id, user_id AS customer_id, date_trunc('second', ts) AS event_time, value AS amount,
         [5411, 5812, 5541, 5311, 5912, 5651, 4900, 4814, 7011, 6010, 5999, 0][coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) % 12 + 1] AS mcc,
         value AS current_balance, 1000.0::DOUBLE AS credit_limit,
         (event_id * 7919 % 18001) / 100.0::DOUBLE - 90 AS geo_lat, (event_id * 104729 % 36001) / 100.0::DOUBLE - 180 AS geo_lon,
         (user_id % 6)::INT AS segment_id
  FROM events)"""

CUSTOMERS_SQL = """cust AS (
  SELECT c_custkey AS customer_id, (c_custkey % 6)::INT AS segment_id, (500 + c_custkey * 37 % 300)::INT AS credit_score, c_acctbal + 20000.0::DOUBLE AS annual_income,
         (c_custkey * 7 % 240)::INT AS account_tenure_months, (c_nationkey % 5 + 1)::INT AS n_products, (c_custkey % 4)::INT AS prev_delinquency_count
  FROM customer)"""

PARAMETERS_SQL = """params AS (
  SELECT c_custkey AS customer_id, (c_custkey % 6)::INT AS segment_id, 0.05::DOUBLE + (c_custkey * 13 % 80) / 100.0::DOUBLE AS true_p_accept_cli,
         50.0::DOUBLE + (c_custkey * 17 % 400) AS true_delta_spend_monthly, 0.01::DOUBLE + (c_custkey * 29 % 20) / 100.0::DOUBLE AS true_p_default,
         500.0::DOUBLE + (c_custkey * 31 % 50) * 100.0::DOUBLE AS credit_limit
  FROM customer)"""

SCORED_SQL = """scored AS (
  SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::INT AS y, (l_quantity * 7 + l_linenumber) / 400.0::DOUBLE AS p, l_linestatus AS grp, (l_suppkey % 4)::INT AS segment,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_shipdate AS ts
  FROM lineitem)"""

ACCOUNTS_SQL = """acc AS (
  SELECT o_orderkey AS account_id, o_custkey AS customer_id, 0.01::DOUBLE + (o_orderkey * 31 % 97) / 400.0::DOUBLE AS pd,
         o_totalprice / 100.0::DOUBLE AS current_balance, o_totalprice / 100.0::DOUBLE * (1.0::DOUBLE + (o_orderkey % 7) / 4.0::DOUBLE) AS credit_limit,
         (o_orderkey % 6)::INT AS segment, 20000.0::DOUBLE + o_orderkey * 13 % 50000 AS annual_income, (o_orderkey * 11 % 100) / 100.0::DOUBLE AS utilization,
         (o_orderkey * 19 % 100) / 100.0::DOUBLE AS paydown_rate_30d, (o_orderkey % 4)::DOUBLE AS prev_delinquency_count, 500.0::DOUBLE + o_orderkey * 37 % 300 AS credit_score,
         (o_orderstatus = 'F')::INT AS defaulted, (o_orderkey % 12 + 1)::INT AS default_month, o_orderdate AS originated
  FROM orders)"""

DECISIONS_SQL = """rewards AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice * l_discount) AS reward FROM lineitem GROUP BY 1),
dec AS (
  SELECT o_orderkey AS decision_id, o_custkey AS customer_id, o_orderdate AS ts, (o_orderkey % 3)::INT AS action, 1.0::DOUBLE / 3.0::DOUBLE AS propensity, reward,
         (o_custkey % 3)::INT AS new_action, o_totalprice / 100.0::DOUBLE AS mu_new, o_totalprice / 120.0::DOUBLE AS mu_logged,
         CASE WHEN o_orderkey % 5 = 0 THEN 'challenger' ELSE 'champion' END AS alias, (o_custkey % 6)::INT AS segment_id, o_orderkey * 37 % 1000 / 10.0::DOUBLE AS latency_ms,
         o_orderkey % 83 = 0 AS is_error, (o_custkey * 11 % 100) / 100.0::DOUBLE AS utilization, (o_orderkey % 40)::DOUBLE AS velocity_24h,
         (o_orderkey * 19 % 100) / 100.0::DOUBLE AS paydown_rate_30d, (o_orderkey * 7 % 100) / 100.0::DOUBLE AS fraud_score
  FROM orders JOIN rewards USING (o_orderkey))"""

VINTAGES_SQL = """vint AS (
  SELECT o_custkey AS customer_id, min(o_orderdate) AS origination_date, min(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS default_date FROM orders GROUP BY 1),
vintage AS (
  SELECT customer_id, origination_date, (default_date IS NOT NULL)::INT AS defaulted,
         ((year(default_date) - year(origination_date)) * 12 + month(default_date) - month(origination_date) + 1)::INT AS default_month FROM vint)"""
