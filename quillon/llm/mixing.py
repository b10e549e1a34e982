"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies, its source's target over its
source's size. Within a source the expected copies are summed up in a fixed
order, one random offset is added, and a document is emitted once for each
integer that the running sum crosses. Documents go in the order of their sizes,
so that a source's mix misses its target by no more than about its longest
document.

The running sum is a rank times a rate. Ranks come from pre-aggregated counts
(source, size, bucket), so that no window ever holds a hot source or a large
group of equally long documents: only the rows of one bucket are sorted together.

Defined results: a null text counts 0 words; a null source is a source of its own
and comes last; a source without words has target 0 and takes nothing; rows that
are alike in every ordering column are interchangeable; an empty table gives an
empty result. Columns of the input keep their names and values; the added ones
are named by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.tables import SPACE_WORDS, table

WEIGHTS = (5, 2, 1)
MOST = 3.0
BUCKETS = 1024
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORDS)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Orders sources by code point (UTF-8 bytes sort alike), null last, and tells null from ''."""
    return F.when(source.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), source))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source of sizes(key, source_size): its weight, target and rate (expected copies).

    The targets are the water level at which the uncapped sources share by weight
    what the capped ones leave: with sources in the order of cap over weight, the
    first k are capped for the smallest k that keeps all others below their caps.
    """
    order = Window.orderBy("key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    d = sizes.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size").cast("double"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    d = d.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    d = d.withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    d = d.withColumn("water", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    d = d.withColumn("target", F.when(F.col("water").isNull() | (F.col("cap") <= F.col("water") * F.col("weight")), F.col("cap")).otherwise(F.col("water") * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    return d.select("key", "source_size", "target", rate.alias("rate"))


def mix(
    docs: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    size: str | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    most: float = MOST,
    buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """All columns of docs under `doc`, and size, source_size, target, rate, copies.

    size names a column that already has the number of words; docs then needs no text, and
    the shuffles carry as little as docs has.
    """
    ident = F.col(doc_id).cast("long")
    words = F.col(size).cast("long") if size else n_words(F.col(text))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _source_key(F.col(source)).alias("key"), words.alias("size"), F.pmod(F.coalesce(ident, F.lit(0)), F.lit(buckets)).cast("int").alias("bucket"), ident.alias("ident"))
    slim = docs.select(_source_key(F.col(source)).alias("key"), words.alias("size"), F.pmod(F.coalesce(ident, F.lit(0)), F.lit(buckets)).cast("int").alias("bucket"))
    cells = slim.groupBy("key", "size", "bucket").agg(F.count("*").alias("n"))
    by_size = cells.groupBy("key", "size").agg(F.sum("n").alias("n_size"))
    targets = source_targets(by_size.groupBy("key").agg(F.sum(F.col("n_size") * F.col("size")).alias("source_size")), weights, most)
    running = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("key", "size", F.coalesce(F.sum("n_size").over(running("key").orderBy("size")), F.lit(0)).alias("shorter"))
    cells = cells.withColumn("earlier", F.coalesce(F.sum("n").over(running("key", "size").orderBy("bucket")), F.lit(0)))
    starts = cells.join(by_size, ["key", "size"]).join(targets, "key").withColumn("first", F.col("shorter") + F.col("earlier"))
    starts = starts.select("key", "size", "bucket", "first", "source_size", "target", "rate")
    within = Window.partitionBy("key", "size", "bucket").orderBy(F.col("ident").asc_nulls_first())
    d = d.withColumn("nth", F.row_number().over(within)).join(starts, ["key", "size", "bucket"])
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    k = (F.col("first") + F.col("nth")).cast("double")
    copies = F.floor(offset + k * F.col("rate")) - F.floor(offset + (k - 1.0) * F.col("rate"))
    return d.select("doc", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, each document as often as it is taken, and which copy it is."""
    copy = next(n for n in ("copy", *(f"copy_{i}" for i in range(1, 10**6))) if n not in docs.columns)
    m = mix(docs, **options).where("copies > 0")
    return m.select("doc.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words"))
    m = mix(sized, size="words")
    return m.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: Same ranks by one sort of each source, as DuckDB has no hot groups to fear here.
MIX_SQL = r"""
WITH sized AS (
  SELECT *, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ((coalesce(doc_id, 0) % 1024) + 1024) % 1024 AS bucket
  FROM {docs}),
sources AS (
  SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY encode(key)) - 1) % 3 + 1)::INT] AS weight,
         3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM sources),
leveled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
water AS (
  SELECT (SELECT level FROM leveled WHERE cap > level * weight ORDER BY cap / weight, key LIMIT 1) AS w),
targets AS (
  SELECT key, source_size, CASE WHEN w IS NULL OR cap <= w * weight THEN cap ELSE w * weight END AS target FROM leveled, water),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix-1:' || key), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start FROM targets),
ranked AS (
  SELECT s.*, r.source_size, r.target, r.rate, r.start,
         (row_number() OVER (PARTITION BY s.key ORDER BY s.size, s.bucket, s.doc_id NULLS FIRST))::DOUBLE AS k
  FROM sized s JOIN rated r USING (key)),
mixed AS (
  SELECT *, (floor(start + k * rate) - floor(start + (k - 1.0::DOUBLE) * rate))::BIGINT AS copies FROM ranked)
"""

OP9_SQL = MIX_SQL.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM mixed"
