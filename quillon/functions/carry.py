"""Running values by key over range partitions: the last known value, sums and maxima up to a row.

A window by key holds a key's rows in one task, however many they are. Here rows are cut into pieces of about
equal size by key and order; a window runs within a key's part of a piece, and what the key's earlier pieces come
to is carried over. Only the keys that a cut runs through have more than one piece, so the table of what is
carried has at most two rows a piece, whatever the data; it is broadcast. As-of joins, lags,
running sums, places and records over all rows share it.

The cuts come from a sample of the rows, those with small hashes, whose share follows from a count. They are a
function of the rows' values alone, so that every reading of them is the same. They steer balance only: any cuts give the same
results. All of it is one lazy plan, in which no job runs before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows a piece.
PER_PIECE = 16


def pieces_of(df: DataFrame) -> int:
    """Pieces that rows are cut into: two a shuffle partition, which grows with the cluster and its data."""
    return max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def cuts(source: DataFrame, columns: Sequence[str], n: int, per_piece: int = PER_PIECE) -> DataFrame:
    """One row: _cuts, fewer than n + 1 ascending structs of the columns, between which rows are about as many."""
    at = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    share = F.least(F.lit(1.0), F.lit(float(per_piece * n)) / F.greatest(F.col("_rows"), F.lit(1)))
    part = F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = source.select(*columns).join(F.broadcast(source.agg(F.count("*").alias("_rows"))), part < share)
    found = sample.agg(F.array_sort(F.collect_list(at)).alias("_all"))
    size = F.size("_all")
    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.floor(i * size / n).cast("int")))
    return found.select(F.when(size > 0, F.array_distinct(F.transform(places, lambda i: F.get("_all", i)))).otherwise(F.slice("_all", 1, 0)).alias("_cuts"))


def in_pieces(df: DataFrame, columns: Sequence[str], n: int, bounds: DataFrame) -> DataFrame:
    """df with _piece, how many cuts are at or below the row: by bisection, a column a step, as Spark compiles columns and interprets lambdas."""
    return _pieces(df, columns, n, bounds).drop("_x", "_cuts")


def _pieces(df: DataFrame, columns: Sequence[str], n: int, bounds: DataFrame) -> DataFrame:
    d = df.withColumn("_x", F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])).join(F.broadcast(bounds)).withColumn("_piece", F.lit(0))
    for bit in range(n.bit_length() - 1, -1, -1):
        p, step = F.col("_piece"), 1 << bit
        d = d.withColumn("_piece", p + F.when(F.get("_cuts", p + (step - 1)) <= F.col("_x"), step).otherwise(0))
    return d


def _cut(df: DataFrame, bounds: DataFrame, key: int, columns: Sequence[str], n: int) -> DataFrame:
    """df with _piece and _shared: may its key, the first `key` of columns, have rows in other pieces?"""
    d = _pieces(df, columns, n, bounds)
    low, high = F.get("_cuts", F.col("_piece") - 1), F.get("_cuts", F.col("_piece"))
    same = lambda c: c.isNotNull() & _all([c[f"_{i}"].eqNullSafe(F.col(f"_x._{i}")) for i in range(key)])
    return d.withColumn("_shared", same(low) | same(high)).drop("_x", "_cuts")


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def running(
    df: DataFrame, by: Sequence[str], order: Sequence[str], *, last: Mapping[str, str] | None = None, sums: Mapping[str, str] | None = None, most: Mapping[str, str] | None = None, own: bool = True,
    source: DataFrame | None = None, pieces: int | None = None,
) -> DataFrame:
    """df with, for each out: column, the last value that is not null, the sum or the maximum over the key's rows before each row (with it, if own).

    source: rows to take the cuts from instead of df, where df is dear: by and the first columns of order,
    or more of them. Rows that are alike in all of order are in no particular order. Sums of no rows are 0.
    """
    last, sums, most = dict(last or {}), dict(sums or {}), dict(most or {})
    by, order, n = list(by), list(order), pieces or pieces_of(df)
    source = df if source is None else source
    columns = [*by, *[c for c in order if c in source.columns]] if source is not df else [*by, *order]
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*columns).schema.fields}
    bounds = cuts(source.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns]), columns, n)
    d = _cut(df, bounds, len(by), columns, n)
    shared = df
    if by:
        # only keys that cuts run through: their filter goes below what made df
        keys = bounds.select(F.explode("_cuts").alias("_c")).select(*[F.col(f"_c._{i}").alias(f"_k{i}") for i in range(len(by))]).distinct()
        shared = df.join(F.broadcast(keys), _all([F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]), "left_semi")
    found = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_{out}") for out, c in last.items()]
    found += [F.sum(c).alias(f"_{out}") for out, c in sums.items()] + [F.max(c).alias(f"_{out}") for out, c in most.items()]
    outs = [*last, *sums, *most]
    # every piece of a key that a cut runs through is shared
    totals = _cut(shared, bounds, len(by), columns, n).groupBy(*by, "_piece").agg(*found)
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = part.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    over = {out: F.last(f"_{out}", ignorenulls=True) for out in last} | {out: F.sum(f"_{out}") for out in sums} | {out: F.max(f"_{out}") for out in most}
    carried = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_piece").alias("_of"), *[over[out].over(before).alias(f"_{out}") for out in outs])
    w = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    d = d.withColumns({out: F.last(c, ignorenulls=True).over(w) for out, c in last.items()} | {out: F.sum(c).over(w) for out, c in sums.items()} | {out: F.max(c).over(w) for out, c in most.items()})
    d = d.join(F.broadcast(carried), _all([F.col("_shared"), F.col("_piece") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]]), "left")
    joined = {out: F.coalesce(out, f"_{out}") for out in last} | {out: F.coalesce(F.col(out), F.lit(0)) + F.coalesce(F.col(f"_{out}"), F.lit(0)) for out in sums} | {out: F.greatest(out, f"_{out}") for out in most}
    return d.withColumns(joined).drop("_piece", "_shared", "_of", *[f"_k{i}" for i in range(len(by))], *[f"_{out}" for out in outs])
