"""Running sums, ranks, quantiles and bins over whole columns, without a window over all rows.

Rows are first added up by distinct value; running sums of the counts are those of carry.running, over range
partitions of all groups together. The axes of a rank correlation are cut at their own quantiles, as many as their size asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from math import ceil
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.carry import cuts, in_pieces, pieces_of, running
from quillon.sources.storage import written

#: Points of an axis that one bucket holds.
LARGEST = 1_000_000
#: Cuts of one group, and buckets of each axis of a rank correlation, at most.
MOST_CUTS = 2048
#: Groups up to which a table of one row per group is handed to every task.
FEW_GROUPS = 10_000
#: Pieces in which places are looked for, as a multiple of those of running sums, and sampled rows of each.
FINER, PER_PIECE = 8, 4


def _cut(df: DataFrame, order: str, by: list[str], largest: int) -> DataFrame | None:
    """df with _bucket, ascending in `order`; None where no group is larger than `largest`."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= largest:
        return None
    n = min(MOST_CUTS, ceil(2 * most / largest))
    x = F.col(order).cast("double")
    cuts = F.array_sort(F.array_distinct(F.percentile_approx(x, F.array(*[F.lit(i / n) for i in range(1, n)]), 10 * n))).alias("_cuts")
    big = df.groupBy(*by).agg(F.count("*").alias("_n"), cuts).where(F.col("_n") > largest).drop("_n")
    d = df.join(big, by, "left") if by else df.join(big)
    return d.withColumn("_bucket", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= x))).drop("_cuts")


def prefix_sum(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), pieces: int | None = None) -> DataFrame:
    """df with cum_<c> for each of sums: the total of c over rows of the same `by` up to this one's `order`.

    df has one row for each (by, order), orders without nulls. It is read several times: callers write what is dear.
    """
    return running(df, by, [order], sums={f"cum_{c}": c for c in sums}, pieces=pieces)


def value_counts(df: DataFrame, column: str, by: Sequence[str] = (), sums: Sequence[Column] = ()) -> DataFrame:
    """(by, x, n, sums): the distinct values that are numbers, and how often they are; written once, as it is read often."""
    x = F.col(column).cast("double")
    return written(df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by, x.alias("x")).agg(F.count("*").alias("n"), *sums), "counts")


def quantile_edges(counts: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, total, edges): quantiles by linear interpolation of value_counts, ascending and without repeats; written, as they are read often."""
    by = list(by)
    keys, n = [*by, "_piece"], FINER * pieces_of(counts)
    counts = counts.select(*by, "x", "n")
    cut = in_pieces(counts, [*by, "x"], n, cuts(counts, [*by, "x"], n, PER_PIECE))
    at = [F.lit(float(q)) * (F.col("total") - 1) for q in probabilities]
    places = {f"{end}{i}": rounded(a) for i, a in enumerate(at) for end, rounded in (("low", F.floor), ("high", F.ceil))}
    there = lambda after, size: {c: (after > F.col(f"at_{c}")) & (after - size <= F.col(f"at_{c}")) for c in places}
    # only pieces that hold a place are put in order
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    sizes = cut.groupBy(*keys).agg(F.sum("n").alias("size"))
    sizes = sizes.withColumns({"total": F.sum("size").over(group), "after": F.sum("size").over(group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0))})
    sizes = sizes.withColumns({f"at_{c}": place for c, place in places.items()})
    held = written(sizes.where(reduce(or_, there(F.col("after"), F.col("size")).values())), "pieces")
    run = F.sum("n").over(Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    d = joined_by(cut, held, keys).withColumn("cum_n", F.col("after") - F.col("size") + run)
    there = there(F.col("cum_n"), F.col("n"))
    e = d.groupBy(*by).agg(F.first("total").alias("total"), *[F.min(F.when(here, F.col("x"))).alias(c) for c, here in there.items()])
    edges = F.array(*[F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (a - F.floor(a)) for i, a in enumerate(at)])
    return written(e.select(*by, "total", F.array_sort(F.array_distinct(edges)).alias("edges")), "edges")


def steps(n_bins: int) -> list[float]:
    return [i / n_bins for i in range(n_bins + 1)]


def _passed(edges: Column, n_bins: int, passes: Callable[[Column], Column]) -> Column:
    """How many of the interior edges `passes` holds for: the first so many, of at most n_bins - 1. A tree of conditions, as Spark interprets lambdas."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        inside = F.size(edges) - 1 > mid + 1
        return F.when(inside & passes(F.get(edges, F.lit(mid + 1))), among(mid + 1, high)).otherwise(among(low, mid))

    return among(0, n_bins - 1)


def bin_right_closed(x: Column, edges: Column, n_bins: int) -> Column:
    """Bin of (a, b] intervals, the lowest edge included: how many interior edges are below x. At most n_bins + 1 edges."""
    return _passed(edges, n_bins, lambda e: e < x)


def bin_open(x: Column, edges: Column, n_bins: int) -> Column:
    """Bin of [a, b) intervals, the first and the last open outwards."""
    return _passed(edges, n_bins, lambda e: e <= x)


def bin_left_closed(x: Column, edges: Column, n_bins: int) -> Column:
    """Bin of [a, b) intervals, the last closed; null outside."""
    inside = (x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, -1))
    return F.when(inside, bin_open(x, edges, n_bins))


def joined_by(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with the columns of one row per group, a written table; of one row in all where there are no groups.

    A shuffle by few groups would put the rows of each in one task, so up to FEW_GROUPS rows are broadcast; more groups are dealt out by key.
    """
    if not by:
        return df.join(F.broadcast(small))
    return df.join(F.broadcast(small) if small.count() <= FEW_GROUPS else small, list(by))


def qcut(df: DataFrame, column: str, n_bins: int, by: Sequence[str] = (), out: str = "bin") -> DataFrame:
    """df with its quantile bin of `column`; rows without a number are left out."""
    counts = value_counts(df, column, by)
    edges = quantile_edges(counts, steps(n_bins), by).select(*by, "edges")
    x = F.col(column).cast("double")
    return joined_by(df.where(x.isNotNull() & ~F.isnan(x)), edges, by).withColumn(out, bin_right_closed(x, F.col("edges"), n_bins)).drop("edges")


def average_ranks(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """value_counts with the average rank of each value's rows (1-based)."""
    return prefix_sum(counts, "x", ["n"], by).withColumn("rank", F.col("cum_n") - (F.col("n") - 1) / 2.0)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows where both are known; null where either does not vary."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of two columns by group, average ranks for ties; for small tables such as bins."""
    part = lambda c: Window.partitionBy(*by).orderBy(c) if by else Window.partitionBy(F.lit(1)).orderBy(c)
    same = lambda c: Window.partitionBy(*by, c)
    rank = lambda c: F.rank().over(part(c)) + (F.count("*").over(same(c)) - 1) / 2.0
    return df.withColumn("_rx", rank(x)).withColumn("_ry", rank(y)).groupBy(*by).agg(correlation(F.col("_rx"), F.col("_ry")).alias("spearman"))


_PAIRS = "concordant decimal(38,0), discordant decimal(38,0)"


def _ordered_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """Concordant and discordant pairs of weighted points.

    Two ranks of x differ first at one binary digit: for each digit, points that agree on the digits above
    form a group, and each with digit 1 meets the group's points with digit 0 and a smaller (larger) y.
    """
    rank, height = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    order = np.argsort(height, kind="stable")
    rank, height, n = rank[order], height[order], n[order].astype(object if n.sum() > 3_000_000_000 else np.int64)
    more = less = 0
    for level in range(int(rank.max(initial=0)).bit_length()):
        group = rank >> (level + 1)
        at = np.argsort(group, kind="stable")
        g, h, one = group[at], height[at], (rank[at] >> level) & 1 == 1
        low = np.where(one, 0, n[at])
        below = np.concatenate([[0], np.cumsum(low)])
        first, end = np.searchsorted(g, g, "left"), np.searchsorted(g, g, "right")
        # rows of one group and height lie together: what is below starts before them, what is above after them
        run = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])]))
        stop = np.append(run[1:], len(g))
        lengths = stop - run
        run, stop = np.repeat(run, lengths), np.repeat(stop, lengths)
        more += int((n[at] * (below[run] - below[first]))[one].sum())
        less += int((n[at] * (below[end] - below[stop]))[one].sum())
    return more, less


def kendall_tau(df: DataFrame, x: str, y: str, largest: int = LARGEST) -> DataFrame:
    """tau-b of two columns, exact: n, concordant, discordant, tau.

    Both axes are cut into buckets of about `largest` points. Pairs within one bucket of x are counted where it lies, pairs
    within one bucket of y but of different buckets of x likewise, and all others follow from the counts of the
    grid's cells. Two shuffles of the distinct points; no task holds more than a bucket (equal values are not cut apart).
    """
    clean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = written(clean.groupBy("x", "y").agg(F.count("*").alias("n")), "points")
    bucketed = cells
    for c in ("x", "y"):
        cut = _cut(bucketed, c, [], largest)
        bucketed = (bucketed.withColumn("_bucket", F.lit(0)) if cut is None else cut).withColumnRenamed("_bucket", f"b{c}")

    def count(by: str, first: str) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            more, less = _ordered_pairs(*(table.column(c).to_numpy() for c in (first, "y", "n")))
            return pa.table({"concordant": pa.array([more], pa.decimal128(38, 0)), "discordant": pa.array([less], pa.decimal128(38, 0))})

        return bucketed.select(by, *dict.fromkeys([first, "y", "n"])).groupBy(by).applyInArrow(run, _PAIRS)

    grid = bucketed.groupBy("bx", "by").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    parts = count("bx", "x")
    if grid.limit(2).count() > 1:
        # cells of smaller x: running sums over y by bucket of x, then over x
        parts = parts.unionAll(count("by", "bx")).unionAll(_grid_pairs(grid))
    pairs = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("concordant", "discordant")])
    tied = lambda k: cells.groupBy(k).agg(F.sum("n").cast("decimal(19,0)").alias("m")).agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - 1)).cast("double") / 2, F.lit(0.0)).alias(f"ties_{k}"))
    n = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    one = n.join(F.broadcast(pairs)).join(F.broadcast(tied("x"))).join(F.broadcast(tied("y")))
    all_pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    below = F.sqrt((all_pairs - F.col("ties_x")) * (all_pairs - F.col("ties_y")))
    return one.select("n", F.col("concordant").cast("decimal(38,0)").cast("long").alias("concordant"), F.col("discordant").cast("decimal(38,0)").cast("long").alias("discordant"), F.try_divide((F.col("concordant") - F.col("discordant")).cast("double"), below).alias("tau"))


def _grid_pairs(grid: DataFrame) -> DataFrame:
    """Pairs of rows in cells that differ in both buckets; the grid has MOST_CUTS squared cells at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.table(b) for b in batches]
        if tables:
            t = pa.concat_tables(tables)
            counts = np.array([int(v) for v in t.column("n").to_pylist()], object)
            bx, by = t.column("bx").to_numpy(), t.column("by").to_numpy()
            m = np.zeros((int(bx.max()) + 1, int(by.max()) + 1), object)
            m[bx, by] = counts
            left = np.cumsum(m, axis=0) - m
            below, above = np.cumsum(left, axis=1) - left, np.cumsum(left[:, ::-1], axis=1)[:, ::-1] - left
            yield pa.RecordBatch.from_arrays([pa.array([int((m * below).sum())], pa.decimal128(38, 0)), pa.array([int((m * above).sum())], pa.decimal128(38, 0))], ["concordant", "discordant"])

    return grid.coalesce(1).mapInArrow(run, _PAIRS)
