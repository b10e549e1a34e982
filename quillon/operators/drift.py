"""Drift between two samples of the same columns, and windows of a stream against the ones before.

Detectors take a reference and a current frame and give tidy rows: detector, feature, statistic,
threshold, is_drifting. Features are unpivoted and both samples aggregated in one pass; `by`
columns stratify.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import ranks as r
from quillon.functions.carry import running
from quillon.functions.special import kolmogorov_sf
from quillon.operators.risk import unpivot
from quillon.sources.storage import written

EPSILON = 1e-6
PSI, KS_P, JS, GAP, MISSING = 0.2, 0.05, 0.1, 0.15, 0.05
LEAST_ROWS = 30
JS_BINS = 20
#: Rows of a window and the one before that one task may hold.
MOST_IN_TASK = 1_000_000


def _long(ref: DataFrame, cur: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, feature, x, in_cur): both samples, one row for each feature."""
    side = lambda d, v: unpivot(d, features, [*[F.col(c) for c in by], F.lit(v).alias("in_cur")])
    return side(ref, 0).unionByName(side(cur, 1))


def _counts(ref: DataFrame, cur: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, feature, x, n_ref, n_cur): distinct values that are numbers, written once; what every detector but missingness starts from."""
    x = F.col("x")
    d = _long(ref, cur, features, by).where(x.isNotNull() & ~F.isnan(x))
    return written(d.groupBy(*by, "feature", "x").agg(F.count(F.when(F.col("in_cur") == 0, 1)).alias("n_ref"), F.count(F.when(F.col("in_cur") == 1, 1)).alias("n_cur")), "counts")


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def _signal(d: DataFrame, by: Sequence[str], name: str, statistic: Column, threshold: float, drifting: Column | None = None) -> DataFrame:
    label = F.col("feature")
    if by:
        label = F.concat(label, F.lit("@segment_"), F.concat_ws("_", *[F.col(c).cast("string") for c in by]))
    d = d.withColumn("statistic", statistic)
    return d.select(F.lit(name).alias("detector"), label.alias("feature"), "statistic", F.lit(threshold).alias("threshold"), F.coalesce((F.col("statistic") > threshold) if drifting is None else drifting, F.lit(False)).alias("is_drifting"))


def _reference_edges(counts: DataFrame, by: list[str], n_bins: int) -> DataFrame:
    ref = counts.where("n_ref > 0").select(*by, "feature", "x", F.col("n_ref").alias("n"))
    return r.quantile_edges(ref, r.steps(n_bins), [*by, "feature"])


def _psi_rows(binned: DataFrame, keys: list[str], smooth) -> DataFrame:
    """Sum of (q - p) ln(q / p) over bins; binned has n_ref and n_cur by bin, and empty bins of either sample count."""
    total = Window.partitionBy(*keys)
    share = lambda c: smooth(F.col(c) / F.greatest(F.sum(c).over(total), F.lit(1)))
    d = binned.withColumn("p", share("n_ref")).withColumn("q", share("n_cur"))
    return d.groupBy(*keys).agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"), F.sum("n_ref").alias("ref"), F.sum("n_cur").alias("cur"))


def psi(ref: DataFrame, cur: DataFrame, features: Sequence[str], *, by: Sequence[str] = (), n_bins: int = 10, threshold: float = PSI, counts: DataFrame | None = None) -> DataFrame:
    """Population stability over the reference's quantile bins [a, b), the last closed; values outside are ignored. 0 without data or with one distinct edge."""
    by = list(by)
    keys = [*by, "feature"]
    counts = _counts(ref, cur, features, by) if counts is None else counts
    edges = _reference_edges(counts, by, n_bins)
    d = r.joined_by(counts, edges.select(*keys, "edges"), keys).withColumn("bin", r.bin_left_closed(F.col("x"), F.col("edges"), n_bins))
    bins = d.where("bin is not null").groupBy(*keys, "bin").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"), F.max(F.size("edges")).alias("n_edges"))
    spine = edges.where("size(edges) > 1").select(*keys, F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    full = spine.join(bins, [*keys, "bin"], "left").fillna(0, ["n_ref", "n_cur"])
    out = _psi_rows(full, keys, lambda s: s + EPSILON)
    sizes = counts.groupBy(*keys).agg(F.sum("n_cur").alias("all_cur"))
    d = edges.select(*keys).join(out, keys, "left").join(sizes, keys)
    return _signal(d, by, "psi", F.when(F.col("all_cur") > 0, F.coalesce("psi", F.lit(0.0))).otherwise(0.0), threshold)


def csi_label(x: Column) -> Column:
    return F.when(x < 0.10, "stable").when(x < 0.25, "minor_shift").otherwise("major_shift")


def csi(ref: DataFrame, cur: DataFrame, features: Sequence[str], *, n_bins: int = 10) -> DataFrame:
    """Characteristic stability: as psi, but with open end bins and a floor on shares; feature, csi and class, largest first. Columns that either frame lacks or that are no numbers are skipped."""
    numeric = lambda d: {f.name for f in d.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")}
    features = [f for f in features if f in numeric(ref) & numeric(cur)]
    counts = _counts(ref, cur, features, [])
    edges = _reference_edges(counts, [], n_bins)
    d = r.joined_by(counts, edges.select("feature", "edges"), ["feature"]).withColumn("bin", r.bin_open(F.col("x"), F.col("edges"), n_bins))
    bins = d.groupBy("feature", "bin").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    spine = edges.select("feature", F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"))
    full = spine.join(bins, ["feature", "bin"], "left").fillna(0, ["n_ref", "n_cur"])
    out = _psi_rows(full, ["feature"], lambda s: F.greatest(s, F.lit(EPSILON)))
    return out.select("feature", F.col("psi").alias("csi"), csi_label(F.col("psi")).alias("classification"), "ref", "cur").orderBy(F.desc("csi"), "feature")


def csi_violations(report: DataFrame) -> DataFrame:
    """One line for each feature that is not stable."""
    return report.where("classification <> 'stable'").select("feature", F.format_string("%s: CSI=%.4f (%s)", "feature", "csi", "classification").alias("line"))


def ks(ref: DataFrame, cur: DataFrame, features: Sequence[str], *, by: Sequence[str] = (), threshold: float = KS_P, counts: DataFrame | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: the statistic is the asymptotic p-value, 1 below LEAST_ROWS rows; d is the distance."""
    by = list(by)
    keys = [*by, "feature"]
    counts = _counts(ref, cur, features, by) if counts is None else counts
    run = r.prefix_sum(counts, "x", ["n_ref", "n_cur"], keys)
    sizes = counts.groupBy(*keys).agg(F.sum("n_ref").alias("ref"), F.sum("n_cur").alias("cur"))
    d = r.joined_by(run, written(sizes, "sizes"), keys).groupBy(*keys).agg(F.max(F.abs(_share("cum_n_ref", "ref") - _share("cum_n_cur", "cur"))).alias("d"), F.first("ref").alias("ref"), F.first("cur").alias("cur"))
    p = kolmogorov_sf(F.col("d") * F.sqrt(F.coalesce(F.try_divide(F.col("ref") * F.col("cur"), F.col("ref") + F.col("cur")), F.lit(0.0))))
    enough = (F.col("ref") >= LEAST_ROWS) & (F.col("cur") >= LEAST_ROWS)
    out = d.withColumn("p", F.when(enough, p).otherwise(1.0))
    signal = _signal(out, by, "ks", F.col("p"), threshold, F.col("p") < threshold)
    return signal


def ks_distance(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    counts = _counts(ref, cur, features, [])
    run = r.prefix_sum(counts, "x", ["n_ref", "n_cur"], ["feature"])
    sizes = counts.groupBy("feature").agg(F.sum("n_ref").alias("ref"), F.sum("n_cur").alias("cur"))
    return r.joined_by(run, written(sizes, "sizes"), ["feature"]).groupBy("feature").agg(F.max(F.abs(_share("cum_n_ref", "ref") - _share("cum_n_cur", "cur"))).alias("d"))


def js(ref: DataFrame, cur: DataFrame, features: Sequence[str], *, by: Sequence[str] = (), n_bins: int = JS_BINS, threshold: float = JS, counts: DataFrame | None = None) -> DataFrame:
    """Jensen-Shannon distance over equal bins of the joint range; 0 below LEAST_ROWS rows."""
    by = list(by)
    keys = [*by, "feature"]
    counts = _counts(ref, cur, features, by) if counts is None else counts
    ranges = written(counts.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n_ref").alias("ref"), F.sum("n_cur").alias("cur")), "ranges")
    width = (F.col("hi") - F.col("lo")) / n_bins
    bin_of = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(n_bins - 1))).otherwise(F.lit(n_bins // 2)).cast("int")
    d = r.joined_by(counts, ranges, keys).groupBy(*keys, bin_of.alias("bin")).agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    spine = ranges.select(*keys, "ref", "cur", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    full = spine.join(d, [*keys, "bin"], "left").fillna(0, ["n_ref", "n_cur"])
    p, q = (F.col("n_ref") + 1e-9) / (F.col("ref") + n_bins * 1e-9), (F.col("n_cur") + 1e-9) / (F.col("cur") + n_bins * 1e-9)
    m = (p + q) / 2
    out = full.groupBy(*keys).agg(F.sqrt(F.greatest(F.sum(p * F.log(p / m) + q * F.log(q / m)) / 2, F.lit(0.0))).alias("js"), F.first("ref").alias("ref"), F.first("cur").alias("cur"))
    enough = (F.col("ref") >= LEAST_ROWS) & (F.col("cur") >= LEAST_ROWS)
    return _signal(out, by, "js_divergence", F.when(enough, F.col("js")).otherwise(0.0), threshold)


def missingness(ref: DataFrame, cur: DataFrame, features: Sequence[str], *, by: Sequence[str] = (), threshold: float = MISSING) -> DataFrame:
    """Rise in the share of nulls and NaNs."""
    d = _long(ref, cur, features, list(by))
    gone = (F.col("x").isNull() | F.isnan("x")).cast("int")
    share = lambda v: F.coalesce(F.avg(F.when(F.col("in_cur") == v, gone)), F.lit(0.0))
    return _signal(d.groupBy(*by, "feature").agg((share(1) - share(0)).alias("rise")), by, "schema", F.col("rise"), threshold)


def performance_gap(df: DataFrame, predicted: str, realized: str, *, by: Sequence[str] = (), threshold: float = GAP, least: int = 50) -> DataFrame:
    """Relative gap of mean predicted and mean realised profit; 0 below `least` rows or with a prediction near 0."""
    d = df.groupBy(*by).agg(F.avg(predicted).alias("p"), F.avg(realized).alias("q"), F.count(predicted).alias("n_p"), F.count(realized).alias("n_q")).withColumn("feature", F.lit("overall"))
    gap = F.when((F.col("n_p") < least) | (F.col("n_q") < least) | (F.abs("p") < 1e-6), 0.0).otherwise(F.abs(F.col("p") - F.col("q")) / F.abs("p"))
    return _signal(d, by, "performance_gap", gap, threshold)


def numbered(df: DataFrame, order: Sequence[str], out: str = "nth") -> tuple[DataFrame, DataFrame]:
    """(df with its rows' places from 0 in the given order, the number of rows in one row `_total`); places are running counts over range partitions."""
    d = running(df.withColumn("_one", F.lit(1)), [], order, sums={out: "_one"}, own=False)
    return d.withColumn(out, F.col(out).cast("long")).drop("_one"), df.agg(F.count("*").alias("_total"))


def count_windows(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """df with `win`, its block of `size` rows in the given order; the last, partial block is left out."""
    d, total = numbered(df, order, "_nth")
    d = d.join(F.broadcast(total)).withColumn("win", F.floor(F.col("_nth") / size).cast("long"))
    return d.where(F.col("win") < F.floor(F.col("_total") / size)).drop("_nth", "_total")


def windowed_monitor(df: DataFrame, features: Sequence[str], order: Sequence[str], size: int = 500) -> DataFrame:
    """Every window of `size` rows against the one before: psi, ks, js and missingness of each feature.

    Each row serves twice, as its window's current sample and as the next one's reference.
    """
    w = written(count_windows(df, order, size).select("win", *features), "windows")
    last = w.agg(F.max("win")).first()[0]
    cur = w.where("win > 0")
    ref = w.withColumn("win", F.col("win") + 1).where(F.col("win") <= F.lit(last if last is not None else 0))
    return signals(ref, cur, features, by="win", size=size)


def _window_statistics(ref: DataFrame, cur: DataFrame, features: Sequence[str], by: str) -> DataFrame:
    """(by, feature, psi, d, js, n_ref, n_cur, rise) of windows that one task holds: rows go to their windows in one shuffle."""
    import numpy as np
    import pyarrow as pa

    features, steps = list(features), np.array(r.steps(10))
    schema = f"{by} long, feature string, psi double, d double, js double, n_ref long, n_cur long, rise double"

    def psi_of(a: np.ndarray, b: np.ndarray) -> float | None:
        if not len(a):
            return None
        at = steps * (len(a) - 1)
        low, high = a[np.floor(at).astype(int)], a[np.ceil(at).astype(int)]
        edges = np.unique(low + (high - low) * (at - np.floor(at)))
        if not len(b) or len(edges) < 2:
            return 0.0
        inside = lambda v: v[(v >= edges[0]) & (v <= edges[-1])]
        n = [np.bincount(np.searchsorted(edges[1:-1], inside(v), "right"), minlength=len(edges) - 1) for v in (a, b)]
        p, q = (k / max(k.sum(), 1) + EPSILON for k in n)
        return float(((q - p) * np.log(q / p)).sum())

    def distances(a: np.ndarray, b: np.ndarray) -> tuple[float | None, float | None]:
        both = np.concatenate([a, b])
        if not len(both):
            return None, None
        cdf = lambda v: np.searchsorted(v, both, "right") / max(len(v), 1)
        lo, hi = both.min(), both.max()
        bins = lambda v: np.minimum(np.floor((v - lo) / ((hi - lo) / JS_BINS)), JS_BINS - 1).astype(int) if hi > lo else np.full(len(v), JS_BINS // 2)
        p, q = ((np.bincount(bins(v), minlength=JS_BINS) + 1e-9) / (len(v) + JS_BINS * 1e-9) for v in (a, b))
        m = (p + q) / 2
        return float(np.abs(cdf(a) - cdf(b)).max()), float(np.sqrt(max((p * np.log(p / m) + q * np.log(q / m)).sum() / 2, 0.0)))

    def run(table: pa.Table) -> pa.Table:
        key, late, out = table.column(by)[0].as_py(), table.column("in_cur").to_numpy() == 1, []
        for f in features:
            x = table.column(f).to_numpy()
            gone = np.isnan(x)
            a, b = np.sort(x[~late & ~gone]), np.sort(x[late & ~gone])
            rise = (gone[late].mean() if late.any() else 0.0) - (gone[~late].mean() if not late.all() else 0.0)
            out.append((key, f, psi_of(a, b), *distances(a, b), len(a), len(b), float(rise)))
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], [c.split(" ")[0] for c in schema.split(", ")])

    side = lambda d, v: d.select(F.col(by).cast("long").alias(by), *[F.col(f).cast("double").alias(f) for f in features], F.lit(v).alias("in_cur"))
    return side(ref, 0).unionByName(side(cur, 1)).groupBy(by).applyInArrow(run, schema)


def _window_signals(found: DataFrame, by: str) -> DataFrame:
    """The four detectors' rows of _window_statistics; a detector that no value reaches has none."""
    a, b = F.col("n_ref"), F.col("n_cur")
    enough = (a >= LEAST_ROWS) & (b >= LEAST_ROWS)
    p = kolmogorov_sf(F.col("d") * F.sqrt(F.coalesce(F.try_divide(a * b, a + b), F.lit(0.0))))
    rows = (
        ("psi", a > 0, F.col("psi"), PSI, None),
        ("ks", a + b > 0, F.when(enough, p).otherwise(1.0), KS_P, lambda v: v < KS_P),
        ("js_divergence", a + b > 0, F.when(enough, F.col("js")).otherwise(0.0), JS, None),
        ("schema", F.lit(True), F.col("rise"), MISSING, None),
    )
    one = [F.when(there, F.struct(F.lit(name).alias("detector"), v.alias("statistic"), F.lit(bound).alias("threshold"), F.coalesce(hit(v) if hit else v > bound, F.lit(False)).alias("is_drifting"))) for name, there, v, bound, hit in rows]
    d = found.select(by, "feature", F.explode(F.filter(F.array(*one), lambda s: s.isNotNull())).alias("s"))
    return d.select(by, "s.detector", "feature", "s.statistic", "s.threshold", "s.is_drifting")


def signals(ref: DataFrame, cur: DataFrame, features: Sequence[str], *, by: str = "win", size: int | None = None) -> DataFrame:
    """(by, detector, feature, statistic, threshold, is_drifting) of the four detectors.

    size: rows of a window at most, if known; windows that fit in a task are dealt out whole, others go by one count of the values.
    """
    if size is not None and 2 * size <= MOST_IN_TASK:
        return _window_signals(_window_statistics(ref, cur, features, by), by)
    counts = _counts(ref, cur, features, [by])
    parts = [*(f(ref, cur, features, by=[by], counts=counts) for f in (psi, ks, js)), missingness(ref, cur, features, by=[by])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    split = F.split("feature", "@segment_")
    return out.select(F.element_at(split, 2).cast("long").alias(by), "detector", F.element_at(split, 1).alias("feature"), "statistic", "threshold", "is_drifting")


def adwin(df: DataFrame, key: str, order: Sequence[str], value: str, *, delta: float = 0.002) -> DataFrame:
    """(key, n, mean_before, mean_after): the mean shifts that a growing window finds in each key's values.

    A value is added; from 30 values on, the first split with 10 on each side whose means differ by
    more than Hoeffding's bound drops what lies before it. Values stream through sorted partitions:
    what is held is a key's window since its last shift. Each value looks at all splits of it. Null keys are one key; null values are skipped.
    """
    import numpy as np
    import pyarrow as pa

    names = [key, "n", "mean_before", "mean_after"]

    def run(batches):
        current, sums, n = None, [0.0], 0
        for batch in batches:
            found, values = [], batch.column(1).to_numpy(zero_copy_only=False)
            for k, v in zip(batch.column(0).to_pylist(), values.tolist(), strict=True):
                if n == 0 or k != current:
                    current, sums, n = k, [0.0], 0
                n += 1
                sums.append(sums[-1] + v)
                size = len(sums) - 1
                if size < LEAST_ROWS:
                    continue
                s, left = np.array(sums), np.arange(10, size - 10)
                before, after = (s[left] - s[0]) / left, (s[-1] - s[left]) / (size - left)
                bound = np.sqrt((1 / left + 1 / (size - left)) / 2 * np.log(2 / delta))
                hit = np.flatnonzero(np.abs(before - after) > bound)
                if len(hit):
                    i = int(hit[0])
                    found.append((k, n, float(before[i]), float(after[i])))
                    sums = sums[int(left[i]) :]
            columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), batch.column(0).type), pa.array(list(columns[1]), pa.int64()), *(pa.array(list(c), pa.float64()) for c in columns[2:])], names)

    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    d = d.select(key, F.col(value).cast("double").alias("_value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]).repartition(key).sortWithinPartitions(key, *[f"_o{i}" for i in range(len(order))])
    kind = df.schema[key].dataType.simpleString()
    return d.select(key, "_value").mapInArrow(run, f"{key} {kind}, n long, mean_before double, mean_after double")
