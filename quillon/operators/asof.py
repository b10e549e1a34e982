"""Point-in-time joins: what was known of a customer at a moment, and nothing later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.carry import running


def asof_joins(base: DataFrame, rights: dict[str, DataFrame], *, by: str, left_on: str, right_on: str, source: DataFrame | None = None, pieces: int | None = None) -> DataFrame:
    """Each base row with, of every right table, the row of greatest right_on <= left_on of the same key; rights: by the name that its right_on gets.

    All tables are put in one stream of rows, and the last right row of each up to a base row is carried
    along, over range partitions: one shuffle by key and time for all of them, no rows multiplied. Unmatched base rows
    keep nulls. source: rows with `by` and left_on to take the cuts from, where the tables are dear to compute.
    """
    taken = {name: [c for c in d.columns if c != by] for name, d in rights.items()}
    kinds = {name: d.select(*taken[name]).schema.simpleString() for name, d in rights.items()} | {"": base.schema.simpleString()}

    def side(d: DataFrame, at: str, own: str, columns: list[str]) -> DataFrame:
        held = [(F.struct(*columns) if name == own else F.lit(None).cast(kind)).alias(f"_r{i}") for i, (name, kind) in enumerate(kinds.items())]
        return d.select(by, F.col(at).alias("_at"), F.lit(int(own == "")).alias("_base"), *held)

    d = side(base, left_on, "", base.columns)
    for name, right in rights.items():
        d = d.unionAll(side(right, right_on, name, taken[name]))
    atomic = [f.name for f in base.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    # base rows of one moment are told apart by their own values, so that they can be cut too
    d = d.withColumn("_tie", F.xxhash64(*[f"_r{len(rights)}.{c}" for c in atomic]))
    cuts = None if source is None else source.select(by, F.col(left_on).alias("_at"))
    found = running(d, [by], ["_at", "_base", "_tie"], last={f"_seen{i}": f"_r{i}" for i in range(len(rights))}, source=cuts, pieces=pieces).where("_base = 1")
    return found.select(f"_r{len(rights)}.*", *[F.col(f"_seen{i}.{c}").alias(name if c == right_on else c) for i, name in enumerate(rights) for c in taken[name]])


def asof_join(base: DataFrame, right: DataFrame, *, by: str, left_on: str, right_on: str, freshness: str) -> DataFrame:
    """Each base row with the right row of greatest right_on <= left_on of the same key; freshness is that right_on."""
    return asof_joins(base, {freshness: right}, by=by, left_on=left_on, right_on=right_on)


def assemble(views: dict[str, DataFrame], base: str = "5m", events: DataFrame | None = None) -> DataFrame:
    """The training frame: every row of the base view with the other views as they were then. events: what the views come from, read for cuts in their place."""
    timed = {f"as_of_{h}": v for h, v in views.items() if h != base and "window_end" in v.columns}
    out = asof_joins(views[base].withColumnRenamed("window_end", "as_of"), timed, by="customer_id", left_on="as_of", right_on="window_end", source=None if events is None else events.select("customer_id", F.col("event_time").alias("as_of")))
    for h, view in views.items():
        if h != base and "window_end" not in view.columns:
            out = out.join(view, "customer_id", "left")
    return out


def violations(joined: DataFrame, at: str = "as_of") -> DataFrame:
    """How many rows each as_of_* column looks into the future of; all 0 in a correct frame."""
    marks = [c for c in joined.columns if c.startswith("as_of_")]
    counts = joined.agg(*[F.count(F.when(F.col(c) > F.col(at), 1)).alias(c) for c in marks])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in marks])).alias("r")).select("r.*")


def assert_point_in_time(joined: DataFrame, at: str = "as_of") -> None:
    """Raises with counts and three samples if any as_of_* is later than as_of."""
    bad = {r[0]: r[1] for r in violations(joined, at).collect() if r[1]}
    if bad:
        worst = max(bad, key=bad.get)
        rows = joined.where(F.col(worst) > F.col(at)).select("customer_id", at, worst).limit(3).collect()
        raise ValueError(f"rows from the future: {bad}; for example {[tuple(r) for r in rows]}")
