"""Additive attributions of a score: Shapley values of each row against a background.

The coalitions are one fixed design for all rows: all of them for up to `exact` features, and beyond that the empty,
full, single and all-but-one sets with a bounded number of drawn sets and their complements. Rows are exploded by coalition, scored in
bulk, and a row's attributions are a fixed matrix times its scores: exact weights, or the least-squares fit under the
condition that attributions add up to the score minus that of the background, which holds in both cases.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features up to which all coalitions are scored, and drawn coalitions beyond that.
EXACT, DRAWN = 10, 1024


def design(d: int, *, exact: int = EXACT, drawn: int = DRAWN, seed: int = 42) -> tuple[list[int], np.ndarray]:
    """(coalitions as bits, matrix (d, coalitions)): attributions are the matrix times the coalitions' scores."""
    full = (1 << d) - 1
    if d <= exact:
        masks = list(range(1 << d))
        inside = [math.factorial(s - 1) * math.factorial(d - s) / math.factorial(d) if s else 0.0 for s in range(d + 1)]
        outside = [-math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) if s < d else 0.0 for s in range(d + 1)]
        return masks, np.array([[(inside if m >> j & 1 else outside)[m.bit_count()] for m in masks] for j in range(d)]).reshape(d, len(masks))
    rng = random.Random(seed)
    weight = {1 << j: 1.0 / d for j in range(d)} | {full ^ (1 << j): 1.0 / d for j in range(d)}
    sizes = list(range(2, d - 1))
    kernel = [(d - 1) / (s * (d - s)) for s in sizes]
    for _ in range(drawn // 2):
        s = rng.choices(sizes, kernel)[0]
        m = sum(1 << j for j in rng.sample(range(d), s))
        for one in (m, full ^ m):
            weight[one] = weight.get(one, 0.0) + sum(kernel) / drawn
    masks = [0, full, *sorted(weight)]
    z = np.array([[m >> j & 1 for j in range(d)] for m in masks[2:]], float)
    zw = z.T * np.array([weight[m] for m in masks[2:]])
    inverse, ones = np.linalg.inv(zw @ z), np.ones((d, 1))
    # y = scores - empty; phi = inverse (zw y + c * ones), c so that phi adds up to full - empty
    free = inverse @ zw
    hold = inverse @ ones / (ones.T @ inverse @ ones)
    on_y = free - hold @ (ones.T @ free)
    matrix = np.hstack([-on_y.sum(axis=1, keepdims=True) - hold, hold, on_y])
    return masks, matrix


def attributions(df: DataFrame, key: str, features: Sequence[str], score: Callable[[DataFrame], DataFrame], background: dict[str, float], *, exact: int = EXACT, drawn: int = DRAWN) -> DataFrame:
    """(key, base, profit, one column phi_<feature> each): base is the background's score; base plus all phi is the row's profit.

    score adds `profit` to a frame that has the features. Null features count as the background's value. Keys are unique.
    """
    masks, matrix = design(len(features), exact=exact, drawn=drawn)
    rows = [([(m, [float(v) for v in matrix[:, i]]) for i, m in enumerate(masks)],)]
    every = df.sparkSession.createDataFrame(rows, "_all array<struct<mask: long, w: array<double>>>")
    d = df.select(key, *features).join(F.broadcast(every)).select(key, *features, F.explode("_all").alias("_c")).select(key, *features, F.col("_c.mask").alias("_mask"), F.col("_c.w").alias("_w"))
    own = lambda j, f: F.when(F.col("_mask").bitwiseAND(F.lit(1 << j)) != 0, F.coalesce(F.col(f).cast("double"), F.lit(float(background[f])))).otherwise(F.lit(float(background[f])))
    d = score(d.withColumns({f: own(j, f) for j, f in enumerate(features)}))
    at = lambda m: F.max(F.when(F.col("_mask") == m, F.col("profit")))
    sums = [F.sum(F.col("profit") * F.col("_w")[j]).alias(f"phi_{f}") for j, f in enumerate(features)]
    return d.groupBy(key).agg(at(0).alias("base"), at((1 << len(features)) - 1).alias("profit"), *sums)
