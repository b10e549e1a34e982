"""PD by segment with partial pooling: logistic regression whose segment intercepts share a normal prior.

    y ~ Bernoulli(sigmoid(a[segment] + b x)),  a ~ Normal(mu, sigma),  b ~ Normal(0, 1),  mu ~ Normal(0, 5)

A Newton step is one aggregation: sums by segment, and one matrix of the features. Intercepts meet only through the features
and mu, so the Hessian is solved by blocks, in time linear in the segments. sigma follows from the spread of the
intercepts and their own variances (EM), with a half-normal prior of scale 1. What comes to the driver grows with segments
times features, not with rows.

Draws come from the normal approximation at the mode (Laplace): features and mu by the Cholesky factor of the Schur
complement, intercepts given those. A draw needs no refit, and rows are scored under all draws in one pass.
Null features count as 0 and rows without a label are not fitted; a segment that was not fitted has mu as its intercept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.storage import written

#: Prior variances of a coefficient and of mu, and the scale of sigma's half-normal prior.
V_COEFFICIENT, V_MU, S_SIGMA = 1.0, 25.0, 1.0
#: Rows that are scored under all draws at once.
SLICE = 512


@dataclass
class Pooled:
    """Mode and blocks of the Hessian; shared is (coefficients, mu)."""

    features: list[str]
    segments: list
    intercepts: np.ndarray
    shared: np.ndarray
    sigma: float
    own: np.ndarray
    cross: np.ndarray
    schur: np.ndarray
    n: np.ndarray

    def draws(self, count: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
        """(intercepts (segments + 1, count), the last for unknown segments; coefficients (features, count))."""
        rng = np.random.default_rng(seed)
        d = len(self.features)
        shared = self.shared[:, None] + np.linalg.solve(np.linalg.cholesky(self.schur).T, rng.standard_normal((d + 1, count)))
        mean = self.intercepts[:, None] - (self.cross @ (shared - self.shared[:, None])) / self.own[:, None]
        own = mean + rng.standard_normal(mean.shape) / np.sqrt(self.own)[:, None]
        other = shared[d] + self.sigma * rng.standard_normal(count)
        return np.vstack([own, other]), shared[:d]


def _columns(df: DataFrame, features: Sequence[str]) -> list:
    return [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_x{j}") for j, f in enumerate(features)]


def _matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.stack([batch.column(first + j).to_numpy(zero_copy_only=False) for j in range(n)], axis=1) if n else np.zeros((batch.num_rows, 0))


def _sums(data: DataFrame, place: dict, intercepts: np.ndarray, b: np.ndarray):
    """By segment: gradient, weight and weighted features; of all: gradient and matrix of the features; log likelihood."""
    s, d = len(place), len(b)
    size = s * (d + 2) + d + d * d + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            g, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch, 2, d)
            eta = intercepts[g] + x @ b
            p = 1 / (1 + np.exp(-eta))
            w, e = p * (1 - p), y - p
            rows = total[: s * (d + 2)].reshape(s, d + 2)
            for k, v in enumerate([e, w, *(w[:, None] * x).T]):
                rows[:, k] += np.bincount(g, weights=v, minlength=s)
            total[s * (d + 2) : s * (d + 2) + d] += x.T @ e
            total[s * (d + 2) + d : -1] += ((x * w[:, None]).T @ x).reshape(-1)
            total[-1] += float((y * eta - np.logaddexp(0, eta)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int64()), pa.array(total, pa.float64())], ["cell", "v"])

    out = np.zeros(size)
    for row in data.mapInArrow(add, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[row.cell] = row.v
    rows = out[: s * (d + 2)].reshape(s, d + 2)
    return rows[:, 0], rows[:, 1], rows[:, 2:], out[s * (d + 2) : s * (d + 2) + d], out[s * (d + 2) + d : -1].reshape(d, d), out[-1]


def fit(df: DataFrame, features: Sequence[str], segment: str, label: str, *, steps: int = 30, tolerance: float = 1e-6) -> Pooled:
    """The mode of the model above, and its Hessian."""
    features, d = list(features), len(features)
    known = df.where(F.col(label).isNotNull())
    sizes = sorted(known.groupBy(segment).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("y")).collect(), key=lambda r: (r[0] is not None, r[0]))
    place = {r[0]: i for i, r in enumerate(sizes)}
    s = len(place)
    numbers = df.sparkSession.createDataFrame([(*k, i) for k, i in (((k,), i) for k, i in place.items())], f"_k {df.schema[segment].dataType.simpleString()}, _g int")
    data = written(known.join(F.broadcast(numbers), F.col(segment).eqNullSafe(F.col("_k"))).select("_g", F.col(label).cast("double").alias("_y"), *_columns(df, features)), "pooled")
    n = np.array([r.n for r in sizes], float)
    rate = (sum(r.y for r in sizes) + 0.5) / (n.sum() + 1.0)
    a, shared, sigma = np.full(s, np.log(rate / (1 - rate))), np.zeros(d + 1), 1.0
    shared[d] = a[0] if s else 0.0
    prior = np.append(np.full(d, 1 / V_COEFFICIENT), 1 / V_MU)
    own, cross, schur = np.ones(s), np.zeros((s, d + 1)), np.diag(prior)
    for _ in range(steps if s else 0):
        grad_a, w, wx, grad_b, xx, _ = _sums(data, place, a, shared[:d])
        tau = 1 / sigma**2
        grad_a = grad_a - tau * (a - shared[d])
        grad = np.append(grad_b, tau * (a - shared[d]).sum()) - prior * shared
        own = w + tau
        cross = np.hstack([wx, np.full((s, 1), -tau)])
        block = np.zeros((d + 1, d + 1))
        block[:d, :d] = xx
        block[d, d] = tau * s
        schur = block + np.diag(prior) - cross.T @ (cross / own[:, None])
        move = np.linalg.solve(schur, grad - cross.T @ (grad_a / own))
        move_a = (grad_a - cross @ move) / own
        # steps of over 3 in any parameter are shortened
        scale = min(1.0, 3.0 / max(1e-12, np.abs(move).max(), np.abs(move_a).max()))
        a, shared = a + scale * move_a, shared + scale * move
        inverse = np.linalg.inv(schur)
        variance = 1 / own + np.einsum("ij,jk,ik->i", cross, inverse, cross) / own**2 - 2 * (cross @ inverse)[:, d] * -1 / own + inverse[d, d]
        spread = float(((a - shared[d]) ** 2 + np.maximum(variance, 0)).sum())
        # the mode of sigma given the spread: s / sigma = spread / sigma**3 - sigma / S_SIGMA**2
        square = S_SIGMA**2 * (-s + np.sqrt(s * s + 4 * spread / S_SIGMA**2)) / 2
        new = max(1e-3, float(np.sqrt(square)))
        done = max(np.abs(move).max(), np.abs(move_a).max(), abs(new - sigma)) < tolerance
        sigma = new
        if done:
            break
    return Pooled(features, list(place), a, shared, sigma, own, cross, schur, n)


def _scored(model: Pooled, df: DataFrame, segment: str, draws: int, seed: int, carried: Sequence[str]):
    """(data with _g, the features and carried columns; intercepts, coefficients by draw)."""
    a, b = model.draws(draws, seed)
    numbers = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(model.segments)], f"_k {df.schema[segment].dataType.simpleString()}, _g int")
    d = df.join(F.broadcast(numbers), F.col(segment).eqNullSafe(F.col("_k")), "left")
    return d.select(F.coalesce("_g", F.lit(len(model.segments))).alias("_g"), *_columns(df, model.features), *carried), a, b


def predict(model: Pooled, df: DataFrame, key: str, segment: str, out: str = "pd") -> DataFrame:
    """(key, out): the PD of every row at the mode."""
    numbers = df.sparkSession.createDataFrame([(k, float(v)) for k, v in zip(model.segments, model.intercepts, strict=True)], f"_k {df.schema[segment].dataType.simpleString()}, _a double")
    d = df.join(F.broadcast(numbers), F.col(segment).eqNullSafe(F.col("_k")), "left").select(key, F.coalesce("_a", F.lit(float(model.shared[-1]))).alias("_a"), *_columns(df, model.features))
    eta = F.col("_a")
    for j in range(len(model.features)):
        eta = eta + F.col(f"_x{j}") * F.lit(float(model.shared[j]))
    return d.select(key, (1 / (1 + F.exp(-eta))).alias(out))


def intervals(model: Pooled, df: DataFrame, key: str, segment: str, *, draws: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(key, mean, median, sd, low, high) of every row's PD under all draws, one pass."""
    d, a, b = _scored(model, df, segment, draws, seed, [key])
    n = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, x, parts = batch.column(0).to_numpy(), _matrix(batch, 1, n), [np.zeros((0, 5))]
            for i in range(0, len(g), SLICE):
                p = 1 / (1 + np.exp(-(a[g[i : i + SLICE]] + x[i : i + SLICE] @ b)))
                low, mid, high = np.quantile(p, [(1 - level) / 2, 0.5, (1 + level) / 2], axis=1)
                parts.append(np.stack([p.mean(axis=1), mid, p.std(axis=1), low, high], axis=1))
            m = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(n + 1), *(pa.array(m[:, k], pa.float64()) for k in range(5))], [key, "mean", "median", "sd", "low", "high"])

    return d.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, mean double, median double, sd double, low double, high double")


def portfolio_losses(model: Pooled, df: DataFrame, segment: str, ead: str, lgd: float, *, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(draw, loss): the portfolio's expected loss under each draw, added up in tasks."""
    d, a, b = _scored(model, df.withColumn("_ead", F.coalesce(F.col(ead).cast("double"), F.lit(0.0))), segment, draws, seed, ["_ead"])
    n = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draws)
        for batch in batches:
            g, x, e = batch.column(0).to_numpy(), _matrix(batch, 1, n), batch.column(n + 1).to_numpy()
            for i in range(0, len(g), SLICE):
                total += lgd * (e[i : i + SLICE] @ (1 / (1 + np.exp(-(a[g[i : i + SLICE]] + x[i : i + SLICE] @ b)))))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws), pa.int32()), pa.array(total, pa.float64())], ["draw", "loss"])

    return d.mapInArrow(run, "draw int, loss double").groupBy("draw").agg(F.sum("loss").alias("loss"))
