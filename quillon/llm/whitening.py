"""Embedding whitening by the exact characteristic polynomial of an integer scatter.

Entries become integers on a grid (floor of `grid` times the entry). Each distinct vector counts once; the fit
list is written once, and its n, sums S and sums of products are added up exactly in tasks, as digits to
base 2**32, so that the scatter A = n * sum(x x') - S S' = n**2 V is an integer matrix without rounding. Only its
d * d cells come to the driver, whatever the number of rows.

A's characteristic polynomial is found modulo 31-bit primes, as many as its coefficients' bound asks for, by
reduction to Hessenberg form of all primes at once, and put together by the Chinese remainder theorem. All roots
are real, so the number of roots above a point is exactly the number of sign changes of the polynomial
shifted to it (Budan and Fourier); bisection over dyadic points isolates the largest ones to
`bits` bits, more where two do not separate. Components come from inverse iteration on A - root in
decimals of 80 digits; a root of higher multiplicity has as many vectors, made orthogonal. Their sign makes the
entry of largest size positive.

Rows are then projected as n * x - S, which is exact, times one small matrix.

Defined results: rows with a null vector or a null, NaN or infinite entry are left out; so are those that are not
of the most frequent length (the longer of two), as no covariance holds both; components of eigenvalue 0 are left out, so
a fit list of one vector, or of none, gives rows without components; equal rows are equal; a deviation beyond a
long is null; all columns but the vector come back under `row`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textcols as tc
from quillon.llm.tables import table, written

GRID = 256
MOST = 4
BITS = 72
#: Bits at which roots that still do not separate count as one.
MOST_BITS = 240
DIGITS = 80
#: Rows that one exact product adds up; bounds sums to what doubles hold.
BLOCK = 4096
_LIMB = 16


def on_grid(df: DataFrame, *, vector: str, grid: int) -> DataFrame:
    """row (all columns but the vector) and x, array<long>, of the rows whose vector is whole."""
    rest = [c for c in df.columns if c != vector]
    v = F.col("_v")
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return whole.where(v.isNotNull() & finite).select("row", F.transform(v, lambda c: F.floor(c * F.lit(float(grid))).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as an integer matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact x' x as Python integers: limbs of 16 bits, whose products doubles add up exactly over a block."""
    most = int(np.abs(x.astype(object)).max(initial=0)) if x.size and (x == np.iinfo(np.int64).min).any() else int(np.abs(x).max(initial=0))
    limbs, left = [], x.copy()
    for _ in range(max(1, -(-(most.bit_length() + 1) // _LIMB))):
        low = (left & 0xFFFF).astype(np.int64)
        low[low >= 0x8000] -= 0x10000
        limbs.append(low.astype(np.float64))
        left = (left - low) >> _LIMB if len(limbs) < 4 else left * 0
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) * (1 << (_LIMB * (i + j)))
    return total


def scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, S, sum of x x') of the rows x, exact; what comes back is d * (d + 3) / 2 cells."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            x = _matrix(batch.column(0))
            for i in range(0, len(x), BLOCK):
                part = x[i : i + BLOCK]
                one = _products(np.concatenate([part, np.ones((len(part), 1), np.int64)], axis=1))
                total = one if total is None else total + one
            n += len(x)
        if n:
            cells, places, digits = [], [], []
            for cell, value in enumerate(total[np.triu_indices(len(total))].tolist()):
                sign, value, place = (1, value, 0) if value >= 0 else (-1, -value, 0)
                while value:
                    cells.append(cell)
                    places.append(place)
                    digits.append(sign * (value & 0xFFFFFFFF))
                    value, place = value >> 32, place + 1
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(places, pa.int32()), pa.array(digits, pa.int64())], ["cell", "place", "digit"])

    found = fit.select("x").mapInArrow(tc.tidied_batches(add), "cell int, place int, digit long").groupBy("cell", "place").agg(F.sum("digit").alias("digit"))
    length = fit.select(F.size("x").alias("d")).first()
    if length is None:
        return 0, [], np.zeros((0, 0), object)
    d = length.d
    flat = [0] * ((d + 1) * (d + 2) // 2)
    for r in found.collect():
        flat[r.cell] += r.digit << (32 * r.place)
    m = np.zeros((d + 1, d + 1), object)
    m[np.triu_indices(d + 1)] = flat
    m = np.triu(m) + np.triu(m, 1).T
    return int(m[d, d]), [int(v) for v in m[d, :d]], m[:d, :d]


def _primes(count: int) -> list[int]:
    """The largest `count` primes below 2**31."""
    found, at = [], (1 << 31) - 1
    small = [p for p in range(3, 46341, 2) if all(p % q for q in range(3, math.isqrt(p) + 1, 2))] if count else []
    divisors = np.array(small, np.int64)
    while len(found) < count:
        if at % divisors[divisors * divisors <= at] is not None and (at % divisors[divisors * divisors <= at]).all():
            found.append(at)
        at -= 2
    return found


def _power_mod(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, base, exponent = np.ones_like(base), base % p, exponent.copy()
    while exponent.any():
        out = np.where(exponent & 1 == 1, out * base % p, out)
        base, exponent = base * base % p, exponent >> 1
    return out


def _polynomials(a: np.ndarray, primes: Sequence[int]) -> np.ndarray:
    """Coefficients (prime, power), lowest first, of det(x - a) modulo each prime, by Hessenberg form."""
    p, d = np.array(primes, np.int64), len(a)
    h = np.stack([(a % q).astype(np.int64) for q in primes])
    one, two, k_ = p[:, None], p[:, None, None], np.arange(len(p))
    for k in range(1, d - 1):
        pivot = k + (h[:, k:, k - 1] != 0).argmax(axis=1)
        row, other = h[k_, k].copy(), h[k_, pivot].copy()
        h[k_, k], h[k_, pivot] = other, row
        column, other = h[k_, :, k].copy(), h[k_, :, pivot].copy()
        h[k_, :, k], h[k_, :, pivot] = other, column
        inverse = _power_mod(h[:, k, k - 1], p - 2, p)  # of 0 it is 0: then the whole column is
        u = h[:, k + 1 :, k - 1] * inverse[:, None] % one
        h[:, k + 1 :] = (h[:, k + 1 :] - u[:, :, None] * h[:, k, None, :] % two) % two
        h[:, :, k] = (h[:, :, k] + (h[:, :, k + 1 :] * u[:, None, :] % two).sum(axis=2)) % one
    poly = np.zeros((d + 1, len(p), d + 1), np.int64)
    poly[0, :, 0] = 1
    for m in range(1, d + 1):
        new = -poly[m - 1] * h[:, m - 1, m - 1, None] % one
        new[:, 1:] += poly[m - 1, :, :-1]
        below = np.ones(len(p), np.int64)
        for i in range(m - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            new -= poly[i - 1] * (below * h[:, i - 1, m - 1] % p)[:, None] % one
        poly[m] = new % one
    return poly[d]


def characteristic_polynomial(a: np.ndarray) -> list[int]:
    """Coefficients, lowest first, of det(x - a) of a symmetric integer matrix without negative eigenvalues."""
    d = len(a)
    trace = sum(int(a[i, i]) for i in range(d))
    # the k-th symmetric function of d roots of that sum is C(d, k) (trace / d)**k at most
    bits = max(math.comb(d, k).bit_length() + k * max(0.0, math.log2(max(trace, 1)) - math.log2(d) + 1e-6) for k in range(d + 1))
    primes = _primes(int(bits) // 30 + 3)
    rests = _polynomials(a, primes)
    product = math.prod(primes)
    terms = [(product // q) * pow(product // q, -1, q) for q in primes]
    out = []
    for k in range(d + 1):
        value = sum(int(r) * t for r, t in zip(rests[:, k], terms, strict=True)) % product
        out.append(value - product if 2 * value > product else value)
    return out


def _above(poly: list[int], at: int, bits: int) -> int:
    """How many roots, with their multiplicity, lie above at / 2**bits; all roots are real."""
    c = [v << (bits * (len(poly) - 1 - k)) for k, v in enumerate(poly)]
    changes, last = 0, 0
    for i in range(len(c)):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
        if c[i]:
            changes += last * c[i] < 0
            last = 1 if c[i] > 0 else -1
    return changes


@dataclass
class Root:
    low: int
    high: int
    bits: int


def largest_roots(poly: list[int], most: int, bits: int = BITS) -> list[Root]:
    """The largest positive roots, with multiplicity, each in (low, high] / 2**bits of relative width below 2**-bits or so."""
    d = len(poly) - 1
    bound = 1 << max(1, (abs(poly[d - 1]) + 1).bit_length())  # the trace bounds all roots
    positive, roots = _above(poly, 0, 0), []

    def narrowed(r: Root, k: int, want: int) -> None:
        while r.low == 0 and r.high > 1 or (r.high - r.low) << want > r.high:
            if r.high - r.low == 1:
                r.low, r.high, r.bits = 2 * r.low, 2 * r.high, r.bits + 1
            mid = (r.low + r.high) // 2
            if _above(poly, mid, r.bits) >= k:
                r.low = mid
            else:
                r.high = mid
            if r.bits > 4 * MOST_BITS:
                break

    for k in range(1, min(most, positive) + 1):
        r = Root(0, bound, 0)
        narrowed(r, k, bits)
        roots.append(r)
    for k in range(1, len(roots)):
        a, b = roots[k - 1], roots[k]
        if a.low * (1 << b.bits) < b.high * (1 << a.bits):
            narrowed(a, k, MOST_BITS)
            narrowed(b, k + 1, MOST_BITS)
    return roots


def _same(a: Root, b: Root) -> bool:
    """Do two roots lie in overlapping intervals?"""
    return a.low * (1 << b.bits) < b.high * (1 << a.bits)


def components(a: np.ndarray, roots: list[Root]) -> list[list[Decimal]]:
    """Unit vectors of each root's null space, orthogonal to one another."""
    d, out = len(a), []
    with localcontext() as ctx:
        ctx.prec = DIGITS + MOST_BITS // 3
        whole = np.array([[Decimal(int(v)) for v in row] for row in a], object)
        for k, r in enumerate(roots):
            root = Decimal(r.low + r.high) / Decimal(2 << r.bits)
            m = whole.copy()
            for i in range(d):
                m[i, i] -= root
            order, factors = list(range(d)), m
            tiny = root.scaleb(-DIGITS)
            for i in range(d):
                pivot = max(range(i, d), key=lambda j: abs(factors[j, i]))  # noqa: B023
                if pivot != i:
                    factors[[i, pivot]] = factors[[pivot, i]]
                    order[i], order[pivot] = order[pivot], order[i]
                if abs(factors[i, i]) < tiny:
                    factors[i, i] = tiny
                if i + 1 < d:
                    factors[i + 1 :, i] = factors[i + 1 :, i] / factors[i, i]
                    factors[i + 1 :, i + 1 :] = factors[i + 1 :, i + 1 :] - np.outer(factors[i + 1 :, i], factors[i, i + 1 :])
            near = [v for v, q in zip(out, roots, strict=False) if _same(q, r)]
            v = np.array([Decimal(((i + 1) * (2 * k + 3) * 7919) % 997 + 1) for i in range(d)], object)
            for _ in range(60):
                for u in near:
                    v = v - u * (u @ v)
                v = v / (v @ v).sqrt()
                w = v[order]
                for i in range(1, d):
                    w[i] -= factors[i, :i] @ w[:i]
                for i in range(d - 1, -1, -1):
                    w[i] = (w[i] - (factors[i, i + 1 :] @ w[i + 1 :] if i + 1 < d else 0)) / factors[i, i]
                for u in near:
                    w = w - u * (u @ w)
                w = w / (w @ w).sqrt()
                if w @ v < 0:
                    w = -w
                moved = max(abs(x) for x in (w - v))
                v = w
                if moved < Decimal(10) ** -30:
                    break
            lead = max(range(d), key=lambda i: abs(v[i]))  # noqa: B023
            out.append(v if v[lead] > 0 else -v)
    return out


def whiten(df: DataFrame, *, vector: str = "embedding", grid: int = GRID, most: int = MOST) -> DataFrame:
    """row (all columns but the vector), n, deviation (long), whitened (array), explained (array) and identity_error of every whole row."""
    rows = on_grid(df, vector=vector, grid=grid)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    rows = rows.where(F.size("x") == d)
    fit = written(rows.select("x").distinct(), "fit")
    n, sums, products = scatter(fit) if d else (0, [], np.zeros((0, 0), object))
    a = n * products - np.outer(np.array(sums, object), np.array(sums, object)) if n else products
    trace = sum(int(a[i, i]) for i in range(d)) if n else 0
    roots = largest_roots(characteristic_polynomial(a), most) if trace else []
    vectors = components(a, roots) if roots else []
    k = len(roots)
    explained = [float(Decimal(r.low + r.high) / Decimal(2 << r.bits) / trace) for r in roots]
    # whitened = (n x - S) / n . u / sqrt(root / n**2) = (n x - S) . u / sqrt(root)
    with localcontext() as ctx:
        ctx.prec = 40
        by = np.array([[float(x / (Decimal(r.low + r.high) / Decimal(2 << r.bits)).sqrt()) for x in v] for v, r in zip(vectors, roots, strict=True)]).reshape(k, d).T
    s = np.array(sums, object)
    largest = max((abs(v) for v in sums), default=0)

    def deviations(x: np.ndarray) -> np.ndarray:
        """n x - S, in 64 bits where they hold it."""
        wide = n * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + largest >= 1 << 62
        return x.astype(object) * n - s if wide else x * np.int64(n) - s.astype(np.int64)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            w = deviations(_matrix(batch.column(0))).astype(np.float64) @ by
            total += np.concatenate([w.T @ w, w.sum(axis=0)[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.reshape(-1), pa.float64())], ["cell", "v"])

    error = 0.0
    if k:
        m = np.zeros(k * (k + 1))
        for r in fit.mapInArrow(tc.tidied_batches(moments), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
            m[r.cell] = r.v / n
        m = m.reshape(k, k + 1)
        error = float(np.abs(m[:, :k] - np.outer(m[:, k], m[:, k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            dev = deviations(x)
            narrow = dev.dtype != object and int(np.abs(dev).max(initial=0)) ** 2 * max(d, 1) < 1 << 63
            square = (dev * dev).sum(axis=1) if narrow else [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in dev)]
            w = dev.astype(np.float64) @ by
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(w.reshape(-1), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(square, pa.int64()), lists], ["row", "deviation", "whitened"])

    out = rows.mapInArrow(tc.tidied_batches(project), f"row {rows.schema['row'].dataType.simpleString()}, deviation long, whitened array<double>")
    return out.select("row", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*[F.lit(e) for e in explained]).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    d = d.select("row.vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return d.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
