"""Language identification with string kernels.

A text is the set of its hashed n-grams of several lengths (blended spectrum, presence only), n-grams of
bytes of UTF-8, so that no script needs a table of its own; ASCII letters count as lower case. The kernel of two texts is the number of n-grams they share over the
geometric mean of their numbers. Landmark texts give a Nystroem approximation, in which
one-versus-rest kernel ridge regression is solved: (K'WK + n*ridge*K_mm) a = K'Wy. Scoring is
a matrix product of a batch's presence matrix with the landmarks' weighted by a, kept as one
matrix of n-gram by language, the same product in another order.

Fitting uses a sample bounded by `most_rows` for each language and by `landmarks`, those with the smallest hashes
of their texts, dealt to the languages in turn; sums over it are formed in tasks and only matrices of landmarks by landmarks
reach the driver. All documents are scored, whole.

Defined results: a null text, or one without a letter, is `und` with score 0; without
labelled rows all are; equal texts get equal results; ties go to the first language by code
point; a text labelled twice counts once, under its first label; input columns with the names of the added ones
are replaced; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import textcols as tc
from quillon.llm.tables import hashed_fold, table, written

UNKNOWN = "und"
DIM_BITS = 16
DIM = 1 << DIM_BITS
LENGTHS = (2, 3, 4)
LANDMARKS = 256
MOST_ROWS = 1024
RIDGE = 1e-3
SHARPNESS = 6.0
#: Rows whose presence matrix is held at once.
ROWS = 64
_CODES = np.random.default_rng(7).integers(1, 2**32, 256, dtype=np.uint32) | np.uint32(1)
_STEP = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Matrix of rows by DIM: does the row's text have an n-gram of that hash?"""
    n_rows, n = len(offsets) - 1, len(data)
    out = np.zeros((n_rows, DIM), bool)
    flat = out.reshape(-1)
    codes = _CODES[tc.LOWER[data]]
    rows = np.repeat(np.arange(n_rows, dtype=np.int64), np.diff(offsets))
    for k in LENGTHS:
        if n < k:
            continue
        h = codes[: n - k + 1] * _STEP[0]
        for i in range(1, k):
            h = (h ^ (h >> np.uint32(15))) * _STEP[i] + codes[i : n - k + 1 + i]
        h = (h * _STEP[3]) >> np.uint32(32 - DIM_BITS)
        at = rows[: n - k + 1] * DIM + h
        flat[at[rows[: n - k + 1] == rows[k - 1 :]]] = True
    return out


def _batches(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets, _ = tc.text_buffer(column)
    for i, j in tc.slices(offsets, 1 << 18):
        for a in range(i, j, ROWS):
            b = min(j, a + ROWS)
            yield presence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


class Model:
    """weights: DIM by languages."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def scores(self, seen: np.ndarray) -> np.ndarray:
        x = seen.astype(np.float32)
        norms = np.sqrt(np.maximum(x.sum(1, dtype=np.float64), 1))
        return (x @ self.weights) / norms[:, None]


def labelled_sample(docs: DataFrame, *, text: str = "text", label: str = "lang", most_rows: int = MOST_ROWS) -> DataFrame:
    """(h, text, label): of each language at most `most_rows` distinct texts, those with the smallest hashes."""
    known = docs.where(F.col(label).isNotNull() & has_letter(F.col(text))).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.xxhash64(text).alias("h"))
    # of each language the distinct texts with the smallest hashes: hashes are even over their range, so a bound from the number of
    # distinct ones leaves somewhat more than most_rows, of which exactly that many are taken
    share = (1.5 * most_rows + 64) / F.approx_count_distinct("h", 0.02)
    bounds = known.groupBy("label").agg(F.when(share < 1, (share * 2.0**64 - 2.0**63).cast("long")).otherwise(F.lit((1 << 63) - 1)).alias("most"))
    near = known.join(F.broadcast(bounds), "label").where("h <= most").groupBy("h").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    return near.withColumn("place", place).where(F.col("place") <= most_rows).drop("place")


def fit(docs: DataFrame, *, text: str = "text", label: str = "lang", landmarks: int = LANDMARKS, most_rows: int = MOST_ROWS, ridge: float = RIDGE) -> Model | None:
    """A model from docs' labelled rows, of each language at most `most_rows` distinct texts; None where there are none."""
    chosen = written(labelled_sample(docs, text=text, label=label, most_rows=most_rows), "labelled")
    counts = {r[0]: r[1] for r in chosen.groupBy("label").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    turn = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    marks = chosen.withColumn("turn", turn).orderBy("turn", "h").limit(landmarks).select("text").mapInArrow(tc.tidied_batches(_packed), "seen binary").collect()
    bits = np.stack([np.frombuffer(r.seen, np.uint8) for r in marks])
    z = _landmarks(bits)
    m, c = len(z), len(languages)
    shared = docs.sparkSession.sparkContext.broadcast((bits, {x: i for i, x in enumerate(languages)}, counts))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, index, counts = shared.value
        z = _landmarks(bits)
        gram, cross = np.zeros((m, m)), np.zeros((m, c))
        for batch in batches:
            labels = batch.column(1).to_pylist()
            at = 0
            for seen in _batches(batch.column(0)):
                x = seen.astype(np.float32)
                k = ((x @ z.T) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]).astype(np.float64)
                own = labels[at : at + len(x)]
                at += len(x)
                w = np.array([1.0 / counts[y] for y in own])
                y = np.full((len(x), c), -1.0)
                y[np.arange(len(x)), [index[v] for v in own]] = 1.0
                gram += k.T @ (k * w[:, None])
                cross += k.T @ (y * w[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([cross.tobytes()], pa.binary())], ["gram", "cross"])

    parts = chosen.select("text", "label").mapInArrow(tc.tidied_batches(sums), "gram binary, cross binary").collect()
    gram = sum(np.frombuffer(r.gram).reshape(m, m) for r in parts)
    cross = sum(np.frombuffer(r.cross).reshape(m, c) for r in parts)
    mm = (z @ z.T).astype(np.float64)
    a = np.linalg.solve(gram + ridge * c * (mm + 1e-6 * np.eye(m)), cross)
    return Model(languages, np.ascontiguousarray(z.T @ a.astype(np.float32)))


def _landmarks(bits: np.ndarray) -> np.ndarray:
    """Landmarks' presence over the roots of their sizes, from packed bits."""
    z = np.unpackbits(bits, axis=1, count=DIM).astype(np.float32)
    z /= np.sqrt(np.maximum(z.sum(1, keepdims=True), 1))
    return z


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.packbits(r).tobytes() for seen in _batches(batch.column(0)) for r in seen]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["seen"])


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and the score, a softmax over the languages' regressions."""
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (out, score)], F.lit(UNKNOWN).alias(out), F.lit(0.0).alias(score))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), has_letter(F.col(text)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            values = [model.scores(seen) for seen in _batches(batch.column(0).field(at))]
            s = np.concatenate(values) if values else np.zeros((0, len(model.languages)))
            best = s.argmax(1) if len(s) else np.zeros(0, int)
            e = np.exp(SHARPNESS * (s - s.max(1, keepdims=True))) if len(s) else s
            p = e.max(1) / e.sum(1) if len(s) else np.zeros(0)
            letters = batch.column(1).to_pylist()
            names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters, strict=True)]
            p = [float(v) if ok else 0.0 for v, ok in zip(p.tolist(), letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(p, pa.float64())], ["row", "l", "s"])

    found = whole.mapInArrow(tc.tidied_batches(run), "row " + docs.schema.simpleString() + ", l string, s double")
    return found.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in (out, score)], F.col("l").alias(out), F.col("s").alias(score))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", hashed_fold("doc_id", 4) == 2)
    model = fit(docs.where(~F.col("held_out")))
    found = identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
