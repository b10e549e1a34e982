"""Quality by hierarchical empirical Bayes over sites.

Three sources of evidence meet in log odds. The global rate of good labels is the prior of every
host's rate, the host's posterior that of its paths, each with a strength that fits the spread
between sites (moments), so sparse sites shrink to what is above them. The document's own
evidence is a classifier over hashed words: per-word log odds from labelled documents, summed,
and calibrated by bins of the sum. Words and bins are fitted on different halves of the labelled
documents, and a labelled document's own label is left out of its site's counts.

Site counts, rates and joins cover all labels and documents in grouped aggregations. The
classifier is fitted on at most `most_labelled` labelled documents, those with the smallest hashes of
their ids; that bounds the one broadcast.

A document's host and path come from pages whose URL ends in its id; without one, its source
stands for the host, and source and language for the path.

Defined results: a null text has no words and so only its site's evidence; null sources and
languages are sites of their own; null labels and ids do not count; a document labelled more than
once is good if at least half its labels are; without labels every quality is 0.5 and all is kept; an
empty table gives an empty result; whatever columns docs has, they come back under `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textcols as tc
from quillon.llm.tables import table, written

FEATURES = 1 << 16
MOST_LABELLED = 20_000
BINS = 32
BIN_STRENGTH = 10.0
SMOOTH = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
THRESHOLD = 0.5
ID_IN_URL = r"/(\d+)(?:/|\.html)?(?:[?#].*)?$"
HOST = r"^[a-z]+://(?:www\.|m\.)?([^/:?#]+)"
SECTION = r"^[a-z]+://[^/]+/([^/?#]*)/"


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of rows: (rows, row, feature) of each row's distinct hashed words."""
    data, offsets, _ = tc.text_buffer(column)
    for i, j in tc.slices(offsets):
        h, _, _, rows = tc.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tc.SPACES, lower=True)
        pairs = np.unique(rows * FEATURES + (h >> np.uint64(48)).astype(np.int64))
        yield j - i, pairs // FEATURES, pairs % FEATURES


def labelled(labels: DataFrame, *, doc_id: str, label: str) -> DataFrame:
    """(id, good): one row per labelled document."""
    return labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("good"))


def sites(pages: DataFrame) -> DataFrame:
    """(id, host, path) of the documents that pages name, the first URL of each."""
    url = F.lower("url")
    return pages.select(F.regexp_extract("url", ID_IN_URL, 1).alias("n"), url.alias("url")).where("n <> ''").groupBy(F.col("n").cast("long").alias("id")).agg(F.min("url").alias("url")).select("id", F.regexp_extract("url", HOST, 1).alias("host"), F.concat(F.regexp_extract("url", HOST, 1), F.lit("/"), F.regexp_extract("url", SECTION, 1)).alias("path"))


def word_weights(docs: DataFrame, sample: DataFrame, *, text: str, doc_id: str) -> np.ndarray:
    """Log odds of each feature by fold of the sample: rows fold 0, fold 1, both. sample(id, good, fold) is bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, FEATURES), np.int64)
        docs_of = np.zeros(4, np.int64)
        for batch in batches:
            cell = batch.column(1).to_numpy(zero_copy_only=False) * 2 + batch.column(2).to_numpy(zero_copy_only=False)
            docs_of += np.bincount(cell, minlength=4)
            at = 0
            for n, rows, feature in _features(batch.column(0)):
                np.add.at(total.reshape(-1), cell[at + rows] * FEATURES + feature, 1)
                at += n
        kind, feature = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*(kind * FEATURES + feature).tolist(), *(-1 - np.arange(4)).tolist()], pa.int64()), pa.array([*total[kind, feature].tolist(), *docs_of.tolist()], pa.int64())], ["cell", "n"])

    chosen = docs.select(F.col(text).alias("t"), F.col(doc_id).cast("long").alias("id")).join(F.broadcast(sample), "id").select("t", "fold", "good")
    found = chosen.mapInArrow(tc.tidied_batches(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts, n_docs = np.zeros(4 * FEATURES), np.zeros(4)
    for r in found:
        if r.cell < 0:
            n_docs[-1 - r.cell] = r.n
        else:
            counts[r.cell] = r.n
    counts = counts.reshape(2, 2, FEATURES)
    n_docs = n_docs.reshape(2, 2)
    counts, n_docs = np.concatenate([counts, counts.sum(0, keepdims=True)]), np.concatenate([n_docs, n_docs.sum(0, keepdims=True)])
    rate = (counts + SMOOTH) / (n_docs[:, :, None] + 2 * SMOOTH)
    return (np.log(rate[:, 1]) - np.log(rate[:, 0])).T.copy()


def evidence(docs: DataFrame, weights: np.ndarray, *, text: str) -> DataFrame:
    """docs (without text) under `doc`, and each document's sums of word weights: half0, half1 and both."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rest = [c for c in docs.columns if c != text]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            sums = [np.stack([np.bincount(rows, weights=w[feature, k], minlength=n) for k in range(3)]) for n, rows, feature in _features(batch.column(1))]
            s = np.concatenate(sums, axis=1) if sums else np.zeros((3, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in s.astype(float))], ["doc", "half0", "half1", "both"])

    return whole.mapInArrow(tc.tidied_batches(run), f"doc {whole.schema['doc'].dataType.simpleString()}, half0 double, half1 double, both double")


def _strength(groups: DataFrame, rate: float) -> float:
    """Strength of a Beta prior of mean `rate` whose spread is that between groups(n, good): moments, weighted by n."""
    r = groups.where("n > 0").agg(F.sum("n"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - rate, 2)), F.count("*")).first()
    if not r[0] or r[2] < 2:
        return MOST_STRENGTH
    within = rate * (1 - rate)
    between = r[1] / r[0] - within * r[2] / r[0]
    return MOST_STRENGTH if between <= 0 else min(MOST_STRENGTH, max(LEAST_STRENGTH, within / between - 1))


def _logit(p):
    return F.log(p / (1 - p))


def quality(docs: DataFrame, labels: DataFrame, pages: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang", label: str = "quality", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc (all columns but text), host, path, site_quality, word_evidence and quality, the posterior probability."""
    spark = docs.sparkSession
    known = labelled(labels, doc_id=doc_id, label=label)
    h = F.xxhash64("id")
    bound = known.select(h.alias("h")).orderBy("h").limit(most_labelled).agg(F.max("h")).first()[0]
    sample = known.where(h <= F.lit(bound)).select("id", "good", F.pmod(h, F.lit(2)).cast("int").alias("fold")) if bound is not None else known.where("false").withColumn("fold", F.lit(0))
    weights = word_weights(docs, sample, text=text, doc_id=doc_id)
    rows = evidence(docs, weights, text=text).withColumn("id", F.col(f"doc.`{doc_id}`").cast("long"))
    fold = F.when(h <= F.lit(bound), F.pmod(h, F.lit(2))) if bound is not None else F.lit(None)
    rows = rows.join(known.withColumn("fold", fold), "id", "left").join(sites(pages), "id", "left")
    name = F.concat(F.lit("source:"), F.coalesce(F.col(f"doc.`{source}`").cast("string"), F.lit("?")))
    section = F.concat(name, F.lit("/"), F.coalesce(F.col(f"doc.`{lang}`").cast("string"), F.lit("?")))
    rows = written(rows.select("doc", "id", "good", "fold", F.coalesce("host", name).alias("host"), F.coalesce("path", section).alias("path"), F.when(F.col("fold") == 0, F.col("half1")).when(F.col("fold") == 1, F.col("half0")).otherwise(F.col("both")).alias("evidence")), "evidence")
    judged = rows.where("good is not null")
    # a document has one label in a site, however often its row repeats
    votes = judged.select("host", "path", "id", "good").distinct()
    whole = votes.agg(F.count("*"), F.sum("good")).first()
    n, good = whole[0], whole[1] or 0
    rate = (good + 1.0) / (n + 2.0)
    paths = written(votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "hosts")
    for_host = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good")), rate)
    for_path = _strength(paths, rate)
    crossed = judged.where("fold is not null").select("id", "good", "evidence").distinct()
    cuts = crossed.agg(F.percentile_approx("evidence", F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), 2000)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array(F.lit(0.0))
    bin_of = F.size(F.filter(bounds, lambda c: c < F.col("evidence")))
    bins = crossed.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.sum("good").alias("good")).collect()
    base = float(np.log(rate / (1 - rate)))
    odds = [0.0] * (len(set(cuts)) + 1 if cuts else 2)
    for b in bins:
        r = (b.good + BIN_STRENGTH * rate) / (b.n + BIN_STRENGTH)
        odds[b.bin] = float(np.log(r / (1 - r))) - base
    own = F.when(F.col("good").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    own_good = F.coalesce("good", F.lit(0))
    d = rows.join(paths.withColumnRenamed("n", "path_n").withColumnRenamed("good", "path_good"), ["host", "path"], "left").join(hosts, "host", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    host_rate = (count("host_good") - own_good + for_host * rate) / (count("host_n") - own + for_host)
    site = (count("path_good") - own_good + for_path * host_rate) / (count("path_n") - own + for_path)
    d = d.withColumn("site_quality", site).withColumn("word_evidence", F.element_at(F.array(*[F.lit(x) for x in odds]), bin_of + 1))
    posterior = 1 / (1 + F.exp(-(_logit(F.col("site_quality")) + F.col("word_evidence"))))
    return d.select("doc", "host", "path", "site_quality", "word_evidence", posterior.alias("quality"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    d = quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "pages").select("url"))
    return d.select("doc.doc_id", "host", "path", "site_quality", "word_evidence", "quality", (F.col("quality") >= THRESHOLD).alias("kept"))
