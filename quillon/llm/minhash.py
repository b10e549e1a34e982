r"""Near-duplicate documents by b-bit MinHash.

A document is the set of its runs of `words` lower-cased words; a shorter one is one run. The
minima of PERMUTATIONS hash functions give band keys (BANDS of ROWS minima) and a packed
signature of the minima's low BITS bits. Documents of equal sets form a class. Classes that share
a band key are candidates; their similarity is estimated from the signatures by bit counts,
corrected for chance agreement of 2**-BITS. What is clearly below the threshold goes, everything else is
confirmed on the full sets. A pair at similarity 0.8 shares no band with probability
(1 - 0.8**4)**32 = 5e-8, and the estimate's margin is more than five standard deviations.

No bucket is expanded into pairs. First each class meets the least class of its buckets, and
confirmed links are joined to components. Then only buckets that still hold more than one component
matter: their classes outside the bucket's first component are compared with the others, in blocks, by
signatures first and then by full sets. So no link between components is lost, and pairs within a
component are not looked at.

Defined results: null and empty texts and texts without words have empty sets and are linked
with nothing; rows that share an id are one document; a row with a null id (and 2**63 - 1 counts as null) belongs to the
class of an equal document with an id and is otherwise linked with nothing; an empty table gives an empty result.
Words are known by 64 bits that are mixed of two independent hashes, those of over 16 bytes by cryptographic ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textcols as tc
from quillon.llm.components import components
from quillon.llm.tables import table, written

PERMUTATIONS, BANDS, ROWS, BITS = 128, 32, 4, 4
WORDS = 5
PERCENT = 80
MARGIN = 0.2
BLOCK = 2048
NO_ID = (1 << 63) - 1
_RNG = np.random.default_rng(5)
_A = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, name) of each row's distinct shingles, sorted by both; a name is mixed of two hashes."""
    h, h2, rows = tc.word_hashes_twice(data, offsets, tc.SPACES, lower=True)
    h = tc.mix(h * np.uint64(tc._MULT) + h2)
    n_rows = len(offsets) - 1
    ok = np.flatnonzero(tc.same_row(rows, words))
    found, owner = tc.window_hashes(h, words)[ok], rows[ok]
    counts = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        firsts = np.searchsorted(rows, short)
        found = np.concatenate([found, tc.run_hashes(h, firsts, firsts + counts[short], tc._MULT_W)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], found[new]


def minima(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with shingles, their minima under each permutation)."""
    rows, firsts = np.unique(owner, return_index=True)
    out = np.empty((len(rows), PERMUTATIONS), np.uint64)
    for i in range(PERMUTATIONS if len(rows) else 0):
        out[:, i] = np.minimum.reduceat(hashes * _A[i] + _B[i], firsts)
    return rows, out


def _members(owner: np.ndarray, names: np.ndarray, n_rows: int) -> list[bytes]:
    """Each row's set: its shingles' names in ascending order."""
    ends = np.cumsum(np.bincount(owner, minlength=n_rows)).tolist()
    return [names[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _digest(members: bytes) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def packed(low: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words holding the low BITS bits of each minimum."""
    per = 64 // BITS
    parts = tc.mix(low.copy()) & np.uint64((1 << BITS) - 1)
    shifts = (np.arange(PERMUTATIONS) % per * BITS).astype(np.uint64)
    return np.bitwise_or.reduce((parts << shifts).reshape(len(low), PERMUTATIONS // per, per), axis=2)


def band_keys(m: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(m), BANDS), np.uint64)
    for r in range(ROWS):
        keys = tc.mix(keys * np.uint64(tc._MULT) + m[:, r :: ROWS][:, :BANDS] + np.uint64(r + 1))
    return tc.mix(keys ^ (np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)))


SKETCH = "ident long, n_shingles long, digest binary, signature array<long>, bands array<long>"


def sketches(docs: DataFrame, *, text: str, doc_id: str, words: int) -> DataFrame:
    """(ident, n_shingles, digest of the set, signature, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = tc.text_buffer(batch.column(1))
            for i, j in tc.slices(offsets):
                owner, h = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                n = np.bincount(owner, minlength=j - i)
                digests = [_digest(x) for x in _members(owner, h, j - i)]
                rows, m = minima(owner, h)
                s, b = np.zeros((j - i, PERMUTATIONS * BITS // 64), np.uint64), np.zeros((j - i, BANDS), np.uint64)
                s[rows], b[rows] = packed(m), band_keys(m)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists(s), lists(b)], SKETCH.replace(",", "").split(" ")[::2])

    ident = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    return docs.select(ident.alias("ident"), F.col(text).alias("t")).mapInArrow(tc.tidied_batches(run), SKETCH)


def _estimate(a: str, b: str):
    """Similarity from two signatures: agreeing groups of BITS bits, corrected for chance."""
    ones = F.lit(int("1" * (64 // BITS), 1 << BITS) if BITS > 1 else -1)
    differ = F.lit(0)
    for i in range(PERMUTATIONS * BITS // 64):
        x = F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))
        y = x
        for k in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(y.bitwiseAND(ones))
    chance = 2.0**-BITS
    return (1 - differ / PERMUTATIONS - chance) / (1 - chance)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) that sizes and signatures allow to be similar."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    p = p.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return p.where(_estimate("s_a", "s_b") >= percent / 100 - MARGIN).select("a", "b")


def _sets(docs: DataFrame, wanted: DataFrame, *, text: str, doc_id: str, words: int) -> DataFrame:
    """(want, members) of the wanted(v, want) documents, want being the digest of the set: the shingles' names, packed; rows that share an id count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = tc.text_buffer(batch.column(1))
            for i, j in tc.slices(offsets):
                members = _members(*shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words), j - i)
                digests = [_digest(x) for x in members]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(digests, pa.binary()), pa.array(members, pa.binary())], ["v", "want", "digest", "members"])

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("v"), F.col(text).alias("t"))
    found = rows.join(wanted, "v").select("v", "t", "want").mapInArrow(tc.tidied_batches(run), "v long, want binary, digest binary, members binary")
    return found.where("digest = want").select("want", "members").dropDuplicates(["want"])


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                ok.append(_linked(_names(x.as_buffer()), _names(y.as_buffer()), percent))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keep], ["a", "b", "ok"])

    side = lambda x: classes.select(F.col("rep").alias(x), F.col("digest").alias(f"d_{x}"))
    full = lambda x: sets.select(F.col("want").alias(f"d_{x}"), F.col("members").alias(f"m_{x}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b").join(full("b"), "d_b").join(full("a"), "d_a").select("a", "b", "m_a", "m_b")
    return p.mapInArrow(tc.tidied_batches(run), "a long, b long, ok boolean").where("ok").select("a", "b")


CELL = "key long, i int, j int, rep long"


def _cells(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, band, i, j, rep, label, asks): the blocks of mixed buckets that are to be compared.

    A mixed bucket holds more than one component. Its rows outside its first component, in
    blocks, meet all its rows, in blocks; `asks` tells the two sides apart.
    """
    named = written(buckets.join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "named")
    mixed = named.groupBy("key").agg(F.min("band").alias("band"), F.min("label").alias("first"), F.max("label").alias("last"), F.count("*").alias("n")).where("first <> last")
    rows = named.join(mixed.select("key", "band", "first", "n"), ["key", "band"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = written(rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "mixed")
    outside = rows.where("label <> first")
    left = outside.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "band", F.col("block").alias("i"), "j", "rep", "label", F.lit(True).alias("asks"))
    asking = outside.select("key", "band", F.col("block").alias("i")).distinct()
    right = rows.join(asking, ["key", "band"]).select("key", "band", "i", F.col("block").alias("j"), "rep", "label", F.lit(False).alias("asks"))
    return left.unionAll(right)


def _compared(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each asking row of a cell, the other side's rows of other components that sizes and signatures
    allow to be linked with it, and that share no earlier band, where the same two meet already."""
    asks = table.column("asks").to_numpy()
    band = table.column("band")[0].as_py()
    label, n = table.column("label").to_numpy(), table.column("n_shingles").to_numpy()
    s = np.array(table.column("signature").to_pylist(), np.int64).view(np.uint64)
    earlier = np.array(table.column("bands").to_pylist(), np.int64)[:, :band]
    ones = np.uint64(int("1" * (64 // BITS), 1 << BITS))
    chance, floor = 2.0**-BITS, percent / 100 - MARGIN
    rest = np.flatnonzero(~asks)
    for k in np.flatnonzero(asks).tolist():
        m = rest[(label[rest] != label[k]) & (100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k]))]
        y = s[m] ^ s[k]
        x = y.copy()
        for v in range(1, BITS):
            y |= x >> np.uint64(v)
        agree = 1 - np.bitwise_count(y & ones).sum(1) / PERMUTATIONS
        m = m[(agree - chance) / (1 - chance) >= floor]
        m = m[~(earlier[m] == earlier[k]).any(1)]
        if len(m):
            yield k, m


def _residual(cells: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, **options) -> DataFrame:
    """Links between components that share a bucket, at least one for each two components that have any.

    First each cell names the rows that take part in a possible link; these get their full sets, and
    each cell confirms in place, so that only links leave it, never pairs.
    """
    known = classes.select("rep", "n_shingles", "signature", "bands")

    def name(table: pa.Table) -> pa.Table:
        found: set[int] = set()
        for k, m in _compared(table, percent):
            found.add(k)
            found.update(m.tolist())
        return table.select(["key", "i", "j", "rep", "asks"]).take(pa.array(sorted(found), pa.int64()))

    taking = written(cells.join(known, "rep").groupBy("key", "i", "j").applyInArrow(tc.tidied(name), CELL + ", asks boolean"), "taking")
    sets = written(_sets(docs, taking.select("rep").distinct().join(classes.select("rep", "digest"), "rep").select(F.col("rep").alias("v"), F.col("digest").alias("want")), **options), "sets")
    full = classes.select("rep", "digest").join(sets.withColumnRenamed("want", "digest"), "digest").select("rep", "members")

    def confirm(table: pa.Table) -> pa.Table:
        rep, label = table.column("rep").to_numpy(), table.column("label").to_numpy()
        members = [_names(x) for x in table.column("members").to_pylist()]
        links, met = [], set()
        for k, m in _compared(table, percent):
            for other in m.tolist():
                pair = (label[k], label[other])
                if pair not in met and _linked(members[k], members[other], percent):
                    met.add(pair)
                    links.append((min(rep[k], rep[other]), max(rep[k], rep[other])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    rows = taking.join(cells, ["key", "i", "j", "rep", "asks"]).join(known, "rep").join(full, "rep")
    return rows.groupBy("key", "i", "j").applyInArrow(tc.tidied(confirm), "a long, b long").distinct()


def _names(members) -> np.ndarray:
    return np.frombuffer(members, np.uint64)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Are two sets of names, both in ascending order, similar enough?"""
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(ident, n_shingles, component) of every row; ident NO_ID is a null id."""
    return _with_components(docs, text=text, doc_id=doc_id, words=words, percent=percent).drop("digest")


def _with_components(docs: DataFrame, *, text: str, doc_id: str, words: int, percent: int) -> DataFrame:
    """near_duplicates and the digest of each row's set, null for an empty one."""
    options = {"text": text, "doc_id": doc_id, "words": words}
    rows = written(sketches(docs, **options), "sketches")
    full = rows.where("n_shingles > 0")
    classes = written(full.groupBy("digest").agg(F.min("ident").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands")).where(f"low <> {NO_ID}").withColumnRenamed("low", "rep"), "classes")
    buckets = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    leaders = buckets.groupBy("key").agg(F.min("band").alias("band"), F.min("rep").alias("a"), F.max("rep").alias("last")).where("a <> last")
    shared = written(buckets.join(leaders.select("key", "band", "a"), ["key", "band"]), "buckets")
    classes_slim = classes.select("rep", "digest", "n_shingles", "signature")
    met = written(_likely(shared.where("a <> rep").select("a", F.col("rep").alias("b")).distinct(), classes_slim, percent), "pairs")
    wanted = met.select(F.col("a").alias("rep")).unionAll(met.select(F.col("b").alias("rep"))).distinct()
    sets = written(_sets(docs, wanted.join(classes_slim, "rep").select(F.col("rep").alias("v"), F.col("digest").alias("want")), **options), "sets")
    links = written(_confirmed(met.groupBy("b").agg(F.min("a").alias("a")), classes_slim, sets, percent), "links")
    labels = components(links)
    others = _other_components(met, labels)
    more = written(_confirmed(others, classes_slim, sets, percent), "links")
    if not more.isEmpty():
        links = links.unionAll(more)
        labels = components(links)
    cells = written(_cells(shared.select("rep", "band", "key"), labels), "cells")
    last = written(_residual(cells, classes, docs, percent, **options), "links")
    if not last.isEmpty():
        labels = components(links.unionAll(last))
    named = written(classes.select("digest", "rep").join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component")), "named")
    out = rows.select("ident", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select("ident", "n_shingles", F.coalesce("component", "ident").alias("component"), "digest")


def _other_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    side = lambda x: labels.select(F.col("v").alias(x), F.col("label").alias(f"l_{x}"))
    p = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return p.where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).select("a", "b")


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without those whose component has a smaller id.

    Rows of one id may hold several texts, and null ids are no id: a row goes by its id and its set.
    """
    found = _with_components(docs, text=text, doc_id=doc_id, words=words, percent=percent)
    gone = found.where("component < ident").select("ident", "digest").distinct()
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = tc.text_buffer(batch.column(1).field(at))
            for i, j in tc.slices(offsets):
                members = _members(*shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words), j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([_digest(x) for x in members], pa.binary()), batch.column(1).slice(i, j - i)], ["ident", "digest", "row"])

    ident = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID))
    rows = docs.select(ident.alias("ident"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = rows.mapInArrow(tc.tidied_batches(run), "ident long, digest binary, row " + docs.schema.simpleString())
    return keyed.join(gone, ["ident", "digest"], "left_anti").select("row.*")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=2)
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(null("ident").alias("doc_id"), "n_shingles", null("component").alias("component_id"), (F.col("ident") == F.col("component")).alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_shared FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * n_shared >= 80 * (p.n + q.n - n_shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS v, doc_id AS root FROM docs
  UNION
  SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.v WHERE r.root < w.b),
least AS (SELECT v, min(root) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN least ON v = d.doc_id
"""
