"""Periodic runs of words: stretches that repeat a period of q words at least `times` times in a row.

Recursive frequency splitting comes first. A run of `times` periods holds each of its words at least `times`
times, so a word that is rarer than that within its segment is in no run of it, and cuts it. What is left is cut
again until no word is too rare; the largest piece of a segment inherits its parent's counts, so that all
cuts together take n log n steps. Few segments survive in prose.

Survivors are scanned by lags, one octave [Q, 2Q) at a time. A run of such a lag holds the whole block of Q words at
some multiple of Q twice, `lag` words apart; equal blocks are found by their hashes, and each lag found so
is extended to both sides by bisection over prefix hashes. Runs are then compared word by word; hashes decide
nothing, as two equal stretches have equal hashes and a run that only hashes saw has the segment scanned
by plain comparison at all lags. Of lags with the same stretch the least is the period: a multiple of a period
has the same maximal stretch. Time and memory are those of a segment's words times octaves.

Defined results: null and empty texts have no words and no runs, and '' as what is left; rows that repeat
have equal results; a text is handled whole however long it is; an empty table gives an empty result; all
columns but the text come back under `doc`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textcols as tc
from quillon.llm.tables import SPACE_WORDS, table

#: Least length of a run in words and in periods.
LEAST, TIMES = 6, 4
_MULT = 0xD1342543DE82EF95
_U = np.uint64


def segments(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of the stretches in which every word occurs at least `times` times, after cutting at rarer ones until nothing changes."""
    out, todo = [], [(0, ids)]
    while todo:
        base, sub = todo.pop()
        words, sub = np.unique(sub, return_inverse=True)
        counts = np.bincount(sub, minlength=len(words))
        if counts.min() >= times:
            out.append((base, base + len(sub)))
            continue
        if counts.max() < times:
            continue
        order = np.argsort(sub, kind="stable")
        first = np.concatenate([[0], np.cumsum(counts)])
        low, high, rare = 0, len(sub), np.flatnonzero(counts < times)
        while len(rare) and high - low >= least:
            at = np.sort(np.concatenate([order[first[r] : first[r + 1]] for r in rare.tolist()])) if len(rare) < 64 else np.flatnonzero(np.isin(sub, rare))
            at = at[(at >= low) & (at < high)]
            edges = np.concatenate([[low - 1], at, [high]])
            sizes = np.diff(edges) - 1
            big = int(sizes.argmax())
            todo += [(base + int(edges[i]) + 1, sub[edges[i] + 1 : edges[i + 1]]) for i in np.flatnonzero(sizes >= least).tolist() if i != big]
            new_low, new_high = int(edges[big]) + 1, int(edges[big + 1])
            gone = np.concatenate([sub[low:new_low], sub[new_high:high]])
            low, high = new_low, new_high
            which, n = np.unique(gone, return_counts=True)
            counts[which] -= n
            rare = which[(counts[which] < times) & (counts[which] > 0)]
        if high - low >= least:
            out.append((base + low, base + high))
    return sorted(out)


def _extended(pre: np.ndarray, power: np.ndarray, at: np.ndarray, lag: np.ndarray, n: int, forward: bool) -> np.ndarray:
    """How far from `at` words equal those `lag` later, forwards (at included) or backwards (at excluded)."""
    most = n - lag - at if forward else at
    low, high = np.zeros_like(at), most.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        a, b = (at, at + mid) if forward else (at - mid, at)
        same = (pre[b] - pre[a]) * power[lag] == pre[b + lag] - pre[a + lag]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)


def _stretches(ids: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, lag) that hashes take for maximal stretches of at least `times` lags; all true ones are there."""
    n = len(ids)
    power = np.full(n + 1, _MULT, _U)
    power[0] = 1
    np.cumprod(power, out=power)
    code = tc.mix(ids.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1))
    pre = np.concatenate([np.zeros(1, _U), np.cumsum(code * power[:n])])
    out, q = [np.zeros((0, 3), np.int64)], 1
    while times * q <= n:
        # blocks of q words, each brought to the same power
        block = (pre[q:] - pre[:-q]) * power[n - q :: -1]
        anchors = np.arange(0, n - q + 1, q)
        values, mine = np.unique(block[anchors], return_inverse=True)
        which = np.minimum(np.searchsorted(values, block), len(values) - 1)
        kept = np.flatnonzero(values[which] == block)
        kept = kept[np.argsort(which[kept], kind="stable")]
        # (block, position) ascending; of an anchor's block, those at [anchor + q, anchor + 2q)
        keys, mine = which[kept] * (4 * n) + kept, mine * (4 * n) + anchors
        left, right = np.searchsorted(keys, mine + q), np.searchsorted(keys, mine + 2 * q)
        count = right - left
        rows = np.repeat(np.arange(len(anchors)), count)
        pick = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
        at, lag = anchors[rows], kept[pick] - anchors[rows]
        # of neighbouring anchors with the same lag, which lie in the same stretch, the first
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        first = np.concatenate([[True], (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + q)])[: len(at)]
        at, lag = at[first], lag[first]
        q *= 2
        if len(at):
            start = at - _extended(pre, power, at, lag, n, False)
            length = at + _extended(pre, power, at, lag, n, True) + lag - start
            keep = length >= np.maximum(least, times * lag)
            out.append(_least_lags(np.stack([start, length, lag], axis=1)[keep]))
    return _least_lags(np.concatenate(out))


def _least_lags(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, length, lag) of the same stretch, the one of least lag; ascending."""
    rows = np.unique(rows, axis=0)
    return rows[np.unique(rows[:, :2], axis=0, return_index=True)[1]]


def _all_lags(ids: np.ndarray, least: int, times: int) -> np.ndarray:
    """What _stretches gives, by plain comparison at every lag."""
    out, n = [np.zeros((0, 3), np.int64)], len(ids)
    for lag in range(1, n // times + 1):
        same = np.concatenate([[False], ids[lag:] == ids[:-lag], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        start, length = edges[::2], edges[1::2] - edges[::2] + lag
        keep = length >= max(least, times * lag)
        out.append(np.stack([start[keep], length[keep], np.full(int(keep.sum()), lag)], axis=1))
    return _least_lags(np.concatenate(out))


def _maximal(ids: np.ndarray, start: int, length: int, lag: int) -> bool:
    """Is this a stretch of the lag, and can it grow to neither side?"""
    end = start + length
    return bool(np.array_equal(ids[start : end - lag], ids[start + lag : end])) and (start == 0 or ids[start - 1] != ids[start + lag - 1]) and (end == len(ids) or ids[end] != ids[end - lag])


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of every maximal run of at least `times` periods and `least` words, by start, then period."""
    out = [np.zeros((0, 3), np.int64)]
    for low, high in segments(ids, least, times) if len(ids) >= least else ():
        sub = ids[low:high]
        found = _stretches(sub, least, times)
        if not all(_maximal(sub, *r) for r in found.tolist()):
            found = _all_lags(sub, least, times)
        out.append(found + np.array([low, 0, 0]))
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def periodic_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc (all columns but text), n_words, runs (start, length, period; by start, then period) and collapsed, the text without what repeats."""
    rest = [c for c in docs.columns if c != text]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), F.col(f"`{text}`").cast("binary").alias("t"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, left = [], [], []
            for value in batch.column(1):
                words = (value.as_py() or b"").split()
                rows = runs(numbers(words), least, times)
                n.append(len(words))
                found.append([{"start": s, "length": m, "period": q} for s, m, q in rows.tolist()])
                left.append(collapsed(words, rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(left, pa.binary()).cast(pa.string())], ["doc", "n_words", "runs", "collapsed"])

    return whole.mapInArrow(tc.tidied_batches(run), f"doc {whole.schema['doc'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """documents as the query takes them: where h = crc32(doc_id) ends in 0, word i >= a is word a + (i - a) % p. A null id counts as the text ''."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words, a, p = F.col("_words"), F.col("_a"), F.col("_p")
    n, g = F.size(words), F.floor(h / 10)
    d = docs.withColumn("_words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({SPACE_WORDS})"), F.lit(1))))
    d = d.withColumn("_a", F.when(n > 0, F.pmod(g, n).cast("int")))
    d = d.withColumn("_p", F.when(n > 0, (1 + F.floor((n - a) / (3 + g % 8))).cast("int")))
    loop = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.slice(F.concat(F.slice(words, F.lit(1), a), loop), F.lit(1), n)
    return d.withColumn("text", F.when(n > 0, F.concat_ws(" ", repeated)).otherwise(F.col("text"))).drop("_words", "_a", "_p")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic_runs(looped(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))))
    d = d.withColumn("_best", best)
    length, period = F.col("_best.length"), -F.col("_best.period")
    return d.select(
        "doc.doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
