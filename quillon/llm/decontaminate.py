r"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z. An item's windows are
its runs of `width` words, or all its words if it has fewer. The set of window hashes is
broadcast to the scan of the documents; each hit is confirmed word by word before it counts.
The set's size, in pairs of a window and an item that has it, is checked against `most_windows`
first; a larger set goes in blocks of about that many pairs, one scan each, so that no broadcast ever exceeds
the bound. A scan hands each row on with what was hit so far, so rows need no key and any number of blocks
gives the same result.

Defined results: null and empty texts have no words and are clean; an item without words
has no window; repeated rows are each answered; a null item_id counts as an item of its
own text but is not listed; spans are maximal runs of hit words; empty tables give empty results or clean documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textcols as tc
from quillon.llm.tables import table, written

WIDTH = 10
#: Pairs of window and item of one broadcast: about 100 bytes each, words included.
MOST_WINDOWS = 1_000_000
#: A character of a word, in a text that is not lower-cased yet.
A_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _split(text: bytes) -> list[bytes]:
    data = tc.LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = tc.word_bounds(data, np.array([0, len(data)]), tc.NON_WORD)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends, strict=True)]


def benchmark_windows(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(window, item) without repeats: normalised words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, items = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _split((t or "").encode())
                n = min(width, len(words))
                for k in range(len(words) - n + 1 if n else 0):
                    windows.append(b" ".join(words[k : k + n]).decode("utf-8", "replace"))
                    items.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(items, pa.string())], ["window", "item"])

    return benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).mapInArrow(tc.tidied_batches(run), "window string, item string").distinct()


class _Set:
    """Window hashes by their number of words, with the words themselves for confirmation."""

    def __init__(self, rows: list):
        by_window: dict[str, list[str]] = {}
        for r in rows:
            by_window.setdefault(r.window, []).append(r.item)
        self.windows = sorted(by_window)
        self.items = [by_window[w] for w in self.windows]
        texts = [w.encode() for w in self.windows]
        offsets = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        words, _, _, doc = tc.word_hashes(data, offsets, tc.NON_WORD)
        counts = np.bincount(doc, minlength=len(texts)) if len(texts) else np.zeros(0, int)
        firsts = np.cumsum(np.append(0, counts[:-1])) if len(texts) else counts
        self.tables = []
        for n in np.unique(counts):
            own = np.flatnonzero(counts == n)
            h = np.array([tc.window_hashes(words[firsts[k] : firsts[k] + n], int(n))[0] for k in own], np.uint64)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[h >> np.uint64(48)] = True
            self.tables.append((int(n), h[order], own[order], seen))

    def find(self, words: np.ndarray, rows: np.ndarray, spelled) -> Iterator[tuple[int, int, int]]:
        """(first word, number of words, window) of each confirmed occurrence; spelled(i, n) has the words."""
        for n, hashes, ids, seen in self.tables:
            h = tc.window_hashes(words, n)
            at = np.flatnonzero(seen[h >> np.uint64(48)] & tc.same_row(rows, n)) if len(h) else []
            if not len(at):
                continue
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            for i, a, b in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                text = spelled(i, n)
                for k in range(a, b):
                    if self.windows[ids[k]] == text:
                        yield i, n, int(ids[k])


def _hits(known: _Set, data: np.ndarray, offsets: np.ndarray) -> tuple:
    """Of texts in one buffer: rows, starts and ends of their words, which words are hit, and the windows of each row that has any."""
    part = tc.LOWER[data]
    words, starts, ends, rows = tc.word_hashes(part, offsets, tc.NON_WORD)
    raw = part.tobytes()
    change = np.zeros(len(words) + 1, np.int64)
    by_row: dict[int, set] = {}
    spelled = lambda k, n: b" ".join(raw[s:e] for s, e in zip(starts[k : k + n].tolist(), ends[k : k + n].tolist(), strict=True)).decode("utf-8", "replace")
    for k, n, w in known.find(words, rows, spelled):
        change[k] += 1
        change[k + n] -= 1
        by_row.setdefault(int(rows[k]), set()).add(w)
    return rows, starts, ends, np.cumsum(change[:-1]) > 0, by_row


def _edges(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of the runs of hit words."""
    edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _without(whole: bytes, firsts: np.ndarray, lasts: np.ndarray) -> bytes:
    cuts = [0, *(x for s in zip(firsts.tolist(), lasts.tolist(), strict=True) for x in s), len(whole)]
    return b"".join(whole[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))


def _settled(known: _Set, whole: bytes) -> bytes:
    """What is left of a text once nothing in it is hit: cutting joins words, which can make a new window."""
    while True:
        _, starts, ends, hit, by_row = _hits(known, np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))
        if not by_row:
            return whole
        first, last = _edges(hit)
        whole = _without(whole, starts[first], ends[last])


_STATE = "n_words long, hits binary, spans array<struct<first:bigint,last:bigint>>, items array<string>, rest string"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _scan(docs: DataFrame, found: _Set, text: str) -> DataFrame:
    """docs (doc: a row's columns; hits, items: of earlier scans, null at first) with what the set adds, spans of all hits, and the rest of a text that has any,
    in which the set hits nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(found)
    at_text = docs.schema["doc"].dataType.names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            data, offsets, _ = tc.text_buffer(batch.column(0).field(at_text))
            before, listed = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            n_words, hits, spans, items, rest = [], [], [], [], []
            for i, j in tc.slices(offsets):
                o = offsets[i : j + 1] - offsets[i]
                rows, starts, ends, hit, by_row = _hits(known, data[offsets[i] : offsets[j]], o)
                firsts = np.searchsorted(rows, np.arange(j - i + 1))
                for r in range(j - i):
                    a, b = firsts[r], firsts[r + 1]
                    n_words.append(int(b - a))
                    old = before[i + r]
                    if r not in by_row and old is None:
                        hits.append(None)
                        spans.append([])
                        items.append([])
                        rest.append(None)
                        continue
                    own = hit[a:b]
                    if old is not None:
                        own = own | np.unpackbits(np.frombuffer(old, np.uint8), count=b - a).astype(bool)
                    hits.append(np.packbits(own).tobytes())
                    first, last = _edges(own)
                    begin, end = starts[first + a] - o[r], ends[last + a] - o[r]
                    spans.append([{"first": s, "last": e} for s, e in zip(begin.tolist(), end.tolist(), strict=True)])
                    items.append(sorted({x for w in by_row.get(r, ()) for x in known.items[w] if x is not None}.union(listed[i + r] or ())))
                    left = _without(data[offsets[i + r] : offsets[i + r + 1]].tobytes(), begin, end)
                    rest.append(_settled(known, left).decode("utf-8", "replace"))
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "n_words", "hits", "spans", "items", "rest"])

    return docs.select("doc", "hits", "items").mapInArrow(tc.tidied_batches(run), f"doc {docs.schema['doc'].dataType.simpleString()}, {_STATE}")


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", width: int = WIDTH, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """docs' columns under `doc`, with n_words, n_hit, spans (bytes of hit words), items (sorted) and rest, the text without the
    spans, and without what is hit in it again, by windows of the last block where they go in several; null where there are no spans."""
    windows = benchmark_windows(benchmark, width=width)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    blocks = _n_blocks(windows, most_windows)
    if blocks > 1:
        windows = written(windows, "windows")
    for b in range(blocks):
        own = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b)
        d = _scan(d, _Set(own.collect()), text)
        if b + 1 < blocks:
            d = written(d, "scanned")
    return d.select("doc", "n_words", _n_bits("hits").alias("n_hit"), "spans", "items", "rest")


def _n_bits(column: str):
    """Ones in packed bits, from the digits of their hexadecimal form."""
    h = F.hex(column)
    counts = [int(x).bit_count() for x in range(16)]
    total = F.lit(0)
    for v in range(1, 16):
        total = total + F.lit(counts[v]) * (F.length(h) - F.length(F.replace(h, F.lit(f"{v:X}"), F.lit(""))))
    return F.coalesce(total, F.lit(0)).cast("long")


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs without their hit spans, until no window is left; a document of which no word is left goes.

    Windows in one block settle a text where it is scanned; several blocks take turns over the written rows until none hits anything.
    """
    blocks = _n_blocks(benchmark_windows(benchmark, width=options.get("width", WIDTH)), options.get("most_windows", MOST_WINDOWS))
    while True:
        d = contamination(docs, benchmark, text=text, **options)
        if blocks > 1:
            d = written(d, "hit")
        left = F.when(F.col("n_hit") > 0, F.col("rest")).otherwise(F.col(f"doc.`{text}`"))
        kept = d.where((F.col("n_hit") == 0) | F.col("rest").rlike(A_WORD))
        docs = kept.select(*[left.alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns])
        if blocks == 1 or d.where("n_hit > 0").isEmpty():
            return docs


def _n_blocks(windows: DataFrame, most_windows: int) -> int:
    return max(1, -(-windows.count() // most_windows))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join("items", ",")
    return d.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


EMPTY_SHA = hashlib.sha256(b"").hexdigest()

WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, {WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths)),
hits AS (SELECT r.doc_id, r.n, r.i, x.item FROM runs r JOIN windows x ON r.win = x.win AND r.n = x.n),
words AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item)::BIGINT AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, '{EMPTY_SHA}') AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
