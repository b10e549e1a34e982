"""Suffix-array dedup: suffixes ordered through `width` bytes by most-significant-digit passes.

Equal windows of `width` bytes are suffixes that are alike through `width` bytes. Three steps, over chunks of
documents and parts (see exchange):

1. The dealing pass. Its digit is cut by content: of the GRAM-byte strings in a window, the one
   with the least hash. Equal windows have the same digit at the same place, so they are dealt to the
   same part, while one digit stands for some seventy neighbouring suffixes. The screen drops digits that occur once:
   their suffixes are settled.
2. A chunk sends each run of neighbouring suffixes with one digit as a string, once however often it occurs there.
   A part orders whole runs first: equal ones repeat as they are and go on as one.
3. Where a digit still has different runs, each of their suffixes is ordered from its first byte on by
   digits of eight bytes, group by group, through `width` bytes; a suffix that is alone in its group
   drops out (radix.tied). The groups left are exactly the repeated windows.

Every comparison is of bytes; hashes only deal and propose.

Defined results: texts are UTF-8 bytes, null is empty; texts shorter than `width` keep all;
null ids and repeated rows are documents like others; matches never cross documents; all columns but
the text come back under `doc`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import exchange as ex
from quillon.llm import radix
from quillon.llm import textcols as tc
from quillon.llm.tables import table

WIDTH = 200
GRAM = 64
#: Suffixes that a part orders at once, but for a digit that leads more.
ORDERED = 1 << 18
_LOW = np.uint64(0xFFFFFFFF)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each `width` neighbours, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _runs(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their digit: first starts, last starts + 1, digits, and hashes of the runs' strings."""
    lengths, n = np.diff(offsets), len(data)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    codes = tc._BYTE_CODES[data]
    at = np.arange(n - gram + 1)
    grams = tc.run_hashes(codes, at, at + gram)
    packed = (grams & ~_LOW) | at.astype(np.uint64)
    anchor = (sliding_min(packed, width - gram + 1) & _LOW).astype(np.int64)
    fits = np.zeros(n - width + 1, bool)
    for a, m in zip(offsets[:-1][lengths >= width].tolist(), lengths[lengths >= width].tolist(), strict=True):
        fits[a : a + m - width + 1] = True
    edge = np.ones(len(fits), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (fits[1:] != fits[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(fits))
    ok = fits[first]
    # rows of at least `width` bytes that lie side by side are parted by the windows across them
    starts, ends = first[ok], last[ok]
    # least hashes lie close together; mixed again they are dealt evenly
    return starts, ends, tc.mix(grams[anchor[starts]]), tc.run_hashes(codes, starts, ends + width - 1)


class _Chunk:
    def __init__(self, rows: pa.Table, width: int, gram: int, n_parts: int):
        self.data, self.offsets, self.valid = ex.texts(rows)
        self.width, self.n_parts = width, n_parts
        found = []
        for i, j in tc.slices(self.offsets):
            base = int(self.offsets[i])
            s, e, d, h = _runs(self.data[base : self.offsets[j]], self.offsets[i : j + 1] - base, width, gram)
            found.append((s + base, e + base, d, h))
        join = lambda k, kind: np.concatenate([x[k] for x in found]) if found else np.zeros(0, kind)
        self.starts, self.ends, self.digit, self.hash = join(0, np.int64), join(1, np.int64), join(2, np.uint64), join(3, np.uint64)
        self.keys, self.key = np.unique(ex.screen_keys(self.digit, n_parts), return_inverse=True)

    def survivors(self, bits: dict[int, bytes]) -> None:
        """Runs whose digit occurs again, here or elsewhere, and their classes."""
        again = ex.passed(self.keys, bits) | (np.bincount(self.key, minlength=len(self.keys)) > 1)
        self.run = np.flatnonzero(again[self.key])
        size = self.ends[self.run] - self.starts[self.run] + self.width - 1
        self.of, one, kinds = radix.classes(self.data, self.starts[self.run], size, self.hash[self.run])
        self.times = np.bincount(self.of, minlength=len(one))
        self.begin, self.size, self.own_digit = self.starts[self.run][one], size[one], self.digit[self.run][one]
        parts = ex.parts_of(self.own_digit, self.n_parts)
        self.order = np.lexsort((kinds, parts))
        self.parts = parts[self.order]

    def blobs(self) -> list[tuple[int, bytes]]:
        z, out = zstandard.ZstdCompressor(level=1), []
        for p, a, b in ex.pieces(self.parts):
            own = self.order[a:b]
            whole = radix.gathered(self.data, self.begin[own], self.size[own])
            out.append((p, z.compress(b"".join([struct.pack("<q", b - a), self.own_digit[own].tobytes(), self.size[own].astype("<u4").tobytes(), (self.times[own] > 1).tobytes(), whole.tobytes()]))))
        return out

    def repeated(self, bits: dict[int, bytes]) -> np.ndarray:
        """Bytes that some repeated window covers."""
        windows = self.size - self.width + 1
        flags, at = np.zeros(0, bool), np.zeros(len(self.order), np.int64)
        found, n = [], 0
        for p, a, b in ex.pieces(self.parts):
            own = self.order[a:b]
            each = windows[own]
            at[own] = n + np.cumsum(each) - each
            found.append(np.unpackbits(np.frombuffer(bits[p], np.uint8), count=int(each.sum())))
            n += len(found[-1])
        flags = np.concatenate(found).astype(bool) if found else flags
        # each run's windows, by its class's answer
        count = windows[self.of]
        again = radix.gathered(flags, at[self.of], count)
        start = np.repeat(self.starts[self.run] - (np.cumsum(count) - count), count) + np.arange(len(again))
        change = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(change, start[again], 1)
        np.add.at(change, start[again] + self.width, -1)
        return np.cumsum(change[:-1]) > 0


def _batches(groups: np.ndarray, weights: np.ndarray, most: int = ORDERED) -> Iterator[slice]:
    """Slices of ascending groups, whole ones, of about `most` weight."""
    ends = np.append(np.flatnonzero(groups[1:] != groups[:-1]) + 1, len(groups)) if len(groups) else np.zeros(0, int)
    sums, a = np.cumsum(weights), 0
    while a < len(groups):
        reach = np.searchsorted(sums, (sums[a - 1] if a else 0) + most, "right")
        b = int(ends[min(np.searchsorted(ends, max(reach, a + 1)), len(ends) - 1)])
        yield slice(a, b)
        a = b


def _ordered(blobs: list[bytes], width: int) -> list[bytes]:
    """For each chunk's runs: which of their windows repeat?"""
    z = zstandard.ZstdDecompressor()
    raw = [z.decompress(b) for b in blobs]
    counts = [struct.unpack_from("<q", r)[0] for r in raw]
    read = lambda kind, at: np.concatenate([np.frombuffer(r, kind, n, 8 + at * n) for r, n in zip(raw, counts, strict=True)])
    digit, size, twice = read("<u8", 0), read("<u4", 8).astype(np.int64), read(bool, 12)
    data = np.concatenate([np.frombuffer(r, np.uint8, -1, 8 + 13 * n) for r, n in zip(raw, counts, strict=True)])
    del raw
    starts = np.cumsum(size) - size
    digits, led = np.unique(digit, return_inverse=True)
    run = radix.tied(data, starts, size, led)
    alone = run < 0
    run[alone] = -1 - np.flatnonzero(alone)
    _, one, kind = np.unique(run, return_index=True, return_inverse=True)
    whole = np.bincount(kind, weights=1 + twice, minlength=len(one)) > 1
    windows = size[one] - width + 1
    first = np.cumsum(windows) - windows
    again = np.repeat(whole, windows)
    mixed = np.flatnonzero(np.bincount(led[one], minlength=len(digits))[led[one]] > 1)
    mixed = mixed[np.argsort(led[one][mixed], kind="stable")]
    for own in _batches(led[one][mixed], windows[mixed]):
        own = mixed[own]
        count, lengths = windows[own], size[one][own]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        base = np.cumsum(lengths) - lengths
        tied = radix.tied(radix.gathered(data, starts[one][own], lengths), np.repeat(base, count) + step, np.full(len(step), width), np.repeat(led[one][own], count))
        again[(np.repeat(first[own], count) + step)[tied >= 0]] = True
    out, n = [], 0
    for c in counts:
        own = kind[n : n + c]
        n += c
        out.append(np.packbits(radix.gathered(again, first[own], windows[own])).tobytes())
    return out


def repeated_bytes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc (all columns but the text), n_bytes, n_removed, spans (maximal removed runs of bytes) and kept (binary)."""
    chunks, n_parts = ex.chunked(docs, text=text, doc_id=doc_id)
    by_chunk = chunks.groupBy("chunk")

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        return ex.asked(key[0].as_py(), ex.screen_blobs(_Chunk(rows, width, gram, n_parts).keys))

    screen = ex.screened(by_chunk.applyInArrow(tc.tidied(ask), ex.ASKED))

    def send(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(rows, width, gram, n_parts)
        c.survivors(ex.replies(answers, 0))
        return ex.asked(key[0].as_py(), c.blobs())

    ordered = ex.answer(by_chunk.cogroup(screen.groupBy("chunk")).applyInArrow(tc.tidied(send), ex.ASKED), lambda blobs: _ordered(blobs, width), kind=1)
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def apply(rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(rows, width, gram, n_parts)
        c.survivors(ex.replies(answers, 0))
        gone = c.repeated(ex.replies(answers, 1))
        n, o = len(rows), c.offsets
        sums = np.append(0, np.cumsum(gone))
        edges = np.zeros(len(gone) + 1, bool)
        edges[1:-1] = gone[1:] != gone[:-1]
        edges[o] = True
        cuts = np.flatnonzero(edges)
        spans: list[list] = [[] for _ in range(n)]
        firsts, lasts = cuts[:-1], cuts[1:]
        marked = gone[firsts] if len(gone) else np.zeros(0, bool)
        for r, a, b in zip(tc.rows_of(firsts[marked], o).tolist(), firsts[marked].tolist(), lasts[marked].tolist(), strict=True):
            spans[r].append({"first": a - int(o[r]), "last": b - int(o[r])})
        out = c.data[~gone].tobytes()
        left = (np.arange(len(gone) + 1) - sums)[o].tolist()
        kept = [out[a:b] for a, b in zip(left[:-1], left[1:], strict=True)]
        return pa.Table.from_arrays([rows.column("doc").combine_chunks(), pa.array(np.diff(o), pa.int64()), pa.array(np.diff(sums[o]), pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc", "n_bytes", "n_removed", "spans", "kept"])

    schema = ex.result_schema(chunks, "n_bytes long, n_removed long, spans array<struct<first:bigint,last:bigint>>, kept binary")
    return by_chunk.cogroup(screen.unionAll(ordered).groupBy("chunk")).applyInArrow(tc.tidied(apply), schema)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Windows by position, in hexadecimal; spans by gaps and islands.
OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM docs WHERE len(h) >= 400)),
again AS (SELECT r, i FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT r, i, (lag(i) OVER w IS NULL OR i > lag(i) OVER w + 200)::INT AS new FROM again WINDOW w AS (PARTITION BY r ORDER BY i)),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM marked) GROUP BY r, g),
pieces AS (
  SELECT s.r, s.a AS place, s.b - s.a AS gone, substr(h, 2 * coalesce(lag(s.b) OVER (PARTITION BY s.r ORDER BY s.a), 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER (PARTITION BY s.r ORDER BY s.a), 0))) AS piece FROM spans s JOIN docs USING (r)
  UNION ALL SELECT d.r, len(h) // 2, 0, substr(h, 2 * coalesce(last, 0) + 1) FROM docs d LEFT JOIN (SELECT r, max(b) AS last FROM spans GROUP BY r) l ON l.r = d.r),
kept AS (SELECT r, sum(gone)::BIGINT AS n_removed, count(*) - 1 AS n_spans, sha256(unhex(string_agg(piece, '' ORDER BY place, gone DESC))) AS kept_sha256 FROM pieces GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, n_removed, n_spans, kept_sha256 FROM docs JOIN kept USING (r)
"""


def brute_force(texts: list[str | None], width: int = WIDTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, sha256 of what is kept) of each text, by a dictionary of all windows; for tests."""
    from collections import Counter

    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
