"""Chunks of documents that ask about keys, and parts of the key space that answer.

Finding repeats needs every window of a corpus to meet its equals, but a row per window is far
more than the corpus itself. Here documents are dealt to chunks of some MB by a hash of the whole row.
A task sees a whole chunk, forms its keys and removes repeats, which also settles the repeats
within the chunk, so that no key, however frequent, is sent more than once by a chunk. The keys
go, packed as binary, to the parts that own them; a part sees all chunks' keys of its range and
answers with a few bits for each, in the order in which they were sent. The answers meet the
chunk's texts again. Spark deals out, shuffles, sorts and recovers all of it: chunks and parts
are ordinary groups, and the exchange of the texts by chunk, compressed one by one, is used several times.

A first, small question screens the keys: a fingerprint of 32 bits beside the part's number
tells which keys no other chunk has. Only what passes is sent whole and compared byte by byte, so a
fingerprint that two keys share costs a little and changes nothing.

Neither ids nor their order matter for the dealing: null, equal or outlying ids do not fill a
chunk, and rows that repeat as a whole are dealt apart by the partition that they come from and by their number
among its equal rows. Neither depends on the order of a partition's rows, so a task that is run
again deals the same way (a map or variant is not part of what makes rows equal). Chunks and parts grow with the input once there are MOST of them, up to 16 times their first size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import textcols as tc

CHUNK_BYTES = 4 << 20
PART_BYTES = 8 << 20
MOST = 1 << 14
LAST_ID = (1 << 63) - 1
ASKED = "part int, chunk long, data binary"
ANSWERED = "chunk long, part int, kind int, bits binary"
_ASKED = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])
_ANSWERED = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("bits", pa.binary())])
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def grown(size: int, total: int) -> int:
    """Bytes of a chunk or part for an input of `total` bytes."""
    return int(min(max(size, total / MOST), 16 * size))


def chunked(docs: DataFrame, *, text: str, doc_id: str, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """(chunk, ident, body, doc) and the number of parts. ident: the id as a long, LAST_ID for null.
    body: the text's UTF-8 bytes, compressed, null as it is. doc: all other columns."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0
    n_chunks = max(1, ceil(total / grown(chunk_bytes, total)))
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID))
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not _has_map(f.dataType)])
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    rows = docs.select(whole.alias("chunk"), ident.alias("ident"), F.col(f"`{text}`").cast("binary").alias("body"), doc.alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        seen: dict[int, int] = {}
        here = TaskContext.get().partitionId()
        for batch in batches:
            packed = [None if x is None else z.compress(x) for x in batch.column(2).to_pylist()]
            dealt = _dealt(batch.column(0).to_numpy(), seen, here, n_chunks)
            yield pa.RecordBatch.from_arrays([pa.array(dealt), batch.column(1), pa.array(packed, pa.binary()), batch.column(3)], ["chunk", "ident", "body", "doc"])

    return rows.mapInArrow(tc.tidied_batches(run), rows.schema), max(1, ceil(total / grown(part_bytes, total)))


def _has_map(kind: T.DataType) -> bool:
    """Types of which Spark takes no hashes."""
    return any(x in kind.simpleString() for x in ("map<", "variant"))


def _dealt(hashes: np.ndarray, seen: dict[int, int], partition: int, n_chunks: int) -> np.ndarray:
    """Chunk numbers of rows, from their hashes, the partition and how many equal rows of it came before (`seen`, updated)."""
    nth = np.empty(len(hashes), np.uint64)
    for i, h in enumerate(hashes.tolist()):
        nth[i] = seen[h] = seen.get(h, -1) + 1
    mixed = tc.mix(tc.mix(hashes.view(np.uint64) + np.uint64(partition)) + nth)
    return (mixed % np.uint64(n_chunks)).astype(np.int64)


def texts(rows: pa.Table, gap: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, validity) of a chunk's bodies, each followed by `gap`; null rows are empty."""
    z = zstandard.ZstdDecompressor()
    raw = [b"" if x is None else z.decompress(x) for x in rows.column("body").to_pylist()]
    offsets = np.cumsum([0, *(len(x) + len(gap) for x in raw)])
    data = np.frombuffer(gap.join([*raw, b""]) if raw else b"", np.uint8)
    return data, offsets, ~np.asarray(rows.column("body").is_null(), bool)


def result_schema(chunks: DataFrame, more: str) -> T.StructType:
    """doc as it is in chunks, and further columns."""
    return T.StructType([chunks.schema["doc"], *T.StructType.fromDDL(more).fields])


def parts_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Part numbers below n from the upper bits of hashes."""
    return (((hashes >> _HALF) * np.uint64(n)) >> _HALF).astype(np.int32)


def pieces(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of each run of ascending part numbers."""
    if not len(parts):
        return
    found, firsts = np.unique(parts, return_index=True)
    yield from zip(found.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(parts)], strict=True)


def asked(chunk: int, blobs: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([p for p, _ in blobs], pa.int32()), pa.array([chunk] * len(blobs), pa.int64()), pa.array([b for _, b in blobs], pa.binary())], schema=_ASKED)


def answered(table: pa.Table, bits: list[bytes], kind: int) -> pa.Table:
    """A part's answers, one to each row of what it was asked."""
    return pa.Table.from_arrays([table.column("chunk").combine_chunks(), table.column("part").combine_chunks(), pa.array([kind] * len(bits), pa.int32()), pa.array(bits, pa.binary())], schema=_ANSWERED)


def answer(questions: DataFrame, decide: Callable[[list[bytes]], list[bytes]], *, kind: int) -> DataFrame:
    """For each part: decide(all chunks' data) gives each chunk's answer."""

    def run(table: pa.Table) -> pa.Table:
        return answered(table, decide(table.column("data").to_pylist()), kind)

    return questions.groupBy("part").applyInArrow(tc.tidied(run), ANSWERED)


def replies(table: pa.Table, kind: int) -> dict[int, bytes]:
    rows = table.filter(pa.compute.equal(table.column("kind"), kind))
    return dict(zip(rows.column("part").to_pylist(), rows.column("bits").to_pylist(), strict=True))


# The screen


def screen_keys(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    """(part, fingerprint) of hashes, as one number."""
    return (parts_of(hashes, n_parts).astype(np.uint64) << _HALF) | (hashes & _LOW)


def screen_blobs(keys: np.ndarray) -> list[tuple[int, bytes]]:
    """Distinct ascending screen keys, packed by part: differences of three bytes where they fit."""
    out = []
    low = (keys & _LOW).astype("<u4")
    for p, a, b in pieces((keys >> _HALF).astype(np.int32)):
        steps = np.diff(low[a:b], prepend=np.uint32(0))
        short = int(steps.max()) < 1 << 24
        out.append((p, (b"\3" if short else b"\4") + (steps.view(np.uint8).reshape(-1, 4)[:, :3] if short else steps).tobytes()))
    return out


def _unpacked(blob: bytes) -> np.ndarray:
    if blob[0] == 4:
        return np.cumsum(np.frombuffer(blob, "<u4", -1, 1), dtype=np.uint32)
    steps = np.zeros((len(blob) // 3, 4), np.uint8)
    steps[:, :3] = np.frombuffer(blob, np.uint8, -1, 1).reshape(-1, 3)
    return np.cumsum(steps.view("<u4").reshape(-1), dtype=np.uint32)


def in_two(blobs: list[bytes]) -> list[bytes]:
    """For each chunk's fingerprints: does another chunk have it?"""
    keys = [_unpacked(b) for b in blobs]
    every = np.sort(np.concatenate(keys))
    again = every[1:][every[1:] == every[:-1]]
    out = []
    for k in keys:
        at = np.searchsorted(again, k)
        at[at == len(again)] = 0
        out.append(np.packbits(again[at] == k if len(again) else np.zeros(len(k), bool)).tobytes())
    return out


def screened(questions: DataFrame) -> DataFrame:
    """Answers of kind 0: which fingerprints another chunk has too."""
    return answer(questions, in_two, kind=0)


def passed(keys: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
    """Those of a chunk's distinct ascending screen keys that another chunk has."""
    out = np.zeros(len(keys), bool)
    for p, a, b in pieces((keys >> _HALF).astype(np.int32)):
        if len(bits[p]) != (b - a + 7) // 8:
            raise ValueError("a chunk has other keys than those that it asked about")
        out[a:b] = np.unpackbits(np.frombuffer(bits[p], np.uint8), count=b - a)
    return out
