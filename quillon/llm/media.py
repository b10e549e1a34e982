"""Media columns: ISO base media containers as binary columns, described without decoding.

`store` puts the bytes of a text column into an ISO container: ftyp, mdat with the payload
as unsigned 8-bit samples, moov with one track and its sample tables. `describe` walks the
nested boxes of any such container, decodes the sample tables (stts, stsc, stsz, stz2, stco,
co64, stss) and the runs of fragments (trex, tfhd, trun), and returns codec, duration and the byte ranges of all samples that are
keyframes. Payload bytes are only located; `payloads` cuts them out by the tables.

Defined results: a null or empty text is stored as 64 zero bytes; a null or broken container
has null columns; tracks without stss have only keyframes; repeated rows repeat; an input column with the
name of an added one is replaced; an empty table gives an empty result. Each row is handled by itself, in record batches of bounded bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textcols as tc
from quillon.llm.tables import table

UNIT = 64
PER_CHUNK = 64
KEY_EVERY = 16
TIMESCALE = 8000
#: Bytes of a record batch that goes back to Spark.
BATCH_BYTES = 4 << 20
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"moof", b"traf", b"mvex"}
DEEPEST = 16


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(text: bytes) -> bytes:
    """text and zeros up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


_MATRIX = struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)


def container(payload: bytes) -> bytes:
    """An ISO file with one raw 8-bit audio track; each sample is UNIT bytes, each KEY_EVERY-th a keyframe."""
    n = len(payload) // UNIT
    length = n * UNIT
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    data = _box(b"mdat", payload)
    first = len(head) + len(data) - len(payload)
    offsets = first + np.arange(0, n, PER_CHUNK, dtype=np.int64) * UNIT
    whole, rest = divmod(n, PER_CHUNK)
    runs = ([(1, PER_CHUNK, 1)] if whole else []) + ([(whole + 1, rest, 1)] if rest else [])
    keys = np.arange(1, n + 1, KEY_EVERY)
    entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16))
    wide = first + length >= 1 << 32
    tables = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, UNIT)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", UNIT, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, length & 0xFFFFFFFF, 0x55C4, 0)),
        _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
        _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables),
    )
    track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, length & 0xFFFFFFFF, 0, 0, 256, 0), _MATRIX, bytes(8), flags=3), media)
    movie = _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIHH8x", 0, 0, TIMESCALE, length & 0xFFFFFFFF, 65536, 256, 0), _MATRIX, bytes(24), struct.pack(">I", 2)), track)
    return head + data + movie


def boxes(raw: memoryview, start: int, end: int, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, first byte, end) of each box's body, nested ones after their parents; a box that leaves its parent, or lies deeper than DEEPEST, ends the walk with an error."""
    at = start
    if path.count("/") > DEEPEST:
        raise ValueError("boxes are nested too deep")
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = at + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("a box is cut off")
            (size,) = struct.unpack_from(">Q", raw, body)
            body += 8
        elif size == 0:
            size = end - at
        if at + size > end or at + size < body:
            raise ValueError(f"box {kind!r} at {at} leaves its parent")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, body, at + size
        if kind in CONTAINERS:
            yield from boxes(raw, body, at + size, name)
        at += size
    if at != end and not path:
        raise ValueError("a box is cut off")


def _numbers(raw: memoryview, at: int, end: int, kind: str, count: int) -> np.ndarray:
    """`count` numbers of a table that ends at `end`."""
    if count * np.dtype(kind).itemsize > end - at:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(raw, kind, count, at).astype(np.int64)


def _fields(form: str, raw: memoryview, at: int, end: int) -> tuple:
    if at + struct.calcsize(form) > end:
        raise ValueError("a box is too short")
    return struct.unpack_from(form, raw, at)


def tracks(raw: bytes) -> list[dict]:
    """Each track's codec, timescale, duration and its samples' offsets, sizes and keyframe flags.

    Samples of fragments (moof) follow those of the sample tables. Broken containers raise ValueError, and so do those whose
    tables and runs of one size, which name samples without a byte for each, claim more samples or bytes together than the file has bytes.
    """
    view, found, defaults = memoryview(raw), [], {}
    fragment: dict = {}
    left = [len(raw)]
    for name, a, b in boxes(view, 0, len(raw)):
        kind = name.rsplit("/", 1)[-1]
        if kind == "trak":
            found.append({"sizes": np.zeros(0, np.int64), "chunks": np.zeros(0, np.int64), "stsc": np.zeros((0, 3), np.int64), "runs": []})
        elif kind == "trex":
            track, _, duration, size, flags = _fields(">5I", view, a + 4, b)
            defaults[track] = (duration, size, flags)
        elif kind == "moof":
            # the box's own header lies before its body
            fragment = {"moof": _header(view, a)}
        elif kind == "tfhd" and fragment:
            fragment |= _track_header(view, a, b, found, defaults)
        elif kind == "trun" and "track" in fragment:
            _run(view, a, b, fragment, left)
        if not found or "/trak/" not in name:
            continue
        t = found[-1]
        if kind == "tkhd":
            (version,) = _fields(">B", view, a, b)
            (t["id"],) = _fields(">I", view, a + (12 if version == 0 else 20), b)
        elif kind == "mdhd":
            (version,) = _fields(">B", view, a, b)
            t["timescale"], t["duration"] = _fields(">II", view, a + 12, b) if version == 0 else _fields(">IQ", view, a + 20, b)
        elif kind == "stsd":
            t["codec"] = bytes(view[a + 12 : min(a + 16, b)]).decode("latin-1").strip() or None
        elif kind in ("stts", "stsc", "stco", "co64", "stss"):
            (count,) = _fields(">I", view, a + 4, b)
            per = {"stts": 2, "stsc": 3}.get(kind, 1)
            x = _numbers(view, a + 8, b, ">u8" if kind == "co64" else ">u4", per * count)
            t[{"stco": "chunks", "co64": "chunks", "stss": "keys"}.get(kind, kind)] = x.reshape(-1, per) if per > 1 else x - 1 if kind == "stss" else x
        elif kind == "stsz":
            size, n = _fields(">II", view, a + 4, b)
            if size:
                _claim(left, n, size)
            t["sizes"] = np.full(n, size, np.int64) if size else _numbers(view, a + 12, b, ">u4", n)
        elif kind == "stz2":
            bits, n = _fields(">3xBI", view, a + 4, b)
            if bits == 4:
                halves = _numbers(view, a + 12, b, "u1", (n + 1) // 2)
                t["sizes"] = np.stack([halves >> 4, halves & 15], 1).reshape(-1)[:n]
            elif bits in (8, 16):
                t["sizes"] = _numbers(view, a + 12, b, f">u{bits // 8}", n)
            else:
                raise ValueError("sizes of a width that there is not")
    return [_located(t, len(raw)) for t in found]


def _claim(left: list[int], n: int, size: int) -> None:
    """Takes n samples of one size, a byte each at least, from the bytes that are left to claim."""
    left[0] -= n * max(size, 1)
    if left[0] < 0:
        raise ValueError("samples are longer than the file")


def _header(view: memoryview, body: int) -> int:
    """Where the box begins whose body begins there: sizes of 64 bits have eight bytes more."""
    long = body >= 16 and bytes(view[body - 12 : body - 8]) == b"moof" and struct.unpack_from(">I", view, body - 16)[0] == 1
    return body - (16 if long else 8)


def _track_header(view: memoryview, a: int, b: int, found: list[dict], defaults: dict) -> dict:
    """Of a fragment's track: which it is, where its data begin, and its samples' default duration, size and flags."""
    flags, track = _fields(">II", view, a, b)
    flags &= 0xFFFFFF
    at, values = a + 8, list(defaults.get(track, (0, 0, 0)))
    out = {"track": next((t for t in found if t.get("id") == track), None), "base": None}
    if flags & 1:
        (out["base"],) = _fields(">Q", view, at, b)
        at += 8
    at += 4 if flags & 2 else 0
    for k, bit in enumerate((8, 16, 32)):
        if flags & bit:
            (values[k],) = _fields(">I", view, at, b)
            at += 4
    out["values"], out["next"] = values, None
    if out["track"] is None:
        raise ValueError("a fragment of a track that there is not")
    return out


def _run(view: memoryview, a: int, b: int, fragment: dict, left: list[int]) -> None:
    """Adds a run of samples to its track: durations, sizes, keyframe flags and offsets."""
    flags, n = _fields(">II", view, a, b)
    flags &= 0xFFFFFF
    base = fragment["moof"] if fragment["base"] is None else fragment["base"]
    at, start, first = a + 8, fragment["next"], None
    if flags & 1:
        (shift,) = _fields(">i", view, at, b)
        start, at = base + shift, at + 4
    if flags & 4:
        (first,) = _fields(">I", view, at, b)
        at += 4
    fields = [k for k, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if flags & bit]
    if not fields:
        _claim(left, n, fragment["values"][1])
    x = _numbers(view, at, b, ">u4", n * len(fields)).reshape(n, len(fields)) if fields else np.zeros((n, 0), np.int64)
    column = lambda k: x[:, fields.index(k)] if k in fields else np.full(n, fragment["values"][k], np.int64)
    durations, sizes, own = column(0), column(1), column(2).copy()
    if first is not None and n:
        own[0] = first
    start = base if start is None else start
    offsets = start + np.cumsum(sizes) - sizes
    fragment["next"] = int(start + sizes.sum())
    # a sample that others depend on and that depends on none is no difference sample
    fragment["track"]["runs"].append((offsets, sizes, own & 0x10000 == 0, int(durations.sum())))


def _located(t: dict, end: int) -> dict:
    """Offsets of all samples: chunks give runs of samples, and sizes add up within a chunk."""
    sizes, chunks, runs = t["sizes"], t["chunks"], t["stsc"]
    per = np.zeros(len(chunks), np.int64)
    if len(runs) and len(chunks):
        lasts = np.append(runs[1:, 0] - 1, len(chunks))
        times = lasts - runs[:, 0] + 1
        if runs[0, 0] != 1 or (times < 0).any() or times.sum() != len(chunks):
            raise ValueError("stsc is out of order")
        per = np.repeat(runs[:, 1], times)
    if per.sum() != len(sizes):
        raise ValueError("stsc and stsz disagree")
    firsts = np.cumsum(per) - per
    sums = np.append(0, np.cumsum(sizes))
    offsets = np.repeat(chunks - sums[firsts], per) + sums[:-1]
    key = np.ones(len(sizes), bool) if "keys" not in t else np.isin(np.arange(len(sizes)), t["keys"])
    spent = int((t["stts"][:, 0] * t["stts"][:, 1]).sum()) if "stts" in t else t.get("duration", 0)
    if t["runs"]:
        more, lengths, keys, times = zip(*t["runs"], strict=True)
        offsets, sizes, key, spent = np.concatenate([offsets, *more]), np.concatenate([sizes, *lengths]), np.concatenate([key, *keys]), spent + sum(times)
    if len(sizes) and ((offsets < 0).any() or (offsets + sizes).max() > end):
        raise ValueError("a sample lies outside the file")
    return {"codec": t.get("codec"), "timescale": int(t.get("timescale", 0)), "duration": spent, "offsets": offsets, "sizes": sizes, "key": key}


def payload(raw: bytes, track: dict) -> bytes:
    """A track's samples, joined; neighbours in the file are cut out together."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    firsts, lasts = np.append(0, breaks), np.append(breaks, len(offsets)) - 1
    return b"".join(raw[a:b] for a, b in zip(offsets[firsts].tolist(), (offsets[lasts] + sizes[lasts]).tolist(), strict=True))


RANGES = "array<struct<first:bigint,length:bigint>>"
TRACK = f"struct<codec:string,timescale:bigint,duration:double,n_samples:bigint,n_bytes:bigint,keyframes:{RANGES}>"


def _described(t: dict) -> dict:
    ranges = [{"first": a, "length": n} for a, n in zip(t["offsets"][t["key"]].tolist(), t["sizes"][t["key"]].tolist(), strict=True)]
    return {"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"] / t["timescale"] if t["timescale"] else None, "n_samples": len(t["sizes"]), "n_bytes": int(t["sizes"].sum()), "keyframes": ranges}


def _per_row(df: DataFrame, column: str, added: list[tuple[str, str, pa.DataType]], make: Callable) -> DataFrame:
    """df with columns that make() gives for each value of `column`, row by row, in batches of bounded bytes; they replace columns of their names."""
    at = df.columns.index(column)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    schema = "row " + df.schema.simpleString() + "".join(f", `_{n}` {t}" for n, t, _ in added)
    names, kinds = [n for n, _, _ in added], [k for _, _, k in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = batch.column(0), batch.column(0).field(at)
            start, out, size = 0, [], 0
            for i in range(len(values)):
                out.append(make(values[i].as_py()))
                size += 64 + sum(len(x) for x in out[-1] if isinstance(x, bytes | str))
                if size > BATCH_BYTES or i + 1 == len(values):
                    arrays = [pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([rows.slice(start, i + 1 - start), *arrays], ["row", *(f"_{n}" for n in names)])
                    start, out, size = i + 1, [], 0

    return whole.mapInArrow(tc.tidied_batches(run), schema).select(*(F.col(f"row.`{c}`") for c in df.columns if c not in names), *(F.col(f"`_{n}`").alias(n) for n in names))


def store(df: DataFrame, *, text: str = "text", media: str = "media") -> DataFrame:
    """df with its text column's UTF-8 bytes in ISO containers."""
    return _per_row(df, text, [(media, "binary", pa.binary())], lambda t: (container(padded((t or "").encode())),))


def describe(df: DataFrame, *, media: str = "media", out: str = "tracks") -> DataFrame:
    """df with an array of its containers' tracks; null for what is no container."""

    def make(raw: bytes | None) -> tuple:
        try:
            return (None if raw is None else [_described(t) for t in tracks(raw)],)
        except ValueError:
            return (None,)

    kind = pa.list_(pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("n_bytes", pa.int64()), ("keyframes", pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())])))]))
    return _per_row(df, media, [(out, f"array<{TRACK}>", kind)], make)


def _digests(raw: bytes | None) -> tuple:
    (t,) = tracks(raw)
    data = payload(raw, t)
    n = int(t["key"].sum())
    ranges = np.stack([t["offsets"], t["sizes"]], 1)[t["key"]].astype("<i8")
    feature = f"{t['codec']};{t['duration'] / t['timescale']:.4f}s;{len(t['sizes'])} samples;{n} keyframes;{zlib.crc32(ranges.tobytes()):08x}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    stored = store(docs).select("doc_id", "n_bytes", "media")
    added = [("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]
    return _per_row(stored, "media", added, _digests).drop("media")
