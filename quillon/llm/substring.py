r"""Substring dedup with prefix-partitioned suffix trees.

Suffixes are word sequences, cut off at `width` words, the length from which a repeat counts;
words are `[^\x20\x09-\x0D]+`. Three steps, all over chunks of documents and parts (see exchange):

1. The screen: fingerprints of windows tell which suffixes may lie in two documents at all.
2. The partition: a suffix belongs to the group of its prefix, and prefixes are of variable length, the
   fewest words that leave a group small enough for memory. Sizes are measured on documents picked by hash
   (they steer only where suffixes meet, never which); a prefix over the bound is
   lengthened word by word (the MOST_HOT most frequent ones, if there are more). Small groups share a part.
3. The subtrees: a part has its suffixes' words whole. Its trees grow from the roots by digit
   passes (radix.tied): a pass splits each node by its next bytes, and leaves that are alone drop out. What is
   still together after `width` words is a deep internal node. A node with leaves of two documents is a repeat;
   a leaf learns whether its node has one of a smaller id. Nodes next to each other in a document join to maximal repeats.

A suffix that repeats within a chunk is sent once, with the smallest id that has it, so no passage,
however common, makes a large group. A word goes if a window over it also starts in a document of
smaller id; equality is that of the words themselves.

Defined results: null and empty texts have no words; a null id (and 2**63 - 1) comes after all other ids, and
rows that share an id are one document's (no copy of its own is removed); fewer words than
`width` are never removed; whatever the input's columns are called, all but the text come back under
`doc`; an empty table gives an empty result.
"""

from __future__ import annotations

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

WIDTH = 13
PIPELINE_WIDTH = 50
#: Bytes of text on which sizes of prefix groups are measured, about; fewer only if there are no more.
MEASURED = 64 << 20
#: Suffixes that a group too large for a part shows at least among the measured ones.
LEAST_SEEN = 64
#: Prefixes that are lengthened at most: 2 MB of hashes in a task. The groups of others stay as they are, whole.
MOST_HOT = 1 << 18
#: Bytes of a suffix's word, about.
WORD_BYTES = 7


def _lengthened(words: np.ndarray, at: np.ndarray, width: int, hot: np.ndarray) -> np.ndarray:
    """Hash of the shortest prefix of each suffix that is not in `hot` (ascending), of `width` words at most."""
    h = tc.mix(words[at] + np.uint64(1))
    rest = np.arange(len(at))
    for k in range(1, width):
        if not len(hot) or not len(rest):
            break
        found = np.minimum(np.searchsorted(hot, h[rest]), len(hot) - 1)
        rest = rest[hot[found] == h[rest]]
        h[rest] = tc.mix(h[rest] * np.uint64(tc._MULT) + words[at[rest] + k])
    return h


def _prefixes(words: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The hashes of all suffixes' prefixes of 1, 2, ... words."""
    h = tc.mix(words[at] + np.uint64(1))
    yield h
    for k in range(1, width - 1):
        h = tc.mix(h * np.uint64(tc._MULT) + words[at + k])
        yield h


def hot_prefixes(docs: DataFrame, *, text: str, doc_id: str, width: int, group_bytes: int, measured: int = MEASURED, most: int = MOST_HOT) -> np.ndarray:
    """Prefixes whose groups would exceed group_bytes (grown with the input as parts are), ascending; of more than `most` the most frequent ones.

    One document of `share` is measured: about `measured` bytes in all, more where a group of that size would
    show fewer than LEAST_SEEN suffixes among them, so that what counts as large does not depend on the input's size."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0
    in_group = ex.grown(group_bytes, total) / (WORD_BYTES * width)
    share = max(1, min(total // measured, int(in_group / LEAST_SEEN)))
    picked = docs.where(F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.lit(11)), F.lit(share)) == 0).select(F.col(f"`{text}`").alias("t"))
    least = in_group / share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = tc.text_buffer(batch.column(0))
            for i, j in tc.slices(offsets, 4 * tc.SLICE_BYTES):
                w, _, _, r = tc.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tc.SPACES)
                at = np.flatnonzero(tc.same_row(r, width))
                for level in _prefixes(w, at, width):
                    h, n = np.unique(level, return_counts=True)
                    # a prefix that is rare in every slice is no hot one; longer ones are no more frequent
                    often = n > min(least / 64, len(at) / 2048)
                    if not often.any():
                        break
                    yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["h", "n"])

    counts = picked.mapInArrow(tc.tidied_batches(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > least).orderBy(F.desc("n"), "h").limit(most).select("h").collect()
    return np.sort(np.array([r.h for r in found], np.int64).view(np.uint64))


class _Chunk:
    """A chunk's words, windows and screen keys."""

    def __init__(self, rows: pa.Table, width: int, n_parts: int):
        self.data, self.offsets, self.valid = ex.texts(rows, b" ")
        self.ids, self.width = rows.column("ident").to_numpy(), width
        words, starts, ends, owner, keys, at = [], [], [], [], [], []
        place = np.int32 if len(self.data) < 1 << 31 else np.int64
        n = 0
        for i, j in tc.slices(self.offsets):
            base = self.offsets[i]
            w, s, e, r = tc.word_hashes(self.data[base : self.offsets[j]], self.offsets[i : j + 1] - base, tc.SPACES)
            ok = np.flatnonzero(tc.same_row(r, width))
            keys.append(tc.window_hashes(w, width)[ok])
            words.append(w)
            for found, x in ((at, ok + n), (starts, s + base), (ends, e + base), (owner, r + i)):
                found.append(x.astype(place))
            n += len(w)

        def join(x: list, kind) -> np.ndarray:
            whole = np.concatenate(x) if x else np.zeros(0, kind)
            x.clear()
            return whole

        self.words, self.hash = join(words, np.uint64), join(keys, np.uint64)
        self.starts, self.ends, self.owner, self.at = (join(x, place) for x in (starts, ends, owner, at))
        self.keys, self.key = np.unique(ex.screen_keys(self.hash, n_parts), return_inverse=True)

    def survivors(self, bits: dict[int, bytes], hot: np.ndarray, n_trees: int) -> None:
        """Windows that may lie in two documents, their classes, and the classes' smallest ids and parts."""
        document = self.ids[self.owner[self.at]]
        low, high = np.full(len(self.keys), ex.LAST_ID), np.full(len(self.keys), -ex.LAST_ID - 1)
        np.minimum.at(low, self.key, document)
        np.maximum.at(high, self.key, document)
        self.window = np.flatnonzero((ex.passed(self.keys, bits) | (low < high))[self.key])
        # words with one space after each, whatever lay between them
        data = self.data.copy()
        data[self.ends] = 0x20
        change = np.zeros(len(data) + 1, np.int8)
        change[self.starts] += 1
        np.add.at(change, self.ends + 1, -1)
        self.text = data[np.cumsum(change[:-1], dtype=np.int8) > 0]
        firsts = np.append(0, np.cumsum(self.ends - self.starts + 1))
        at = self.at[self.window]
        begin, size = firsts[at], firsts[at + self.width] - firsts[at]
        self.of, one, kinds = radix.classes(self.text, begin, size, self.hash[self.window])
        self.begin, self.size = begin[one], size[one]
        self.document = document[self.window]
        self.low = np.full(len(one), ex.LAST_ID)
        np.minimum.at(self.low, self.of, self.document)
        parts = ex.parts_of(_lengthened(self.words, at[one], self.width, hot), n_trees)
        self.order = np.lexsort((kinds, parts))
        self.parts = parts[self.order]

    def blobs(self) -> list[tuple[int, bytes]]:
        z, out = zstandard.ZstdCompressor(level=3), []
        for p, a, b in ex.pieces(self.parts):
            own = self.order[a:b]
            whole = radix.gathered(self.text, self.begin[own], self.size[own])
            out.append((p, z.compress(b"".join([struct.pack("<q", b - a), self.low[own].astype("<i8").tobytes(), self.size[own].astype("<u4").tobytes(), whole.tobytes()]))))
        return out

    def removed(self, bits: dict[int, bytes]) -> np.ndarray:
        """Words to remove: another chunk has the window under a smaller id, or a document of this one has."""
        earlier = np.zeros(len(self.order), bool)
        for p, a, b in ex.pieces(self.parts):
            earlier[self.order[a:b]] = np.unpackbits(np.frombuffer(bits[p], np.uint8), count=b - a)
        gone = earlier[self.of] | (self.document > self.low[self.of])
        flags = np.zeros(len(self.starts), bool)
        flags[self.at[self.window[gone]]] = True
        return tc.cover(flags, self.width, len(self.starts))


def _subtrees(blobs: list[bytes]) -> list[bytes]:
    """For each chunk's suffixes: does the suffix's deep node hold a smaller id?"""
    z = zstandard.ZstdDecompressor()
    raw = [z.decompress(blobs.pop(0)) for _ in range(len(blobs))]
    counts = [struct.unpack_from("<q", r)[0] for r in raw]
    ids = np.concatenate([np.frombuffer(r, "<i8", n, 8) for r, n in zip(raw, counts, strict=True)])
    sizes = np.concatenate([np.frombuffer(r, "<u4", n, 8 + 8 * n) for r, n in zip(raw, counts, strict=True)]).astype(np.int64)
    data = np.concatenate([np.frombuffer(r, np.uint8, -1, 8 + 12 * n) for r, n in zip(raw, counts, strict=True)])
    del raw
    node = radix.tied(data, np.cumsum(sizes) - sizes, sizes)
    deep = np.flatnonzero(node >= 0)
    earlier = np.zeros(len(ids), bool)
    if len(deep):
        low = np.full(int(node.max()) + 1, ex.LAST_ID)
        np.minimum.at(low, node[deep], ids[deep])
        earlier[deep] = low[node[deep]] < ids[deep]
    ends = np.cumsum(counts).tolist()
    return [np.packbits(earlier[b - n : b]).tobytes() for b, n in zip(ends, counts, strict=True)]


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, whole: bool = False) -> DataFrame:
    """doc (all columns but the text), n_words, n_removed, spans (bytes of removed runs) and kept: the other words, joined by one space.
    whole: texts from which nothing is removed are in `kept` as they are."""
    chunks, n_parts = ex.chunked(docs, text=text, doc_id=doc_id)
    hot = docs.sparkSession.sparkContext.broadcast(hot_prefixes(docs, text=text, doc_id=doc_id, width=width, group_bytes=ex.PART_BYTES))
    # suffixes are as long as windows are wide: the trees have as many more parts
    n_trees = n_parts * max(1, -(-width // WIDTH))
    by_chunk = chunks.groupBy("chunk")

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        return ex.asked(key[0].as_py(), ex.screen_blobs(_Chunk(rows, width, n_parts).keys))

    screen = ex.screened(by_chunk.applyInArrow(tc.tidied(ask), ex.ASKED))

    def send(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(rows, width, n_parts)
        c.survivors(ex.replies(answers, 0), hot.value, n_trees)
        return ex.asked(key[0].as_py(), c.blobs())

    trees = ex.answer(by_chunk.cogroup(screen.groupBy("chunk")).applyInArrow(tc.tidied(send), ex.ASKED), _subtrees, kind=1)
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def apply(rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(rows, width, n_parts)
        c.survivors(ex.replies(answers, 0), hot.value, n_trees)
        gone = c.removed(ex.replies(answers, 1))
        n = len(rows)
        n_words, n_removed = np.bincount(c.owner, minlength=n), np.bincount(c.owner[gone], minlength=n)
        edge = np.ones(len(gone), bool)
        edge[1:] = (gone[1:] != gone[:-1]) | (c.owner[1:] != c.owner[:-1])
        firsts = np.flatnonzero(edge)
        lasts = (np.append(firsts[1:], len(gone)) - 1)[: len(firsts)]
        firsts, lasts = firsts[gone[firsts]], lasts[gone[firsts]]
        spans: list[list] = [[] for _ in range(n)]
        for r, a, b in zip(c.owner[firsts].tolist(), c.starts[firsts].tolist(), c.ends[lasts].tolist(), strict=True):
            spans[r].append({"first": a - int(c.offsets[r]), "last": b - int(c.offsets[r])})
        kept = _joined(c, ~gone, whole & (n_removed == 0))
        kept = [t if ok else None for t, ok in zip(kept, c.valid.tolist(), strict=True)]
        return pa.Table.from_arrays([rows.column("doc").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], ["doc", "n_words", "n_removed", "spans", "kept"])

    schema = ex.result_schema(chunks, "n_words long, n_removed long, spans array<struct<first:bigint,last:bigint>>, kept string")
    return by_chunk.cogroup(screen.unionAll(trees).groupBy("chunk")).applyInArrow(tc.tidied(apply), schema)


def _joined(c: _Chunk, kept: np.ndarray, as_is: np.ndarray) -> list[bytes]:
    """Each row's kept words with one space between, or its text as it is."""
    size = np.where(kept, c.ends - c.starts + 1, 0)
    starts = np.append(0, np.cumsum(c.ends - c.starts + 1))
    out = radix.gathered(c.text, starts[:-1][kept], size[kept]).tobytes()
    ends = np.cumsum(np.bincount(c.owner, weights=size, minlength=len(c.ids)).astype(np.int64)).tolist()
    raw = c.data.tobytes()
    o = c.offsets.tolist()
    return [raw[o[i] : o[i + 1] - 1] if as_is[i] else out[a : max(a, b - 1)] for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]


def without_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = PIPELINE_WIDTH) -> DataFrame:
    """docs with the repeats cut out of their texts; a document of which no word is left goes. Texts without repeats stay as they are."""
    d = remove_repeats(docs, text=text, doc_id=doc_id, width=width, whole=True).where("n_removed = 0 or n_removed < n_words")
    return d.select(*[F.col("kept").alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc.doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
runs AS (
  SELECT doc_id, i, hash(w[i:i + 12]) AS h, md5(array_to_string(w[i:i + 12], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first FROM runs GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM runs JOIN firsts USING (win) WHERE first < doc_id),
kept AS (
  SELECT d.doc_id, count(*) AS n_kept, string_agg(d.word, ' ' ORDER BY d.k) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM docs) d
  ANTI JOIN gone g ON d.doc_id = g.doc_id AND d.k = g.k GROUP BY d.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, len(d.w)::BIGINT - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""
