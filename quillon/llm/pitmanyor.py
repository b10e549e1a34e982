r"""Language-model scores from a hierarchical Pitman-Yor process over pairs of words.

Tokens are the lower-cased words `[^\x20\x09-\x0D]+` of a text, then one end. A token's context is the word
before it, or the start of the text. Each context is a restaurant whose customers are the tokens that
follow it; its tables draw their dishes from one parent, the restaurant of all words, whose base is
uniform over the known words and one unknown. Dishes are known, so the state of the seating is the number of tables of
each dish in each restaurant. Both discounts are 1/2: the number of ways to seat c customers of a dish at t tables then is

    S(c, t) = (2c - t - 1)! / ((t - 1)! (c - t)! 2**(2c - 2t))

and a Gibbs step draws t, given all other tables of the restaurant, from S(c, t) times the weights of t new tables
times P(dish)**t, for any number of customers (windows around the mode hold all but 1e-12 of it).

Counts come from all training documents. Chunks of documents screen their pairs of words first (see exchange): a pair that
occurs once in training sits at one table, and only its word's and context's sums are sent. All other pairs go, once a
chunk, to the part that owns the word, which keeps their tables. The pairs of hot words, those with more than 1/SPLIT of what a part has on average,
are dealt to all parts by context instead, as a word in every chunk would send one part some pairs of every chunk; such a word is a guest of those parts.
A sweep is two exchanges: parts send the tables of their pairs, added up by context and by guest, to the owners of the contexts and guests; owners
draw the parent's tables of their words and answer with each context's tables over all parts and each guest's place in the parent; then every part
draws all its pairs. So every draw knows the totals of the whole corpus as of the sweep before, whatever the number of parts and whichever words are hot.
The model's probability is averaged over the sweeps after `burn`:

    P(w)     = (C_w - s_w / 2 + (h + S / 2) / (V + 1)) / (h + T)
    P(w | k) = (c_kw - t_kw / 2 + (h + t_k / 2) P(w)) / (h + c_k)

which sums to one over all words and the unknown one. Scores are log10; perplexity is 10**(-score / n_tokens).

Defined results: a null or empty text has one token, its end; a null `train` is false; without
training documents all words are unknown; rows with equal ids are scored one by one; all columns but the text
come back under `doc`; an empty table gives an empty result. Words are known by hashes of 64 bits, cryptographic ones
if they are longer than 16 bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import exchange as ex
from quillon.llm import textcols as tc
from quillon.llm.tables import hashed_fold, table, written

DISCOUNT = 0.5
STRENGTH = 1.0
BURN, SWEEPS = 1, 3
#: Customers up to which all numbers of tables are weighed; beyond, those around the mode.
SMALL = 64
#: A word is hot if its distinct pairs, chunk by chunk, are more than 1/SPLIT of a part's average. Chunks name their candidates to one part in so many.
SPLIT, NAMED_BY = 4, 64
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Kinds of messages between parts.
STATE, NAMES, ROUTE, SUBS, UP, BOUND, BASE, DOWN, TABLES, DRAWN, OWN, ROOT = range(12)
#: Kind of the answers with hot words, beside those of the screen.
HOT = 2
_MESSAGE = "part int, kind int, other long, data binary, totals array<double>"
_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("other", pa.int64()), ("data", pa.binary()), ("totals", pa.list_(pa.float64()))])


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte numbers, by byte planes, compressed: small numbers take little."""
    head = struct.pack(f"<{len(arrays) + 1}q", len(arrays), *map(len, arrays))
    planes = [np.ascontiguousarray(np.ascontiguousarray(a, "<i8" if a.dtype != np.uint64 else "<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    at, out = 8 * (n + 1), []
    for size in struct.unpack_from(f"<{n}q", raw, 8):
        planes = np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size)
        # a copy always, which can be written to
        out.append(np.array(planes.T, order="C").reshape(-1).view("<i8"))
        at += 8 * size
    return out


def _counted(of: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(of, weights=weights, minlength=n).astype(np.int64)


class _Chunk:
    """A chunk's tokens, its distinct words in the order of their hashes, and its distinct pairs."""

    def __init__(self, rows: pa.Table, n_parts: int, train: np.ndarray):
        data, offsets, _ = ex.texts(rows, b" ")
        self.n_rows, self.n_parts = len(rows), n_parts
        found, owner = [], []
        for i, j in tc.slices(offsets):
            w, _, _, r = tc.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tc.SPACES, lower=True)
            tokens = np.full(len(w) + j - i, END)
            tokens[np.arange(len(w)) + r] = w
            found.append(tokens)
            owner.append(np.repeat(np.arange(i, j), np.bincount(r, minlength=j - i) + 1))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        tokens, self.owner = join(found, np.uint64), join(owner, np.int64)
        self.words, at = np.unique(np.append(tokens, [END, START]), return_inverse=True)
        self.end, self.start = int(at[-2]), int(at[-1])
        self.word = at[:-2]
        before = np.append(self.end, self.word)[:-1]
        before[before == self.end] = self.start
        n = len(self.words)
        pairs, self.pair = np.unique(self.word * n + before, return_inverse=True)
        self.w, self.k = pairs // n, pairs % n
        weight = train[self.owner].astype(float) if self.n_rows else np.zeros(0)
        self.c, self.c_w = _counted(self.pair, weight, len(pairs)), _counted(self.word, weight, n)
        self.name = tc.mix(tc.mix(self.words[self.k]) * np.uint64(tc._MULT) + self.words[self.w])
        self.keys, self.key = np.unique(ex.screen_keys(self.name, n_parts), return_inverse=True)

    def candidates(self) -> list[tuple[int, bytes]]:
        """For the parts beyond n_parts that count them: the words that may be hot with their pairs here, and the number of all pairs here."""
        n_k = _counted(self.w, None, len(self.words))
        found = np.flatnonzero(n_k * (2 * SPLIT * self.n_parts) > len(self.w))
        n_counting = -(-self.n_parts // NAMED_BY)
        cuts = np.searchsorted(ex.parts_of(self.words[found], n_counting), np.arange(n_counting + 1))
        return [(self.n_parts + i, packed(self.words[found[a:b]], n_k[found[a:b]], np.array([len(self.w)]))) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]

    def screened(self, bits: dict[int, bytes], hot: np.ndarray) -> None:
        """Pairs that are to be sent, by part, those of guests last: those that another chunk has too, or that occur twice here. parts: (part, its first word, end, its first pair, end)."""
        sent = ex.passed(self.keys, bits)[self.key] | (self.c > 1)
        self.once = ~sent & (self.c == 1)
        self.sent, self.place = np.flatnonzero(sent), np.searchsorted(hot, self.words)
        owners = ex.parts_of(self.words, self.n_parts)
        own = owners[self.w[self.sent]]
        to = np.where(np.isin(self.words, hot)[self.w[self.sent]], ex.parts_of(self.name[self.sent], self.n_parts), own)
        order = np.lexsort((to != own, to))
        self.sent, to = self.sent[order], to[order]
        every = np.union1d(owners, to)
        ends = [np.searchsorted(x, every, side).tolist() for x in (owners, to) for side in ("left", "right")]
        self.parts = list(zip(every.tolist(), *ends, strict=True))

    def blobs(self) -> list[tuple[int, bytes]]:
        """For each part: its words with their sums, the number of pairs of each and of each guest, the pairs, and the guests as places among the hot words, which take less than hashes."""
        n = len(self.words)
        once_w, once_k = _counted(self.w[self.once], None, n), _counted(self.k[self.once], None, n)
        out = []
        for p, a, b, i, j in self.parts:
            sent = self.sent[i:j]
            w = self.w[sent]
            own = (w >= a) & (w < b)
            guests, pairs = np.unique(w[~own], return_counts=True)
            numbers = np.append(_counted(w[own] - a, None, b - a), pairs)
            out.append((p, packed(self.words[a:b], self.c_w[a:b], once_w[a:b], once_k[a:b], numbers, self.words[self.k[sent]], self.c[sent], np.diff(self.place[guests], prepend=0))))
        return out


def _hot(blobs: list[bytes], n_parts: int) -> np.ndarray:
    """Of the chunks' candidates, those whose pairs are more than 1/SPLIT of a part's average."""
    asked = [unpacked(x) for x in blobs]
    words, of = np.unique(np.concatenate([x[0] for x in asked]).view(np.uint64), return_inverse=True)
    n = _counted(of, np.concatenate([x[1] for x in asked]), len(words))
    return words[n * (SPLIT * n_parts) > sum(int(x[2][0]) for x in asked)] if n_parts > 1 else words[:0]


def _answered(table: pa.Table, n_parts: int) -> pa.Table:
    """Answers to the screen's questions; of the parts that count candidates, the hot words."""
    part, blobs = table.column("part")[0].as_py(), table.column("data").to_pylist()
    if part < n_parts:
        return ex.answered(table, ex.in_two(blobs), 0)
    return ex.answered(table.slice(0, 1), [packed(_hot(blobs, n_parts))], HOT)


def _rows(part: int, made: list[tuple]) -> pa.Table:
    """Messages (part, kind, other, data); the totals of the part, if any, last."""
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _gathered(table: pa.Table, n_parts: int, hot: np.ndarray) -> pa.Table:
    """What a part learns from the chunks: its words, guests and pairs, where each chunk's are among them, and what it asks the owners of contexts and guests."""
    part, chunks = table.column("part")[0].as_py(), table.column("chunk").to_pylist()
    asked = [unpacked(x) for x in table.column("data").to_pylist()]
    every = lambda i, kind=np.int64: np.concatenate([x[i] for x in asked]).view(kind)
    names = [np.append(x[0].view(np.uint64), hot[np.cumsum(x[7])]) for x in asked]
    words, word = np.unique(np.concatenate(names), return_inverse=True)
    n, own = len(words), word[np.concatenate([np.arange(len(a)) < len(x[0]) for a, x in zip(names, asked, strict=True)])]
    c_w, once_w, once_k = (_counted(own, every(i), n) for i in (1, 2, 3))
    contexts, context = np.unique(every(5, np.uint64), return_inverse=True)
    pairs, pair = np.unique(np.repeat(word, every(4)) * max(len(contexts), 1) + context, return_inverse=True)
    c, w, k = _counted(pair, every(6), len(pairs)), pairs // max(len(contexts), 1), pairs % max(len(contexts), 1)
    owned = ex.parts_of(words, n_parts) == part
    guests = np.flatnonzero(~owned)
    made, at, e = [], 0, 0
    for chunk, x in zip(chunks, asked, strict=True):
        made.append((part, ROUTE, chunk, packed(np.diff(own[at : at + len(x[0])], prepend=0), np.diff(pair[e : e + len(x[5])], prepend=0)), None))
        at, e = at + len(x[0]), e + len(x[5])
    many, single = np.flatnonzero(c > 1), c == 1
    once_w += _counted(w[single], None, n)
    moving, of = np.unique(k[many], return_inverse=True)
    tables, settled = _counted(of, None, len(moving)), _counted(k[single], None, len(contexts))
    made.append((part, STATE, part, packed(c_w, once_w, c, w[many], of, guests), [float(c_w.sum()), float((c_w > 0).sum())]))
    made.append((part, NAMES, part, packed(words, once_k), None))
    root = once_w + _counted(w[many], None, n)
    none, asks = np.zeros(0, np.int64), {}
    for owner, a, b in ex.pieces(ex.parts_of(contexts[moving], n_parts)):
        asks.setdefault(owner, [none] * 6)[0:5:4] = contexts[moving][a:b], tables[a:b]
    still = np.flatnonzero(settled)
    for owner, a, b in ex.pieces(ex.parts_of(contexts[still], n_parts)):
        asks.setdefault(owner, [none] * 6)[1:3] = contexts[still][a:b], settled[still][a:b]
    for owner, a, b in ex.pieces(ex.parts_of(words[guests], n_parts)):
        asks.setdefault(owner, [none] * 6)[3:6:2] = words[guests][a:b], root[guests][a:b]
    for owner, (names, quiet, count, visiting, up, up_root) in asks.items():
        made += [(owner, SUBS, part, packed(names, quiet, count, visiting), None), (owner, UP, part, packed(up, up_root), None)]
    made += [(part, OWN, part, packed(root * owned), None), (part, DRAWN, part, packed(np.ones(len(many), np.int64)), None)]
    return _rows(part, made)


def _by_kind(table: pa.Table) -> dict[int, list[tuple[int, list[np.ndarray]]]]:
    """kind -> (other, arrays) in the order of others."""
    out: dict[int, list] = {}
    for kind, other, data in sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "other", "data")), strict=True)):
        out.setdefault(kind, []).append((other, unpacked(data)))
    return out


def _bound(table: pa.Table) -> pa.Table:
    """An owner's answer to what it is asked about: places among its words of contexts and of guests; and the tables of each context that never move."""
    part, got = table.column("part")[0].as_py(), _by_kind(table)
    ((_, (words, base)),) = got[NAMES]
    words, made = words.view(np.uint64), []
    place = lambda names: np.searchsorted(words, names.view(np.uint64))
    for other, (names, quiet, count, visiting) in got.get(SUBS, ()):
        made.append((part, BOUND, other, packed(place(names), place(visiting)), None))
        np.add.at(base, place(quiet), count)
    made.append((part, BASE, part, packed(base), None))
    return _rows(part, made)


def _told(table: pa.Table, n_words: float, n_tables: float, seed: list[int]) -> pa.Table:
    """An owner's contexts' tables in all parts, its words' customers and new tables in the parent, and the answers to those that asked about them."""
    part, got = table.column("part")[0].as_py(), _by_kind(table)
    ((_, (tables,)),), ((_, (root,)),) = got[BASE], got[OWN]
    places = dict(got.get(BOUND, ()))
    for other, (up, up_root) in got.get(UP, ()):
        at, visiting = places[other]
        np.add.at(tables, at, up)
        np.add.at(root, visiting, up_root)
    if ROOT in got:
        ((_, (_, s_w)),) = got[ROOT]
        s_w = seat(root, n_tables - s_w, np.full(len(root), 1.0 / (n_words + 1)), np.random.default_rng([*seed, part]))
    else:
        s_w = np.minimum(root, 1)
    made = [(other, DOWN, part, packed(tables[at], root[visiting], s_w[visiting]), None) for other, (at, visiting) in places.items() if len(at) + len(visiting)]
    return _rows(part, [*made, (part, TABLES, part, packed(tables), None), (part, ROOT, part, packed(root, s_w), [float(root.sum()), float(s_w.sum())])])


def _ratio(c, t, rest, p):
    """Weight of t + 1 tables over that of t: c customers, `rest` other tables in the restaurant, p the parent's probability of the dish."""
    return 4.0 * (c - t) / ((2.0 * c - t - 1.0) * t) * (STRENGTH + DISCOUNT * (rest + t)) * p


def seat(c: np.ndarray, rest: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn given all others of its restaurant; a dish without customers has none."""
    out = np.minimum(c, 1)
    order = np.argsort(c, kind="stable")
    bounds = np.searchsorted(c[order], np.arange(2, SMALL + 2))
    for n in range(2, SMALL + 1):
        own = order[bounds[n - 2] : bounds[n - 1]]
        for part in np.array_split(own, max(1, len(own) * n // (1 << 20))) if len(own) else ():
            t = np.arange(1, n, dtype=float)
            logs = np.zeros((len(part), n))
            np.cumsum(np.log(_ratio(float(n), t, rest[part, None], p[part, None])), axis=1, out=logs[:, 1:])
            out[part] = 1 + (logs + rng.gumbel(size=logs.shape)).argmax(1)
    for i in order[bounds[-1] :].tolist():
        n, r, q = float(c[i]), float(rest[i]), float(p[i])
        low, high = 1, int(c[i])
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if _ratio(n, float(mid), r, q) > 1 else (low, mid)
        reach = int(10 * np.sqrt(low)) + 40
        t = np.arange(max(1, low - reach), min(int(c[i]), low + reach) + 1, dtype=float)
        logs = np.append(0.0, np.cumsum(np.log(_ratio(n, t[:-1], r, q))))
        out[i] = int(t[(logs + rng.gumbel(size=len(t))).argmax()])
    return out


def parent(c_root: np.ndarray, s_w: np.ndarray, n_tables: float, n_root: float, n_words: float) -> np.ndarray:
    """P(w) from the parent's customers and tables of a word, and its totals."""
    return (c_root - DISCOUNT * s_w + (STRENGTH + DISCOUNT * n_tables) / (n_words + 1)) / (STRENGTH + n_root)


def _drawn(table: pa.Table, totals: list[float], seed: list[int]) -> pa.Table:
    """One sweep of a part: new tables of its pairs, added up for the owners of their contexts and words."""
    part, got = table.column("part")[0].as_py(), _by_kind(table)
    ((_, (c_w, once_w, c, w, of, guests)),), ((_, (t,)),), ((_, (c_root, s_w)),) = got[STATE], got[DRAWN], got[ROOT]
    n_words, n_root, n_tables = totals
    down = got.get(DOWN, ())
    t_k, c_root[guests], s_w[guests] = (np.concatenate([np.zeros(0, np.int64), *(x[i] for _, x in down)]) for i in range(3))
    # the parent without the pair's own tables
    others = c_root[w] - t
    p = parent(others, np.minimum(s_w[w], others), n_tables, n_root - t, n_words)
    t = seat(c[c > 1], (t_k[of] - t).astype(float), p, np.random.default_rng([*seed, part]))
    root = once_w + _counted(w, t, len(c_w))
    made, up, up_root, at, e = [], _counted(of, t, len(t_k)), root[guests], 0, 0
    for owner, (k, visiting, _) in down:
        made.append((owner, UP, part, packed(up[at : at + len(k)], up_root[e : e + len(visiting)]), None))
        at, e = at + len(k), e + len(visiting)
    root[guests] = 0
    return _rows(part, [*made, (part, OWN, part, packed(root), None), (part, DRAWN, part, packed(t), None)])


def _replied(table: pa.Table, n_sweeps: int) -> pa.Table:
    """For each chunk, of its words: the counts, and for each sweep the parent's customers and tables and the tables as a context; of its pairs: counts and tables of all sweeps together."""
    part, got = table.column("part")[0].as_py(), _by_kind(table)
    ((_, (c_w, _, c, _, _, _)),) = got[STATE]
    tables, total = [x[0] for _, x in got[TABLES]], (c == 1).astype(np.int64) * n_sweeps
    roots, seats = zip(*(x for _, x in got[ROOT]), strict=True)
    for _, (t,) in got[DRAWN]:
        total[c > 1] += t
    chunks, replies = [], []
    for chunk, (word, pair) in got[ROUTE]:
        word, pair = np.cumsum(word), np.cumsum(pair)
        later = [x[i][word] - x[0][word] for x in (roots, tables) for i in range(1, n_sweeps)]
        chunks.append(chunk)
        replies.append(packed(c_w[word], roots[0][word], tables[0][word], *later, *(s[word] for s in seats), c[pair], total[pair]))
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "part": pa.array([part] * len(chunks), pa.int32()), "kind": pa.array([1] * len(chunks), pa.int32()), "bits": pa.array(replies, pa.binary())})


def _summed(messages: DataFrame) -> list[float]:
    """The parts' two totals, added up: training tokens and known words, or the parent's customers and tables."""
    found = messages.where(F.col("totals").isNotNull()).select(F.posexplode("totals")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    by_place = {r.pos: r.v for r in found}
    return [by_place.get(i, 0.0) for i in range(2)]


def score(docs: DataFrame, train: str, *, text: str = "text", doc_id: str = "doc_id", burn: int = BURN, sweeps: int = SWEEPS, seed: int = 1) -> DataFrame:
    """doc (all columns but the text), n_tokens, n_known, train_tokens, base_score and score, learning from rows whose column `train` is true."""
    at_train = [c for c in docs.columns if c != text].index(train)
    chunks, n_parts = ex.chunked(docs, text=text, doc_id=doc_id)
    # several jobs read the chunks, so what is in which must be settled
    chunks = written(chunks, "chunks")
    by_chunk = chunks.groupBy("chunk")

    def chunk(rows: pa.Table) -> _Chunk:
        flags = rows.column("doc").combine_chunks()
        flags = (flags.chunk(0) if isinstance(flags, pa.ChunkedArray) else flags).field(at_train)
        return _Chunk(rows, n_parts, np.array([bool(x) for x in flags.to_pylist()], bool))

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        c = chunk(rows)
        return ex.asked(key[0].as_py(), ex.screen_blobs(c.keys) + c.candidates())

    def send(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = chunk(rows)
        c.screened(ex.replies(answers, 0), hot)
        return ex.asked(key[0].as_py(), c.blobs())

    answers = by_chunk.applyInArrow(tc.tidied(ask), ex.ASKED).groupBy("part").applyInArrow(tc.tidied(lambda t: _answered(t, n_parts)), ex.ANSWERED)
    screen = written(answers, "screen")
    # fewer than SPLIT a part
    hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpacked(r.bits)[0].view(np.uint64) for r in screen.where(F.col("kind") == HOT).collect())]))
    screen = screen.where(F.col("kind") == 0)
    sent = by_chunk.cogroup(screen.groupBy("chunk")).applyInArrow(tc.tidied(send), ex.ASKED)
    known = sent.groupBy("part").applyInArrow(tc.tidied(lambda t: _gathered(t, n_parts, hot)), _MESSAGE)
    # as few files as the later readings allow: each costs the executors some processes, too
    known = written(known.withColumn("read", F.when(F.col("kind") == STATE, 0).when(F.col("kind") == ROUTE, 1).otherwise(2)), "known", by="read")
    states, routes, first = (known.where(F.col("read") == i) for i in range(3))
    of = lambda d, *kinds: d.where(F.col("kind").isin(*kinds)).select("part", "kind", "other", "data", "totals")
    meet = lambda f, *tables: _union(tables).groupBy("part").applyInArrow(tc.tidied(f), _MESSAGE)
    told_by = lambda *totals: lambda t: _told(t, *totals)
    drawn_by = lambda *totals: lambda t: _drawn(t, *totals)
    bound = written(meet(_bound, of(first, NAMES, SUBS)), "bound")
    n_all, n_words = _summed(states)
    drawn, n_tables, roots, kept, all_totals = first, 0.0, [], [], []
    for sweep in range(burn + sweeps + 1):
        told = written(meet(told_by(n_words, n_tables, [seed, sweep, 1]), bound, of(drawn, UP, OWN), *roots), "told")
        roots, (n_root, n_tables) = [of(told, ROOT)], _summed(told)
        if sweep > burn:
            kept += [d.withColumn("other", F.lit(sweep).cast("long")) for d in (of(drawn, DRAWN), of(told, TABLES, ROOT))]
            all_totals.append((n_root, n_tables))
        if sweep < burn + sweeps:
            drawn = written(meet(drawn_by([n_words, n_root, n_tables], [seed, sweep, 0]), of(states, STATE), of(told, DOWN, ROOT), of(drawn, DRAWN)), "drawn")
    replies = _union([of(states, STATE), of(routes, ROUTE), *kept]).groupBy("part").applyInArrow(tc.tidied(lambda t: _replied(t, sweeps)), ex.ANSWERED)

    def apply(rows: pa.Table, answers: pa.Table) -> pa.Table:
        d = chunk(rows)
        d.screened(ex.replies(answers, 0), hot)
        by_part = ex.replies(answers, 1)
        n = len(d.words)
        c_w, roots, tables, seats = np.zeros(n, np.int64), np.zeros((sweeps, n)), np.zeros((sweeps, n)), np.zeros((sweeps, n))
        # pairs that were not sent have one customer at one table, or none
        fixed = d.c * (1.0 - DISCOUNT)
        for p, a, b, i, j in d.parts:
            x = unpacked(by_part[p])
            c_w[a:b], roots[0, a:b], tables[0, a:b] = x[:3]
            for s in range(1, sweeps):
                roots[s, a:b], tables[s, a:b] = x[1] + x[2 + s], x[2] + x[1 + sweeps + s]
            for s in range(sweeps):
                seats[s, a:b] = x[1 + 2 * sweeps + s]
            fixed[d.sent[i:j]] = x[-2] - DISCOUNT * x[-1] / sweeps
        c_k = c_w.copy()
        c_k[d.start] = c_w[d.end]
        c_k[d.end] = 0
        fresh = np.zeros(len(d.w))
        for s, (n_root, n_tables) in enumerate(all_totals):
            fresh += (STRENGTH + DISCOUNT * tables[s, d.k]) * parent(roots[s], seats[s], n_tables, n_root, n_words)[d.w] / sweeps
        p = np.log10((fixed + fresh) / (STRENGTH + c_k[d.k]))
        base = np.log10((c_w + 0.5) / (n_all + 0.5 * (n_words + 1)))
        per = lambda x: np.bincount(d.owner, weights=x, minlength=d.n_rows)
        columns = [rows.column("doc").combine_chunks(), pa.array(np.bincount(d.owner, minlength=d.n_rows), pa.int64()), pa.array(per(c_w[d.word] > 0).astype(np.int64)), pa.array([int(n_all)] * d.n_rows, pa.int64()), pa.array(per(base[d.word])), pa.array(per(p[d.pair]))]
        return pa.Table.from_arrays(columns, ["doc", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = ex.result_schema(chunks, "n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return by_chunk.cogroup(screen.unionAll(replies).groupBy("chunk")).applyInArrow(tc.tidied(apply), schema)


def _union(tables) -> DataFrame:
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (hashed_fold("doc_id", 5) != 1).alias("train"))
    d = score(docs, "train")
    return d.select("doc.doc_id", (~F.col("doc.train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
