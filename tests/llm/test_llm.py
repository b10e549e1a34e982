"""The operators for training data: brute force on small fixtures, round trips, odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import components, decontaminate, exchange, langid, licenses, media, minhash, mixing, pitmanyor, quality, queries, radix, substring, suffixes
from quillon.llm import textcols as tc
from tests.compare import assert_same, connection

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, copies and near copies, clashing names."""
    rng = random.Random(7)
    base = words(rng, 300)
    passage = words(rng, 70)
    near = base.split(" ")
    near[10] = "other"
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join(near), "en", None),
        (4, None, None, None),
        (5, "", "en", "b"),
        (6, " \n\t ", "de", "b"),
        (7, "one", "en", "b"),
        (8, "One", "en", "b"),
        (9, words(rng, 40) + " " + passage + " " + words(rng, 40), "en", "a"),
        (10, words(rng, 40) + " " + passage + " " + words(rng, 40), "en", "a"),
        (11, words(rng, 40000), "en", "a"),
        (12, "12 34 !!", "en", "a"),
        (13, "äöü ÄÖÜ ñ 漢字 🙂", "de", "ü"),
        (14, "ab" * 400, None, "a"),
        (14, "ab" * 400, None, "a"),
        (None, words(rng, 60), "en", "a"),
        (None, None, None, None),
    ]
    d = frame(spark, rows)
    return rows, d.withColumns({"size": F.lit(1), "doc": F.lit("x"), "row": F.lit("y"), "chunk": F.lit(2), "copy": F.lit(3), "key": F.lit(4)})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    assert_same(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


# Words and windows


def test_words_are_those_of_the_pattern():
    texts = ["a b", "", "x\ty\nz", "ünï  çode\x0b!", " lead", "trail ", "A1b2-c3"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for table, pattern in ((tc.SPACES, SPACE_WORDS), (tc.NON_WORD, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))):
        lower = tc.LOWER[data]
        s, e, r = tc.word_bounds(lower, offsets, table)
        got = [(int(k), bytes(lower[a:b]).decode()) for k, a, b in zip(r, s, e, strict=True)]
        assert got == [(i, w) for i, t in enumerate(texts) for w in pattern.findall(t.lower())]


def test_equal_windows_have_equal_hashes():
    h = tc.run_hashes(np.array([5, 7, 9, 5, 7, 9], np.uint64), np.array([0, 1, 3]), np.array([3, 3, 6]))
    assert h[0] == h[2] != h[1]


#: Two different words that polynomials modulo 2**64 take for one.
ALIKE = ["".join("ab"[(i.bit_count() + k) & 1] for i in range(1024)) for k in range(2)]


def test_long_words_are_told_apart():
    raw = [w.encode() for w in ALIKE]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, _, _, _ = tc.word_hashes(data, offsets, tc.SPACES)
    assert h[0] != h[1]
    assert tc.run_hashes(tc._BYTE_CODES[data], offsets[:-1], offsets[1:])[0] == tc.run_hashes(tc._BYTE_CODES[data], offsets[:-1], offsets[1:])[1]


@pytest.mark.parametrize("n", range(1, 40))
def test_equal_strings_are_tied(n):
    rng = random.Random(n)
    strings = ["".join(rng.choice("ab\0") for _ in range(rng.randrange(n))).encode() for _ in range(60)]
    within = [rng.randrange(2) for _ in strings]
    data, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(x) for x in strings])
    got = radix.tied(data, ends - [len(x) for x in strings], np.array([len(x) for x in strings]), np.array(within))
    times = Counter(zip(strings, within, strict=True))
    numbers = {}
    for s, k, g in zip(strings, within, got.tolist(), strict=True):
        assert (g < 0) == (times[s, k] == 1) and (g < 0 or numbers.setdefault(g, (s, k)) == (s, k))


def test_classes_are_exact():
    data = np.frombuffer(b"abcabdabc", np.uint8)
    at, size = np.array([0, 3, 6]), np.array([3, 3, 3])
    for hashes in ([1, 2, 1], [7, 7, 7]):
        of, one, _ = radix.classes(data, at, size, np.array(hashes, np.uint64))
        assert of[0] == of[2] != of[1] and len(one) == 2


# 1 Benchmark decontamination


def test_contamination(spark, odd):
    rows, d = odd
    text = rows[8][1].split(" ")
    bench = spark.createDataFrame([(1, " ".join(text[45:60]).upper()), (2, "One"), (3, ""), (4, None), (None, "漢字")], "item_id long, text string")
    got = {r.doc.doc_id: r for r in decontaminate.contamination(d, bench).collect()}
    assert got[9].n_hit == got[10].n_hit == 15 and got[9]["items"] == ["1"]
    assert got[7].n_hit == got[8].n_hit == 1 and got[7]["items"] == ["2"]
    assert got[13].n_hit == 1 and got[13]["items"] == []
    assert got[4].n_words == got[5].n_words == 0 and got[1].n_hit == 0
    clean = {r.doc_id: r for r in decontaminate.clean_documents(d, bench).collect()}
    assert 7 not in clean and clean[1].text == rows[0][1] and len(clean[9].text.split()) == 150 - 15 and clean[9].row == "y"


def test_contamination_in_blocks(spark, odd):
    _, d = odd
    bench = d.select(F.col("doc_id").alias("item_id"), "text").where("doc_id in (1, 9)")
    whole = decontaminate.contamination(d, bench)
    blocks = decontaminate.contamination(d, bench, most_windows=50)
    pick = lambda x: sorted(((r.doc_id or -1), r.n_words, r.n_hit, r["items"], r.spans) for r in x.select("doc.doc_id", "n_words", "n_hit", "items", "spans").collect())
    assert pick(whole) == pick(blocks) and [len(r[4]) for r in pick(whole) if r[0] in (1, 3)] == [1, 2]


def test_contamination_by_an_item_that_many_share(spark, nothing):
    text = words(random.Random(8), 12)
    bench = spark.createDataFrame([(i, text) for i in range(40)], "item_id long, text string")
    d = spark.createDataFrame([(1, f"x {text} y", "z")] * 3, "doc_id long, text string, doc string")
    for most in (7, 1000):
        got = decontaminate.contamination(d, bench, most_windows=most).collect()
        assert len(got) == 3 and all(r.n_hit == 12 and r["items"] == sorted(map(str, range(40))) and len(r.spans) == 1 for r in got)
    assert decontaminate.contamination(nothing, bench).count() == 0
    none = decontaminate.contamination(d, bench.where("false")).collect()
    assert [r.n_hit for r in none] == [0, 0, 0] and decontaminate.clean_documents(d, bench.where("false")).count() == 3


def test_what_is_left_is_clean_too(spark):
    """Cutting joins words, which can make a window; in several blocks, one of another block."""
    w = [f"w{i}" for i in range(10)]
    x = [f"x{i}" for i in range(10)]
    inner = " ".join([*x[:3], *w, *x[3:]])
    bench = spark.createDataFrame([("a", " ".join(w)), ("b", " ".join(x)), ("c", "END")], "item_id string, text string")
    texts = [" ".join([*w[:5], *x, *w[5:]]), "Before. " + inner + " After.", " ".join([*w[:5], *x, *w[5:], "and", *w]), "a b", None, " ".join([*w[:3], inner, *w[3:]]), "end, End."]
    d = spark.createDataFrame([*enumerate(texts), (1, texts[1])], "doc_id long, text string")
    for most in (1, 2, 1000):
        got = sorted((r.doc_id, r.text and r.text.split()) for r in decontaminate.clean_documents(d, bench, most_windows=most).collect())
        assert got == [(1, ["Before.", "After."])] * 2 + [(2, ["and"]), (3, ["a", "b"]), (4, None)]


# 2 Media columns


def test_media_round_trip(spark, odd):
    rows, d = odd
    got = media.describe(media.store(d)).select("doc_id", "text", "media", "tracks").collect()
    assert len(got) == len(rows)
    for r in got:
        (t,) = media.tracks(bytes(r.media))
        want = media.padded((r.text or "").encode())
        assert media.payload(bytes(r.media), t) == want and len(want) % 64 == 0 and len(want) >= 64
        (c,) = r.tracks
        assert c.codec == "raw" and c.n_bytes == len(want) and c.duration == len(want) / 8000
        for k in c.keyframes:
            assert bytes(r.media)[k.first : k.first + k.length] in want
    assert Counter(bytes(r.media) for r in got if r.doc_id in (1, 2)).most_common(1)[0][1] == 2


def test_broken_containers_are_null(spark):
    good = media.container(b"x" * 128)
    d = spark.createDataFrame([(1, None), (2, b""), (3, good[:-9]), (4, b"\0\0\0\x04free"), (5, good)], "i int, media binary")
    got = {r.i: r.tracks for r in media.describe(d).collect()}
    assert got[1] is None and got[2] == [] and got[3] is None and got[4] is None and len(got[5]) == 1


def fragmented(payload: bytes, sizes: list[int], keys: list[bool]) -> bytes:
    """A container without samples of its own, and one fragment with a run of them."""
    box, full = media._box, media._full
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, 8000 << 16))
    empty = [full(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")] + [full(b"stsz", struct.pack(">II", 0, 0))]
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), *empty)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 8000, 0, 0, 0)), box(b"minf", stbl))
    trak = box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7)), mdia)
    moov = box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 64, 0, 0))))
    rows = b"".join(struct.pack(">II", n, 0 if k else 0x10000) for n, k in zip(sizes, keys, strict=True))

    def moof(shift):
        run = full(b"trun", struct.pack(">Ii", len(sizes), shift), rows, flags=0x601)
        return box(b"moof", full(b"mfhd", struct.pack(">I", 1)), box(b"traf", full(b"tfhd", struct.pack(">I", 7)), run))

    return moov + moof(len(moof(0)) + 8) + box(b"mdat", payload)


def test_fragments():
    data = bytes(range(200)) + b"x" * 56
    (t,) = media.tracks(fragmented(data, [100, 56, 100], [True, False, True]))
    assert media.payload(fragmented(data, [100, 56, 100], [True] * 3), t) == data
    assert t["key"].tolist() == [True, False, True] and t["sizes"].tolist() == [100, 56, 100] and t["duration"] == 192


def test_damaged_containers_never_end_a_job():
    for good in (media.container(b"x" * 640), fragmented(b"y" * 90, [30, 30, 30], [True] * 3)):
        whole = media.tracks(good)
        assert len(whole) == 1
        rng = random.Random(1)
        damaged = [good[:i] for i in range(len(good))]
        for _ in range(3000):
            raw = bytearray(good)
            for _ in range(rng.choice([1, 1, 4])):
                raw[rng.randrange(len(raw))] = rng.choice([0, 1, 0x7F, 0x80, 0xFF, rng.randrange(256)])
            damaged.append(bytes(raw))
        for raw in damaged:
            try:
                for t in media.tracks(raw):
                    assert len(media.payload(raw, t)) == t["sizes"].sum()
                    media._described(t)
            except ValueError:
                pass


def test_runs_claim_no_more_than_the_file():
    """Many runs of samples without a byte of their own, each of which alone fits."""
    box, full = media._box, media._full
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, 8000 << 16))
    empty = [full(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")] + [full(b"stsz", struct.pack(">II", 0, 0))]
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 8000, 0, 0, 0)), box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), *empty)))
    trak = box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7)), mdia)

    def file(runs, n, size):
        moov = box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 1, size, 0))))
        run = full(b"trun", struct.pack(">I", n))
        return moov + box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 7)), *[run] * runs)) + box(b"mdat", bytes(20_000))

    begin = time.perf_counter()
    for size in (0, 1):
        with pytest.raises(ValueError, match="longer than the file"):
            media.tracks(file(200, 20_000, size))
        (t,) = media.tracks(file(200, 50, size))
        assert len(t["sizes"]) == 10_000
    assert time.perf_counter() - begin < 2


def test_op2_digests(spark, tmp_path):
    texts = ["", None, "a" * 64, "ü" * 33, "x" * 100_000, "a" * 64]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.op2_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.container(data)
        want = (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert tuple(got[i][1:7]) == want
    assert got[2].feature == got[5].feature != got[3].feature and got[4].feature.startswith("raw;12.5040s;1563 samples;98 keyframes;")


def test_media_of_odd_rows(spark, odd, nothing):
    _, d = odd
    clash = media.describe(media.store(d.withColumns({"media": F.lit(1), "tracks": F.lit(2)})))
    assert sorted(clash.columns) == sorted({*d.columns, "media", "tracks"}) and {len(r.tracks) for r in clash.collect()} == {1}
    assert media.describe(media.store(nothing)).count() == 0


# 3 Language identification


def test_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.op3_language_id(spark, sf_dir).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_folded_weights_equal_the_kernel(spark):
    texts = ["the cat sat", "der hund lief", "le chat dort"]
    raw = [t.encode() for t in texts]
    seen = langid.presence(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])).astype(np.float32)
    z = seen / np.sqrt(seen.sum(1, keepdims=True))
    a = np.array([[1.0, -1.0], [0.5, 0.2], [-0.3, 0.9]], np.float32)
    kernel = (seen @ z.T) / np.sqrt(seen.sum(1))[:, None]
    assert np.allclose(langid.Model(["a", "b"], z.T @ a).scores(seen > 0), kernel @ a, atol=1e-4)


def test_language_of_odd_rows(spark, odd, nothing):
    rows, d = odd
    got = {r.doc_id: r for r in langid.identify(d, langid.fit(d)).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (4, 5, 6, 12)) and got[7].lang_pred in ("en", "de")
    assert langid.fit(nothing) is None and langid.identify(nothing, None).count() == 0
    assert {r.lang_pred for r in langid.identify(d, None).collect()} == {"und"}
    clash = d.withColumns({"lang_pred": F.lit(1), "score": F.lit("x")})
    for model in (None, langid.fit(clash)):
        got = langid.identify(clash, model)
        assert sorted(got.columns) == sorted(clash.columns) and got.schema["score"].dataType.typeName() == "double"


def test_rare_languages_are_learned(spark):
    rng = random.Random(6)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, make("abcdefg"), "aa", "s") for i in range(600)] + [(1000 + i, make("hijklmn"), "bb", "s") for i in range(6)]
    d = frame(spark, rows)
    got = {r.doc_id: r.lang_pred for r in langid.identify(d, langid.fit(d, most_rows=40, landmarks=24)).collect()}
    assert all(got[i] == lang for i, _, lang, _ in rows)


def test_the_sample_is_bounded(spark):
    """Exactly `most_rows` distinct texts of a language with more, however rows repeat."""
    rows = [(i, f"text {i % 3000} of {i % 2}", "ab"[i % 2], "s") for i in range(20_000)] + [(i, "a copy", "a", "s") for i in range(9000)] + [(1, "only one", "c", "s")]
    for most in (1, 2, 300):
        got = langid.labelled_sample(frame(spark, rows), most_rows=most).collect()
        assert Counter(r.label for r in got) == {"a": most, "b": most, "c": 1} and len({r.text for r in got}) == len(got)
        every = {x: sorted({r.h for r in langid.labelled_sample(frame(spark, rows), most_rows=10_000).collect() if r.label == x}) for x in "ab"}
        assert all(sorted(r.h for r in got if r.label == x) == every[x][:most] for x in "ab")


def test_scores_are_those_of_dense_ridge_regression(spark):
    """With every text as a landmark, against kernels of n-gram sets and a solve without sums over partitions."""
    rng = random.Random(9)
    rows = [(i, words(rng, 12) if i % 2 else words(rng, 12).upper()[::-1] + " zz", "ab"[i % 2], "s") for i in range(40)]
    model = langid.fit(frame(spark, rows), landmarks=64)
    texts = [r[1] for r in rows]

    def seen(t):
        raw = t.encode()
        return langid.presence(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]

    own = [set(np.flatnonzero(seen(t)).tolist()) for t in texts]
    kernel = np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in own] for x in own])
    y = np.array([[1.0 if r[2] == x else -1.0 for x in model.languages] for r in rows])
    n = {x: sum(r[2] == x for r in rows) for x in "ab"}
    w = np.diag([1.0 / n[r[2]] for r in rows])
    a = np.linalg.solve(kernel @ w @ kernel + langid.RIDGE * 2 * (kernel + 1e-6 * np.eye(40)), kernel @ w @ y)
    assert np.abs(model.scores(np.stack([seen(t) for t in texts])) - kernel @ a).max() < 1e-3


# 4 License scans


def test_licenses(spark):
    known = licenses.TEMPLATES
    texts = [f"Some words.\n{t}\nMore words." for t in known.values()]
    close = known["GPL-3.0"].replace("work", "program")
    far = "You need a license to drive a car in most places of the world."
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, close, far, None, "", "x" * 100000 + "\n" + known["MIT"]])], "doc_id int, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(d).collect()}
    n = len(texts)
    for i, name in enumerate(known):
        (b,) = got[i]
        assert b.license == name and b.differences == 0 and texts[i].encode()[b.first : b.last].decode() == known[name]
    assert got[n][0].license == "GPL-3.0" and got[n][0].differences == 1
    assert got[n + 1][0].license is None and got[n + 2] == got[n + 3] == [] and got[n + 4][0].license == "MIT"


def licenses_of(spark, texts):
    d = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    return [r.licenses for r in sorted(d.collect(), key=lambda r: r.doc_id)]


def test_wordings_of_licenses(spark):
    named = lambda t: {r.license for r in licenses_of(spark, [t])[0]}
    assert named("All rights reserved.") == named("Copyright (c) 2020 X. All rights reserved.") == {"Proprietary"}
    assert named("Dual-licensed under the MIT License or the Apache License, Version 2.0.") == {"MIT", "Apache-2.0"}
    assert named("Released by us under the MIT License.") == {"MIT"}
    assert named("Published under the GNU Affero General Public License, version 2.") == named("Licensed under CC BY-NC-SA 4.0.") == {None}
    for name in ("MIT", "BSD", "Unlicense"):
        text = "\n".join(textwrap.wrap(licenses.WORDINGS[name][-1], 70))
        (r,) = licenses_of(spark, [f"Program\n\n{text}\n\nÜnd more"])[0]
        assert (r.license, r.differences) == (name, 0) and r.last - r.first >= len(text) - 1


@pytest.mark.parametrize("n", [100, 180, 400, 5000])
def test_licenses_in_prose(spark, n):
    rng = random.Random(n)
    prose = lambda k: words(rng, k // 4, 10**6)[:k].rsplit(" ", 1)[0]
    known = licenses.TEMPLATES
    lines = {(name, i): line for name, text in known.items() for i, line in enumerate((f"{prose(n)}. {text}", f"{prose(n)}. {text} {prose(n)}", f"{prose(500)} licensed {prose(370)} {text} {prose(n)}"))}
    for (name, _), found in zip(lines, licenses_of(spark, lines.values()), strict=True):
        assert (name, 0) in {(r.license, r.differences) for r in found}
    # notices that stand apart in one long line, the second in reach of the first
    (found,) = licenses_of(spark, [f"{prose(500)} {known['MIT']} {prose(300)} {known['Apache-2.0']} {prose(300)} {known['GPL-2.0']} {prose(n)}"])
    assert {"MIT", "Apache-2.0", "GPL-2.0"} <= {r.license for r in found}


def test_licenses_of_odd_rows(spark, odd, nothing):
    rows, d = odd
    got = licenses.scan(d.withColumn("licenses", F.lit(1))).collect()
    assert len(got) == len(rows) and all(r.licenses == [] for r in got)
    twice = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (None, "Text.\n# Licensed under the Apache License,\n# Version 2.0.\nmore")], "doc_id int, text string")
    found = [[x.license for x in r.licenses] for r in licenses.scan(twice).collect()]
    assert sorted(found) == [["Apache-2.0"], ["MIT"], ["MIT"]] and licenses.scan(nothing).count() == 0


def test_wordings_are_ranked_by_what_they_save(spark):
    known = {name: (text, *licenses.WORDINGS[name]) for name, text in licenses.TEMPLATES.items()}
    scanner = licenses.Scanner(known)
    rng = random.Random(12)
    for w in scanner.wordings:
        t = " ".join(w.words)
        found = scanner.scan(f"{words(rng, 30)}. License: {t}. {words(rng, 20)}".encode())
        assert w.license in {x["license"] for x in found}, t
        # of a whole text that is quoted, the whole text saves the most, so it is what names the license
        seen = {x: [k for k, y in enumerate(w.words) if y == x] for x in w.words}
        saved = {v: v.saved(w.words, seen, 0, len(w.words), scanner.plain) for v in scanner.wordings}
        if len(w.words) > 10:
            assert saved[w] == max(saved.values()) >= 0.8 * w.size, t
    (r,) = licenses_of(spark, [licenses.WORDINGS["MIT"][-1].replace("merge", "mix")])[0]
    assert (r.license, r.differences) == ("MIT", 1) and r.saved > 0.8


def test_differences():
    assert licenses.differences("a b c d".split(), "x a b z d y".split())[0] == 1
    assert licenses.differences("a b".split(), [])[0] == 2


# 5 Near duplicates


def near_brute(rows, n, percent=80):
    sets = []
    for _, t in rows:
        w = SPACE_WORDS.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    rng = random.Random(n)
    rows = []
    for _ in range(12):
        base = words(rng, rng.randrange(20, 200), 2000).split(" ")
        for _ in range(rng.randrange(1, 12)):
            # a chain: each copy differs a little from the one before, so ends may differ by much
            base = [w if rng.random() > 0.015 else f"v{rng.randrange(999)}" for w in base]
            rows.append((len(rows), " ".join(base)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "x"), (len(rows) + 3, "X"), (len(rows) + 4, "  ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.ident: (r.n_shingles, r.component) for r in minhash.near_duplicates(d, words=n).collect()}
    assert got == near_brute(rows, n)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.sort(np.concatenate([a[:600], rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    _, m = minhash.minima(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]))
    x, y = minhash.packed(m)
    differ = sum(((int(p) ^ int(q)) >> (4 * k)) & 15 != 0 for p, q in zip(x, y, strict=True) for k in range(16))
    chance = 2**-4
    estimate = (1 - differ / 128 - chance) / (1 - chance)
    assert abs(estimate - 600 / (len(a) + 300)) < 0.2


def test_near_duplicates_of_odd_rows(spark, odd, nothing):
    rows, d = odd
    kept = [r.doc_id for r in minhash.one_of_each(d).collect()]
    assert {1, 4, 5, 6, 7, 9, 10, 11} <= set(kept) and not {2, 3, 8} & set(kept) and kept.count(None) == 2 and kept.count(14) == 2
    assert minhash.one_of_each(nothing).count() == 0


def test_copies_go_without_rows_that_share_their_id(spark):
    rng = random.Random(3)
    a, b, c, d = (words(rng, 60, 10**6) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (None, None), (2, c), (5, a), (5, d), (5, "")]
    got = minhash.one_of_each(frame(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, a), (None, b), (None, None), (2, c), (5, d), (5, "")])


def test_near_duplicates_of_words_that_hash_alike(spark):
    rows = [(1, ALIKE[0]), (2, ALIKE[1]), (3, ALIKE[0].upper())]
    got = {r.ident: r.component for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (5, 5)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# 6 and 7 Repeats


def repeats_brute(rows, width):
    first = {}
    split = {i: SPACE_WORDS.findall(t or "") for i, t in rows}
    for i, w in sorted(split.items()):
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("width", [3, 13, 30])
@pytest.mark.parametrize("chunk_bytes", [400, 1 << 22])
def test_substrings(spark, monkeypatch, width, chunk_bytes):
    monkeypatch.setattr(substring.ex, "PART_BYTES", 40 * chunk_bytes // 4)
    monkeypatch.setattr(substring.ex.chunked, "__kwdefaults__", {**substring.ex.chunked.__kwdefaults__, "chunk_bytes": chunk_bytes, "part_bytes": 2 * chunk_bytes})
    rng = random.Random(width)
    passages = [words(rng, width + k, 30) for k in (-1, 0, 1, 20)]
    rows = [(i * 3, "  ".join([words(rng, rng.randrange(0, 30), 30), rng.choice(passages), words(rng, rng.randrange(0, 30), 30)]) + "\n") for i in range(60)] + [(1, None), (2, "")]
    got = {r.i: (r.n_words, r.n_removed, r.kept or "") for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=width).select(F.col("doc.doc_id").alias("i"), "n_words", "n_removed", "kept").collect()}
    assert got == repeats_brute(rows, width)


def test_repeats_of_odd_rows(spark, odd, nothing):
    rows, d = odd
    got = {r.doc_id: r for r in substring.without_repeats(d).collect()}
    assert 2 not in got and 4 in got and got[4].text is None and got[9].text == rows[8][1] and len(got[10].text.split()) == 80 and got[1].text == rows[0][1]
    assert 14 in got and got[10].doc == "x" and substring.without_repeats(nothing).count() == 0


@pytest.mark.parametrize("chunk_bytes", [600, 1 << 22])
def test_suffixes(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(suffixes.ex.chunked, "__kwdefaults__", {**suffixes.ex.chunked.__kwdefaults__, "chunk_bytes": chunk_bytes, "part_bytes": 2 * chunk_bytes})
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefghijé ") for _ in range(n))
    shared = [letters(n) for n in (150, 199, 200, 201, 260, 420)]
    texts = [letters(rng.randrange(0, 120)) + rng.choice(shared) + letters(rng.randrange(0, 120)) for _ in range(60)]
    texts += [None, "", "a" * 500, "ab" * 100, "ab" * 101, shared[4] + shared[4], "🙂" * 60]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.i: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffixes.repeated_bytes(d).select(F.col("doc.doc_id").alias("i"), "n_bytes", "n_removed", "spans", "kept").collect()}
    assert [got[i] for i in range(len(texts))] == suffixes.brute_force(texts)


def test_digits_are_dealt_evenly():
    data = np.random.default_rng(0).integers(97, 123, 400_000).astype(np.uint8)
    _, _, digit, _ = suffixes._runs(data, np.array([0, len(data)]), 200, 64)
    sizes = np.bincount(suffixes.ex.parts_of(digit, 16), minlength=16)
    assert sizes.max() < 1.5 * sizes.mean()


def test_suffixes_of_odd_rows(spark, odd, nothing):
    rows, d = odd
    got = suffixes.repeated_bytes(d).collect()
    assert len(got) == len(rows) and {r.doc.doc_id for r in got if r.n_removed == r.n_bytes > 0} == {1, 2, 14}
    assert suffixes.repeated_bytes(nothing).count() == 0


def test_repeats_of_words_that_hash_alike(spark):
    rng = random.Random(5)
    rest = words(rng, 12)
    d = spark.createDataFrame([(1, f"{ALIKE[0]} {rest}"), (2, f"{ALIKE[1]} {rest}"), (3, f"{ALIKE[1]}\n{rest}")], "doc_id long, text string")
    got = {r.i: r.n_removed for r in substring.remove_repeats(d).select(F.col("doc.doc_id").alias("i"), "n_removed").collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    got = [r.n_removed for r in suffixes.repeated_bytes(spark.createDataFrame([(1, ALIKE[0][:300]), (2, ALIKE[1][:300])], "doc_id long, text string")).orderBy("doc.doc_id").collect()]
    assert got == [x[1] for x in suffixes.brute_force([ALIKE[0][:300], ALIKE[1][:300]])]


def test_hot_prefixes_are_lengthened(spark):
    rows = [(i, f"the same {i % 7} " + " ".join(f"w{i}x{k}" for k in range(40)) + " the same") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    hot = substring.hot_prefixes(d, text="text", doc_id="doc_id", width=5, group_bytes=5 * 7 * 60)
    w = np.array([tc.word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]), tc.SPACES)[0][0] for x in ("the", "same", "w1x1")], np.uint64)
    first = next(substring._prefixes(w, np.array([0, 2]), 5))
    assert first[0] in hot and first[1] not in hot and len(hot) == 3
    assert substring._lengthened(np.append(w, w), np.array([0]), 5, hot)[0] not in hot


def test_prefixes_are_measured_alike_at_every_size(spark):
    rng = random.Random(8)
    d = spark.createDataFrame([(i, words(rng, 200, 300)) for i in range(600)], "doc_id long, text string")
    of = lambda measured, **more: substring.hot_prefixes(d, text="text", doc_id="doc_id", width=5, group_bytes=5 * 7 * 130, measured=measured, **more)
    # a small measured share, which would make a prefix large that is seen once, does not: 64 suffixes are seen at least
    few, all_of = of(2000), of(1 << 30)
    assert len(all_of) >= 300 and set(few.tolist()) <= set(of(1 << 20).tolist()) | set(all_of.tolist()) and len(few) < 2 * len(all_of)
    assert len(of(1 << 30, most=7)) == 7 and set(of(1 << 30, most=7).tolist()) <= set(all_of.tolist())


def test_repeated_rows_are_dealt_apart(spark):
    rng = random.Random(9)
    rows = [(None, "the same text in every one of these rows")] * 10_000 + [(i, words(rng, 8)) for i in range(10_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    chunks, _ = exchange.chunked(d, text="text", doc_id="doc_id", chunk_bytes=6000, part_bytes=6000)
    sizes = [r[1] for r in chunks.groupBy("chunk").count().collect()]
    assert len(sizes) > 100 and sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / len(sizes)
    # what is dealt does not depend on the order of a partition's rows
    h = np.array([5, 7, 5, 5, 9], np.int64)
    one, other = exchange._dealt(h, {}, 3, 1000), exchange._dealt(h[::-1].copy(), {}, 3, 1000)
    assert sorted(zip(h.tolist(), one.tolist())) == sorted(zip(h[::-1].tolist(), other.tolist())) and len(set(one.tolist())) == 5


def test_repeated_rows_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(exchange.chunked, "__kwdefaults__", {"chunk_bytes": 500, "part_bytes": 1000})
    rng = random.Random(10)
    passage = words(rng, 30)
    rows = [(None, passage)] * 40 + [(3, passage + " end")] * 40 + [(4, words(rng, 50))] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.i, r.n_words, r.n_removed) for r in substring.remove_repeats(d).selectExpr("doc.doc_id as i", "n_words", "n_removed").collect())
    assert got == {(None, 30, 30): 40, (3, 31, 0): 40, (4, 50, 0): 3}
    texts = [t for _, t in rows]
    found = Counter((r.n_bytes, r.n_removed) for r in suffixes.repeated_bytes(d, width=60, gram=16).select("n_bytes", "n_removed").collect())
    assert found == Counter(x[:2] for x in suffixes.brute_force(texts, 60))
    scored = {(r.i, r.n_tokens, r.train_tokens) for r in pitmanyor.score(d.withColumn("train", F.lit(True)), "train").selectExpr("doc.doc_id as i", "n_tokens", "train_tokens").collect()}
    assert scored == {(i, n, 40 * 31 + 40 * 32 + 3 * 51) for i, n in ((None, 31), (3, 32), (4, 51))}


# 8 Language-model scores


def test_scores(spark, odd):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(0, 60), 50)) for i in range(80)] + [(90, None), (91, "never seen")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.col("doc_id") % 5 != 1)
    got = {r.doc.doc_id: r for r in pitmanyor.score(d, "train").collect()}
    counts: Counter = Counter()
    for i, t in rows:
        if i % 5 != 1:
            counts.update([*SPACE_WORDS.findall(t or ""), "\x00"])
    total, kinds = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*SPACE_WORDS.findall(t or ""), "\x00"]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total) and r.base_score == pytest.approx(base)
    assert all(r.score < 0 for r in got.values())


def weights_of_tables(c, rest, p):
    """Weights of 1 to c tables by the recursion of the number of seatings."""
    ways = [1.0]
    for n in range(1, c):
        ways = [(ways[t] * (n - 0.5 * (t + 1)) if t < n else 0.0) + (ways[t - 1] if t else 0.0) for t in range(n + 1)]
    out, fresh = [], 1.0
    for t in range(c):
        out.append(ways[t] * fresh * p ** (t + 1))
        fresh *= 1.0 + 0.5 * (rest + t + 1)
    return np.array(out) / sum(out)


@pytest.mark.parametrize(("c", "rest", "p"), [(2, 0, 0.3), (5, 3, 0.2), (9, 40, 0.05), (64, 10, 0.4), (65, 10, 0.4), (120, 0, 0.02)])
def test_tables_are_drawn_from_their_conditional(c, rest, p):
    n = 20_000 if c <= 64 else 4000
    got = pitmanyor.seat(np.full(n, c), np.full(n, float(rest)), np.full(n, p), np.random.default_rng(2))
    want = weights_of_tables(c, rest, p)
    seen = np.bincount(got, minlength=c + 1)[1:] / n
    assert abs(seen - want).max() < 4 * np.sqrt(0.25 / n) and abs(got.mean() - want @ np.arange(1, c + 1)) < 5 * got.std() / np.sqrt(n) + 1e-9


def test_many_customers():
    got = pitmanyor.seat(np.array([10**9, 10**6, 0, 1]), np.array([10.0, 10.0, 5.0, 5.0]), np.array([1e-3, 0.5, 0.1, 0.1]), np.random.default_rng(0))
    assert got[2] == 0 and got[3] == 1 and 1 < got[1] < 10**6


def test_packed_arrays():
    a, b = np.array([1, -5, 2**62]), np.array([2**64 - 1, 0], np.uint64)
    x, y, z = pitmanyor.unpacked(pitmanyor.packed(a, b, np.zeros(0, np.int64)))
    assert x.tolist() == a.tolist() and y.view(np.uint64).tolist() == b.tolist() and len(z) == 0


def seated_by_hand(texts, rng, sweeps, burn):
    """Mean probabilities of (context, word) by seating one customer at a time, everything in dictionaries; brute force."""
    tokens = [[*t.split(), "."] for t in texts]
    pairs = [(k, w) for t in tokens for k, w in zip(["^", *t], t, strict=False)]
    words = sorted({w for _, w in pairs})
    v = len(words)
    tables: dict = {}  # context -> list of [dish, customers]
    root: list = []  # the parent's tables, whose customers are the children's tables

    def p_root(w):
        n = sum(c for _, c in root)
        return (sum(c - 0.5 for d, c in root if d == w) + (1 + 0.5 * len(root)) / (v + 1)) / (1 + n)

    def p_word(k, w):
        own = tables.get(k, [])
        n = sum(c for _, c in own)
        return (sum(c - 0.5 for d, c in own if d == w) + (1 + 0.5 * len(own)) * p_root(w)) / (1 + n)

    def add(room, w, fresh):
        chances = [c - 0.5 if d == w else 0.0 for d, c in room] + [(1 + 0.5 * len(room)) * fresh]
        i = rng.choices(range(len(chances)), chances)[0]
        if i == len(room):
            room.append([w, 0])
        room[i][1] += 1
        return room[i][1] == 1

    def drop(room, w):
        i = rng.choices([i for i, (d, _) in enumerate(room) if d == w], [c for d, c in room if d == w])[0]
        room[i][1] -= 1
        if room[i][1] == 0:
            del room[i]
            return True
        return False

    mean: dict = {}
    for sweep in range(sweeps + burn):
        for k, w in pairs:
            if sweep and drop(tables[k], w):
                drop(root, w)
            if add(tables.setdefault(k, []), w, p_root(w)):
                add(root, w, 1 / (v + 1))
        if sweep >= burn:
            for k in {"^", *words}:
                for w in (*words, "?"):
                    mean[k, w] = mean.get((k, w), 0.0) + p_word(k, w) / sweeps
    return mean


def test_scores_agree_with_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "c", "d"], [8, 4, 2, 1], k=12)) for _ in range(12)] + ["a a a a a a a a", "a b a b a b a b"]
    held = ["a b c", "d d d d", "c a b d a", "x a y", ""]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(100 + i, t, False) for i, t in enumerate(held)]
    d = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r.doc.doc_id: r.score for r in pitmanyor.score(d, "train", burn=4, sweeps=12).collect()}
    mean = seated_by_hand(texts, rng, 300, 20)
    assert all(sum(mean[k, w] for w in ("a", "b", "c", "d", ".", "?")) == pytest.approx(1) for k in ("^", "a", "d"))
    known = {"a", "b", "c", "d", "."}
    for i, t in enumerate(held):
        tokens = [*t.split(), "."]
        want = 0.0
        for k, w in zip(["^", *tokens], tokens, strict=False):
            # an unknown word's context has no restaurant: the parent's probability, which "?" has as a context without customers
            if k == "^" or k in known:
                want += np.log10(mean[k, w if w in known else "?"])
            else:
                want = None
                break
        if want is not None:
            assert got[100 + i] == pytest.approx(want, abs=0.06 * len(tokens))


def test_probabilities_sum_to_one():
    c_root, s_w = np.array([9.0, 4.0, 1.0]), np.array([3.0, 2.0, 1.0])
    p = pitmanyor.parent(np.append(c_root, 0), np.append(s_w, 0), s_w.sum(), c_root.sum(), 3)
    assert p.sum() == pytest.approx(1)
    c, t = np.array([5.0, 2.0, 0.0, 0.0]), np.array([2.0, 1.0, 0.0, 0.0])
    assert ((c - 0.5 * t + (1 + 0.5 * t.sum()) * p) / (1 + c.sum())).sum() == pytest.approx(1)


@pytest.mark.parametrize("sizes", [(300, 600), (2000, 500)])
def test_scores_do_not_depend_on_chunks_and_parts(spark, monkeypatch, sizes):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(1, 40), 12), i % 4 > 0) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    whole = {r.doc.doc_id: r for r in pitmanyor.score(d, "train", sweeps=6).collect()}
    monkeypatch.setattr(pitmanyor.ex.chunked, "__kwdefaults__", {"chunk_bytes": sizes[0], "part_bytes": sizes[1]})
    cut = {r.doc.doc_id: r for r in pitmanyor.score(d, "train", sweeps=6).collect()}
    assert all(cut[i][:-1][1:4] == r[:-1][1:4] and cut[i].base_score == pytest.approx(r.base_score) for i, r in whole.items())
    # draws differ, the distribution does not
    assert all(abs(cut[i].score - r.score) < 0.05 * r.n_tokens for i, r in whole.items())
    assert sum(r.score for r in cut.values()) == pytest.approx(sum(r.score for r in whole.values()), rel=0.01)


def test_pairs_of_a_hot_word_are_dealt_to_all_parts(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(f"{w} the" for w in rng.choices([f"w{k}" for k in range(400)], k=30)), i % 4 > 0) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    whole = {r.doc.doc_id: r for r in pitmanyor.score(d, "train").collect()}
    monkeypatch.setattr(pitmanyor.ex.chunked, "__kwdefaults__", {"chunk_bytes": 2000, "part_bytes": 2000})
    made, write = {}, pitmanyor.written
    monkeypatch.setattr(pitmanyor, "written", lambda df, label, by=None: made.setdefault(label, []).append(write(df, label, by)) or made[label][-1])
    cut = {r.doc.doc_id: r for r in pitmanyor.score(d, "train").collect()}
    pairs: Counter = Counter()
    for r in made["known"][0].where(F.col("kind") == pitmanyor.ROUTE).collect():
        pairs[r.part] += len(pitmanyor.unpacked(r.data)[1])
    # half of all pairs end in one word
    assert len(pairs) > 15 and max(pairs.values()) < 3 * sum(pairs.values()) / len(pairs)
    assert all(cut[i][1:4] == r[1:4] and cut[i].base_score == pytest.approx(r.base_score) and abs(cut[i].score - r.score) < 0.05 * r.n_tokens for i, r in whole.items())
    assert sum(r.score for r in cut.values()) == pytest.approx(sum(r.score for r in whole.values()), rel=0.01)


def test_scores_with_hot_words_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pitmanyor.ex.chunked, "__kwdefaults__", {"chunk_bytes": 40, "part_bytes": 20})
    test_scores_agree_with_brute_force(spark)


def test_hot_words_are_those_over_a_share_of_a_part():
    w = np.array([1, 2**63, 5], np.uint64)
    blobs = [pitmanyor.packed(w, np.array([30, 3, 9]), np.array([100])), pitmanyor.packed(w[:1], np.array([20]), np.array([60])), pitmanyor.packed(w[:0], np.zeros(0, np.int64), np.array([40]))]
    assert pitmanyor._hot(blobs, 2).tolist() == [1] and pitmanyor._hot(blobs, 6).tolist() == [1, 5] and pitmanyor._hot(blobs, 1).tolist() == []


def test_a_single_number_can_be_written_to():
    (x,) = pitmanyor.unpacked(pitmanyor.packed(np.array([3])))
    np.add.at(x, np.array([0]), 4)
    assert x.tolist() == [7]


def test_model_beats_its_base(spark, sf_dir):
    r = pitmanyor.op8_pitman_yor(spark, sf_dir).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_scores_of_odd_rows(spark, odd, nothing):
    _, d = odd
    got = pitmanyor.score(d.withColumn("train", F.lit(None).cast("boolean")), "train").collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in got)
    assert pitmanyor.score(nothing.withColumn("train", F.lit(True)), "train").count() == 0


# 9 Mixing


def test_mix(spark, odd):
    rows, d = odd
    got = mixing.mix(d).select("doc.doc_id", "doc.source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    sources = {r.source: (r.source_size, r.target) for r in got}
    assert sources["b"] == (2, pytest.approx(min(6, sources["b"][1]))) and all(t <= 3 * s + 1e-9 for s, t in sources.values())
    again = mixing.mix(d.repartition(5)).select("doc.doc_id", "copies").collect()
    assert Counter((r.doc_id, r.copies) for r in again) == Counter((r.doc_id, r.copies) for r in got)
    mixed = mixing.mixed_rows(d)
    assert mixed.columns == [*d.columns, "copy_1"] and mixed.count() == sum(r.copies for r in got)


def test_mix_comes_near_its_targets(spark, sf_dir):
    got = mixing.op9_mixing(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= 3 * r.most


def test_no_words_no_mix(spark, nothing):
    assert mixing.mixed_rows(nothing).count() == 0
    assert {r.copies for r in mixing.mix(frame(spark, [(1, "", "en", "a"), (2, None, None, None)])).collect()} == {0}


# 10 Quality


def test_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    got = quality.op10_quality(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = got.join(labels, "doc_id").collect()
    good, bad = [r.quality for r in rows if r.label == 1], [r.quality for r in rows if r.label == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.7 and all(0 < r.quality < 1 for r in rows)
    assert sum(r.kept for r in rows if r.label == 1) / len(good) > 0.9


def test_sites_shrink(spark):
    docs = frame(spark, [(i, f"text number {i}", "en", "good" if i < 40 else "bad" if i < 80 else "rare") for i in range(82)])
    labels = spark.createDataFrame([(i, int(i < 40 or i == 80)) for i in range(81)] + [(None, 1), (5, None)], "doc_id long, quality int")
    pages = spark.createDataFrame([("https://www.site.org/en/3?x=1",), (None,), ("not a url",)], "url string")
    got = {r.doc.doc_id: r for r in quality.quality(docs, labels, pages).collect()}
    assert got[3].host == "site.org" and got[3].path == "site.org/en" and got[4].host == "source:good"
    assert got[10].site_quality > got[81].site_quality > got[50].site_quality


def test_quality_of_odd_rows(spark, odd, nothing):
    rows, d = odd
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "url string")
    got = quality.quality(d, labels, pages).collect()
    assert len(got) == len(rows) and {round(r.quality, 6) for r in got} == {0.5}
    assert quality.quality(nothing, labels, pages).count() == 0


def test_copies_of_a_labelled_row_are_one_label(spark):
    one = frame(spark, [(1, "text one", "en", "a"), (2, "text two", "en", "a"), *[(i, f"other {i}", "en", "b") for i in range(3, 9)]])
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (5, 0)], "doc_id long, quality int")
    pages = spark.createDataFrame([], "url string")
    many = one.unionAll(one.where("doc_id = 1").crossJoin(spark.range(49).select()))
    sites = [{r.doc.doc_id: round(r.site_quality, 12) for r in quality.quality(d, labels, pages).collect()} for d in (one, many)]
    assert many.count() == 57 and sites[0] == sites[1] and sites[1][1] < sites[1][2]


# The pipeline


def test_pipeline_stages(spark, sf_dir, odd, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "benchmark", "mix"]
    rows, d = odd
    docs = d.select(*nothing.columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0
        out = stage(spark, docs, sf_dir)
        assert out.columns == [*docs.columns, *(["copy"] if name == "mix" else [])]
        out.collect()


def test_pipeline(spark, sf_dir):
    """Each stage against brute force on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, r in before.items() if r.text and re.search(r"[^\W\d_]", r.text)}
    unique = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    texts = sorted((i, before[i].text) for i in ids)
    brute = near_brute(texts, 5)
    assert {r.doc_id for r in unique.collect()} == {i for i, (_, c) in brute.items() if i == c}
    rest = {r.doc_id: r.text for r in unique.collect()}
    cut = {r.doc_id: r for r in corpus_pipeline.repeats(spark, unique, sf_dir).collect()}
    expected = repeats_brute(sorted(rest.items()), corpus_pipeline.REPEAT_WORDS)
    assert set(cut) == {i for i, (n, gone, _) in expected.items() if gone == 0 or gone < n}
    for i, r in cut.items():
        assert r.text == (expected[i][2] if expected[i][1] else rest[i]) and r.n_chars == len(r.text)
    clean = corpus_pipeline.benchmark(spark, spark.createDataFrame(list(cut.values()), DOCS), sf_dir)
    assert decontaminate.contamination(clean, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0").count() == 0
    mixed = corpus_pipeline.mix(spark, clean, sf_dir)
    assert mixed.count() > 0 and {r.doc_id for r in mixed.collect()} <= set(cut)
