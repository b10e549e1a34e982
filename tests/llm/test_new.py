"""Periodic runs, whitening and HTML extraction: brute force, exact values and edge cases."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import htmltext, periodic, whitening


def plain_runs(w):
    """Every maximal run of at least four periods and six words, by comparing at every lag."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(rng, n, k):
    w = [rng.randrange(k) for _ in range(n)]
    if n > 10 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 9)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


@pytest.mark.parametrize("k", [1, 2, 3, 6, 30])
def test_runs_equal_those_of_all_lags(k):
    rng = random.Random(k)
    for _ in range(300):
        w = looped(rng, rng.randint(0, 140), k)
        assert [tuple(r) for r in periodic.runs(np.array(w, np.int64)).tolist()] == plain_runs(w)


def test_a_run_that_only_hashes_see_is_scanned_again(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(periodic.tc, "mix", lambda h: h * np.uint64(0))  # every block has the same hash
    for _ in range(30):
        w = looped(rng, 80, 3)
        assert [tuple(r) for r in periodic.runs(np.array(w, np.int64)).tolist()] == plain_runs(w)


def test_segments_hold_no_rare_word_and_no_run_is_cut():
    rng = random.Random(8)
    for _ in range(100):
        w = np.array(looped(rng, 200, 12))
        found = periodic.segments(w)
        for low, high in found:
            assert np.unique(w[low:high], return_counts=True)[1].min() >= 4
        for start, length, _ in plain_runs(w.tolist()):
            assert any(low <= start and start + length <= high for low, high in found)


def test_long_texts_of_runs():
    began = time.time()
    assert periodic.runs(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]
    assert periodic.runs(np.arange(200_000) % 1000).tolist() == [[0, 200_000, 1000]]
    assert len(periodic.runs(np.arange(200_000))) == 0
    assert time.time() - began < 60


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "a b " * 9, "x " * 50, "Z é " * 7 + "\x0b end", *[" ".join(f"w{v}" for v in looped(rng, rng.randint(1, 90), 5)) for _ in range(60)]]
    rows = [(i, t) for i, t in enumerate([*texts, "same words here"] * 2)] + [(None, "a b c " * 8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = periodic.op11_periodic_runs(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        w = (t or "").encode().split()
        h, n = zlib.crc32(b"" if i is None else str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = plain_runs(w)
        gone = {j for s, m, q in found for j in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = by_id[i]
        assert (r.n_runs, r.n_words) == (len(found), n)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(v for j, v in enumerate(w) if j not in gone)).hexdigest()


def test_runs_keep_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b " * 4, 7)], "doc int, text string, runs int").withColumn("t", F.lit("x")).withColumn("n_words", F.lit(3))
    r = periodic.periodic_runs(d).first()
    assert (r.doc.doc, r.doc.runs, r.doc.t, r.doc.n_words) == (1, 7, "x", 3) and [tuple(x) for x in r.runs] == [(0, 8, 2)] and r.collapsed == "a b"
    assert periodic.periodic_runs(d.where("false")).count() == 0


def exact_polynomial(a):
    """det(x - a) by Faddeev and LeVerrier in fractions."""
    d = len(a)
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(sum(a[i][t] * m[t][i] for t in range(d)) for i in range(d)) / k)
    return [int(v) for v in reversed(c)]


@pytest.mark.parametrize(("n", "d", "rank"), [(30, 6, None), (4, 6, None), (50, 5, 2), (9, 1, None)])
def test_characteristic_polynomial_is_exact(n, d, rank):
    rng = np.random.default_rng(d)
    x = rng.integers(-400, 400, (n, d))
    if rank:
        x = x[:, :rank] @ rng.integers(-3, 4, (rank, d))
    a = (n * (x.T @ x) - np.outer(x.sum(0), x.sum(0))).astype(object)
    poly = whitening.characteristic_polynomial(a)
    assert poly == exact_polynomial([[int(v) for v in row] for row in a])
    roots = whitening.largest_roots(poly, 4)
    want = np.linalg.eigvalsh(a.astype(float))[::-1]
    assert len(roots) == min(4, d, rank or n - 1)
    assert [(r.low + r.high) / (2 << r.bits) for r in roots] == pytest.approx(want[: len(roots)], rel=1e-12)


def test_equal_eigenvalues_have_orthogonal_components():
    a = (np.eye(5, dtype=np.int64) * 50).astype(object)
    a[0, 0] = 90
    v = np.array(whitening.components(a, whitening.largest_roots(whitening.characteristic_polynomial(a), 4)), float)
    assert np.abs(v @ v.T - np.eye(4)).max() < 1e-12 and np.abs(a.astype(float) @ v.T - v.T * [90, 50, 50, 50]).max() < 1e-9


def test_products_of_large_integers_are_exact():
    x = np.array([[2**62, -(2**63)], [1, 2**40], [-7, 3]])
    assert (whitening._products(x) == x.T.astype(object) @ x.astype(object)).all()


def test_whitening_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 5)).astype(np.float32)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(np.concatenate([v, np.repeat(v[:1], 30, axis=0)]))]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, [1.0, 2.0]), (None, rows[3][1])]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = whitening.op12_whitening(spark, f"file://{tmp_path}").collect()
    assert len(got) == 4 * 71 and {r.n for r in got} == {40}
    x = np.floor(256 * v.astype(float)).astype(np.int64)
    mean, s = x.mean(0), x.sum(0)
    e, u = np.linalg.eigh((x - mean).T @ (x - mean) / 40)
    e, u = e[::-1], u[:, ::-1]
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(4):
        want = (x - mean) @ u[:, k] / np.sqrt(e[k])
        have = np.array([by[i, k + 1].whitened for i in range(40)])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert by[0, k + 1].explained == pytest.approx(e[k] / e.sum(), rel=1e-12) and by[69, k + 1].whitened == have[0] == by[40, k + 1].whitened
    assert by[None, 1].whitened == by[3, 1].whitened
    assert all(by[i, 1].deviation == int(((40 * x[i] - s) ** 2).sum()) for i in range(40)) and max(r.identity_error for r in got) < 1e-12


def test_whitening_without_spread(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0], 5), (2, [1.0, 2.0], 6)], "row int, embedding array<float>, n int")
    assert [(r.row.row, r.row.n, r.n, r.deviation, r.whitened, r.explained) for r in whitening.whiten(d).orderBy("row.row").collect()] == [(1, 5, 1, 0, [], []), (2, 6, 1, 0, [], [])]
    assert whitening.whiten(d.where("false")).count() == 0
    huge = spark.createDataFrame([(1, [1e16]), (2, [-1e16]), (3, [5.0])], "i int, embedding array<double>")
    assert [r.deviation for r in whitening.whiten(huge).orderBy("row.i").collect()][0] is None


PROSE = "The cat sat on the mat and it was not for the dog that was in the house with a friend of his. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        (page("<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>Short.<p>One\n  two&nbsp;three<br>four</article><footer>&copy; me</footer>"), "A & B\nShort.\nOne two three four"),
        (page(f"<header><h2>Site</h2></header><h1>Title</h1><div>{PROSE}</div><p>Short end.</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul><div id='comments'><p>{PROSE}</div>"), f"Title\n{PROSE.strip()}\nShort end."),
        (page(f"<article class='post has-sidebar'><p>{PROSE}</p><div class=share>Share this</div><aside>{PROSE}</aside><form><p>Mail?<input></form></article><section class='reader-comments'><article class=comment><p>{PROSE}</article></section>"), PROSE.strip()),
        (page(f"<div class='cookie-notice'><p>{PROSE}</p></div><main><p>{PROSE}</p><p>Below.</p></main><div role=contentinfo>end</div><div style='display: none'>{PROSE}</div>"), f"{PROSE.strip()}\nBelow."),
        (page(f"<div class='ad'>never closed<article><p>{PROSE}</p></article>"), PROSE.strip()),
        (page(f"<article><p>a < b and 3 > 2 <b>bold<p>x<script>var t='</p>'; if (a<b) {{}}</script>y<!-- <p>no</p> --></article>"), "a < b and 3 > 2 bold\nxy"),
        (page("<article><p>" + "qqq zzz vvv kkk " * 20 + "</p><p>tail</p></article>"), ("qqq zzz vvv kkk " * 20).strip() + "\ntail"),
        (page(f"<form action=/><main><p>{PROSE}</p></main></form>"), PROSE.strip()),
    ],
)
def test_main_text(html, want):
    assert htmltext.page_text(html)[0] == want


@pytest.mark.parametrize("html", ['<p "x', "<b>", "<div>x", "<ul><li>x", "<!--", "<script>", "<", "<a href='", "<x/", "</", "<p><td>", "&#xD800;&bogus;"])
def test_broken_pages_take_time_in_proportion(html):
    began = time.time()
    htmltext.page_text(html * 20_000)
    assert time.time() - began < 15


def test_pages_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = htmltext.op13_html_text(spark, sf_dir)
    assert got.count() == pages.count() and got.where("n_chars <> length(text) or text is null or text like '%&copy;%' or text like '%track(%'").count() == 0
    d = spark.createDataFrame([(1, None, "t"), (2, "<p>x</p>", "u"), (2, "<p>x</p>", "u")], "page int, html string, text string").withColumn("h", F.lit(1))
    assert [(r.page.page, r.page.text, r.page.h, r.text) for r in htmltext.main_text(d).orderBy("page.page").collect()] == [(1, "t", 1, ""), (2, "u", 1, "x"), (2, "u", 1, "x")]
    assert htmltext.main_text(d.where("false")).count() == 0
