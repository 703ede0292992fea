"""HTML extraction, periodic runs and whitening against brute force, on small fixtures with their edge cases."""

import hashlib
import html
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gateflow.llm import html_text, periodic, queries, whitening

SF = "/root/testdata/sf0.001"

# --- 11 HTML extraction ------------------------------------------------------------------------


def text_of(spark, pages, **options):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.html_text(df, **options).collect()}


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."


SOUP = """<html><head><title>t</title></head><body><div id=top><a href=/>Home</a> <a href=/x>News of the day</a></div><div>Our site is the best of all sites.</div>
<div class=box><h2>{title}</h2>{paragraphs}</div><div class=low><p>Written by all of us, read by all of you.</p></div><div><ul>{links}</ul></div></body></html>"""


@pytest.mark.parametrize("held", [html_text.HELD_BYTES, 0])
def test_template_of_plain_divs(spark, held):
    """Nothing but the template tells the article apart here: constant texts and lists of links go."""
    rng = random.Random(5)
    pages, want = [], {}
    for k in range(12):
        parts = [sentence(rng, 12) for _ in range(rng.randrange(1, 5))]
        title = sentence(rng, 4)
        links = "".join(f"<li><a href=/{j}>{sentence(rng, 3)}</a></li>" for j in range(rng.randrange(2, 6)))
        pages.append((k, f"http://h{k % 2}.org/{k}", SOUP.format(title=title, paragraphs="".join(f"<p>{p}</p>" for p in parts), links=links)))
        want[k] = " ".join([title, *parts])
    assert text_of(spark, pages, held_bytes=held) == want
    # a copy of a page many times on one host is no template of its own; the others of the host are as before
    copies = [(100 + k, "http://h0.org/copy", pages[0][2]) for k in range(3)]
    got = text_of(spark, pages + copies, held_bytes=held)
    assert {k: got[k] for k in want} == want and {got[100 + k] for k in range(3)} == {want[0]}


def test_classes_nest():
    token = lambda name, vector, place: {"token": name, "pages": sum(v > 0 for v in vector), "sum_1": hash(tuple(vector)), "sum_2": 0, "first": place * sum(v > 0 for v in vector)}
    root = [token(1, (1, 1, 1), 0), token(2, (1, 1, 1), 5), token(3, (1, 1, 1), 20)]
    item = [token(4, (3, 2, 5), 6), token(5, (3, 2, 5), 8)]
    across = [token(6, (0, 1, 1), 7), token(7, (0, 1, 1), 21)]
    alone = [token(8, (2, 0, 0), 9)]
    assert [[t["token"] for t in c] for c in html_text.valid_classes(alone + across + item + root)] == [[1, 2, 3], [4, 5]]


MARKED = [
    ("<article><h1>A &amp; B</h1><p>one<b>two</b> three<br>four<p>five</article>", "A & B onetwo three four five"),
    ("<nav><a href=x>menu</a></nav><main>kept<aside>not</aside><div class='ad'>not</div><form>not<input></form> also</main><footer>not</footer>", "kept also"),
    ("<article>a<div id=comments><article>no</article></div><section class='post-content'>b</section></article>", "a b"),
    ("<div class='with-sidebar'><article>x</article></div><div class=\"sidebar\">no</div>", "x"),
    ("<form action=all><article>in a form</article></form>", "in a form"),
    ("<article>1 < 2 &lt; 3 <!-- <p>no</p> -->&copy;&nbsp;&#65;&ampx &am</article>", "1 < 2 < 3 © A&x &am"),
    ("<script>var t='</article>';</script><article a='>' b=\"<p>\">t<style>p{}</style></article >", "t"),
    ("<ARTICLE><P>upper</P></ARTICLE>", "upper"),
    ("<article>unclosed <p>text <i>goes <script>if (a < b) {", "unclosed text goes"),
    ("<article>x<!-- never closed <p>no", "x"),
    ("<article><header><h1>Title</h1></header><div class='article-header'>by</div>t</article><header>no</header>", "Title by t"),
    ("<head><title>t</title></head><header>no</header><p>only prose here</p>", "only prose here"),
    ("no markup at all", "no markup at all"),
    ("", ""),
    (None, ""),
    ("<", "<"),
    ("<article>" + "<p>long \n\t text</p>" * 20_000 + "</article>", " ".join(["long text"] * 20_000)),
    ("<div>" * 3000 + "<article>deep</article>", "deep"),
]


def test_marked_up_pages(spark):
    pages = [(k, f"https://site{k}.org/", page) for k, (page, _) in enumerate(MARKED)]
    got = text_of(spark, pages)
    for k, (_, want) in enumerate(MARKED):
        assert got[k] == want, k


def test_html_edges(spark):
    rows = [(1, None, "<article>a</article>"), (1, None, "<article>a</article>"), (None, "no host", "<article>b</article>"), (3, "http://h.org", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("text", "host", "n_chars", "model", "id", "token")})
    out = html_text.html_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in out.collect()) == [(0, "no host", "b", 1), (1, "", "a", 1), (1, "", "a", 1), (3, "http://h.org", "", 0)]
    assert html_text.html_text(df.limit(0)).count() == 0


def test_pages_without_their_marks(spark):
    """The given pages with all telling tags and names taken away: the template alone finds the same text on hosts with pages enough."""
    df = queries.table(spark, "/root/testdata/sf0.01", "pages")
    plain = df.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(/?)(?:article|nav|footer)>", "<$1div>"), ' class="ad"', ""))
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    want = html_text.html_text(df).withColumn("host", host)
    got = html_text.html_text(plain).select("page_id", F.col("text").alias("found"))
    rows = want.join(got, "page_id").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.host] += 1
    many = [r for r in rows if sizes[r.host] >= 5]
    assert len(many) > 50 and all(r.text == r.found for r in many)


# --- 12 periodic runs --------------------------------------------------------------------------


def plain_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            if w[at] != w[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and w[end] == w[end + q]:
                end += 1
            length = end - at + q
            smaller = any(all(w[x] == w[x + p] for x in range(at, at + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((at, length, q))
            at = end
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made_texts():
    rng = random.Random(12)
    texts = ["", None, " \n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b a b a b a", "a b " * 3 + "a c", ("a b " * 6 + "c ") * 5, "x " * 3000, "a" * 5000]
    for _ in range(120):
        w = [rng.choice("ab" if rng.random() < 0.5 else "abcdef") for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.7:
            p = rng.randrange(1, 25)
            part = [rng.choice("abcdefghij") for _ in range(p)]
            w = w[:10] + (part * 9)[: rng.randrange(3 * p, 9 * p)] + w[10:]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    fib = ["a", "a b"]
    for _ in range(9):
        fib.append(f"{fib[-1]} {fib[-2]}")
    texts.append(fib[-1])  # many squares and cubes, no fourth powers
    return texts


def test_periodic_runs(spark):
    texts = made_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in periodic.periodic_runs(df).collect():
        w = (texts[r.doc_id] or "").split()
        want = plain_runs(w) if len(w) < 2000 else [(0, len(w), 1)]
        assert [tuple(x) for x in r.runs] == want, r.doc_id
        assert (r.n_words, r.collapsed) == (len(w), collapsed(w, want)) and r.n_dropped == len(w) - len(r.collapsed.split())


def test_periodic_runs_of_great_length():
    """A period of thousands of words in 200,000, and pairs that are not followed twice."""
    rng = np.random.default_rng(3)
    w = rng.integers(0, 1 << 60, 200_000).astype(np.uint64)
    w[50_000:110_000] = np.tile(w[:12_000], 5)
    w[150_000:160_000] = w[7]
    assert periodic.runs_of(w) == [(50_000, 60_000, 12_000), (150_000, 10_000, 1)]
    assert periodic.runs_of(np.tile(w[:3], 100_000)) == [(0, 300_000, 3)]


def test_periodic_query_digests(spark):
    rows = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs = queries.table(spark, SF, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        w, h = [x for x in _split(d.text)], zlib.crc32(str(d.doc_id).encode())
        if len(w) > 1500 and h % 10:
            continue
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) > 1500:
            continue
        runs, r = plain_runs(w), rows[d.doc_id]
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)


def _split(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_periodic_edges(spark):
    df = spark.createDataFrame([(1, "a " * 8), (1, "a " * 8), (None, None)], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("runs", "collapsed", "a.b", "__text")})
    rows = periodic.periodic_runs(df).collect()
    assert [(r.doc_id, r.text, r["a.b"], r.collapsed) for r in sorted(rows, key=lambda r: -(r.doc_id or 0))] == [(1, "a " * 8, "a.b", "a")] * 2 + [(None, None, "a.b", "")]
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "b " * 9), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in queries.with_repeats(none).collect()} == {None: "b " * 9, 4: ""}


# --- 13 whitening ------------------------------------------------------------------------------


def plain_whitening(vectors, weights="one", k=4):
    """By id: (n, deviation, whitened up to sign, explained); and the error of the identity."""
    x = {i: tuple(math.floor(256 * float(c)) for c in v) for i, v in vectors.items()}
    fit = {}
    for v in x.values():
        fit[v] = fit.get(v, 0) + 1
    m, w = np.array(list(fit), dtype=object), np.array([c if weights == "count" else 1 for c in fit.values()], dtype=object)
    total, s = int(w.sum()), (m * w[:, None]).sum(axis=0)
    mean = np.array([float(v) / total for v in s])
    y = m.astype(float) - mean
    cov = (y * w[:, None].astype(float)).T @ y / total
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    z = {i: (np.array(v, dtype=float) - mean) @ u / np.sqrt(e) for i, v in x.items()}
    return {i: (len(fit), sum((total * a - b) ** 2 for a, b in zip(x[i], s, strict=True)), z[i], e / np.trace(cov)) for i in x}


def check_whitening(out, want, k=4):
    by = defaultdict(dict)
    for r in out.collect():
        by[r.vec_id][r.component] = r
    assert set(by) == set(want)
    ids = sorted(want)
    for c in range(1, k + 1):
        got, ref = np.array([by[i][c].whitened for i in ids]), np.array([want[i][2][c - 1] for i in ids])
        sign = 1 if abs(got - ref).max() < abs(got + ref).max() else -1
        assert np.allclose(got, sign * ref, atol=1e-8)
        for i in ids:
            r = by[i][c]
            assert (r.n, r.deviation) == want[i][:2] and math.isclose(r.explained, want[i][3][c - 1], rel_tol=1e-9) and r.identity_error < 1e-9


def vectors_of(n=300, d=7, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(1, 3, d)
    base[n // 2 :] = base[rng.integers(0, n // 10, n - n // 2)]  # copies
    base[: n // 3] = base[0]
    return {i: v.tolist() for i, v in enumerate(base)}


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    vectors = vectors_of()
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(4)
    check_whitening(whitening.whiten_embeddings(df, weights=weights), plain_whitening(vectors, weights))


def test_whitening_of_the_given_table(spark):
    rows = queries.table(spark, "/root/testdata/sf0.01", "embeddings").collect()
    want = plain_whitening({r.vec_id: r.embedding for r in rows})
    check_whitening(queries.op13_embedding_whitening(spark, "/root/testdata/sf0.01"), want)


def test_whitening_edges(spark, monkeypatch):
    """Nulls, odd entries, lengths of their own, one vector alone, no variance, and models joined instead of held."""
    good = vectors_of(60, 3, 1)
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None), (1001, [1.0, None, 2.0]), (1002, [nan, 0.0, 0.0]), (1003, [inf, 0.0, 0.0]), (1004, []), (1005, [5.0]), (1006, [1e300, 0.0, 0.0])]
    flat = [(2000 + i, [float(i), 2.0, 2.0, 2.0, 2.0]) for i in range(4)]
    df = spark.createDataFrame([*good.items(), *odd, *flat, (7, good[7])], "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("n", "d", "key", "copies")})
    for held in (whitening.HELD_BYTES, 0):
        monkeypatch.setattr(whitening, "HELD_BYTES", held)
        rows = whitening.whiten_embeddings(df).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.vec_id].append(r)
        assert not set(by) & {1000, 1001, 1002, 1003, 1004, 1006} and len(by[7]) == 6 and len(by[8]) == 3
        assert [(r.n, r.deviation, r.whitened, r.explained) for r in by[1005]] == [(1, 0, None, None)]
        assert [len(by[2000 + i]) for i in range(4)] == [4] * 4 and {r.component for r in by[2001] if r.whitened is not None} == {1}
        want = plain_whitening(good, k=3)
        assert all(math.isclose(abs(r.whitened), abs(want[8][2][r.component - 1]), rel_tol=1e-7) for r in by[8])
    assert whitening.whiten_embeddings(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [3e15, 1.0]), (2, [-3e15, 2.0])], "vec_id long, embedding array<double>")
    assert all(r.deviation is None and r.identity_error < 1e-6 for r in whitening.whiten_embeddings(huge).collect())
    plain = spark.createDataFrame([(1, [-0.001, 0.004]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r.vec_id: r.deviation for r in whitening.whiten_embeddings(plain).collect()} == {1: 2, 2: 2}
