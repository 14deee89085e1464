"""Main texts, vector codes and phrases against brute force, and on dirty small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import phrases, site_templates, value_codes

SF = "/root/testdata/sf0.001"


# --- main texts

def texts(spark, pages, **kw):
    rows = [(i, f"https://{host}/p{i}", html, "x", 1) for i, (host, html) in enumerate(pages)]
    out = site_templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, blocks int"), **kw)
    assert out.columns == ["page_id", "url", "text", "n_template", "n_chars"]
    got = {r["page_id"]: r for r in out.collect()}
    assert sorted(got) == list(range(len(pages))) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    return [got[i]["text"] for i in range(len(pages))]


ARTICLE = "<article><h1>A &amp; B</h1><p>one\n  two<br>three</p><p>four <b>five</b>"


def test_pages_by_what_elements_say(spark):
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">
<header><a href=/>Site</a></header><nav><ul><li>Menu</ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div id=cookie-notice>We use</div>
<form><p>Name</p></form><aside>Side</aside>{ARTICLE}<div class="comments"><p>First!</p></div><div class='share-buttons'>Share</div><nav>Next</nav></article>
<footer>&copy; us</footer></body></html>"""
    cases = [(page, "A & B\n\none two three\n\nfour five"), (ARTICLE, "A & B\n\none two three\n\nfour five"), (None, ""), ("", ""), ("plain &lt;text&gt; &#228;&nbsp;x", "plain <text> ä x"),
             ("<main><p>in main</p></main><p>outside</p>", "in main"), ("<div class='sidebar-left'><main>kept</main></div>", "kept"),
             ("<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", "a\n\nb\n\nc\n\nd\n\ne f\n\ng"), ("<p>x < y <3 and a<b", "x < y <3 and a"),
             ("<p title='a > b'>q</p><script>cut", "q"), ("<article></article>", ""), ("<header><h1>Title</h1><p>by me</p></header><p>t</p>", "Title\n\nby me\n\nt"),
             ("<article>1</article><article class=comment>2</article><article>3</article>", "1\n\n3"), ("</div></p>z</article>", "z"), ("<title>t</title>body", "body"),
             ("<head><title>t</title><p>no body tag", "no body tag"), ("&am &amp", "&am &"), ("<p hidden>h</p><p>s</p>", "s")]
    got = texts(spark, [(f"h{i}.org", html) for i, (html, _) in enumerate(cases)])
    assert got == [want for _, want in cases]


def test_pages_by_recurrence(spark):
    shop = [("shop.org", f"<div><div><p>Welcome to</p><ul><li>Home<li>Cart</ul></div><div><p>item {i}</p><p>{'said once' if i % 2 else 'always here'}</p></div><div>call us</div></div>") for i in range(8)]
    got = texts(spark, shop)
    assert all("Welcome" not in t and "call us" not in t and "Cart" not in t and f"item {i}" in t for i, t in enumerate(got))
    # the same on another host with few pages, copies of one page, and paragraphs of a marked article: nothing recurs
    assert texts(spark, [(f"h{i}.org", h) for i, (_, h) in enumerate(shop)])[0] == "Welcome to\n\nHome\n\nCart\n\nitem 0\n\nalways here\n\ncall us"
    assert texts(spark, [shop[1]] * 9)[0].startswith("Welcome to")
    same = [("news.org", f"<article><h1>Same title</h1><p>same passage</p><section><p>Subscribe</p><p>now</p></section><p>own {i}</p></article><div><p>links {i % 3}</p></div>") for i in range(9)]
    assert texts(spark, same) == [f"Same title\n\nsame passage\n\nown {i}" for i in range(9)]
    assert texts(spark, same, site_pages=99)[0] == "Same title\n\nsame passage\n\nSubscribe\n\nnow\n\nown 0"


def test_pages_tables(spark):
    pages = spark.createDataFrame([(1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "no url", "<p>b</p>"), (2, "//H.org:80/x", None), (3, "http://u@H.ORG/y", "<div>" * 5000 + "deep" + "<p>" * 5000)],
                                  "page_id long, url string, html string")
    got = site_templates.main_text(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, "b"), (1, "a"), (1, "a"), (2, ""), (3, "deep")]
    assert {r[0] for r in pages.select(site_templates.host_of(F.col("url"))).collect()} == {None, "h.org"}
    assert site_templates.main_text(pages.limit(0)).count() == 0
    long = "<article>" + "".join(f"<p>p {i}</p>" for i in range(20_000)) + "</article>"
    out = site_templates.main_text(spark.createDataFrame([(i, f"//a.b/{i}", long + str(i)) for i in range(3)], "page_id long, url string, html string")).first()
    assert out["text"] == "\n\n".join(f"p {i}" for i in range(20_000))


def test_pages_salted_templates(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plain = sorted(map(tuple, site_templates.main_text(pages).collect()))
    monkeypatch.setattr(site_templates, "MAX_BROADCAST_ROWS", -1)
    assert sorted(map(tuple, site_templates.main_text(pages).collect())) == plain


# --- vector codes

def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Python integers, row by row."""
    kept = [(i, label, [int(np.floor(x * 4096)) if abs(x) < 1e15 else int(x) * 4096 for x in v]) for i, label, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2])
    cut = [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]
    books = [[v[a:b] for _, _, v in kept[:entries]] for a, b in cut]

    def near(p, x):
        return min((sum((u - w) ** 2 for u, w in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            groups = defaultdict(list)
            for _, _, v in kept:
                groups[near(p, v[a:b])[1]].append(v[a:b])
            for i, g in groups.items():
                books[p][i] = [sum(c) // len(g) for c in zip(*g)]
    coded = [(i, label, [near(p, v[a:b]) for p, (a, b) in enumerate(cut)]) for i, label, v in kept]
    errors = Counter()
    for _, label, n in coded:
        errors[label] += sum(x for x, _ in n)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in n), sum(x for x, _ in n), errors[label]) for i, label, n in coded), key=str), sha


def codes_of(spark, rows, kind="double", **kw):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], f"vec_id long, label int, embedding array<{kind}>, code string, v int")
    coded, books = value_codes.compress(df, **kw)
    out = value_codes.with_label_error(coded)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"]
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()), key=str), books and books.sha256()


def test_codes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[50:150] = x[50]           # copies, ties
    x[:4] = x[0]                # equal first entries
    x[200:210] = np.round(x[200:210])
    rows = [(i - 5, None if i % 7 == 0 else i % 3, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, 1, None), (901, 1, [1.0] * 15 + [None]), (902, 1, [float("nan")] + [0.0] * 15), (903, 1, [float("-inf")] + [0.0] * 15)]
    want = brute_codes(rows)
    assert codes_of(spark, rows + odd) == want
    monkeypatch.setattr(value_codes, "BLOCK_VALUES", 16 * 7)  # many blocks
    assert codes_of(spark, rows + odd) == want
    assert codes_of(spark, rows + [rows[0]] * 3) == brute_codes(rows + [rows[0]] * 3)
    assert codes_of(spark, [(i, l, v[:12]) for i, l, v in rows[:40]]) == brute_codes([(i, l, v[:12]) for i, l, v in rows[:40]])


def test_codes_of_few_and_large(spark):
    few = [(None, 1, [0.5] * 8), (3, 1, [-0.5] * 8), (2, None, [0.25] * 8)]
    assert codes_of(spark, few) == brute_codes(few)
    big = [(i, 0, [float(i) * 1e12 + j for j in range(8)]) for i in range(40)]
    got, want = codes_of(spark, big), brute_codes(big)
    assert got[1] == want[1] and [r[:2] for r in got[0]] == [r[:2] for r in want[0]]
    assert [r[2] for r in got[0]] == [r[2] if r[2] < 2**63 else None for r in want[0]]
    most = [(i, 0, [1.7e308 * (-1) ** i] * 8) for i in range(3)]
    assert codes_of(spark, most)[1] == brute_codes(most)[1]
    other = codes_of(spark, few + [(9, 1, [1.0] * 16), (1, 2, [])])[0]  # the smallest id has no components
    assert {r[0]: r[1] for r in other} == {None: None, 3: None, 2: None, 9: None, 1: "00" * 8}
    assert codes_of(spark, [(1, 1, None)]) == ([], None) and codes_of(spark, []) == ([], None)


# --- phrases

def brute_phrases(rows, least=10, most=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most])]
    return sorted(out)


def found_phrases(spark, rows, **kw):
    df = spark.createDataFrame([(i, l, t, "x", 0) for i, (l, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int")
    return sorted(tuple(r) for r in phrases.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    pool = ["a", "B", "b", "c", "ä", "Ä", "ß", "\U0001F600", "d\x0bd", "e.e", "f", "  g", "x y", "h\t", "i,"]
    rows = [(("de", None, "und", "")[int(rng.integers(4))], " ".join(rng.choice(pool, int(rng.integers(0, 400))))) for _ in range(60)]
    rows += [("de", None), ("fr", ""), ("fr", " .,;"), (None, "one two " * 400 + "w" * 5000)]
    want = brute_phrases(rows)
    assert len(want) > 100 and found_phrases(spark, rows) == want
    assert found_phrases(spark, rows, most=3) == [r for r in want if r[1] <= 3]
    monkeypatch.setattr(phrases, "SLICE", 64)      # cuts in the middle of pieces
    monkeypatch.setattr(phrases, "CHUNK", 100)
    monkeypatch.setattr(phrases, "PART_MASS", 50)  # summaries that lose counters
    assert found_phrases(spark, rows) == want
    assert found_phrases(spark, []) == [] and found_phrases(spark, [("en", "too few")]) == []


def test_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(5)
    for spare in (1, 4):
        stream = np.concatenate((np.repeat(np.arange(40, dtype=np.uint64), 10), rng.integers(1000, 1 << 40, 3000).astype(np.uint64)))
        rng.shuffle(stream)
        summary = phrases.Summary(spare * len(stream) // 10 + 1)
        for at in range(0, len(stream), 50):
            summary.add(*(x.astype(t) for x, t in zip(np.unique(stream[at:at + 50], return_counts=True), (np.uint64, np.int64))))
        found = summary.survivors(10)
        assert set(range(40)) <= set(found.tolist()) and summary.lost < 10 / spare and len(summary.codes) <= summary.capacity


def test_exact_scores(spark):
    counts = spark.createDataFrame([("x", 1, "u", 5_000_000_000_000), ("x", 1, "v", 7_000_000_000_001), ("x", 2, "u v", 4_999_999_999_999), ("x", 0, "", 10**14)], "lang string, words int, phrase string, f long")
    real, phrases.frequent_runs = phrases.frequent_runs, lambda docs, **kw: counts
    try:
        row = phrases.collocations(counts).first()
    finally:
        phrases.frequent_runs = real
    assert row["score"] == 10**6 * 4_999_999_999_999**2 // (5_000_000_000_000 * 7_000_000_000_001)
