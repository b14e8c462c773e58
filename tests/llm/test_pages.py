"""Main text, WARC archives and URL rules."""

import base64
import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import gbt, htmltext, urlfilter, warc

PAGES = "page_id long, url string, html string, text string, score int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 0) for i, u, h in rows], PAGES)


@pytest.fixture(scope="module")
def model():
    return htmltext.trained()


CASES = {
    "<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>Title here</h1><p>First  paragraph &amp; more text in it.</p><p>Second one,\nwith a break<br>inside.</p>"
    "</article><footer>&copy; site &middot; words at the foot.</footer></body></html>": "Title here First paragraph & more text in it. Second one, with a break inside.",
    "<div class=menu><a href=/x>One</a> | <a href=/y>Two</a></div><div class=content><p>Only this sentence is the article, and it is long enough.<p>And this one follows it, unclosed.</div>"
    "<div id=comments><h3>Comments</h3><div class=comment><p>I liked it a lot, thank you for writing.</p></div></div>": "Only this sentence is the article, and it is long enough. And this one follows it, unclosed.",
    "<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><main><p>Real text stands here, with some words.</p><div class=ad>Buy now, cheap things for you.</div><p>More real text stands here too.</p></main>": "Real text stands here, with some words. More real text stands here too.",
    "": "",
}


@pytest.mark.parametrize("source", CASES)
def test_main_text(model, source):
    assert htmltext.main_texts([source], model) == [CASES[source]]


def test_extract_table(spark, model):
    rows = [(i, "u", h) for i, h in enumerate(CASES)] + [(90, None, None), (None, "u", "<p"), (0, "u", next(iter(CASES)))]
    found = htmltext.extract(pages(spark, rows), model).collect()
    assert len(found) == len(rows)
    assert {r["page_id"]: r["text"] for r in found}[0] == next(iter(CASES.values()))
    assert all(r["n_chars"] == len(r["text"]) for r in found) and {r["page_id"]: r["text"] for r in found}[90] == ""
    assert htmltext.extract(pages(spark, []), model).count() == 0


def test_decoding_never_contradicts_itself(model):
    draw = random.Random(3)
    for _ in range(20):
        page = htmltext.parse(htmltext.training_page(draw))
        margin = np.random.default_rng(1).normal(size=len(page.tag))
        kept = htmltext.decode(page, margin)
        runs = [i for i, t in enumerate(page.tag) if t == "#"]
        total = lambda states: sum(s * m for s, m in zip(states, margin))
        assert len(kept) <= len(runs)
        assert htmltext.decode(page, np.ones(len(page.tag))) == [page.text[i] for i in runs]
        assert htmltext.decode(page, -np.ones(len(page.tag))) == [] and total([0] * len(margin)) == 0


def test_real_template(spark, sf_dir, model):
    import html
    import re

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for r, text in zip(rows, htmltext.main_texts([r["html"] for r in rows], model)):
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        assert text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_held_out_pages(model):
    draw, right, all_ = random.Random(99), 0, 0
    for _ in range(60):
        page = htmltext.parse(htmltext.training_page(draw), marks=True)
        truth = htmltext.labelled_nodes(page)
        kept = htmltext.decode(page, model.margins([page])[0])
        for i, tag in enumerate(page.tag):
            if tag == "#" and truth[i] >= 0:
                all_ += len(page.text[i])
                right += len(page.text[i]) * ((page.text[i] in kept) == bool(truth[i]))
    assert right / all_ > 0.93


def prose(d, low, high):
    w = "the of river market people garden winter letter stone morning window village story paper number early light house water green under after never often".split()
    out = []
    for _ in range(d.randint(low, high)):
        x = [d.choice(w) for _ in range(d.randint(5, 18))]
        out.append(" ".join(x).capitalize() + ".")
    return " ".join(out)


def layout(d, kind):
    """Layouts of common publishing software, written apart from the training pages: (html, main text)."""
    title = prose(d, 1, 1)[:-1]
    paras = [prose(d, 1, d.choice([2, 4, 7])) for _ in range(d.choice([1, 2, 4, 9, 25, 50]))]
    inner = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paras)
    text = " ".join([title, *paras])
    links = "".join(f'<li class="menu-item"><a href="/{i}">{d.choice(["Home", "About us", "News", "Contact", "Shop", "Archive"])}</a></li>' for i in range(d.randint(3, 9)))
    note = prose(d, 1, 2)
    if kind == 0:
        cls = d.choice(["post type-post status-publish format-standard hentry category-news tag-more", "post tag-news", "post hentry tag-news category-more", "content more", "entry meta-box"])
        return f'<html><body class="single single-post has-sidebar comments-open"><header class="site-header"><div class="site-title"><a href="/">{title[:9]}</a></div><nav class="main-navigation"><ul class="menu">{links}</ul></nav></header><div class="site-content"><{"article" if d.random() < .5 else "div"} class="{cls}">{inner}</article></div><div id="comments" class="comments-area"><h2>Responses</h2><ol class="comment-list"><li class="comment"><p>{note}</p></li><li class="comment"><p>{prose(d, 1, 4)}</p></li></ol></div></div><aside class="widget-area sidebar"><section class="widget"><h3>Recent</h3><ul>{links}</ul></section></aside><footer class="site-footer">&copy; {title[:12]} All rights reserved.</footer></body></html>', text
    if kind == 1:
        return f'<body><nav class="navbar navbar-expand-lg"><ul class="navbar-nav">{links}</ul></nav><div class="container"><div class="row"><div class="c7 col-md-9">{inner}</div><div class="col-md-3 sidebar"><h4>Links</h4><ul>{links}</ul></div></div></div><div class="footer"><p>Copyright 2020 {title[:10]}.</p></div></body>', text
    if kind == 2:
        return f'<body><div id=top><ul>{links}</ul></div><div class=c7>{inner}</div><div class="cookie-banner"><p>{note}</p><button>OK</button></div><footer><p>{prose(d, 1, 1)}</p></footer></body>', text
    if kind == 3:
        return f'<body><main>{inner}</main></body>', text
    if kind == 4:
        return f'<!doctype html><html><head><title>x</title></head><body><div class="wrapper"><div class="masthead"><a href=/>Site</a></div><div class="topnav"><a href=/1>One</a><a href=/2>Two</a><a href=/3>Three</a></div><div class="story"><h1>{title}</h1>' + "".join(f"<p>{p}</p>" + ('<div class="advertisement"><p>Buy this now, only today.</p></div>' if i == 1 else "") for i, p in enumerate(paras)) + f'</div><div class="related-posts"><h3>More</h3><ul>{links}</ul></div><div class="newsletter-signup"><p>{note}</p><form><input><button>Go</button></form></div><div id="footer">{prose(d, 1, 1)}</div></div></body></html>', text
    return f'<body><header><h1>Site name</h1><p>A slogan of the site</p></header><nav><a href=/>a</a> | <a href=/b>b</a></nav><section class="section"><article><header><h1>{title}</h1></header>' + "".join(f"<p>{p}</p>" for p in paras) + f'</article></section><section class="comments"><h3>Comments</h3><div class="comment"><p>{note}</p></div></section><footer><small>Made by us</small></footer></body>', text


@pytest.mark.parametrize("kind", range(6))
def test_layouts_of_other_hands(model, kind):
    draw, both, found, wanted = random.Random(4), 0, 0, 0
    for _ in range(40):
        source, text = layout(draw, kind)
        got, text = Counter(htmltext.main_texts([source], model)[0].split()), Counter(text.split())
        both, found, wanted = both + (got & text).total(), found + got.total(), wanted + text.total()
    assert 2 * both / (found + wanted) > 0.985


@pytest.mark.parametrize("name", ["post", "post tag-news", "post hentry tag-news category-more", "content more", "entry meta-box", "c7"])
@pytest.mark.parametrize("paragraphs", [9, 50])
def test_names_that_speak_of_other_things(model, name, paragraphs):
    words = [f"This is the clear paragraph number {i} of the text, with words." for i in range(paragraphs)]
    for tag in ("article", "div"):
        source = (f'<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><{tag} class="{name}"><h1>Headline of it</h1>' + "".join(f"<p>{w}</p>" for w in words)
                  + f"</{tag}><footer>&copy; site words at the foot.</footer></body></html>")
        assert htmltext.main_texts([source], model) == [" ".join(["Headline of it", *words])]


#: Names whose first word, or all words, speak of what surrounds a text.
MISLEADING = ["widget-area main", "widget-content", "footer-less sidebar", "footer-content", "header-fixed article", "menu-open main", "banner-page", "comment-open post", "nav-page", "share-box text", "sidebar-right content",
              "ad-free", "notice-open", "comments-closed entry", "related-post", "popup-wrap", "search-result", "promo-page", "newsletter-issue", "cookie-page", "form-page"]


@pytest.mark.parametrize("tag", ["article", "div", "main", "section"])
def test_no_article_is_lost_to_its_name(model, tag):
    words = [f"This is the clear paragraph number {i} of the text, with words." for i in range(9)]
    page = ("<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><{0} class=\"{1}\"><h1>Headline of it</h1>" + "".join(f"<p>{w}</p>" for w in words)
            + "</{0}><footer>&copy; site words at the foot.</footer></body></html>")
    wanted = " ".join(["Headline of it", *words])
    assert {n: t for n, t in zip(MISLEADING, htmltext.main_texts([page.format(tag, n) for n in MISLEADING], model)) if t != wanted} == {}


def test_marks_of_training_pages_are_not_read(model):
    page = "<body><nav data-truth=1><a href=/>Home</a> <a href=/x>News</a></nav><article{}><h1>Title of it</h1><p>Some words of the text, and more of them.</p><p>The second one, with words.</p></article></body>"
    marks = ["", " data-truth", ' data-truth=""', ' data-truth="x"', " data-truth=0", ' DATA-TRUTH="99999999999999999999"', " data-truth='-1' hidden2"]
    assert len(set(htmltext.main_texts([page.format(m) for m in marks], model))) == 1
    assert htmltext.parse("<p data-truth=x>a").truth == [-1, -1, -1] and htmltext.parse("<p data-truth=0>a", marks=True).truth == [-1, 0, -1]


def test_pages_judged_together_are_judged_alone(spark, model, monkeypatch):
    sources = [layout(random.Random(i), i % 6)[0] for i in range(30)] + ["", "<p>x", "&amp;", "<div>" * 300 + "x", "\ud800".encode("utf-8", "surrogatepass").decode("utf-8", "replace")]
    together = htmltext.main_texts(sources, model)
    assert together == [t for s in sources for t in htmltext.main_texts([s], model)]
    monkeypatch.setattr(htmltext, "TURN", 1000)
    monkeypatch.setattr(htmltext, "NODES", 50)
    rows = [(i, "u", s) for i, s in enumerate(sources)]
    assert [r["text"] for r in htmltext.extract(pages(spark, rows), model).orderBy("page_id").collect()] == together
    assert htmltext.main_texts([], model) == []


def test_a_page_of_five_megabytes(model):
    line = "<div><p>Words of a long page, one after the other.</p><ul><li>and an item</li></ul></div>"
    source = "<nav><a href=/>Home</a></nav><article>" + line * (5_000_000 // len(line)) + "</article>"
    began = time.time()
    (text,) = htmltext.main_texts([source], model)
    assert text.startswith("Words of a long page") and len(text) > 2_500_000 and time.time() - began < 60


def test_odd_markup(model):
    assert htmltext.main_texts(["<main><h1>Title</h1><p>Short.</p></main>", "<article><p>Then <math><mi>E</mi>=<mi>m</mi></math> follows.</p></article>"], model) == ["Title Short.", "Then E=m follows."]
    words = "long text with <object>words</object> in it, and more; " * 40_000
    (text,) = htmltext.main_texts([f"<article><p>{words}</p></article>"], model)
    assert text == " ".join(("long text with words in it, and more; " * 40_000).split())
    began = time.time()
    for source in ("<div>" * 40_000, "</div>" * 100_000, "<blockquote>" * 20_000 + "<li>" * 2000, "<td><p>" * 10_000, "<!--" * 9, "<svg><a><math>x"):
        htmltext.main_texts([source], model)
    assert time.time() - began < 20


# ---- archives

HTML = [(1, "http://a.example.com/x?y=1#z", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://b.example.com/\r\nX: y", "ü € \r\n\r\nWARC/1.1\r\n\r\n"), (4, "http://a.example.com/x", None), (5, "HTTP://WWW.Example.ORG/Q", ""),
        (2, "http://a.example.com/again", "<p>same</p>"), (6, "u", "x" * 200_000), (None, "http://n.example.com/", "<p>other</p>")]


def test_archives_round_trip(spark):
    found = warc.archive_and_index(pages(spark, HTML)).collect()
    assert len(found) == len(HTML)
    expected = []
    for i, _, h in HTML:
        payload = (h or "").encode()
        largest = max((j for j, _, g in HTML if (g or "") == (h or "") and j is not None), default=None)
        revisit = largest is not None and i != largest
        expected.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", largest if revisit else None))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(expected, key=str)
    keys = [(r["url_key"], r["captured"]) for r in found]
    assert keys == sorted(keys)
    assert next(r for r in found if r["page_id"] == 5)["url_key"] == "org,example,www)/q"
    assert warc.archive_and_index(pages(spark, [])).count() == 0


def test_large_pages_have_archives_of_their_own(spark, tmp_path):
    rows = [(i, f"http://a.com/{i}", ("x" * (3_000_000 if i % 4 == 0 else 100)) + str(i % 8)) for i in range(24)]
    path = str(tmp_path / "archives")
    warc.write_archives(pages(spark, rows).coalesce(1), path, per_archive=50, archive_bytes=8_000_000, compression="none")
    sizes = sorted(f.stat().st_size for f in (tmp_path / "archives").glob("part-*"))
    assert sizes[-1] < 10_000_000 and len(sizes) >= 3
    found = warc.merged_index(warc.read_archives(spark, path)).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in found) == [(i, len(h)) for i, _, h in rows]
    assert sum(r["record_type"] == "response" for r in found) == 8


def test_small_payloads_stay_responses(spark):
    found = {(r["page_id"], r["record_type"]) for r in warc.archive_and_index(pages(spark, HTML[:2]), least=100).collect()}
    assert found == {(1, "response"), (2, "response")}


def test_plain_archive_is_valid_warc(spark, tmp_path):
    path = str(tmp_path / "plain")
    warc.write_archives(pages(spark, HTML[:1]).coalesce(1), path, compression="none")
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "plain").glob("part-*")))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"<p>same</p>\r\n\r\n")
    broken = data.replace(b"<p>same</p>", b"<p>Same</p>")
    with pytest.raises(ValueError, match="digest"):
        warc.parse_archive(broken, "x")


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7, 16])
def test_loser_tree(runs):
    draw = random.Random(runs)
    parts = [sorted(((None if draw.random() < 0.1 else draw.randint(0, 9), 0, "", "", None, "", draw.choice("abc"), draw.choice("12"), f"r{i}", j, 0) for j in range(draw.randint(0, 30))), key=warc.sort_key) for i in range(runs)]
    assert list(warc.LoserTree([iter(p) for p in parts])) == sorted(sum(parts, []), key=warc.sort_key)


# ---- urls

URLS = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"), ("http://x.EXAMPLE.org/es/1?q#f", "x.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/19", "example.org", "/en/19", "example.org/en/1", "block"),
    ("http://example.org/en/29", "example.org", "/en/29", "org/", "allow"), ("https://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"), ("https://b.com/de/#x", "b.com", "/de/", "com/de/", "block"), ("http://notorg/", "notorg", "/", None, None),
    ("http://a.org", "a.org", "", None, None), ("http://a.org?x=/", "a.org", "", None, None), (None, "", "", None, None), ("no scheme", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("", "", "", None, None)]


def test_rules(spark):
    rows = [(i, u[0], None) for i, u in enumerate(URLS)] + [(i, f"http://h{i}.com/{'de' if i % 2 else 'fr'}/{'9' * (i % 2 * 9)}", None) for i in range(100, 200)]
    found = {r["page_id"]: r for r in urlfilter.judge(pages(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
    assert {r["verdict"] for r in urlfilter.judge(pages(spark, [(1, "http://q.net/", None), (1, "http://q.net/", None)])).collect()} == {"allow"}
    assert urlfilter.judge(pages(spark, [])).count() == 0


def test_hosts_paths_and_rules_match_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    fits = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(rules, key=lambda r: -len(r[0] + r[1]))) + " END"
    db = duckdb.connect()
    db.execute("CREATE TABLE p AS SELECT page_id, url FROM '" + sf_dir + "/pages.parquet'")
    db.executemany("INSERT INTO p VALUES (?, ?)", [(10_000 + i, u[0]) for i, u in enumerate(URLS)])
    theirs = db.execute(f"""WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM p),
        b AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM a),
        c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM b)
        SELECT page_id, coalesce(host, ''), coalesce(path, ''), {fits} FROM c""").fetchall()
    table = spark.createDataFrame([(i, u, "") for i, u in db.execute("SELECT page_id, url FROM p").fetchall()], "page_id long, url string, html string")
    ours = urlfilter.judge(table).collect()
    assert sorted(tuple(r)[:4] for r in ours) == sorted(theirs)
    verdict = {f"{h}{p}": v for h, p, v in rules}
    assert all(r["verdict"] == verdict.get(r["rule"], r["verdict"]) for r in ours)


def test_trees_as_columns_match_numpy(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 3)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = gbt.fit(x, y, trees=20, depth=3)
    assert (((m.margin(x) > 0) == y).mean()) > 0.95
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    got = {r["i"]: r["m"] for r in df.select("i", m.column([F.col("a"), F.col("b"), F.col("c")]).alias("m")).collect()}
    assert np.allclose([got[i] for i in range(len(x))], m.margin(x))
    assert gbt.fit(x, np.zeros(len(x))).trees == []


def test_entropy(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("aabb",), ("aaaa",), ("",), ("abcd",)], "u string").select(urlfilter.entropy(F.col("u")).alias("e")).collect()
    assert [round(r["e"], 6) for r in rows] == [1.0, 0.0, 0.0, 2.0]
