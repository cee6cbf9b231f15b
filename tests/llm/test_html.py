"""Template deduction: by hand-made hosts, against a brute-force deduction on lists, and on edge cases."""

import random
from collections import Counter, defaultdict

import pytest

from quadrille.llm import html_text
from quadrille.llm.html_text import Page, main_text, template_of

PAGES = "page_id long, url string, html string"


def words(i, n=30):
    return " ".join(f"w{i}x{k}" for k in range(n))


def texts(spark, pages):
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, PAGES)).collect()}


def alone(page):
    """The text of a page that is alone on its host."""
    return main_text(Page(page), template_of(0, None))


def test_page():
    page = '<html><head><title>t</title></head><body><nav>m</nav><article><h1>T &amp; U</h1><p>a&nbsp;b<br>c<p>d <i>e</i>f<script>"<p>x"</script><div class="comments">no</div></article><footer>f'
    assert alone(page) == "T & U\n\na b c\n\nd ef"
    assert alone('<p>un<clo') == "un" and alone('<div class=menu>m</div><div>x</div>') == "x" and alone("") == alone("<nav>only a menu</nav>") == ""
    assert alone(f'<nav>menu<article><p>{words(1)}</p></article>') == words(1)  # the menu is never closed
    assert alone(f'<aside><article>teaser</article></aside><article><p>{words(1)}</p></article>') == words(1)
    assert alone('<p>a <span class="ad">buy</span>b</p><p hidden>c</p>') == "a b"


@pytest.mark.parametrize("mark", ["social-science", "search-results-article", "ad-free story", "post comments-open", "content no-sidebar", "page has-comments"])
def test_words_inside_class_names_decide_nothing(mark):
    body = f"<h1>T</h1><p>{words(1)}</p>"
    for page in (f'<body class="right-sidebar"><article class="{mark}">{body}</article></body>', f'<body><main class="{mark}">{body}</main></body>', f'<body><div class="{mark}">{body}</div></body>'):
        assert alone(page) == f"T\n\n{words(1)}"


def test_side_elements():
    for mark in ("comment-list", "ad", "cookie-banner", "site-nav", "share-buttons", "comments", "related-posts", "comment-17"):
        assert alone(f'<div><h1>T</h1><p>{words(1)}</p></div><div class="{mark}"><p>{words(2, 9)}</p></div>') == f"T\n\n{words(1)}"
    assert alone(f'<form><div><h1>T</h1><p>{words(1)}</p></div></form>') == f"T\n\n{words(1)}"  # a form around the page
    menu = "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(5))
    assert alone(f"<ul>{menu}</ul><div><p>{words(1)}</p></div>") == words(1)
    assert "Topic 3" in alone(f"<article><p>{words(1)}</p><ul>{menu}</ul></article>")


def test_template_decides(spark):
    """Pages in plain divs, with an identical side column, and one article page; teasers; repeated texts; copies."""
    def page(body):
        return f'<body><div id="top">Home About</div><div id="text">{body}</div><div id="side"><p>About us</p><p>We are here</p></div><div id="end">Imprint</div></body>'

    mixed = [(i, f"http://mixed.org/{i}", page(f"<p>{words(i)}</p>")) for i in range(12)] + [(12, "http://mixed.org/12", page(f"<article><p>{words(12)}</p></article>"))]
    teaser = [(20 + i, f"http://teaser.org/{i}", f'<body><div id="text"><p>{words(20 + i)}</p></div><article>more t{i}</article></body>') for i in range(5)]
    marked = [(30 + i, f"http://marked.org/{i}", f"<body><article><p>{words(30 + i)}</p><p>Read our rules</p></article></body>") for i in range(5)]
    copies = [(40 + i, "http://copies.org/", f"<body><article><p>{words(40)}</p></article></body>") for i in range(5)]
    wrapped = [(50 + i, f"http://wrapped.org/{i}", f'<body><div class="widget"><p>{words(50 + i)}</p></div><div class="ad">buy {i}</div></body>') for i in range(5)]
    every = mixed + teaser + marked + copies + wrapped
    assert texts(spark, every) == {i: words(min(i, 40) if i < 50 else i) for i, _, _ in every}


def hosts_with_separators(own_vector):
    """A separator that most pages hold, either as often as an element (a record's label) or at its own rate."""
    out = []
    for i in range(12):
        records = 1 + i % 4
        if own_vector:
            body = "".join(f"<p>{words(100 * i + k)}</p>" for k in range(records)) + "<p>* * *</p>" * (i % 3 + (i % 5 > 0))
        else:
            body = "".join(f'<section><p>{words(100 * i + k)}</p><div class="label">* * *</div></section>' for k in range(records))
        out.append((i, f"http://h{int(own_vector)}.org/{i}", f'<body><div id="top">Home</div><div id="text">{body}</div></body>'))
    return out


def test_vectors_decide(spark):
    """A text is template if it has the vector of an element of its class, not because most pages hold it."""
    kept, gone = texts(spark, hosts_with_separators(True)), texts(spark, hosts_with_separators(False))
    assert [t.count("* * *") for _, t in sorted(kept.items())] == [i % 3 + (i % 5 > 0) for i in range(12)]
    assert not any("* * *" in t for t in gone.values()) and all(words(100 * i) in t for i, t in gone.items())


def test_classes_out_of_order_are_no_template(spark):
    """Two boxes whose tokens share a vector but change places: no class in order, so nothing of them is template."""
    pages = []
    for i in range(10):
        boxes = ["<h2>First</h2>", "<h3>Second</h3>"]
        pages.append((i, f"http://o.org/{i}", f"<div>{''.join(boxes if i % 2 else boxes[::-1])}<p>{words(i)}</p></div>"))
    assert all("First" in t and "Second" in t for t in texts(spark, pages).values())


def brute(pages):
    """Template texts and main slot of one host by vectors as lists, for classes in order on all pages."""
    parsed = [Page(h) for h in pages]
    vectors, text = defaultdict(lambda: [0] * len(pages)), {}
    for i, p in enumerate(parsed):
        for path in p.path[1:]:
            vectors[path][i] += 1
            text[path] = False
        for e, t, _ in p.texts:
            token = html_text.text_token(p.path[e], t)
            vectors[token][i] += 1
            text[token] = True
    groups = defaultdict(list)
    for token, v in vectors.items():
        if sum(x > 0 for x in v) >= max(html_text.LEAST_PAGES, html_text.SUPPORT * len(pages)):
            groups[tuple(v)].append(token)
    return {t for own in groups.values() if sum(1 if text[x] else 2 for x in own) >= html_text.LARGE and not all(text[x] for x in own) for t in own if text[t]}


def test_against_brute_force(spark):
    random.seed(6)
    pages = []
    for i in range(20):
        promo = '<div id="promo"><b>Offer</b><p>Only today</p></div>' if random.random() < 0.8 else ""
        items = "".join(f'<li><p>{words(1000 * i + k, 5)}</p><div>More</div></li>' for k in range(random.randint(1, 6)))
        pages.append(f'<body><div id="top"><p>Home</p></div>{promo}<div id="text"><p>{words(i)}</p><ul>{items}</ul></div><div id="end">Imprint {i % 2}</div></body>')
    got = html_text.templates(spark.createDataFrame([(i, "http://b.org/", h) for i, h in enumerate(pages)], PAGES)).collect()
    known = template_of(1, got[0]["template"])
    assert known["repeated"] == brute(pages) and len(known["repeated"]) == 4
    assert known["container"] == Page(pages[0]).path[next(e for e, s in enumerate(Page(pages[0]).path) if s == html_text.path_token(html_text.path_token(0, "body"), "div.text"))]


def test_edges(spark):
    """Nulls, empty, repeated rows, a very long page, deep nesting, a column named host, no rows."""
    long = "".join(f"<p>{words(i, 12)}</p>" for i in range(20_000))
    deep = "<div>" * 20_000 + f"<p>{words(5)}</p>" + "<p>tail</p>"
    pages = [(1, None, None, 1), (2, "u", "", 1), (3, "http://r.org/", "<p>same</p>", 1), (3, "http://r.org/", "<p>same</p>", 1), (None, "http://r.org/", "<p>no id</p>", 1),
             (4, "http://l.org/", f"<body>{long}</body>", 1), (5, "http://d.org/", deep, 1)]
    df = spark.createDataFrame(pages, f"{PAGES}, host int")
    got = html_text.extract(df).collect()
    assert Counter((r["page_id"], r["text"]) for r in got if r["page_id"] != 4) == Counter([(1, ""), (2, ""), (3, "same"), (3, "same"), (None, "no id"), (5, f"{words(5)}\n\ntail")])
    own = next(r for r in got if r["page_id"] == 4)
    assert own["text"] == "\n\n".join(words(i, 12) for i in range(20_000)) and own["n_chars"] == len(own["text"])
    assert html_text.extract(df.limit(0)).count() == 0


def test_query_keeps_articles_only(spark):
    """On the test pages the text is that of the article, whatever else stands around it."""
    import re

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.query(spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)
        if article:
            assert r["text"] == alone(article[0])
