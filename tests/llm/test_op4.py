import html as H
import re

from cartosea.llm.html_text import extract, extract_text

LONG = "Some long sentence of the article that goes on and on, with commas &amp; more."


def test_article_among_boilerplate():
    page = f"""<!DOCTYPE html><html><head><title>x</title><script>if(a<b){{"</p>"}}</script></head><body class="home">
    <header><a href=/>Home</a></header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
    <div class="cookie-notice">We use cookies.</div><div id=main><h1>Title</h1>
    <p>{LONG}<p>Second   {LONG} <a href=x>link</a><br>after &lt;b&gt;<ul><li>one<li>two</ul>
    <div class="ad">Buy!</div><section id="comments"><p>{LONG}{LONG}</p></section></div>
    <aside>{LONG}</aside><form><p>mail</p></form><footer>&copy; me</footer></body>"""
    t = H.unescape(LONG)
    assert extract(page) == f"Title\n{t}\nSecond {t} link\nafter <b>\none\ntwo"


def test_degenerate():
    assert extract(None) == extract("") == extract("<p>") == extract("<!-- x") == extract("<script>a") == ""
    assert extract("plain &eacute;  text") == "plain é text"
    assert extract("<p>a<b>c</b>d</p><div>e") == "acd\ne"
    assert extract("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert extract("<div>" * 3000 + "deep") == "deep"


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        want[r["page_id"]] = "\n".join(x for x in parts if x)
    got = {r["page_id"]: r for r in extract_text(pages).collect()}
    assert {k: v["text"] for k, v in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract_text(spark.createDataFrame([(1, "u", None, "t")], "page_id long, url string, html string, text string")).first()["text"] == ""


def test_article_split_over_siblings():
    part = lambda c, n: f"<section><h2>Part {c}</h2>" + "".join(f"<p>{c}{i} {LONG}</p>" for i in range(n)) + "</section>"
    want = lambda c, n: [f"Part {c}", *[f"{c}{i} {H.unescape(LONG)}" for i in range(n)]]
    links = "<div>" + "".join(f"<a href={i}>Go {i}</a> " for i in range(40)) + "</div>"
    page = f"<body>{links}<div>{part('a', 20)}{part('b', 20)}</div>{links}</body>"
    assert extract(page).split("\n") == want("a", 20) + want("b", 20)
    page = f"<body>{links}<div>{part('a', 12)}{links}{part('b', 20)}</div><div><h3>More</h3><div>{part('c', 15)}</div></div></body>"
    assert extract(page).split("\n") == want("a", 12) + want("b", 20) + ["More"] + want("c", 15)


def test_names_of_states_and_topics():
    body, t = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>", H.unescape(LONG)
    wraps = ["main class='has-sidebar'", "div id='content' class='no-sidebar'", "article class='post category-social'", "article class='post comments-open'"]
    wraps += ["div class='notice-board'", "div class='related-yes'", "main class=sidebar", "article id=hidden-nav class=widget", "div class='sidebar-right'", "div class=widget"]
    for w in wraps:
        page = f"<body><div class=cookie-notice>We use cookies.</div><{w}>{body}</{w.split()[0]}><div class='site-footer'>{LONG}</div></body>"
        assert extract(page) == f"Title\n{t}\n{t}", w


def test_names_of_furniture():
    for name in ("sidebar", "ad", "ad-1", "ads2", "post-comments", "comment_list", "share-buttons", "related-posts", "side-bar", "x main-nav", "site__footer", "cookie-consent-banner"):
        for attribute in ("class", "id"):
            assert extract(f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div {attribute}='{name}'><p>{LONG}</p></div></body>") == "\n".join([H.unescape(LONG)] * 2), name
    assert extract(f"<body><div><p>{LONG}</p></div><div id=comments>{f'<p>{LONG}</p>' * 4}</div></body>") == H.unescape(LONG)


def test_without_article_or_main():
    t, links = H.unescape(LONG), "".join(f"<li><a href={i}>Go {i}</a></li>" for i in range(30))
    paras = "".join(f"<p>{c} {LONG} <i>and</i> {LONG}</p>" for c in "abc")
    want = "\n".join(f"{c} {t} and {t}" for c in "abc")
    page = f"<body><div><ul>{links}</ul></div><table><tr><td>{paras}</td><td><div>short</div><div>bits</div><ul>{links}</ul></td></tr></table></body>"
    assert extract(page) == want
    # an article element wins by its densities or not at all
    page = f"<body><div><h2>Story</h2>{paras}</div><article><ul>{links}</ul></article></body>"
    assert extract(page) == "Story\n" + want


def test_names_and_headers_inside_the_text():
    t = H.unescape(LONG)
    assert extract(f'<body><div class="post hidden-xs"><p>{LONG}</p></div></body>') == t
    assert extract(f"<body><div><header><h1>Title</h1></header><p>{LONG}</p><p>{LONG}</p></div></body>") == f"Title\n{t}\n{t}"
    assert extract(f"<body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div><p>{LONG}</p><p>{LONG}</p></div></body>") == f"{t}\n{t}"
    assert extract(f"<body><div><header><h1>Site</h1><nav>x</nav></header><div><p>{LONG}</p><p>{LONG}</p></div></div></body>") == f"{t}\n{t}"
    for inner in ('section class="related-work"', "section role=note", "div class=menu-of-the-day", "section class=share-prices"):
        page = f"<body><article><h1>T</h1><p>{LONG}</p><{inner}><p>more {LONG}</p></{inner.split()[0]}><p>x<math><mi>y</mi></math></p></article></body>"
        assert extract(page) == f"T\n{t}\nmore {t}\nxy", inner


def test_ties_and_hostile_pages():
    import time

    t = H.unescape(LONG)
    half = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    assert extract(f"<body>{half}{half}</body>") == "\n".join([t] * 4)
    n, began = 100_000, time.time()
    for page, want in (("<b>" * n + "deep", "deep"), ("<div>" * n + "deep", "deep"), ("<b>" * n + "</i>" * n + "x", "x"), ("<b>" * n + "<hr>" * n + "x", "x"), ('<a "' * n, ""), ("<p>x</p>" + "<li>" * n, "x"), ("<a " + "b" * n + ">x", "x")):
        assert extract(page) == want
    assert time.time() - began < 120  # quadratic steps would take hours


def test_tables_empty_repeated_and_clashing(spark):
    schema = "page_id long, url string, html string, text string, _html string, n_chars string, _c0 int"
    assert extract_text(spark.createDataFrame([], schema)).count() == 0
    page = f"<p>{LONG}</p>"
    rows = extract_text(spark.createDataFrame([(None, None, page, "a", "b", "c", 7)] * 3 + [(1, "u", "<p>" + "long " * 400_000, "a", "b", "c", 7)], schema)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"], r["_html"], r["_c0"]) for r in rows) == [(0, len(H.unescape(LONG)), "b", 7)] * 3 + [(1, 1_999_999, "b", 7)]


def test_short_lines_of_the_article_stay():
    t = H.unescape(LONG)
    part = lambda c: f"<section><h2>Part {c}</h2>" + "".join(f"<p>{c}{i} {LONG} {LONG}</p>" for i in range(5)) + "</section>"
    links = "<div><ul>" + "".join(f"<li><a href={i}>Go {i}</a></li>" for i in range(30)) + "</ul></div>"
    head, tail = "<header><h1>Title</h1><p>By A. N. Other</p></header>", "<ul><li>one</li><li>two</li></ul><p>End.</p>"
    page = f"<body>{links}<div><div>{head}{part('a')}{part('b')}{tail}</div></div>{links}</body>"
    lines = lambda c: [f"Part {c}", *[f"{c}{i} {t} {t}" for i in range(5)]]
    assert extract(page).split("\n") == ["Title", "By A. N. Other", *lines("a"), *lines("b"), "one", "two", "End."]
