import random

import pytest

from lakeprofile.llm import html_extraction as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h2>Site</h2></header>
<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><div class="sidebar">side</div>
<main><article class="post-12"><header><h1>T &amp; x</h1></header><p>one <b>two</b>
 three&nbsp;&eacute;<p>four<ul><li>a<li>b</ul><div class="ad">buy</div><form>f<input></form><br>tail
<section class="comments"><p>nice</p></section></article></main><aside>more</aside>
<script>var a="</p>"</script><!-- note --><footer>&copy; me</footer></body></html>"""
TEXT = "T & x\none two three é\nfour\na\nb\ntail"


def test_main_text():
    assert H.extracted(PAGE, None) == TEXT
    assert H.extracted(PAGE, "/html/body/main/article.post-N") == TEXT
    assert H.extracted(PAGE, "/html/body/div.elsewhere") == TEXT  # the page's own best container


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt; text", "plain < text"),
        ("<p", ""),
        ("<!-- open", ""),
        ("<p>a<p>b</div></p>c", "a\nb\nc"),
        ("<div>" * 3000 + "x" + "</div>" * 10, "x"),
        ('<p title="a > b">c', "c"),
        ("<script>x", ""),
        ("<b>a<br>b</b>", "a\nb"),
        ("&#x41;&bogus; 1 < 2", "A&bogus; 1 < 2"),
    ],
)
def test_odd_pages(html, text):
    assert H.extracted(html, None) == text


def test_long_pages_are_linear():
    assert len(H.extracted("<div><p>word " * 20_000, None)) > 80_000


def site(n, body):
    return [(f"http://Site.example/{i}", f"<html><body>{body(i)}</body></html>") for i in range(n)]


@pytest.mark.parametrize("broadcast", [50_000, 1])
def test_a_host_votes(spark, broadcast):
    long, short = "words and words " * 20, "few"
    # On the last page the comments are longer than the text; the other pages outvote it.
    pages = site(8, lambda i: f'<div class="entry-{i}"><p>{long if i < 7 else short}</p></div><div class="thread"><p>{"talk " * 60 if i == 7 else "talk"}</p></div>')
    pages += [("https://other.example/", "<div><p>other text</p></div>"), (None, "<p>no host</p>"), (None, None), ("x", "")]
    pages += pages[:1]
    rows = [(i, u, h, "kept", 1) for i, (u, h) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path int")
    out = H.extract_pages(df, broadcast_hosts=broadcast)
    assert out.columns == ["page_id", "url", "html", "host", "path", "text"] or set(out.columns) == {*df.columns, "text"}
    text = {r.page_id: r.text for r in out.collect()}
    assert len(text) == len(rows) and all(r.host == "kept" for r in out.select("host").collect())
    assert text[7] == short and text[0] == text[12] == " ".join(long.split())
    assert text[8] == "other text" and text[9] == "no host" and text[10] == text[11] == ""
    best = {r.host: r.path for r in H.host_paths(df).collect()}
    assert best["site.example"] == "/html/body/div.entry-N"


def test_empty_table(spark):
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


STORY = "<p>" + "The long story of the day, told at length. " * 8 + "</p>"
SIDE = '<div class="sidebar"><p>side</p></div>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="content-sidebar-wrap"><article><p>few words</p></article>%s</div><p>about this site and its owners</p>', "few words"),
        ('<div id="page" class="has-sidebar"><main><p>few words</p></main>%s</div>', "few words"),
        ('<div class="with-comments"><div class="top"><h1>T</h1><p>few words</p></div>%s</div><p>all rights are reserved by us</p>', "T\nfew words"),
        (f'<form id="aspnetForm"><div class="body">{STORY}</div>%s<form><input>find</form></form>', None),
        (f'<div id="page" class="has-sidebar"><form><fieldset><div>{STORY}</div></fieldset></form>%s</div>', None),
    ],
)
def test_wrappers_keep_their_text(page, text):
    found = H.extracted(f"<html><body>{page % SIDE}</body></html>", None)
    assert (text or "story of the day") in found and "side" not in found


def test_no_page_is_left_without_text():
    page = f'<div class="content-sidebar">{STORY}</div><div class="share-wrap">{STORY}</div>{SIDE}'
    assert H.extracted(f"<html><body>{page}</body></html>", None).count("story") == 16


def test_marked_parts_stay_out():
    comments = '<div class="comments"><article class="comment-body"><p>nice</p></article></div>'
    page = f'<html><body><div class="has-sidebar"><main><h1>T</h1>{STORY}{comments}<form>ask</form></main>{SIDE}</div></body></html>'
    assert H.extracted(page, "/html/body") == "T\n" + STORY[3:-4].strip()


def test_a_host_of_wrapper_pages_votes(spark):
    pages = site(4, lambda i: f'<div class="page with-comments"><div class="entry">{STORY}</div>{SIDE}</div>')
    df = spark.createDataFrame(pages, "url string, html string")
    assert {r.text for r in H.extract_pages(df).collect()} == {STORY[3:-4].strip()}


LEAD, TAIL = "The lead says what it is about.", "And this is the last line."
PRICE = "The share price fell, and the law on promotions did not help."
TALK = "<p>" + "What we found is discussed here. " * 4 + "</p>"
FOUND = TALK[3:-4].strip()
MENU = '<ul class="menu"><li><a href="/">Home</a></li></ul>'


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f'<article><h1>T</h1><p class="lead">{LEAD}</p><div class="body">{STORY}</div><p>{TAIL}</p></article>', f"T\n{LEAD}\n%s\n{TAIL}"),
        (f'<main><h1>T</h1><section class="intro">{STORY}</section><section class="discussion">{TALK}</section></main>', f"T\n%s\n{FOUND}"),
        (f"<div><section>{STORY}</section><section>{TALK}</section></div>", f"%s\n{FOUND}"),
        (f'<div><section class="a">{STORY}</section><section class="b">{TALK}</section></div>', f"%s\n{FOUND}"),
        (f'<article>{STORY}<p class="share-price">{PRICE}</p><p class="promotion-law">{PRICE}</p></article>', f"%s\n{PRICE}\n{PRICE}"),
        (f'<article>{STORY}<section class="menu-planning">{TALK}</section></article>', f"%s\n{FOUND}"),
        (f'<div class="page"><h1>T</h1><div class="text">{STORY}</div><p>{TAIL}</p></div><div class="x"><p>short</p></div>', f"T\n%s\n{TAIL}"),
        (f'<h1>T</h1><div class="text">{STORY}</div><p>{TAIL}</p>', f"T\n%s\n{TAIL}"),
        (f'<article>{STORY}<div class="share"><a href="/a">Tell a friend</a> <a href="/b">Write to us</a></div></article>', "%s"),
        (f'<article>{STORY}<div class="reader-comments">{TALK}</div><div class="cookie-notice"><p>{LEAD}</p></div></article>', "%s"),
        (f'<main><h1>T</h1><article>{STORY}</article></main>', "T\n%s"),
    ],
)
def test_whole_articles(spark, body, text):
    text = text % STORY[3:-4].strip()
    page = f"<html><body><nav>go</nav>{MENU}{body}{SIDE}<footer>end</footer></body></html>"
    assert H.extracted(page, None) == text
    df = spark.createDataFrame(site(5, lambda i: page[12:-14]), "url string, html string")  # by the vote of the host
    assert {r.text for r in H.extract_pages(df).collect()} == {text}


def test_deep_containers_keep_apart():
    steps = "".join(f'<div class="step{"x" * 30}">' for _ in range(30))
    page = H.parsed(f'<div class="a">{steps}<p>one</p>{"</div>" * 31}<div class="b">{steps}<p>two</p>')
    paths = [page.containers[b.container][0] for b in page.blocks]
    assert len(set(paths)) == 2 and [H.text_below(page, p) for p in paths] == ["one", "two"]


def slow_targets(page):
    """`whole_articles` by looking at all blocks for each container."""
    above = [c[1] for c in page.containers]
    tags = [c[2] for c in page.containers]

    def line(c):
        while c >= 0:
            yield c
            c = above[c]

    def weight(choose):
        return sum(max(len(b.text) - 2 * b.links, 0) for b in page.blocks if choose(b.container))

    def climbs(c):
        up = above[c]
        if any(tags[x] == "article" for x in line(up)):
            return True
        if any(tags[x] == "main" for x in line(up)) and not any(t == "article" and c in line(i) for i, t in enumerate(tags)):
            return True
        same = {i for i in range(len(tags)) if above[i] == up and page.containers[i][0] == page.containers[c][0]}
        others = {i for i in range(len(tags)) if above[i] == up} - same
        kin = {i for i in others if tags[i] == tags[c] == "section"}
        own = weight(lambda b: b == up)
        headed = any(b.heading for b in page.blocks if b.container == up)
        if tags[up] in ("", "html", "body") and not headed and own < H.TOP_SHARE * weight(lambda b: c in line(b)):
            own = 0
        like = own + weight(lambda b: kin & set(line(b)))
        rest = weight(lambda b: up in line(b)) - weight(lambda b: same & set(line(b))) - like
        return 0 < like >= rest

    def target(c):
        return target(above[c]) if c and tags[c] != "body" and climbs(c) else c

    return [target(c) for c in range(len(tags))]


def test_whole_articles_equal_a_slow_version():
    draw = random.Random(4)
    parts = ["<div>", '<div class="a">', "<section>", '<section class="b">', "<article>", "<main>", "</div>", "</section>", "</article>"]
    parts += ["</main>", "<h1>head</h1>", "<p>some text</p>", "<p>longer text, with more words</p>", '<p><a href="/">link</a></p>', "loose"]
    for i in range(300):
        html = "".join(draw.choices(parts, k=draw.randint(1, 30)))
        page = H.parsed(f"<html><body>{html}</body></html>" if i % 2 else html)
        assert H.whole_articles(page) == slow_targets(page), html
