"""Template deduction on made-up hosts, odd markup, and the marked articles of the smallest tables."""

import html
import random
import re

from fieldmark.llm import html_extract, pages

SCHEMA = "page_id bigint, url string, html string, host string, key string, text string"


def _words(draw, n):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(n)).capitalize() + "."


def _shop(draw, body):
    """A layout that doesn't mark the article: menus and offers are told by links, the notice by standing on every page."""
    links = "".join(f'<div><a href="/{k}">{_words(draw, 3)}</a></div>' for k in range(draw.randint(3, 9)))
    return (f"<html><head><title>{body[0]}</title></head><body><div><div class='top'><p>Our shop since 1999</p></div><div>{links}</div>"
            f"<div><h2>{body[0]}</h2>{''.join(f'<p>{b}</p>' for b in body[1:])}<p>All prices include delivery.</p></div>"
            f"<div>{links}</div><div class='bottom'><p>Call us</p></div></div></body></html>")


def _blog(draw, body):
    asides = ['<aside><p>{0}</p></aside>', '<div class="sidebar-left"><p>{0}</p></div>', '<div id="comments"><p>{0}</p><p>{0}</p></div>',
              '<form><p>{0}</p><input><textarea>{0}</textarea></form>', '<div class="cookie-notice">{0}</div>', '<section class="related"><a href="/x">{0}</a></section>',
              '<div style="display: none">{0}</div>', '<script>if (a < b) {{ x = "<p>{0}</p>" }}</script>', '<!-- <p>{0}</p> -->']
    parts = [f"<p class=x>{b}" + draw.choice(["", "</p>"]) for b in body[1:]]
    for a in draw.sample(asides, 5):
        parts.insert(draw.randint(0, len(parts)), "</p>" + a.format(_words(draw, 6)))
    return (f"<!DOCTYPE html><html><body class='has-sidebar'><header><p>{_words(draw, 4)}</p></header><nav><ul><li>{_words(draw, 1)}<li>two</ul></nav>"
            f"<div class='post-{draw.randint(1, 99)} entry-content'><header><h1>{body[0]}</h1><p>by someone</p></header>{''.join(parts)}</div><footer>&copy; x</footer>")


def _body(draw):
    return [_words(draw, 5)] + [_words(draw, draw.randint(8, 60)) + draw.choice(["", " a < b", " &amp; more", " é\U0001F600"]).replace(" < ", " &lt; ") for _ in range(draw.randint(2, 7))]


def _plain(body):
    return "\n".join(" ".join(html.unescape(b).split()) for b in body)


def test_layouts_without_and_with_marks(spark):
    draw = random.Random(3)
    rows, want = [], {}
    for i in range(120):
        body = _body(draw)
        host = ["shop.example", "Blog.Example:8080", f"single-{i}.example"][i % 3]
        page = (_shop if i % 3 == 0 else _blog)(draw, body)
        rows.append((i, f"http://{host}/a/{i}?q=//z", page, "h", "k", "t"))
        want[i] = _plain(body)
    rows += [(200, "http://shop.example/", None, None, None, None), (201, None, "", "h", None, None), (202, "odd", "no markup at all &amp; one line", "h", None, None),
             (203, "odd", "<p>" + "long word " * 50_000, "h", None, None), (None, "http://[", "<<<>>><a href='", "h", None, None), (204, "odd", "<nav>menu</nav><article></article>", "", "", "")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, text in want.items():
        assert got[i].text == text, (i, rows[i][2])
    assert (got[200].text, got[201].text, got[204].text) == ("", "", "")
    assert got[202].text == "no markup at all & one line"
    assert got[203].text == ("long word " * 50_000).strip()
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_copies_keep_their_text(spark):
    draw = random.Random(4)
    copies = [(i, "http://same.example/x", "<body><article><h1>Title</h1><p>" + "equal words " * 20 + "</p></article><footer>f</footer></body>", *"abc") for i in range(40)]
    other = [(100 + i, "http://notice.example/x", f"<body><article><p>{_words(draw, 50)}</p><p>Read our terms first.</p></article></body>", *"abc") for i in range(40)]
    got = html_extract.extract(spark.createDataFrame(copies + other, SCHEMA)).collect()
    for r in got:
        if r.page_id < 100:
            assert r.text == "Title\n" + ("equal words " * 20).strip()
        else:
            assert "terms" not in r.text and r.n_chars > 50


def test_empty_table(spark):
    assert html_extract.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_marked_articles_of_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.page_id: r.text for r in html_extract.op12(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_reader_repairs_markup():
    def texts(page):
        return [e.text for e in pages.read(page) if e.text is not None and not e.aside]

    assert texts("<p>a<p>b</p>c") == ["a", "b", "c"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("a<b>b</b>c <i>d") == ["abc d"]
    assert texts("a<br>b<!-- > --> c") == ["a b c"]
    assert texts('<p title="a > b">x') == ["x"]
    assert texts("<script>'<p>'</script>y</div>z") == ["yz"]
    assert texts("1 < 2 & 3 &gt; 2") == ["1 < 2 & 3 > 2"]
    assert texts("İİ<script>'</p>'</SCRIPT >a<p>b</p><foot") == ["İİ", "a", "b"]
    assert texts('<p><a href="x" y">b</a> c</p><p title="unclosed>d') == ["b c", "d"]
    assert texts("<a " * 50_000 + '="' * 50_000) == []
    assert texts("<nav>x<p>y</nav>z") == ["z"]
    assert texts("<p>a <span class=ad>b</span> c") == ["a c"]
    assert texts("<div hidden>a</div><div class=hidden-gem>b</div>") == ["b"]
