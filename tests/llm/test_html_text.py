"""Main text of pages against pages built from known parts."""

from __future__ import annotations

import random

from pyspark.sql import Row

from fathom.llm import html_text

SCHEMA = "page_id long, url string, html string, text string, host int"


def page_table(spark, rows):
    return spark.createDataFrame([Row(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)


def wrapped(article, extra="", tag="article"):
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><p>no';</script></head><body>"
        "<header><h2>Site</h2></header><nav><ul><li><a href='/a'>Menu</a></ul></nav><div class='cookie-notice'>We use</div>"
        f"<aside>Side</aside><{tag}>{article}</{tag}><form>Mail <input></form><div id=comments><p>Great!</p></div>{extra}"
        "<div class=\"ad\">Buy</div><footer>&copy; me</footer><!-- <p>gone</p> --></body></html>"
    )


def test_one_page_in_its_parts():
    article = "<h1>A &amp; B</h1><p>One\n  two<br>three <b>bold<p>Next &eacute;&#233;&amp x</p><ul><li>first<li>second</ul><div class='share'>Tweet</div>"
    want = "A & B\nOne two three bold\nNext éé& x\nfirst\nsecond"
    assert html_text.main_text(wrapped(article)) == want
    assert html_text.main_text(wrapped(article, tag="main")) == want
    assert html_text.main_text(wrapped(article, tag="div")) == want


def test_broken_pages():
    for page, want in [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b<foo", "a\nb"), ("<p>a</b></i></p></div>c", "a\nc"),
        ("<article><p>cut &am", "cut &am"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<script>never closed <p>x", ""),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<!-- open", ""), ("<p hidden>x</p><p>y", "y"),
        ("<div>" * 3000 + "deep", "deep"),
    ]:
        assert html_text.main_text(page) == want, page


def test_templates_of_a_host_go_and_articles_stay(spark):
    dealt = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        own = [" ".join(dealt.choice("abcdefgh") * 3 for _ in range(12)) + f" {i}" for _ in range(3)]
        same = "The same sentence on every page."
        body = f"<div>Standing line</div><section><span>Top</span></section><div><p>{own[0]}</p><p>{own[1]}</p></div>"
        if i % 2:
            rows.append((i, f"https://user@plain.example:80/{i}", f"<html><body>{body}<p>{own[2]}</p></body></html>"))
            want[i] = "\n".join(own)
        else:
            rows.append((i, f"http://Article.example/{i}", wrapped(f"<p>{same}</p><p>{own[0]}</p><div><em>Read</em> more</div>")))
            want[i] = f"{same}\n{own[0]}"
    rows += [(100, None, "<p>Standing line</p>"), (101, "https://plain.example/", None), (102, "https://few.example/", "<div>Standing line</div>")]
    want |= {100: "Standing line", 101: "", 102: "Standing line"}
    rows.append(rows[1])
    pages = page_table(spark, rows).repartition(5)
    near = html_text.extract_text(pages).collect()
    far = html_text.extract_text(pages, near_hashes=0).collect()
    assert sorted(map(tuple, near), key=repr) == sorted(map(tuple, far), key=repr)
    assert len(near) == len(rows)
    for row in near:
        assert row.text == want[row.page_id] and row.n_chars == len(row.text)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_names_around_the_text_do_not_drop_it():
    for page, want in [
        ('<body class="no-sidebar"><article><p>Real text.</p></article></body>', "Real text."),
        ('<html class="no-js cookie-consent"><body><p>Real text.</p></body></html>', "Real text."),
        ('<body class="sidebar"><div class="page-banner-off"><p>Real text.</p></div></body>', "Real text."),
        ('<article class="post comments-open"><p>Real text.</p></article>', "Real text."),
        ('<article><p class="notice-period">Three months.</p><p class="notice">Sale</p></article>', "Three months."),
        ('<form id="aspnet"><article><h2>Head</h2><p>Real text.</p></article><form>Mail</form></form>', "Head\nReal text."),
        ('<form><h1>Head</h1><p>Real text.</p></form><form>Search</form>', "Head\nReal text."),
        ('<div class="widget"><main><p>Real text.</p></main></div>', "Real text."),
        ('<div class="site-footer"><p>Imprint</p></div><p>Real text.</p>', "Real text."),
        ('<article><p>Real text.</p></article><div class="comments"><article class="comment-body"><p>First!</p></article></div>', "Real text."),
        ("<main><h1>Head</h1><p>A first long paragraph of it.</p><article><p>Teaser card</p></article><p>A last paragraph.</p></main>",
         "Head\nA first long paragraph of it.\nTeaser card\nA last paragraph."),
        ("<main><p>Home</p><article><p>A long text that is most of main.</p></article></main>", "A long text that is most of main."),
    ]:
        assert html_text.main_text(page) == want, page


def test_repeated_rows_and_mirrors_count_as_one_page(spark):
    page = "<html><body><div><p>A page of its own.</p><section>More of it.</section></div></body></html>"
    rows = [(1, "https://a.example/", page)] * 6 + [(i, f"https://a.example/{i}", page) for i in range(2, 8)]
    for near in (html_text.NEAR_HASHES, 0):
        got = html_text.extract_text(page_table(spark, rows).repartition(3), near_hashes=near).collect()
        assert len(got) == 12 and {r.text for r in got} == {"A page of its own.\nMore of it."}
