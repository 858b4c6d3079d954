"""Rendered pages against what a reader sees."""

import re
import time

import pytest

from plumbline.llm import html_text, registry

CASES = [
    ("plain text", "plain text"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>c<br>d", "a\nb\nc\nd"),
    ("<title>t</title><style>x{}</style><script>var a='</p>';</script><p>seen</p>", "seen"),
    ("a <!-- no --> b<!doctype html> c", "a b c"),
    ("<b>bo</b>ld  and\n\n wide", "bold and wide"),
    ("&lt;x&gt; &amp; &eacute; &#65; &nope;", "<x> & é A &nope;"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a</li><li>b</li></ol>", "9. a\n10. b"),
    ("<ol type=i><li>a</li><li value=4>b</li></ol>", "i. a\niv. b"),
    ("<ol reversed><li>a</li><li>b</li></ol>", "2. a\n1. b"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<table><tr><th>name<th>n<tr><td>a<td>10<tr><td>long one<td>7</table>", "name      n\na         10\nlong one  7"),
    ("<table><caption>cap</caption><tbody><tr><td>a</td><td rowspan=2>b</td></tr><tr><td>c</td></tr></tbody></table>", "cap\na  b\nc"),
    ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<pre>a\n  b\n\n\nc</pre>d", "a\n  b\n\nc\n\nd"),
    ("<p hidden>no</p><p style='display: none'>no</p><p style='color:red;visibility:hidden'>no</p>yes", "yes"),
    ("<style>.ad,#x{display:none} b.y{visibility:hidden}</style><p class='q ad'>no</p><i id=x>no</i><b class=y>no</b><b>yes</b>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<svg><text>no</text></svg><iframe>no</iframe><noscript>yes</noscript><dialog>no</dialog>", "yes"),
    ("<blockquote>q</blockquote>r", "  q\n\nr"),
    ("</p></div>stray</b> ends <b>open", "stray ends open"),
    ("<p><b>bold<p>next", "bold\n\nnext"),
    ("<a href='x>y'>link</a><img alt=no src=a>end", "linkend"),
    ("text < 3 and <3", "text < 3 and <3"),
    ("<textarea>a <b>\nc</textarea>", "a <b>\nc"),
    ("<head><meta charset=x><title>t</title><p>body", "body"),
    ("broken <a href='", "broken <a href='"),
    ("<p class=a'b>x<p title='1 > 0'>y", "x\n\ny"),
    ("", ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert html_text.rendered(page) == text


SHOWN = [
    ("<style>@media print { .a { display:none } } @media (max-width:600px) { .b { display:none } .c {} }</style><p class=a>x<p class=b>y", "x\n\ny"),
    ("<style media=print>p{display:none}</style><p>x", "x"),
    ("<style>@import 'q'; @media screen { .a { display:none } } .b{display:none}</style><p class=a>no<p class=b>no<p>x", "x"),
    ("<style>.a { display:none } .a { display:block }</style><p class=a>x", "x"),
    ("<style>.a { display:none !important } .a { display:block }</style><p class=a>no</p>x", "x"),
    ("<head><title>T</title>Hello <p>x", "Hello\n\nx"),
    ("<math><mi>x</mi><mo>=</mo><annotation>no</annotation></math><map name=m>y</map>", "x=y"),
]


@pytest.mark.parametrize("page,text", SHOWN)
def test_shown_by_browsers(page, text):
    assert html_text.rendered(page) == text


def test_null_deep_and_long_pages():
    assert html_text.rendered(None) == ""
    assert html_text.rendered("<div>" * 50_000 + "deep") == "deep"
    assert html_text.rendered("<b>" * 5_000 + "x" + "</b>" * 5_000 + "<p>y") == "x\n\ny"
    assert len(html_text.rendered("<p>word " * 20_000).split()) == 20_000
    assert html_text.rendered("<a " + "' \"" * 2_000) == "<a " + "' \"" * 2_000
    assert html_text.rendered("<ul><li>" * 400 + "x").endswith("x")
    assert html_text.rendered("<table><tr><td>" * 400 + "x").endswith("x")


def test_every_visible_word_of_the_driver_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = registry.op9_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    import html

    for r in got:
        plain = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", pages[r["page_id"]] or "")
        plain = html.unescape(re.sub(r"<(/?)(?:p|br|li|div|h1|ul|nav|article|footer|body|table|tr|td|th)\b[^>]*>", " ", plain))
        plain = re.sub(r"<[a-z/!][^>]*>", "", plain)
        words = [w for w in plain.split() if w != "-"]
        assert [w for w in r["text"].split() if w != "-"] == words
        assert r["n_chars"] == len(r["text"]) and r["n_lines"] == (r["text"].count("\n") + 1 if r["text"] else 0)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "<p>a", "x")], "page_id long, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract(df).collect()) == [(0, "a"), (1, ""), (1, "")]
    assert html_text.extract(df.limit(0)).count() == 0


def test_long_quoted_values_end_at_their_quote():
    for n in (700, 70_000, 1_000_000):
        assert html_text.rendered(f'<p title="{"x" * n}>LEAK">visible</p>') == "visible"
    assert html_text.rendered("<p title='a>b' data-x=\"'>\">ok</p><p a=\"unclosed>rest") == "ok\n\nrest"
    assert html_text.rendered("a <b and <i") == "a <b and <i"


def test_many_rules_quotes_and_levels_are_linear():
    began = time.perf_counter()
    rules = "".join(f".c{i}{{display:none}}" for i in range(10_000))
    page = f"<style>{rules}</style>" + "".join(f'<p class="c{i} d">x{i}</p>' for i in range(9_990, 20_000))
    assert html_text.rendered(page).split() == [f"x{i}" for i in range(10_000, 20_000)]
    html_text.rendered('<p a="' * 20_000)
    html_text.rendered("<a " * 20_000)
    html_text.rendered("<div>" * 5_000 + "deep" + "</div>" * 5_000)
    assert time.perf_counter() - began < 8


def test_visible_inside_hidden():
    page = "<style>.h{visibility:hidden}.v{visibility:visible}</style><p>a</p><div class=h>no <p class=v>yes <b>too</b></p><span style='visibility:visible'>inline</span> no</div>"
    assert html_text.rendered(page) == "a\n\nyes too\n\ninline"
    assert html_text.rendered("<div style='visibility:hidden'>no<div style='display:none'><p style='visibility:visible'>no</p></div></div>z") == "z"


BLOCKS = "ul ol menu li dl dt dd table tr td blockquote pre div p section details summary fieldset form figure center".split()


def test_every_block_nests_deeply(spark):
    """Levels beyond MAX_DEPTH are laid out at that depth; none ends the page, or the others' job."""
    pages = [(f"<{t}>" * n + "the end" + f"</{t}>" * k + " after") for t in BLOCKS for n in (340, 600, 50_000) for k in (0, n)]
    pages += ["<ul><li>" * 600 + "the end", "<table><tr><td>" * 5_000 + "the end", "<blockquote><pre>" * 600 + "the end", "<ol><li><table><tr><td>" * 400 + "the end"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").repartition(4)
    rows = html_text.extract(df).collect()
    assert len(rows) == len(pages)
    for r in rows:
        closed = "<details" in pages[r["page_id"]]
        assert closed or "the end" in r["text"]


def test_lists_keep_their_marks_at_depth():
    text = html_text.rendered("<ul><li>" * 150 + "x")
    assert text.endswith("x") and text.count("- ") == 150


def test_tables_of_many_spans_are_linear():
    import time

    def seconds(n):
        page = "<table>" + "<tr><td colspan=1000 rowspan=60000>a<td>b</tr>" * n + "</table>"
        at = time.process_time()
        assert html_text.rendered(page).count("a") == n
        return time.process_time() - at

    seconds(20)
    assert seconds(800) < 12 * seconds(200) + 0.5


def test_covered_ranges_against_columns():
    import random

    r = random.Random(1)
    for _ in range(300):
        lists = []
        for _ in range(2):
            at, own = 0, []
            for _ in range(r.randrange(5)):
                at += r.randrange(3)
                end = at + r.randint(1, 4)
                own.append((at, end, r.randint(1, 3)))
                at = end
            lists.append(own)
        want = {c: max(u for a, b, u in sum(lists, []) if a <= c < b) for a, b, _ in sum(lists, []) for c in range(a, b)}
        got = html_text.covered(*lists)
        assert {c: u for a, b, u in got for c in range(a, b)} == want
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
