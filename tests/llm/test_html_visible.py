"""What a page shows and hides, tables of any depth and span, and all pages against a plain walk of their tags."""

import re

import pytest

from pulsegrid.llm import html


@pytest.mark.parametrize(
    "page,text",
    [
        ("<style>.h{display:none} #i, p.x > b{visibility:hidden}</style><p class='a h'>no<p>yes<div id=i>no <span style='visibility:visible'>seen</span></div><p class=x>a<b>no</b>c", "yes\n\nseen\n\nac"),
        ("<style>.h{display:none} div.h{display:block}</style><div class=h>shown</div><p class=h>no", "shown"),
        ("<style>.h{display:none !important}</style><div class=h style='display:block'>no</div>x", "x"),
        ("<style>@media print {p{display:none}} @media screen {i{display:none}} @import url(x);</style><p>yes<i>no</i>", "yes"),
        ("<style media=print>p{display:none}</style><p>yes", "yes"),
        ("<style>[data-x=no]{display:none}</style><p data-x=no>no<p data-x=y>yes", "yes"),
        ("<p aria-hidden=true>seen", "seen"),
        ("a<!-- > no --> b<!-->c<!--- no --!>d<!-- no", "a bcd"),
        ("a <svg><title>t</title><text>label <tspan>two</tspan></text>stray<desc>d</desc></svg> b", "a label two b"),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>", "x=2"),
        ("<textarea>\nfirst\n second</textarea>after", "first\n second\nafter"),
        ("<select><option>a<option selected>b<option>c</select>", "b"),
        ("<select multiple><option>a<optgroup><option>b</optgroup></select>", "a b"),
        ("<input type=submit value=Go> <input value=typed> <input type=hidden value=no><input type=password value=no><input type=checkbox value=no>", "Go typed"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<table><tr><td colspan=1000>a<td>b</table>", "a | b"),
        ("<table><tr><td colspan=2>a long heading<td>x<tr><td>1<td>2<td>3</table>", "a long heading | x\n1 | 2          | 3"),
        ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in | ner | out"),
        ("<table><tr style='visibility:hidden'><td>no<td style='visibility:visible'>yes</table>", "| yes"),
    ],
)
def test_visible(page, text):
    got = html.html_text(page)[0]
    assert got.strip() == text, got


def test_tables_of_any_depth():
    deep = "<table><tr><td>" * 3000 + "core" + "</table>" * 3000
    assert html.html_text(deep) == ("core", 1)
    assert html.html_text("<div>" * 20_000 + "<p>x</p>" + "</div>" * 20_000)[0] == "x"


def test_very_long_pages():
    for unit in ("<p>", "<td>a", "a b ", "<b>", "</div>", "<", "&amp;", "<li>x", "<style>a{}</style>", "<!-- "):
        html.html_text(unit * (200_000 // len(unit)))


def test_words_of_all_pages(spark):
    """Every page's words are those between its tags, but for what scripts, styles, comments and hidden elements hold."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r.text for r in html.render_pages(pages).collect()}
    checked = 0
    for r in pages.collect():
        page = r.html or ""
        if re.search(r"<(select|textarea|input|svg|math|details|img|ol|q)\b|hidden|display\s*:|visibility\s*:|<pre", page, re.I):
            continue
        import html as entities

        plain = re.sub(r"<!--.*?-->|<(script|style|noscript|title|head|template|iframe)\b.*?</\1\s*>", " ", page, flags=re.S | re.I)
        plain = entities.unescape(re.sub(r"<[^>]*>", " ", plain))
        words = re.findall(r"\w+", plain)
        assert sorted("".join(words)) == sorted("".join(re.findall(r"\w+", got[r.page_id] or ""))), r.page_id
        checked += 1
    assert checked > 100
