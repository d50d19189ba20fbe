"""Pages are read in time linear in their length, whatever their markup."""

import time

import pytest

from graphloom.llm import extraction

BROKEN = ["x <b y ", "<a href='x", '<a "', '<x a="1" ', "<!x ", "<div>", "<b>", "<span><div></span>", "<body>", "a<b "]


def seconds(page):
    began = time.process_time()
    extraction.read_page(page)
    return time.process_time() - began


@pytest.mark.parametrize("unit", BROKEN)
def test_broken_markup_is_read_in_linear_time(unit):
    half, whole = (min(seconds(unit * (n // len(unit))) for _ in range(2)) for n in (150_000, 300_000))
    assert whole < 4 and whole < 3.5 * half + 0.2


def test_stray_ends_and_deep_markup():
    assert seconds("<div>" * 10_000 + "</p>" * 10_000) < 2
    assert seconds("<b>" * 20_000 + "<hr>" * 20_000) < 2
    assert seconds("<p>" + "<div>" * 10_000 + "</span>" * 10_000) < 2


def test_a_tag_that_another_one_cuts_off_is_text():
    found = lambda page: [t for _, t in extraction.read_page(page)[1]]
    assert found("<p>if a <b and c: stop</p><p>next</p>") == ["if a <b and c: stop", "next"]
    assert found("<p>one <a href='x>y' title=\"q>r\">two</a></p><p class=un") == ["one two"]
    assert found("<!-- a > b --><!doctype html><p>three<!-- never ends") == ["three"]
    assert found("<b>x</i>y</b><p>z</p></div>w") == ["xy", "z", "w"]


def test_ends_stay_inside_walls():
    elements, blocks = extraction.read_page("<ul><li>a<div><p>b</li>c</div><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>")
    assert [(elements[at].tag, t) for at, t in blocks] == [("li", "a"), ("p", "bc"), ("li", "d"), ("td", "e"), ("td", "f"), ("td", "g")]
