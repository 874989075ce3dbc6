"""Elements whose end tag may be left out, or that close themselves, do not swallow the rest of the page."""

import pytest

from ledgerlark.llm.html_text import blocks_of


def texts(page):
    return [b.text for b in blocks_of(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>t</title><body><article><p>one</p></article></body></html>", ["one"]),
        ("<head><meta charset=utf-8><style>p{}</style><title>t</title><article><p>one</p><p>two</p></article>", ["one", "two"]),
        ("<head class=ad><title>t</title><noscript>n</noscript><script>'<body>'</script><p>one", ["one"]),
        ("<html><head><title>t</title><link rel=x></head><body><p>one</p></body>", ["one"]),
        ("<datalist id=x><option value=a>A<option>B</datalist><p>one</p>", ["one"]),
        ("<datalist><option>A</option><option>B</datalist>one<p>two</p>", ["one", "two"]),
        ("<datalist><optgroup><option>A<optgroup><option>B</optgroup></datalist><p>one</p>", ["one"]),
        ("<div><option>A</div><p>one</p>", ["one"]),
        ("<p>x</p><select><option>A<option>B</select><p>one</p>", ["x", "one"]),
        ("<p>one <svg class=i/> two</p><p>three", ["one two", "three"]),
        ('<p>one <svg viewBox="0 > 1" /> two</p><p>three</p>', ["one two", "three"]),
        ("<p>one <math/> two</p><p>three</p>", ["one two", "three"]),
        ("<p>one <svg><path d='m'/><text>no</text></svg> two</p>", ["one two"]),
        ("<p>one <SVG/> two <math><mi>x</mi></math> three</p>", ["one two three"]),
    ],
)
def test_ends(page, want):
    assert texts(page) == want


def test_an_open_head_is_not_an_aside():
    (b,) = blocks_of("<head class=ad><title>t</title><p>one")
    assert not b.aside


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p class=ad>Buy<div>the article</div>", [("Buy", True), ("the article", False)]),
        ("<ul><li class=promo>Buy<li>the article</ul>", [("Buy", True), ("the article", False)]),
        ("<dl><dt class=ad>Buy<dd>the article</dl>", [("Buy", True), ("the article", False)]),
        ("<table><tr><td class=ad>Buy<td>the article<tr><td>and more</table>", [("Buy", True), ("the article", False), ("and more", False)]),
        ("<table><thead class=ad><tr><td>Buy<tbody><tr><td>the article</table>", [("Buy", True), ("the article", False)]),
        ("<ul><li class=promo>Buy<ul><li>inside</ul><li>the article</ul>", [("Buy", True), ("inside", True), ("the article", False)]),
        ("<p class=ad>Buy<table><tr><td><p>inside</table><p>the article", [("Buy", True), ("inside", False), ("the article", False)]),
    ],
)
def test_implied_ends(page, want):
    assert [(b.text, b.aside) for b in blocks_of(page)] == want


def test_the_tree_looks_at_neighbours_and_deep_pages_take_linear_time():
    import time

    from ledgerlark.llm import html_text

    def used(node):
        return set() if isinstance(node, int) else {html_text.FEATURES[node[0]]} | used(node[2]) | used(node[3])

    assert used(html_text.tree()) & {"words_before", "link_density_before", "words_after", "link_density_after"}
    seconds = []
    for n in (10_000, 40_000):
        began = time.process_time()
        assert len(blocks_of("<div><p>x" * n)) == n
        seconds.append(time.process_time() - began)
    assert seconds[1] < 10 * seconds[0] + 0.2
