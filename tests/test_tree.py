"""Trees of malformed pages: texts and links as browsers have them."""

import random
import time

import pytest

from tidemark.functions import tree
from tidemark.operators import web

#: Page, its text with newlines before blocks, its links.
PAGES = [
    ("<p>one<p>two", "\none\ntwo", []),
    ("<p><a href=x>one<p>two</a>three", "\none\ntwothree", [("x", "one"), ("x", "two")]),
    ("<a href=1>x<a href=2>y</a>z", "xyz", [("1", "x"), ("2", "y")]),
    ("<a href=1><div>x<div>y</a>z</div></div>", "\nx\nyz", [("1", ""), ("1", "x"), ("1", "y")]),
    ("<a href=1><p>x</a>y</p>z", "\nxyz", [("1", ""), ("1", "x")]),
    ("<a href=a>a<table><a href=b>b</table>x", "abx", [("a", "ab"), ("b", "b"), ("b", "x")]),
    ("<table><tr><td>a</td>stray</tr></table>after", "stray\naafter", []),
    ("<table>b<tr><td>a</td></tr>c</table>d", "bc\nad", []),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "\nab\ncd", []),
    ("<table><td>a</table>b", "\nab", []),
    ("<table><caption>t<tr><td>a</table>", "t\na", []),
    ("<table><p>x<tr><td>a</table>", "\nx\na", []),
    ("<table><tr><td><table><tr><td>in</table>out</table>", "\n\ninout", []),
    ("<table><a href=1>x<tr><td>y</a></table>z", "x\nyz", [("1", "x"), ("1", "z")]),
    ("<table><tr><td><a href=1>x</td><td>y</td></tr></table>z", "\nxyz", [("1", "x")]),
    ("<b>1<p>2</b>3</p>4", "1\n234", []),
    ("<p>1<b>2<i>3</b>4</i>5</p>6", "\n123456", []),
    ("<p>1<div>2</p>3", "\n1\n2\n3", []),
    ("</p>x</br>y", "\nx\ny", []),
    ("<h1>a<h2>b</h1>c", "\na\nbc", []),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "\na\nb\nc\nde", []),
    ("<dl><dt>a<dd>b<dt>c</dl>d", "abcd", []),
    ("<tr><td>x</td></tr>y", "xy", []),
    ("<select><option>a<p>b<option>c</select>d<p>e", "abcd\ne", []),
    ("<table><tr><td><select><option>a<td>b</table>", "\nab", []),
    ("<select><input>x", "x", []),
    ("<svg><title>no</title><text>x</text></svg>z", "z", []),
    ("<svg><text>x</text><p>y</p></svg>z", "\nyz", []),
    ("<svg><foreignObject><p>x</p></foreignObject></svg>z", "z", []),
    ("<math><mi>x</mi><mo>+</mo></math>z", "x+z", []),
    ("<noscript><p>no</p></noscript>yes", "yes", []),
    ("<iframe><p>a</iframe>b", "b", []),
    ("<template><p>x<template>y</template>z</template>w", "w", []),
    ("<table><template><tr><td>x</template><tr><td>y</table>", "\ny", []),
    ("<button>a<button>b</button>c", "abc", []),
    ("<form>a<form>b</form>c<div>d</form>e</div>", "abc\nde", []),
    ("<pre>\nx\n\ny</pre>", "x\n\ny", []),
    ("<textarea>\nx &amp; <b></textarea>y", "x & <b>y", []),
    ("<xmp><p>x</xmp>y", "<p>xy", []),
    ("<marquee><a href=1>x</marquee>y</a>z", "xyz", [("1", "x")]),
    ("<body>a</body>b</html>c", "abc", []),
    ("<head><p>x<title>T</title>", "\nx", []),
    ("<a>x</a><a href=y><script>no</script>z</a>", "xz", [("", "x"), ("y", "noz")]),
    ("<nobr>a<nobr>b</nobr>c", "abc", []),
    ("<ruby>a<rp>(<rt>b<rp>)</ruby>c", "a(b)c", []),
    ("<a href=1 href=2>x</a>", "x", [("1", "x")]),
    ("a\0b", "ab", []),
]


@pytest.mark.parametrize(("page", "text", "links"), PAGES)
def test_malformed_pages(page, text, links):
    got = web.read_page(page, "")
    assert (got[1], got[2]) == (text, links)


def test_a_description_counts_where_it_stands():
    page = "<title>A  &amp; B</title><p>We are here.<meta name=description content=' We are here. '><meta property='og:description' content='Else.'>"
    assert web.read_page(page, "") == ("A & B", "\nWe are here.Else.\n", [])


def checked(node):
    """Links between nodes agree in both directions."""
    last = None
    child = node.first
    while child is not None:
        assert child.parent is node and child.prev is last
        last, child = child, child.next
    assert node.last is last


def test_any_tags_give_a_tree_with_all_texts():
    rng = random.Random(3)
    tags = sorted(tree.SPECIAL | tree.FORMATS | {"span", "option", "select", "svg", "math", "mi", "ruby", "rt"} - {"plaintext"})
    for k in range(3000):
        few = rng.sample(tags, rng.randint(2, 8))
        page, texts = "", []
        for i in range(rng.randint(1, 40)):
            tag = rng.choice(few)
            page += rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>"])
            if rng.random() < 0.5:
                page += f"t{i} "
                texts.append(f"t{i}")
        root = tree.tree(page)
        for node in root.walk():
            checked(node)
        seen = "".join(n.text for n in root.walk() if not n.tag).split()
        raw = {"script", "style", "title", "textarea", "xmp", "noembed", "noframes", "iframe", "noscript"}
        if not raw & set(few):
            assert sorted(seen) == sorted(texts), page
        assert len(set(seen)) == len(seen) or raw & set(few)
        assert isinstance(web.read_page(page, "")[1], str)


@pytest.mark.parametrize("part", ["<b>", "<b id={}>", "<b id={}><p>", "<p><b id={}>", "<a href={}>x", "<a href={}><div>", "<table>x", "<table><tr><td>", "<table><a>", "<div><b>x</div>", "<font size={}><p>x</font>", "<i><div></i>", "<li>", "<button>", "<select><option>", "<svg><p>", "<template>", "</p>", "</b>", "<form><div></form>", "<nobr>", "<marquee><b>", "<b></p>"])
def test_pages_of_any_depth_take_time_in_proportion(part):
    def took(n):
        page = "".join(part.replace("{}", str(k)) for k in range(n // len(part)))
        began = time.perf_counter()
        web.read_page(page, "https://a.example/")
        return time.perf_counter() - began

    took(1000)
    assert took(200_000) < 12
    assert took(200_000) < 8 * took(50_000) + 0.5


def test_the_deepest_elements_are_beside_each_other():
    root = tree.tree("<div>" * 5000 + "x")
    depth, node = 0, root
    while node.first is not None:
        node, depth = node.last, depth + 1
    assert depth <= tree.DEEPEST + 1 and root.content() == "x"
