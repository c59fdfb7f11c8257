"""Pages put together from shells of articles and what themes put around them, in every combination."""

import itertools

import pytest

from tidemark.llm.html_extract import main_text

WORDS = "the river rose again that night and people moved their things upstairs before it reached the lower rooms".split()


def sentence(k, n):
    return " ".join(WORDS[(k + 3 * i) % len(WORDS)] for i in range(n)).capitalize() + "."


SHORT = [sentence(1, 14), sentence(4, 17)]
LONG = [sentence(i, 18 + i) for i in range(9)]
#: How a theme holds the article; {} is its inside.
SHELLS = {
    "article element": "<article>{}</article>",
    "main element": "<main>{}</main>",
    "article in main": "<main><article class='post'>{}</article></main>",
    "content division": "<div class=content>{}</div>",
    "entry": "<div class=entry>{}</div>",
    "nested divisions": "<div class='region'><div class='node'><div class='field--name-body'>{}</div></div></div>",
    "numbered post": "<div id='post-12' class='hentry'>{}</div>",
    "story section": "<section class='story__body'>{}</section>",
    "role": "<div role='main' id='c'>{}</div>",
    "table cell": "<table><tr><td width=600>{}</td></tr></table>",
}
MANY = 30
#: What stands around it, before and after.
AROUND = {
    "reader comments": ("", "<div id=comments>" + "".join(f"<p>{sentence(i, 25)}</p>" for i in range(MANY)) + "</div>"),
    "a comment list": ("", "<section class='comments-area'><ol class='comment-list'>" + "".join(f"<li class='comment'><div class='body'><p>{sentence(i, 21)}</p></div></li>" for i in range(MANY)) + "</ol></section>"),
    "a thread": ("", "<div id='disqus_thread'>" + "".join(f"<div><p>{sentence(i, 30)}</p></div>" for i in range(MANY)) + "</div>"),
    "a long advert": ("", "<div class=promo>" + "".join(f"<p>{sentence(i, 40)}</p>" for i in range(6)) + "</div>"),
    "adverts first": ("<div class='ad-slot'><p>" + sentence(2, 60) + "</p></div>", "<div class='advert advert-bottom'><p>" + sentence(5, 70) + "</p></div>"),
    "a consent notice first": ("<div class=cookie-notice><p>" + sentence(3, 55) + "</p><p>" + sentence(6, 48) + "</p></div>", ""),
    "consent with a heading": ("<div id='cookie-consent' class='modal'><h2>We value you</h2><p>" + sentence(3, 80) + "</p><button>OK</button></div>", ""),
    "a newsletter": ("", "<div class='newsletter-signup'><h1>Read more of this</h1><p>" + sentence(7, 66) + "</p><form><input name=mail></form></div>"),
    "a sidebar": ("<div id=sidebar>" + "".join(f"<h3>Box {i}</h3><p>{sentence(i, 30)}</p>" for i in range(5)) + "</div>", ""),
    "related texts": ("", "<div class='related-posts'>" + "".join(f"<div><h4>{sentence(i, 5)}</h4><p>{sentence(i, 24)}</p></div>" for i in range(8)) + "</div>"),
    "all of them": ("<header><h1>The Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie-banner'><p>" + sentence(3, 50) + "</p></div>", "<div class='share-buttons'><a href=x>Share</a></div><div id=comments>" + "".join(f"<p>{sentence(i, 25)}</p>" for i in range(MANY)) + "</div><aside><p>" + sentence(8, 40) + "</p></aside><footer><p>© 2020 The Site, " + sentence(9, 20) + "</p></footer>"),
}


def page(shell, around, paragraphs, title="<h1>What happened</h1>"):
    before, after = AROUND[around]
    inside = title + "".join(f"<p>{x}</p>" for x in paragraphs)
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{SHELLS[shell].format(inside)}{after}</body></html>"


@pytest.mark.parametrize(("shell", "around"), list(itertools.product(SHELLS, AROUND)))
def test_only_the_article_comes_out(shell, around):
    for paragraphs in (SHORT, LONG, SHORT[:1]):
        assert main_text(page(shell, around, paragraphs)) == "\n".join(["What happened", *paragraphs])
        assert main_text(page(shell, around, paragraphs, "")) == "\n".join(paragraphs)


@pytest.mark.parametrize("around", AROUND)
def test_a_page_whose_wrapper_has_a_name_keeps_its_article(around):
    """Themes put a name of boilerplate on the element around all of the page, too."""
    before, after = AROUND[around]
    inside = "<h1>What happened</h1>" + "".join(f"<p>{x}</p>" for x in LONG)
    for name in ("sidebar", "page header-fixed", "notice"):
        got = main_text(f"<body><div class='{name}'>{before}<div class=text>{inside}</div>{after}</div></body>")
        assert got == "\n".join(["What happened", *LONG])


def articles(sizes, wrap="{}", between=""):
    one = lambda k, n: wrap.format(f"<article><h2>Part {k}</h2>" + "".join(f"<p>{sentence(i + k, 20)}</p>" for i in range(n)) + "</article>")
    want = "\n".join(x for k, n in enumerate(sizes) for x in [f"Part {k}", *[sentence(i + k, 20) for i in range(n)]])
    return between.join(one(k, n) for k, n in enumerate(sizes)), want


@pytest.mark.parametrize("outer", ["{}", "<main>{}</main>", "<div class=posts>{}</div>", "<main><div><section>{}</section></div></main>"])
@pytest.mark.parametrize("wrap", ["{}", "<div class=row>{}</div>"])
def test_several_articles_all_come_out(outer, wrap):
    for sizes in ((3, 9), (9, 3), (1, 12, 2), (4, 4, 4), (1, 1)):
        inside, want = articles(sizes, wrap)
        assert main_text(f"<body><nav><a href=/>Home</a></nav>{outer.format(inside)}<footer>About us</footer></body>") == want
        inside, want = articles(sizes, wrap, "<div class=ad><p>" + sentence(3, 40) + "</p></div>")
        assert main_text(f"<body>{outer.format(inside)}<div id=comments>{AROUND['reader comments'][1]}</div></body>") == want


def test_an_article_with_the_title_against_more_unnamed_text():
    other = "<div class=x>" + "".join(f"<p>{sentence(i, 25)}</p>" for i in range(MANY)) + "</div>"
    assert main_text(f"<body><article><h1>What happened</h1><p>{SHORT[0]}</p></article>{other}</body>") == "What happened\n" + SHORT[0]


def test_a_title_before_its_text():
    text = "".join(f"<p>{x}</p>" for x in LONG)
    for head in ("<h1>What happened</h1>", "<div class=title><h1>What happened</h1></div>"):
        assert main_text(f"<body><div class=menu><a href=x>x</a></div><div class=story>{head}<div class=text>{text}</div></div></body>") == "\n".join(["What happened", *LONG])
    byline = f"<div class=story><h1>What happened</h1><div class=by>By somebody, on Sunday</div><div class=text>{text}</div></div>"
    assert main_text(f"<body>{byline}</body>") == "\n".join(["What happened", "By somebody, on Sunday", *LONG])


def test_comments_alone_and_notices_alone():
    """What has no other text keeps what it has, as far as it is one element's."""
    comments = AROUND["reader comments"][1]
    assert main_text(f"<body><nav><a href=/>x</a></nav>{comments}</body>").count("\n") == MANY - 1
    assert main_text("<body><nav><a href=/>x</a></nav><footer><p>" + sentence(1, 20) + "</p></footer></body>") == ""
