"""Events of HTML pages from the standard library's parser, for any text and in linear time.

The parser alone raises on unknown marked sections and on very long character references, waits for the rest of a tag
that never ends, and then tries each later one again. Here a page is cut into tags, comments and text first, and the
parser gets one complete tag at a time.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

#: Decimal references longer than any character's are cut: they stand for no character anyway.
LONG_REFERENCE = re.compile(r"&#0*(?:([1-9][0-9]{7,})|(?=[0-9]))")
TAG = re.compile(r"""</?[a-zA-Z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Elements whose content is text up to their end tag.
RAW = frozenset(("script", "style", "title", "textarea", "xmp", "noembed", "noframes"))


class MarkupReader(HTMLParser):
    """``read`` sends a page's events to the handlers of the standard parser.

    A tag ends at the first > outside quotes; where quotes never end, at the first >; without any >, the rest is text.
    Comments end at their mark, or at the first > if it is missing; declarations and marked sections at the first >.
    ``raw`` is called with the name and content of elements that hold text only (scripts, titles); such an element
    without an end tag holds the rest of the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def raw(self, tag: str, content: str) -> None:
        pass

    def read(self, page: str) -> None:
        if "&#" in page:
            page = LONG_REFERENCE.sub(lambda m: "&#9999999" if m[1] else "&#", page)
        at, quotes, comments, last = 0, True, True, page.rfind(">")
        while (m := MARKUP.search(page, at)) and m.start() <= last:
            begin = m.start()
            if begin > at:
                self.handle_data(unescape(page[at:begin]))
            if name := NAME.match(page, begin):
                whole = TAG.match(page, begin) if quotes else None
                if whole is None:
                    quotes = False  # a quote that never ends protects nothing, nor do later ones
                at = whole.end() if whole else page.index(">", begin) + 1
                self.one_tag(page[begin:at])
                if page[begin + 1] != "/" and name[1].lower() in RAW:
                    at = self.raw_content(page, at, name[1].lower())
                continue
            end = page.find("-->", begin + 4) if comments and page.startswith("<!--", begin) else -1
            if page.startswith("<!--", begin) and end < 0:
                comments = False
            at = end + 3 if end >= 0 else page.index(">", begin) + 1
        if at < len(page):
            self.handle_data(unescape(page[at:]))

    def one_tag(self, tag: str) -> None:
        self.cdata_elem = None
        self.rawdata = ""
        self.feed(tag)
        if self.rawdata:  # quotes that don't match: the name is all that is certain
            self.rawdata = ""
            self.feed(NAME.match(tag)[0] + ">")

    def raw_content(self, page: str, at: int, name: str) -> int:
        end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
        self.raw(name, page[at : end.start() if end else len(page)])
        if not end:
            return len(page)
        self.one_tag(f"</{name}>")
        return end.end()
