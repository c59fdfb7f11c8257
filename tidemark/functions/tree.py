"""Trees of HTML pages, built from their events by the rules that browsers follow for markup that isn't well formed: end
tags that are left out, formatting that overlaps other elements, text that stands in a table outside its cells.

What the page's head has is put where it stands. Elements deeper than ``DEEPEST`` are put beside each other, and no more
than ``MOST_FORMATS`` open formats are carried on, so that a page of any kind takes time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

from tidemark.functions.markup import MarkupReader

DEEPEST, MOST_FORMATS = 512, 64

#: The kinds of elements that the rules speak of.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing "
    "main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table "
    "tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATS = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MARKED = frozenset("applet marquee object".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes script style template title".split())
SCOPE = frozenset("applet caption html table td th marquee object template foreignobject desc annotation-xml mi mo mn ms mtext".split())
BUTTON_SCOPE, LIST_SCOPE, TABLE_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul"}, frozenset(("html", "table", "template"))
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
BODIES = frozenset("tbody tfoot thead".split())
IN_TABLE = BODIES | {"table", "tr"}
#: Elements whose content is text only, whatever it looks like.
OPAQUE = frozenset(("iframe", "noscript"))
#: In these, markup of other languages ends at an element of HTML.
FOREIGN, WITHIN_FOREIGN = frozenset(("svg", "math")), frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var".split()
)


class Node:
    """An element, or a text: ``tag`` is empty. Children are linked, so that one goes before another without a search."""

    __slots__ = ("attrs", "first", "foreign", "last", "next", "parent", "prev", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = "", foreign: bool = False):
        self.tag, self.attrs, self.text, self.foreign = tag, attrs or {}, text, foreign
        self.parent = self.first = self.last = self.prev = self.next = None

    def remove(self) -> None:
        if self.parent is None:
            return
        if self.prev is None:
            self.parent.first = self.next
        else:
            self.prev.next = self.next
        if self.next is None:
            self.parent.last = self.prev
        else:
            self.next.prev = self.prev
        self.parent = self.prev = self.next = None

    def insert(self, child: Node, before: Node | None = None) -> None:
        child.remove()
        child.parent, child.next = self, before
        child.prev = self.last if before is None else before.prev
        if child.prev is None:
            self.first = child
        else:
            child.prev.next = child
        if before is None:
            self.last = child
        else:
            before.prev = child

    def walk(self, skip: frozenset[str] = frozenset()) -> Iterator[Node]:
        """All nodes below in the page's order, without what is in elements of ``skip``; those come out themselves."""
        node = self.first
        while node is not None:
            yield node
            if node.first is not None and node.tag not in skip:
                node = node.first
                continue
            while node is not self and node.next is None:
                node = node.parent
            node = None if node is self else node.next

    def content(self) -> str:
        """All texts below, with single blanks between words."""
        return " ".join("".join(n.text for n in self.walk() if not n.tag).split())


class TreeBuilder(MarkupReader):
    """Builds ``root`` while events stream by. ``formats`` are the open formats, None standing for a border that they are
    not carried over."""

    def __init__(self):
        super().__init__()
        self.root, self.body = Node("html"), Node("body")
        self.root.insert(self.body)
        self.stack: list[Node] = [self.root, self.body]
        self.formats: list[Node | None] = []
        self.form: Node | None = None
        self.mode = self.in_body
        self.opaque: str | None = None
        self.fostering = self.after_pre = False

    # --- events

    def handle_starttag(self, tag, attrs):
        if self.opaque:
            return
        self.after_pre = False
        self.start(tag, {k: v or "" for k, v in reversed(attrs)}, False)  # of repeated attributes the first counts

    def handle_startendtag(self, tag, attrs):
        if self.opaque:
            return
        self.after_pre = False
        self.start(tag, {k: v or "" for k, v in reversed(attrs)}, True)

    def handle_endtag(self, tag):
        if self.opaque:
            if tag == self.opaque:
                self.opaque = None
                self.stack.pop()
            return
        self.after_pre = False
        self.end(tag)

    def handle_data(self, data):
        if self.opaque:
            return
        data = data.replace("\0", "")
        if self.after_pre:
            data, self.after_pre = data.removeprefix("\n"), False
        if not data:
            return
        top = self.stack[-1]
        if top.tag in IN_TABLE and not top.foreign and self.mode in (self.in_table, self.in_table_body, self.in_row) and data.strip(" \t\r\n\f"):
            self.foster(lambda: self.text(data))
        elif self.mode == self.in_column_group and data.strip(" \t\r\n\f"):
            self.stack.pop()
            self.mode = self.in_table
            self.foster(lambda: self.text(data))
        else:
            self.text(data)

    def raw(self, tag, content):
        from html import unescape

        if self.opaque or self.stack[-1].tag != tag:
            return
        if tag == "textarea":
            content = content.removeprefix("\n")
        content = unescape(content) if tag in ("title", "textarea") else content
        if content:
            self.stack[-1].insert(Node("", text=content))

    # --- the stack

    def place(self) -> tuple[Node, Node | None]:
        """Where a new node goes: a parent, and the child that it goes before."""
        top = self.stack[-1]
        if self.fostering and top.tag in IN_TABLE and not top.foreign:
            return self.foster_place()
        return top, None

    def foster_place(self) -> tuple[Node, Node | None]:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == "template":
                return self.stack[k], None
            if self.stack[k].tag == "table":
                table = self.stack[k]
                return (table.parent, table) if table.parent is not None else (self.stack[k - 1], None)
        return self.root, None

    def insert(self, tag: str, attrs: dict[str, str] | None = None, push: bool = True, foreign: bool = False) -> Node:
        node = Node(tag, attrs, foreign=foreign)
        parent, before = self.place()
        parent.insert(node, before)
        if push and len(self.stack) < DEEPEST:
            self.stack.append(node)
        return node

    def text(self, data: str) -> None:
        if self.mode == self.in_body or self.mode in (self.in_cell, self.in_caption) or self.fostering:
            self.reopen()
        parent, before = self.place()
        parent.insert(Node("", text=data), before)

    def foster(self, do) -> None:
        self.fostering = True
        try:
            do()
        finally:
            self.fostering = False

    def within(self, tags: frozenset[str], scope: frozenset[str] = SCOPE) -> bool:
        for node in reversed(self.stack):
            if node.tag in tags and not node.foreign:
                return True
            if node.tag in scope:
                return False
        return False

    def has(self, tag: str, scope: frozenset[str] = SCOPE) -> bool:
        return self.within(frozenset((tag,)), scope)

    def pop_until(self, tags: frozenset[str]) -> None:
        while len(self.stack) > 2:
            if self.stack.pop().tag in tags:
                return

    def pop_to(self, tags: frozenset[str]) -> None:
        """Closes elements until one of these is the innermost."""
        while len(self.stack) > 2 and self.stack[-1].tag not in tags:
            self.stack.pop()

    def close_implied(self, but: str = "") -> None:
        while self.stack[-1].tag in IMPLIED and self.stack[-1].tag != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.has("p", BUTTON_SCOPE):
            self.close_implied("p")
            self.pop_until(frozenset(("p",)))

    # --- open formats

    def reopen(self) -> None:
        """Opens formats again that an element's end closed."""
        if not self.formats or self.formats[-1] is None or len(self.stack) >= DEEPEST or self.formats[-1] in self.stack:
            return
        k = len(self.formats) - 1
        while k > 0 and self.formats[k - 1] is not None and self.formats[k - 1] not in self.stack:
            k -= 1
        for i in range(k, len(self.formats)):
            old = self.formats[i]
            self.formats[i] = self.insert(old.tag, old.attrs)

    def add_format(self, node: Node) -> None:
        same = []
        for k in range(len(self.formats) - 1, -1, -1):
            f = self.formats[k]
            if f is None:
                break
            if f.tag == node.tag and f.attrs == node.attrs:
                same.append(k)
        if len(same) >= 3:
            del self.formats[same[-1]]
        self.formats.append(node)
        if len(self.formats) > MOST_FORMATS:
            del self.formats[0]

    def clear_formats(self) -> None:
        while self.formats and self.formats.pop() is not None:
            pass

    def open_format(self, tag: str) -> Node | None:
        for f in reversed(self.formats):
            if f is None:
                return None
            if f.tag == tag:
                return f
        return None

    def end_format(self, tag: str) -> None:
        """Ends a format that may overlap other elements: what it still holds of them gets a format of its own."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.formats:
            self.stack.pop()
            return
        for _ in range(8):
            f = self.open_format(tag)
            if f is None:
                self.end_other(tag)
                return
            if f not in self.stack:
                self.formats.remove(f)
                return
            if not self.has(tag):
                return
            at = self.stack.index(f)
            block = next((k for k in range(at + 1, len(self.stack)) if self.stack[k].tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.formats.remove(f)
                return
            furthest, around = self.stack[block], self.stack[at - 1]
            mark = self.formats.index(f)
            last, k, steps = furthest, block, 0
            while True:
                k -= 1
                node = self.stack[k]
                if node is f:
                    break
                steps += 1
                if steps > 3 and node in self.formats:
                    i = self.formats.index(node)
                    del self.formats[i]
                    mark -= i < mark
                if node not in self.formats:
                    del self.stack[k]
                    continue
                copy = Node(node.tag, node.attrs)
                i = self.formats.index(node)
                self.formats[i] = self.stack[k] = copy
                if last is furthest:
                    mark = i + 1
                copy.insert(last)
                last = copy
            if around.tag in IN_TABLE:
                parent, before = self.foster_place()
                parent.insert(last, before)
            else:
                around.insert(last)
            copy = Node(f.tag, f.attrs)
            while furthest.first is not None:
                copy.insert(furthest.first)
            furthest.insert(copy)
            i = self.formats.index(f)
            del self.formats[i]
            self.formats.insert(mark - (i < mark), copy)
            self.stack.remove(f)
            self.stack.insert(self.stack.index(furthest) + 1, copy)

    # --- tags

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        top = self.stack[-1]
        if top.foreign and top.tag not in WITHIN_FOREIGN:
            if tag not in BREAKOUT and not (tag == "font" and {"color", "face", "size"} & attrs.keys()):
                self.insert(tag, attrs, not closed, True)
                return
            while self.stack[-1].foreign and self.stack[-1].tag not in WITHIN_FOREIGN:
                self.stack.pop()
        self.mode(tag, attrs)

    def end(self, tag: str) -> None:
        if self.stack[-1].foreign:
            for k in range(len(self.stack) - 1, 1, -1):
                if not self.stack[k].foreign:
                    break
                if self.stack[k].tag == tag:
                    del self.stack[k:]
                    return
        self.mode(tag, None)

    def in_body(self, tag: str, attrs: dict[str, str] | None) -> None:
        if attrs is None:
            self.end_in_body(tag)
        else:
            self.start_in_body(tag, attrs)

    def start_in_body(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body", "head", "frameset", "frame") or tag in TABLE_PARTS:
            return
        if tag in IN_HEAD:
            self.insert(tag, attrs, tag not in VOID)
            if tag == "template":
                self.formats.append(None)
        elif tag in BLOCKS or tag in ("pre", "listing", "plaintext", "xmp"):
            self.close_p()
            if tag == "xmp":
                self.reopen()
            self.insert(tag, attrs)
            self.after_pre = tag in ("pre", "listing")
        elif tag in HEADINGS:
            self.close_p()
            if self.stack[-1].tag in HEADINGS:
                self.stack.pop()
            self.insert(tag, attrs)
        elif tag == "form":
            if self.form is None or self.has("template", frozenset()):
                self.close_p()
                node = self.insert(tag, attrs)
                self.form = self.form or node
        elif tag in ("li", "dd", "dt"):
            same = ("li",) if tag == "li" else ("dd", "dt")
            for node in reversed(self.stack):
                if node.tag in same:
                    self.close_implied(node.tag)
                    self.pop_until(frozenset((node.tag,)))
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(tag, attrs)
        elif tag == "button":
            if self.has("button"):
                self.close_implied()
                self.pop_until(frozenset(("button",)))
            self.reopen()
            self.insert(tag, attrs)
        elif tag in FORMATS:
            if tag == "a" and (old := self.open_format("a")) is not None:
                self.end_format("a")
                if old in self.formats:
                    self.formats.remove(old)
                if old in self.stack:
                    self.stack.remove(old)
            self.reopen()
            if tag == "nobr" and self.has("nobr"):
                self.end_format("nobr")
                self.reopen()
            self.add_format(self.insert(tag, attrs))
        elif tag in MARKED:
            self.reopen()
            self.insert(tag, attrs)
            self.formats.append(None)
        elif tag == "table":
            self.close_p()
            self.insert(tag, attrs)
            self.mode = self.in_table
        elif tag == "hr":
            self.close_p()
            self.insert(tag, attrs, False)
        elif tag == "image" or tag in VOID:
            if tag not in ("param", "source", "track"):
                self.reopen()
            self.insert("img" if tag == "image" else tag, attrs, False)
        elif tag in OPAQUE:
            self.opaque = tag
            self.stack.append(self.insert(tag, attrs, False))
        elif tag == "select":
            self.reopen()
            self.insert(tag, attrs)
            self.mode = self.in_select
        elif tag in ("optgroup", "option"):
            if self.stack[-1].tag == "option":
                self.stack.pop()
            self.reopen()
            self.insert(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.has("ruby"):
                self.close_implied("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
        else:
            self.reopen()
            self.insert(tag, attrs, foreign=tag in FOREIGN)

    def end_in_body(self, tag: str) -> None:
        own = frozenset((tag,))
        if tag in ("html", "body", "head"):
            return
        if tag == "template":
            if self.has("template", frozenset()):
                self.pop_until(own)
                self.clear_formats()
                self.reset_mode()
        elif tag == "p":
            if not self.has("p", BUTTON_SCOPE):
                self.insert("p")
            self.close_p()
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and node in self.stack and self.has("form"):
                self.close_implied()
                if node in self.stack:
                    self.stack.remove(node)
        elif tag in BLOCKS or tag in ("button", "pre", "listing"):
            if self.has(tag):
                self.close_implied()
                self.pop_until(own)
        elif tag in ("li", "dd", "dt"):
            if self.has(tag, LIST_SCOPE if tag == "li" else SCOPE):
                self.close_implied(tag)
                self.pop_until(own)
        elif tag in HEADINGS:
            if self.within(HEADINGS):
                self.close_implied()
                self.pop_until(HEADINGS)
        elif tag in FORMATS:
            self.end_format(tag)
        elif tag in MARKED:
            if self.has(tag):
                self.close_implied()
                self.pop_until(own)
                self.clear_formats()
        elif tag == "br":
            self.start_in_body("br", {})
        else:
            self.end_other(tag)

    def end_other(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 1, -1):
            if self.stack[k].tag == tag:
                self.close_implied(tag)
                del self.stack[min(k, len(self.stack)) :]
                return
            if self.stack[k].tag in SPECIAL:
                return

    # --- tables

    def reset_mode(self) -> None:
        modes = {"select": self.in_select, "td": self.in_cell, "th": self.in_cell, "tr": self.in_row, "caption": self.in_caption, "colgroup": self.in_column_group, "table": self.in_table}
        for node in reversed(self.stack):
            if node.tag in modes or node.tag in BODIES or node.tag == "template":
                self.mode = modes.get(node.tag, self.in_table_body if node.tag in BODIES else self.in_body)
                return
        self.mode = self.in_body

    def in_table(self, tag: str, attrs: dict[str, str] | None) -> None:
        context = frozenset(("table", "template"))
        if attrs is None:
            if tag == "table":
                if self.has("table", TABLE_SCOPE):
                    self.pop_until(frozenset(("table",)))
                    self.reset_mode()
            elif tag == "template":
                self.end_in_body(tag)
            elif tag not in TABLE_PARTS and tag not in ("body", "html"):
                self.foster(lambda: self.end_in_body(tag))
        elif tag == "caption":
            self.pop_to(context)
            self.formats.append(None)
            self.insert(tag, attrs)
            self.mode = self.in_caption
        elif tag in ("colgroup", "col"):
            self.pop_to(context)
            self.insert("colgroup", attrs if tag == "colgroup" else {})
            self.mode = self.in_column_group
            if tag == "col":
                self.mode(tag, attrs)
        elif tag in BODIES or tag in ("tr", "td", "th"):
            self.pop_to(context)
            self.insert(tag if tag in BODIES else "tbody", attrs if tag in BODIES else {})
            self.mode = self.in_table_body
            if tag not in BODIES:
                self.mode(tag, attrs)
        elif tag == "table":
            if self.has("table", TABLE_SCOPE):
                self.pop_until(frozenset(("table",)))
                self.reset_mode()
                self.mode(tag, attrs)
        elif tag in ("style", "script", "template"):
            self.start_in_body(tag, attrs)
        elif tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.insert(tag, attrs, False)
        elif tag == "form":
            if self.form is None:
                self.form = self.insert(tag, attrs, False)
        else:
            self.foster(lambda: self.start_in_body(tag, attrs))

    def in_table_body(self, tag: str, attrs: dict[str, str] | None) -> None:
        context = BODIES | {"template"}
        if attrs is not None and tag in ("tr", "td", "th"):
            self.pop_to(context)
            self.insert("tr", attrs if tag == "tr" else {})
            self.mode = self.in_row
            if tag != "tr":
                self.mode(tag, attrs)
        elif attrs is None and tag in BODIES:
            if self.has(tag, TABLE_SCOPE):
                self.pop_to(context)
                self.stack.pop()
                self.mode = self.in_table
        elif attrs is None and tag == "table" or attrs is not None and tag in TABLE_PARTS:
            if self.within(BODIES, TABLE_SCOPE):
                self.pop_to(context)
                self.stack.pop()
                self.mode = self.in_table
                self.mode(tag, attrs)
        else:
            self.in_table(tag, attrs)

    def end_row(self) -> bool:
        if not self.has("tr", TABLE_SCOPE):
            return False
        self.pop_to(frozenset(("tr", "template")))
        self.stack.pop()
        self.mode = self.in_table_body
        return True

    def in_row(self, tag: str, attrs: dict[str, str] | None) -> None:
        if attrs is not None and tag in ("td", "th"):
            self.pop_to(frozenset(("tr", "template")))
            self.insert(tag, attrs)
            self.mode = self.in_cell
            self.formats.append(None)
        elif attrs is None and tag == "tr":
            self.end_row()
        elif attrs is None and (tag == "table" or tag in BODIES and self.has(tag, TABLE_SCOPE)) or attrs is not None and tag in TABLE_PARTS:
            if self.end_row():
                self.mode(tag, attrs)
        else:
            self.in_table(tag, attrs)

    def close_cell(self) -> None:
        self.close_implied()
        self.pop_until(frozenset(("td", "th")))
        self.clear_formats()
        self.mode = self.in_row

    def in_cell(self, tag: str, attrs: dict[str, str] | None) -> None:
        if attrs is None and tag in ("td", "th"):
            if self.has(tag, TABLE_SCOPE):
                self.close_cell()
        elif attrs is None and (tag == "table" or tag == "tr" or tag in BODIES):
            if self.has(tag, TABLE_SCOPE):
                self.close_cell()
                self.mode(tag, attrs)
        elif attrs is not None and tag in TABLE_PARTS:
            if self.within(frozenset(("td", "th")), TABLE_SCOPE):
                self.close_cell()
                self.mode(tag, attrs)
        elif attrs is not None or tag not in ("body", "caption", "col", "colgroup", "html"):
            self.in_body(tag, attrs)

    def in_caption(self, tag: str, attrs: dict[str, str] | None) -> None:
        ends = attrs is None and tag in ("caption", "table") or attrs is not None and tag in TABLE_PARTS
        if ends:
            if self.has("caption", TABLE_SCOPE):
                self.close_implied()
                self.pop_until(frozenset(("caption",)))
                self.clear_formats()
                self.mode = self.in_table
                if tag != "caption" or attrs is not None:
                    self.mode(tag, attrs)
        elif attrs is not None or tag not in TABLE_PARTS and tag not in ("body", "html"):
            self.in_body(tag, attrs)

    def in_column_group(self, tag: str, attrs: dict[str, str] | None) -> None:
        if attrs is not None and tag == "col":
            self.insert(tag, attrs, False)
        elif tag == "template":
            self.in_body(tag, attrs)
        elif attrs is None and tag == "col":
            pass
        elif self.stack[-1].tag == "colgroup":
            self.stack.pop()
            self.mode = self.in_table
            if not (attrs is None and tag == "colgroup"):
                self.mode(tag, attrs)

    def in_select(self, tag: str, attrs: dict[str, str] | None) -> None:
        top, own = self.stack[-1].tag, frozenset(("select",))
        in_table = self.within(frozenset(("td", "th", "caption", "table")), frozenset(("html", "template")))
        if attrs is None:
            if tag == "optgroup":
                if top == "option" and len(self.stack) > 1 and self.stack[-2].tag == "optgroup":
                    self.stack.pop()
                if self.stack[-1].tag == "optgroup":
                    self.stack.pop()
            elif tag == "option":
                if top == "option":
                    self.stack.pop()
            elif tag == "select":
                self.pop_until(own)
                self.reset_mode()
            elif tag == "template":
                self.end_in_body(tag)
            elif in_table and (tag == "table" or tag in TABLE_PARTS) and self.has(tag, TABLE_SCOPE):
                self.pop_until(own)
                self.reset_mode()
                self.mode(tag, attrs)
        elif tag in ("option", "optgroup", "hr"):
            if top == "option":
                self.stack.pop()
            if tag != "option" and self.stack[-1].tag == "optgroup":
                self.stack.pop()
            self.insert(tag, attrs, tag != "hr")
        elif tag == "select" or tag in ("input", "keygen", "textarea") or in_table and (tag == "table" or tag in TABLE_PARTS):
            self.pop_until(own)
            self.reset_mode()
            if tag != "select":
                self.mode(tag, attrs)
        elif tag in ("script", "template"):
            self.start_in_body(tag, attrs)


def tree(page: str) -> Node:
    """The page's root element."""
    builder = TreeBuilder()
    builder.read(page)
    return builder.root
