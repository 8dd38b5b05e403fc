"""Turns one page of HTML text into a flat, document-ordered node list.

This is the only per-row Python in the package: it follows the HTML tree-building rules that
change extraction results (implied and void elements, raw text, re-opened formatting, table
fix-ups) and emits flat columns; selecting and extracting is left to Spark expressions.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

from ..fixed import DROPPED_TAGS

VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source "
    "track wbr".split()
)
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset(("title", "textarea"))
HEAD_ONLY = frozenset(
    "base basefont bgsound link meta noframes script style template title noscript".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form header hgroup hr li dd dt listing main menu nav ol p plaintext pre "
    "search section summary table ul xmp".split()
)
BLOCK_END = (CLOSES_P - HEADINGS - {"p", "li", "dd", "dt", "hr", "table"}) | {"button"}
SPECIAL = CLOSES_P | VOID | RAW | frozenset(
    "applet body button caption colgroup frameset head html marquee noscript object select "
    "tbody td template textarea tfoot th thead title tr".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
TABLE_SCOPE = frozenset(("html", "table", "template"))
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SECTIONS = frozenset(("tbody", "thead", "tfoot"))
TABLE_PARTS = SECTIONS | {"tr", "td", "th", "caption", "colgroup", "col"}
FOSTER_CONTEXT = SECTIONS | {"table", "tr"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\t\n\f\r />]*)")
_ATTR = re.compile(
    r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?"
)
_TAG_END = re.compile(r"[\s/]*>")
_REFERENCE = re.compile(r"&(?:#\d+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*(?:;|(?!=)))")


def attribute_text(value: str) -> str:
    """Character references in an attribute: "&copy=1" and "&copyright" stay as they are."""

    def decode(found):
        text = found.group()
        if text.endswith(";") or text[1] == "#" or text[1:] in html5:
            return unescape(text)
        return text

    return _REFERENCE.sub(decode, value)


def tokens(html: str):
    """Yields ("text", data), ("start", name, attrs, self_closing) and ("end", name)."""
    pos, size = 0, len(html)
    raw_for = None
    while pos < size:
        if raw_for:
            close = re.compile(rf"</{raw_for}(?=[\s/>])", re.I).search(html, pos)
            stop = close.start() if close else size
            if stop > pos:
                data = html[pos:stop]
                yield "text", unescape(data) if raw_for in RCDATA else data
            pos, raw_for = stop, None
            continue
        lt = html.find("<", pos)
        if lt < 0:
            yield "text", unescape(html[pos:])
            return
        tag = _TAG.match(html, lt)
        if not tag:
            following = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                if html.startswith(("<!-->", "<!--->"), lt):
                    end = html.find(">", lt) + 1
                else:
                    ends = [e for e in (html.find("-->", lt + 4), html.find("--!>", lt + 4)) if e >= 0]
                    end = html.find(">", min(ends)) + 1 if ends else size
            elif following in ("!", "?") or (following == "/" and lt + 2 < size):
                end = html.find(">", lt) + 1 or size
            else:
                end = lt + 1  # a plain "<" is text and joins the text around it
                nxt = html.find("<", end)
                end = nxt if nxt >= 0 else size
                yield "text", unescape(html[pos:end])
                pos = end
                continue
            if lt > pos:
                yield "text", unescape(html[pos:lt])
            pos = end
            continue
        if lt > pos:
            yield "text", unescape(html[pos:lt])
        name, pos, attrs = tag.group(2).lower(), tag.end(), {}
        while not (end := _TAG_END.match(html, pos)):
            found = _ATTR.match(html, pos)
            if not found:
                break
            key = found.group(1).lower()
            if key not in attrs:
                value = next((g for g in found.group(2, 3, 4) if g is not None), "")
                attrs[key] = attribute_text(value) if "&" in value else value
            pos = found.end()
        if not end:
            return  # the input stops inside a tag: the tag is lost
        pos = end.end()
        if tag.group(1):
            yield "end", name
        else:
            yield "start", name, attrs, "/" in end.group()
            if name in RAW or name in RCDATA:
                raw_for = name


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=None, text=None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, None
        self.children = text if tag == "#text" else []


class TreeBuilder:
    def __init__(self):
        self.root = Node("#document")
        self.stack = [self.root]
        self.active = []  # formatting elements to re-open; None marks a cell or caption
        self.html = self.head = self.body = self.form = None

    # -- placing nodes -----------------------------------------------------------------
    def _place(self, node, target=None):
        target = target or self.stack[-1]
        children, before = target.children, None
        if target.tag in FOSTER_CONTEXT and not (
            node.tag in TABLE_PARTS or node.tag in ("script", "style", "template", "form")
            or (node.tag == "#text" and not node.children.strip())
        ):
            table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                target, before = table.parent, table
                children = target.children
        if before is not None:
            at = children.index(before)
            previous = children[at - 1] if at else None
        else:
            at, previous = len(children), children[-1] if children else None
        if node.tag == "#text" and previous is not None and previous.tag == "#text":
            previous.children += node.children
            return
        node.parent = target
        children.insert(at, node)

    def _open(self, tag, attrs=None):
        node = Node(tag, attrs)
        self._place(node)
        self.stack.append(node)
        return node

    def _in_scope(self, tag, extra=()):
        for node in reversed(self.stack):
            if node.tag == tag:
                return True
            if node.tag in SCOPE or node.tag in extra:
                return False
        return False

    def _in_table_scope(self, *tags):
        for node in reversed(self.stack):
            if node.tag in tags:
                return True
            if node.tag in TABLE_SCOPE:
                return False
        return False

    def _pop_to(self, *tags):
        while len(self.stack) > 1 and self.stack.pop().tag not in tags:
            pass

    def _pop_back_to(self, context):
        while len(self.stack) > 1 and self.stack[-1].tag not in context:
            self.stack.pop()

    def _imply_ends(self, but=None):
        while self.stack[-1].tag in IMPLIED_END and self.stack[-1].tag != but:
            self.stack.pop()

    def _close_p(self):
        if self._in_scope("p", ("button",)):
            self._imply_ends("p")
            self._pop_to("p")

    def _clear_to_marker(self):
        while self.active and self.active.pop() is not None:
            pass

    # -- formatting elements -----------------------------------------------------------
    def _reopen(self):
        at = len(self.active)
        while at and self.active[at - 1] is not None and self.active[at - 1] not in self.stack:
            at -= 1
        for i in range(at, len(self.active)):
            old = self.active[i]
            self.active[i] = self._open(old.tag, old.attrs)

    def _remember(self, node):
        same = []
        for other in reversed(self.active):
            if other is None:
                break
            if other.tag == node.tag and other.attrs == node.attrs:
                same.append(other)
        if len(same) >= 3:
            self.active.remove(same[-1])
        self.active.append(node)

    def _adopt(self, tag):
        """End tag of a formatting element: closes it and moves misnested content."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            fmt = None
            for other in reversed(self.active):
                if other is None:
                    break
                if other.tag == tag:
                    fmt = other
                    break
            if fmt is None:
                self._any_end(tag)
                return
            if fmt not in self.stack:
                self.active.remove(fmt)
                return
            if not self._in_scope(tag):
                return
            at = self.stack.index(fmt)
            block = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(fmt)
                return
            above, bookmark = self.stack[at - 1], self.active.index(fmt)
            last, level, inner = block, self.stack.index(block), 0
            while True:
                level -= 1
                node = self.stack[level]
                if node is fmt:
                    break
                inner += 1
                if inner > 3 and node in self.active:
                    gone = self.active.index(node)
                    bookmark -= gone < bookmark
                    del self.active[gone]
                if node not in self.active:
                    del self.stack[level]
                    continue
                copy = Node(node.tag, node.attrs)
                self.active[self.active.index(node)] = copy
                self.stack[level] = copy
                if last is block:
                    bookmark = self.active.index(copy) + 1
                if last.parent:
                    last.parent.children.remove(last)
                last.parent = copy
                copy.children.append(last)
                last = copy
            if last.parent:
                last.parent.children.remove(last)
            self._place(last, above)
            copy = Node(fmt.tag, fmt.attrs)
            copy.children, block.children = block.children, [copy]
            for child in copy.children:
                child.parent = copy
            copy.parent = block
            gone = self.active.index(fmt)
            del self.active[gone]
            self.active.insert(bookmark - (gone < bookmark), copy)
            self.stack.remove(fmt)
            self.stack.insert(self.stack.index(block) + 1, copy)

    # -- tokens ------------------------------------------------------------------------
    def _need_body(self):
        if self.body is None:
            if self.html is None:
                self.html = self._open("html")
            if self.head is None:
                self.head = self._open("head")
            self._pop_back_to(("html",))
            self.body = self._open("body")

    def text(self, data):
        data = data.replace("\0", "")
        if self.body is None:
            if self.stack[-1].tag in RAW or self.stack[-1].tag in RCDATA or self.stack[-1].tag in (
                "noscript", "template"
            ):
                self._place(Node("#text", text=data))
                return
            rest = data.lstrip("\t\n\f\r ")
            if self.html is not None and self.head is not None and len(rest) < len(data):
                self._place(Node("#text", text=data[: len(data) - len(rest)]))
            if not rest:
                return
            self._need_body()
            data = rest
        if not data:
            return
        if self.stack[-1].tag not in RAW and self.stack[-1].tag not in RCDATA and (
            data.strip() or self.stack[-1].tag not in FOSTER_CONTEXT
        ):
            self._reopen()
        self._place(Node("#text", text=data))

    def start(self, tag, attrs, self_closing):
        if tag == "image":
            tag = "img"
        if tag == "html":
            if self.html is None:
                self.html = self._open("html", attrs)
            else:
                self.html.attrs = {**attrs, **self.html.attrs}
            return
        if self.html is None:
            self.html = self._open("html")
        if self.body is None:
            top = self.stack[-1].tag
            if top in ("noscript", "template") or (top == "head" and tag in HEAD_ONLY):
                self._element(tag, attrs, self_closing)
                return
            if tag == "head":
                if self.head is None:
                    self.head = self._open("head", attrs)
                return
            if self.head is None:
                self.head = self._open("head")
            if tag in HEAD_ONLY:
                if self.stack[-1] is not self.head:
                    self.stack.append(self.head)
                self._element(tag, attrs, self_closing)
                return
            if tag == "body":
                self._pop_back_to(("html",))
                self.body = self._open("body", attrs)
                return
            self._need_body()
        elif tag == "body":
            self.body.attrs = {**attrs, **self.body.attrs}
            return
        elif tag == "head":
            return
        self._element(tag, attrs, self_closing)

    def _element(self, tag, attrs, self_closing):
        if any(n.tag in ("svg", "math") for n in self.stack) and tag not in CLOSES_P:
            self._open(tag, attrs)
            if self_closing or tag in VOID:
                self.stack.pop()
            return
        if tag in TABLE_PARTS and not self._table_part(tag):
            return
        if tag in CLOSES_P and not (tag == "form" and self.form is not None):
            if tag in ("li", "dd", "dt"):
                closes = ("li",) if tag == "li" else ("dd", "dt")
                for node in reversed(self.stack):
                    if node.tag in closes:
                        self._imply_ends(node.tag)
                        self._pop_to(node.tag)
                        break
                    if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                        break
            self._close_p()
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        elif tag == "form":
            if self.form is not None:
                return
            self.form = self._open("form", attrs)
            return
        elif tag == "button" and self._in_scope("button"):
            self._imply_ends()
            self._pop_to("button")
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self.stack.pop()
            if tag == "optgroup" and self.stack[-1].tag == "optgroup":
                self.stack.pop()
        elif tag in ("rb", "rp", "rt", "rtc") and self._in_scope("ruby"):
            self._imply_ends("rtc" if tag in ("rp", "rt") else None)
        elif tag == "table" and self.stack[-1].tag in FOSTER_CONTEXT and self._in_table_scope("table"):
            self._pop_to("table")
        elif tag == "a":
            for other in reversed(self.active):
                if other is None:
                    break
                if other.tag == "a":
                    self._adopt("a")
                    if other in self.active:
                        self.active.remove(other)
                    if other in self.stack:
                        self.stack.remove(other)
                    break
        elif tag == "nobr" and self._in_scope("nobr"):
            self._adopt("nobr")
        if tag not in CLOSES_P and tag not in TABLE_PARTS and tag not in HEAD_ONLY:
            self._reopen()
        node = self._open(tag, attrs)
        if tag in VOID:
            self.stack.pop()
        elif tag in FORMATTING:
            self._remember(node)
        elif tag in ("td", "th", "caption", "applet", "marquee", "object"):
            self.active.append(None)

    def _table_part(self, tag):
        """Closes and implies table structure before a table part; False drops the tag."""
        if not self._in_table_scope("table"):
            return any(n.tag == "template" for n in self.stack)
        if self._in_table_scope("td", "th"):
            self._pop_to("td", "th")
            self._clear_to_marker()
        if self._in_table_scope("caption"):
            self._pop_to("caption")
            self._clear_to_marker()
        if tag in SECTIONS or tag in ("caption", "colgroup"):
            self._pop_back_to(("table",))
        elif tag == "col":
            if self.stack[-1].tag != "colgroup":
                self._pop_back_to(("table",))
                self._open("colgroup")
        elif tag == "tr":
            self._pop_back_to(SECTIONS | {"table"})
            if self.stack[-1].tag == "table":
                self._open("tbody")
        else:
            self._pop_back_to(SECTIONS | {"table", "tr"})
            if self.stack[-1].tag == "table":
                self._open("tbody")
            if self.stack[-1].tag != "tr":
                self._open("tr")
        return True

    def end(self, tag):
        if self.body is None:
            if tag in ("head", "noscript", "template", *RAW, *RCDATA):
                if any(n.tag == tag for n in self.stack):
                    self._pop_to(tag)
                    if self.stack[-1] is self.head and tag != "head" and self.head_closed:
                        self.stack.pop()
                if tag == "head":
                    self.head_closed = True
                return
            if tag not in ("body", "html", "br", "p"):
                return
            self._need_body()
        if tag in ("body", "html"):
            return
        if tag == "br":
            self._element("br", {}, False)
        elif tag == "p":
            if not self._in_scope("p", ("button",)):
                self._element("p", {}, False)
            self._close_p()
        elif tag in FORMATTING:
            self._adopt(tag)
        elif tag in HEADINGS:
            if any(self._in_scope(h) for h in HEADINGS):
                self._imply_ends()
                self._pop_to(*HEADINGS)
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and node in self.stack:
                self._imply_ends()
                if node in self.stack:
                    self.stack.remove(node)
        elif tag in ("li", "dd", "dt"):
            if self._in_scope(tag, ("ol", "ul") if tag == "li" else ()):
                self._imply_ends(tag)
                self._pop_to(tag)
        elif tag in TABLE_PARTS or tag == "table":
            if self._in_table_scope(tag):
                self._pop_to(tag)
                if tag in ("td", "th", "caption"):
                    self._clear_to_marker()
        elif tag in BLOCK_END or tag in ("applet", "marquee", "object"):
            if self._in_scope(tag):
                self._imply_ends()
                self._pop_to(tag)
                if tag in ("applet", "marquee", "object"):
                    self._clear_to_marker()
        else:
            self._any_end(tag)

    head_closed = False

    def _any_end(self, tag):
        for node in reversed(self.stack):
            if node.tag == tag:
                self._imply_ends(tag)
                while self.stack.pop() is not node:
                    pass
                return
            if node.tag in SPECIAL or node.tag == "#document":
                return


def tree(html: str) -> Node:
    builder, skip_newline = TreeBuilder(), False
    for token in tokens(html.replace("\r\n", "\n").replace("\r", "\n")):
        if token[0] == "text":
            data = token[1][1:] if skip_newline and token[1].startswith("\n") else token[1]
            builder.text(data)
        elif token[0] == "start":
            builder.start(*token[1:])
        else:
            builder.end(token[1])
        skip_newline = token[0] == "start" and token[1] in ("pre", "listing", "textarea")
    builder._need_body()
    return builder.root


def flatten(root: Node):
    """One tuple per kept node, in document order, in the layout of schemas.NODE."""
    dropped = frozenset(DROPPED_TAGS)
    out, last_element = [], {}
    # An explicit stack keeps deeply nested pages clear of the recursion limit.
    todo = [(root, -1, (1, 1, 1, 1), [])]
    while todo:
        item = todo.pop()
        if len(item) == 2:  # leaving an element: its subtree is complete
            pre, rest = item
            out[pre] = (pre, len(out) - pre - 1, *rest)
            continue
        node, parent, place, path = item
        pre, prev = len(out), last_element.get(parent, -1)
        if node.tag == "#text":
            out.append((pre, 0, parent, prev, "#text", {}, (), 0, 0, 0, 0, path, node.children))
            continue
        out.append(None)
        last_element[parent] = pre
        classes = node.attrs.get("class")
        classes = classes.split() if classes else ()
        todo.append((pre, (parent, prev, node.tag, node.attrs, classes, *place, path, None)))
        totals, seen, n, below, batch = {}, {}, 0, path + [pre], []
        kept = [child for child in node.children if child.tag not in dropped]
        for child in kept:
            totals[child.tag] = totals.get(child.tag, 0) + 1
        elements = len(kept) - totals.get("#text", 0)
        for child in kept:
            place = None
            if child.tag != "#text":
                n += 1
                seen[child.tag] = seen.get(child.tag, 0) + 1
                place = (n, elements, seen[child.tag], totals[child.tag])
            batch.append((child, pre, place, below))
        todo.extend(reversed(batch))
    return out
