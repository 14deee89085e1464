"""A small reader for untidy HTML, used per row inside the Arrow UDFs of `operators.html`."""

from __future__ import annotations

import re
from contextlib import contextmanager
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}
LISTS = ("ul", "ol")


class Node:
    """An element; children are nodes and plain strings, `parent` is the element that was open around it."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs), [], parent

    def text(self):
        """The visible text below; kept on an own stack, because raw pages nest without bound."""
        out, left = [], list(reversed(self.children))
        while left:
            child = left.pop()
            if isinstance(child, str):
                out.append(child)
            elif child.tag not in HIDDEN:
                left.extend(reversed(child.children))
        return "".join(out)

    def free(self):
        """Take the tree apart: elements and their parents hold each other, so pages would pile up until the garbage collector runs."""
        left = [self]
        while left:
            node = left.pop()
            left.extend(c for c in node.children if isinstance(c, Node))
            node.children, node.parent = [], None

    def walk(self):
        left = [c for c in reversed(self.children) if isinstance(c, Node)]
        while left:
            node = left.pop()
            yield node
            left.extend(c for c in reversed(node.children) if isinstance(c, Node))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, attrs, self.open[-1]))

    def handle_endtag(self, tag):
        # An end tag closes everything opened since its start tag; one without a start tag is ignored.
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # `<![...` of any kind is skipped up to `>`

    def handle_data(self, data):
        self.open[-1].children.append(data)


def read(html: str) -> Node:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


@contextmanager
def tree(html: str):
    """The tree of a page for as long as it is looked at."""
    root = read(html)
    try:
        yield root
    finally:
        root.free()


def _inner_list(item: Node) -> Node | None:
    found = (next((n for n in item.walk() if n.tag == tag), None) for tag in LISTS)
    return next(found) or next(found)


def _label(item: Node, inner: Node | None) -> str:
    """An item's own text: all of it, or what stands before the list inside it."""
    if inner is None:
        words = item.text().strip()
    else:
        own = item.children[:item.children.index(inner)] if inner in item.children else item.children
        words = " ".join(c.strip() if isinstance(c, str) else c.text().strip() for c in own
                         if isinstance(c, str) or c.tag not in LISTS).strip()
    return re.sub(r"\s+:", ":", words)


def _list_lines(node: Node) -> list[str]:
    lines, left = [], [(node, 0)]
    while left:
        here, depth = left.pop()
        if here.tag != "li":
            left.extend((c, depth) for c in reversed(here.children) if isinstance(c, Node) and c.tag == "li")
            continue
        inner = _inner_list(here)
        if label := _label(here, inner):
            lines.append("  " * depth + "- " + label)
        if inner is not None:
            left.append((inner, depth + 1))
    return lines


def _flow(root: Node) -> str:
    """Running text of an element; what is still to come lies on a stack, closing breaks included."""
    out, left = [], list(reversed(root.children))
    while left:
        part = left.pop()
        if isinstance(part, str):
            out.append(part)
        elif part.tag in LISTS:
            out.append("\n\n" + "\n".join(_list_lines(part)) + "\n\n")
        elif part.tag == "br":
            out.append("\n")
        elif part.tag not in HIDDEN:
            rim = ["\n\n"] if part.tag in ("p", "div") else []
            left.extend([*rim, *reversed(part.children), *rim])
    return "".join(out)


def to_markdown(html: str | None) -> str:
    """Lists as `- ` with two blanks per level, blocks apart by one empty line, inline tags dropped."""
    if not html:
        return ""
    with tree(html) as root:
        text = re.sub(r"\n\n\n+", "\n\n", _flow(root))
    text = re.sub(r"(?<=[^ \t\n])[ \t]+", " ", text)
    for odd, plain in (("\xa0", " "), ("\u200b", ""), ("\u2028", " "), ("\u2029", " "), ("\u2003", " ")):
        text = text.replace(odd, plain)
    return text.strip()


def pills_after(html: str | None, heading: str, heading_tag: str, containers: tuple[str, ...],
                tags: tuple[str, ...], classes: str | None) -> list[str]:
    """Texts of the marked elements inside the first container that follows each matching heading."""
    if not html:
        return []
    wanted = re.compile(classes, re.I) if classes else None
    found = []
    with tree(html) as root:
        nodes = list(root.walk())
        for at, node in enumerate(nodes):
            if node.tag == heading_tag and heading in node.text():
                box = next((n for n in nodes[at + 1:] if n.tag in containers), None)
                if box is not None:
                    found += [n.text().strip() for n in box.walk() if n.tag in tags
                              and (wanted is None or wanted.search(n.attrs.get("class") or ""))]
    return found
