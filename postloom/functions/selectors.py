"""Selectors over the element tree of `functions.markup`: what a per-page reader in `operators.html` asks of one parse.

A selector is a list of alternatives (`,`); each is a chain of compounds joined by a blank (somewhere below) or `>`
(directly below). A compound is a tag (`*` for any), `#id`, `.class`, and attribute tests: `[a]`, `[a=v]`, `[a~=v]`, `[a^=v]`, `[a*=v]`, `[a$=v]`, with
or without quotes. Anything else is an error when the selector is made, not when it meets a page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urljoin

from postloom.functions.markup import Node, tree

_COMPOUND = re.compile(r"""(?P<tag>[A-Za-z][\w-]*|\*)?(?P<rest>(?:\#[\w-]+|\.[\w-]+|\[\s*[\w:-]+\s*(?:[~^*$]?=\s*(?:"[^"]*"|'[^']*'|[^\]"'\s]+)\s*)?\])*)""")
_TEST = re.compile(r"""\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[~^*$]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]"'\s]+))\s*)?\]""")
_HOLDS = {"=": lambda have, want: have == want, "~=": lambda have, want: want in have.split(), "^=": lambda have, want: want != "" and have.startswith(want),
          "*=": lambda have, want: want != "" and want in have, "$=": lambda have, want: want != "" and have.endswith(want)}


class _Compound:
    def __init__(self, tag: str | None, rest: str):
        self.tag = tag.lower() if tag and tag != "*" else None
        self.tests = []
        for m in _TEST.finditer(rest):
            if m["id"]:
                self.tests.append(("id", "=", m["id"]))
            elif m["cls"]:
                self.tests.append(("class", "~=", m["cls"]))
            else:
                self.tests.append((m["name"].lower(), m["op"], next((m[g] for g in "abc" if m[g] is not None), "")))

    def fits(self, node: Node) -> bool:
        if self.tag is not None and node.tag != self.tag:
            return False
        for name, op, want in self.tests:
            if name not in node.attrs:
                return False
            if op is not None and not _HOLDS[op](node.attrs[name] or "", want):
                return False
        return True


class Selector:
    def __init__(self, text: str):
        self.chains = [self._chain(part.strip(), text) for part in re.split(r""",(?=(?:[^"']|"[^"]*"|'[^']*')*$)""", text)]

    @staticmethod
    def _chain(part: str, whole: str) -> list[tuple[str, _Compound]]:
        chain, at, link = [], 0, " "
        while at < len(part):
            m = _COMPOUND.match(part, at)
            if m.end() == at:
                raise ValueError(f"not a selector: {whole!r}")
            chain.append((link, _Compound(m["tag"], m["rest"])))
            gap = re.compile(r"\s*>\s*|\s+").match(part, m.end())
            if gap is None and m.end() < len(part):
                raise ValueError(f"not a selector: {whole!r}")
            at, link = (gap.end(), gap[0].strip() or " ") if gap else (m.end(), " ")
        if not chain or link == ">":
            raise ValueError(f"not a selector: {whole!r}")
        return chain

    def fits(self, node: Node) -> bool:
        return any(self._fits(node, chain, len(chain) - 1) for chain in self.chains)

    @staticmethod
    def _fits(node: Node, chain: list[tuple[str, _Compound]], last: int) -> bool:
        """From the last compound up through the open ancestors; a `>` step that fails goes back to the nearest free step."""
        if not chain[last][1].fits(node):
            return False
        spots, at, here = [], last, node  # spots: (compound, ancestor) to try next
        while True:
            if at == 0:
                return True
            link, here = chain[at][0], here.parent
            if link == " ":
                while here is not None and not chain[at - 1][1].fits(here):
                    here = here.parent
                if here is not None:
                    spots.append((at, here))
            elif here is not None and not chain[at - 1][1].fits(here):
                here = None
            if here is not None:
                at -= 1
                continue
            if not spots:
                return False
            at, here = spots.pop()  # that ancestor did not do: look further up from it


@lru_cache(256)
def selector(text: str) -> Selector:
    return Selector(text)


def select(root: Node, wanted: str) -> Iterator[Node]:
    """Elements below `root`, in page order."""
    fits = selector(wanted).fits
    return (node for node in root.walk() if fits(node))


def first(root: Node, wanted: str) -> Node | None:
    return next(select(root, wanted), None)


def closest(node: Node | None, wanted: str) -> Node | None:
    """The element itself or its nearest ancestor that fits."""
    fits = selector(wanted).fits
    while node is not None and node.tag != "#root":
        if fits(node):
            return node
        node = node.parent
    return None


def inside(node: Node | None, outer: Node) -> bool:
    while node is not None and node is not outer:
        node = node.parent
    return node is outer


def squeezed(node: Node) -> str:
    """Visible text with every run of white space as one blank."""
    return " ".join(node.text().split())


def nearest_text(node: Node, stop: Node, shorter_than: int) -> str:
    """The text of the nearest ancestor below `stop` that has one; texts only grow on the way up, so a long one ends the search."""
    here = node.parent
    while here is not None and here is not stop and here.tag != "#root":
        text = squeezed(here)
        if text:
            return text if len(text) < shorter_than else ""
        here = here.parent
    return ""


# How a listing marks its cards, in order of preference, and what their icons stand for.
TITLE_LINK = 'h2 a[href*="/job/"]'
COMPANY_LINK = 'a[href*="/company"]'
COMPANY_IMAGE = 'img[data-id="company-img"], img[alt*="Logo"]'
CARDS = ('div[id^="job-card-"]', ".job-bounded-responsive", '[class*="job"]')
ICONS = {"location": "fa-location-dot", "work_type": "fa-house-building", "compensation": "fa-sack-dollar", "level": "fa-trophy"}


def _company(link: Node) -> str:
    image = first(link, COMPANY_IMAGE)
    if image is not None and image.attrs.get("alt"):
        return image.attrs["alt"].replace(" Logo", "", 1).replace(" logo", "", 1).strip()
    span = first(link, "span")
    return (link if span is None else span).text().strip()


def cards_of(html: str | None, url: str | None, shorter_than: int = 100) -> list[dict]:
    """The listing cards of a page that have a title and a company; `card_no` counts all title links. A card is its element, so nothing
    behind its end tag belongs to it, and a company is looked for no further than in its card. With a `url` (or a `base` element) links
    are absolute."""
    if not html:
        return []
    with tree(html) as root:
        return _cards_below(root, url, shorter_than)


def _cards_below(root: Node, url: str | None, shorter_than: int) -> list[dict]:
    out = []
    base = first(root, "base[href]")
    base = urljoin(url or "", base.attrs["href"] or "") if base is not None else url
    for number, link in enumerate(select(root, TITLE_LINK)):
        box = closest(link, "div")
        card = next((c for c in (closest(link, s) for s in CARDS) if c is not None), box.parent if box is not None else None)
        company = first(box, COMPANY_LINK) if box is not None else None
        if company is None and box is not None and box is not card and card is not None and inside(box.parent, card):
            company = first(box.parent, COMPANY_LINK)
        title, name = link.text().strip(), _company(company) if company is not None else ""
        if not title or not name:
            continue
        row = {"card_no": number, "title": title, "link": urljoin(base, link.attrs["href"].strip()) if base else link.attrs["href"], "company": name}
        for field, mark in ICONS.items():
            icon = first(card, "." + mark) if card is not None else None
            row[field] = nearest_text(icon, card, shorter_than) if icon is not None else ""
        out.append(row)
    return out
