"""One pass over a page's HTML: a tree, and from it blocks, table cells, links and media.

The tree is built with the ends that HTML leaves out. All walks are loops over explicit stacks,
and each part of a page is visited a fixed number of times, so hostile nesting costs no more than
its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

# fixed values: elements by role
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template".split())
HEADINGS = {f"h{k}": k for k in range(1, 7)}
_LINES = frozenset("p div section article main aside header footer nav form fieldset figure figcaption blockquote address details summary li ul ol dl dt dd table caption pre".split()) | frozenset(HEADINGS)
_BARE = frozenset("div section article main aside form figure figcaption body header footer nav blockquote address fieldset ul ol dl".split())
_SECTIONS = frozenset("article aside main section".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo".split())
_ITEMS = frozenset("tr li p dd dt".split()) | frozenset(HEADINGS)
_CONTROLS = frozenset("button input select textarea".split())
#: an element whose start ends an open one of the first kind, unless one of the second kind was opened in between
_ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",))}
_ENDS |= {tag: (("thead", "tbody", "tfoot"), ("table",)) for tag in ("thead", "tbody", "tfoot")}
_PARAGRAPH_ENDS = (_LINES | {"ul", "ol", "hr"}) - {"summary", "caption"}
_FENCES = ("table", "td", "th", "button")
_ROWS = frozenset("tr thead tbody tfoot".split())
# fixed values: class names
_ACCORDION_TITLE = re.compile(r"(?:accordion|faq)\S*(?:title|header|question|trigger)", re.I)
_ACCORDION_PANEL = re.compile(r"(?:accordion|faq)\S*(?:panel|content|answer)", re.I)
_CARD = re.compile(r"(?:^|[-_])card(?:$|__item$|[-_]item$)", re.I)
SHORT, CONTEXT_CHARS, MOST_SPAN = 60, 600, 1000


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "title", "panel", "card", "pairs", "paired", "label", "consumed", "hidden")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.title = self.panel = self.label = None  # of an accordion's parts their container; of a stat card's heading its label
        self.card = self.paired = self.consumed = False
        self.pairs: list[Node] = []
        style = (attrs.get("style") or "").replace(" ", "").lower()
        self.hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class Tree(HTMLParser):
    """Builds the tree; open elements are counted by name, so no end tag searches the stack in vain."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.stack, self.open = [self.root], {}
        # behind the last ">" no tag is whole: text up to a "<" counts, the rest is dropped
        whole = page.rfind(">") + 1
        self.feed(page[:whole])
        self.close()
        if rest := page[whole:].partition("<")[0]:
            self.handle_data(unescape(rest))

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.open[self.stack.pop().tag].pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends, fence = _ENDS.get(tag, ((), ()))
        place = self._last(ends)
        if place > 0 and place > self._last(fence):
            self._pop_to(place)
        if tag in _PARAGRAPH_ENDS:
            place = self._last(("p",))
            if place > 0 and place > self._last(_FENCES):
                self._pop_to(place)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        place = self._last((tag,))
        fence = ("table",) if tag in _ROWS else _FENCES
        if place > 0 and (tag in _FENCES or place > self._last(fence)):
            self._pop_to(place)

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def walk(root: Node) -> Iterator[tuple[bool, Node | str]]:
    """(enters, node or text) in reading order without hidden and silent parts; elements also when they are left."""
    stack: list = [(True, root)]
    while stack:
        enters, node = stack.pop()
        yield enters, node
        if enters and isinstance(node, Node):
            stack.append((False, node))
            stack += [(True, c) for c in reversed(node.children) if isinstance(c, str) or not (c.hidden or c.tag in _SILENT)]


def clean(text: str) -> str:
    """Lines trimmed, white space inside them single, empty lines out."""
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def text_of(root: Node, most: int = 1 << 60) -> str:
    parts, size = [], 0
    for enters, node in walk(root):
        if isinstance(node, str):
            parts.append(node.replace("\n", " "))
            size += len(node)
            if size > 2 * most + 1000:
                break
        elif node.tag in _LINES or node.tag in ("br", "tr"):
            parts.append("\n")
        elif node.tag in ("td", "th"):
            parts.append(" ")
    return clean("".join(parts))[:most]


def _mark(root: Node) -> None:
    """Finds accordions, cards, definition pairs and stat cards, children before parents."""
    texted: dict[int, bool] = {}
    carded: dict[int, bool] = {}
    blocky: dict[int, bool] = {}
    for enters, node in walk(root):
        if isinstance(node, str) or enters:
            continue
        children = [c for c in node.elements() if id(c) in texted]
        texted[id(node)] = any(isinstance(c, str) and c.strip() for c in node.children) or any(texted[id(c)] for c in children)
        inner = any(carded[id(c)] for c in children)
        node.card = not inner and node.tag in ("article", "div", "li") and any(_CARD.search(x) for x in node.attrs.get("class", "").split())
        carded[id(node)] = inner or node.card
        blocky[id(node)] = node.tag in HEADINGS or node.tag in ("p", "li", "table", "dt", "dd") or any(blocky[id(c)] for c in children)
        if node.tag in ("div", "section", "article"):
            title = next((c for c in children if _ACCORDION_TITLE.search(c.attrs.get("class", "")) or c.attrs.get("role") in ("button", "heading") and c.attrs.get("aria-controls")), None)
            panel = next((c for c in children if c is not title and (_ACCORDION_PANEL.search(c.attrs.get("class", "")) or c.attrs.get("role") == "region")), None)
            if title is not None and panel is not None:
                title.title, panel.panel = node, node
        term = None
        for c in children:
            if c.tag == "dt":
                term = c
            elif c.tag == "dd" and term is not None and texted[id(c)]:
                term.pairs.append(c)
                c.paired = True
        full = [c for c in children if texted[id(c)]]
        if len(full) == 2 and node.tag not in ("", "html", "body", "main") and full[0].tag in HEADINGS and full[1].tag in ("p", "span", "div") and not any(blocky[id(c)] for c in full[1].elements()):
            value, label = text_of(full[0], SHORT + 1), text_of(full[1], SHORT + 1).split("\n")[0]
            if "\n" not in value and max(len(value), len(label)) <= SHORT and not re.search(r"\d", label):
                full[0].label, full[1].consumed = full[1], True


def _number(text: str | None) -> int:
    return min(int(text), MOST_SPAN) if text and text.isdigit() and len(text) < 9 and int(text) > 0 else 1


class _Table:
    """Cells of a table with their places on the grid, spans from above resolved."""

    def __init__(self, table_id: str) -> None:
        self.id, self.row, self.col, self.busy, self.cells, self.head = table_id, -1, 0, {}, [], False

    def start_row(self) -> None:
        self.row, self.col = self.row + 1, 0
        self.busy = {c: n - 1 for c, n in self.busy.items() if n > 1}

    def add(self, node: Node, chrome: bool) -> dict:
        if self.row < 0:
            self.start_row()
        while self.busy.get(self.col):
            self.col += 1
        rows, cols = _number(node.attrs.get("rowspan")), _number(node.attrs.get("colspan"))
        # a span meets the next row once start_row has counted it down
        self.busy |= {self.col + k: rows for k in range(cols)} if rows > 1 else {}
        cell = {"table_id": self.id, "row": self.row, "col": self.col, "rowspan": rows, "colspan": cols, "is_header": node.tag == "th" and node.attrs.get("scope") not in ("row", "rowgroup"), "row_header": node.tag == "th" and node.attrs.get("scope") in ("row", "rowgroup"), "thead": self.head, "text": [], "plain": 0, "strong": 0}
        self.cells.append(cell)
        self.col += cols
        return cell


def scan(page: str | None, url: str | None, allowed: frozenset[str] = frozenset()) -> dict:
    """title, lang, blocks, cells, links and media of a page; null is an empty page."""
    root = Tree(page or "").root
    _mark(root)
    title, lang = "", ""
    blocks: list[dict] = []
    links: list[dict] = []
    media: list[dict] = []
    tables: list[_Table] = []
    headings: list[tuple[int, str, int | None]] = []
    owners: list[tuple[dict, str] | None] = [None]  # the block and part of it that takes the text
    opened: dict[int, list] = {}  # what an element opened, undone when it is left
    open_tables: list[_Table] = []
    open_cells: list[dict | None] = [None]
    chrome = bold = inside = cover = sections = 0
    parents: list[dict] = []
    scopes: list[Node | None] = [None]
    contexts: list[list] = []
    link: dict | None = None
    titles: dict[int, dict] = {}

    def block(kind: str, node: Node, covers: bool) -> dict:
        made = {"type": kind, "text": [], "key": [], "level": HEADINGS.get(node.tag, 0), "heading_path": [h[1] for h in headings], "parent": parents[-1] if parents else None, "links": [], "table_id": None, "chrome": chrome > 0}
        blocks.append(made)
        return made

    for enters, node in walk(root):
        if isinstance(node, str):
            if node.strip() and not inside and owners[-1] is None and not open_cells[-1]:
                owners[-1] = (block("paragraph", root, False), "text")
            if open_cells[-1] is not None:
                cell = open_cells[-1]
                cell["text"].append(node.replace("\n", " "))
                if node.strip():
                    cell["strong" if bold else "plain"] += 1
            elif owners[-1] is not None and not inside:
                owners[-1][0][owners[-1][1]].append(node.replace("\n", " "))
            if link is not None:
                link["text"].append(node)
            continue
        tag = node.tag
        if enters:
            undo: list = []
            opened[id(node)] = undo
            if tag in ("title", "head", *_CONTROLS):
                inside += 1
                undo.append("inside")
            if tag == "title" and not title:
                title = " ".join(text_of(node).split())
            if tag == "html" and not lang:
                lang = node.attrs.get("lang", "").strip()
            if tag == "nav" or node.attrs.get("role", "").lower() in _CHROME_ROLES or tag in ("header", "footer") and not sections:
                chrome += 1
                undo.append("chrome")
            if tag in _SECTIONS:
                sections += 1
                undo.append("section")
            if tag in ("section", "article", "details") or node.panel is not None:
                scopes.append(node)
                undo.append("scope")
            if tag in ("b", "strong"):
                bold += 1
                undo.append("bold")
            if tag in _ITEMS:
                contexts.append([node, None])
                undo.append("context")
            if node.panel is not None and id(node.panel) in titles:
                parents.append(titles[id(node.panel)])
                undo.append("parent")
            if tag == "table":
                made = block("table", node, True)
                table = _Table(f"t{len(tables) + 1}")
                made["table_id"] = table.id
                tables.append(table)
                open_tables.append(table)
                open_cells.append(None)
                owners.append((made, "caption"))
                made["caption"] = []
                parents.append(made)
                cover += 1
                undo += ["table", "owner", "parent", "cover"]
            elif open_tables and tag in ("tr", "thead", "td", "th"):
                if tag == "tr":
                    open_tables[-1].start_row()
                elif tag == "thead":
                    open_tables[-1].head = True
                    undo.append("thead")
                else:
                    open_cells.append(open_tables[-1].add(node, chrome > 0))
                    undo.append("cell")
            elif not cover and not inside:
                kind = None
                if node.title is not None:
                    kind = "accordion"
                elif node.card:
                    kind = "card"
                elif node.label is not None or tag in ("dt", "dd") and not node.paired:
                    kind = "key_value"
                elif tag in HEADINGS:
                    kind = "heading"
                elif tag == "li":
                    kind = "list"
                elif tag == "details":
                    kind = "accordion"
                elif tag in ("p", "pre"):
                    kind = "paragraph"
                if kind == "heading":
                    headings = [h for h in headings if h[0] < HEADINGS[tag]]
                if kind is not None and not node.consumed:
                    made = block(kind, node, True)
                    part = "key" if node.pairs else "text"
                    owners.append((made, part))
                    undo.append("owner")
                    if kind != "heading":
                        parents.append(made)
                        undo.append("parent")
                    cover += 1
                    undo.append("cover")
                    undo.append(made)
                    if node.title is not None:
                        titles[id(node.title)] = made
                    for value in node.pairs or ([node.label] if node.label is not None else []):
                        opened[-id(value)] = [made, "text" if node.pairs else "key"]
                elif node.paired or node.consumed:
                    made, part = opened.get(-id(node), [None, ""])
                    if made is not None:
                        owners.append((made, part))
                        cover += 1
                        undo += ["owner", "cover"]
                        made[part].append("\n")
                elif tag in _BARE:
                    owners.append(None)  # text that is in no other block becomes a paragraph of its own
                    undo.append("owner")
            if owners[-1] is not None and cover and (tag in _LINES or tag == "br") and not open_cells[-1]:
                owners[-1][0][owners[-1][1]].append("\n")
            if open_cells[-1] is not None and (tag in _LINES or tag == "br"):
                open_cells[-1]["text"].append("\n")
            elif tag == "br" and owners[-1] is not None and not cover:
                owners[-1][0][owners[-1][1]].append("\n")
            if tag == "a" and "href" in node.attrs and link is None:
                absolute, fragment = _absolute(url, node.attrs["href"])
                if absolute:
                    kind, path = node.attrs.get("type", "").strip(), urlsplit(absolute).path.lower()
                    link = {
                        "url": absolute, "href": node.attrs["href"], "fragment": fragment, "text": [], "title": node.attrs.get("title", ""), "rel": node.attrs.get("rel", "").split(), "kind": kind,
                        "downloadable": path.endswith(".pdf") or kind == "application/pdf" or "download" in node.attrs, "same_source": (urlsplit(absolute).hostname or "") in allowed if allowed else urlsplit(absolute).hostname == urlsplit(url or "").hostname,
                        "chrome": chrome > 0, "context": "",
                    }
                    if contexts:
                        if contexts[-1][1] is None:
                            contexts[-1][1] = text_of(contexts[-1][0], CONTEXT_CHARS)
                        link["context"] = contexts[-1][1]
                    links.append(link)
                    undo.append("link")
                    for made in [owners[-1][0]] if owners[-1] is not None else []:
                        made["links"].append(len(links))
            if tag in _CONTROLS and node.attrs.get("type") != "hidden" or tag == "img" or node.attrs.get("role") == "button" and tag != "a":
                source = node.attrs.get("data-src") or node.attrs.get("src") or ""
                media.append({"tag": tag if tag in _CONTROLS or tag == "img" else "button", "source": (_absolute(url, source)[0] or source) if source else "", "label": node.attrs.get("alt") or node.attrs.get("aria-label") or (text_of(node, 200) if tag != "img" else ""), "decorative": tag == "img" and not node.attrs.get("alt", "").strip(), "chrome": chrome > 0})
            continue
        for step in reversed(opened.pop(id(node))):
            match step:
                case "inside":
                    inside -= 1
                case "chrome":
                    chrome -= 1
                case "section":
                    sections -= 1
                case "scope":
                    scopes.pop()
                case "bold":
                    bold -= 1
                case "context":
                    contexts.pop()
                case "parent":
                    parents.pop()
                case "owner":
                    owners.pop()
                    if owners[-1] is not None and not cover:
                        owners[-1] = None  # text behind a block starts a new paragraph
                case "cover":
                    cover -= 1
                case "table":
                    open_tables.pop()
                    open_cells.pop()
                case "thead":
                    if open_tables:
                        open_tables[-1].head = False
                case "cell":
                    open_cells.pop()
                case "link":
                    link = None
                case dict():
                    text = clean("".join(step["text"]))
                    if text and (step["type"] == "heading" or node.title is not None):
                        level = step["level"] if step["type"] == "heading" else 0
                        scope = node.title if node.title is not None else node.parent if _heads_its_card(node) else scopes[-1]
                        headings.append((level, text.replace("\n", " "), id(scope) if scope is not None else None))
        if headings and (tag in ("section", "article", "details", "div") or node.panel is not None):
            headings = [h for h in headings if h[2] != id(node)]
    return _rows(title, lang, blocks, tables, links, media)


def _heads_its_card(node: Node) -> bool:
    """Whether a minor heading stands alone in a small card, and so heads that card only."""
    parent = node.parent
    if node.tag not in ("h5", "h6") or parent is None or parent.tag == "body" or len(parent.children) > 64:
        return False
    full = [c for c in parent.elements() if c.children]
    return len(full) <= 3 and sum(c.tag in HEADINGS for c in full) == 1


def _absolute(base: str | None, href: str) -> tuple[str, str | None]:
    """The absolute http URL without its fragment, and the fragment; empty for other schemes."""
    try:
        full, fragment = urldefrag(urljoin(base or "", href.strip()))
        return (full, fragment or None) if urlsplit(full).scheme in ("http", "https") else ("", None)
    except ValueError:
        return "", None


def _grid(cells: list[dict]) -> str:
    """A table in Markdown: cells at their columns, the first row as its head."""
    width = max((c["col"] + c["colspan"] for c in cells), default=0)
    if width > MOST_SPAN or not cells:
        return ""
    rows: dict[int, list[str]] = {}
    for c in cells:
        rows.setdefault(c["row"], [""] * width)[c["col"]] = c["text"].replace("|", "\\|").replace("\n", "<br>")
    head, *body = [f"| {' | '.join(r)} |" for _, r in sorted(rows.items())]
    return "\n".join([head, "|" + " --- |" * width, *body])


def _rows(title: str, lang: str, blocks: list[dict], tables: list[_Table], links: list[dict], media: list[dict]) -> dict:
    cells = []
    for table in tables:
        for c in table.cells:
            text = clean("".join(c["text"]))
            cells.append({k: c[k] for k in ("table_id", "row", "col", "rowspan", "colspan", "is_header", "row_header", "thead")} | {"bold": c["strong"] > 0 and not c["plain"], "text": text})
    lines: dict[str, dict[int, list[str]]] = {}
    for c in cells:
        lines.setdefault(c["table_id"], {}).setdefault(c["row"], []).append(c["text"].replace("\n", " "))
    grids: dict[str, list[dict]] = {}
    for c in cells:
        grids.setdefault(c["table_id"], []).append(c)
    out, ids, place = [], {}, {}
    for b in blocks:
        if b["table_id"]:
            head = clean("".join(b["caption"]))
            text = "\n".join([*([head] if head else []), *(" | ".join(r) for r in lines.get(b["table_id"], {}).values())]).strip()
        else:
            text = clean("".join(b["text"]))
        key = clean("".join(b["key"])).split("\n")
        name, rest = key[0].rstrip(":").strip(), [x for x in key[1:] if x]
        if not (text or name):
            continue
        value = text if name else None
        shown = "\n".join([f"{name}: {text}" if name and text else name or text, *rest])
        ids[id(b)] = f"b{len(out) + 1}"
        parent = b["parent"]
        while parent is not None and id(parent) not in ids:
            parent = parent["parent"]
        for k in b["links"]:
            place[k] = ids[id(b)]
        if b["type"] == "heading":
            markdown = f"{'#' * b['level']} {' '.join(shown.split())}"
        elif b["type"] == "list":
            markdown = "- " + shown.replace("\n", "\n  ")
        else:
            markdown = _grid(grids.get(b["table_id"], [])) or shown if b["table_id"] else shown
        out.append({
            "markdown": markdown, "block_id": ids[id(b)], "ord": len(out), "type": b["type"], "text": shown, "heading_path": b["heading_path"], "parent_id": ids[id(parent)] if parent is not None else None, "link_ids": [f"l{k}" for k in b["links"]],
            "table_id": b["table_id"], "level": b["level"], "key": name or None, "value": value, "chrome": b["chrome"],
        })
    for k, x in enumerate(links, 1):
        x |= {"link_id": f"l{k}", "ord": k - 1, "text": " ".join("".join(x["text"]).split()), "block_id": place.get(k)}
    return {"title": title, "lang": lang, "blocks": out, "cells": cells, "links": links, "media": [m | {"ord": k} for k, m in enumerate(media)]}
