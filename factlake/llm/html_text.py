"""Operator 2: main text of web pages by gradient-boosted trees over DOM nodes.

Each block element gets features of its subtree, attributes, depth and siblings, and the trees
give its log-odds of being (or holding) main text. Decoding is hierarchical: a node can only be
kept with its ancestors, and the kept set with the highest sum of log-odds is chosen, so a
dropped node never has a kept descendant. The trees are trained on generated page layouts.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.boosting import BoostedTrees, fit
from factlake.llm.hashing import small_chunks
from factlake.llm.tables import map_rows, text_bytes

# fixed values: elements of HTML by role
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template head title svg iframe object canvas select textarea button audio video".split())
_BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption "
    "nav header footer aside form fieldset address details summary dialog center menu hgroup search".split()
)
_CLOSES_P = _BLOCK - frozenset("html body".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_SPACED = frozenset("br td th hr img".split())
_MAIN_TOKENS = frozenset("article content main post entry story body text blog page copy prose".split())
_OTHER_TOKENS = frozenset(
    "ad ads advert advertisement adverts adsense banner promo sponsor sponsored nav navbar navigation menu header footer sidebar aside side widget comment comments "
    "reply respond disqus discussion cookie cookies consent notice notices alert popup modal overlay share sharing social related recommended recommend breadcrumb breadcrumbs "
    "pagination pager newsletter subscribe signup login search form copyright legal tags toolbar masthead topbar bottom skip meta byline rail teaser outbrain taboola".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_GROUPS = ("article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "table tr", "nav", "header", "footer", "aside", "form", "blockquote pre", "body html")
_GROUP = {tag: k for k, tags in enumerate(_GROUPS) for tag in tags.split()}


class Node:
    __slots__ = ("tag", "parent", "items", "main", "other", "chars", "linked", "words", "stops", "links", "blocks", "paragraphs", "place", "depth", "own")

    def __init__(self, tag: str, parent: Node | None, attributes: str) -> None:
        self.tag, self.parent, self.items = tag, parent, []
        self.main = self.other = 0
        self.chars = self.linked = self.words = self.stops = self.links = self.blocks = self.paragraphs = self.own = 0
        self.place, self.depth = 0, parent.depth + 1 if parent else 0
        if attributes:
            for found in _NAMES.findall(attributes):
                names = {n.lower() for n in _PARTS.findall(" ".join(found))}
                self.main += len(names & _MAIN_TOKENS)
                self.other += len(names & _OTHER_TOKENS)


def parse(page: str) -> list[Node]:
    """Block elements in page order, the root first; items of a node are its texts (text, in a link) and child nodes."""
    root = Node("html", None, "")
    nodes, stack, at, linked, size = [root], [("html", root)], 0, 0, len(page)
    whole = page.rfind(">") + 1  # no tag ends behind it
    opened: dict[str, list[int]] = {}  # places in the stack of open blocks, by name

    def cut(place: int) -> None:
        for t, _ in stack[place:]:
            opened[t].pop()
        del stack[place:]

    endless: set[str] = set()  # silent elements without an end tag from here on
    node = root
    while at < size:
        found = _TOKEN.search(page, at, whole) if at < whole else None
        if found is None:
            node.items.append((page[at:], linked > 0))
            break
        if found.start() > at:
            node.items.append((page[at : found.start()], linked > 0))
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "a":
                linked = 0
            if tag in _SPACED:
                node.items.append((" ", False))
            if tag not in _BLOCK or not opened.get(tag):
                continue
            cut(opened[tag][-1])
            node, linked = stack[-1][1], 0
            continue
        if tag in _SILENT:
            if tag == "svg" and found[3].endswith("/"):
                continue
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            if end is None and tag in ("head", "title", "button", "select", "object", "svg"):
                continue
            at = end.end() if end else size
            continue
        if tag in _SPACED:
            node.items.append((" ", False))
        if tag in _VOID or tag == "html":
            continue
        if tag == "a":
            linked = 1
            node.links += 1
        if tag not in _BLOCK:
            continue
        drop = set(_CLOSES.get(tag, ()))
        if tag in _CLOSES_P:
            drop.add("p")
        last = lambda tags: max((opened[t][-1] for t in tags if opened.get(t)), default=0)
        place = last(drop) if tag in _HOLDERS else len(stack) - 1 if stack[-1][0] in drop else 0
        if place > last(_HOLDERS.get(tag, ())):
            cut(place)
        linked = 0
        node = Node(tag, stack[-1][1], found[3])
        stack[-1][1].items.append(node)
        nodes.append(node)
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))
    return nodes


def measure(nodes: list[Node]) -> list[list[float]]:
    """Features of each node, filling the counts of its subtree."""
    for node in reversed(nodes):
        place = 0
        for item in node.items:
            if type(item) is tuple:
                text, in_link = item
                n = len(text)
                if n and (n > 40 or not text.isspace()):
                    node.own += n
                    node.chars += n
                    node.words += text.count(" ") + 1
                    node.stops += text.count(".") + text.count(",")
                    if in_link:
                        node.linked += n
            else:
                item.place = place
                place += 1
                node.chars += item.chars
                node.linked += item.linked
                node.words += item.words
                node.stops += item.stops
                node.links += item.links
                node.blocks += item.blocks + 1
                node.paragraphs += item.paragraphs + (item.tag == "p")
    total = nodes[0].chars + 1
    width = len(_GROUPS)
    out, above = [], {}
    for node in nodes:
        group = _GROUP.get(node.tag, 2)
        parent = node.parent
        up = above[id(parent)] if parent else (0, 0, 0, 0)
        above[id(node)] = (up[0] + (group == 0), up[1] + (8 <= group <= 12 and group != 9), up[2] + bool(node.main), up[3] + bool(node.other))
        row = [0.0] * width
        row[group] = 1.0
        siblings = sum(1 for i in parent.items if type(i) is not tuple) if parent and len(parent.items) < 200 else 200 if parent else 1
        out.append(
            row
            + [
                node.main,
                node.other,
                up[0],
                up[1],
                up[2],
                up[3],
                min(node.depth, 12),
                math.log1p(node.chars),
                node.chars / total,
                node.linked / (node.chars + 1),
                node.stops / (node.words + 1),
                math.log1p(node.links),
                node.links / (node.blocks + 1),
                math.log1p(node.paragraphs),
                math.log1p(node.own),
                node.own / (node.chars + 1),
                math.log1p(siblings),
                node.place / siblings,
                (parent.chars / total) if parent else 1.0,
                (parent.linked / (parent.chars + 1)) if parent else 0.0,
                math.log1p(parent.paragraphs) if parent else 0.0,
            ]
        )
    return out


def decode(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """The set closed under ancestors with the highest sum of log-odds; ties are dropped."""
    index = {id(node): k for k, node in enumerate(nodes)}
    best = logits.tolist()
    best[0] = 0.0  # the root holds everything
    for k in range(len(nodes) - 1, 0, -1):
        if best[k] > 0:
            best[index[id(nodes[k].parent)]] += best[k]
    keep = [True] * len(nodes)
    for k in range(1, len(nodes)):
        keep[k] = best[k] > 0 and keep[index[id(nodes[k].parent)]]
    return keep


def render(nodes: list[Node], keep: list[bool]) -> str:
    """Kept blocks in page order: character references decoded, white space to one space, joined by an empty line."""
    kept = {id(node) for node, k in zip(nodes, keep, strict=True) if k}
    blocks, buffer = [], []

    def flush() -> None:
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            if text := " ".join((entities.unescape(text) if "&" in text else text).split()):
                blocks.append(text)

    work: list = [nodes[0]]
    while work:
        item = work.pop()
        if type(item) is tuple:
            buffer.append(item[0])
        elif item is None:
            flush()
        elif id(item) in kept:
            flush()
            work.append(None)
            work.extend(reversed(item.items))
        else:
            flush()
    flush()
    return "\n\n".join(blocks)


# ---------------------------------------------------------------- training pages


def training_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page of random layout, main parts marked by data-main, with its attributes otherwise as pages have them."""

    def words(low: int, high: int, style: int) -> str:
        n = int(rng.integers(low, high + 1))
        out = ["".join(rng.choice(["an", "er", "the", "in", "os", "ung", "le", "ti", "on", "é"], int(rng.integers(1, 5)))) for _ in range(n)]
        if style == 1:
            out = [w.upper() + "!!" for w in out]
        elif style == 2:
            out = [w + str(rng.choice(["***", "%%%", "$$$"])) for w in out]
        elif style == 3:
            out = [out[0]] * n
        elif style == 4:
            return " | ".join(out)
        else:
            return ". ".join(" ".join(out[k : k + 9]).capitalize() for k in range(0, n, 9)) + "."
        return " ".join(out)

    pick = lambda *options: options[int(rng.integers(len(options)))]
    often = lambda p: rng.random() < p
    style = int(rng.integers(5)) if often(0.3) else 0
    link = lambda: f'<a href="/{words(1, 1, 9)}">{words(1, 3, 9)}</a>'
    named = lambda *names: pick(f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="x {pick(*names)}-{pick("box", "area", "1", "wrap")}"')
    links = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(a, b)))) + "</ul>"

    def other(inside: bool = False) -> str:
        kinds = [
            lambda: f"<div{named('ad', 'ads', 'advert', 'promo', 'sponsor', 'banner')}>{words(2, 30, style if often(0.5) else 0)}</div>",
            lambda: f"<div{named('share', 'social', 'tags')}>{link()} {link()}</div>",
            lambda: f"<div{named('related', 'recommended')}><h3>{words(1, 3, 0)}</h3>{links(2, 6)}</div>",
            lambda: f"<form{pick('', named('newsletter', 'search', 'login'))}><p>{words(2, 15, 0)}</p><input name=q></form>",
            lambda: f"<aside{pick('', named('sidebar', 'widget'))}><p>{words(3, 40, 0)}</p>{links(1, 4)}</aside>",
        ]
        if not inside:
            kinds += [
                lambda: f"<nav>{links(3, 9)}</nav>",
                lambda: f"<div{named('menu', 'nav', 'navbar', 'breadcrumb')}>{links(3, 9)}</div>",
                lambda: f"<header{pick('', named('header', 'masthead'))}><h2>{words(1, 4, 0)}</h2>{links(2, 5)}</header>",
                lambda: f"<div{named('cookie', 'consent', 'notice', 'alert', 'popup')}><p>{words(5, 40, 0)}</p></div>",
                lambda: f"<div{named('sidebar', 'widget', 'rail')}><h3>{words(1, 3, 0)}</h3><p>{words(4, 40, 0)}</p>{links(2, 5)}</div>",
                lambda: f"<footer{pick('', named('footer'))}>&copy; {words(3, 25, 0)}{pick('', links(2, 5))}</footer>",
                lambda: f"<div{named('footer', 'copyright', 'legal')}><p>&copy; {words(3, 25, 0)}</p></div>",
                comments,
            ]
        return pick(*kinds)()

    def comments() -> str:
        tag = pick("section", "div", "ol")
        body = "".join(f"<{pick('div', 'li')}{named('comment', 'reply')}><p>{words(3, 60, 0)}</p></{pick('div', 'li')}>" for _ in range(int(rng.integers(1, 5))))
        return f"<{tag}{named('comments', 'respond', 'discussion')}><h3>{words(1, 3, 0)}</h3>{body}</{tag}>"

    def block() -> str:
        r = rng.random()
        if r < 0.75:
            return f"<p data-main>{words(*pick((1, 4), (5, 40), (30, 120)), style)}{'<br>' if often(0.1) else ''}" + pick("</p>", "</p>", "")
        if r < 0.83:
            return f"<h2 data-main>{words(1, 8, style)}</h2>"
        if r < 0.9:
            return "<ul data-main>" + "".join(f"<li data-main>{words(1, 20, style)}</li>" for _ in range(int(rng.integers(1, 6)))) + "</ul>"
        if r < 0.95:
            return f"<blockquote data-main><p data-main>{words(4, 40, style)}</p></blockquote>"
        return "<table data-main>" + "".join(f"<tr data-main><td>{words(1, 3, 0)}<td>{words(1, 6, 0)}</tr>" for _ in range(int(rng.integers(1, 5)))) + "</table>"

    inner = [f"<h1 data-main>{words(1, 10, style)}</h1>"] if often(0.85) else []
    for _ in range(int(rng.integers(1, pick(3, 8, 20)))):
        inner.append(block())
        if often(0.05):
            inner.append(other(True))
    if often(0.2):
        inner.insert(int(rng.integers(len(inner) + 1)), f"<header data-main><h1 data-main>{words(1, 8, style)}</h1></header>")
    if often(0.15):
        inner = ["".join(f"<section data-main>{x}</section>" if often(0.5) else x for x in inner)]
    tag, attribute = pick(("article", ""), ("article", named("post", "article")), ("main", ""), ("div", named("content", "post", "entry", "story", "article")), ("div", named("content", "post", "entry", "story", "article")), ("section", named("content", "text")), ("div", ""))
    main = f"<{tag}{attribute} data-main>{''.join(inner)}</{tag}>"
    for _ in range(int(rng.integers(0, 3))):
        beside = (other() if often(0.4) else "", other() if often(0.4) else "")
        main = f"<div{pick('', named('wrapper', 'container', 'row', 'page', 'layout'))} data-main>{beside[0]}{main}{beside[1]}</div>"
    before = "".join(other() for _ in range(int(rng.integers(0, 4))))
    after = "".join(other() for _ in range(int(rng.integers(0, 4))))
    return f"<!DOCTYPE html><html><head><title>{words(1, 6, 0)}</title><script>var t='</p>';</script></head><body data-main>{before}{main}{after}</body></html>"


@lru_cache(maxsize=2)
def trained(pages: int = 500, seed: int = 5) -> BoostedTrees:
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    marked = re.compile(r"\bdata-main")
    for _ in range(pages):
        page = training_page(rng)
        nodes = parse(page)
        starts = [m for m in _TOKEN.finditer(page) if m[2] and not m[1] and m[2].lower() in _BLOCK and m[2].lower() != "html"]
        rows += measure(nodes)[1:]
        labels += [bool(marked.search(m[3])) for m in starts]
    return fit(np.array(rows), np.array(labels, np.float64))


def main_texts(pages: list[str], model: BoostedTrees) -> list[str]:
    parsed = [parse(page) for page in pages]
    rows = [row for nodes in parsed for row in measure(nodes)]
    logits = model.logits(np.array(rows)) if rows else np.empty(0)
    out, at = [], 0
    for nodes in parsed:
        out.append(render(nodes, decode(nodes, logits[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every row of ``pages``, from the whole html.

    Null or empty html, and pages without main text, give an empty text. Null ids and urls pass
    through; repeated rows each give a row; other columns are ignored; an empty table gives an
    empty result. Only the trained trees, of a fixed size, are shipped; nothing is shuffled.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_bytes(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for own, raw in small_chunks(keys, batch.column(2)):
                texts = main_texts([t.decode("utf-8", "replace") for t in raw], model.value)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own], pa.int64()), pa.array([k[1] for k in own], pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return map_rows(source, run, "page_id long, url string, text string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
