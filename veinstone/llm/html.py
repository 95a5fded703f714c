"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.common import first_by_hash
from veinstone.llm.trees import BoostedTrees

# Fixed values of HTML: elements without content, raw text, elements whose content is not shown as text,
# blocks, elements whose end tag may be left out before another, and form elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
UNSHOWN = frozenset("template textarea title iframe select button label canvas audio video".split())
BLOCK = frozenset((
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form td th blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BARE = frozenset("nav footer aside form button select textarea input dialog menu label".split())
CONTENT = frozenset("article main".split())

# Words of class, id and role attributes that speak for or against main text.
FOR = frozenset("article body content entry main page post story text hentry prose markdown".split())
AGAINST = frozenset((
    "ad ads advert advertisement adverts aside banner bar breadcrumb breadcrumbs comment comments cookie consent copyright disclaimer "
    "disqus footer form header login masthead menu meta modal nav navbar navigation newsletter notice pager pagination "
    "popup promo promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe tags toolbar topbar widget alert discussion feedback complementary contentinfo").split())

_NAME_OF_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_READ = frozenset("class id role aria-label itemprop".split())
_NOT_DISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_ENDS = re.compile(r"[.!?;:,]")
N_FEATURES = 27
MARK = " data-main-text"  # marks the main element of pages made for training; no feature sees it


class Node:
    __slots__ = ("tag", "up", "depth", "children", "good", "bad", "parts", "chars", "words", "links", "marks", "tags",
                 "paragraphs", "before", "inputs", "hidden", "marked", "index")

    def __init__(self, tag, up, attributes=""):
        self.tag, self.up, self.children, self.parts = tag, up, [], []
        self.depth = up.depth + 1 if up else 0
        self.good = self.bad = self.chars = self.words = self.links = self.marks = self.tags = 0
        self.paragraphs = self.before = self.inputs = 0
        self.hidden, self.marked = False, MARK in attributes
        for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "style" and _NOT_DISPLAYED.search(value) or name == "aria-hidden" and value.lower() == "true":
                self.hidden = True
            elif name in _READ:
                words = {w.lower() for w in _NAME.findall(value)}
                self.good += len(words & FOR)
                self.bad += len(words & AGAINST)


def _end_of_unshown(page: str, at: int, tag: str, parent: str) -> int | None:
    """Where an element without shown text that begins at ``at`` ends; None if it is not closed inside its
    parent. Looks no further than the next tag of its name."""
    m = re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
    if not m or not m[1]:
        return None
    level = 0
    for step in re.compile(rf"<(/?){parent}(?=[\s/>])", re.I).finditer(page, at, m.start()) if parent else ():
        level += -1 if step[1] else 1
        if level < 0:
            return None
    return m.end()


class _Pieces:
    """The pieces of a page: (end, closing, tag, attributes), with no tag for text and comments.

    A tag ends at the first ``>`` outside of quotes; ``<`` without such an end is text. Where that search
    has failed once from some quote, every later search that comes to it fails, so quotes are passed once.
    """

    def __init__(self, page: str):
        self.page, self.failed, self.last = page, set(), page.rfind(">")

    def _end(self, at: int) -> int | None:
        """Where the tag whose attributes begin at ``at`` ends."""
        page, passed = self.page, []
        while at <= self.last:
            m = _QUOTE_OR_END.search(page, at)
            if m[0] == ">":
                return m.end()
            if m.start() in self.failed:
                break
            passed.append(m.start())
            shut = page.find(m[0], m.end())
            if shut < 0:
                break
            at = shut + 1
        self.failed.update(passed)
        return None

    def __call__(self, at: int) -> tuple[int, str, str | None, str, bool]:
        """(end, closing, tag, attributes, shown) of the piece at ``at``."""
        page = self.page
        if page[at] != "<":
            end = page.find("<", at)
            return (len(page) if end < 0 else end), "", None, "", True
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (len(page) if end < 0 else end + 3), "", None, "", False
        if page.startswith(("<!", "<?"), at) and at < self.last:
            return page.find(">", at) + 1, "", None, "", False
        name = _NAME_OF_TAG.match(page, at)
        end = self._end(name.end()) if name else None
        if end is None:
            return at + 1, "", None, "", True
        return end, name[1], name[2], page[name.end():end - 1], False


def parse(page: str) -> Node:
    """The tree of block elements; a node's ``parts`` are its children and its runs of own text in order.

    Inline elements only mark link text; scripts, styles, comments and elements whose content is not shown
    are left out, the latter only if they are closed inside their parent. A block element closes an open
    paragraph; list items and table cells close their like. End tags without a start are ignored.
    """
    top = node = Node("", None)
    stack: list[Node] = [top]
    open_: dict[str, int] = {}
    links, buffer, linked, at, size, piece = 0, [], 0, 0, len(page), _Pieces(page)

    def flush():
        nonlocal linked
        if buffer:
            run = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if run:
                node.parts.append((run, min(linked, len(run))))
        linked = 0

    def close(i):
        nonlocal links
        for gone in stack[i:]:
            open_[gone.tag] -= 1
        del stack[i:]
        links = 0

    while at < size:
        begin = at
        at, closing, tag, attributes, shown = piece(begin)
        if tag is None:
            if shown:
                buffer.append(page[begin:at])
                linked += at - begin if links else 0
            continue
        tag = tag.lower()
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag == "br":
            buffer.append(" ")
        elif not closing and tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            buffer.append(" ")
        elif tag in UNSHOWN:
            if not closing and not attributes.endswith("/"):
                at = _end_of_unshown(page, at, tag, re.escape(node.tag)) or at
            node.inputs += not closing and tag in ("textarea", "select", "button")
            buffer.append(" ")
        elif tag == "input":
            node.inputs += not closing
        elif tag in BLOCK:
            flush()
            if closing:
                for i in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                    if stack[i].tag == tag:
                        close(i)
                        break
            else:
                shut = CLOSES.get(tag, ())
                for i in range(len(stack) - 1, 0, -1) if any(map(open_.get, ("p", *shut))) else ():
                    if stack[i].tag in shut or stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in SCOPE:
                        break
                if tag == "hr":
                    node = stack[-1]
                    continue
                child = Node(tag, stack[-1], attributes)
                stack[-1].children.append(child)
                stack[-1].parts.append(child)
                stack.append(child)
                open_[tag] = open_.get(tag, 0) + 1
            node = stack[-1]
    flush()
    return top


def measure(top: Node) -> list[Node]:
    """Nodes in page order, with sums over their subtrees."""
    order, todo = [], [top]
    while todo:
        node = todo.pop()
        node.index = len(order)
        order.append(node)
        todo += reversed(node.children)
    # text before a node, in page order
    seen, walk = 0, [top]
    while walk:
        part = walk.pop()
        if isinstance(part, Node):
            part.before = seen
            walk += reversed(part.parts)
        else:
            seen += len(part[0])
    for node in reversed(order):
        for part in node.parts:
            if not isinstance(part, Node):
                text, linked = part
                node.chars += len(text)
                node.words += text.count(" ") + 1
                node.links += linked
                node.marks += len(_ENDS.findall(text))
        node.tags += 1
        node.paragraphs += node.tag == "p"
        if node.up:
            up = node.up
            for name in ("chars", "words", "links", "marks", "tags", "paragraphs", "inputs"):
                setattr(up, name, getattr(up, name) + getattr(node, name))
    return order


def features(order: list[Node]) -> np.ndarray:
    """Subtree density, attribute words, depth and sibling statistics of every node."""
    out = np.zeros((len(order), N_FEATURES), np.float32)
    total = max(1, order[0].chars)
    path = [(0, 0, 0, 0, 0)] * len(order)
    for node in order:
        good, bad, content, bare, hidden = path[node.up.index] if node.up else (0, 0, 0, 0, 0)
        path[node.index] = good, bad, content, bare, hidden = (
            good + node.good, bad + node.bad, content + (node.tag in CONTENT), bare + (node.tag in BARE), hidden + node.hidden)
        brothers = node.up.children if node.up else [node]
        mean = sum(b.chars for b in brothers) / len(brothers) if len(brothers) < 64 else node.up.chars / len(brothers)
        out[node.index] = (
            node.depth, len(brothers), len(node.children), np.log1p(node.chars), node.words,
            node.links / max(1, node.chars), node.chars / node.tags, node.marks / max(1, node.words),
            node.chars / max(1, node.words), node.tag in CONTENT, node.tag in BARE, node.tag == "p",
            node.tag in HEADINGS, node.tag == "li", node.tag == "header", node.good, node.bad, good, bad, content, bare,
            node.before / total, node.chars / total, node.paragraphs, node.chars / (1 + mean), node.hidden, hidden)
    return out


def decode(order: list[Node], logits: np.ndarray) -> list[bool]:
    """Which nodes' own text is kept: the best choice of whole subtrees.

    Every node is kept whole, dropped whole or split: its own text goes by its own score and each child
    decides for itself. A subtree that is kept or dropped has no child that says otherwise, so ancestor
    and descendant never contradict each other; splitting costs ``SPLIT``.
    """
    n = len(order)
    own = np.array([sum(len(p[0]) for p in node.parts if not isinstance(p, Node)) for node in order], float)
    weight = np.log1p(own) * logits  # support of keeping a node's own text
    keep = weight.copy()
    for node in reversed(order):
        if node.up:
            keep[node.up.index] += keep[node.index]
    best, choice = np.zeros(n), np.zeros(n, np.int8)
    split = np.maximum(weight, 0)
    for node in reversed(order):
        i = node.index
        options = (-SPLIT if node.children else 0.0) + split[i], keep[i], 0.0
        choice[i] = int(np.argmax(options))
        best[i] = options[choice[i]]
        if node.up:
            split[node.up.index] += best[i]
    kept = [False] * n
    force = np.zeros(n, np.int8)  # 1: an ancestor keeps all, 2: drops all
    for node in order:
        i = node.index
        f = force[node.up.index] if node.up else 0
        force[i] = f or (choice[i] if choice[i] else 0)
        kept[i] = force[i] == 1 or force[i] == 0 and weight[i] > 0
    return kept


SPLIT = 0.5


def main_text(page: str, model: BoostedTrees) -> str:
    order = measure(parse(page))
    return _text(order, decode(order, model.logit(features(order))))


def _text(order: list[Node], kept: list[bool]) -> str:
    blocks, walk = [], [order[0]]
    while walk:
        part = walk.pop()
        if not isinstance(part, Node):
            blocks.append(part[0])
            continue
        walk += [p for p in reversed(part.parts) if isinstance(p, Node) or kept[part.index]]
    return "\n".join(blocks)


# ------------------------------------------------------------------------------------------ training

_TEMPLATES_FOR = ("article", "main", "div class='post-content'", "div id='content'", "section class='entry-content'",
                  "div class='story-body'", "article class='post'", "main id='main-content'")
_TEMPLATES_AGAINST = (
    "nav", "footer", "aside", "header", "div class='sidebar'", "div class='ad'", "div class='advert banner'", "form",
    "div class='cookie-notice'", "section id='comments'", "div class='comment-list'", "ul class='menu'",
    "div class='related-posts'", "div class='share social'", "div id='footer'", "div id='header'", "aside class='widget'",
    "div class='newsletter-signup'", "div class='notice'", "div role='navigation'", "div class='comments'")
_HIDING = ("div hidden", "div style='display:none'", "div aria-hidden='true'", "section hidden", "div class='text' style='color:red;display: none'")


def _is_content(node: Node) -> bool:
    while node:
        if node.hidden:
            return False
        if node.tag in CONTENT:
            return True
        node = node.up
    return False


def _rewrapped(page: str, others: list[str], rng: random.Random) -> str | None:
    """A page in another dress: its article in a random (marked) content element, and around it
    boilerplate of itself and of other pages in random boilerplate elements."""
    found = re.search(r"<(article|main)\b[^>]*>(.*?)</\1\s*>", page, re.S | re.I)
    if not found:
        return None

    def wrap(dress, inside, mark=""):
        return f"<{dress}{mark}>{inside}</{dress.split()[0]}>"

    def boilerplate():
        source = rng.choice(others)
        outside = re.sub(r"<(article|main|head)\b[^>]*>.*?</\1\s*>|<script.*?</script>|<style.*?</style>|<!--.*?-->|<!doctype[^>]*>|</?(html|body|nav|footer|header|aside|div)\b[^>]*>",
                         " ", source, flags=re.S | re.I)
        kind = rng.random()
        words = re.sub(r"<[^>]*>", " ", outside).split() or ["menu"]
        if kind < 0.35:
            inside = outside
        elif kind < 0.7:  # reader comments and notices have sentences, too
            prose = re.sub(r"<[^>]*>", " ", source[source.find("<p"):]).split() or words
            start = rng.randrange(len(prose))
            inside = "".join(f"<p>{' '.join(prose[start + i:start + i + rng.randint(5, 60)])}</p>" for i in range(rng.randint(1, 4)))
        else:
            inside = "<ul>" + "".join(f"<li><a href='#'>{w}</a></li>" for w in words[:rng.randint(2, 9)]) + "</ul>"
        return wrap(rng.choice(_TEMPLATES_AGAINST), inside)

    inner = found[2]
    if rng.random() < 0.3:
        inner += boilerplate()
    core = wrap(rng.choice(_TEMPLATES_FOR), inner, MARK)
    body = "".join(boilerplate() for _ in range(rng.randint(1, 3))) + core + "".join(boilerplate() for _ in range(rng.randint(1, 4)))
    if rng.random() < 0.4:
        body = wrap(rng.choice(("div", "div class='page'", "div id='wrapper'", "section")), body)
    return f"<html><body>{body}</body></html>"


def _with_hidden(page: str, others: list[str], rng: random.Random) -> str | None:
    """A page in another dress with a hidden part of other prose in its article; some are hidden as a whole,
    as until a script shows them."""
    found = re.search(r"<(article|main)\b[^>]*>(.*?)</\1\s*>", page, re.S | re.I)
    if not found:
        return None
    source, dress = rng.choice(others), rng.choice(_HIDING)
    prose = re.sub(r"<[^>]*>", " ", source[source.find("<p"):]).split() or ["menu"]
    inside = "".join(f"<p>{' '.join(prose[start:start + rng.randint(3, 60)])}</p>" for start in (rng.randrange(len(prose)) for _ in range(rng.randint(1, 4))))
    at = rng.choice((found.start(2), found.end(2), found.end(2)))
    page = _rewrapped(f"{page[:at]}<{dress}>{inside}</{dress.split()[0]}>{page[at:]}", others, rng)
    return f"<div style='display:none'>{page}</div>" if rng.random() < 0.2 else page


def train(pages: list[str], seed: int = 7, dresses: int = 3) -> BoostedTrees:
    """Fits the trees on pages whose article element marks the main text, as they are and re-dressed.

    One more dress has a hidden part. Pages without an article or main element teach nothing. Without any such page the trees learn from
    one written example, in the same dresses.
    """
    usable = [p for p in pages if re.search(r"<(article|main)\b", p, re.I)]
    usable = usable or ["<html><nav><ul><li><a href='#'>home</a></li></ul></nav><article><h1>A title here</h1><p>Some words of a text, "
                        "and more of them. It goes on.</p><p>It ends.</p></article><footer>&copy; us</footer></html>"] * 20
    rng, hiding, xs, ys = random.Random(seed), random.Random(seed + 1), [], []
    for page in usable:
        order = measure(parse(page))
        xs.append(features(order))
        ys.append([_is_content(n) for n in order])
        for i in range(dresses + 1):
            dressed = _rewrapped(page, usable, rng) if i < dresses else _with_hidden(page, usable, hiding)
            if dressed:
                order = measure(parse(dressed))
                main = [False] * len(order)
                for node in order:
                    inside = node.up is not None and main[node.up.index]
                    main[node.index] = node.marked or inside and not (node.tag in BARE or node.hidden or node.bad > node.good)
                xs.append(features(order))
                ys.append(main)
    x, y = np.concatenate(xs), np.concatenate([np.asarray(v, float) for v in ys])
    return BoostedTrees().fit(x.astype(np.float64), y)


def training_pages(pages: DataFrame, key: str, html: str, limit: int, longest: int) -> list[str]:
    """At most ``limit`` pages of at most ``longest`` characters, chosen by a hash of their key and text."""
    rows = (pages.filter((F.length(html) <= longest) & F.lower(html).rlike("<(article|main)[ >]"))
            .select(F.col(key).alias("key"), F.col(html).alias("page")))
    return [r.page for r in first_by_hash(rows, limit, "key", "page")]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
            training_limit: int = 300, training_longest: int = 20_000, model: BoostedTrees | None = None) -> DataFrame:
    """Main text of every page: key, url, text, n_chars.

    The model is fitted on a bounded sample (``training_limit`` pages of at most ``training_longest``
    characters; at most 6 MB reach the driver); every page is then parsed, scored and decoded whole,
    without a shuffle. Null or empty pages, and pages without main text, give an empty text. Repeated
    rows give repeated results; other columns are not read.
    """
    model = model or train(training_pages(pages, key, html, training_limit, training_longest))

    def run(batches):
        for batch in batches:
            texts = []
            page_rows = batch.column(2)
            for start in range(0, len(page_rows), 64):
                trees = [measure(parse(p.as_py() or "")) for p in page_rows[start:start + 64]]
                logits = model.logit(np.concatenate([features(t) for t in trees]).astype(np.float64))
                at = 0
                for order in trees:
                    texts.append(_text(order, decode(order, logits[at:at + len(order)])))
                    at += len(order)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = rows.mapInArrow(run, "key long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"key": key, "url": url})
