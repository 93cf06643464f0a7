"""Main text of web pages by tree scoring.

The page becomes a tree of elements. Every block of text gives points for being there, for each comma and for its length;
its container gets them whole, the container's ancestors a share that shrinks with the distance. Points are discounted by
link density. The container with most points is kept. If it stands in an article or main element, so is all else there
that isn't mostly links; otherwise those siblings that have enough points, are plain paragraphs or belong to the run
around it (what stands between kept siblings, headings, what follows a heading, sections, elements of the same class),
and the headings before its ancestors. Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and
styles are left out by their element or their class, and so are lists that mostly consist of links. A class counts if it
is one of the known words as a whole, or made of them and of words for place, rank and part. It doesn't count for an
element that holds most of the page's text outside links, unless it names comments; if nothing else is on the page,
no class counts.

Formulas (math) and what stands in for objects and scripts (object, noscript) are text like any other.

Cases: a null, empty or textless page has an empty text. A page without markup is one block. Elements that are not
closed, or closed without being open, are put right as browsers do; a tag that doesn't end is text. Of containers with
equal points the first one is kept. A page of any size is read whole, in time that grows with its size, however deep its
elements are. Equal rows give equal texts; null and equal ids are carried along. An empty table gives an empty result.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import named

# Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template svg select annotation annotation-xml".split())
SKIPPED = frozenset("nav header footer aside form button dialog menu head".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary".split())
BLOCKS = PARAGRAPHS | SKIPPED | frozenset("html body div section article main ul ol dl table thead tbody tfoot tr figure details address center fieldset hr".split())
#: An element of the key ends, if open in the same parent, when one of its values begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
#: A class or id made of these words, with or without words of FILLING between them, marks what isn't article text.
MARKING = r"(?:ad|ads|adv|advert[a-z]*|adsense|sponsor[a-z]*|promo[a-z]*|banner|nav|navbar|navigation|menu|sidebar|aside|widget|widgets|footer|header|masthead" \
    r"|comment|comments|disqus|replies|respond|cookie[a-z]*|consent|gdpr|notice|alert|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social" \
    r"|related|recommended|breadcrumb[a-z]*|pagination|pager|skip|hidden)"
FILLING = r"(?:site|global|top|bottom|left|right|main|primary|secondary|sub|mobile|desktop|user|bar|side|box|block|area|section|slot|unit|wrap|wrapper|container|inner|outer|list|item|items" \
    r"|link|links|button|buttons|icons|form|text|body|thread|posts|articles|stories|content|media|visually|is|js|to|\d+|\d+x\d+)"
UNLIKELY = re.compile(rf"(?!(?:section|block|content|item|box|list|text|body)[_-]header)(?:{FILLING}[_-]+)*{MARKING}(?:[_-]+(?:{MARKING}|{FILLING}))*|side-bar", re.I)
#: Of these, what marks a discussion, which may be longer than its article.
DISCUSSION = re.compile(r"comment|disqus|replies|respond", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What is a menu if it mostly consists of links.
MENUS = frozenset("ul ol dl table div section".split())
#: So far up the open elements that make blocks, an open paragraph is looked for when another one begins.
DEEP = 64
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
#: Where markup begins; a tag up to its end, which isn't within quotes; a tag up to the next >.
MARKUP = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
COMMAS = re.compile("[,，、،]")


class Node:
    """An element. No element refers to itself or to one below it, so a page's tree goes as soon as it isn't needed."""

    __slots__ = ("above", "chars", "classes", "discussion", "gone", "linked", "marked", "outer", "parent", "plain", "points", "skipped", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.points, self.chars, self.linked, self.plain, self.gone = tag, parent, 0.0, 0, 0, 0, False
        if attributes:
            self.skipped, self.marked, self.discussion, self.classes = judged(tag, attributes)
        else:
            self.skipped, self.marked, self.discussion, self.classes = tag in SKIPPED, False, False, ""
        #: The nearest elements above that make blocks and that have an unlikely class.
        self.above: Node | None = None
        self.outer: Node | None = None
        if parent:
            self.skipped = self.skipped or parent.skipped
            self.above = parent if parent.tag in BLOCKS else parent.above
            self.outer = parent if parent.marked else parent.outer


def mark_of(node: Node) -> Node | None:
    return node if node.marked else node.outer


def judged(tag: str, attributes: str) -> tuple[bool, bool, bool, str]:
    """Whether an element is skipped for good, is unlikely by its class, is a discussion; and its classes."""
    hard, marked, discussion, classes = tag in SKIPPED, False, False, ""
    whole = tag in ("html", "body", "article", "main")
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "class":
            classes = value
        if whole:
            continue
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            hard = True
        elif name == "role" and value.lower() in ("navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert"):
            hard = True
        elif name in ("class", "id"):
            for word in value.split():
                if UNLIKELY.fullmatch(word):
                    marked, discussion = True, discussion or bool(DISCUSSION.search(word))
    return hard, marked, discussion, classes


class Tree:
    """The elements of a page in page order (nodes), and its blocks of text: (element, text, characters in links)."""

    def __init__(self, page: str):
        root = Node("html", None)
        self.nodes, self.blocks = [root], []
        # Open elements, by tag where they are in the stack, and where those are that make blocks.
        self.stack, self.open, self.outlines = [root], {"html": [0]}, [0]
        self.text: list[str] = []
        self.linked, self.page = 0, page
        self._read()
        for node in reversed(self.nodes):  # children come after their parents
            if node.parent:
                node.parent.chars += node.chars
                node.parent.linked += node.linked

    def flush(self) -> None:
        if self.text:
            block = "".join(self.text)
            block = " ".join((entities.unescape(block) if "&" in block else block).split())
            if block:
                node, linked = self.stack[self.outlines[-1]], min(self.linked, len(block))
                self.blocks.append((node, block, linked))
                node.chars += len(block)
                node.linked += linked
            self.text.clear()
        self.linked = 0

    def add(self, s: str) -> None:
        if s:
            self.text.append(s)
            if self.open.get("a"):
                self.linked += len(s.strip())

    def close(self, at: int) -> None:
        for node in self.stack[at:]:
            self.open[node.tag].pop()
        del self.stack[at:]
        while self.outlines[-1] >= at:
            self.outlines.pop()

    def begin(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            for i in self.outlines[: -DEEP - 1 : -1]:
                open_ = self.stack[i].tag
                if open_ == "p" or tag in ENDS.get(open_, ()):
                    self.close(i)
                elif open_ not in PARAGRAPHS:
                    break
        if tag == "a" and self.open.get("a"):
            self.close(self.open["a"][-1])
        if attributes.endswith("/") and tag not in BLOCKS:
            return
        node = Node(tag, self.stack[-1], attributes)
        self.nodes.append(node)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.outlines.append(len(self.stack))
        self.stack.append(node)

    def end(self, tag: str) -> None:
        at = (self.open.get(tag) or [0])[-1]
        if tag in BLOCKS:
            self.flush()
        if at:
            if self.outlines[-1] >= at:
                self.flush()
            self.close(at)

    def _read(self) -> None:
        page, pos, pattern, never = self.page, 0, TAG, set()
        while m := MARKUP.search(page, pos):
            start = m.start()
            if page[start + 1] in "!?":
                comment = page.startswith("<!--", start)
                stop = page.find("-->" if comment else ">", start + 4 if comment else start)
                self.add(page[pos:start])
                pos = len(page) if stop < 0 else stop + (3 if comment else 1)
                continue
            tag = pattern.match(page, start)
            if not tag and pattern is TAG:
                pattern = PLAIN_TAG  # a quote that never ends: from here on quotes don't count
                tag = pattern.match(page, start)
            if not tag:
                break
            self.add(page[pos:start])
            pos, (end, name, attributes) = tag.end(), tag.groups()
            name = name.lower()
            if end:
                self.end(name)
            elif name in RAW:
                stop = None if name in never else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
                if stop:
                    pos = stop.end()
                elif name in ("script", "style"):
                    pos = len(page)
                else:
                    never.add(name)
            elif name in VOID:
                if name in BLOCKS:
                    self.flush()
                elif name == "br":
                    self.add(" ")
            else:
                self.begin(name, attributes)
        self.add(page[pos:])
        self.flush()


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def article_blocks(page: str) -> list[tuple[Node, str]]:
    """The blocks that neither an element nor a class rules out."""
    tree = Tree(page)
    found = [x for x in tree.blocks if not x[0].skipped]
    marks = [n for n in tree.nodes if n.marked]
    for node, block, linked in found if marks else ():
        if mark := mark_of(node):
            mark.plain += len(block) - linked
    for mark in reversed(marks):
        if mark.outer:
            mark.outer.plain += mark.plain
    half = sum(len(block) - linked for _, block, linked in found) / 2
    for mark in marks:
        mark.gone = mark.plain > 0 and (mark.discussion or mark.plain <= half) or mark.outer is not None and mark.outer.gone
    stays = [(n, b) for n, b, _ in found if not ((mark := mark_of(n)) and mark.gone)]
    return stays or [(n, b) for n, b, linked in found if 2 * linked < len(b)]


def run_around(entries: list[Node | None], best: Node, enough: float, on: bool, loose: bool) -> set[int]:
    """Which of the best container's siblings, itself included, belong to the article, by position. None is loose text.

    on: whether the run may go on behind the last good sibling; loose: whether paragraphs anywhere are kept.
    """
    good = [i for i, n in enumerate(entries) if n and (n is best or n.points * (1 - density(n)) >= enough)]
    first, last = good[0], good[-1]
    kept = set(good)
    low = lambda n: n is None or density(n) < 0.25
    while first > 0 and (n := entries[first - 1]) and n.tag in HEADINGS and low(n):
        first -= 1
    while on and last + 1 < len(entries) and (n := entries[last + 1]) and low(n):
        before = entries[last]
        alike = n.tag == "section" or n.tag == best.tag and n.classes and n.classes == best.classes
        if not (n.tag in PARAGRAPHS or alike or before and before.tag in HEADINGS or n.tag in ("ul", "ol", "dl")):
            break
        last += 1
    return kept | {i for i in range(first, last + 1) if low(entries[i])} | {i for i, n in enumerate(entries) if loose and n and n.tag == "p" and low(n)}


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, joined by line ends."""
    blocks = article_blocks(page or "")
    if not blocks:
        return ""
    scored: dict[int, Node] = {}
    for node, block in blocks:
        points = 1 + (block.count(",") if block.isascii() else len(COMMAS.findall(block))) + min(len(block) / 100, 3)
        up = node.parent if node.tag in PARAGRAPHS and node.parent else node
        share = 1.0
        while up and share > 0.1:
            up.points += points * share
            scored[id(up)] = up
            up, share = up.parent, share / 2 if share == 1 else share / 1.5
    best = max(scored.values(), key=lambda n: n.points * (1 - density(n)))
    enough = max(10.0, 0.2 * best.points * (1 - density(best)))
    above, up = [], best
    while up:
        above.append(up)
        up = up.parent
    # The article that the best container stands in, or else the main element.
    whole = next((n for n in above if n.tag == "article"), None) or next((n for n in above if n.tag == "main"), None)
    top = whole or best
    levels = {id(n): i for i, n in enumerate(above)}
    at = levels[id(top)]
    # The children of top's parent in page order, which of them each block is in, and headings before top's ancestors.
    entries: list[Node | None] = []
    of: list[int] = []
    titles: list[int] = []
    places = Places(levels)
    for k, (node, _) in enumerate(blocks):
        level, child, _ = places.of(node)
        if level > at + 1:
            of.append(-1)
            if not entries:
                if child and child.tag in HEADINGS and density(child) < 0.25:
                    titles.append(k)
                else:
                    titles = []
            continue
        entry = top if level <= at else child
        if not entries or entry is None or entries[-1] is not entry:
            entries.append(entry)
        of.append(len(entries) - 1)
    around, ahead = run_around(entries, top, enough, not whole, top is best), set(titles)
    out = []
    for k, (node, block) in enumerate(blocks):
        level, _, menu = places.of(node)
        if (of[k] in around or k in ahead) and not menu and (level == 0 or density(node) <= 0.5):
            out.append(block)
    return "\n".join(out)


class Places:
    """Where elements stand as seen from the best container; levels: it and its ancestors, numbered from it upwards."""

    def __init__(self, levels: dict[int, int]):
        self.levels = levels
        self.known: dict[int, tuple[int, Node | None, bool]] = {}

    def of(self, node: Node) -> tuple[int, Node | None, bool]:
        """The level that holds the node, its child on the way there, and whether a menu is between."""
        path: list[Node] = []
        while (found := self.known.get(id(node))) is None and (at := self.levels.get(id(node))) is None:
            path.append(node)
            node = node.parent
        level, child, menu = found or (at, None, False)
        for x in reversed(path):
            child = child or x
            menu = menu or x.tag in MENUS and density(x) > 0.5
            self.known[id(x)] = level, child, menu
        return level, child, menu


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    plain = pages.select(named(id).cast("bigint").alias("page_id"), named(url).alias("url"), named(page).alias("html"))
    return plain.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
