"""HTML extraction by composite text density.

A page becomes a tree of nodes. Each node has C characters, T tags, and LC and LT of them
in links; its composite density is C/T * log_b(C/LC * T/LT) with
b = ln(C/(C-LC) * LC + LC_body/C_body * C + e). A node's sum is that of its children's
densities. The threshold is the least density on the path from the body to the block of the
greatest sum; the main subtree is the least one that holds that block and what lies beside
its path and reaches the threshold, is a heading (short by nature) or bare text. Density alone
chooses the block; an article or main element around it only says how far its loose neighbours reach:
inside one, what lies beside the path belongs to it however short, unless it is made of links or controls.

Page furniture is taken out before: elements that never hold text of their own (scripts,
styles, menus, footers, controls), and blocks whose class, id or role names furniture. A name
counts if all of its words are of such a kind ("comment-list", not "comment-on-law"), and names
are not judged alone: reader comments go by name; other furniture stays if it holds nearly all of
the page's text (nine tenths) without being made of links; what could as well be a part of an article
(search, share, related, notice and the like, a furniture word among others, or an aside) stays
inside one unless it is made of links or controls, or is short beside the article (a tenth). A form
goes if its controls outweigh its text. Hidden is what the hidden, style and aria-hidden attributes say.

Text of a block: references decoded, white space turned into one space, trimmed; blocks
are joined by one space in page order. Nothing else is dropped or cut.

Defined results: null or empty html gives empty text; pages that end early or leave tags
open are read as browsers roughly do (what is open closes at the end, a tag without an end is
no text); of equal sums the first block counts; very long pages are read whole, in time
proportional to their length; pages are judged one by one, so repeated rows agree; an empty
table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

# Element names by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr rt rp ruby".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = frozenset(
    "head script style noscript template iframe object embed svg canvas nav footer button select textarea input menu dialog title xmp noembed noframes audio video map".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("button select textarea input".split())
BLOCKS_CLOSE_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Words of class, id and role that name page furniture, what may be a part of an article too, and reader comments.
FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login social pagination pager toolbar skip copyright contentinfo".split()
)
DOUBTFUL = frozenset("aside complementary search share sharing related recommended notice promotion widget widgets disclaimer dialog alert".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
#: Words that only say which part of a block a name means.
PARTS = frozenset(
    "area author bar block body bottom box button buttons card cell center col column container content count desktop entry fixed footer form group head header holder icon icons inner item items large layer left "
    "link links list meta mobile module one outer page panel placeholder post posts primary reader reply respond results right row secondary section site slot small sticky text thread title top two unit user users wrap wrapper".split()
)
QUOTES = frozenset("quote pullquote pull".split())

# An attribute's value is quoted only right behind "="; a tag without an end goes on to the end of the page.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|(?=>)|[^\s\"'>][^\s>]*+)?+)*+)(>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")

#: What a node may be by its name: kept, dropped whatever it holds, furniture, doubtful, a form.
KEPT, GONE, FURNISHED, DOUBTED, FORM = range(5)


class Node:
    __slots__ = ("tag", "parent", "items", "kind", "inside", "quote", "chars", "tags", "link_chars", "link_tags", "controls", "density", "total", "drop", "held")

    def __init__(self, tag: str, parent: "Node | None", kind: int = KEPT, inside: bool = False):
        self.tag, self.parent, self.items, self.kind, self.inside, self.quote = tag, parent, [], kind, inside, False
        self.drop = kind == GONE
        self.held = inside or tag in ("article", "main")
        self._reset()

    def _reset(self) -> None:
        self.chars = self.link_chars = self.tags = self.link_tags = self.controls = 0
        self.density = self.total = 0.0


def _attributes(text: str) -> dict[str, str]:
    """By small name, the first of a name."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _names(attributes: dict[str, str]) -> list[set[str]]:
    """The words of each name in class, id and role, without numbers and single letters."""
    names = " ".join(attributes.get(a, "") for a in ("class", "id", "role")).split()
    return [{w for w in _SPLIT.split(_CAMEL.sub(r"\1-\2", n).lower()) if len(w) > 1 and not w.isdigit()} for n in names]


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(attributes.get("style", "")))


def _kind(tag: str, attributes: dict[str, str], names: list[set[str]], inside: bool) -> int:
    if tag in DROPPED or tag == "header" and not inside:
        return GONE
    if tag in ("html", "body", "article", "main"):
        return KEPT
    if _hidden(attributes) or any(n & COMMENTS and n <= COMMENTS | PARTS for n in names):
        return GONE
    furniture = FURNITURE if inside else FURNITURE | {"header"}
    if any(n & furniture and n <= furniture | DOUBTFUL | PARTS for n in names):
        return FURNISHED
    if any(n & furniture or n & DOUBTFUL and n <= DOUBTFUL | PARTS for n in names):
        return DOUBTED
    return DOUBTED if tag == "aside" else FORM if tag == "form" else KEPT


_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def parse(page: str) -> Node:
    """Tree of a page; items of a node are nodes and decoded strings in page order."""
    root = Node("#root", None)
    stack, where, blocks, walls, articles = [root], {}, [0], [0], 0  # places in the stack of each tag, of blocks, and of what stray end tags don't reach over

    def push(child: Node) -> None:
        nonlocal articles
        where.setdefault(child.tag, []).append(len(stack))
        if child.tag not in INLINE:
            blocks.append(len(stack))
        if child.tag in ("article", "td", "th"):
            walls.append(len(stack))
        articles += child.tag in ("article", "main")
        stack.append(child)

    def pop_to(place: int) -> None:
        nonlocal articles
        while len(stack) > place:
            tag = stack.pop().tag
            where[tag].pop()
            if tag not in INLINE:
                blocks.pop()
            if tag in ("article", "td", "th"):
                walls.pop()
            articles -= tag in ("article", "main")

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        raw = page[at : m.start() if m else n]
        if raw and not stack[-1].drop:
            stack[-1].items.append(_html.unescape(raw))
        if not m:
            break
        at = m.end()
        if not m[2] or not m[4]:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            place = where[tag][-1] if where.get(tag) else 0
            # an inline end tag doesn't close a block, nor anything an article or a table cell
            if tag in INLINE and place < blocks[-1] or place < walls[-1] and tag not in ("body", "html", "table", "tr", "main", "section", "div"):
                place = 0
            if place:
                pop_to(place)
            elif tag in ("p", "br") and not stack[-1].drop:
                stack[-1].items.append(Node("br", stack[-1]))
            continue
        ends = ("p",) if tag in BLOCKS_CLOSE_P else _ENDS.get(tag)
        if ends:
            k = len(blocks) - 1
            while k and (tag == "tr" and stack[blocks[k]].tag in ("td", "th") or tag == "li" and stack[blocks[k]].tag == "p") and stack[blocks[k]].tag not in ends:
                k -= 1
            if stack[blocks[k]].tag in ends:
                pop_to(blocks[k])
        up = stack[-1]
        known = _attributes(attributes) if attributes and not up.drop else {}
        names = _names(known)
        child = Node(tag, up, GONE if up.drop else _kind(tag, known, names, articles > 0), articles > 0)
        child.quote = tag in ("blockquote", "q") or any(n & QUOTES for n in names)
        up.items.append(child)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            if end is None and tag == "title":
                continue
            at = end.end() if end else n
            continue
        push(child)
    return root


def _nodes(root: Node) -> list[Node]:
    """All kept nodes, parents first."""
    out = [root]
    for x in out:
        out.extend(c for c in x.items if isinstance(c, Node) and not c.drop)
    return out


def _count(root: Node) -> list[Node]:
    nodes = _nodes(root)
    for x in nodes:
        x._reset()
    for x in reversed(nodes):
        x.chars += sum(len("".join(c.split())) for c in x.items if isinstance(c, str))
        x.controls += sum(isinstance(c, Node) and c.tag in CONTROLS for c in x.items)
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.tags + 1
        p = x.parent
        if p is not None:
            p.chars += x.chars
            p.tags += x.tags + 1
            p.link_chars += x.link_chars
            p.link_tags += x.link_tags
            p.controls += x.controls
            p.quote |= x.quote and p.kind == DOUBTED
    return nodes


def clear(root: Node) -> None:
    """Drop what is page furniture by its name and by what it holds."""
    nodes = _count(root)
    whole = root.chars
    article: dict[int, int] = {}  # text of the article or main element around a node
    for x in nodes:
        article[id(x)] = x.chars if x.tag in ("article", "main") else article.get(id(x.parent), 0)
        linked = 2 * x.link_chars > x.chars
        if x.kind == FURNISHED:
            x.drop = linked or 10 * x.chars < 9 * whole
        elif x.kind == DOUBTED:
            around = article[id(x)]
            if not x.inside:
                x.drop = linked or 2 * x.chars < whole
            else:
                x.drop = linked or x.controls > 0 or (10 * x.chars < around or x.tag == "aside") and not x.quote
        elif x.kind == FORM:
            x.drop = x.controls > 0 and x.chars < 100 * x.controls and 2 * x.chars < whole
        if x.parent is not None and x.parent.drop:
            x.drop = True


def weigh(root: Node) -> list[Node]:
    """Counts, densities and sums of all kept nodes."""
    nodes = _count(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    ratio = body.link_chars / max(1, body.chars)
    for x in nodes:
        c, t, lc, lt = x.chars, max(1, x.tags), x.link_chars, max(1, x.link_tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            x.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / max(base, 1e-9)
    for x in nodes:
        if x.parent is not None:
            x.parent.total += x.density
    return nodes


def main_node(root: Node) -> Node:
    """The main subtree of a weighed tree, by greatest sum and the threshold of the body's path."""
    nodes = weigh(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    inner, seen = [], {id(body)}
    for x in nodes:  # parents first
        if x is body or id(x.parent) in seen:
            seen.add(id(x))
            if x.tag not in INLINE:
                inner.append(x)
    best = max(inner, key=lambda x: x.total)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    # as far up as something beside the path belongs to it
    for x, up in zip(path, path[1:]):
        beside = [c for c in up.items if isinstance(c, Node) and c is not x and not c.drop and c.chars]
        loose = lambda c: up.held and 2 * c.link_chars <= c.chars and not c.controls
        if any(c.density >= threshold or c.tag in HEADINGS or loose(c) for c in beside) or any(isinstance(c, str) and c.strip() for c in up.items):
            best = up
    return best


def block_text(node: Node) -> str:
    """Blocks of a subtree, joined by one space."""
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif not x.drop:
            if x.tag not in INLINE:
                close()
                stack.append(None)
            stack.extend(reversed(x.items))
    close()
    return " ".join(blocks)


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    clear(root)
    return block_text(main_node(root))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row an input row: id, ``keep`` (none of them id, text or n_chars), text, n_chars (code points)."""
    if clash := {c.lower() for c in keep} & {"id", "text", "n_chars"}:
        raise ValueError(f"columns that the result has itself can't be kept: {sorted(clash)}")
    small_batches(pages.sparkSession)
    kept = pages.select(F.col(id_col).alias("id"), *keep)

    def run(batches):
        for b in batches:
            texts = [extract(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", *keep, "text", "n_chars"]
            )

    return pages.select(F.col(id_col).alias("id"), *keep, F.col(html_col).alias(fresh(kept, "_html"))).mapInArrow(run, kept.schema.add("text", "string").add("n_chars", "long"))
