"""Main text of web pages by wrapper induction.

Pages of one host are aligned, node by node, with that host's first page by simple tree matching. What the
aligned nodes have in common over the host tells what each of them is:

* Text that is the same in nearly all of the pages aligned there (90 %, of eight or more) is template. On a host
  of eight pages or fewer, which can't have as many, it is what all others that are aligned there share with the
  first page, three of them at least.
* The content is the slot that varying text outside of links gathers in. From the root down, it is the child with
  four fifths of that text, as long as there is one, has blocks of its own, and has no heading beside it.
* In and beside the content, containers that are mostly links, and small ones whose length hardly varies, are left out.

A second pass takes from each page what stands in its content. What elements say of themselves (menus, forms,
comments, scripts) only decides what alignment leaves open: slots that the host's first page lacks, parts of the
content, pages on hosts without a template; and whether a slot with much text is one of comments.

Both passes read the pages without a shuffle. What they look up is one small tree per host; those trees are
broadcast while they take ``max_bytes`` or less, and joined by host beyond it (Spark splits a host that is too
large for one task). Counts are summed within each task before they are exchanged.

Defined results: a null page is empty and has an empty text; a page on a host of three pages or fewer, or whose
host can't be read, has no template and is read by its elements only; pages that repeat the first page word for
word don't count as evidence; repeated rows are extracted one by one; an empty table gives no rows. Whole pages
are read in time that grows with their length, but for the matching of subtrees: pairs of subtrees with more than
``_MANY`` pairs of nodes count as their labels alone when children are matched. Elements may be nested as deep as a
page has it. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.urlcascade import url_parts
from millrace.plans.scratch import write_table

# Names of HTML elements, and words that pages use for what isn't their text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr br math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
SKIPPED = RAW | set("head nav footer aside form button select option input svg canvas template dialog object audio video menu".split())
CLOSED_BY = {
    "p": set("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table td th tr ul".split()),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
}
CLOSES = {tag: [t for t, by in CLOSED_BY.items() if tag in by] for tag in set().union(*CLOSED_BY.values())}
BARRIERS = set("ul ol dl table article section div main body html td th nav aside footer header form blockquote".split())
SIDE_WORDS = set(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager sidebar side rail footer masthead topbar toolbar ad ads"
    " adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice"
    " notices notification alert popup modal overlay share sharing social related recommended recommendations comment comments disqus respond"
    " discussion replies newsletter subscribe subscription signup login signin register widget widgets search skip disclaimer copyright tags".split()
)
#: First words of class names that say what an element is beside, or is part of, not what it is.
ABOUT_WORDS = set("no not non without has have with is main text content article post page layout body".split())
SIDE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note status".split())
MAIN_WORDS = set("content article post entry story main articlebody maincontent text".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/a-zA-Z][^>]*(?:>|\Z)|([^<]+)|<""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
COMMENT_WORDS = set("comment comments disqus respond discussion replies".split())
ALWAYS_SIDE = COMMENT_WORDS | set("nav navbar navigation menu menubar submenu breadcrumb breadcrumbs footer cookie cookies consent".split())
HEADINGS = {"h1", "h2"}
CONTAINERS = set("div section ul ol dl table tbody tr td aside nav header footer form fieldset".split())
TEXT = "#"
#: Pairs of nodes up to which two subtrees are compared node by node to weigh a match of theirs.
_MANY = 250_000
#: Pairs of children up to which their matching is traced in a table; longer lists are halved.
_TABLE = 4096


class Node:
    """An element or (label TEXT) a stretch of text. ``shape`` is a digest of the labels of a subtree.

    Of a host's tree, ``at`` is the node's number, ``fixed`` marks template text and ``role`` content and what is left out.
    """

    __slots__ = ("articles", "at", "chars", "children", "fixed", "label", "links", "named", "role", "shape", "side", "size", "tag", "text", "words")

    def __init__(self, tag: str, text: str = "", words: frozenset = frozenset(), side: bool = False):
        self.tag, self.text, self.words, self.side = tag, text, words, side
        self.children: list[Node] = []
        self.label, self.shape, self.size, self.fixed, self.role = tag, 0, 1, False, ""
        self.at = self.chars = self.links = self.articles = 0
        self.named = False


def _names_side(names: str) -> bool:
    """Whether a class, an id or the like says that an element isn't text."""
    for name in names.split():
        words = _WORDS.findall(name)
        if words and words[0] not in ABOUT_WORDS and not SIDE_WORDS.isdisjoint(words):
            return True
    return False


def _element(tag: str, attrs: str) -> Node:
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if attrs.strip() else {}
    names = " ".join(found.get(k, "") for k in ("class", "id", "itemprop")) if found else ""
    words = frozenset(_WORDS.findall(names))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    side = tag in SKIPPED or hidden or found.get("role") in SIDE_ROLES
    named = not side and _names_side(names)
    node = Node(tag, words=words | ({"main"} if found.get("role") == "main" else set()), side=(side or named) and tag not in ("html", "body"))
    node.named = named
    node.label = f"{tag}.{' '.join(sorted(words))}" if words else tag
    return node


def parse(html: str | None) -> Node:
    """The tree of a page; forgiving about what isn't closed. Scripts, comments and the like leave nothing."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # subtrees are weighed by plain calls, which take no C stack
    root = Node("html")
    stack, at, html = [root], 0, html or ""
    opened: Counter = Counter()  # elements of the stack, so that it isn't searched for what isn't there

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    while m := _TOKEN.match(html, at):
        at = m.end()
        closing, tag, attrs, text = m.groups()
        if text or m[0] == "<":
            stack[-1].children.append(Node(TEXT, text or "<"))
        elif tag is None:
            continue
        elif closing:
            tag = tag.lower()
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in BARRIERS and tag not in BARRIERS:
                    break
        else:
            tag = tag.lower()
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag in ("html", "body"):
                continue
            for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in CLOSES.get(tag, ())) else ():
                if tag in CLOSED_BY.get(stack[i].tag, ()):
                    close(i)
                    break
                if stack[i].tag in BARRIERS:
                    break
            node = _element(tag, attrs)
            stack[-1].children.append(node)
            if tag not in VOID and not attrs.rstrip().endswith("/"):
                stack.append(node)
                opened[tag] += 1
    return _finish(root)


def _finish(root: Node) -> Node:
    """Merges neighbouring stretches of text, drops blank ones, and works out shapes and sizes from the leaves up."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        kids: list[Node] = []
        run: list[str] = []
        for k in [*node.children, None]:
            if k is not None and k.tag == TEXT:
                run.append(k.text)
                continue
            if run:
                kids.append(Node(TEXT, "".join(run)))
                run = []
            if k is not None:
                kids.append(k)
        node.children = kids
        todo += kids
    for node in reversed(order):
        shapes, size, letters = [], 1, 0
        articles = 1 if node.tag in ("article", "main") or "articlebody" in node.words else 0
        for k in node.children:
            size += k.size
            if k.tag != TEXT:
                shapes.append(k.shape)
                letters += k.chars
                articles += k.articles
            elif n := len(k.text.strip()):
                shapes.append(k.shape)
                letters += n
        node.shape, node.size = hash((node.label, tuple(shapes))), size
        if not node.side or node.named:
            node.articles, node.chars = articles, letters
    # a class name doesn't make a side of what holds all of a page's articles, or (but for menus and comments) most of its text if it has none
    todo = [root] if any(n.named for n in order) else []
    while todo:
        node = todo.pop()
        if node.named and node.side and (node.articles == root.articles if root.articles else 2 * node.chars > root.chars and ALWAYS_SIDE.isdisjoint(node.words)):
            node.side = False
        todo += [k for k in node.children if k.tag != TEXT]
    return root


def aligned(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of nodes of a largest order-keeping match of two trees with equal labels at the root.

    Children of like shape at the front and at the back of both lists are matched as they stand, which can't
    lose anything; what lies between them is matched by dynamic programming over the subtrees' match sizes.
    """
    pairs: list[tuple[Node, Node]] = []
    todo = [(a, b)]
    sizes: dict[tuple[int, int], int] = {}
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        todo += _matched_children(x, y, sizes)
    return pairs


def _ends(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
    """How many children are alike at the front, and of the rest at the back."""
    n = min(len(xs), len(ys))
    front = 0
    while front < n and xs[front].shape == ys[front].shape:
        front += 1
    back = 0
    while back < n - front and xs[-1 - back].shape == ys[-1 - back].shape:
        back += 1
    return front, back


def _kids(node: Node) -> list[Node]:
    return [k for k in node.children if k.tag != TEXT or k.text.strip()]


def _matched_children(x: Node, y: Node, sizes: dict) -> list[tuple[Node, Node]]:
    xs, ys = _kids(x), _kids(y)
    front, back = _ends(xs, ys)
    out = [*zip(xs[:front], ys[:front], strict=True), *zip(xs[len(xs) - back :], ys[len(ys) - back :], strict=True)]
    todo = [(xs[front : len(xs) - back], ys[front : len(ys) - back])]
    while todo:
        xs, ys = todo.pop()
        if not xs or not ys:
            continue
        if len(xs) * len(ys) <= _TABLE:
            out += _traced(xs, ys, sizes)
        elif len(xs) == 1:
            j = int(np.argmax(_weights(xs, ys, sizes)(0)))
            if xs[0].label == ys[j].label:
                out.append((xs[0], ys[j]))
        else:  # halves of the one list, with that cut of the other that loses nothing: two rows in memory, not a table
            half = len(xs) // 2
            ahead, behind = _last_row(xs[:half], ys, sizes), _last_row(xs[half:][::-1], ys[::-1], sizes)[::-1]
            cut = int(np.argmax(ahead + behind))
            todo += [(xs[:half], ys[:cut]), (xs[half:], ys[cut:])]
    return out


def _traced(xs: list[Node], ys: list[Node], sizes: dict) -> list[tuple[Node, Node]]:
    """The pairs of a best match of two short lists."""
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, p in enumerate(xs, 1):
        for j, q in enumerate(ys, 1):
            both = best[i - 1][j - 1] + _match_size(p, q, sizes) if p.label == q.label else 0
            best[i][j] = max(both, best[i - 1][j], best[i][j - 1])
    out, i, j = [], len(xs), len(ys)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
    return out


def _weights(xs: list[Node], ys: list[Node], sizes: dict):
    """A function that gives, for a number in xs, the match sizes with all of ys. Subtrees of like shape are weighed once."""
    kinds: dict[tuple, tuple[int, Node]] = {}
    which = np.array([kinds.setdefault((y.label, y.shape), (len(kinds), y))[0] for y in ys])
    known: dict[tuple, np.ndarray] = {}

    def row(i: int) -> np.ndarray:
        x = xs[i]
        key = (x.label, x.shape)
        if key not in known:
            known[key] = np.array([_match_size(x, y, sizes) if x.label == y.label else 0 for _, y in kinds.values()], np.int64)
        return known[key][which]

    return row


def _last_row(xs: list[Node], ys: list[Node], sizes: dict) -> np.ndarray:
    """The size of the best match of xs with the first 0, 1, 2 ... of ys."""
    weights, best = _weights(xs, ys, sizes), np.zeros(len(ys) + 1, np.int64)
    for i in range(len(xs)):
        w = weights(i)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(w > 0, best[:-1] + w, 0)))
    return best


def _match_size(p: Node, q: Node, sizes: dict) -> int:
    if p.shape == q.shape:
        return p.size
    if p.size * q.size > _MANY:
        return 1
    key = (p.shape, q.shape)
    if key not in sizes:
        xs, ys = _kids(p), _kids(q)
        front, back = _ends(xs, ys)
        total = 1 + sum(k.size for k in xs[:front]) + sum(k.size for k in xs[len(xs) - back :])
        xs, ys = xs[front : len(xs) - back], ys[front : len(ys) - back]
        row = [0] * (len(ys) + 1)
        for a in xs if ys else ():
            old = row
            row = [0]
            for j, b in enumerate(ys, 1):
                both = old[j - 1] + _match_size(a, b, sizes) if a.label == b.label else 0
                row.append(max(both, old[j], row[j - 1]))
        sizes[key] = total + row[-1]
    return sizes[key]


def clean(text: str) -> str:
    """Character references decoded, white space to single spaces, trimmed."""
    return " ".join(unescape(text).split())


# -- a host's tree


def dump_tree(root: Node) -> str:
    """A tree as JSON: for each node, in order, its depth, label, (of text) a digest, and whether it says that it isn't text."""
    rows, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        digest = zlib.crc32(clean(node.text).encode("utf-8", "surrogatepass")) if node.tag == TEXT else 0
        rows.append([depth, node.label, digest, int(node.side)])
        todo += [(k, depth + 1) for k in reversed(_kids(node))]
    return json.dumps(rows, ensure_ascii=False, separators=(",", ":"))


def load_tree(dumped: str, fixed: list[int] | None = None, content: int | None = None, dropped: list[int] | None = None) -> list[Node]:
    """The nodes of a dumped tree, in order; ``text`` is the digest. The other parameters are numbers of nodes."""
    nodes, path = [], []
    for depth, label, digest, side in json.loads(dumped):
        tag, _, words = label.partition(".")
        node = Node(tag, text=str(digest), words=frozenset(words.split()))
        node.side = bool(side)
        node.label, node.at = label, len(nodes)
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
        nodes.append(node)
    for node in reversed(nodes):
        node.shape = hash((node.label, tuple(k.shape for k in node.children)))
        node.size = 1 + sum(k.size for k in node.children)
    for i in fixed or ():
        nodes[i].fixed = True
    for i in dropped or ():
        nodes[i].role = "dropped"
    if content is not None:
        nodes[content].role = "content"
    return nodes


def measure(root: Node) -> None:
    """Sets chars (of text, white space run together) and links (those of them in links) of each node."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    for node in reversed(order):
        node.chars = len(clean(node.text)) if node.tag == TEXT else sum(k.chars for k in node.children)
        node.links = node.chars if node.tag == "a" else sum(k.links for k in node.children)


def choose_slots(nodes: list[Node], stats: dict[int, tuple[int, int, int, float]], fixed: set[int], enough: int, share: float = 0.8) -> tuple[int, list[int]]:
    """The content's number, and those of containers to leave out, from a host's sums of (pages, chars, chars in links,
    squares of chars) by node."""
    plain = [0] * len(nodes)
    for node in reversed(nodes):  # children follow their parents
        _, chars, links, _ = stats.get(node.at, (0, 0, 0, 0.0))
        plain[node.at] += 0 if node.at in fixed else chars - links
        for k in node.children:
            if k.at in fixed:
                plain[node.at] -= stats[k.at][1]
            elif k.tag != TEXT:  # what is template further down isn't counted further up
                plain[node.at] -= stats.get(k.at, (0, 0, 0, 0.0))[1] - stats.get(k.at, (0, 0, 0, 0.0))[2] - plain[k.at]
    node = nodes[0]
    while node.tag not in ("article", "main"):
        left, best = plain[node.at], None
        for k in sorted((k for k in node.children if k.tag != TEXT and k.tag not in INLINE), key=lambda k: -plain[k.at]):
            if k.side and (k.tag in SKIPPED or k.words & COMMENT_WORDS or plain[k.at] < 0.9 * left):
                left -= plain[k.at]  # says of itself that it isn't the content
            elif best is None:
                best = k
        if best is None or plain[best.at] < share * left or not left or best.tag in ("p", *HEADINGS):
            break
        if not any(k.tag != TEXT and k.tag not in INLINE for k in best.children):
            break
        if any(k is not best and not k.side and plain[k.at] > 0 and _has_heading(k) for k in node.children):
            break
        node = best
    sized = {k.at: stats[k.at] for k in node.children if k.at in stats and stats[k.at][0] >= enough}
    largest = max((chars / met for met, chars, _, _ in sized.values()), default=0)
    dropped = []
    for k in node.children:
        if k.at in sized and k.tag in CONTAINERS and not _has_heading(k):
            met, chars, links, squares = sized[k.at]
            mean = chars / met
            flat = squares / met - mean * mean <= (0.5 * mean) ** 2
            if chars and (2 * links > chars or (flat and mean <= 0.2 * largest)):
                dropped.append(k.at)
    return node.at, dropped


def _digests(root: Node) -> list[str]:
    """The digests of a page's texts, in order."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == TEXT:
            found.append(_digest(node))
        todo += reversed(_kids(node))
    return found


def _digest(node: Node) -> str:
    return str(zlib.crc32(clean(node.text).encode("utf-8", "surrogatepass")))


# -- text of a page


def _content_root(root: Node, ranks: tuple[int, ...] = (0, 1, 2)) -> Node:
    """The largest article outside of what isn't text; else main, else an element named as content, else the root."""
    found: dict[int, list[Node]] = {0: [], 1: [], 2: []}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.side and node is not root:
            continue
        rank = 0 if node.tag == "article" or "articlebody" in node.words else 1 if node.tag == "main" or "main" in node.words else 2 if node.words & MAIN_WORDS else None
        if rank is not None:
            found[rank].append(node)
        todo += node.children
    for rank in ranks:
        if found[rank]:
            sized = [(sum(map(len, _blocks(n))), n) for n in found[rank]]
            best = max(sized, key=lambda x: x[0])
            if best[0]:
                return best[1]
    return root


def _blocks(root: Node) -> list[str]:
    """The text of each block below a node, in order, without sides and template text."""
    blocks, open_text = [], []
    in_article = root.tag == "article" or "articlebody" in root.words

    def close() -> None:
        if text := clean("".join(open_text)):
            blocks.append(text)
        open_text.clear()

    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, done = todo.pop()
        if done:
            close()
        elif node.tag == TEXT:
            if not node.fixed:
                open_text.append(node.text)
        elif node is not root and (node.side or (_is_header(node) and not (in_article and _has_heading(node)))):
            close()
        elif node.tag in ("br", "wbr", "img"):
            open_text.append(" " if node.tag == "br" else "")
        else:
            if node.tag not in INLINE:
                close()
                todo.append((node, True))
            todo += [(k, False) for k in reversed(node.children)]
    close()
    return blocks


def _is_header(node: Node) -> bool:
    return node.tag == "header" or "header" in node.words


def _has_heading(node: Node) -> bool:
    todo = [node]
    while todo:
        node = todo.pop()
        if node.tag in HEADINGS:
            return True
        todo += node.children
    return False


def page_text(html: str | None, template: list[Node] | None = None) -> str:
    """The main text of a page: blocks, each on a line of its own. template: of load_tree()."""
    root, content = parse(html), None
    for mine, other in aligned(root, template[0]) if template else ():
        if mine.tag == TEXT:
            mine.fixed = other.fixed and _digest(mine) == other.text
        elif other.role == "dropped":
            mine.side = True
        elif other.role == "content":
            content = mine
    blocks = _blocks(_content_root(content, (0, 1))) if content is not None else []
    return "\n".join(blocks or _blocks(_content_root(root)))


# -- jobs


def _lookup(spark, per_host: DataFrame, size_col: str, max_bytes: int):
    """A broadcast dictionary of host -> row, or None if the rows would take more than max_bytes."""
    total = per_host.agg(F.sum(F.octet_length(size_col) + F.octet_length("host") + 64)).first()[0] or 0
    if total > max_bytes:
        return None
    return spark.sparkContext.broadcast({r["host"]: r.asDict() for r in per_host.toLocalIterator()})


_STATS = "host string, node int, met long, same long, chars long, links long, squares double"


def induce_templates(pages: DataFrame, max_bytes: int = 32 << 20, min_pages: int = 8, share: float = 0.9, few_pages: int = 3) -> DataFrame:
    """host, tree, and numbers of the tree's nodes: fixed (template text), content, dropped; from rows of (page_id, host, html)."""
    spark = pages.sparkSession
    rows = pages.filter("host != '' and html is not null")
    first = rows.groupBy("host").agg(F.min("page_id").alias("page_id"), F.count("*").alias("pages")).filter(F.col("pages") > few_pages)
    first = write_table(first, "hosts")
    few_hosts = (first.agg(F.sum(F.octet_length("host") + 32)).first()[0] or 0) <= max_bytes

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dumped = [dump_tree(parse(h)) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dumped, pa.string()), batch.column(2)], names=["host", "tree", "small"])

    small = F.col("pages") <= min_pages
    seeds = rows.join(F.broadcast(first) if few_hosts else first, ["host", "page_id"]).select("host", "html", small.alias("small"))
    seeds = write_table(seeds.mapInArrow(trees, "host string, tree string, small boolean").groupBy("host").agg(F.min(F.struct("tree", "small")).alias("s")).select("host", "s.*"), "seeds")
    found = _lookup(spark, seeds, "tree", max_bytes)
    rows = rows.select("host", "html")
    if found is None:
        rows = rows.join(seeds, "host")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, list[Node]] = {}
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for host, own in sums.items():
                nodes = np.flatnonzero(own[:, 0])
                ints = [pa.array(own[nodes, k].astype(np.int64)) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host] * len(nodes), pa.string()), pa.array(nodes.astype(np.int32)), *ints, pa.array(own[nodes, 4])],
                    names=["host", "node", "met", "same", "chars", "links", "squares"],
                )

        for batch in batches:
            trees_here = batch.column("tree").to_pylist() if found is None else None
            for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                tree = trees_here[i] if found is None else found.value.get(host, {}).get("tree")
                if tree is None:
                    continue
                if host not in loaded:
                    if len(loaded) > 2000:
                        yield from told()
                        loaded.clear()
                        sums.clear()
                    loaded[host] = load_tree(tree)
                    sums[host] = np.zeros((len(loaded[host]), 5))
                root = parse(html)
                measure(root)
                pairs = [(x, y, x.tag == TEXT and _digest(x) == y.text) for x, y in aligned(root, loaded[host][0])]
                if all(same for x, _, same in pairs if x.tag == TEXT) and _digests(root) == [n.text for n in loaded[host] if n.tag == TEXT]:
                    continue
                own = sums[host]
                for x, y, same in pairs:
                    own[y.at] += (1, same, x.chars, x.links, x.chars * x.chars)
        yield from told()

    sums = ["met", "same", "chars", "links", "squares"]
    summed = rows.mapInArrow(count, _STATS).groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in sums))
    by_host = summed.groupBy("host").agg(F.collect_list(F.struct("node", *sums)).alias("stats"))  # as many as a tree's nodes

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                nodes = load_tree(r["tree"])
                alike = {
                    x["node"]
                    for x in r["stats"]
                    if nodes[x["node"]].tag == TEXT
                    and ((x["met"] >= min_pages and x["same"] >= share * x["met"]) or (r["small"] and x["met"] >= few_pages and x["same"] == x["met"]))
                }
                stats = {x["node"]: (x["met"], x["chars"], x["links"], x["squares"]) for x in r["stats"]}
                content, dropped = choose_slots(nodes, stats, alike, few_pages if r["small"] else min_pages)
                out.append((r["host"], r["tree"], sorted(alike), content, dropped))
            columns = zip(*out, strict=True) if out else [()] * 5
            types = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "tree", "fixed", "content", "dropped"])

    return seeds.join(by_host, "host").mapInArrow(choose, "host string, tree string, fixed array<int>, content int, dropped array<int>")


def extract_text(pages: DataFrame, max_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every row."""
    spark = pages.sparkSession
    keyed = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), url_parts(F.col(url_col))[0].alias("host"), F.col(html_col).cast("string").alias("html")
    )
    templates = write_table(induce_templates(keyed, max_bytes), "templates")
    found = _lookup(spark, templates, "tree", max_bytes)
    rows = keyed if found is not None else keyed.join(templates, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, list[Node]] = {}
        for batch in batches:
            texts = []
            trees = None if found is not None else batch.select(["tree", "fixed", "content", "dropped"]).to_pylist()
            for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                row = trees[i] if trees else found.value.get(host)
                if row and row["tree"] and host not in loaded:
                    if len(loaded) > 2000:
                        loaded.clear()
                    loaded[host] = load_tree(row["tree"], row["fixed"], row["content"], row["dropped"])
                texts.append(page_text(html, loaded.get(host) if row else None))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
