"""Main text of web pages by wrapper induction.

For each host the pages of its most common layout lend one reference tree.
Every page's DOM tree (runs of like siblings as one node) is aligned with its
host's reference by simple tree matching. Counts over all pages of the host
tell, for each reference node, how often it occurs, how often its text is the
reference's own, and how much of it is links: constant nodes are template,
varying ones are slots. The content is the subtree that holds most slot text,
without template nodes and without what names itself menu, footer, advert,
form, comments and the like. A page that doesn't align is judged by itself.

Reference trees and decisions are one short row for each host; they are
broadcast if a count proves them few, else joined. Counts are summed before
they are shuffled, so a host with a third of all pages costs no more.

Null pages are empty and yield an empty text. Pages without a host (null or
malformed address) share one. Broken markup, unclosed elements and stray "<"
are read like browsers do; nesting beyond MAX_DEPTH is flattened, no text
is lost. Repeated rows yield repeated rows. Other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfeed.llm._common import materialize, sized_broadcast, text_chunks

MAX_DEPTH = 150
#: Reference trees that one broadcast may hold.
BROADCAST_HOSTS = 50_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed".split())
#: Elements that an opening tag of the kind ends, up to the nearest of the containers.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Element names, and words of classes and ids, of what isn't main text.
OTHER_TAGS = frozenset("head nav footer aside form button select dialog svg canvas object script style title textarea noscript template iframe xmp noembed".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus dropdown footer "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets alert complementary contentinfo form".split()
)
#: Elements that a class or id alone never makes other than main text.
KEPT_TAGS = frozenset("html body main article".split())


class Node:
    """An element: its label (name and stable class), its pieces of text and elements in order."""

    __slots__ = ("tag", "label", "other", "parts", "blocks", "depth", "number")

    def __init__(self, tag: str, label: str, other: bool, depth: int):
        self.tag, self.label, self.other, self.depth = tag, label, other, depth
        self.parts: list = []
        self.blocks: list[Node] = []
        self.number = -1


def _describe(tag: str, attributes: str) -> tuple[str, bool]:
    label, words = tag, []
    if attributes and ("=" in attributes):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value = a or b or c
            words += [w.lower() for w in _PARTS.findall(value)]
            if name.lower() != "role":
                label += "." + re.sub(r"[0-9]+", "", value.lower())[:40]
    return label, tag in OTHER_TAGS or tag not in KEPT_TAGS and any(w in OTHER_WORDS for w in words)


def parse(page: str) -> Node:
    """The page's tree."""
    root = Node("", "", False, 0)
    stack = [root]
    at, n = 0, len(page)
    lower = None
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].parts.append(html_lib.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            else:
                if tag == "p" or tag == "br":
                    stack[-1].parts.append(" ")
            continue
        if tag in VOID:
            stack[-1].parts.append("" if tag in INLINE else " ")
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in CLOSES:
            ended, limit = CLOSES[tag]
            ended = ended.split()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in limit:
                    break
                if stack[i].tag in ended:
                    del stack[i:]
                    break
        label, other = _describe(tag, m[3])
        top = stack[-1]
        if tag == "header" and not other:
            other = not any(x.tag in ("article", "main") for x in stack)
        node = Node(tag, label, other, len(stack))
        top.parts.append(node)
        if tag not in INLINE:
            owner = next(x for x in reversed(stack) if x.tag not in INLINE)
            owner.blocks.append(node)
        if tag in RAW:
            lower = lower if lower is not None else page.lower()
            end = lower.find("</" + tag, at)
            if end < 0:
                at = n
            else:
                close = page.find(">", end)
                at = n if close < 0 else close + 1
            continue
        if m[3].endswith("/") and tag in ("svg", "path", "g"):
            continue
        if len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def own_text(node: Node) -> tuple[str, int, int]:
    """The text of a node without its blocks; its length and how much of it is in links."""
    out: list[str] = []
    linked = 0
    todo = [(p, False) for p in reversed(node.parts)]
    while todo:
        p, link = todo.pop()
        if isinstance(p, str):
            out.append(p)
            if link:
                linked += len(p)
        elif p.tag in INLINE:
            if not p.other:
                todo += [(x, link or p.tag == "a") for x in reversed(p.parts)]
        else:
            out.append(" ")
    text = " ".join("".join(out).split())
    return text, len(text), min(linked, len(text))


def all_text(node: Node, skip) -> str:
    """The text of a subtree without the nodes that skip() names; blocks are set apart by a space."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            out.append(p)
        elif p is node or not skip(p):
            if p.tag in INLINE:
                todo += reversed(p.parts)
            else:
                out.append(" ")
                todo.append(" ")
                todo += reversed(p.parts)
    return " ".join("".join(out).split())


class Shape:
    """A node of the tree used for alignment: like siblings in a row are one."""

    __slots__ = ("label", "other", "kids", "nodes", "number", "text", "linked", "digest")

    def __init__(self, label: str, other: bool):
        self.label, self.other = label, other
        self.kids: list[Shape] = []
        self.nodes: list[Node] = []
        self.number, self.text, self.linked, self.digest = -1, 0, 0, 0


def shape(nodes: list[Node], other: bool = False) -> Shape:
    """The shape of a run of like nodes: their blocks, the longest row of them setting the order."""
    s = Shape(nodes[0].label, other or nodes[0].other)
    s.nodes = nodes
    crc = 0
    for x in nodes:
        text, length, linked = own_text(x)
        s.text += length
        s.linked += linked
        crc = zlib.crc32(text.encode("utf-8", "replace"), crc)
    s.digest = crc
    runs: list[list[Node]] = []
    by_label: dict[str, list[Node]] = {}
    single = len(nodes) == 1
    for x in nodes:
        for b in x.blocks:
            if runs and runs[-1][-1].label == b.label:
                runs[-1].append(b)
            elif single or b.label not in by_label:
                runs.append([b])
                by_label[b.label] = runs[-1]
            else:
                by_label[b.label].append(b)
    s.kids = [shape(r, s.other) for r in runs]
    return s


def numbered(s: Shape) -> list[Shape]:
    """All shapes of a tree in document order, with their numbers."""
    out, todo = [], [s]
    while todo:
        x = todo.pop()
        x.number = len(out)
        out.append(x)
        todo += reversed(x.kids)
    return out


def align(a: Shape, b: Shape, pairs: list[tuple[Shape, Shape]] | None = None) -> int:
    """Simple tree matching: the number of node pairs in the largest order-keeping match of two trees; pairs gets them."""
    if a.label != b.label:
        return 0
    here: list[tuple[Shape, Shape]] = [(a, b)]
    m, n = len(a.kids), len(b.kids)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    sub: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, m + 1):
        row, above = best[i], best[i - 1]
        x = a.kids[i - 1]
        for j in range(1, n + 1):
            w = 0
            if x.label == b.kids[j - 1].label:
                inner: list = []
                w = align(x, b.kids[j - 1], inner)
                sub[i, j] = (w, inner)
            row[j] = max(row[j - 1], above[j], above[j - 1] + w)
    i, j = m, n
    while i and j:
        if (i, j) in sub and best[i][j] == best[i - 1][j - 1] + sub[i, j][0]:
            here += sub[i, j][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    if pairs is not None:
        pairs += here
    return 1 + best[m][n]


def skeleton(s: Shape, depth: int = 4) -> int:
    """A digest of the labels of a tree's upper levels."""
    paths, todo = set(), [(s, "", 0)]
    while todo:
        x, path, d = todo.pop()
        path += "/" + x.label
        paths.add(path)
        if d < depth:
            todo += [(k, path, d + 1) for k in x.kids]
    return zlib.crc32("\n".join(sorted(paths)).encode())


def to_json(s: Shape) -> str:
    nodes = numbered(s)
    parent = {k.number: x.number for x in nodes for k in x.kids}
    return json.dumps([[parent.get(x.number, -1), x.label, int(x.other), x.digest, x.text] for x in nodes])


def from_json(text: str) -> list[Shape]:
    nodes: list[Shape] = []
    for i, (parent, label, other, digest, length) in enumerate(json.loads(text)):
        x = Shape(label, bool(other))
        x.number, x.digest, x.text = i, digest, length
        nodes.append(x)
        if parent >= 0:
            nodes[parent].kids.append(x)
    return nodes


def decide(nodes: list[Shape], stats: dict[int, tuple[int, int, int, int]], pages: int) -> tuple[int, list[int]]:
    """The number of the content node and those of template nodes. stats: (pages, pages with the
    reference's text, characters, characters in links) of each node."""

    def template(x: Shape) -> bool:
        seen, same, chars, linked = stats.get(x.number, (0, 0, 0, 0))
        if not seen or not chars:
            return False
        return linked > 0.6 * chars or (pages >= 5 and same >= 0.9 * seen and chars < 120 * seen)

    dropped = [x.number for x in nodes if not x.other and template(x)]
    gone = set(dropped)
    volume, varying = [0.0] * len(nodes), [0.0] * len(nodes)
    for x in reversed(nodes):
        seen, same, chars, _ = stats.get(x.number, (0, 0, 0, 0))
        own = 0 if x.other or x.number in gone else chars
        volume[x.number] = own + sum(volume[k.number] for k in x.kids)
        # of few pages none is known to be constant
        varying[x.number] = (own if pages < 5 or same < 0.9 * seen else 0) + sum(varying[k.number] for k in x.kids)
    total = volume[0]
    if not total:
        return 0, dropped
    named = [x for x in nodes if not x.other and re.match(r"(article|main)(\.|$)", x.label) and volume[x.number] >= 0.4 * total]
    if named:
        return max(named, key=lambda x: (x.label.startswith("article"), volume[x.number], -x.number)).number, dropped
    x = nodes[0]
    while True:
        most = max(x.kids, key=lambda k: volume[k.number], default=None)
        # varying slots outside the child (a title, a lead) are content too
        if most is None or volume[most.number] < 0.75 * volume[x.number] or varying[most.number] < varying[x.number] or re.match(r"(p|h[1-6]|ul|ol|li|table|blockquote|pre|tr|td|tbody|dl)(\.|$)", most.label):
            return x.number, dropped
        x = most


def content(page: str, reference: list[Shape] | None, root: int, dropped: set[int]) -> str:
    """The main text of a page, by its host's reference; by itself if it doesn't align with it."""
    tree = parse(page)
    own = shape([tree])
    nodes = numbered(own)
    chosen, skip = None, set()
    if reference is not None:
        pairs: list[tuple[Shape, Shape]] = []
        align(own, reference[0], pairs)
        chosen = next((a for a, b in pairs if b.number == root), None)
        if chosen is not None and (root or not any(b.number for _, b in pairs if b.number)) or root == 0 and len(pairs) * 2 >= len(nodes):
            skip = {id(x) for a, b in pairs if b.number in dropped for x in a.nodes}
        else:
            chosen = None
    if chosen is None:
        number, template = decide(nodes, {x.number: (1, 0, x.text, x.linked) for x in nodes}, 1)
        chosen, skip = nodes[number], {id(x) for t in template for x in nodes[t].nodes}
    # a template node's own text goes; its slots stay
    found = [all_text(x, lambda p: p.other or (id(p) in skip and not p.blocks)) for x in chosen.nodes]
    return " ".join(t for t in found if t)


def host_of():
    """The host of the column `url`, lower-cased, without port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of())
    id_type = pages.schema[id_col].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                digest = [skeleton(shape([parse(t)])) if t else None for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.int64()), part.column(2)], names=["host", "layout", "id"])

    layouts = rows.select("host", "html", "id").mapInArrow(look, f"host string, layout long, id {id_type}").where("layout is not null and id is not null")
    common = layouts.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    lenders = common.groupBy("host").agg(F.max(F.struct("n", "layout", "id")).alias("m")).select("host", F.col("m.id").alias("id"))
    lenders = materialize(lenders, "lenders")

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_json(shape([parse(t)])) for t in batch.column(1).to_pylist()], pa.string())], names=["host", "tree"])

    lent = rows.join(sized_broadcast(lenders.select("id", "host")), ["id", "host"], "left_semi").groupBy("host").agg(F.min("html").alias("html"))
    trees = materialize(lent.select("host", "html").mapInArrow(lend, "host string, tree string"), "trees")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Shape]] = {}
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for a, b in text_chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                for host, page, tree in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if tree is None or not page:
                        continue
                    if len(known) > 1000:
                        known.clear()
                    if tree not in known:
                        known[tree] = from_json(tree)
                    pairs: list[tuple[Shape, Shape]] = []
                    align(shape([parse(page)]), known[tree][0], pairs)
                    for own, ref in pairs:
                        s = sums.setdefault((host, ref.number), [0, 0, 0, 0])
                        s[0] += 1
                        s[1] += own.digest == ref.digest
                        s[2] += own.text
                        s[3] += own.linked
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), *(pa.array(x, pa.int64()) for x in zip(*((n, *v) for (_, n), v in sums.items())))] if sums else [pa.array([], pa.string()), *(pa.array([], pa.int64()) for _ in range(5))], names=["host", "node", "pages", "same", "chars", "linked"])

    held = rows.select("host", "html").join(sized_broadcast(trees, BROADCAST_HOSTS), "host", "left")
    counted = held.select("host", "html", "tree").mapInArrow(tally, "host string, node long, pages long, same long, chars long, linked long")
    counted = counted.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("pages", "same", "chars", "linked")])
    # at most one entry for each node of the reference tree
    gathered = counted.groupBy("host").agg(F.to_json(F.collect_list(F.array("node", "pages", "same", "chars", "linked"))).alias("stats"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, drops = [], []
            for tree, stats in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                told = {s[0]: tuple(s[1:]) for s in json.loads(stats)}
                root, dropped = decide(from_json(tree), told, max((s[0] for s in told.values()), default=0))
                roots.append(root)
                drops.append(dropped)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.int64()), pa.array(drops, pa.list_(pa.int64()))], names=["host", "tree", "root", "dropped"])

    wrappers = materialize(trees.join(gathered, "host").select("host", "tree", "stats").mapInArrow(judge, "host string, tree string, root long, dropped array<long>"), "wrappers")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Shape]] = {}
        for batch in batches:
            for a, b in text_chunks(batch.column(2)):
                part = batch.slice(a, b - a)
                out = []
                for page, tree, root, dropped in zip(*(part.column(i).to_pylist() for i in range(2, 6))):
                    if len(known) > 1000:
                        known.clear()
                    if tree is not None and tree not in known:
                        known[tree] = from_json(tree)
                    out.append(content(page, known[tree] if tree is not None else None, root or 0, set(dropped or ())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["id", "url", "text", "n_chars"])

    ready = rows.join(sized_broadcast(wrappers, BROADCAST_HOSTS), "host", "left").select("id", "url", "html", "tree", "root", "dropped")
    return ready.mapInArrow(take, f"id {id_type}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
