"""Main text of web pages by wrapper induction over the pages of a host.

Every page is parsed into a tree; runs of like siblings (list entries, paragraphs) are one iterator node. The tree is aligned with
that of the host's exemplar page by simple tree matching. Hosts with few pages share a wrapper with those whose exemplar has the same outermost
elements. Over all pages of a wrapper it is added up how often a node holds the same text, how long its texts are and how much of them are links:
constant nodes and lists of links are template, others are slots. The slot with the text is found from the root down: an element whose
texts are most of all that varies, until a heading stands beside the next one. On a page the main text is what is in its element of that slot
(of an ``article`` or ``main`` that is most of it, only that). Pages that do not fit, or whose wrapper has seen too few, give what their articles hold if that
is most of their text, else what is marked as main if that is, else the smallest element with most of it. Template nodes, and what
its tag, role or class marks as menu, header, footer, sidebar, notice, advert, form or comment, are left out.

Pages with equal main texts count once as evidence, so that copies of an article do not make it a template. Counts are added up before
they are shuffled; a wrapper is as long as its exemplar. The wrappers are broadcast up to a counted number, else joined by shuffle.

Defined results: a null or empty page has an empty text; a null URL, or one without a host, belongs to the host without a name; unclosed
and truncated markup is closed at the end; however deep a page is, its text is kept; a tag that never ends is dropped; repeated rows are extracted each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as html_module
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import written
from millrace.llm.url_filter import host_path


@dataclass(frozen=True)
class Wrapper:
    """A node is template if ``constant`` of at least ``pages`` different pages hold the same text in it, or ``links`` of its characters are links.

    The text's slot holds at least a ``majority`` of what varies; a page with less than ``fits`` of its text in it does not fit.
    """

    constant: float = 0.9
    links: float = 0.6
    pages: int = 5
    majority: float = 0.6
    fits: float = 0.2
    broadcast_rows: int = 50_000
    broadcast_characters: int = 50_000_000
    rows_per_batch: int = 1000


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
# Tags of the HTML standard by their use.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in "script style textarea title noscript template iframe xmp noembed noframes svg math select object".split()}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CELL = frozenset("td th".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_LEFT_OUT = frozenset("nav footer aside form script style noscript head button dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
_HEAD_MARKS = frozenset("header topbar".split())


#: Elements below this depth become breaks in the text of the one above them, so that no page is too deep to walk.
DEPTH = 256


class Node:
    __slots__ = ("tag", "label", "out", "items", "links")

    def __init__(self, tag: str, label: str, out: bool) -> None:
        self.tag, self.label, self.out, self.items, self.links = tag, label, out, [], 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t\r") else {}


def _left_out(tag: str, at: dict[str, str], inside: bool) -> bool:
    if tag in _LEFT_OUT or (tag == "header" and not inside):
        return True
    if not at or tag in ("html", "body", "main"):
        return False
    words = set(_WORD.findall(f"{at.get('class', '')} {at.get('id', '')}".lower()))
    if words & _MARKS or (not inside and words & _HEAD_MARKS) or at.get("role", "").lower() in _ROLES:
        return True
    return "hidden" in at or at.get("aria-hidden", "").lower() == "true" or "display:none" in at.get("style", "").replace(" ", "").lower()


def parse(page: str) -> Node:
    """The page's tree; formatting without attributes leaves no node."""
    root = Node("", "", False)
    stack, pos, end = [root], 0, len(page)
    inside, anchor = 0, False
    while pos < end:
        m = _TOKEN.search(page, pos)
        text = page[pos : m.start() if m else end]
        if text and not any(n.out for n in stack[DEPTH:]):
            stack[:DEPTH][-1].items.append(text)
            stack[:DEPTH][-1].links += len(text.strip()) if anchor else 0
        if not m:
            break
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[5] and not page.endswith(">", 0, pos):
            break  # the page ends inside a tag
        if tag == "a" or tag not in _INLINE:
            anchor = tag == "a" and not (m[1] or m[4])
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    inside -= sum(n.tag in ("article", "main") for n in stack[i:])
                    if len(stack) > DEPTH:
                        stack[DEPTH - 1].items.append(Node("hr", "hr", False))
                    del stack[i:]
                    break
            continue
        if tag in _RAW:
            close = _RAW[tag].search(page, pos)
            pos = close.end() if close else end
            continue
        if tag == "br" or tag in _VOID:
            stack[:DEPTH][-1].items.append(" " if tag != "hr" else Node("hr", "hr", False))
            continue
        at = _attributes(m[3] or m[6] or "")
        out = _left_out(tag, at, inside > 0)
        if tag in _INLINE:
            if not out:
                continue
        elif tag in _CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ("p",))
            stop = ("ul", "ol") if tag == "li" else ("table",) if tag in ("tr", "td", "th") else ("dl",) if tag in ("dt", "dd") else ()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in same:
                    del stack[i:]
                    break
                if stack[i].tag in stop or (not stop and stack[i].tag not in _INLINE):
                    break
        node = Node(tag, f"{tag}.{at.get('class', '')}" if at.get("class") else tag, out)
        stack[:DEPTH][-1].items.append(node if len(stack) < DEPTH else Node("hr", "hr", False))
        if not m[0].endswith("/>") or tag not in ("path", "circle"):
            stack.append(node)
            inside += tag in ("article", "main")
    return root


def _flush(parts: list[str], out: list[str]) -> None:
    if parts:
        text = " ".join(html_module.unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()


def _collect(node: Node, parts: list[str], out: list[str], dropped: set[int]) -> None:
    for x in node.items:
        if isinstance(x, str):
            parts.append(x)
        elif x.out or id(x) in dropped:
            parts.append(" ")
        elif x.tag in _INLINE:
            _collect(x, parts, out, dropped)
        elif x.tag in _CELL:
            parts.append(" ")
            _collect(x, parts, out, dropped)
            parts.append(" ")
        else:
            _flush(parts, out)
            _collect(x, parts, out, dropped)
            _flush(parts, out)


def blocks(node: Node, dropped: set[int] = frozenset()) -> list[str]:
    """Texts of the node's blocks in page order, without what is left out."""
    out, parts = [], []
    _collect(node, parts, out, dropped)
    _flush(parts, out)
    return out


def _shape(node: Node) -> tuple:
    """What makes neighbours alike: the label, and for an element that says nothing of its use the labels of its children."""
    return (node.label, *dict.fromkeys(x.label for x in node.items if not isinstance(x, str))) if node.label in ("div", "section") else (node.label,)


#: An element with more runs of like children than this tells them by label alone, which keeps the alignment small.
RUNS = 100


def skeleton(node: Node) -> list:
    """``[label, children, nodes]``: like neighbours are one iterator, whose children are those of its first node."""
    for shape in (_shape, lambda x: (x.label,)):
        runs: list[list] = []
        for x in node.items:
            if not isinstance(x, str):
                like = shape(x)
                if runs and runs[-1][0] == like:
                    runs[-1][1].append(x)
                else:
                    runs.append([like, [x]])
        if len(runs) <= RUNS:
            break
    return [node.label, [[like[0], skeleton(nodes[0])[1], nodes] for like, nodes in runs], [node]]


def layout(tree: list, depth: int = 3) -> str:
    """The outermost elements of a skeleton."""
    return f"{tree[0]}({' '.join(layout(c, depth - 1) for c in tree[1])})" if depth else ""


def plain(tree: list) -> list:
    """The skeleton without the page's nodes, for storage."""
    return [tree[0], [plain(c) for c in tree[1]]]


def matched(a: list, b: list) -> tuple[int, list]:
    """Simple tree matching: the largest number of node pairs that keep parents and order, and the pairs of children."""
    if a[0] != b[0]:
        return 0, []
    x, y = a[1], b[1]
    best = [[(0, None)] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            up, left = best[i - 1][j][0], best[i][j - 1][0]
            n, inner = matched(x[i - 1], y[j - 1])
            both = best[i - 1][j - 1][0] + n
            best[i][j] = (both, (i - 1, j - 1, inner)) if n and both > max(up, left) else (max(up, left), (i - 1, j) if up >= left else (i, j - 1))
    pairs, i, j = [], len(x), len(y)
    while i and j:
        step = best[i][j][1]
        if len(step) == 3:
            pairs.append((x[step[0]], y[step[1]], step[2]))
        i, j = step[0], step[1]
    return 1 + best[-1][-1][0], pairs[::-1]


def _ids(tree: list, out: dict[int, int] | None = None) -> dict[int, int]:
    out = {} if out is None else out
    out[id(tree)] = len(out)
    for c in tree[1]:
        _ids(c, out)
    return out


def aligned(page: list, exemplar: list) -> list[tuple[int, list]]:
    """``(number of the exemplar's node, the page's node)`` for every matched pair."""
    number = _ids(exemplar)
    out, todo = [], list(matched(page, exemplar)[1])
    while todo:
        a, b, inner = todo.pop()
        out.append((number[id(b)], a))
        todo += inner
    return out


def _marked(node: Node, tags: tuple[str, ...], dropped: set[int]) -> list[Node]:
    """Outermost elements of these tags that are neither left out nor template."""
    out = []
    for x in node.items:
        if not isinstance(x, str) and not x.out and id(x) not in dropped:
            out += [x] if x.tag in tags else _marked(x, tags, dropped)
    return out


def _size(node: Node, dropped: set[int]) -> int:
    return sum(map(len, blocks(node, dropped)))


def _densest(root: Node, dropped: set[int], majority: float) -> Node:
    """The smallest element with most of the text that varies."""
    size = lambda n: _size(n, dropped)
    whole = size(root)
    while True:
        inner = [x for x in root.items if not isinstance(x, str) and not x.out and id(x) not in dropped and x.tag not in ("p", "table", "ul", "ol", "dl", "blockquote", "pre") and size(x) >= majority * whole]
        if not whole or not inner:
            return root
        root = inner[0]


def _links(node: Node) -> int:
    return node.links + sum(_links(x) for x in node.items if not isinstance(x, str) and not x.out)


def _headed(tree: list, number: dict[int, int], open_: set[int], depth: int = 8) -> bool:
    """Whether a skeleton has a first or second heading that is no template."""
    return number[id(tree)] in open_ and (tree[0].split(".")[0] in ("h1", "h2") or (depth > 0 and any(_headed(c, number, open_, depth - 1) for c in tree[1])))


_FLAT = frozenset("p table ul ol dl blockquote pre".split())


def slots(exemplar: list, nodes: list, how: Wrapper) -> tuple[set[int], int | None]:
    """Numbers of the template nodes, and of the slot with the text, from ``(node, n, most, chars, links)`` of every node."""
    seen = {k: (n, most, chars, links) for k, n, most, chars, links in nodes}
    if not seen or max(x[0] for x in seen.values()) < how.pages:
        return set(), None
    number = _ids(exemplar)
    length = lambda t: seen[number[id(t)]][2] if number[id(t)] in seen else 0
    whole = sum(map(length, exemplar[1]))
    template = {k for k, (n, most, chars, links) in seen.items() if n >= how.pages and (most >= how.constant * n or (links >= how.links * chars and chars <= (1 - how.majority) * whole))}

    def varying(tree: list) -> int:
        below = lambda t: sum(length(c) if number[id(c)] in template else below(c) for c in t[1])
        return 0 if number[id(tree)] in template else length(tree) - below(tree)

    whole, at, open_ = sum(map(varying, exemplar[1])), exemplar, seen.keys() - template
    while whole and at[0].split(".")[0] != "article":
        inner = next((i for i, c in enumerate(at[1]) if c[0].split(".")[0] not in _FLAT and varying(c) >= how.majority * whole), None)
        if inner is None or any(c[0].split(".")[0] in ("h1", "h2", "h3") and number[id(c)] in open_ for c in at[1]) or any(_headed(c, number, open_) for c in at[1][:inner]):
            break
        at = at[1][inner]
    return template, None if at is exemplar else number[id(at)]


def main_text(root: Node, exemplar: list | None, template: set[int], slot: int | None, how: Wrapper) -> str:
    dropped: set[int] = set()
    start = [root]
    if exemplar and (template or slot is not None):
        for number, tree in aligned(skeleton(root), exemplar):
            if number in template:
                dropped |= {id(n) for n in tree[2]}
            if number == slot:
                start = tree[2]
    whole = _size(root, dropped)
    size = sum(_size(n, dropped) for n in start)
    if not size or size < how.fits * whole:
        start, size = [root], whole
    # A mark is only a hint: what it names must hold most of the text that varies.
    for tag in ("article", "main"):
        chosen = [x for n in start for x in ([n] if n.tag == tag else _marked(n, (tag,), dropped))]
        if chosen and sum(_size(n, dropped) for n in chosen) >= how.majority * size:
            break
    else:
        chosen = start if start[0] is not root else [_densest(root, dropped, how.majority)]
    return "\n\n".join(t for n in chosen for t in blocks(n, dropped))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def extracted(pages: DataFrame, how: Wrapper = Wrapper()) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_path(F.col("url"))[0].alias("host"))

    def bounded(df: DataFrame) -> DataFrame:
        size = F.length("exemplar") if "exemplar" in df.columns else F.lit(0)  # an outline is as long as its page may be
        rows_, characters = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        return F.broadcast(df) if rows_ <= how.broadcast_rows and characters <= how.broadcast_characters else df

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            trees = [plain(skeleton(parse(x))) for x in b["html"]]
            yield pd.DataFrame({"host": b["host"], "n": b["n"], "layout": [f"{_digest(layout(t))}" for t in trees], "exemplar": [json.dumps(t) for t in trees]})

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            known: dict[str, list] = {}
            for wrapper, page, stored in zip(b["wrapper"], b["html"], b["exemplar"], strict=True):
                if stored not in known:
                    known[stored] = json.loads(stored)
                root = parse(page)
                whole = _digest(main_text(root, None, set(), None, how))
                for number, tree in aligned(skeleton(root), known[stored]):
                    text = "" if any(n.out for n in tree[2]) else "\n\n".join(t for n in tree[2] for t in blocks(n))
                    if text:
                        out.append((wrapper, number, _digest(text), whole, len(text), sum(map(_links, tree[2]))))
            yield pd.DataFrame(out, columns=["wrapper", "node", "t", "w", "chars", "links"])

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[str, tuple] = {}
            out = []
            for wrapper, page, stored, nodes in zip(b["wrapper"], b["html"], b["exemplar"], b["nodes"], strict=True):
                if stored and wrapper not in known:
                    tree = json.loads(stored)
                    known[wrapper] = (tree, *slots(tree, [tuple(x.values()) for x in nodes] if nodes is not None else [], how))
                out.append(main_text(parse(page), *(known[wrapper] if stored else (None, set(), None)), how))
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": out, "n_chars": [len(t) for t in out]})

    first = bounded(written(rows.groupBy("host").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")), "hosts"))
    same = (F.col("r.host") == F.col("f.host")) & F.col("r.page_id").eqNullSafe(F.col("f.first.page_id")) & F.col("r.url").eqNullSafe(F.col("f.first.url"))
    outlines = rows.alias("r").join(first.alias("f"), same).select("r.host", "f.n", "html").mapInPandas(outline, "host string, n long, layout string, exemplar string")
    outlines = outlines.groupBy("host").agg(F.min(F.struct("exemplar", "layout", "n")).alias("o")).select("host", "o.*")
    wrapper = F.when(F.col("n") < how.pages, F.concat(F.lit("layout "), F.col("layout"))).otherwise(F.concat(F.lit("host "), F.col("host")))
    outlines = written(outlines.select("host", wrapper.alias("wrapper"), "exemplar"), "outlines", rows=how.rows_per_batch)
    exemplars = outlines.groupBy("wrapper").agg(F.min("exemplar").alias("exemplar"))
    hosts = written(outlines.select("host", "wrapper").join(exemplars, "wrapper"), "shared", rows=how.rows_per_batch)
    seen = rows.select("host", "html").join(bounded(hosts), "host").select("wrapper", "html", "exemplar").mapInPandas(evidence, "wrapper string, node int, t long, w long, chars long, links long")
    sums = [F.sum("chars").alias("chars"), F.sum("links").alias("links")]
    seen = seen.groupBy("wrapper", "node", "t", "w").agg(F.max("chars").alias("chars"), F.max("links").alias("links"))
    counts = seen.groupBy("wrapper", "node", "t").agg(F.count(F.lit(1)).alias("n"), *sums).groupBy("wrapper", "node").agg(F.sum("n").alias("n"), F.max("n").alias("most"), *sums)
    nodes = counts.groupBy("wrapper").agg(F.collect_list(F.struct("node", "n", "most", "chars", "links")).alias("nodes"))  # as many as the exemplar has
    wrappers = written(hosts.join(nodes, "wrapper", "left"), "wrappers", rows=how.rows_per_batch)
    texts = rows.join(bounded(wrappers), "host", "left").select("page_id", "url", "html", "wrapper", "exemplar", "nodes").mapInPandas(extract, "page_id long, url string, text string, n_chars long")
    return written(texts, "extracted", rows=how.rows_per_batch)  # bounds the pages that one batch brings
