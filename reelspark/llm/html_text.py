"""Operator 2 — main text of web pages by wrapper induction.

Every distinct page of a host counts. Its blocks of text are aligned with those of the host's other pages by their place, the
labels of the elements around them. Text that stays the same on nearly all pages that have something in its place is the
host's template; what varies fills slots, and the deepest element that holds most of the varying text is where the
host keeps its content. Every page is then read with its host's wrapper: the article elements, or else
the content element, or else the body; without template text, and without what HTML itself marks
as no part of an article (menus, site headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments).

The counts are plain sums by host, place and hash of the text, combined in every task, so no task holds a host's pages, and a
wrapper is as large as what repeats on a page. Simple tree matching (:func:`align`, :func:`induce`) gives the wrapper of
a few pages at hand.

Null and empty pages give an empty text; a page without a url or host has no wrapper and is read by
its markup alone. Repeated rows give one row each and count once in their host's wrapper; extra columns are not read. A host with
fewer than ``MIN_SUPPORT`` distinct pages has no template text, one with a single page no content element.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

MAX_NODES, MIN_SUPPORT = 600, 4
#: Shares of the pages with something in a place that show a template text there, and of all pages of the host.
SAME, COMMON = 0.9, 0.1
#: Share of the varying text that an element of the content's path holds.
HEAVY = 0.8
#: Elements nested deeper become siblings, so that no walk over a tree nests deeper.
MAX_DEPTH = 250

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_NAME = re.compile(r"[a-z0-9]+")

# Fixed sets of HTML element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav
    ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
_NO_CONTENT = frozenset("""head nav footer aside form script style noscript template button select option textarea
    input iframe object embed svg canvas audio video dialog menu title xmp noembed noframes""".split())
_MARKED = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner
    cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup
    sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer share sharing social
    related recommended comment comments disqus respond replies""".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
              "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("article body div section table td th ul ol dl blockquote main aside nav form html".split())


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []


def parse(page: str) -> Node:
    """The page's tree; text is held as strings among the children, references decoded."""
    root = Node("#root")
    stack, at, end = [root], 0, len(page)
    lower = None

    def text(s: str) -> None:
        if s:
            stack[-1].kids.append(html_lib.unescape(s) if "&" in s else s)

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[1] is not None:
            stack[-1].kids.append(m[1])
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in _BLOCK and stack[k].tag in _SCOPE:
                    break
            continue
        closes = _CLOSED_BY.get(tag) or ({"p"} if tag in _BLOCK else None)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE and stack[k].tag not in closes:
                    break
        node = Node(tag, m[4])
        stack[-1].kids.append(node)
        if tag in _VOID:
            continue
        if tag in _RAW:
            if lower is None:
                lower = page.lower()
                if len(lower) != end:  # a few characters change length in lower case
                    lower = re.sub(r"[A-Z]", lambda c: c[0].lower(), page)
            close = lower.find("</" + tag, at)
            node.kids.append(page[at:close if close >= 0 else end])
            at = end if close < 0 else (page.find(">", close) + 1 or end)
            continue
        if len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(node.attrs)}


def label(node: Node) -> str:
    """What makes two nodes the same kind in an alignment."""
    name = attributes(node).get("class") if node.attrs else None
    return f"{node.tag}.{name}" if name else node.tag


def is_boilerplate(node: Node, in_article: bool) -> bool:
    """Whether HTML itself marks the element as no part of an article."""
    if node.tag in _NO_CONTENT or node.tag == "header" and not in_article:
        return True
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return False
    a = attributes(node)
    if a.get("role") in _ROLES or a.get("aria-hidden") == "true" or re.search(r"(^|\s)hidden(\s|$)", node.attrs):
        return True
    if "display:none" in a.get("style", "").replace(" ", ""):
        return True
    names = _NAME.findall(a.get("class", "") + " " + a.get("id", ""))
    return any(n in _MARKED for n in names)


def own_text(node: Node) -> str:
    """Text of a node outside its block children, white space collapsed."""
    out: list[str] = []

    def add(n: Node) -> None:
        for k in n.kids:
            if isinstance(k, str):
                out.append(k)
            elif k.tag == "br":
                out.append(" ")
            elif k.tag not in _BLOCK and k.tag not in _NO_CONTENT:
                add(k)

    add(node)
    return " ".join("".join(out).split())


def elements(node: Node) -> list[Node]:
    """Child elements that an alignment looks at; inline ones belong to their block."""
    return [k for k in node.kids if not isinstance(k, str) and (k.tag in _BLOCK or k.tag in _NO_CONTENT)]


def count_nodes(node: Node) -> int:
    return 1 + sum(count_nodes(k) for k in elements(node))


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size and pairs of a largest order-preserving match of two trees
    whose matched nodes have matched parents and equal labels."""
    if label(a) != label(b):
        return 0, []
    ka, kb = elements(a), elements(b)
    best = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
    pair: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(ka):
        for j, y in enumerate(kb):
            w = pair[i, j] = align(x, y)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[0])
    pairs = [(a, b)]
    i, j = len(ka), len(kb)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += pair[i - 1, j - 1][1]
            i, j = i - 1, j - 1
    return 1 + best[len(ka)][len(kb)], pairs


def paths(root: Node) -> dict[int, str]:
    """Path of labels from the root, by node identity."""
    out: dict[int, str] = {}

    def walk(n: Node, path: str) -> None:
        out[id(n)] = path
        for k in elements(n):
            walk(k, f"{path}/{label(k)}")

    walk(root, "")
    return out


def induce(pages: list[str]) -> dict:
    """The wrapper of a host's sample pages: ``template`` (path and text of constant nodes) and
    ``content`` (path of the element that holds most of the varying text, or None)."""
    trees = [t for t in map(parse, pages) if count_nodes(t) <= MAX_NODES]
    if len(trees) < 2:
        return {"template": [], "content": None}
    first, where = trees[0], paths(trees[0])
    same: Counter = Counter()
    varies: Counter = Counter()
    for other in trees[1:]:
        matched = {id(x): y for x, y in align(first, other)[1]}

        def walk(n: Node) -> None:
            mine = own_text(n)
            if mine:
                twin = matched.get(id(n))
                if twin is not None and own_text(twin) == mine:
                    same[id(n)] += 1
                elif not is_boilerplate(n, True):
                    varies[id(n)] += len(mine)
            for k in elements(n):
                if not is_boilerplate(k, True):
                    walk(k)

        walk(first)
    template = []
    if len(trees) >= MIN_SUPPORT:
        def constant(n: Node) -> None:
            if same[id(n)] == len(trees) - 1:
                template.append([where[id(n)], own_text(n)])
            for k in elements(n):
                constant(k)

        constant(first)

    def weight(n: Node) -> int:
        return varies[id(n)] + sum(map(weight, elements(n)))

    total, node = weight(first), first
    while total:
        heavy = [k for k in elements(node) if weight(k) >= 0.8 * total]
        if not heavy or heavy[0].tag in ("p", "h1", "h2", "li"):
            break
        node = heavy[0]
    return {"template": template, "content": where[id(node)] if total and node is not first else None}


def text_blocks(found: list[tuple[Node, str]]) -> list[tuple[list[tuple[str, str]], str]]:
    """Blocks of text below elements at their paths: the paths and tags of the elements around each, from the found one on, and its text."""
    out: list[tuple[list, str]] = []
    run: list[str] = []

    def flush(around: list) -> None:
        s = " ".join("".join(run).split())
        run.clear()
        if s:
            out.append((around, s))

    def walk(n: Node, around: list) -> None:
        for k in n.kids:
            if isinstance(k, str):
                run.append(k)
            elif k.tag == "br":
                run.append(" ")
            elif is_boilerplate(k, True):
                if k.tag in _BLOCK:
                    flush(around)
            elif k.tag in _BLOCK:
                flush(around)
                here = [*around, (f"{around[-1][0]}/{label(k)}", k.tag)]
                walk(k, here)
                flush(here)
            else:
                walk(k, around)

    for n, path in found:
        walk(n, [(path, n.tag)])
        flush([(path, n.tag)])
    return out


def text_hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def main_text(page: str | None, wrapper: dict | None) -> str:
    """Blocks of the page's article, one a line."""
    if not page:
        return ""
    root = parse(page)
    template = {(p, t) for p, t in wrapper.get("template", ())} if wrapper else set()
    hashes = {(p, h) for p, h in wrapper.get("hashes", ())} if wrapper else set()
    content = wrapper.get("content") if wrapper else None

    def roots(n: Node, path: str, wanted) -> list[tuple[Node, str]]:
        out = []
        for k in n.kids:
            if isinstance(k, str):
                continue
            here = f"{path}/{label(k)}" if k.tag in _BLOCK or k.tag in _NO_CONTENT else path
            if k.tag in _NO_CONTENT or is_boilerplate(k, False):
                continue
            out += [(k, here)] if wanted(k, here) else roots(k, here, wanted)
        return out

    found = (roots(root, "", lambda k, _: k.tag == "article")
             or roots(root, "", lambda k, _: k.tag == "main" or attributes(k).get("role") == "main")
             or content and roots(root, "", lambda _, path: path == content)
             or roots(root, "", lambda k, _: k.tag == "body") or [(root, "")])
    places = {p for p, _ in hashes}
    return "\n".join(s for around, s in text_blocks(found)
                     if (around[-1][0], s) not in template
                     and not (around[-1][0] in places and (around[-1][0], text_hash(s)) in hashes))


def page_counts(pages: DataFrame) -> DataFrame:
    """Sums over all distinct pages (``host``, ``html``): ``host``, ``path``, ``hash``, ``n``, ``chars``, ``tag``.

    A row with a hash tells how many pages have that text there, and its characters in all; one without, how many pages have any text
    right there, and the characters within the element. The empty path stands for the host: all pages, all characters. Pages
    are compared whole, as two that differ may have one hash, and every text has its row, however few pages show it.
    """
    once = pages.where((F.col("host") != "") & (F.length("html") > 0)).select("host", "html").distinct()

    def run(batches):
        for pdf in batches:
            sums: dict[tuple[str, str, str], list] = {}
            for host, page in zip(pdf["host"], pdf["html"]):
                own: dict[tuple[str, str], list] = {("", ""): [1, 0, ""]}
                for around, s in text_blocks([(parse(page), "")]):
                    path, tag = around[-1]
                    own.setdefault((path, text_hash(s)), [1, 0, tag])[1] += len(s)
                    for p, t in around:
                        own.setdefault((p, ""), [0, 0, t])[1] += len(s)
                    own[path, ""][0] = 1
                for (path, key), (n, chars, tag) in own.items():
                    total = sums.setdefault((host, path, key), [0, 0, tag])
                    total[0] += n
                    total[1] += chars
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "path", "hash", "n", "chars", "tag"])

    rows = once.mapInPandas(run, "host string, path string, hash string, n long, chars long, tag string")
    return rows.groupBy("host", "path", "hash").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.max("tag").alias("tag"))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host``, ``wrapper`` (JSON) from all ``pages`` (``host``, ``html``): ``hashes`` (path and hash of template text)
    and ``content`` (path of the element that holds most of the varying text, or None)."""
    # template text needs MIN_SUPPORT pages that show it; the others' rows would be most of the table
    counts = shared_table(page_counts(pages).where((F.col("hash") == "") | (F.col("n") >= MIN_SUPPORT)), "page-counts")
    places = counts.where(F.col("hash") == "")
    hosts = places.where(F.col("path") == "").select("host", F.col("n").alias("pages"), F.col("chars").alias("total"))
    template = (counts.where(F.col("hash") != "").join(places.select("host", "path", F.col("n").alias("at")), ["host", "path"])
                .join(hosts, "host").where((F.col("n") >= SAME * F.col("at")) & (F.col("n") >= COMMON * F.col("pages")))
                .groupBy("host").agg(F.sum("chars").alias("fixed"), F.collect_list(F.struct("path", "hash", "chars")).alias("template")))
    hosts = hosts.join(template, "host", "left")
    varying = F.col("total") - F.coalesce("fixed", F.lit(0))
    # whoever holds most of what varies holds as much at least with the template
    heavy = (places.where(F.col("path") != "").join(hosts.where((varying > 0) & (F.col("pages") > 1)).select("host", varying.alias("varying")), "host")
             .where(F.col("chars") >= HEAVY * F.col("varying"))
             .groupBy("host").agg(F.first("varying").alias("varying"), F.collect_list(F.struct("path", "tag", "chars")).alias("heavy")))

    def run(batches):
        for pdf in batches:
            out = []
            for template, varying, heavy in zip(pdf["template"], pdf["varying"], pdf["heavy"]):
                template = [] if template is None else list(template)
                content = None
                for e in sorted([] if heavy is None else heavy, key=lambda e: (len(e["path"]), e["path"])):
                    held = e["chars"] - sum(t["chars"] for t in template if (t["path"] + "/").startswith(e["path"] + "/"))
                    if held < HEAVY * varying:
                        continue
                    if e["tag"] in ("p", "h1", "h2", "li"):
                        break
                    content = e["path"]
                out.append(json.dumps({"hashes": sorted([t["path"], t["hash"]] for t in template), "content": content}))
            yield pd.DataFrame({"host": pdf["host"], "wrapper": out})

    return hosts.join(heavy, "host", "left").select("host", "template", "varying", "heavy").mapInPandas(run, "host string, wrapper string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col``, ``url``, ``text`` (empty if none), ``n_chars``."""
    host = F.coalesce(F.lower(F.expr(
        f"regexp_extract(`{url_col}`, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)")), F.lit(""))
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html"), host.alias("host"))
    # Written, so that Spark knows its size: small enough it is broadcast, else both sides are
    # shuffled and a host that holds a third of the pages is split by adaptive execution.
    joined = src.join(shared_table(wrappers(src), "wrappers"), "host", "left")

    def run(batches):
        last = (None, None)
        for pdf in batches:
            texts = []
            for page, w in zip(pdf["html"], pdf["wrapper"]):
                if w != last[0]:
                    last = (w, json.loads(w) if w else None)
                texts.append(main_text(page, last[1]))
            yield pd.DataFrame({id_col: pdf["page_id"], "url": pdf["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    kind = src.schema["page_id"].dataType.simpleString()
    return (joined.select("page_id", "url", "html", "wrapper")
            .mapInPandas(run, f"`{id_col}` {kind}, url string, text string, n_chars long"))
