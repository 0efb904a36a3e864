"""Main text of web pages with the templates of each site removed.

1. A page is read into a tree of elements (end tags may be missing). Every
   block element outside the text of the article gives a hash of its subtree:
   tag, class, id, text and the hashes of its children.
2. Spark counts, per host, the different articles whose pages hold a subtree. An
   article counts once, so that one published on many pages stays whole. Only
   hashes are shuffled: a list of templates of up to ``SENT_TEMPLATES`` goes to the
   tasks, which read the pages again where they lie; a longer one is joined.
3. Subtrees that recur with ``MIN_PAGES`` or more different articles of their
   host, however many it has, are deleted, and so are elements that are never
   part of an article (menus, headers, footers, forms, scripts, comments, ...).
   What is left of the article (``article``, else ``main``, else ``body``) is
   the text.

Names (class, id) tell furniture anywhere outside the article. Inside, where a
slug may hold any word, they only do for containers: by a class with such a
word, or by an id, or the class of a section, of nothing but such words.
Paragraphs and headings of the article are never counted: a site may quote
itself. Blocks are joined by one line end; inside a block white space is one
space, character references are decoded. A null page has an empty text. Rows
that repeat a page_id are pages of their own; pages without a host only lose
what the element rules name.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import key_filter, small, stored

MIN_PAGES = 10
#: Templates (of all hosts) that are sent to all tasks, as 8 bytes each.
SENT_TEMPLATES = 4_000_000

# Element names of the HTML standard by their role, and words that name page furniture.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_NEVER = frozenset(
    "head script style noscript template iframe object svg math canvas nav header footer aside form "
    "button select option input textarea dialog menu title noembed noframes audio video".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption".split())
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar side menu nav "
    "navbar navigation breadcrumb breadcrumbs header footer masthead notice notices cookie cookies consent "
    "gdpr popup modal newsletter subscribe signup login share sharing social related recommended comment "
    "comments disqus respond reply replies widget toolbar pagination pager form search".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# A start tag of the key closes an open element of the value, as far as the nearest element of the third part.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_WHOLE = frozenset("html body main article".split())
# Elements of an article that may hold something else than its text.
_CONTAINERS = frozenset("div ul ol dl table section".split())
_SCOPE = frozenset("article section div body td th li blockquote main aside nav header footer form button table".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s>]+))?""", re.I)
_NAME_PART = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "children", "drop", "inner")

    def __init__(self, tag: str, names: str = "", drop: bool = False, inner: bool = False) -> None:
        # drop: never main text, seen from outside the article; inner: nor inside of it
        self.tag, self.names, self.drop, self.inner = tag, names, drop, inner
        self.children: list[Node | str] = []


def parse(page: str) -> Node:
    """The tree of a page. Unknown or stray end tags are passed over."""
    root = Node("html")
    stack, at = [root], 0
    while at < len(page):
        match = _TOKEN.search(page, at)
        if match is None:
            stack[-1].children.append(page[at:])
            break
        if match.start() > at:
            stack[-1].children.append(page[at : match.start()])
        at = match.end()
        tag = match.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if match.group(1):
            _end(stack, tag)
            continue
        _close_implied(stack, tag)
        attributes = match.group(3)
        names, named, inner = _read_attributes(attributes, tag) if attributes else ("", False, False)
        # the class of a whole page or article often tells of its furniture
        whole, never = tag in _WHOLE, tag in _NEVER
        node = Node(tag, names, named and not whole or never, inner and not whole or never)
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in _VOID:
            stack.append(node)
    return root


def _end(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        # a stray inline end tag does not reach out of its block
        if tag not in _BLOCK and stack[k].tag in _SCOPE:
            return


def _close_implied(stack: list[Node], tag: str) -> None:
    if tag in _CLOSES:
        closed, limit = _CLOSES[tag]
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in limit:
                return
            if stack[k].tag in closed:
                del stack[k:]
                return
    elif tag in _BLOCK:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                return
            if stack[k].tag in _SCOPE:
                return


def _read_attributes(attributes: str, tag: str) -> tuple[str, bool, bool]:
    """Class and id as text; whether the element is page furniture or hidden, and whether inside an article."""
    names, drop, inner = [], False, False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            drop = inner = True
        elif key == "role":
            drop |= value.lower() in _ROLES
            inner |= value.lower() in _ROLES
        elif key in ("class", "id"):
            names.append(value)
            parts = [part for part in _NAME_PART.findall(_CAMEL.sub(" ", value).lower()) if not part.isdigit()]
            hits = [part in _FURNITURE for part in parts]
            drop |= any(hits)
            if tag in _CONTAINERS and any(hits):
                inner |= all(hits) or key == "class" and tag != "section"
    return " ".join(names), drop, inner


def _main(root: Node) -> list[Node]:
    """Outermost articles outside page furniture, else main elements, else everything.

    Where all of them lie in elements that only their names make furniture,
    such as a frame called ``with-sidebar``, these are looked into as well.
    """
    for strict in (True, False):
        for wanted in ("article", "main"):
            found: list[Node] = []
            todo = [root]
            while todo:
                node = todo.pop()
                if node.tag == wanted:
                    found.append(node)
                elif node.tag not in _NEVER and not (strict and node.drop):
                    todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
            if found:
                return found
    return [root]


def subtree_hashes(root: Node) -> dict[int, int]:
    """Hash of every element by its identity, children first."""
    out: dict[int, int] = {}
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo.extend((c, False) for c in node.children if isinstance(c, Node))
            continue
        digest = xxhash.xxh3_64(f"<{node.tag} {node.names}>".encode("utf-8", "surrogatepass"))
        for child in node.children:
            if isinstance(child, Node):
                digest.update(out[id(child)].to_bytes(8, "little", signed=True))
            else:
                words = _SPACE.sub(" ", child).strip()
                digest.update(words.encode("utf-8", "surrogatepass"))
        out[id(node)] = digest.intdigest() - 2**63  # as a signed number
    return out


def _around(root: Node, wanted: set[int]) -> set[int]:
    """The elements that have one of ``wanted`` below them."""
    parents: dict[int, int] = {}
    todo = [root] if wanted else []
    while todo:
        node = todo.pop()
        for child in node.children:
            if isinstance(child, Node):
                parents[id(child)] = id(node)
                todo.append(child)
    out: set[int] = set()
    for here in wanted:
        while (here := parents.get(here, 0)) and here not in out:
            out.add(here)
    return out


def countable(root: Node) -> list[Node]:
    """Block elements whose recurrence tells a template: all but the flow of the article, and what holds it."""
    mains = {id(n) for n in _main(root)} - {id(root)}
    above, out = _around(root, mains), []
    walk = [(root, False)]
    while walk:
        node, inside = walk.pop()
        inside = inside or id(node) in mains
        for child in node.children:
            if not isinstance(child, Node) or child.tag in _RAW or child.tag == "head":
                continue
            walk.append((child, inside))
            if child.tag not in _BLOCK or child.tag in ("html", "body"):
                continue
            if id(child) not in mains and id(child) not in above and not (inside and child.tag in _FLOW):
                out.append(child)
    return out


def main_text(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    """Text of the article of ``page`` without the subtrees whose hashes are in ``templates``."""
    if not page:
        return ""
    root = parse(page)
    hashes = subtree_hashes(root) if templates else {}
    return text_of_tree(root, {id(n) for n in countable(root) if hashes[id(n)] in templates} if templates else set())


def text_of_tree(root: Node, deleted: set[int]) -> str:
    """The text of a page that is parsed, without some of its elements."""
    blocks: list[str] = []
    parts: list[str] = []

    def close() -> None:
        # references are decoded before white space is, so a decoded no-break space counts as space
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            blocks.append(text)
        parts.clear()

    mains = _main(root)
    for top in mains:
        close()
        outside = top is root
        todo: list[Node | str | None] = [top]
        while todo:
            item = todo.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                parts.append(html_lib.unescape(item) if "&" in item else item)
            elif item is not top and (item.drop if outside else item.inner) or id(item) in deleted:
                if item.tag in _BLOCK:
                    close()
            else:
                if item.tag in ("br", "td", "th"):
                    parts.append(" ")
                block = item.tag in _BLOCK and item.tag not in ("td", "th")
                if block:
                    close()
                    todo.append(None)
                todo.extend(reversed(item.children))
        close()
    return "\n".join(blocks)


def _keyed(pages: DataFrame) -> DataFrame:
    # host without user, port and case; the key names a page by its content
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select("page_id", "url", "html").withColumns(
        {"host": F.when(host != "", host), "page": F.xxhash64("html")}
    )


def _subtrees(keyed: DataFrame) -> DataFrame:
    """(host, page, article, subtree): the countable subtrees of each page with a host."""
    keyed = keyed.where(F.col("host").isNotNull() & F.col("html").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            hosts, keys, articles, found = [], [], [], []
            for host, key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                root = parse(page)
                hashes = subtree_hashes(root)
                article = xxhash.xxh3_64_intdigest(repr([hashes[id(n)] for n in _main(root)])) - 2**63
                for subtree in {hashes[id(n)] for n in countable(root)}:
                    hosts.append(host)
                    keys.append(key)
                    articles.append(article)
                    found.append(subtree)
            numbers = [pa.array(c, pa.int64()) for c in (keys, articles, found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), *numbers], ["host", "page", "article", "subtree"]
            )

    schema = "host string, page bigint, article bigint, subtree bigint"
    return keyed.select("host", "page", "html").mapInArrow(run, schema)


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree): the subtrees that recur with ``min_pages`` different articles of their host."""
    # distinct merges copies before and after the shuffle
    different = _subtrees(_keyed(pages)).select("host", "article", "subtree").distinct()
    counts = different.groupBy("host", "subtree").agg(F.count("*").alias("n"))
    return stored(counts.where(F.col("n") >= min_pages).select("host", "subtree"), "templates")


def _sent(templates: DataFrame) -> np.ndarray:
    """One sorted number for each template, in the order of Spark's hash of host and subtree."""
    numbers = templates.select(F.xxhash64("host", "subtree").alias("key")).toArrow()["key"].to_numpy()
    return np.sort(numbers)


def _key(host: str, subtree: int) -> int:
    """Spark's hash of a text and a whole number, as a signed number."""
    first = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), 42)
    value = xxhash.xxh64_intdigest(subtree.to_bytes(8, "little", signed=True), first)
    return value - 2**64 if value >= 2**63 else value


def _with_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages with the array of their ``subtrees`` to delete, where there are too many templates to send."""
    keyed = _keyed(pages)
    found = _subtrees(keyed).select("host", "page", "subtree").distinct().join(templates, ["host", "subtree"])
    per_page = found.groupBy("host", "page").agg(F.collect_set("subtree").alias("subtrees"))  # of one page
    per_page = stored(per_page, "page-templates")
    # pages that lose no subtree are not shuffled
    mark = key_filter(per_page.select(F.xxhash64("host", "page")))
    keyed = mark(keyed, F.xxhash64("host", "page"), "maybe")
    columns = ["page_id", "url", "host", "html", "subtrees"]
    whole = keyed.where("NOT maybe").withColumn("subtrees", F.lit(None).cast("array<bigint>"))
    joined = keyed.where("maybe").join(per_page, ["host", "page"], "left").select(*columns)
    return whole.select(*columns).unionByName(joined)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars, n_templates (different subtrees deleted)."""
    templates = site_templates(pages, min_pages)
    listed = None
    if templates.count() <= SENT_TEMPLATES:
        listed = pages.sparkSession.sparkContext.broadcast(_sent(templates))
        rows = _keyed(pages).withColumn("subtrees", F.lit(None).cast("array<bigint>"))
        rows = rows.select("page_id", "url", "host", "html", "subtrees")
    else:
        rows = _with_templates(pages, templates)

    def text_of(host: str | None, page: str | None, subtrees: list[int] | None) -> tuple[str, int]:
        if not page:
            return "", 0
        if listed is None or host is None:
            found = frozenset(subtrees or ())
            return main_text(page, found), len(found)
        keys, root = listed.value, parse(page)
        if not len(keys):
            return text_of_tree(root, set()), 0
        hashes, nodes = subtree_hashes(root), countable(root)
        wanted = np.array([_key(host, hashes[id(n)]) for n in nodes], np.int64)
        places = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        deleted = [n for n, hit in zip(nodes, keys[places] == wanted, strict=True) if hit]
        return text_of_tree(root, set(map(id, deleted))), len({hashes[id(n)] for n in deleted})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)
            made = [text_of(*row) for row in rows]
            texts = [text for text, _ in made]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([n for _, n in made], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars", "n_templates"],
            )

    schema = "page_id bigint, url string, text string, n_chars bigint, n_templates bigint"
    return rows.mapInArrow(run, schema)
