"""Main text of web pages: site templates are found by counting hashed element subtrees per host, and deleted.

Each block element's subtree is hashed: its tag, its text and its children's hashes. Spark counts on how many different
pages of a host each hash stands; copies of a page count once, so that a page's own text is no template because the page
was fetched often. Subtrees on many pages of the host are deleted; plain prose inside an article, which may repeat by
chance, only if it is on most of them. Elements that say what they are (menus, headers, footers, forms, adverts, comments and
so on) go as well, with the articles in them. One article is the story: the one with most text of its own among those that are
no comment, advert or the like and lie in none. What is left of it, or of the main element or the page where there is no such
article, is the text; other articles, beside it or in it, are teasers or comments. An element that holds more than half of
the page's text is no sidebar or form, whatever its name, but comments are comments.

A null or empty html gives an empty text. Equal rows get equal texts. A page without a host is of the host ''. Broken
markup is read as far as it goes: open elements end with their parents, a tag that is cut off is dropped. br is white
space. Other columns of the input are ignored, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm.common import table, written

#: Names of HTML, by what they are.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table "
    "tbody td template tfoot th thead title tr ul".split()
)
NEVER = set("head script style noscript template title xmp iframe noembed noframes textarea svg math canvas object audio video map datalist select option button dialog".split())
FURNITURE = set("nav header footer aside form menu search fieldset".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption".split())
ENDS_P = BLOCK - set("button caption dd dt head html body legend li option tbody td tfoot th thead title tr template noscript".split())
#: A start tag ends an open element of these, unless one of the stops is open above it.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
#: Words of class names and ids that tell page furniture.
HINTS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar header footer sidebar aside ad ads adv advert adverts advertisement "
    "advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription share sharing social comment comments disqus reply replies respond related recommended widget "
    "login signup signin search pagination pager skip toolbar copyright".split()
)
#: Those of readers' comments.
COMMENTS = set("comment comments disqus reply replies respond".split())
#: A name that begins or ends with one of these says how an element is, not what it is: has-sidebar, comments-open.
STATES = set("has no with without is open opened closed enabled disabled allowed".split())
#: Furniture even if it holds most of the page's text.
ALWAYS = set("nav footer aside".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/]|\Z)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(frozen=True)
class Templates:
    """A subtree is a template if it is on pages or more different pages of the host, and on share or more of them or on enough
    pages, however many the host has. Prose inside an article is one if it is on pages or more and on most of them.

    broadcast: template hashes up to which all tasks get them; with more of them they are joined to the pages.
    """

    pages: int = 8
    share: float = 0.1
    enough: int = 50
    most: float = 0.5
    broadcast: int = 200_000


#: What an element's attributes say of it.
NOTHING, NAMED, NEVER_TEXT = 0, 1, 2


class Node:
    """hint: NOTHING, NAMED (page furniture) or NEVER_TEXT (hidden, comments). size: characters in it; own: those of its story alone."""

    __slots__ = ("tag", "items", "hint", "hash", "holds", "size", "own", "wide")

    def __init__(self, tag: str, hint: int = NOTHING):
        self.tag, self.hint, self.items, self.hash, self.holds, self.size, self.own, self.wide = tag, hint, [], 0, False, 0, 0, False


def _hinted(attributes: str) -> int:
    hint = NOTHING
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return NEVER_TEXT
        if name == "role" and value.lower() in ROLES:
            hint = NAMED
        for token in value.split() if name in ("class", "id") else ():
            words = [w.lower() for w in _WORD.findall(token)]
            if not words or words[0] in STATES or words[-1] in STATES:
                continue
            if not COMMENTS.isdisjoint(words):
                return NEVER_TEXT
            if not HINTS.isdisjoint(words):
                hint = NAMED
    return hint


def parse(html: str) -> Node:
    """The page as a tree: items are texts, with character references, and nodes."""
    root = Node("#root")
    stack, at, n = [root], 0, len(html)

    def close(names: set[str], stops: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in stops:
                return

    while at < n:
        m = _TAG.search(html, at)
        if not m:
            stack[-1].items.append(html[at:])
            break
        if m.start() > at:
            stack[-1].items.append(html[at : m.start()])
        at = m.end()
        if not m[2] or not m[4]:  # a comment or declaration; or a tag that is cut off
            continue
        tag = m[2].lower()
        if m[1]:
            close({tag}, set() if tag in ("article", "main", "body", "html", "table") else {"article", "main", "body", "td", "th"} - {tag} if tag not in BLOCK else {"body"} - {tag})
            continue
        if tag in ENDS_P:
            close({"p"}, BLOCK - {"p"})
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        node = Node(tag, _hinted(m[3]) if m[3] else NOTHING)
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            node.items.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK and tag in ("path", "use", "circle", "rect", "line", "polygon")):
            stack.append(node)
    return root


def _furniture(node: Node, in_article: bool) -> bool:
    """Whether the element goes for what it says it is. Below the story, or where there is none, an article is a comment or a teaser."""
    if node.tag in NEVER or node.tag == "article":
        return True
    if node.tag in ("html", "body", "main", "#root") or not _named(node):
        return False
    return not (in_article and node.tag in ("header", "div", "hgroup", "section") and _is_heading(node))


def _named(node: Node) -> bool:
    """Whether tag or attributes say that the element is furniture."""
    if node.hint == NEVER_TEXT or node.tag in ALWAYS:
        return True
    return (node.tag in FURNITURE or node.hint == NAMED) and not node.wide


def _is_heading(node: Node) -> bool:
    """An article's own header: it has a heading, and no more than titles and lines of an article's head beside it."""
    found, todo = False, [x for x in node.items if not isinstance(x, str)]
    while todo:
        x = todo.pop()
        if x.tag in ("nav", "form", "ul", "ol", "aside", "article"):
            return False
        found |= x.tag in ("h1", "h2")
        todo += [y for y in x.items if not isinstance(y, str)]
    return found


def prepare(root: Node) -> None:
    """Fills in hash, sizes and holds (an article or main element is inside), children first."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [y for y in x.items if not isinstance(y, str)]
    for x in reversed(order):
        parts = [x.tag]
        for y in x.items:
            if isinstance(y, str):
                words = y.split()
                parts.append(" ".join(words))
                n = sum(map(len, words))
                x.size, x.own = x.size + n, x.own + n
            else:
                parts.append(format(y.hash, "x"))
                x.holds |= y.holds or y.tag in ("article", "main")
                if y.tag not in NEVER:
                    x.size += y.size
                    if y.tag not in FURNITURE and y.tag != "article" and not y.hint:
                        x.own += y.own
        x.hash = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    for x in order:
        x.wide = 2 * x.size > root.size


def _start(root: Node) -> Node:
    """Where the text is: the article that is the story, else the main element with most text, else the whole page."""
    stories, mains, todo = [], [], [root]
    while todo:
        x = todo.pop()
        if x.tag in ("article", "main"):
            (stories if x.tag == "article" else mains).append(x)
        # What lies in furniture is no story. A plain name on an article itself doesn't tell; its text will.
        todo += [y for y in reversed(x.items) if not isinstance(y, str) and y.tag not in NEVER and (y.tag in ("html", "body", "main") or not _named(y) or (y.tag == "article" and y.hint == NAMED))]
    for found in (stories, mains):
        found = [x for x in found if x.own]
        if found:
            return max(found, key=lambda x: x.own)  # the first of several
    return root


#: Prose inside an article is counted apart from the same block elsewhere.
INSIDE = 1 << 63


def _key(x: Node, inside: bool) -> int:
    return (x.hash | INSIDE) if inside and x.tag in PROSE else x.hash & ~INSIDE


def subtrees(root: Node) -> set[int]:
    """Keys of the subtrees that may be templates: blocks that are no furniture by name, hold no article and have text."""
    start = _start(root)
    out, todo = set(), [(start, start.tag in ("article", "main"))]
    while todo:
        x, inside = todo.pop()
        for y in x.items:
            if isinstance(y, str) or _furniture(y, inside):
                continue
            if y.tag in BLOCK and not y.holds and y.tag not in ("html", "body", "article", "main"):
                out.add(_key(y, inside))
            todo.append((y, inside or y.tag in ("article", "main")))
    return out


def text_of(root: Node, templates) -> str:
    """Blocks of what is left, in page order. templates: contains hashes of subtrees to delete."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if joined := " ".join(entities.unescape("".join(line)).split()):
                blocks.append(joined)
            line.clear()

    start = _start(root)
    todo: list = [(y, start.tag in ("article", "main")) for y in reversed(start.items)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                flush()
            if _furniture(x, inside) or (block and not x.holds and x.tag not in ("html", "body", "article", "main") and _key(x, inside) in templates):
                continue
            if block:
                todo.append((None, inside))
            todo += [(y, inside or x.tag in ("article", "main")) for y in reversed(x.items)]
    flush()
    return "\n".join(blocks)


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _host(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Templates = Templates()) -> DataFrame:
    """One row per page: the id, the url, text and n_chars."""
    kind = dict(pages.dtypes)[id_col]
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    own = own.withColumn("host", _host(F.col("url"))).withColumn("copy", F.xxhash64("html", F.length("html")))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, html in enumerate(batch.column(2)):
                prepare(root := parse(html.as_py()))
                own = subtrees(root) or {0}
                rows += [k] * len(own)
                found += own
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(_signed(found))], names=["host", "copy", "subtree"])

    # Pages by host and content: what copies of a page have in common counts once.
    seen = own.select("host", "copy", "html").mapInArrow(hashes, "host string, copy long, subtree long").distinct()
    sites = own.groupBy("host", "copy").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("all"))
    often = seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).where((F.col("n") >= rules.pages) & (F.col("subtree") != 0))
    bar = F.when(F.col("subtree") < 0, rules.most * F.col("all")).otherwise(F.least(rules.share * F.col("all"), F.lit(float(rules.enough))))
    often = written(often.join(sites, "host").where(F.col("n") >= bar).select("host", "subtree"))
    first = often.limit(rules.broadcast + 1).collect()
    columns = "id {}, url string, text string, n_chars long".format(kind)

    def texts(known, keyed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for k, html in enumerate(batch.column(2)):
                    prepare(root := parse(html.as_py()))
                    mine = set(batch.column(3)[k].as_py() or ()) if keyed else known.value.get(batch.column(3)[k].as_py(), ())
                    out.append(text_of(root, {x % 2**64 for x in mine}))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["id", "url", "text", "n_chars"])

        return run

    if len(first) <= rules.broadcast:
        by_host: dict[str, list[int]] = {}
        for r in first:
            by_host.setdefault(r["host"], []).append(r["subtree"])
        known = pages.sparkSession.sparkContext.broadcast(by_host)
        out = own.select("id", "url", "html", "host").mapInArrow(texts(known, False), columns)
    else:
        lists = seen.join(often, ["host", "subtree"]).groupBy("host", "copy").agg(F.collect_set("subtree").alias("templates"))
        out = own.join(lists, ["host", "copy"], "left").select("id", "url", "html", "templates").mapInArrow(texts(None, True), columns)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
