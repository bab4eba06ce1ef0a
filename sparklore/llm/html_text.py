"""Operator 3: main text of HTML pages by consensus host paths.

A page votes for the generalised tag-class path of the innermost container that holds all of its text outside
links, menus, forms, adverts and the like. Votes are counted per host in Spark; with the winning path the host's
pages are extracted again. Menus, scripts and the like are known by their tag. Whether a class, id or form says what
an element is or just describes the layout around the article (``container sidebar-right``, a form around the page)
is decided when all of a page is known: an element around the host's winning container is kept, one beside it is not,
and where the page has no such container, one that holds nearly all of the text is. Clean text beyond the winning
container is kept too.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: The end of a tag, or an attribute's value up to its opening quote or (unquoted) whole; quotes elsewhere are no quotes.
_VALUE = re.compile(r">|=\s*+(?:([\"'])|([^\s>\"'][^\s>]*))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")

# What elements are, by HTML's own definitions.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img picture source".split())
CONTAINERS = frozenset("article body center div main section td".split())
#: Elements that an open paragraph, item or cell ends at.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that are never part of an article.
DROPPED = frozenset("head script style noscript template iframe object svg canvas audio video map nav footer aside button select textarea dialog menu title input".split())
CONTROLS = frozenset("button input select textarea".split())
#: Words for what is not part of an article, in classes, ids and roles.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar sidenav aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies respond disqus discussion share sharing social "
    "related recommended recommendations newsletter subscribe subscription login signup search searchbox pagination pager toolbar skip hidden contentinfo complementary".split()
)
#: Words that may stand beside those: what the thing is made of, and where. With any other word a name may well mean something else.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons center close col column container content count desktop element entry field fixed float footer form global group head header holder icon icons id image img "
    "inline inner is item items js label large layout left link links list main message mobile module outer page panel placeholder post posts primary region results right row section secondary site slot small space sticky "
    "submit tab table text the thread title top unit user view widget wide wrap wrapper zone".split()
)
#: Of the first, those that also describe the layout around an article, and those that mean little beside a word for content.
LAYOUT = frozenset("sidebar sidenav aside widget widgets menu menus nav navbar navigation banner masthead toolbar overlay modal popup hidden social share sharing skip search complementary".split())
SOFT, CONTENT = frozenset("social share sharing skip search hidden".split()), frozenset("article content entry main page post posts results section text".split())
_MEANT = BOILERPLATE | NEUTRAL
_WORD = re.compile(r"[^\W_]")
#: Elements that an article does not stand in: it ends those that were left open.
MENUS = ("head", "nav", "header", "footer")
#: Of elements nested deeper than this only the tag is kept, so that work stays in proportion to the page.
DEEPEST = 512
#: Characters that a form without an article has at least for each of its controls, if it is more than one to fill in.
FOR_A_CONTROL = 30


class Node(NamedTuple):
    tag: str
    path: str
    dropped: bool
    rank: int
    case: int = 0


class Case:
    """An element that may or may not be part of the article.

    ``kind``: "thing" if its name says what it is, "layout" if that may be about the page around, "form", or "doubtful"
    if its name has other words too. ``around`` is the next such element around it, ``rank`` the container it stands in.
    """

    __slots__ = ("kind", "around", "rank", "articles", "controls")

    def __init__(self, kind: str, around: int, rank: int):
        self.kind, self.around, self.rank, self.articles, self.controls = kind, around, rank, 0, 0


def _attributes(page: str, at: int, unclosed: set[str]) -> tuple[list[tuple[str, str]], int]:
    """The classes, ids, roles and types of the tag whose attributes begin ``at``, and where the tag ends.

    A quote that is never closed leaves the tag to end at the next ">". ``unclosed`` collects the kinds of
    quotes that the page has no more of, so that each is looked for in vain but once.
    """
    found = []
    while m := _VALUE.search(page, at):
        if m.group() == ">":
            return found, m.end()
        start, end, quote = m.start(2), m.end(), m.group(1)
        if quote:
            start = m.end()
            end = -1 if quote in unclosed else page.find(quote, start)
            if end < 0:
                unclosed.add(quote)
                return found, page.find(">", start) + 1 or len(page)
        name = page[at : m.start()].replace("/", " ").split()[-1:]
        if name and name[0].lower() in ("class", "id", "role", "type"):
            found.append((name[0].lower(), page[start:end]))
        at = end + 1 if quote else end
    return found, len(page)


def _names(attributes: list[tuple[str, str]]) -> tuple[list[str], str]:
    """Classes, and the kind of ``Case`` that classes, ids and roles make of an element ("" if none)."""
    classes, kinds = [], set()
    for kind, value in attributes:
        if kind == "type":
            continue
        held = html.unescape(value).split()
        if kind == "class":
            classes += held
        for name in held:
            words = {w.lower() for w in _NAME.findall(name) if len(w) > 1}
            meant = words & BOILERPLATE
            if not meant:
                continue
            if not _MEANT.issuperset(words) or SOFT.issuperset(meant) and not CONTENT.isdisjoint(words):
                kinds.add("doubtful")
            else:
                kinds.add("layout" if LAYOUT.issuperset(meant) else "thing")
    return classes, next((k for k in ("thing", "layout", "doubtful") if k in kinds), "")


def blocks(page: str, wanted: str | None = None) -> tuple[list[tuple[int, str, int]], list[Node]]:
    """(rank of the innermost container, text, characters of links) of each text block, and the containers.

    A block without a letter or digit outside links is all links. Containers are ranked in page order; a block
    counts for its container and all around it. Inline elements are looked through, so that they may be left
    open; ends without a beginning are ignored. What is kept of elements with telling names, and of forms, is
    decided by ``_kept``, with the host's winning path if it is ``wanted``.
    """
    out: list[tuple[int, str, int]] = []
    of: list[int] = []  # of each block, the innermost case around it
    cases = [Case("", 0, 0)]
    root = Node("", "", False, 0)
    nodes, stack, held, links, worded, in_link, at, n = [root], [root], [], 0, False, 0, 0, len(page)

    unclosed: set[str] = set()
    deep: list[tuple[str, bool, int]] = []  # (tag, dropped, case) of the open elements beyond DEEPEST,
    opened: Counter[str] = Counter()  # and how many there are of each tag

    def flush():
        nonlocal held, links, worded
        if held:
            if text := " ".join("".join(held).split()):
                inner = next(s.rank for s in reversed(stack) if s.tag in CONTAINERS or not s.tag)
                out.append((inner, text, min(links, len(text) - 1) if worded else len(text)))
                of.append(deep[-1][2] if deep else stack[-1].case)
            held, links, worded = [], 0, False

    def close(depth):
        flush()
        del stack[depth:]
        deep.clear()
        opened.clear()

    def rise(tags):
        """Close the innermost element beyond DEEPEST that is one of ``tags``, and those in it."""
        flush()
        while deep:
            tag = deep.pop()[0]
            opened[tag] -= 1
            if tag in tags:
                break

    def in_article():
        return opened["article"] > 0 or opened["main"] > 0 or any(s.tag in ("article", "main") for s in stack)

    def hidden():
        return deep[-1][1] if deep else stack[-1].dropped

    def add(text):
        nonlocal links, worded
        if text and not hidden():
            text = html.unescape(text) if "&" in text else text
            held.append(text)
            if in_link:
                links += len(text)
            elif not worded:
                worded = _WORD.search(text) is not None

    while at < n:
        lt = page.find("<", at)
        m = _TAG.match(page, lt) if lt >= 0 else None
        while lt >= 0 and m is None:  # a mere "<"
            lt = page.find("<", lt + 1)
            m = _TAG.match(page, lt) if lt >= 0 else None
        if m is None:
            add(page[at:])
            break
        add(page[at:lt])
        at = m.end()
        if m.group(2) is None:
            continue
        attributes, at = _attributes(page, at, unclosed)
        tag, ends = m.group(2).lower(), m.group(1) == "/"
        if tag in CONTROLS and not ends and ("type", "hidden") not in attributes:
            cases[deep[-1][2] if deep else stack[-1].case].controls += 1
        if tag == "br":
            add(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            continue
        elif ends and opened[tag] > 0:
            rise((tag,))
        elif ends:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag), 0)
            if depth:
                close(depth)
            else:
                flush()
        elif tag in RAW:
            if tag in ("textarea", "iframe"):
                flush()
            close_at = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", close_at.end()) + 1 or n if close_at else n
        else:
            flush()
            if tag in VOID:
                continue
            others = CLOSED_BY.get(tag, ())
            if deep and deep[-1][0] == "p":
                rise(("p",))
            for _ in range(2 if tag == "tr" else 1):
                if deep and deep[-1][0] in others:
                    rise(others)
            if not deep:
                if stack[-1].tag == "p":
                    stack.pop()
                if stack[-1].tag in others:
                    close(len(stack) - 1)
                    if tag == "tr" and stack[-1].tag == "tr":
                        close(len(stack) - 1)
            if tag in ("article", "main", "body"):
                while any(opened[t] > 0 for t in MENUS):
                    rise(MENUS)
                if first := next((d for d in range(1, len(stack)) if stack[d].tag in MENUS), None):
                    close(first)
            classes, kind = _names(attributes)
            whole = tag in ("body", "html", "article", "main")
            dropped = hidden() or tag in DROPPED or (tag == "header" and not in_article())
            case = deep[-1][2] if deep else stack[-1].case
            if tag == "form" and kind != "thing":
                kind = "form"
            if kind and not whole and not dropped:
                cases.append(Case(kind, case, next(s.rank for s in reversed(stack) if s.tag in CONTAINERS or not s.tag)))
                case = len(cases) - 1
            elif tag in ("article", "main") and not dropped:
                cases[case].articles += 1
            if len(stack) >= DEEPEST:
                deep.append((tag, dropped, case))
                opened[tag] += 1
                continue
            path = stack[-1].path
            if tag in CONTAINERS or tag in ("html", "table"):
                path += "/" + ".".join([tag, *sorted({_DIGITS.sub("#", c.lower()) for c in classes})])
            node = Node(tag, path, dropped, len(nodes), case)
            stack.append(node)
            if tag in CONTAINERS:
                nodes.append(node)
    flush()
    return (_kept(out, of, nodes, cases, wanted) if len(cases) > 1 else out), nodes


def _kept(out: list, of: list[int], nodes: list[Node], cases: list[Case], wanted: str | None) -> list:
    """``out`` without the blocks in elements that are no part of the article.

    Doubtful elements go if more than half of their text is links, things always. Layout and forms stay if a container
    at ``wanted`` that has text is in them. Beside such a container they go; elsewhere they stay if they hold four
    fifths of what may be text around them, or half of it and all articles; forms not if they are to be filled in.
    A page of which nothing would be left keeps what holds an article.
    """
    size, linked, inner = [0] * len(cases), [0] * len(cases), range(len(cases) - 1, 0, -1)  # an element comes after those around it
    for (_, text, links), c in zip(out, of):
        size[c] += len(text)
        linked[c] += links
    for c in inner:
        around = cases[c].around
        size[around] += size[c]
        linked[around] += linked[c]
        cases[around].articles += cases[c].articles
        cases[around].controls += cases[c].controls
    inside, parents = set(), _parents(nodes) if wanted else {}
    for n in nodes:
        if wanted and (n.path == wanted or parents.get(n.rank) in inside):
            inside.add(n.rank)

    def decided(things: bool) -> list:
        gone, total, chosen = [False] * len(cases), [0] * len(cases), False
        for c in range(1, len(cases)):
            kind = cases[c].kind
            gone[c] = gone[cases[c].around] or (2 * linked[c] > size[c] if kind == "doubtful" else kind == "thing" and not (things and cases[c].articles))
        for (rank, text, links), c in zip(out, of):
            if not gone[c]:
                total[c] += len(text) - links
                chosen = chosen or rank in inside and len(text) > links
        for c in inner:
            total[cases[c].around] += total[c]
        around_chosen = set()
        for n in nodes if chosen else ():
            c = n.case
            while n.path == wanted and c and c not in around_chosen:
                around_chosen.add(c)
                c = cases[c].around
        scope = [0] * len(cases)
        for c in range(1, len(cases)):
            case, outer = cases[c], scope[cases[c].around]
            scope[c] = outer if case.kind == "doubtful" else c
            gone[c] = gone[c] or gone[case.around]
            if gone[c] or case.kind == "doubtful" or c in around_chosen:
                continue
            most = 5 * total[c] >= 4 * total[outer] or (2 * total[c] > total[outer] and 0 < case.articles == cases[outer].articles)
            if chosen and case.rank not in inside or not total[c] or not most or case.kind == "form" and not case.articles and total[c] < FOR_A_CONTROL * case.controls:
                gone[c] = True
        return [block for block, c in zip(out, of) if not gone[c]]

    return decided(False) or (decided(True) if any(c.kind == "thing" and c.articles for c in cases) else [])


def _around(nodes: list[Node], held: list[tuple[int, str, int]], spans: dict[int, int]) -> dict[int, int]:
    """Characters outside links of each container, those within it included."""
    total: dict[int, int] = {}
    for rank, text, linked in held:
        free = len(text) - linked
        while True:
            total[rank] = total.get(rank, 0) + free
            if rank == 0:
                break
            rank = spans[rank]
    return total


def _parents(nodes: list[Node]) -> dict[int, int]:
    """Each container's own container, by their paths and page order."""
    parents, last = {}, {}
    for node in nodes:
        if node.rank:
            path = node.path
            while path:
                path = path.rpartition("/")[0]
                if path in last:
                    break
            parents[node.rank] = last.get(path, 0)
        last[node.path] = node.rank
    return parents


def _best(held: list[tuple[int, str, int]], nodes: list[Node]) -> tuple[Node | None, int]:
    """The innermost container around every block that is not links alone, and the characters outside links."""
    total = _around(nodes, held, _parents(nodes))
    whole = total.get(0, 0)
    best = max((n for n in nodes if total.get(n.rank, 0) == whole), key=lambda n: n.path.count("/")) if whole else None
    return best, whole


def best_path(page: str) -> tuple[str, int]:
    """The generalised path of the page's best container, and the characters outside links it holds; "" if none.

    It is the innermost one around every block that is no boilerplate, so only what is marked as such, and
    blocks of links alone, can stand outside.
    """
    best, chars = _best(*blocks(page))
    return (best.path, chars) if best else ("", 0)


def main_text(page: str | None, path: str | None) -> str:
    """Blocks in the containers at ``path``, joined by line ends; in the page's own best one where clean text stands beyond those."""
    held, nodes = blocks(page or "", path)
    best, chars = _best(held, nodes)
    if best is None:
        return ""
    parents = _parents(nodes)

    def within(wanted: str | None, first: int) -> list[tuple[int, str, int]]:
        inside = {first}
        for n in nodes:
            if n.path == wanted or parents.get(n.rank) in inside:
                inside.add(n.rank)
        return [block for block in held if block[0] in inside]

    found = within(path, -1) if path else []
    if sum(len(text) - links for _, text, links in found) < chars:
        found = within(None, best.rank)
    return "\n".join(text for _, text, _ in found)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path most pages of the host vote for; of equals, that which holds the most text.

    Null and empty pages, those without text and those of a null URL or one without a host have no vote; empty in, empty out.
    """

    def vote(batches):
        for batch in batches:
            found = [best_path(p or "") for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], names=["host", "path", "chars"])

    votes = pages.select(host_of(F.col(url_col)).alias("host"), html_col).where("host <> ''").mapInArrow(vote, "host string, path string, chars long")
    counted = votes.where("chars > 0").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))
    return counted.groupBy("host").agg(F.max(F.struct("votes", "chars", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``; ``text`` is empty where there is none.

    A null page is empty. Pages without a host are extracted by their own best container. Rows that
    repeat are extracted each, other columns are ignored; empty in, empty out.
    """
    small_batches(pages.sparkSession)
    winners = stored(host_paths(pages, url_col, html_col), "host_paths")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    fields = [T.StructField(id_col, rows.schema["id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]

    def run(batches):
        for batch in batches:
            texts = [main_text(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, "url", "text"])

    out = rows.join(winners, "host", "left").select("id", "url", "html", "path").mapInArrow(run, T.StructType(fields))
    return out.withColumn("n_chars", F.length("text").cast("long"))
