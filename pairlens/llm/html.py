"""Main text of pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and texts, nested by its block tags. A wrapper is such a stream in which
an item may be optional or repeated and a text is a constant or a slot. Pages of a host are aligned
with its wrapper one after another: like items are merged, neighbours of one label become a
repeated group, an item that one side lacks becomes optional, texts that differ become a slot.
Wrappers made in different tasks are aligned with each other the same way, in two rounds, so that a
host of any size needs no task of its own; all pages take part.

A wrapper's slots are then judged once for the host: those in menus, headers, footers, sidebars,
notices, adverts, forms and comments go, unless the element frames the page (it holds most of the text of its article and
main elements, or is a form around most of its prose); names count by what they are names of, so `site-footer` and
`comment-list` do and `has-sidebar` does not; on a page that has an article or main element only what
is inside stays; on others a slot stays if its texts are prose (long, few links, not the same on
several different pages) or stand beside prose. Each page is aligned with its host's wrapper so that most blocks have a
place, and the blocks in slots that stay are its main text; a block without a place is judged by
its own path and length.

Nulls: a null or empty html has an empty text; a page without a host is aligned with the others of
that kind. Broken markup is read as far as it goes. Repeated rows and copies count like any page.
An empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import html
import pickle
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import Written

# an attribute's value is quoted, or runs to the next white space or end of the tag whatever quotes it holds
ATTRIBUTES = r"""((?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|[^>=])*+)"""
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|iframe|title)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"""
    + ATTRIBUTES
    + r""">|<[!?/][^>]*+>|[^<]++|<""",
    re.S | re.I,
)
LABELS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?(?=[\s/>]|$)""", re.I)
#: Elements inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that ends when one of these begins beside it.
ENDED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "head": frozenset(["body"]),
}
#: Elements and words of class, id and role that hold no main text.
OUTSIDE_TAGS = frozenset("head nav footer aside form button fieldset menu dialog object canvas audio video".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies discussion discussions disqus footer gdpr header hidden masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion related replies reply respond responses search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Those that inside an article may name a part of it (its header, a section on related work), and those that hide an inline element.
PART_WORDS = frozenset("alert banner byline header notice related reply respond search".split())
INLINE_WORDS = frozenset("ad ads advert adverts advertisement hidden promo promoted promotion sponsor sponsored".split())
#: First parts of names that say what an element has or lacks beside it, and last parts that only hold what is named before them.
STATE_WORDS = frozenset("has no with without not".split())
HOLDER_WORDS = frozenset("area bar block box buttons container content form group icons inner items links list panel region row section slot unit wrap wrapper".split())
#: Elements that may frame a whole page.
FRAME_TAGS = frozenset("form fieldset object dialog".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MAIN_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPLIT_WORDS = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
MOST_ITEMS = 48  # of one level: more become a repeated group of optional items
MOST_LEVELS = 100
PROSE_CHARS = 40
CONSTANT_PAGES = 5
SALTS = 32
TASK_HOSTS = 2000  # wrappers that a task holds at once
BROADCAST_BYTES = 32 << 20

# A node is [label, quantifier, children, texts]; a text slot has the label "#" and no children.
# quantifier: "1", "?", "+" or "*". texts: [blocks, characters, characters in links, a digest of the text or None if it varies,
# digests of CONSTANT_PAGES different pages that have it, or of all if they are fewer; none if it varies]
LABEL, TIMES, CHILDREN, TEXTS = range(4)


def label_of(tag: str, attributes: str) -> str:
    """tag, and the names of class, id and role: their parts without digits, joined by hyphens."""
    if not attributes or not attributes.strip():
        return tag
    found = set()
    for name, value in LABELS.findall(attributes):
        if name.lower().endswith("hidden"):
            if value.strip("\"'").lower() != "false":
                found.add("hidden")
        elif name.lower() == "style":
            if UNSEEN.search(value):
                found.add("hidden")
        else:
            for token in value.strip("\"'").split():
                parts = [w for w in SPLIT_WORDS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()) if w]
                if parts:
                    found.add("-".join(parts))
    return ".".join([tag, *sorted(found)]) if found else tag


def parse(source: str) -> list:
    """The page as a tree of block elements; texts are (text, characters in links), entities decoded, white space as one space."""
    root: list = ["", []]
    stack = [root]
    names = [""]
    parts: list[str] = []
    linked: list[str] = []
    links = 0
    silent: list[str] = []  # inline elements open inside one that holds no main text

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                within = len(" ".join(html.unescape("".join(linked)).split())) if linked else 0
                stack[-1][1].append((text, within))
            parts.clear()
            linked.clear()

    for m in TOKEN.finditer(source):
        tag = m[3]
        if tag is None:
            token = m[0]
            if silent:
                continue
            if token[0] != "<" or token == "<":
                parts.append(token)
                if links:
                    linked.append(token)
            elif m[1] and m[1].lower() != "title":
                parts.append(" ")
            continue
        tag = tag.lower()
        end = bool(m[2])
        if tag in INLINE:
            if tag not in VOID and (silent or not end and m[4] and inline_outside(label_of(tag, m[4]))):
                if not end:
                    silent.append(tag)
                elif tag in silent:
                    while silent.pop() != tag:
                        pass
            if silent:
                continue
            if tag == "a":
                links = max(0, links - 1) if end else links + 1
            elif tag in ("br", "img", "input"):
                parts.append(" ")
            continue
        silent.clear()  # no inline element holds a block
        flush()
        if end:
            if tag in names:
                while names[-1] != tag:
                    names.pop()
                    stack.pop()
                names.pop()
                stack.pop()
                if len(stack) > MOST_LEVELS:  # its parent goes on behind it
                    stack[-1] = [stack[-1][0], []]
                    stack[MOST_LEVELS - 1][1].append(stack[-1])
            links = 0
            continue
        while (by := ENDED_BY.get(names[-1])) and tag in by:
            names.pop()
            stack.pop()
        if tag in ("html", "body") or tag in VOID:
            continue
        node = [label_of(tag, m[4]), []]
        if len(stack) < MOST_LEVELS:
            stack[-1][1].append(node)
        else:  # what is nested deeper stands beside its parents, and is marked by those that decide over it
            up = stack[-1][0] if len(stack) > MOST_LEVELS else ""
            if up.startswith("!") or outside(up, up.startswith("@")):
                node[0] = "!" + node[0]
            elif up.startswith("@") or up.split(".")[0] in MAIN_TAGS:
                node[0] = "@" + node[0]
            stack[MOST_LEVELS - 1][1].append(node)
        stack.append(node)
        names.append(tag)
    flush()
    return root[1]


def generalized(children: list, page: int = 0) -> list:
    """The wrapper of one page's items: each text constant, neighbours of one label a repeated group."""
    out: list = []
    for child in children:
        if isinstance(child, tuple):
            node = ["#", "1", [], [1, len(child[0]), child[1], xxhash.xxh64_intdigest(child[0].encode(errors="surrogatepass")), (page,)]]
        else:
            node = [child[0], "1", generalized(child[1], page), None]
        _append(out, node)
    return _bounded(out)


def _append(out: list, node: list) -> None:
    if out and out[-1][LABEL] == node[LABEL]:
        out[-1] = merged(out[-1], node)
        out[-1][TIMES] = "+" if "1" in out[-1][TIMES] or "+" in out[-1][TIMES] else "*"
    else:
        out.append(node)


def _bounded(items: list) -> list:
    """Too many items become (a? b? c?)+, each label once, as one group without a tag of its own."""
    if len(items) <= MOST_ITEMS:
        return items
    by: dict[str, list] = {}
    for node in items:
        by[node[LABEL]] = merged(by[node[LABEL]], node) if node[LABEL] in by else node
    for node in by.values():
        node[TIMES] = "*"
    return list(by.values())


def _texts(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return a or b
    same = a[3] is not None and a[3] == b[3]
    pages = tuple(sorted({*a[4], *b[4]})[:CONSTANT_PAGES]) if same else ()
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] if same else None, pages]


def merged(a: list, b: list) -> list:
    """Two items of one label as one."""
    many = a[TIMES] in "+*" or b[TIMES] in "+*"
    few = a[TIMES] in "?*" or b[TIMES] in "?*"
    times = "*" if many and few else "+" if many else "?" if few else "1"
    return [a[LABEL], times, aligned(a[CHILDREN], b[CHILDREN]), _texts(a[TEXTS], b[TEXTS])]


def _optional(node: list) -> list:
    return [node[LABEL], {"1": "?", "+": "*"}.get(node[TIMES], node[TIMES]), *node[2:]]


def aligned(a: list, b: list) -> list:
    """Two streams of items as one: the longest common subsequence of labels is merged, the rest becomes optional."""
    if [x[LABEL] for x in a] == [y[LABEL] for y in b]:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i][LABEL] == b[j][LABEL] else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i][LABEL] == b[j][LABEL]:
            _append(out, merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            _append(out, _optional(a[i]))
            i += 1
        else:
            _append(out, _optional(b[j]))
            j += 1
    return _bounded(out)


def names_one_of(name: str, words: frozenset) -> bool:
    """Whether a name is of a kind of element: its last part says what it is, unless that only holds what is named before; `has-sidebar` names a page with one."""
    *before, last = name.split("-")
    if before and before[0] in STATE_WORDS:
        return False
    return last in words or last in HOLDER_WORDS and not words.isdisjoint(before)


def outside(label: str, in_main: bool) -> bool:
    """Whether an element by its tag and names holds no main text; inside an article or main element, words that also name its parts do not count."""
    if label.startswith("!"):
        return True
    tag, *names = label.lstrip("@").split(".")
    words = OUTSIDE_WORDS - PART_WORDS if in_main else OUTSIDE_WORDS
    return tag in OUTSIDE_TAGS or (tag == "header" and not in_main) or any(names_one_of(n, words) for n in names)


def tag_of(label: str) -> str:
    return label.lstrip("!@").split(".")[0]


def is_main(label: str) -> bool:
    return label.startswith("@") or tag_of(label) in MAIN_TAGS


def weighed(children: list, framed: set[int], in_main: bool = False) -> tuple[int, int]:
    """Characters of main elements and of prose in a page's items; adds to framed the elements that hold most of either, whatever they are called.

    Not called outside although it says so: what holds most of the text in article and main elements, and, where there
    is no such element, a form or the like that holds most of the prose.
    """

    def walk(nodes: list, in_main: bool) -> tuple[int, int]:
        main = prose = 0
        for node in nodes:
            if isinstance(node, tuple):
                n = len(node[0])
                main += n * in_main
                prose += n * (n >= PROSE_CHARS and 2 * node[1] < n)
            else:
                a, b = walk(node[1], in_main or is_main(node[0]))
                sums[id(node)] = (a, b)
                main, prose = main + a, prose + b
        return main, prose

    sums: dict[int, tuple[int, int]] = {}
    total, all_prose = walk(children, in_main)

    def mark(nodes: list, in_main: bool) -> None:
        for node in nodes:
            if isinstance(node, tuple):
                continue
            a, b = sums[id(node)]
            inner = not is_main(node[0]) and not in_main
            if total and 2 * a > total and (inner or is_main(node[0])) or not total and 2 * b > all_prose and tag_of(node[0]) in FRAME_TAGS:
                framed.add(id(node))
            mark(node[1], in_main or is_main(node[0]))

    mark(children, False)
    return total, all_prose


def inline_outside(label: str) -> bool:
    tag, *words = label.split(".")
    return not INLINE_WORDS.isdisjoint(words)


def kept(around: str, in_main: bool, blocks: int, chars: int, links: int, constant: bool, beside: bool = False) -> tuple[bool, bool]:
    """Whether texts stay: on pages with a main element, and on pages without; beside: whether prose stands in an element next to theirs."""
    headed = around in HEADINGS or around in ("p", "pre", "blockquote")
    if in_main:  # all of an article, but menus and what its site repeats beside the text
        stays = headed or not (10 * links > 9 * chars or constant and chars < PROSE_CHARS * blocks and links)
        return stays, stays
    prose = (chars >= PROSE_CHARS * blocks or beside) and not constant
    listed = around in ("li", "dd", "dt", "td", "th", "figcaption", "caption")
    return False, headed and (around in HEADINGS or 2 * links < chars) or (prose or listed and not constant) and 2 * links < chars


def judged(items: list) -> list:
    """A wrapper as decisions: (label, children, stays, many), stays for text slots as in kept(); what lies outside the main text has no children."""

    def is_prose(node: list) -> bool:
        return node[LABEL] != "#" and any(c[LABEL] == "#" and c[TEXTS][1] >= PROSE_CHARS * c[TEXTS][0] and 2 * c[TEXTS][2] < c[TEXTS][1] for c in node[CHILDREN])

    def walk(nodes: list, around: str, in_main: bool, beside: bool) -> list:
        out = []
        near = any(is_prose(n) and not outside(n[LABEL], in_main) for n in nodes)
        for node in nodes:
            label, many = node[LABEL], node[TIMES] in "+*"
            if label == "#":
                blocks, chars, links, constant, pages = node[TEXTS]
                out.append((label, (), kept(around, in_main, blocks, chars, links, constant is not None and len(pages) >= CONSTANT_PAGES, beside), many))
            else:  # what its names put outside is judged as well: on some pages it may frame the main text
                out.append((label, tuple(walk(node[CHILDREN], tag_of(label), in_main or is_main(label), near)), (True, True), many))
        return out

    return walk(items, "", False, False)


def has_text(children: list) -> bool:
    return any(isinstance(c, tuple) or has_text(c[1]) for c in children)


def has_main(children: list, framed: set[int]) -> bool:
    """Whether a page has an article or main element with a text."""
    nodes = [c for c in children if not isinstance(c, tuple) and (id(c) in framed or not outside(c[0], False))]
    return any(is_main(n[0]) and has_text(n[1]) or has_main(n[1], framed) for n in nodes)


def label_in(child: tuple | list) -> str:
    return "#" if isinstance(child, tuple) else child[0]


def fitted(child: tuple | list, item: tuple, known: dict) -> int:
    """How many of the child's blocks have a place in the item."""
    if isinstance(child, tuple):
        return 1
    key = id(child), id(item)
    if key not in known:
        known[key] = sum(fitted(c, found, known) for c, found in zip(child[1], places(child[1], item[1], known), strict=True) if found is not None)
    return known[key]


def places(children: list, wrapper: tuple | list, known: dict) -> list[tuple | None]:
    """The wrapper's item of each child, so that in order most blocks inside have a place; out of order where else a child had none."""
    by: dict[str, list[int]] = {}
    for k, item in enumerate(wrapper):
        by.setdefault(item[0], []).append(k)
    labels = [label_in(c) for c in children]
    if all(len(by.get(x, ())) <= 1 for x in labels):
        return [wrapper[by[x][0]] if x in by else None for x in labels]
    n, m = len(children), len(wrapper)
    # children of equal label side by side are one item's
    best = [[0] * (m + 1) for _ in range(n + 1)]
    took = [[False] * m for _ in range(n)]
    for i in range(n - 1, -1, -1):
        for k in range(m - 1, -1, -1):
            score = max(best[i][k + 1], best[i + 1][k])
            if wrapper[k][0] == labels[i]:
                match = 1 + 2 * fitted(children[i], wrapper[k], known) + best[i + 1][k if wrapper[k][3] else k + 1]
                if match >= score:
                    score, took[i][k] = match, True
            best[i][k] = score
    out: list[tuple | None] = [None] * n
    i = k = 0
    while i < n and k < m:
        if took[i][k]:
            out[i] = wrapper[k]
            k += not wrapper[k][3]
            i += 1
        elif best[i][k + 1] >= best[i + 1][k]:
            k += 1
        else:
            i += 1
    for i, found in enumerate(out):  # a group's next round
        if found is None and labels[i] in by:
            out[i] = max((wrapper[k] for k in by[labels[i]]), key=lambda item: fitted(children[i], item, known))
    return out


def extracted(children: list, wrapper: tuple | list) -> list[str]:
    """The page's blocks that fall in the wrapper's slots that stay, in page order."""
    framed: set[int] = set()
    weighed(children, framed)
    without = not has_main(children, framed)
    known: dict = {}
    out: list[str] = []

    def is_prose(child: tuple | list) -> bool:
        return not isinstance(child, tuple) and any(isinstance(c, tuple) and len(c[0]) >= PROSE_CHARS and 2 * c[1] < len(c[0]) for c in child[1])

    def walk(children: list, wrapper: tuple | list, around: str, in_main: bool, beside: bool = False) -> None:
        near = any(is_prose(c) and not outside(c[0], in_main) for c in children)
        for child, item in zip(children, places(children, wrapper, known), strict=True):
            if isinstance(child, tuple):
                text, links = child
                stays = item[2] if item is not None else kept(around, in_main, 1, len(text), links, False, beside)
                if stays[without]:
                    out.append(text)
            elif id(child) in framed or not outside(child[0], in_main):
                walk(child[1], item[1] if item is not None else (), tag_of(child[0]), in_main or is_main(child[0]), near)

    walk(children, wrapper, "", False)
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_host: dict[str, list] = {}
    salt = TaskContext.get().partitionId() % SALTS

    def packed() -> pa.RecordBatch:
        columns = [pa.array(list(by_host), pa.string()), pa.array([salt] * len(by_host), pa.int32()), pa.array([pickle.dumps(w) for w in by_host.values()], pa.binary())]
        by_host.clear()
        return pa.RecordBatch.from_arrays(columns, ["host", "salt", "wrapper"])

    for batch in batches:
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            page = source.as_py() or ""
            items = generalized(parse(page), xxhash.xxh64_intdigest(page.encode(errors="surrogatepass")))
            by_host[host] = aligned(by_host[host], items) if host in by_host else items
            if len(by_host) >= TASK_HOSTS:
                yield packed()
    if by_host:
        yield packed()


def _together(rows: pd.DataFrame) -> bytes:
    # the same order on each run
    out, *more = (pickle.loads(w) for w in sorted(rows["wrapper"]))
    for w in more:
        out = aligned(out, w)
    return pickle.dumps(out)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (as decisions) of every host."""
    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_infer, "host string, salt int, wrapper binary")
    some = parts.groupBy("host", "salt").applyInPandas(lambda rows: pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [_together(rows)]}), "host string, wrapper binary")
    return some.groupBy("host").applyInPandas(lambda rows: pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [pickle.dumps(judged(pickle.loads(_together(rows))))]}), "host string, wrapper binary")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read: dict[bytes, list] = {}
    for batch in batches:
        texts = []
        for source, wrapper in zip(batch.column("html"), batch.column("wrapper"), strict=True):
            packed = wrapper.as_py()
            if packed not in read:
                if len(read) > 5000:
                    read.clear()
                read[packed] = pickle.loads(packed) if packed else []
            texts.append("\n".join(extracted(parse(source.as_py() or ""), read[packed])))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    kind = dict(pages.dtypes)["page_id"]
    pages = pages.select("page_id", "url", "html")
    known = Written(pages.sparkSession).table(wrappers(pages))
    size = known.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host") + 32), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:  # else hosts with many pages are split by adaptive execution
        known = F.broadcast(known)
    joined = pages.withColumn("host", host_of(F.col("url"))).join(known, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
