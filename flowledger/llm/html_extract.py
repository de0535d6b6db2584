"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tags and texts; properly closed, it is a tree of blocks, with inline marks dissolved into the texts
around them. A wrapper is inferred by aligning the pages of a host one after another. Inside a page, neighbours of one
kind, or repeated sequences of two or three kinds, become a repeated group; between two pages, blocks that only one has
become optional, and texts that differ become slots; texts that agree stay as constants. There is no union: two blocks
either align or are optional.

The wrapper's blocks are then judged by what the sample pages hold there. Slots, optional and repeated groups may be
content; constants and blocks that are equal on CONSTANT_PAGES unlike pages are template. Content is what an article or
main element holds, or, without one, the innermost block with all those parts whose changing words, outside links, make up
a share of SIGNIFICANT, and with the paragraphs, headlines and the like beside them. Inside an article or main element
texts that pages share are content too, a label of a recipe say, unless most of their words are links or their block's name
tells otherwise. What HTML itself calls a menu, header, footer, aside, form or dialogue isn't followed. Names of
classes only break ties: a block called a comment list or an advert, by exactly that name, is left out beside others, one
called a menu or sidebar only if most of its words are links or it recurs on the host's pages, one with a vaguer name only
if it recurs. A page is read by matching it against the wrapper, block by block; a page of which the wrapper knows less
than it doesn't is its own sample.

At most SAMPLE pages of a host are aligned, one from each of as many hash classes; every page is extracted. Nothing here
is recursive, so pages may nest as deep as they like.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.llm.scratch import keep, lean

SAMPLE = 12
#: Unlike pages on which a text must stand in the same place to count as template.
CONSTANT_PAGES = 3
#: Pages that share so much of their three-word sequences count as one.
ALIKE = 0.8
#: Share of a block's changing words that a part of it needs to be content by itself.
SIGNIFICANT = 0.1
#: Cells of a table of alignment that are held at once; larger ones are halved, with the same outcome.
TABLE = 1 << 22
#: Sample pages, and bytes of wrappers, that are broadcast at most; above that the pages are shuffled by host, and Spark
#: splits the large ones.
PICKS, WRAPPERS = 1_000_000, 64 << 20

TEMPLATE, CONTENT, THROUGH = 0, 1, 2

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {x: re.compile(rf"</{x}\b[^>]*>?", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd maction semantics annotation annotation-xml".split())
_INLINE = _MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img label".split())
#: What a start tag ends, if it is open and no block of the second kind lies between.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_NOISE_TAGS = frozenset("head nav aside footer form script style noscript template svg iframe button select option textarea title dialog menu canvas audio video xmp noembed noframes".split())
_NOISE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
#: Whole names of classes and ids: those that say what a block is, and those that may also be an article's.
_CLEAR = frozenset("ad ads advert adverts advertisement advertising comments comment-list disqus_thread cookie-notice cookie-banner".split())
_LISTS = frozenset("sidebar breadcrumb breadcrumbs pagination navbar navigation menu nav footer".split())
_VAGUE = frozenset("comment replies respond related recommended share sharing social promo promotion sponsor sponsored banner notice notices newsletter subscribe subscription signup widget widgets cookie cookies popup modal overlay header".split())
_MAIN = frozenset(["article", "main"])
#: Blocks that are text rather than parts of a page.
_TEXT = frozenset("# p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre table tbody thead tr td th figure figcaption address details summary".split())


class Node:
    """A block: kind, children, how often (1, ?, + or *), the sample pages that have it as bits; a text has kind # and its
    words or None for a slot. ``hint`` says what its names do: 3 clearly no article, 2 a menu or the like, 1 vaguely no
    article, 0 nothing."""

    __slots__ = ("changed", "children", "flag", "hint", "kind", "links", "noise", "often", "pages", "tag", "text", "weight", "words")

    def __init__(self, kind: str, tag: str, noise: bool = False, hint: int = 0, text: str | None = None, links: int = 0):
        self.kind, self.tag, self.noise, self.hint, self.text, self.links = kind, tag, noise, hint, text, links
        self.children, self.often, self.pages, self.changed, self.flag, self.weight = [], "1", 1, False, TEMPLATE, 0
        self.words = len(text.split()) if text else 0


def walk(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(n.children))
    return out


def _noise(name: str, attrs: dict[str, str]) -> bool:
    return name in _NOISE_TAGS or attrs.get("role", "").lower() in _NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _hint(attrs: dict[str, str]) -> int:
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    return 3 if not _CLEAR.isdisjoint(names) else 2 if not _LISTS.isdisjoint(names) else 1 if not _VAGUE.isdisjoint(names) else 0


def _linked(block: Node) -> bool:
    """Whether most words of a block are links."""
    words, links = 0, 0
    for n in walk(block):
        if n.kind == "#":
            words, links = words + n.words, links + n.links
    return 2 * links > words


def parse(page: str) -> Node:
    """The tree of a page, with unclosed elements closed where a browser would."""
    root = Node("", "")
    stack, names, opened = [root], [""], Counter()
    text: list[str] = []
    links = skip = 0  # words in links so far, depth of inline noise

    def flush() -> None:
        nonlocal links
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                stack[-1].children.append(Node("#", "#", text=words, links=links))
            text.clear()
        links = 0

    def close(at: int) -> None:
        flush()
        opened.subtract(names[at:])
        del stack[at:], names[at:]

    inline: list[tuple[str, bool]] = []
    within: Counter[str] = Counter()
    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if (m.start() if m else len(page)) > at and not skip:
            text.append(page[at : m.start() if m else len(page)])
            if within["a"]:
                links += len(text[-1].split())
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not skip:
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1] or m[4]:
            if name in _INLINE:
                while within[name] > 0:
                    last, bad = inline.pop()
                    skip -= bad
                    within[last] -= 1
                    if last == name:
                        break
            elif opened[name] > 0:
                k = len(names) - 1
                while names[k] != name:
                    k -= 1
                close(k)
                inline.clear()
                within.clear()
                skip = 0
            elif name == "p":
                flush()
            continue
        attrs = {a.lower(): v.strip("\"'") for a, v in _ATTR.findall(m[3] or m[6] or "")} if m[3] or m[6] else {}
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _INLINE:
            if name == "br":
                text.append(" ")
            elif name not in _VOID:
                bad = _noise(name, attrs) or name.startswith("annotation")
                inline.append((name, bad))
                within[name] += 1
                skip += bad
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        flush()
        inline.clear()
        within.clear()
        skip = 0
        if names[-1] == "p":
            close(len(names) - 1)
        if name in _ENDS:
            ends, bounds = _ENDS[name]
            if any(opened[x] > 0 for x in ends):
                last = len(names)
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in bounds:
                        break
                    if names[k] in ends:
                        last = k
                if last < len(names):
                    close(last)
        if name in ("body", "html") and opened[name] > 0:
            continue
        if name == "body" and opened["head"] > 0:
            close(names.index("head"))
        inside = opened["article"] + opened["main"] > 0
        cls = ".".join(sorted(re.sub(r"\d+", "0", attrs.get("class", "").lower()).split())[:3])
        main = name in ("body", "html", *_MAIN)
        noise = _noise(name, attrs) or name == "header" and not inside
        node = Node((f"{name}.{cls}" if cls else name) + "!" * noise, name, noise, 0 if main else _hint(attrs))
        stack[-1].children.append(node)
        stack.append(node)
        names.append(name)
        opened[name] += 1
    close(1)
    return root


def fold(root: Node) -> Node:
    """The tree with repeated neighbours, or sequences of up to three kinds of them, as one repeated group."""
    for node in reversed(walk(root)):
        kids = node.children
        for period in (1, 2, 3):
            out: list[Node] = []
            for c in kids:
                out.append(c)
                if len(out) >= 2 * period and all(a.kind == b.kind != "#" for a, b in zip(out[-2 * period : -period], out[-period:], strict=True)):
                    last = out[-period:]
                    del out[-period:]
                    for a, b in zip(out[-period:], last, strict=True):
                        merge(a, b, True)
            kids = out
        node.children = kids
    return root


def merge(a: Node, b: Node, repeated: bool = False) -> Node:
    """``a`` widened so that it also takes ``b``, which has the same kind."""
    stack = [(a, b, repeated)]
    while stack:
        x, y, again = stack.pop()
        if x.kind == "#":
            if x.text != y.text:
                x.text, x.changed = None, True
            x.changed |= y.changed
        x.words += y.words
        x.links += y.links
        x.pages |= y.pages
        x.noise |= y.noise
        x.hint = min(x.hint, y.hint)
        if again:
            x.often = "+" if x.often in "1+" else "*"
        else:
            x.often = {"": "1", "?": "?", "+": "+", "?+": "*"}["?" * bool({x.often, y.often} & set("?*")) + "+" * bool({x.often, y.often} & set("+*"))]
        out, i, j = [], 0, 0
        for p, q in [*common([c.kind for c in x.children], [c.kind for c in y.children]), (len(x.children), len(y.children))]:
            out += map(_optional, x.children[i:p])
            out += map(_optional, y.children[j:q])
            if p < len(x.children):
                out.append(x.children[p])
                stack.append((x.children[p], y.children[q], False))
            i, j = p + 1, q + 1
        x.children = out
    return a


def _optional(n: Node) -> Node:
    n.often = {"1": "?", "+": "*"}.get(n.often, n.often)
    return n


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of two lists of kinds."""
    if x == y:
        return [(k, k) for k in range(len(x))]
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(k, len(number)) for k in z], np.int64) for z in (x, y))
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:  # the later part is pushed first, so that pairs come in order
        i, ie, j, je = stack.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        if i == ie or j == je:
            continue
        if (ie - i) * (je - j) <= TABLE:
            size = np.zeros((ie - i + 1, je - j + 1), np.int32)
            for r in range(ie - i - 1, -1, -1):
                size[r] = _row(size[r + 1], a[i + r] == b[j:je])
            r = c = 0
            while r < ie - i and c < je - j:
                if a[i + r] == b[j + c]:
                    out.append((i + r, j + c))
                    r, c = r + 1, c + 1
                elif size[r + 1, c] >= size[r, c + 1]:
                    r += 1
                else:
                    c += 1
            continue
        mid = (i + ie) // 2
        down, up = np.zeros(je - j + 1, np.int32), np.zeros(je - j + 1, np.int32)
        for r in range(i, mid):
            down = _row(down[::-1], (a[r] == b[j:je])[::-1])[::-1]
        for r in range(ie - 1, mid - 1, -1):
            up = _row(up, a[r] == b[j:je])
        cut = j + int((down + up).argmax())
        stack += [(mid, ie, cut, je), (i, mid, j, cut)]
    return out


def _row(below: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences from each column on, from those of the row below."""
    row = below.copy()
    np.maximum(row[:-1], below[1:] + equal, out=row[:-1])
    return np.maximum.accumulate(row[::-1])[::-1]


def expression(root: Node) -> str:
    """The wrapper as a regular expression over tags, with #PCDATA for slots."""
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == "#":
            out.append(("#PCDATA" if n.text is None else json.dumps(n.text, ensure_ascii=False)) + ("" if n.often == "1" else n.often))
        else:
            group = n.often != "1"
            stack.append(f"</{n.kind}>" + (f"){n.often}" if group else ""))
            stack.extend(reversed(n.children))
            out.append("(" * group + f"<{n.kind}>")
    return " ".join(out)


def unlike(pages: list[Node]) -> int:
    """Bits of the pages that don't share most of their three-word sequences with one before."""
    seen: list[set[int]] = []
    bits = 0
    for k, p in enumerate(pages):
        words = " ".join(n.text for n in walk(p) if n.kind == "#").split()
        own = {hash(tuple(words[i : i + 3])) for i in range(max(1, len(words) - 2))}
        if all(len(own & s) < ALIKE * min(len(own), len(s)) for s in seen):
            seen.append(own)
            bits |= 1 << k
    return bits


def infer(pages: list[Node]) -> Node:
    """The wrapper of some parsed pages, its blocks marked as content, template or to be gone through."""
    bits = unlike(pages)
    for k, p in enumerate(pages):
        for n in walk(p):
            n.pages = 1 << k
    root = fold(pages[0])
    for p in pages[1:]:
        merge(root, fold(p))
    several = bits.bit_count()
    order = walk(root)
    for n in reversed(order):
        if n.kind == "#":
            fixed = n.text is not None and not n.changed and (n.pages & bits).bit_count() >= CONSTANT_PAGES
            n.weight = 0 if fixed else max(0, n.words - n.links)
            n.flag = TEMPLATE if fixed else CONTENT
        else:
            n.weight = 0 if n.noise else sum(c.weight for c in n.children)
    outer, inside = [], set()  # inside: what is in an outer named block or in noise
    for n in order:
        if id(n) not in inside and n.tag in _MAIN and n.weight:
            outer.append(n)
        if n.noise or n.tag in _MAIN and n.weight or id(n) in inside:
            inside.update(map(id, n.children))
    if outer:
        best = max(n.weight for n in outer)
        parts = [n for n in outer if n.weight >= SIGNIFICANT * best]
        # an article inside main is what is meant
        parts = [x for n in parts for x in (_inner(n) or [n])]
    else:
        parts = _dense(root)
    for n in order:
        if n.kind != "#":
            n.flag = TEMPLATE
    for part in parts:
        stack = [(part, part)]
        while stack:
            n, top = stack.pop()
            if n.kind == "#":
                continue
            n.flag = CONTENT
            for c in n.children:
                again = (c.pages & bits).bit_count() > 1
                named = c.hint == 3 and (again or several == 1) or c.hint == 2 and (again or _linked(c)) or c.hint == 1 and again
                if not c.noise and not (c is not top and named and c.weight < 0.5 * top.weight):
                    stack.append((c, top))
                if c.kind == "#" and top.tag in _MAIN and not n.hint and 2 * c.links <= c.words:
                    c.flag = CONTENT  # what an article says is its own, though others say it too
            if n.tag[:1] == "h" and n.tag[1:].isdigit():
                for c in n.children:
                    c.flag = CONTENT  # a headline is never template
    for n in reversed(order):
        if n.flag == TEMPLATE and n.kind != "#" and any(c.kind != "#" and c.flag != TEMPLATE for c in n.children):
            n.flag = THROUGH
    return root


def _inner(main: Node) -> list[Node]:
    """The articles within a main element, if they hold half of its words."""
    if main.tag == "article":
        return []
    found, stack = [], list(main.children)
    while stack:
        n = stack.pop()
        if n.tag == "article" and n.weight:
            found.append(n)
        elif not n.noise:
            stack.extend(n.children)
    return found if sum(n.weight for n in found) >= 0.5 * main.weight else []


def _dense(root: Node) -> list[Node]:
    """The parts of a page without named ones that are content: from the outside in, as long as there is only one."""
    node = root
    while True:
        kids = [c for c in node.children if c.kind != "#" and not c.noise and c.weight]
        plain = sum(c.weight for c in node.children if c.tag in _TEXT and not c.noise)
        if plain >= SIGNIFICANT * node.weight or not kids:
            return [node]
        beside = [c for c in kids if c.tag in _TEXT and not c.hint and not _linked(c)]
        kids = [c for c in kids if c.weight >= SIGNIFICANT * node.weight and c.tag not in _TEXT] or kids
        if best := [c for c in kids if not c.hint]:
            kids = best
        if len(kids) > 1 or beside:
            return [*kids, *[c for c in beside if c not in kids]]
        node = kids[0]


def flat(root: Node) -> list[list]:
    """The wrapper as rows [parent, kind, flag, constant or null], parents first."""
    order = [n for n in walk(root) if n.kind != "#" or n.flag == TEMPLATE]  # slots take any text
    place = {id(n): k for k, n in enumerate(order)}
    rows: list[list] = [[-1, n.kind, n.flag, n.text if n.kind == "#" else None] for n in order]
    for k, n in enumerate(order):
        for c in n.children:
            if id(c) in place:
                rows[place[id(c)]][0] = k
    return rows


class Wrapper:
    """A wrapper to match pages against: by block its flag, its constants and its inner blocks by kind, in order."""

    def __init__(self, rows: list[list]):
        self.flag = [r[2] for r in rows]
        self.constants: list[set[str]] = [set() for _ in rows]
        self.inner: list[dict[str, list[int]]] = [{} for _ in rows]
        for k, (parent, kind, _, text) in enumerate(rows):
            if parent >= 0 and kind != "#":
                self.inner[parent].setdefault(kind, []).append(k)
            elif parent >= 0 and text is not None:
                self.constants[parent].add(text)

    def read(self, root: Node) -> tuple[list[str], int, int]:
        """(texts of the content blocks in page order, words in them, words in blocks that the wrapper doesn't know)."""
        out: list[str] = []
        got = lost = 0
        stack: list[tuple[Node, int, bool]] = [(root, 0, self.flag[0] == CONTENT)]
        while stack:
            n, w, content = stack.pop()
            if n.kind == "#":  # w is the parent's
                if content and not (w >= 0 and n.text in self.constants[w]):
                    out.append(n.text)
                    got += n.words
                continue
            todo: list[tuple[Node, int, bool]] = []
            at = -1
            for c in n.children:
                if c.kind == "#":
                    todo.append((c, w, content))
                    continue
                if c.noise:
                    continue
                known = self.inner[w].get(c.kind) if w >= 0 else None
                if known:  # the next block of this kind, or else the last one again
                    k = known[min(bisect_right(known, at), len(known) - 1)]
                    at = max(at, k)
                    if self.flag[k] != TEMPLATE:
                        todo.append((c, k, self.flag[k] == CONTENT))
                elif content:
                    if c.hint < 2 or c.hint == 2 and not _linked(c):
                        todo.append((c, -1, True))
                else:
                    lost += sum(x.words for x in walk(c))
            stack.extend(reversed(todo))
        return out, got, lost


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    if not page:
        return ""
    root = parse(page)
    found, got, lost = wrapper.read(root) if wrapper else ([], 0, 1)
    if got <= lost:  # another template than the sample's: the page is its own sample
        found = Wrapper(flat(infer([parse(page)]))).read(root)[0]
    return "\n".join(found)


def _infer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pages = sorted({x for x in pdf["html"] if x}, key=lambda x: (len(x), x))
    return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(flat(infer([parse(x) for x in pages])), ensure_ascii=False)]}) if pages else pd.DataFrame({"host": [], "wrapper": []})


@lru_cache(4096)
def _wrapper(text: str) -> Wrapper:
    return Wrapper(json.loads(text))


def _extract(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, wrappers in parts:
        yield pd.Series([extract(x, _wrapper(w) if w else None) for x, w in zip(pages, wrappers, strict=True)], dtype=object)


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper as JSON) by the pages of each host with the smallest hash in each of ``sample`` classes of hashes."""
    rows = pages.where(F.col(page).isNotNull()).select(host(url).alias("host"), F.xxhash64(id_col, page).alias("h"), F.col(page).alias("html"))
    picks = keep(rows.select("host", "h").groupBy("host", F.pmod("h", F.lit(sample)).alias("c")).agg(F.min("h").alias("h")).select("host", "h"), "picks")
    few = picks.count() <= PICKS
    some = rows.join(F.broadcast(picks) if few else picks, ["host", "h"], "left_semi")
    return some.dropDuplicates(["host", "h"]).groupBy("host").applyInPandas(_infer, "host string, wrapper string")


def main_text(pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each page: its blocks of main text, joined by line breaks.

    Null and blank pages, and pages without main text, have an empty one. Pages without a host share the empty host.
    Repeated rows are all returned; an empty table gives no rows.
    """
    lean(pages.sparkSession)
    found = keep(wrappers(pages, sample, id_col, url, page), "wrappers")
    size = found.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    found = F.broadcast(found) if size <= WRAPPERS else found
    rows = pages.select(F.col(id_col), F.col(url), F.col(page).alias("_html"), host(url).alias("_host")).join(found.withColumnRenamed("host", "_host"), "_host", "left")
    kind = F.pandas_udf(_extract, "string", F.PandasUDFType.SCALAR_ITER)
    rows = rows.select(id_col, url, kind("_html", "wrapper").alias("text"))
    return rows.select(id_col, url, "text", F.char_length("text").cast("long").alias("n_chars"))
