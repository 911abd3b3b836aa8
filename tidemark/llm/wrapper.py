"""HTML main text by wrappers: union-free expressions inferred for each host.

A page's block-level tags form a nested token stream.  Streams of one host are
aligned one after another: texts that all pages share stay constants, differing
ones become slots, tags that some pages lack become optional, and adjacent
repeats become repeated groups.  The wrapper also sums how much text its slots
hold and how much of that is links.  It decides the main region for every page
of the host: article or main elements, else the deepest element that holds most
of the unlinked text.  All texts of the region stay, also those that all pages
share, since a heading such as "Summary" is the article's on every page.

Markup is read as HTML says: ``<!-->`` is an empty comment, quotes count in
attribute values only, svg may close itself and ends at a tag that can't be in
it, ``p`` is closed by blocks within its scope.  An aside tag or word doesn't count
on an element that holds the main part of the page, such as a form around all.

Pages of one shape (the expression of a single page) are summed up in each
task, which is exact in any order.  The distinct shapes of a host are aligned in
their sorted order as a tree: in buckets by a hash of the shape, then those in
fewer buckets, then in one, so the wrapper does not depend on how the pages are
partitioned, a host with a third of all pages is spread over buckets, and a task
holds one wrapper at a time.  Where an element's children become many, the
wrapper keeps one optional node of each kind in a repeated group, so aligning a
page takes time by the page and the kinds of its elements, also on a host with a
shape per page.  The main region is decided by sums over paths, which neither
order nor grouping changes.  The joined wrapper table has a row per host; frequent hosts are
joined by broadcast (``join_hot``), so their pages are not shuffled.

Edge cases: null and empty pages have the empty text; a page without a host is
of the host ""; pages that have no text in their host's main region are read by
a wrapper of their own; broken markup is closed as it must be; elements nested
deeper than ``DEPTH`` count as content of the element at that depth; repeated
rows and further columns pass through, also those with the names of helpers.
"""

from __future__ import annotations

import json
import re
import sys
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_hot, map_rows, small_batches, written

#: Elements inside each other that are told apart; far beyond what browsers take.
DEPTH = 10_000
#: Children of an element that a merged wrapper tells apart by place; of more, only their kinds.
WIDE = 64
#: Buckets of a host's shapes, and of their wrappers.
BUCKETS = (4096, 64)
#: Nodes that a task holds before it hands its sums on.
HELD_NODES = 400_000
#: HTML's elements without content, raw text elements and block elements.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style noscript template textarea title iframe".split())
#: Raw elements whose content is markup, which counts where their end is missing.
MARKUP = {"noscript", "template"}
#: Start tags that end svg, elements of svg that may hold them, and the bounds of the scope in which blocks close `p`.
BREAKOUT = (
    "b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby|s|small|span|strong|strike|sub|sup|table|tt|u|ul|var"
)
INTEGRATION = {"foreignobject", "desc", "title"}
SCOPE = set("html table caption td th button".split())
BLOCK = set(
    "html head body article aside address blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul "
    "button label output".split()
)
#: Elements that a start tag of the key closes, up to the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Elements and class, id or role words of what is no main text.
ASIDE_TAGS = set("head nav aside footer form menu dialog search select button option fieldset".split())
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer cookie cookies consent notice notices gdpr popup modal overlay comment comments commentlist disqus respond "
    "reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchform widget "
    "pagination pager toolbar skip copyright legal disclaimer alert complementary contentinfo".split()
)
#: Aside tags that never hold the main text, and blocks that don't close `p`.
NEVER_MAIN = set("head select button option".split())
INLINE = set("option button label output select".split())
#: Words of ``ASIDE_WORDS`` that also name subjects, and words beside which they don't.
SUBJECT_WORDS = set("social legal share sharing notice notices alert related search reply replies respond skip menu promotion advert".split())
PLAIN_WORDS = set(
    "a all area articles bar block bottom box button buttons col column container content entries entry footer form group header heading icon icons inner item items left "
    "link links list main media more network networks nav news outer page pages panel post posts right row section site small stories story title top wrap wrapper you".split()
)
HEAD_WORDS = {"header", "masthead", "topbar"}
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')?+)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_SVG = re.compile(rf"""<(/?)(svg|foreignobject|desc|title|{BREAKOUT})(?=[\s/>])((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>""", re.I)
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Phrases about the layout around an element, not about what it is: one word each in a signature.
_LAYOUT = re.compile(
    r"(?<![a-z])(?:(?:with|without|no|has|have)(?:[-_]+(?:left|right|both|one|two|single|dual|primary|secondary|sticky))*"
    r"[-_]+(?:sidebars?|aside|nav|navbar|navigation|menu|footer|banner|ads?|adverts?|comments?|sharing|share|social|related|widgets?|toolbar|breadcrumbs?|pagination|pager|cookies?|newsletter|promo)"
    r"|(?:comments?|replies)[-_]+(?:open|closed|off|enabled|disabled|allowed)"
    r"|(?:category|tag|format|status)[-_]+[a-z0-9_-]+)(?![a-z])"
)


def _joined(m: re.Match) -> str:
    return re.sub("[^a-z]", "", m[0]) or "x"


def _words(name: str) -> list[str]:
    """The words of one class, id or role; a subject such as ``social-studies`` is one word."""
    words = _WORD.findall(name)
    subject = not SUBJECT_WORDS.isdisjoint(words) and any(w not in ASIDE_WORDS and w not in PLAIN_WORDS for w in words)
    return ["".join(words)] if subject else words


@lru_cache(maxsize=4096)
def signature(tag: str, attrs: str) -> str:
    """The tag and the words of its class, id and role."""
    if not attrs or "=" not in attrs:
        return tag
    values = (_LAYOUT.sub(_joined, _CAMEL.sub("-", m[2] or m[3] or m[4] or "").lower()) for m in _ATTR.finditer(attrs))
    words = dict.fromkeys(w for v in values for name in v.split() for w in _words(name))
    return ".".join([tag, *words]) if words else tag


@lru_cache(maxsize=4096)
def is_aside(sig: str) -> bool:
    """Whether tag or words set an element aside; `x` overrules words by what it holds."""
    tag, *words = sig.split(".")
    if tag in ASIDE_TAGS:
        return True
    if tag in ("html", "body", "main"):
        return False
    return not ASIDE_WORDS.isdisjoint(words)


@lru_cache(maxsize=4096)
def is_head(sig: str) -> bool:
    tag, *words = sig.split(".")
    return tag == "header" or (tag[0] != "h" and not HEAD_WORDS.isdisjoint(words))


def after_svg(html: str, at: int) -> int:
    """The end of an svg element whose start tag ends at ``at``: its end tag, or a tag that can't be inside."""
    depth, inner = 1, 0
    for m in _SVG.finditer(html, at):
        name, end = m[2].lower(), m[1] == "/"
        step = -1 if end else 0 if _SELF_CLOSED.search(m[3]) else 1
        if name == "svg":
            depth += step
            if not depth:
                return m.end()
        elif name in INTEGRATION:
            inner = max(0, inner + step)
        elif not end and not inner:
            return m.start()
    return len(html)


def events(html: str) -> list[tuple[str, str, bool]]:
    """Balanced stream of (kind, value, linked): ``+`` and ``-`` of block elements, and ``t`` for text.

    A line break is white space; inline elements leave no trace but links.
    """
    out: list[tuple[str, str, bool]] = []
    stack: list[str] = []
    names: list[str] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag
    links, at, n = 0, 0, len(html)

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            out.append(("-", stack.pop(), False))
            places[names.pop()].pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def text(s: str) -> None:
        if s:
            out.append(("t", unescape(s) if "&" in s else s, links > 0))

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        end, attrs = m[1] == "/", m[3] or ""
        if tag in RAW and not end:
            closing = re.compile(f"</{re.escape(tag)}\\b[^>]*(?:>|\\Z)", re.I).search(html, at)
            if closing is not None:
                at = closing.end()
            elif tag not in MARKUP:
                at = n
        elif tag == "svg" and not end:
            if not _SELF_CLOSED.search(attrs):
                at = after_svg(html, at)
        elif tag == "a":
            links = 0 if end else 1
        elif tag == "br":
            out.append(("t", " ", False))
        elif tag in VOID and tag != "hr":
            continue
        elif tag in BLOCK:
            links = 0
            if end:
                if places[tag]:
                    close_to(places[tag][-1])
                continue
            if places["p"] and tag not in INLINE and places["p"][-1] > last(SCOPE):
                close_to(places["p"][-1])
            shut, stop = CLOSES.get(tag, (None, None))
            if shut:
                low = last(stop)
                cuts = [own[k] for t in shut if (k := bisect_right(own := places[t], low)) < len(own)]
                if cuts:
                    close_to(min(cuts))
            sig = signature(tag, attrs)
            out.append(("+", sig, False))
            if tag == "hr":
                out.append(("-", sig, False))
            else:
                places[tag].append(len(stack))
                stack.append(sig)
                names.append(tag)
    close_to(0)
    return cleared(out)


def holders(stream: list[tuple[str, str, bool]], wanted: Callable[[str], bool], skipped: set[str]) -> list[tuple[int, int]]:
    """Start and end of the wanted elements that hold the main part of the page.

    That is over half of the unlinked text outside of ``skipped`` elements, with
    an h1 or an article (or on a page that has neither).
    """
    path, found = [[-1, 0, False, False]], []  # place, characters, h1 or article, inside of a skipped element
    for i, (kind, value, linked) in enumerate(stream):
        top = path[-1]
        if kind == "t":
            if not linked and not top[3]:
                top[1] += len("".join(value.split()))
        elif kind == "+":
            tag = value.split(".", 1)[0]
            titled = not top[3] and (tag == "h1" or tag == "article" and not is_aside(value))
            path.append([i, 0, titled, top[3] or tag in skipped])
        else:
            at, size, titled, _ = path.pop()
            if wanted(stream[at][1]):
                found.append((at, i, size, titled or stream[at][1].startswith("article.")))
            path[-1][1] += size
            path[-1][2] |= titled
    _, total, any_titled, _ = path[0]
    return [(at, i) for at, i, size, titled in found if size * 2 > total and (titled or not any_titled)]


def cleared(stream: list[tuple[str, str, bool]]) -> list[tuple[str, str, bool]]:
    """The stream without the aside tags and words of elements that hold the main part of the page.

    Such as a form around all, or ``<div class="content social">``.
    """
    if not any(kind == "+" and is_aside(sig) for kind, sig, _ in stream):
        return stream
    out = list(stream)
    tagged = lambda sig: sig.split(".", 1)[0] in ASIDE_TAGS - NEVER_MAIN
    for at, end in holders(out, tagged, NEVER_MAIN):
        sig = ".".join(["div", *out[at][1].split(".")[1:]])
        out[at], out[end] = ("+", sig, False), ("-", sig, False)
    named = lambda sig: "." in sig and sig.split(".", 1)[0] not in ASIDE_TAGS and is_aside(sig)
    for at, end in holders(out, named, ASIDE_TAGS):
        tag, *words = out[at][1].split(".")
        sig = ".".join([tag, *(w for w in words if w not in ASIDE_WORDS)])
        out[at], out[end] = ("+", sig, False), ("-", sig, False)
    return out


# A wrapper node is a list: signature, occurrence (1 ? + *), unlinked and linked
# characters, the texts that every page with the node has (of a text node; none:
# a slot), child nodes.
SIG, OCC, CHARS, LINKED, SEEN, KIDS = range(6)
GROUP, ANY, TEXT = "()", "()any", "#text"
GROUPS = (GROUP, ANY)
NONE: frozenset[int] = frozenset()


def line_of(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def mark(line: str) -> int:
    """A text as a number: 32 bits of a hash and its length (up to 20 bits)."""
    return xxhash.xxh32_intdigest(line.encode("utf-8", "surrogatepass")) << 20 | min(len(line), (1 << 20) - 1)


def child(path: int, sig: str) -> int:
    """The path of an element inside an element."""
    return xxhash.xxh64_intdigest(sig, path) >> 1


def skeleton(stream: list[tuple[str, str, bool]]) -> list:
    """One page as a wrapper."""
    root = ["", "1", 0, 0, NONE, []]
    path, held = [root], []
    deep = 0

    def flush() -> None:
        """The texts since the last tag are one text node."""
        if held:
            size = [0, 0]
            for value, linked in held:
                size[linked] += len(" ".join(value.split()))
            if sum(size):
                path[-1][KIDS].append([TEXT, "1", *size, frozenset((mark(line_of([v for v, _ in held])),)), []])
            held.clear()

    for kind, value, linked in stream:
        if kind == "t":
            held.append((value, linked))
            continue
        flush()
        if kind == "+":
            if len(path) > DEPTH:
                deep += 1
                continue
            node = [value, "1", 0, 0, NONE, []]
            path[-1][KIDS].append(node)
            path.append(node)
        elif deep:
            deep -= 1
        else:
            node = path.pop()
            node[KIDS] = repeats(node[KIDS])
    flush()
    root[KIDS] = repeats(root[KIDS])
    return root


def key(node: list) -> str:
    return node[SIG] if node[SIG] != GROUP else GROUP + " ".join([key(k) for k in node[KIDS]])


def merge(a: list, b: list, across: bool = True) -> list:
    """Two nodes of one key as one: of different pages, or (not ``across``) of one.

    Texts that both pages have stay, or those that either has in its page.
    """
    many = a[OCC] in "+*" or b[OCC] in "+*"
    maybe = a[OCC] in "?*" or b[OCC] in "?*"
    occ = ("*" if maybe else "+") if many else ("?" if maybe else "1")
    if across:
        seen = a[SEEN] & b[SEEN]
    else:
        a, b = (x if x[OCC] in "1+" else unsure(x) for x in (a, b))
        seen = a[SEEN] | b[SEEN]
    return [a[SIG], occ, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], seen, align(a[KIDS], b[KIDS], across)]


def unsure(node: list) -> list:
    """A node that a page may lack promises no text."""
    return [*node[:SEEN], NONE, [unsure(k) for k in node[KIDS]]]


def optional(node: list) -> list:
    return [node[SIG], "*" if node[OCC] in "+*" else "?", *node[CHARS:]]


def repeats(nodes: list[list]) -> list[list]:
    """Adjacent repeats of up to four nodes as one repeated node or group."""
    for size in (1, 2, 3, 4):
        i, out = 0, []
        keys = [key(x) for x in nodes]
        while i < len(nodes):
            unit = keys[i : i + size]
            j = i + size
            if len(unit) == size and keys[j : j + size] == unit and TEXT not in unit[: 1 if size == 1 else 0]:
                joined, sure = nodes[i:j], nodes[i][OCC] in "1+"
                while keys[j : j + size] == unit:
                    sure = sure or nodes[j][OCC] in "1+"
                    joined = [merge(x, y, False) for x, y in zip(joined, nodes[j : j + size], strict=True)]
                    j += size
                if size == 1:
                    x = joined[0]
                    out.append([x[SIG], "+" if sure else "*", *x[CHARS:]])
                else:
                    out.append([GROUP, "+", 0, 0, NONE, joined])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of the longest common subsequence."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def gather(nodes: list[list]) -> list:
    """A list of any length as one group of its kinds, each once: (a? b? c?)*, which takes them in every order."""
    held: dict[str, list] = {}
    todo = [(node, False) for node in reversed(nodes)]
    while todo:
        node, gathered = todo.pop()
        if node[SIG] in GROUPS:
            todo += [(kid, node[SIG] == ANY) for kid in reversed(node[KIDS])]
            continue
        node = node if gathered else optional(unsure(node))
        held[node[SIG]] = merge(held[node[SIG]], node) if node[SIG] in held else node
    return [ANY, "*", 0, 0, NONE, list(held.values())]


def align(a: list[list], b: list[list], across: bool = True) -> list[list]:
    """The longest common subsequence is merged, the rest becomes optional; nothing is left out.

    Lists that are longer than ``WIDE``, or would be, become one group of their kinds.
    """
    x, y = [key(n) for n in a], [key(n) for n in b]
    if ANY in x or ANY in y:
        return [gather([*a, *b])]
    if x == y:
        return [merge(p, q, across) for p, q in zip(a, b, strict=True)]
    if max(len(x), len(y)) > WIDE:
        return [gather([*a, *b])]
    i = j = 0
    out = []
    for p, q in [*matches(x, y), (len(a), len(b))]:
        out += [optional(n) for n in a[i:p]] + [optional(n) for n in b[j:q]]
        if p < len(a):
            out.append(merge(a[p], b[q], across))
        i, j = p + 1, q + 1
    out = repeats(out)
    return out if len(out) <= WIDE else [gather(out)]


def preorder(root: list) -> Iterator[tuple[list, int]]:
    """Nodes with the place of their parent; after a node (-1: its end)."""
    todo = [(root, -1)]
    n = 0
    while todo:
        node, parent = todo.pop()
        yield node, parent
        if node is not END:
            todo.append((END, -1))
            todo += [(k, n) for k in reversed(node[KIDS])]
            n += 1


#: Stands for the end of an element in ``preorder``.
END: list = []


def flat(root: list) -> tuple[str, list[int], list[int], list[list[int]]]:
    """A wrapper as its shape and, node by node, its characters and texts."""
    shape, chars, linked, seen = [], [], [], []
    for node, _ in preorder(root):
        if node is END:
            shape.append(")")
        else:
            shape.append(node[OCC] + node[SIG])
            chars.append(node[CHARS])
            linked.append(node[LINKED])
            seen.append(sorted(node[SEEN]))
    return " ".join(shape), chars, linked, seen


def tree(shape: str, chars: list[int], linked: list[int], seen: list[list[int]]) -> list:
    """The wrapper of ``flat``."""
    path, n, root = [], 0, None
    for token in shape.split(" "):
        if token == ")":
            root = path.pop()
        else:
            node = [token[1:], token[0], int(chars[n]), int(linked[n]), frozenset(map(int, seen[n])), []]
            n += 1
            if path:
                path[-1][KIDS].append(node)
            path.append(node)
    return root


def expression(root: list) -> str:
    """The wrapper as a union-free regular expression."""
    out, path = [], []
    for node, _ in preorder(root):
        if node is END:
            node = path.pop()
            if node[SIG] in GROUPS:
                out[-1] = out[-1].rstrip(" ")
                out.append(")")
            elif node[SIG] != TEXT:
                out.append(f"</{node[SIG].split('.')[0]}>")
            out.append((node[OCC] if node[OCC] != "1" else "") + (" " if path and path[-1][SIG] in GROUPS else ""))
        else:
            path.append(node)
            out.append({TEXT: "#const" if node[SEEN] else "#slot", GROUP: "(", ANY: "("}.get(node[SIG], f"<{node[SIG]}>"))
    return "".join(out)


def by_path(root: list) -> list:
    """The elements of a wrapper by path alone: [signature, size, elements inside].

    Size is the unlinked characters that are not set aside, less the linked
    ones.  Elements of one path are one here, so it doesn't matter in which order
    pages were aligned nor what was gathered.
    """
    top = ["", 0, {}]
    order, todo = [top], [(root, top)]
    while todo:
        node, to = todo.pop()
        to[1] += node[CHARS] - node[LINKED]
        for kid in node[KIDS]:
            at = to
            if kid[SIG] != TEXT and kid[SIG] not in GROUPS:
                at = to[2].get(kid[SIG])
                if at is None:
                    at = to[2][kid[SIG]] = [kid[SIG], 0, {}]
                    order.append(at)
            todo.append((kid, at))
    for at in reversed(order):
        at[1] = 0 if at[0] and is_aside(at[0]) else at[1] + sum([k[1] for k in at[2].values()])
    return top


#: Elements that may wrap the main text without being it.
_AROUND = set("html body div section table tbody tr td center dl dd".split())


def main_region(root: list) -> list[int]:
    """Paths of the elements that hold the main text."""
    top = by_path(root)
    articles, mains, sizes = [], [], {"article": 0, "main": 0}
    todo = [(top, 0, False)]
    while todo:
        (_, _, kids), path, in_main = todo.pop()
        for sig, size, _ in kids.values():
            if is_aside(sig):
                continue
            at = child(path, sig)
            tag = sig.split(".", 1)[0]
            if tag == "article" and size > 0:
                articles.append(at)
                sizes["article"] += size
                continue
            main = size > 0 and (tag == "main" or (".main" in sig and tag in ("div", "section")))
            if main and not in_main:
                mains.append(at)
                sizes["main"] += size
            todo.append((kids[sig], at, in_main or main))
    if articles and sizes["article"] >= 0.5 * sizes["main"]:
        return sorted(articles)
    if mains:
        return sorted(mains)
    (_, size, kids), path = top, 0
    while True:
        inner = max((k for k in kids.values() if not is_aside(k[0])), key=lambda k: (k[1], k[0]), default=None)
        if inner is None or inner[0].split(".", 1)[0] not in _AROUND or inner[1] < 0.7 * size:
            return [path]
        path = child(path, inner[0])
        _, size, kids = inner


def extract(stream: list[tuple[str, str, bool]], region: list[int]) -> str:
    """The blocks of text inside the region, joined by blank lines."""
    keep = set(region)
    titled, open_at = set(), []
    for i, (kind, value, _) in enumerate(stream):
        if kind == "+":
            open_at.append(i)
            if value.split(".", 1)[0] == "h1":
                titled.update(open_at)
        elif kind == "-":
            open_at.pop()
    blocks, block = [], []
    path = [(0, 0 in keep, False)]

    def flush() -> None:
        if block and (line := line_of(block)):
            blocks.append(line)
        block.clear()

    for i, (kind, value, _) in enumerate(stream):
        at, inside, aside = path[-1]
        if kind == "t":
            if inside and not aside:
                block.append(value)
            continue
        flush()
        if kind == "+":
            here = child(at, value) if len(path) <= DEPTH else at
            aside = aside or is_aside(value) or (is_head(value) and not (inside and i in titled))
            path.append((here, inside or here in keep, aside))
        else:
            path.pop()
    flush()
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


_WRAPPER = "host string, bucket int, shape string, chars array<long>, linked array<long>, seen array<array<long>>, pages long"
_NAMES = [f.split(" ")[0] for f in _WRAPPER.split(", ")]


class Sum:
    """What pages of one shape, or wrappers of one shape, add up to."""

    def __init__(self, chars, linked, seen, pages: int):
        self.chars, self.linked = list(chars), list(linked)
        self.seen = [frozenset(s) for s in seen]
        self.pages = pages

    def add(self, chars, linked, seen, pages: int) -> None:
        self.chars = [a + b for a, b in zip(self.chars, chars, strict=True)]
        self.linked = [a + b for a, b in zip(self.linked, linked, strict=True)]
        self.seen = [a.intersection(b) if a else a for a, b in zip(self.seen, seen, strict=True)]
        self.pages += pages

    def row(self, host: str, bucket: int, shape: str) -> tuple:
        return host, bucket, shape, self.chars, self.linked, [sorted(s) for s in self.seen], self.pages


def _shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages (host, html) summed up by shape."""
    sys.setrecursionlimit(10 * DEPTH)
    held: dict[tuple[str, str], Sum] = {}
    size = 0

    def rows() -> pd.DataFrame:
        out = [s.row(h, xxhash.xxh32_intdigest(shape) % BUCKETS[0], shape) for (h, shape), s in held.items()]
        held.clear()
        return pd.DataFrame(out, columns=_NAMES)

    for f in frames:
        for h, t in zip(f["host"], f["html"], strict=True):
            shape, chars, linked, seen = flat(skeleton(events(t or "")))
            if (h, shape) in held:
                held[h, shape].add(chars, linked, seen, 1)
            else:
                held[h, shape] = Sum(chars, linked, seen, 1)
                size += len(chars)
            if size > HELD_NODES:
                yield rows()
                size = 0
    yield rows()


def _aligned(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by ``keys`` and shape to one row for each value of ``keys``, holding one wrapper."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(10 * DEPTH)
        now, shape, same, root, pages, done = None, None, None, None, 0, []

        def close_shape() -> None:
            nonlocal root, pages
            node = tree(shape, same.chars, same.linked, same.seen)
            root = node if root is None else merge(root, node)
            pages += same.pages

        def close_key() -> None:
            nonlocal root, pages
            close_shape()
            text, chars, linked, seen = flat(root)
            done.append(Sum(chars, linked, seen, pages).row(now[0], now[1] if len(now) > 1 else 0, text))
            root, pages = None, 0

        for f in frames:
            for row in f.itertuples(index=False):
                k, values = tuple(getattr(row, c) for c in keys), (row.chars, row.linked, row.seen, row.pages)
                if now == k and shape == row.shape:
                    same.add(*values)
                    continue
                if now == k:
                    close_shape()
                elif now is not None:
                    close_key()
                now, shape, same = k, row.shape, Sum(*values)
            if done:
                yield pd.DataFrame(done, columns=_NAMES)
                done.clear()
        if now is not None:
            close_key()
            yield pd.DataFrame(done, columns=_NAMES)

    return run


def infer(pages: DataFrame, host: str, html: str) -> DataFrame:
    """One row per host: host, pages, expression, region (JSON list of paths)."""
    shapes = small_batches(pages).select(F.col(f"`{host}`").alias("host"), F.col(f"`{html}`").alias("html")).mapInPandas(_shapes, _WRAPPER)
    for buckets, keys in ((BUCKETS[0], ["host", "bucket"]), (BUCKETS[1], ["host", "bucket"]), (1, ["host"])):
        shapes = shapes.withColumn("bucket", (F.col("bucket") % buckets).cast("int"))
        shapes = shapes.repartition(*keys).sortWithinPartitions(*keys, "shape").mapInPandas(_aligned(keys), _WRAPPER)

    def make():
        sys.setrecursionlimit(10 * DEPTH)

        def work(shape, chars, linked, seen):
            for s, c, k, t in zip(shape, chars, linked, seen, strict=True):
                root = tree(s.decode(), c, k, t)
                yield expression(root), json.dumps(main_region(root))

        return work

    return map_rows(shapes, ["shape", "chars", "linked", "seen"], "expression string, region string", make, keep=["host", "pages"])


def main_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "main_text", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep``) with the main text of every page in ``out``."""
    host, region, size = (free_name(pages, c) for c in ("_host", "_region", "_pages"))
    tagged = pages.withColumn(host, host_of(F.col(f"`{url}`")))
    wrappers = written(infer(tagged, host, html), "wrappers")
    total = wrappers.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    wrappers = wrappers.select(F.col("host").alias(host), F.col("region").alias(region), F.col("pages").alias(size))
    joined = join_hot(tagged, wrappers, [host], size, total)

    def make():
        def work(texts, regions):
            for t, r in zip(texts, regions, strict=True):
                stream = events((t or b"").decode())
                text = extract(stream, json.loads(r)) if stream else ""
                yield (text or (extract(stream, main_region(skeleton(stream))) if stream else ""),)

        def deep(*lists):
            sys.setrecursionlimit(10 * DEPTH)
            return work(*lists)

        return deep

    return map_rows(joined, [html, region], f"`{out}` string", make, keep=pages.columns if keep is None else keep)
