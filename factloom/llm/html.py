"""HTML extraction by wrapper inference.

The pages of a host are aligned into one union-free regular expression, its wrapper: what all pages
have stays as it is, what some lack becomes optional, what repeats becomes a repeated group, and text
becomes a slot. All pages are then read through their host's wrapper, and each slot gets what its
texts are like: in how many pages it is, how long they are, how much of them are links, and which of
them most pages share. These figures decide which part of a page is its article: from the root down,
the element that holds most text that is neither link nor shared. Names of elements and classes only
weigh in.

A wrapper is a nested list of items [label, optional, repeated, texts, items, support]. Labels name a
tag with its class and id; ``#`` is text; ``(a|b)`` is a group of items in a row.
"""

from __future__ import annotations

import html as entities
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import durable

# Element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|title"
#: Elements whose content is no article text; one without an end tag is as if its tag were not there.
SKIPPED = frozenset("select svg object canvas audio video button".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics annotation".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | MATH
DROPPED_TAGS = frozenset("nav footer aside form head dialog menu fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in a class or id that mark what is not the article.
DROPPED_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar aside widget cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments reply replies respond disqus pagination pager toolbar skip hidden masthead topbar form search".split()
)
#: Those of them that mark what readers write, which no figure of a host's pages tells from an article.
READER_WORDS = frozenset("comment comments reply replies respond disqus".split())
MAIN_WORDS = frozenset("article content post entry story main body text".split())
#: Elements that a start tag ends, unless one of the second kind is open inside them.
CLOSES = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (a.split(), b.split()) for k, (a, b) in CLOSES.items()}
#: Elements that may hold the article with other things beside them.
CONTAINERS = frozenset("html body div section article main center table tbody tr td span font".split())

_RAW_NAMES = frozenset(RAW.split("|"))
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in _RAW_NAMES}
#: A whole tag without a mark of its own kind in it; anything else is read step by step.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*+)((?:[^<>"']++|"[^"<>]*+"(?=[\s/>]))*+)>""")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""(?<![^\s/"'])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _label(tag: str, attributes: str) -> str:
    """The tag with its class, id and marks ``!hidden`` and ``!main``; digits of names are left out."""
    if "=" not in attributes and "hidden" not in attributes:
        return tag
    parts, marks = [tag], []
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "class" and value:
            parts.append("." + " ".join(re.sub(r"[0-9]+", "", value).split()))
        elif name == "id" and value:
            parts.append("#" + re.sub(r"[0-9]+", "", value))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            marks.append("!hidden")
        elif name == "role" and value == "main" or name == "itemprop" and value == "articlebody":
            marks.append("!main")
        elif name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog"):
            marks.append("!hidden")
    return "".join(parts + sorted(set(marks)))


def _tag_end(text: str, at: int, lost: set[str]) -> int:
    """Where the tag that is open at ``at`` has its ``>``; -1 if nowhere.

    A quote counts only if it is closed and a blank, ``/`` or ``>`` follows; else the tag ends at the
    next ``>``. ``lost`` holds the quotes that do not occur any more.
    """
    while True:
        m = _MARK.search(text, at)
        if m is None or m.group() == ">":
            return m.start() if m else -1
        q, at = m.group(), m.start() + 1
        close = -1 if q in lost else text.find(q, at)
        if close < 0:
            lost.add(q)
        if close < 0 or not (text[close + 1 : close + 2] in "/>" or text[close + 1].isspace()):
            return text.find(">", at)
        at = close + 1


def parse(text: str) -> list:
    """A page as nested elements [label, children]; text is ["#", block number, raw text, whether it is a link].

    End tags that may be left out are implied, stray ones are ignored. Inline elements without a name of their own are
    transparent. Texts of one block number belong to one block. Time is linear in the page: open
    elements are found by their tag, and nothing is searched for again once it is known to be absent.
    """
    root: list = ["", []]
    stack, tags, block, pos, gap = [root], [""], 0, 0, False
    where: dict[str, list[int]] = {}  # places of open elements by tag
    blocks: list[int] = []  # places of open elements that are not inline
    skips: list[int] = []  # the block number at each open element of SKIPPED
    link = 0  # how deep the open link lies, 0 without one
    lost: set[str] = set()

    def add(raw: str) -> None:
        nonlocal gap
        if raw.isspace() or not raw:
            gap = gap or bool(raw)
            return
        stack[-1][1].append(["#", block, " " + raw if gap else raw, link > 0])
        gap = False

    def push(tag: str, label: str, inline: bool) -> None:
        where.setdefault(tag, []).append(len(tags))
        if not inline:
            blocks.append(len(tags))
        node = [label, []]
        stack[-1][1].append(node)
        stack.append(node)
        tags.append(tag)

    def pop_to(k: int, ended: bool = False) -> None:
        nonlocal block, link
        for i in range(len(tags) - 1, k - 1, -1):
            where[tags[i]].pop()
            if blocks and blocks[-1] == i:
                blocks.pop()
            if tags[i] in SKIPPED:
                before = skips.pop()
                if ended and i == k:
                    block = before
                    stack[i - 1][1].pop()
                else:
                    stack[i][0] = ""  # as if its tag were not there
        del stack[k:], tags[k:]
        link = link if link <= len(tags) else 0

    def last(names: list[str]) -> int:
        return max((where[t][-1] for t in names if where.get(t)), default=0)

    n = len(text)
    while pos < n:
        at = text.find("<", pos)
        if at < 0:
            break
        m = _PLAIN_TAG.match(text, at)
        if m:
            end, ending, tag, attributes = m.end(), m[1], m[2].lower(), m[3]
        elif text.startswith(("<!", "<?"), at):
            add(text[pos:at])
            if text.startswith("<!--", at):
                end = at + 5 if text.startswith("<!-->", at) else text.find("-->", at + 4) + 3
                pos = end if end > 2 else n
                continue
            end = text.find(">", at)
            if end < 0:
                pos = at
                break
            pos = end + 1
            continue
        else:
            m = _TAG_NAME.match(text, at)
            if m is None:
                add(text[pos : at + 1])
                pos = at + 1
                continue
            end = _tag_end(text, m.end(), lost)
            if end < 0:
                break
            ending, tag, attributes = m[1], m[2].lower(), text[m.end() : end]
            end += 1
        if at > pos:
            add(text[pos:at])
        pos = end
        if tag in _RAW_NAMES:
            if not ending:
                close = _RAW_END[tag].search(text, pos)
                pos = close.end() if close else n
                block += 1
            continue
        inline = tag in INLINE or tag in SKIPPED
        if not inline:
            block += tag != "br"
            gap = gap or tag == "br"
        if tag in VOID:
            continue
        if tag == "a":
            link = 0 if ending else len(tags)
        if ending:
            k = where[tag][-1] if where.get(tag) else 0
            if k and not (tag in INLINE and blocks and blocks[-1] > k):
                pop_to(k, True)
            continue
        if attributes.endswith("/") and (tag == "svg" or tag in MATH or where.get("svg")):
            continue
        if tag in SKIPPED:
            push(tag, tag, True)
            skips.append(block)
            continue
        label = _label(tag, attributes)
        if inline and label == tag:
            continue
        if not inline:
            if blocks and tags[blocks[-1]] == "p":
                pop_to(blocks[-1])
            if tag in CLOSES:
                closed, scope = CLOSES[tag]
                k = last(closed)
                if k and k > last(scope):
                    pop_to(k)
        push(tag, label, inline)
        if tag == "a":
            link = len(tags)
    if pos < n:
        add(text[pos:])
    pop_to(1)
    return root[1]


def _flat(children: list) -> list:
    """``children``, those of elements whose tag counts as absent in their place."""
    if all(c[0] for c in children):
        return children
    out, todo = [], list(reversed(children))
    while todo:
        node = todo.pop()
        if node[0]:
            out.append(node)
        else:
            todo += reversed(node[1])
    return out


def _deep() -> None:
    """Elements may be nested by the thousand; frames of Python functions lie on the heap."""
    if sys.getrecursionlimit() < 1_000_000:
        sys.setrecursionlimit(1_000_000)


def fold(children: list) -> list:
    """Items of a page's elements, runs and rows of two to four labels that repeat made one item each."""
    items: list = []
    run: list = []
    for node in _flat(children):
        item = ["#", False, False, [node], [], 1] if node[0] == "#" else [node[0], False, False, [], fold(node[1]), 1]
        if run and run[0][0] != item[0]:
            items.append(_all(run))
            run = []
        run.append(item)
    if run:
        items.append(_all(run))
    for period in (2, 3, 4):
        if len(items) < 2 * period:
            break
        names, out, i = [x[0] for x in items], [], 0
        while i < len(items):
            row = names[i : i + period]
            end = i + period
            if row == names[end : end + period] and not any(x[0] == "(" for x in row):
                while names[end : end + period] == row:
                    end += period
                group = [_all(items[i + k : end : period]) for k in range(period)]
                for x in group:
                    x[2] = x[2] and x[0] == "#"
                out.append([f"({'|'.join(row)})", False, True, [], group, 1])
                i = end
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _all(items: list) -> list:
    """One item for a run of items of one label, merged two by two; its support is one page's."""
    repeated, items = len(items) > 1, list(items)
    while len(items) > 1:
        items = [merge_item(*items[k : k + 2]) if k + 1 < len(items) else items[k] for k in range(0, len(items), 2)]
    items[0][2] = repeated or items[0][2]
    items[0][5] = 1
    return items[0]


def merge_item(a: list, b: list) -> list:
    """The item that covers both; they have the same label."""
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] + b[3], merge(a[4], b[4]), a[5] + b[5]]


def _grouped(items: list, groups: dict[str, list]) -> list:
    """``items`` with rows that another side knows as a group made that group."""
    names, out, i = [x[0] for x in items], [], 0
    known: dict[str, list] = {}
    for label, row in groups.items():
        known.setdefault(row[0][0], []).append((label, [x[0] for x in row]))
    while i < len(items):
        for label, row in known.get(names[i], ()):
            if names[i : i + len(row)] == row:
                out.append([label, False, False, [], items[i : i + len(row)], items[i][5]])
                i += len(row)
                break
        else:
            out.append(items[i])
            i += 1
    return out


def merge(a: list, b: list) -> list:
    """The least row of items that covers both: aligned items merge, the others become optional."""
    x, y = [v[0] for v in a], [v[0] for v in b]
    if x == y:
        return [merge_item(v, w) for v, w in zip(a, b, strict=True)]
    groups = {v[0]: v[4] for v in (*a, *b) if v[0][0] == "("}
    if groups:
        a, b = _grouped(a, groups), _grouped(b, groups)
        x, y = [v[0] for v in a], [v[0] for v in b]
    out, i, j = [], 0, 0
    for p, q in [*_aligned(x, y), (len(a), len(b))]:
        out += [[v[0], True, *v[2:]] for v in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(merge_item(a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def _aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with the same label, rising on both sides, as many as there are.

    The k-th of a label on one side can only meet the k-th on the other, so the most pairs are a
    longest rising subsequence, found in n log n steps.
    """
    places: dict[tuple[str, int], int] = {}
    seen: dict[str, int] = {}
    for j, label in enumerate(b):
        places[label, seen.setdefault(label, 0)] = j
        seen[label] += 1
    seen = {}
    pairs = []
    for i, label in enumerate(a):
        j = places.get((label, seen.setdefault(label, 0)))
        seen[label] += 1
        if j is not None:
            pairs.append((i, j))
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[k] = ends[at - 1] if at else -1
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def written(items: list) -> str:
    """A wrapper as text, an item a line: depth, marks, support and label."""
    lines, todo = [], [(x, 0) for x in reversed(items)]
    while todo:
        x, depth = todo.pop()
        lines.append(f"{depth} {'?' * x[1]}{'+' * x[2]}. {x[5]} {x[0]}")
        todo += [(y, depth + 1) for y in reversed(x[4])]
    return "\n".join(lines)


def read_wrapper(text: str) -> list:
    """Back from ``written``."""
    root: list = [None, None, None, None, []]
    open_items = [root]
    for line in text.split("\n") if text else []:
        depth, marks, support, label = line.split(" ", 3)
        item = [label, "?" in marks, "+" in marks, [], [], int(support)]
        del open_items[int(depth) + 1 :]
        open_items[-1][4].append(item)
        open_items.append(item)
    return root[4]


def pruned(items: list, least: float) -> list:
    """``items`` without those that fewer than ``least`` of the merged structures have."""
    for x in items:
        x[4] = pruned(x[4], least)
    return [x for x in items if x[5] >= least]


def merge_all(texts: list[str], rare: float = 0.001) -> str:
    """One wrapper for the written ones, merged in the order of their hashes, two by two.

    Items that fewer than ``rare`` of the structures have are left out of the wrapper (never of a
    text), so that odd pages do not let it grow without end.
    """
    _deep()
    parts = [read_wrapper(t) for t in sorted(texts, key=lambda t: (xxhash.xxh64_intdigest(t), t))]
    most = sum(max((x[5] for x in p), default=1) for p in parts)
    while len(parts) > 1:
        parts = [merge(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return written(pruned(parts[0], rare * most))


_WORDS = re.compile(r"[a-z]+")
_KINDS: dict[str, tuple[str, int, bool]] = {}


def kind(label: str) -> tuple[str, int, bool]:
    """(tag, how sure its name says that it is no article, main) of a label.

    3: a tag of that meaning, a hidden element, or a class or id that is such a word; 2: a word of ``READER_WORDS`` as a
    part of one, or a form; 1: another such word as a part of one (``share-bar``, but also ``share-price``); 0: nothing. Classes for
    screen sizes (``md:hidden``) say nothing.
    """
    got = _KINDS.get(label)
    if got is None:
        tag = re.split(r"[.#!]", label, maxsplit=1)[0]
        tokens = [t for t in re.split(r"[.#!\s]+", label[len(tag) :]) if ":" not in t]
        words = {w for t in tokens for w in _WORDS.findall(t)}
        if tag in DROPPED_TAGS and tag != "form" or "!hidden" in label or any(t.strip("-_") in DROPPED_WORDS for t in tokens):
            sure = 3
        elif tag == "form" or words & READER_WORDS:
            sure = 2
        else:
            sure = int(bool(words & DROPPED_WORDS))
        main = tag in ("article", "main") or "!main" in label or bool(words & MAIN_WORDS) and tag in ("div", "section")
        got = _KINDS[label] = (tag, sure, main)
        if len(_KINDS) > 100_000:
            _KINDS.clear()
    return got


class Wrapper:
    """A host's wrapper with the figures of its text slots, numbered in its order of items."""

    def __init__(self, text: str, figures: list[tuple] = (), names: bool = True):
        _deep()
        self.names = names
        self.figures = {f[0]: f[1:] for f in figures}  # slot -> pages, characters, of them links, of them shared, shared texts' hashes
        self.shared = {k: frozenset(f[4]) for k, f in self.figures.items()}
        self.pages = max((f[0] for f in self.figures.values()), default=0)
        self.items = read_wrapper(text)
        self.index: dict[int, tuple[dict, dict]] = {}
        self.count = 0
        self._number(self.items)

    def _number(self, items: list) -> None:
        places: dict[str, list[int]] = {}
        for k, x in enumerate(items):
            places.setdefault(x[0], []).append(k)
            x[3] = self.count
            self.count += 1
            self._number(x[4])
        self.index[id(items)] = (places, {x[0]: x[4] for x in items if x[0][0] == "("})

    def placed(self, items: list, known: list) -> list:
        """The page's items as [label, slot, texts, items, repeated], each matched with the wrapper's next item of its label; slot -1 where it has none."""
        places, groups = self.index.get(id(known), ({}, {}))
        if groups and [x[0] for x in items] != [x[0] for x in known]:
            items = _grouped(items, groups)
        out, at = [], 0
        for item in items:
            spots = places.get(item[0], ())
            k = bisect_left(spots, at)
            slot, below = -1, []
            if k < len(spots):
                at = spots[k] + 1
                slot, below = known[spots[k]][3], known[spots[k]][4]
            if item[0][0] == "(":
                out += self.placed(item[4], below)
            else:
                out.append([item[0], slot, item[3], self.placed(item[4], below), item[2]])
        return out

    def texts(self, page: list) -> Iterator[tuple[int, list]]:
        """(slot, texts) of all text slots of a parsed page."""
        todo = self.placed(fold(page), self.items)
        while todo:
            label, slot, leaves, kids, _ = todo.pop()
            if label == "#":
                yield slot, leaves
            todo += kids

    def _weigh(self, items: list) -> tuple[float, float, float]:
        """Appends to each item how many of its characters are its own text, how many are links, and how many there are; returns their sums.

        They are the means of the host's pages that have the slot, so that a page of little text is
        judged by what its slots hold elsewhere.
        """
        sums = (0.0, 0.0, 0.0)
        for x in items:
            if x[0] == "#":
                n, chars, links, shared, _ = self.figures.get(x[1]) or (1, sum(len(t[2].strip()) for t in x[2]), sum(len(t[2].strip()) for t in x[2] if t[3]), 0, ())
                got = (max(0, chars - links - shared) / n, links / n, chars / n)
            else:
                got = self._weigh(x[3])
            x += got
            sums = tuple(a + b for a, b in zip(sums, got, strict=True))
        return sums

    def _gone(self, x: list, whole: float) -> bool:
        """Whether an item is no article by its name, on a page of ``whole`` characters of own text.

        What is named so in part only stays if it has over half of that. Otherwise it goes, but for words that say
        little where the figures of four pages or more say that most of it is neither shared nor links.
        """
        sure = kind(x[0])[1] if self.names and x[0] != "#" else 0
        if sure in (0, 3):
            return sure == 3
        return 2 * x[5] <= whole and (sure == 2 or self.pages < 4 or 2 * x[5] <= x[7])

    def _rank(self, x: list, gone: bool) -> int:
        """3 for an article, 2 for a main element, 1 for one named like it."""
        tag, _, main = kind(x[0])
        if not self.names or not main or gone:
            return 0
        return 3 if tag == "article" else 2 if tag == "main" or "!main" in x[0] else 1

    def read(self, page: list) -> list:
        """The page's texts that belong to the article, in page order.

        From the root down, the element with most own text is entered while it has over 0.6 of what
        lies beside it; names weigh 2 to 8 times more or 16 times less, but those that may mean
        something else only as ``_gone`` says. Headings before an element that only
        its text speaks for are kept. Inside, what most of the host's pages share goes (but from an
        article or main element), and so do lists of links and what names say is no article.
        """
        items = self.placed(fold(page), self.items)
        whole = self._weigh(items)[0]
        out: list = []
        here = ["", -1, [], items, False]
        rank = 0
        while True:
            best, most, total = None, 0.0, 0.0
            for x in here[3]:
                tag, gone = kind(x[0])[0] if x[0] != "#" else "#", self._gone(x, whole)
                r = self._rank(x, gone)
                weight = x[5] * (1 / 16 if gone or self.names and tag == "header" else 2**r)
                total += weight
                if weight > most and (tag in CONTAINERS or tag == "form") and not gone and (r >= rank if rank else True) and (r or not rank):
                    best, most, best_rank = x, weight, r
            if best is None or most < 0.6 * total:
                break
            if not best_rank:
                for x in here[3]:
                    if x is best:
                        break
                    if kind(x[0])[0] in HEADINGS:
                        self._gather([x], whole, False, False, out)
            here, rank = best, max(rank, best_rank)
        self._gather(here[3], whole, False, False, out)
        # a block goes only if all of it is shared, and none does from what is marked as the article
        own = {t[1] for t, shared in out if not shared or rank >= 2}
        return sorted((t for t, _ in out if t[1] in own), key=lambda t: t[1])

    def _gather(self, items: list, whole: float, header: bool, heading: bool, out: list) -> None:
        for x in items:
            label, slot, leaves, kids, repeated, own, link, _ = x
            if label == "#":
                if not header or heading:
                    shared = self.shared.get(slot, ())
                    out += [(t, bool(shared) and text_hash(text) in shared) for text, parts in blocks_of(leaves) for t in parts]
                continue
            tag = kind(label)[0]
            if self._gone(x, whole) or repeated and link > 4 * own and tag in ("li", "div", "p", "tr", "td", "ul", "ol"):
                continue
            if tag in ("ul", "ol") and link > 4 * own and any(k[4] for k in kids):
                continue
            self._gather(kids, whole, header or self.names and tag == "header", heading or tag in HEADINGS, out)


def blocks_of(leaves: list) -> Iterator[tuple[str, list]]:
    """(text, its parts) of each block among a slot's texts."""
    for _, parts in groupby(leaves, key=lambda t: t[1]):
        parts = list(parts)
        yield "".join(t[2] for t in parts), parts


def text_hash(raw: str) -> int:
    """A signed hash of a text without the white space around it."""
    h = xxhash.xxh64_intdigest(raw.strip().encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def article(texts: list) -> str:
    """Blocks of texts, one a line: references decoded, white space made one space, empty ones left out."""
    blocks: dict[int, list[str]] = {}
    for _, block, raw, _ in texts:
        blocks.setdefault(block, []).append(raw)
    lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def structures(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the distinct structures of the pages of each host, without their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        made: set[tuple[str, str]] = set()
        out = lambda: pa.RecordBatch.from_pydict({"host": [h for h, _ in made], "wrapper": [w for _, w in made]}, pa.schema([("host", pa.string()), ("wrapper", pa.string())]))
        for batch in batches:
            for name, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made.add((name, written(fold(parse(cell.as_py())))))
            if len(made) > 2000:
                yield out()
                made.clear()
        yield out()

    return pages.mapInArrow(run, "host string, wrapper string").distinct()


def infer(pages: DataFrame, fan: int = 32) -> DataFrame:
    """(host, wrapper): one wrapper a host over the structures of all its pages (host, html).

    About ``fan`` structures of a host are merged at a time, dealt by their hashes, then what came
    out, until one is left. So no task has all of a host's, and the result doesn't depend on how the pages lie.
    """

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": pdf.host.iloc[:1], "wrapper": [merge_all(sorted(set(pdf.wrapper)))]})

    parts = durable(structures(pages))
    while True:
        counts = parts.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("_n"))
        if (counts.agg(F.max("_n")).first()[0] or 0) <= 1:
            return parts
        groups = F.ceil(F.col("_n") / fan)
        dealt = parts.join(counts, F.col("host") == F.col("_host")).withColumn("_g", F.pmod(F.xxhash64("wrapper"), groups))
        parts = durable(dealt.groupBy("host", "_g").applyInPandas(join, "host string, wrapper string"))


def figures(rows: DataFrame) -> DataFrame:
    """(host, slots) of ``rows(host, html, wrapper)``: an array (slot, pages, chars, links, shared, hashes) of each host.

    A text is shared if it is in the same slot of at least half of the pages that have the slot and
    of three pages more: c >= (n + 3) / 2, so a few pages that agree do not make a text the host's. Equal pages count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            out: list[tuple] = []
            for name, cell, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if w not in known:
                    if len(known) > 100:
                        known.clear()
                    known[w] = Wrapper(w)
                page = cell.as_py()
                mark, seen = text_hash(page), {}
                for slot, leaves in known[w].texts(parse(page)):
                    if slot < 0:
                        continue
                    seen.setdefault((slot, None), [0, 0])
                    for whole, parts in blocks_of(leaves):
                        got = seen.setdefault((slot, text_hash(whole)), [0, 0])
                        got[0] += sum(len(t[2].strip()) for t in parts)
                        got[1] += sum(len(t[2].strip()) for t in parts if t[3])
                out += [(name, slot, h, mark, chars, links) for (slot, h), (chars, links) in seen.items()]
            cols = zip(*out, strict=True) if out else [[]] * 6
            kinds = [pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "slot", "hash", "page", "chars", "links"])

    each = rows.mapInArrow(run, "host string, slot long, hash long, page long, chars long, links long").dropDuplicates(["host", "slot", "hash", "page"])
    texts = durable(each.groupBy("host", "slot", "hash").agg(F.count("*").alias("c"), F.sum("chars").alias("chars"), F.sum("links").alias("links")))
    slots = texts.groupBy("host", "slot").agg(F.max(F.when(F.col("hash").isNull(), F.col("c"))).alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    most = slots.select(F.col("host").alias("_host"), F.col("slot").alias("_slot"), "n")
    shared = texts.where("hash is not null and c >= 3").join(most, (F.col("host") == F.col("_host")) & (F.col("slot") == F.col("_slot"))).where("2 * c >= n + 3")
    shared = shared.groupBy("_host", "_slot").agg(F.sum(F.col("chars") - F.col("links")).alias("shared"), F.sort_array(F.collect_list("hash")).alias("hashes"))
    every = slots.join(shared, (F.col("host") == F.col("_host")) & (F.col("slot") == F.col("_slot")), "left")
    one = F.struct("slot", "n", "chars", "links", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("hashes", F.array().cast("array<bigint>")).alias("hashes"))
    return every.groupBy("host").agg(F.sort_array(F.collect_list(one)).alias("slots"))


def extract(pages: DataFrame, broadcast_bytes: int = 8 << 20, names: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Three passes over the pages: their structures make a wrapper for each host, their texts the
    figures of its slots, and then each page is read. Wrappers are sent to all executors only if
    they take at most ``broadcast_bytes``, else joined by host. ``names`` false leaves the names of elements and
    classes out of account. Null html is empty, null URLs are one
    host, repeated rows repeat, an empty table gives no rows; other columns are ignored. The result
    does not depend on how the pages are partitioned.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))

    def side(df: DataFrame, *columns: str) -> DataFrame:
        size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*columns))))).first()[0] or 0
        return F.broadcast(df) if size <= broadcast_bytes else df

    wrappers = durable(infer(rows.select("host", "html"))).select(F.col("host").alias("_host"), "wrapper")
    through = rows.join(side(wrappers, "wrapper"), F.col("host") == F.col("_host"))
    slots = durable(figures(through.select("host", "html", "wrapper"))).select(F.col("host").alias("_of"), "slots")
    whole = durable(wrappers.join(slots, F.col("_host") == F.col("_of"), "left").select("_host", "wrapper", "slots"))
    joined = rows.join(side(whole, "wrapper", "slots"), F.col("host") == F.col("_host")).select("page_id", "url", "html", "wrapper", "slots")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for cell, w, figure in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                w = w.as_py()
                if w not in known:
                    if len(known) > 100:
                        known.clear()
                    known[w] = Wrapper(w, [tuple(f.values()) for f in figure.as_py() or ()], names)
                texts.append(article(known[w].read(parse(cell.as_py()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")
