"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of one host's pages."""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging

#: A comment, a tag (slash, name, attributes), another declaration, a run of text, or a lone sign. Nothing is tried twice, so the time is
#: linear: what never ends runs to the end of the page, and a quote opens a value only after an equals sign.
TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*+)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<""", re.S)
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
# Elements of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr link meta param source track".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in "script style noscript template svg iframe textarea select noembed noframes xmp".split()}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A paragraph ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IN_HEAD = frozenset("title meta link base".split())
#: Blocks of text, which are never the whole of an article.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr th blockquote pre address figcaption caption summary legend".split())
DROPPED = frozenset("head nav aside footer form button dialog menu object audio video canvas map title".split())
#: Names that speak for or against a part. They weigh slots (MAIN_WEIGHT, AROUND_WEIGHT); the choice of the main part is the wrapper's.
AROUND = frozenset("ad ads adv advert adverts advertisement advertising adsense alert aside banner breadcrumb breadcrumbs captcha comment comments commentlist consent contentinfo complementary cookie cookies dialog discussion disqus foot footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion promoted rail recommended recommendations register related replies reply respond search share sharebar sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar trending widget widgets".split())
#: Parts of names that say the same wherever they stand.
STEMS = re.compile("sidebar|navbar|navigation|cookie|advert|comments|footer|newsletter|breadcrumb|banner|popup|subscribe|sponsor|masthead|(?:nav|menu)$")
#: Of these, what readers wrote: an article in it is no main part.
READERS = frozenset("comment comments commentlist discussion disqus replies reply respond related recommended recommendations".split())
HEAD = frozenset("header hdr head siteheader pageheader topheader".split())
MAIN = frozenset("article main".split())
MAIN_WEIGHT, AROUND_WEIGHT = 4.0, 0.1
#: A part is descended into while it holds this share of the text.
MOST = 0.6
#: Elements nested deeper are taken as text of the one at this depth.
DEPTH = 150
#: Parts of a wrapper; beyond, those seen on the fewest pages become text of what they stand in.
SIZE = 20_000
#: Wrappers that one task merges.
FAN = 32
NOWHERE = 1 << 60


@lru_cache(50_000)
def signature(tag: str, attrs: str) -> str:
    """A tag with its class, id and role; digits are left out, as they number things."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs)}
    parts = [f"{k[0]}={re.sub(r'[0-9]+', '', v).strip().lower()}" for k, v in sorted(found.items()) if v.strip()]
    return " ".join([tag, *parts])


@lru_cache(50_000)
def kind(sig: str) -> str:
    """main, readers, around, head (a header, to be kept inside an article) or empty, by the names in a signature."""
    tag, _, rest = sig.partition(" ")
    if tag == "()":
        return ""
    names = {w for v in re.findall(r"\w=([^=]*)(?= \w=|$)", rest) for w in re.split(r"[^a-z]+", v)}
    around = bool(names & AROUND or any(map(STEMS.search, names)))
    if (tag in MAIN and not around) or ("main" in names and "r=main" in rest):
        return "main"
    if names & READERS:
        return "readers"
    if tag in DROPPED or around:
        return "around"
    if tag == "header" or (names & HEAD and not names & {"article", "entry", "post", "story", "content", "title"}):
        return "head"
    return ""


def tokens(page: str) -> Iterator[tuple[str, str, int]]:
    """The token stream of a page: ("<", signature, 0), (">", "", 0) and ("#", text, characters in links), always balanced.

    Comments, scripts and styles are gone; inline elements are part of the text; character references are decoded, white space is
    single. html and body are left out, as many pages lack them. Elements deeper than DEPTH leave no tokens, their texts do."""
    stack: list[str] = []
    text: list[str] = []
    deeper = links = in_link = at = 0
    size, match = len(page), TOKEN.match

    def flush() -> list[tuple[str, str, int]]:
        nonlocal links
        if not text:
            return []
        t, n = " ".join(html.unescape("".join(text)).split()), links
        text.clear()
        links = 0
        return [("#", t, n)] if t else []

    while at < size:
        m = match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                text.append(t)
                if in_link:
                    links += len(t.strip())
            continue
        tag, close = tag.lower(), m[1]
        if tag == "a":
            in_link = 0 if close else 1
        if tag in INLINE:
            continue
        if not close and tag in RAW:
            text.append(" ")
            if tag != "svg" or not m[3].endswith("/"):
                end = RAW[tag].search(page, at)
                at = end.end() if end else size
            continue
        yield from flush()
        if tag in VOID or tag == "html":
            continue
        if close:
            if tag == "body":
                continue
            if deeper:
                deeper -= 1
            elif tag in stack:
                while stack.pop() != tag:
                    yield (">", "", 0)
                yield (">", "", 0)
            continue
        if not deeper and stack:
            if stack[-1] == "head" and tag not in IN_HEAD:
                stack.pop()
                yield (">", "", 0)
            if tag in ENDS_P and stack and stack[-1] == "p":
                stack.pop()
                yield (">", "", 0)
            shut = CLOSES.get(tag, ())
            while stack and stack[-1] in shut:
                stack.pop()
                yield (">", "", 0)
        if tag == "body":
            continue
        if len(stack) >= DEPTH:
            deeper += 1
            continue
        stack.append(tag)
        yield ("<", signature(tag, m[3]), 0)
    yield from flush()
    for _ in stack:
        yield (">", "", 0)


def tree(stream: Iterator[tuple[str, str, int]]) -> list:
    """The stream with each balanced part as [signature, children]; a text is ("#", text, characters in links)."""
    root: list = ["", []]
    path = [root]
    for t in stream:
        if t[0] == "#":
            path[-1][1].append(t)
        elif t[0] == "<":
            node = [t[1], []]
            path[-1][1].append(node)
            path.append(node)
        else:
            path.pop()
    return root


# A wrapper is a union-free regular expression over tokens. A part is a list [signature, optional, repeated, pages, parts]; a group of
# several parts has the signature "()" with theirs; a text is ["#", optional, repeated, pages, [hash, characters, link characters, seen]], with the
# hash of a fixed text and up to three hashes of different pages that have it, or None and nothing for a slot.


def _text(a: list, b: list) -> list:
    x, y = a[4], b[4]
    same = x[0] is not None and x[0] == y[0]
    return ["#", a[1] or b[1], a[2] or b[2], a[3] + b[3], [x[0] if same else None, x[1] + y[1], x[2] + y[2], sorted({*x[3], *y[3]})[:3] if same else []]]


def _squares(parts: list) -> list:
    """Runs in which the same signatures return in the same order become repeated groups: of one part, or of several."""
    out: list = []
    for c in parts:
        if out and out[-1][0] == c[0]:
            n = out[-1][3]
            out[-1] = merge(out[-1], c)
            out[-1][2], out[-1][3] = True, max(n, c[3])
        else:
            out.append(c)
    parts, out, last, i = out, [], {}, 0
    # how far back each signature was last; a run of one distance, as long as that distance, is a square
    back = []
    for k, c in enumerate(parts):
        back.append(k - last[c[0]] if c[0] in last else 0)
        last[c[0]] = k
    while i < len(parts):
        p = back[i]
        end = i
        while p > 1 and end < len(parts) and back[end] == p:
            end += 1
        if p > 1 and end - i >= p and len(out) >= p and all(x is y for x, y in zip(out[-p:], parts[i - p : i])):
            times = (end - i) // p
            body = out[-p:]
            for r in range(times):
                body = [merge(x, y) for x, y in zip(body, parts[i + r * p : i + (r + 1) * p])]
            n = max(c[3] for c in parts[i - p : i + times * p])
            for c in body:
                c[3] = min(c[3], n)
            out[-p:] = [["() " + " ".join(c[0] for c in body), False, True, n, body]]
            i += times * p
        else:
            out.append(parts[i])
            i += 1
    return out


def align(x: list, y: list) -> list:
    """One expression for two sequences of parts. At a mismatch, another copy of what stands before makes a repeated group; a copy of a
    group's parts joins the group; else what one side has before the other's next part comes is optional."""
    out: list = []
    i, j, n, m = 0, 0, len(x), len(y)
    places: list[dict[str, list[int]]] = []

    def ahead(side: int, sig: str, start: int) -> int:
        """Where a signature stands next."""
        if not places:
            for s in (x, y):
                at: dict[str, list[int]] = {}
                for k, c in enumerate(s):
                    at.setdefault(c[0], []).append(k)
                places.append(at)
        found = places[side].get(sig, ())
        k = bisect_left(found, start)
        return found[k] if k < len(found) else NOWHERE

    def again(c: list) -> None:
        pages = max(out[-1][3], c[3])
        out[-1] = merge(out[-1], c)
        out[-1][2], out[-1][3] = True, pages

    def copy_of(group: list, s: list, at: int) -> list | None:
        """The parts of s from a place on as one copy of a group."""
        size = len(group[4])
        if group[0].startswith("()") and [c[0] for c in s[at : at + size]] == [c[0] for c in group[4]]:
            return [group[0], False, False, max(c[3] for c in s[at : at + size]), s[at : at + size]]
        return None

    while i < n and j < m:
        if x[i][0] == y[j][0]:
            out.append(merge(x[i], y[j]))
            i, j = i + 1, j + 1
        elif out and y[j][0] == out[-1][0]:
            again(y[j])
            j += 1
        elif out and x[i][0] == out[-1][0]:
            again(x[i])
            i += 1
        elif (c := copy_of(x[i], y, j)) is not None:
            out.append(merge(x[i], c))
            i, j = i + 1, j + len(c[4])
        elif (c := copy_of(y[j], x, i)) is not None:
            out.append(merge(c, y[j]))
            i, j = i + len(c[4]), j + 1
        else:
            a, b = ahead(1, x[i][0], j), ahead(0, y[j][0], i)
            if a == b == NOWHERE:
                out += [merge(x[i], y[j])] if _renamed(x[i][0], y[j][0]) else [[c[0], True, *c[2:]] for c in (x[i], y[j])]
                i, j = i + 1, j + 1
            elif a - j <= b - i:
                out += [[c[0], True, *c[2:]] for c in y[j:a]]
                j = a
            else:
                out += [[c[0], True, *c[2:]] for c in x[i:b]]
                i = b
    return _squares(out + [[c[0], True, *c[2:]] for c in (*x[i:], *y[j:])])


def _renamed(a: str, b: str) -> bool:
    """Whether two signatures may be one element whose name differs from page to page."""
    tag = a.partition(" ")[0]
    return tag not in ("#", "()") and tag == b.partition(" ")[0] and not kind(a) and not kind(b)


def merge(a: list, b: list) -> list:
    """One expression for two parts of one signature (or of one tag)."""
    if a[0] == "#":
        return _text(a, b)
    x, y = a[4], b[4]
    same = len(x) == len(y) and all(p[0] == q[0] for p, q in zip(x, y))
    parts = [merge(p, q) for p, q in zip(x, y)] if same else align(x, y)
    return [a[0] if a[0] == b[0] else a[0].partition(" ")[0], a[1] or b[1], a[2] or b[2], a[3] + b[3], parts]


def page_wrapper(root: list, page: int) -> list:
    """The expression of one page (known by a hash): its tokens, with squares as repeated groups."""
    if root[0] == "#":
        return ["#", False, False, 1, [crc32(root[1].encode("utf-8", "replace")), len(root[1]), root[2], [page]]]
    return [root[0], False, False, 1, _squares([page_wrapper(c, page) for c in root[1]])]


def bounded(w: list, most: int = SIZE) -> list:
    """A wrapper of at most about `most` parts: what was seen on the fewest pages becomes a slot of what it stands in."""

    def count(n: list) -> int:
        return 1 if n[0] == "#" else 1 + sum(map(count, n[4]))

    def mass(n: list) -> tuple[int, int]:
        if n[0] == "#":
            return n[4][1], n[4][2]
        got = [mass(c) for c in n[4]]
        return sum(g[0] for g in got), sum(g[1] for g in got)

    def cut(n: list, least: int) -> list:
        if n[0] == "#":
            return n
        keep, gone = [cut(c, least) for c in n[4] if c[3] > least], [mass(c) for c in n[4] if c[3] <= least]
        if gone:
            keep.append(["#", True, True, n[3], [None, sum(g[0] for g in gone), sum(g[1] for g in gone), []]])
        return [*n[:4], _squares(keep)]

    least = 1
    while count(w) > most and least < 2 * w[3]:
        w, least = cut(w, least), 2 * least
    return w


def expression(node: list) -> str:
    """A wrapper as text: tags, #PCDATA slots, fixed texts, ( )? and ( )+ groups."""
    if node[0] == "#":
        body = "#PCDATA" if node[4][0] is None else f"'{node[4][0]:08x}'"
    else:
        body = "".join(map(expression, node[4]))
        if node[0] and not node[0].startswith("()"):
            body = f"<{node[0]}>{body}</>"
    return f"({body}){'+' if node[2] else ''}{'?' if node[1] else ''}" if node[1] or node[2] else body


def rules(w: list) -> list:
    """A wrapper with its slots told apart: [signature, 1 if the parts' texts stay by default, 1 for the main part, parts], texts as ["#", 1 if it stays].

    Slots that differ between pages weigh by their characters, those in links against them; fixed texts (the same on three
    different pages and half of all) weigh nothing; names make slots heavier or lighter. The main part is found from the root on: the
    part that holds MOST of the weight, while that is no repeated group and no block of text. Of it, what is no link list, no
    fixed text and not marked as surrounding stays; in an article element links and fixed texts stay too."""
    pages = w[3]

    def fixed(n: list) -> bool:
        return n[4][0] is not None and not n[2] and len(n[4][3]) >= 3 and n[3] >= 0.5 * pages

    @lru_cache(None)
    def has_main(i: int) -> bool:
        n = parts[i]
        return n[0] != "#" and kind(n[0]) != "readers" and (kind(n[0]) == "main" or any(has_main(id(c)) for c in n[4]))

    parts: dict[int, list] = {}
    raw: dict[int, float] = {}

    def measure(n: list) -> float:
        parts[id(n)] = n
        raw[id(n)] = (0.0 if fixed(n) else max(0.0, n[4][1] - 2.0 * n[4][2])) if n[0] == "#" else sum(map(measure, n[4]))
        return raw[id(n)]

    total, any_main = measure(w), has_main(id(w))

    def role(n: list, inside: bool) -> str:
        """What a part's names make it: main, around or nothing. They don't hold against a part with the article in it or, where
        no element says that it is the article, against one with most of the text."""
        k = kind(n[0])
        if k in ("main", "readers", ""):
            return {"readers": "around"}.get(k, k)
        if (k == "head" and inside) or has_main(id(n)):
            return ""
        return "" if not any_main and n[0].partition(" ")[0] not in DROPPED and raw[id(n)] >= MOST * total > 0 else "around"

    weight: dict[int, float] = {}

    def weigh(n: list, factor: float, inside: bool) -> float:
        if n[0] == "#":
            weight[id(n)] = raw[id(n)] * factor
            return weight[id(n)]
        r = role(n, inside)
        factor = {"main": MAIN_WEIGHT if factor >= 1 else factor, "around": AROUND_WEIGHT}.get(r, factor)
        weight[id(n)] = sum(weigh(c, factor, inside or r == "main") for c in n[4])
        return weight[id(n)]

    whole = weigh(w, 1.0, False)
    main, above = w, w
    while whole > 0:
        inner = [c for c in main[4] if c[0] != "#" and weight[id(c)] >= MOST * whole]
        if not inner or inner[0][2] or inner[0][0].startswith("()") or inner[0][0].partition(" ")[0] in LEAVES:
            break
        main, above = inner[0], main
    if main is not w and above is not w and kind(main[0]) != "main" and sum(weight[id(c)] for c in main[4] if c[0] == "#") > 0.8 * weight[id(main)]:
        main = above  # one block of text in a box of its own

    def told(n: list, stays: bool, inside: bool) -> list:
        if n[0] == "#":
            return ["#", int(stays and (inside or not (fixed(n) or n[4][2] > 0.8 * n[4][1])))]
        is_main = n is main
        r = role(n, inside) if n[0] else ""
        if is_main:
            stays, inside = True, inside or r == "main"
        elif stays:
            stays, inside = r != "around", inside or r == "main"
        below = [told(c, stays, inside or r == "main") for c in n[4]]
        flat = [p for c, t in zip(n[4], below) for p in (t[3] if c[0].startswith("()") else [t])]
        return [n[0], int(stays), int(is_main), flat if stays or any(p[0] != "#" and (p[2] or p[3]) for p in flat) else []]

    return told(w, False, False)


class Rule:
    """A told wrapper, ready to be run along pages."""

    def __init__(self, told: list):
        self.sig, self.stays, self.main = told[0], bool(told[1]), len(told) > 2 and bool(told[2])
        self.parts = [Rule(p) for p in told[3]] if len(told) > 3 else []
        self.at: dict[str, list[int]] = {}
        for k, p in enumerate(self.parts):
            self.at.setdefault(p.sig, []).append(k)
        self.tags = {p.sig for p in self.parts if " " not in p.sig}

    def next(self, sig: str, cur: int) -> int:
        """The part that a page's next element is: from the current one on, else from the start, as groups repeat; -1 if there is none."""
        found = self.at.get(sig)
        if not found:
            tag = sig.partition(" ")[0]
            found = self.at[tag] if tag in self.tags else None
        if not found:
            return -1
        k = bisect_left(found, cur)
        return found[k] if k < len(found) else found[0]

    def read(self, root: list) -> tuple[list[str], bool]:
        """(the texts of a page that stay, whether it has the main part)."""
        out: list[str] = []
        seen = False

        def strange(n: list) -> None:
            """What the wrapper doesn't know, in a part that stays."""
            for c in n[1]:
                if c[0] == "#":
                    out.append(c[1])
                elif kind(c[0]) not in ("around", "readers"):
                    strange(c)

        def walk(n: list, rule: Rule) -> None:
            nonlocal seen
            seen = seen or rule.main
            if not rule.parts:
                if rule.stays:
                    strange(n)
                return
            cur = 0
            for c in n[1]:
                k = rule.next(c[0], cur)
                if k >= 0:
                    cur, p = k, rule.parts[k]
                    if c[0] != "#":
                        walk(c, p)
                    elif p.stays:
                        out.append(c[1])
                elif rule.stays:
                    if c[0] == "#":
                        out.append(c[1])
                    elif kind(c[0]) not in ("around", "readers"):
                        strange(c)

        walk(root, self)
        return out, seen


def page_hash(page: str) -> int:
    return crc32(page.encode("utf-8", "replace"))


def main_text(page: str, rule: Rule | None) -> str:
    """The texts of a page that its host's wrapper keeps, joined by a space; a page without the wrapper's main part is read by a wrapper
    of its own. No wrapper, or an empty one: no text."""
    if rule is None or not page or not (rule.parts or rule.main):
        return ""
    root = tree(tokens(page))
    kept, seen = rule.read(root)
    if not seen:
        kept, _ = Rule(rules(page_wrapper(root, 0))).read(root)
    return " ".join(kept)


class Forest:
    """Wrappers of hosts in the making. Those of as many pages are merged first, so that a wrapper that grows isn't walked for each page."""

    def __init__(self):
        self.known: dict[str, list[tuple[int, list]]] = {}

    def add(self, host: str, w: list) -> None:
        heap, size = self.known.setdefault(host, []), 1
        while heap and heap[-1][0] <= size:
            n, other = heap.pop()
            w, size = bounded(merge(other, w)), size + n
        heap.append((size, w))

    def take(self) -> Iterator[tuple[str, list]]:
        for host, heap in self.known.items():
            w = heap.pop()[1]
            while heap:
                w = bounded(merge(heap.pop()[1], w))
            yield host, w
        self.known = {}


def wrappers(stage: Staging, pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, rules): one wrapper for each host, from all its pages.

    The pages of a host are aligned within a partition; the wrappers of FAN neighbouring partitions meet in one task, then those of FAN such
    groups, and so on, so that a task gets about FAN wrappers of a host, however many pages it has."""

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, forest = TaskContext.get().partitionId(), Forest()
        packed = lambda: pd.DataFrame([(h, part, json.dumps(w)) for h, w in forest.take()], columns=["host", "part", "w"])
        for p in batches:
            for h, t in zip(p.host, p.html):
                forest.add(h, page_wrapper(tree(tokens(t)), page_hash(t)))
                if len(forest.known) > 4000:  # bounds the memory
                    yield packed()
        yield packed()

    def join(p: pd.DataFrame) -> list:
        forest = Forest()
        for t in p.w.sort_values():
            forest.add("", json.loads(t))
        return next(forest.take())[1]

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": p.host[:1], "part": p.part[:1] // FAN, "w": [json.dumps(join(p))]})

    def told(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": p.host[:1], "rules": [json.dumps(rules(join(p)))]})

    d = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    some = stage.cut(d.mapInPandas(infer, "host string, part int, w string"), "parts")
    top = some.agg(F.max("part")).first()[0] or 0
    while top >= FAN:
        some = some.groupBy("host", F.floor(F.col("part") / FAN).alias("group")).applyInPandas(meet, "host string, part int, w string")
        top //= FAN
    return some.groupBy("host").applyInPandas(told, "host string, rules string")


def host_of(url_col: str):
    """The host of an address in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#\s]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    The wrapper of a page's host is run along the page: texts in its main part stay, but for link lists, texts that are the same on three
    different pages and half of all, and parts that a tag, class, id or role marks as a menu, header, footer, sidebar, notice, advert, form or
    comments. Parts that the wrapper doesn't know go with the part they stand in. A page without the main part (another template) is
    read by a wrapper of its own.

    Null, empty and textless pages give an empty text. Pages without a host share one wrapper. Repeated rows give equal results, and
    copies of one page don't make its texts fixed. Elements nested deeper than DEPTH are read as text of the one at that depth.
    """
    stage = Staging(pages.sparkSession)
    known = stage.cut(wrappers(stage, pages, url_col, html_col), "wrappers").withColumnRenamed("host", "_host")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = lru_cache(1000)(lambda r: Rule(json.loads(r)))
        for p in batches:
            out = [main_text(t, ready(r)) if t and r else "" for t, r in zip(p.html, p.rules)]
            yield pd.DataFrame({"page_id": p.page_id, "url": p.url, "text": out, "n_chars": [len(t) for t in out]})

    d = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    d = d.join(known, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "rules")
    out = d.mapInPandas(texts, "page_id string, url string, text string, n_chars bigint")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema[id_col].dataType))
