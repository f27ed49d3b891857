"""Main-text extraction by equivalence-class template deduction.

For each host, tokens are grouped by their occurrence vectors: how often each occurs on each
page of the host. A token is a start tag with the path of the elements around it, or a block of
text with its path. Tokens that occur on enough of the host's pages, and keep their order (one
that is once on a page has the same such token before it, or after it, in its element on every
page), make a class with those of the same vector. A class is valid when it is large enough; where its tokens hang in several places
of the other classes, it is split, so that classes are nested: each lies in one slot of the
class around it. All of them are the host's template.

A page is cut into slots at its template tokens. Text that is a template token belongs to the
template; the text of the page is what is in the slots outside of boilerplate elements
(``nav``, ``footer``, forms and the like, and containers whose class or id names such a thing:
reader comments differ from page to page, so their occurrence doesn't show them). Where a name
may be that of other things too (``share``, ``widget``, ``discussion``), what is inside decides:
mostly links, a part of several blocks that is repeated, as comments are, or a few labels go;
prose and tables stay.
``article`` and ``main`` are a hint: where they hold a fair share of the page's text, only slots
in them count, and text there goes as the template's only where nearly all pages of the host
have it and more of the text is the page's own (else the host has copies of one article). On
other pages the main element is the deepest template element that holds most of the text; all
of it is kept, and of what lies beside it (titles, leads, columns) all but the template's text. Pages whose host has no usable template follow the same rules by their own
tree.

Vectors aren't gathered: a page's part of a token's vector is hashed, and the hashes are summed,
so a host with a third of all pages costs one row per task and token. Templates are broadcast
where their measured size allows it, else joined with pages dealt out in parts of bounded size.

Cases: null and empty html gives '' and 0; unclosed and stray tags are closed as browsers
do in the simple cases, in time and memory linear in the page, tags with unclosed quotes included; repeated pages count once each;
null hosts are one host; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Pages that a token must be on, at least, and its share of the host's pages.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: The same for text of an article or main element.
MAIN_PAGES, MAIN_PAGES_SHARE = 5, 0.8
#: Tokens that a class must have.
LEAST_TOKENS = 2
#: Share of the text outside of boilerplate that the main element must hold, and that an article or main element must.
MAIN_SHARE, HINT_SHARE = 0.5, 0.2
#: Template tokens that are broadcast at most; pages of one host that go to one task otherwise.
BROADCAST_TOKENS, PAGES_AT_ONCE = 1_000_000, 2_000

_NAME = re.compile(r"[a-zA-Z][^\s/><]*")
_STOP = re.compile("[>\"'<]")
_CLASS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe"}
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "header", "footer", "nav", "aside", "form", "fieldset", "head", "title"}
#: Elements that never hold main text.
_AROUND = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "title"}
_NAMES = re.compile(r"ads?|advert\w*|breadcrumbs?|comments?|cookies?|disqus|footer|masthead|modal|nav|navbar|navbox|navigation|newsletters?|notices?|popup|promo\w*|sidebar|sponsor\w*|subscribe|toolbar", re.I)
#: Names of such things or of others; what is in them decides.
_MAYBE = re.compile(r"banner|discussion|menu|popular|recommend\w*|related|respond|share|sharing|social|trending|widget", re.I)
#: What may stand beside such a name in a class or id, as in site-nav: anything else (related-work) is another word.
_BESIDE = re.compile(r"site|page|main|global|top|bottom|left|right|primary|secondary|list|box|area|bar|block|links?|buttons?|icons?|items?|form|inner|outer|wrap|wrapper|container|section|posts?|articles?|media|consent|slots?|units?|threads?|board|signup|readers?|users?|\d+", re.I)
#: In a class, these name such a thing whatever stands beside them, unless it is a state of something else.
_TELLING = re.compile(r"advert\w*|breadcrumbs?|comments?|cookies?|disqus|newsletters?|notices?|sidebar|sponsor\w*|subscribe", re.I)
_STATES = re.compile(r"no|not|has|have|with|without|is|hide|show|open", re.I)
_HEADER = re.compile(r"(?:site|page|global|top)[_-]header", re.I)
#: The elements whose class and id are looked at: not headings, paragraphs and text within lines.
_NAMED = {"div", "section", "header", "ul", "ol", "dl", "table", "details"}
#: A container of a doubtful name is such a thing if this share of its text is in links, if it repeats a part
#: of several blocks, or if it holds less text than this and no prose.
_LINKED, _LABELS = 0.4, 100
_PROSE = {"p", "blockquote", "pre", "td", "th", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}
_MAIN = {"article", "main"}
#: What a start tag closes first, up to an element that keeps it in.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


_INLINE = {"b", "i", "em", "strong", "a", "span", "u", "font", "small", "big", "code", "s"}
_LEAVES = {"p", "li", "td", "h1", "h2", "h3", "blockquote", "pre", "dd"}


@dataclass
class Page:
    """The elements in order: name, token (the hash of the path), parent (-1: none), depth and
    whether each is an article or main element; and blocks: (element, around, text) in order,
    where around tells whether the text is in an element that never holds main text."""

    names: list[str] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    mains: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, bool, str]] = field(default_factory=list)
    links: list[int] = field(default_factory=list)  # code points of each block that are in links, about
    doubtful: list[int] = field(default_factory=list)  # elements whose name may be that of an advert and the like

    def mark(self, block: tuple[int, bool, str]) -> int:
        """The token of a block of text."""
        return _hash(block[2], self.tokens[block[0]] if block[0] >= 0 else 1)


def _hash(text: str, seed: int) -> int:
    h = xxhash.xxh64_intdigest(text, seed & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


def _named(classes: str, ids: str) -> tuple[bool, bool]:
    """Whether a class or id names navigation, adverts and the like, and whether one may do so."""
    sure = maybe = False
    for k, tokens in enumerate((classes, ids)):
        for token in tokens.split():
            parts = [p for p in re.split(r"[_-]+", token) if p]
            names, doubtful = [bool(_NAMES.fullmatch(p)) for p in parts], [bool(_MAYBE.fullmatch(p)) for p in parts]
            whole = all(n or d or _BESIDE.fullmatch(p) for n, d, p in zip(names, doubtful, parts, strict=True))
            told = k == 0 and any(map(_TELLING.fullmatch, parts)) and not any(map(_STATES.fullmatch, parts))
            sure = sure or (whole and any(names)) or told or bool(_HEADER.fullmatch(token))
            maybe = maybe or (whole and any(doubtful))
    return sure, maybe


class _Open:
    """The stack of open elements: (name, element, around, innermost block element or -1)."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, int]] = []
        self.places: dict[str, list[int]] = {}  # of each name in the stack
        self.mains = 0

    def push(self, name: str, element: int, around: bool, block: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, element, around, block))
        self.mains += name in _MAIN

    def last(self, names: set[str]) -> int:
        return max((p[-1] for p in (self.places.get(n) for n in names) if p), default=-1)

    def cut(self, upto: int) -> bool:
        """Closes all elements from ``upto`` on; whether text ends with one of them."""
        ends = False
        while len(self.stack) > upto:
            name, _, around, _ = self.stack.pop()
            self.places[name].pop()
            self.mains -= name in _MAIN
            ends = ends or around or name in _BLOCK
        return ends


class _Scanner:
    """The tags of a page in one pass. A tag ends at the first ``>`` outside of quoted values; one
    whose quote is never closed ends at the first ``>`` in any case, or before the next ``<``."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.unclosed: set[str] = set()  # quotes that don't occur any more

    def tag(self, at: int) -> tuple[int, str, str, bool] | None:
        """What stands at a ``<``: where it ends, name, attributes and whether it is an end tag; the
        name is empty for comments and the like; None if it is text."""
        text = self.text
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            return (end + 3 if end >= 0 else len(text)), "", "", False
        if text.startswith(("<!", "<?"), at):
            end = text.find(">", at)
            return (end + 1 if end >= 0 else len(text)), "", "", False
        closing = text.startswith("</", at)
        name = _NAME.match(text, at + 1 + closing)
        if not name:
            return None
        start = place = name.end()
        while True:
            stop = _STOP.search(text, place)
            if not stop:
                return len(text), name.group().lower(), text[start:], closing
            sign, place = stop.group(), stop.end()
            if sign in "><":
                return (place if sign == ">" else place - 1), name.group().lower(), text[start : place - 1], closing
            if text[start : place - 1][-32:].rstrip().endswith("=") and sign not in self.unclosed:
                end = text.find(sign, place)
                if end < 0:
                    self.unclosed.add(sign)
                else:
                    place = end + 1


def parse(source: str | None) -> Page:
    """The elements and blocks of one page."""
    page, text, open_ = Page(), source or "", _Open()
    scanner = _Scanner(text)
    held: list[str] = []
    owner, linked = (-1, False), 0

    def flush() -> None:
        joined = " ".join("".join(held).split())
        held.clear()
        if joined:
            page.blocks.append((*owner, joined))
            page.links.append(min(linked, len(joined)))

    def add(raw: str) -> None:
        nonlocal owner, linked
        if raw:
            _, _, around, block = open_.stack[-1] if open_.stack else ("", -1, False, -1)
            if held and owner[1] != around:
                flush()
            if not held:
                owner, linked = (block, around), 0
            held.append(entities.unescape(raw))
            linked += len(raw) if open_.places.get("a") else 0

    def close(upto: int) -> None:
        if open_.cut(upto):
            flush()

    at = begin = 0  # begin: of the text not yet added
    while at < len(text):
        at = text.find("<", at)
        if at < 0:
            break
        found = scanner.tag(at)
        if not found:
            at += 1
            continue
        add(text[begin:at])
        at, name, attributes, closing = found
        begin = at
        if not name:
            continue
        if closing:  # an end tag closes up to its start; a stray one is skipped
            places = open_.places.get(name)
            if places:
                close(places[-1])
            elif name == "p":
                flush()
            continue
        if name in _RAW:
            end = _ENDS[name].search(text, at)
            at = begin = end.end() if end else len(text)
            continue
        if name == "br":
            add(" ")
            continue
        if name in _BLOCK:
            flush()
            k = open_.last({"p"})  # a block ends an open paragraph that only inline elements are open in
            if k >= 0 and all(n in _INLINE for n, *_ in open_.stack[k + 1 :]):
                close(k)
        if name in _CLOSES:
            what, keeps = _CLOSES[name]
            k = open_.last(what)
            if k > open_.last(keeps):
                close(k)
        marks = {a.lower(): (b or c or d) for a, b, c, d in _CLASS.findall(attributes)}
        _, above, outside, block = open_.stack[-1] if open_.stack else ("", -1, False, -1)
        role = marks.get("role", "")
        label = name + "".join(f".{x}" for x in sorted(marks.get("class", "").split())) + (f"@{role}" if role else "")
        around = outside or name in _AROUND or (name == "header" and not open_.mains) or role in _ROLES
        sure, maybe = _named(marks.get("class", ""), marks.get("id", "") if name != "p" else "") if name in _NAMED or name == "p" else (False, False)
        around = around or sure
        element = len(page.names)
        if maybe and not around and name != "p":
            page.doubtful.append(element)
        page.names.append(name)
        page.tokens.append(_hash(label, page.tokens[above] if above >= 0 else 0))
        page.parents.append(above)
        page.depths.append(page.depths[above] + 1 if above >= 0 else 0)
        page.mains.append(name in _MAIN or role == "main")
        if name not in _VOID and not attributes.endswith("/"):
            if around and not outside:
                flush()
            open_.push(name, element, around, element if name in _BLOCK or (around and not outside) else block)
    add(text[begin:])
    flush()
    if page.doubtful:
        _settle(page)
    return page


def _settle(page: Page) -> None:
    """Decides by their contents which elements of doubtful names hold main text."""
    n = len(page.names)
    total, linked, blocks, prose, repeats = [0] * n, [0] * n, [0] * n, [False] * n, [False] * n
    for (element, _, text), links in zip(page.blocks, page.links, strict=True):
        if element >= 0:
            total[element] += len(text)
            linked[element] += links
            blocks[element] += 1
            prose[element] = prose[element] or page.names[element] in _PROSE
    alike: dict[tuple[int, int], int] = {}  # of each element, its children of one token that hold several blocks
    for e in range(n - 1, -1, -1):  # parents come first
        above = page.parents[e]
        if above >= 0:
            total[above], linked[above], blocks[above] = total[above] + total[e], linked[above] + linked[e], blocks[above] + blocks[e]
            prose[above] = prose[above] or prose[e]
            if blocks[e] > 1 and page.names[e] != "tr":
                k = (above, page.tokens[e])
                alike[k] = alike.get(k, 0) + 1
                repeats[above] = repeats[above] or alike[k] > 1
            repeats[above] = repeats[above] or repeats[e]
    gone = [False] * n
    for e in page.doubtful:
        gone[e] = linked[e] >= _LINKED * total[e] or repeats[e] or (total[e] < _LABELS and not prose[e])
    for e in range(n):
        gone[e] = gone[e] or (page.parents[e] >= 0 and gone[page.parents[e]])
    page.blocks = [(e, around or (e >= 0 and gone[e]), text) for e, around, text in page.blocks]


@dataclass
class Template:
    """The nested classes of a host: the class of each token, and which class each lies in (-1:
    none). share and pages: how many of the host's pages have a token."""

    classes: dict[int, int]
    within: list[int]
    share: dict[int, float]
    pages: dict[int, int]


def nested(tokens: list[tuple[int, int, tuple, int, float]]) -> Template:
    """The template of tokens that are frequent and in order: (token, the token around it, its
    vector, pages, share of pages). Classes of one vector are split where they hang in several
    places."""
    by_vector: dict[tuple, list[int]] = {}
    around = {t: a for t, a, *_ in tokens}
    for t, _, vector, *_ in tokens:
        by_vector.setdefault(vector, []).append(t)
    able = {t: v for v, ts in by_vector.items() if len(ts) >= LEAST_TOKENS for t in ts}
    hangs: dict[int, int] = {}  # the innermost token of another class around each

    def hook(t: int) -> int:
        way = []
        while t not in hangs:
            way.append(t)
            a = around.get(t, 0)
            if a not in around:
                hangs[t] = 0
            elif a in able and able[a] != able.get(t):
                hangs[t] = a
            else:
                t = a
                continue
            break
        for x in way:
            hangs[x] = hangs[t]
        return hangs[t]

    groups: dict[tuple, list[int]] = {}
    for t, v in sorted(able.items()):
        groups.setdefault((v, hook(t)), []).append(t)
    classes: dict[int, int] = {}
    hooks = []
    for (_, h), ts in sorted(groups.items(), key=lambda g: min(g[1])):
        if len(ts) >= LEAST_TOKENS:
            classes |= dict.fromkeys(ts, len(hooks))
            hooks.append(h)
    kept = {t: (p, s) for t, _, _, p, s in tokens if t in classes}
    return Template(classes, [classes.get(h, -1) for h in hooks], {t: s for t, (_, s) in kept.items()}, {t: p for t, (p, _) in kept.items()})


def slots(page: Page, template: Template | None) -> list[tuple[int, int] | None]:
    """The slot of each block of text, or None where the block is a template token: the innermost
    template element around it and how many template tokens stood in that before."""
    out: list[tuple[int, int] | None] = []
    known = template.classes if template else {}
    inner: list[int] = []  # of each element, itself included
    seen: dict[int, int] = {}
    element = 0
    for block in page.blocks:
        while element <= block[0]:
            above = inner[page.parents[element]] if page.parents[element] >= 0 else -1
            if page.tokens[element] in known:
                seen[above] = seen.get(above, 0) + 1
                above = element
            inner.append(above)
            element += 1
        place = inner[block[0]] if block[0] >= 0 else -1
        if page.mark(block) in known:
            seen[place] = seen.get(place, 0) + 1
            out.append(None)
        else:
            out.append((place, seen.get(place, 0)))
    return out


def main_text(page: Page, template: Template | None = None) -> str:
    """The text of the main slots."""
    free = slots(page, template)
    n = len(page.names)
    weight, total = [0] * n, 0
    for element, around, text in page.blocks:
        if not around:
            total += len(text)
            if element >= 0:
                weight[element] += len(text)
    for e in range(n - 1, -1, -1):  # parents come first
        if page.parents[e] >= 0:
            weight[page.parents[e]] += weight[e]
    inside = [False] * n

    def within(roots: list[bool]) -> list[bool]:
        for e in range(n):
            inside[e] = roots[e] or (page.parents[e] >= 0 and inside[page.parents[e]])
        return inside

    def chosen(of_template: bool) -> str:
        """All in ``inside`` and, with the host's template known, what else is in slots."""
        kept = [text for (e, around, text), slot in zip(page.blocks, free, strict=True) if not around and ((e >= 0 and inside[e]) or (of_template and slot is not None))]
        return "\n\n".join(kept)

    within(page.mains)
    hinted = [(b, slot) for b, slot in zip(page.blocks, free, strict=True) if not b[1] and b[0] >= 0 and inside[b[0]]]
    if hinted and sum(len(b[2]) for b, _ in hinted) >= HINT_SHARE * total:
        common = [slot is None and template.pages[page.mark(b)] >= MAIN_PAGES and template.share[page.mark(b)] >= MAIN_PAGES_SHARE for b, slot in hinted]
        repeats = sum(len(b[2]) for (b, _), c in zip(hinted, common, strict=True) if c) > sum(len(b[2]) for b, slot in hinted if slot is not None)
        return "\n\n".join(b[2] for (b, _), c in zip(hinted, common, strict=True) if repeats or not c)  # repeats: copies of one article
    able = [e for e in range(n) if weight[e] and weight[e] >= MAIN_SHARE * total and (not template or page.tokens[e] in template.classes)]
    if not able:
        return chosen(of_template=True)
    best = max(able, key=lambda e: (page.depths[e], weight[e], -e))
    # A leaf that occurs again and again is a block of the slot, not the slot.
    while page.parents[best] >= 0 and page.names[best] in _LEAVES:
        best = page.parents[best]
    within([e == best for e in range(n)])
    return chosen(of_template=True)


_ROW = "host string, token long, around long, pages long, low long, high long, b1 long, b2 long, a1 long, a2 long, many int"


def templates(pages: DataFrame, host: str, page_html: str) -> DataFrame:
    """host and tokens: array of (token, around, low, high, pages, share), for ``nested``."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], list[int]] = {}
        for b in batches:
            for h, source in zip(b["host"], b["html"], strict=True):
                page = parse(source)
                count: dict[int, int] = {}
                around: dict[int, int] = {}
                for t, parent in zip(page.tokens, page.parents, strict=True):
                    count[t] = count.get(t, 0) + 1
                    around[t] = page.tokens[parent] if parent >= 0 else 0
                elements = len(count)
                for block in page.blocks:
                    if not block[1]:
                        t = page.mark(block)
                        count[t] = count.get(t, 0) + 1
                        around[t] = page.tokens[block[0]] if block[0] >= 0 else 0
                mine = xxhash.xxh64_intdigest(source or "")
                before, after, last = {}, {}, {}  # of tokens that are once on the page, beside each other in one element
                for t, parent in zip(page.tokens, page.parents, strict=True):
                    if count[t] == 1:
                        before[t] = last.get(parent, 0)
                        after[before[t]] = t
                        last[parent] = t
                for k, (t, n) in enumerate(count.items()):
                    s = sums.setdefault((h, t), [around[t], 0, 0, 0, 1 << 62, -(1 << 62), 1 << 62, -(1 << 62), 0])
                    part = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), mine)
                    s[1] += 1
                    s[2] += part & 0xFFFFFFFF  # summed in halves, which don't overflow
                    s[3] += part >> 32
                    if n > 1 or k >= elements:  # a block's place is its path alone
                        s[8] = 1
                    else:  # two bits of room for the start values
                        x, y = before[t] >> 2, after.get(t, 0) >> 2
                        s[4:8] = min(s[4], x), max(s[5], x), min(s[6], y), max(s[7], y)
                if len(sums) > 100_000:
                    yield _frame(sums)
                    sums.clear()
        yield _frame(sums)

    rows = pages.select(F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("host"), F.col(f"`{page_html}`").alias("html")).mapInPandas(vectors, _ROW)
    tokens = rows.groupBy("host", "token").agg(F.min("around").alias("around"), *[F.sum(c).alias(c) for c in ("pages", "low", "high")], *[F.min(c).alias(c) for c in ("b1", "a1")], *[F.max(c).alias(c) for c in ("b2", "a2", "many")])
    sizes = pages.groupBy(F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("host")).agg(F.count("*").alias("n"))
    often = tokens.filter(F.col("pages") >= LEAST_PAGES).join(sizes, "host").filter(F.col("pages") >= LEAST_SHARE * F.col("n"))
    ordered = often.filter((F.col("many") == 1) | (F.col("b1") == F.col("b2")) | (F.col("a1") == F.col("a2")))
    entry = F.struct("token", "around", "low", "high", "pages", (F.col("pages") / F.col("n")).alias("share"))
    return ordered.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("tokens"))  # tokens of half of a host's pages: few


def _frame(sums: dict[tuple[str, int], list[int]]) -> pd.DataFrame:
    keys, values = list(sums), np.array(list(sums.values()), dtype=np.int64).reshape(-1, 9)
    out = pd.DataFrame({"host": pd.Series([k[0] for k in keys], dtype=object), "token": np.array([k[1] for k in keys], dtype=np.int64)})
    for i, name in enumerate(("around", "pages", "low", "high", "b1", "b2", "a1", "a2", "many")):
        out[name] = values[:, i]
    return out


def extract(pages: DataFrame, key: str, url: str, host: str, page_html: str, broadcast_tokens: int = BROADCAST_TOKENS, pages_at_once: int = PAGES_AT_ONCE) -> DataFrame:
    """key, url and text of each page."""
    found = cut(templates(pages, host, page_html), "templates")
    size = found.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n"), F.count("*").alias("hosts")).first()
    rows = pages.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").alias("u"), F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("host"), F.col(f"`{page_html}`").alias("html"))
    if size["n"] + size["hosts"] <= broadcast_tokens:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:  # each host's pages in parts, its template once for each
        parts = rows.groupBy("host").agg(F.ceil(F.count("*") / pages_at_once).cast("int").alias("parts"))
        dealt = found.join(parts, "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("host", "part", "tokens")
        most = parts.agg(F.max("parts")).first()[0]
        own = F.pmod(F.xxhash64("html"), F.col("parts")).cast("int")
        many = parts.filter("parts > 1")  # hosts of more than ``pages_at_once`` pages
        sized = rows.join(F.broadcast(many), "host", "left") if most > 1 and many.count() <= broadcast_tokens else rows.withColumn("parts", F.lit(1))
        joined = sized.withColumn("part", F.when(F.col("parts") > 1, own).otherwise(F.lit(0))).drop("parts").join(dealt, ["host", "part"], "left")

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made: dict[str, Template | None] = {}
        for hosts, sources, tokens in batches:
            out = []
            for h, source, ts in zip(hosts, sources, tokens, strict=True):
                if h not in made:
                    if len(made) >= 1000:
                        made.clear()
                    made[h] = nested([(t["token"], t["around"], (t["low"], t["high"]), t["pages"], t["share"]) for t in ts]) if ts is not None else None
                template = made[h]
                out.append(main_text(parse(source), template if template and template.classes else None))
            yield pd.Series(out, dtype=object)

    return joined.select(F.col("k").alias(key), F.col("u").alias(url), text_of("host", "html", "tokens").alias("text"))
