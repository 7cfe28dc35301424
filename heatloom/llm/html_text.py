"""Main text of web pages by tag-path ratios.

A page is read tag by tag into text blocks, each with its tag path from the root (tags with their classes; inline tags
belong to the block around them). Per tag path, text length, punctuation marks, link text and blocks are added up; its ratio
is mean length times (1 + mean punctuation) times the share of text outside of links. The ratios in page order are smoothed by
a Gaussian kernel and fused per path (mean over the path's blocks); paths at or above the standard deviation of the smoothed
sequence are content.

What decides the text: blocks in menus, headers, footers, sidebars, notices, adverts, forms and reader comments, as tags, roles and names tell
(``_side_kind``), are left out first. Of the rest the chosen paths decide. If ``article`` elements hold half of the chosen text or more, the text is
all blocks of those with a chosen block, in page order; else the same for ``main``; else the root is the lowest container of all chosen blocks, and the text is all
blocks in it but parts of it that are mostly links, and the blocks that stand directly in the containers around it (headings, first and last paragraphs).

Defined results: a null, empty or text-free page has the empty text; text without any tag is one block; an unclosed tag, comment or
script runs to the end of what it is in; repeated rows are each reported; an empty table gives an empty table. Only
``page_id``, ``url`` and ``html`` are read. Each page is handled by itself, in time linear in its length.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, REACH = 1.0, 2
#: Share of the text that a part beside the main text can not have; share of links that makes a part a menu.
TOO_MUCH, LINKS = 0.5, 0.6

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select button canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "tr"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
SCOPE = frozenset("table ul ol dl article section div body html main td th".split())
CONTAINER = frozenset("html body main article section div td center table tbody tr form blockquote".split())
# What is not main text, by tag, by role and by a part of a class or id.
SIDE_TAGS = frozenset("nav header footer aside form menu dialog".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SIDE_NAMES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside rail ad ads advert adverts advertisement adsense banner promo sponsor sponsored cookie "
    "cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup share sharing social related recommended comment comments "
    "disqus reply replies respond breadcrumb breadcrumbs pagination pager login search widget toolbar skip copyright legal".split()
)
NEGATIONS = frozenset("has with no without show hide".split())
# Words of these that also begin or end names of content.
SOFT_NAMES = frozenset("header rail banner notice overlay share social related reply respond search skip copyright legal".split())
COMMENT_NAMES = frozenset("comment comments disqus reply replies respond".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/]|$))", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？·]")


NOT_SIDE, SOFT, NAMED, COMMENTS, SIDE = range(5)


def _side_kind(tag: str, attributes: dict[str, str], inside_main: bool) -> int:
    """Whether an element is beside the main text: ``SIDE`` by its tag or role; ``NAMED`` and ``COMMENTS`` if one of its names is in the list or begins or
    ends with a word of it; ``SOFT`` if that word is common in names of content as well."""
    if tag in SIDE_TAGS and not (tag == "header" and inside_main):
        return SIDE
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "") in SIDE_ROLES:
        return SIDE
    if tag in ("html", "body", "main", "article"):
        return NOT_SIDE
    kind = NOT_SIDE
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = re.split(r"[-_]+", name)
        if parts[0] in NEGATIONS:
            continue
        found = {name} & SIDE_NAMES or {parts[0], parts[-1]} & SIDE_NAMES
        if found & COMMENT_NAMES and (name in found or found - SOFT_NAMES):
            return COMMENTS
        if found:
            kind = max(kind, SOFT if name not in found and found <= SOFT_NAMES else NAMED)
    return kind


class Page:
    """Elements and text blocks of one page."""

    def __init__(self, source: str):
        # elements: tag, parent, path number, in what way beside the main text
        self.tag, self.parent, self.path, self.side = ["#root"], [-1], [0], [NOT_SIDE]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.stack = [0]
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.linked = 0
        self.read(source)

    def element(self) -> int:
        """Innermost open element that is not inline."""
        for e in reversed(self.stack):
            if self.tag[e] not in INLINE:
                return e
        return 0

    def end_block(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            if text:
                self.blocks.append((self.element(), text, min(self.linked, len(text))))
            self.text, self.linked = [], 0

    def push(self, tag: str, attributes: str) -> None:
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        up = self.stack[-1]
        inside_main = bool(self.open.get("article") or self.open.get("main"))
        label = f"{tag}.{found['class']}" if "class" in found else tag
        self.tag.append(tag)
        self.parent.append(up)
        self.path.append(self.paths.setdefault((self.path[up], label), len(self.paths) + 1))
        self.side.append(_side_kind(tag, found, inside_main) if tag not in INLINE or "class" in found else NOT_SIDE)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self) -> None:
        self.open[self.tag[self.stack.pop()]] -= 1

    def close_upto(self, tags: tuple[str, ...], scope: frozenset[str]) -> None:
        """Closes the innermost open element of these tags, if none of ``scope`` is inside it."""
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[i]]
            if name in tags:
                while len(self.stack) > i:
                    self.pop()
                return
            if name in scope:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag not in VOID:
                self.push(tag, attributes)
            return
        self.end_block()
        if tag in CLOSES_P:
            self.close_upto(("p",), SCOPE)
        if tag in SIBLINGS:
            while any(self.open.get(t) for t in SIBLINGS[tag]):
                before = len(self.stack)
                self.close_upto(SIBLINGS[tag], SCOPE - set(SIBLINGS[tag]) - {"td", "th"} if tag in ("tr", "tbody", "tfoot") else SCOPE - set(SIBLINGS[tag]))
                if len(self.stack) == before:
                    break
        if tag not in VOID:
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag in INLINE:
            for i in range(len(self.stack) - 1, 0, -1):
                name = self.tag[self.stack[i]]
                if name == tag:
                    while len(self.stack) > i:
                        self.pop()
                    return
                if name not in INLINE:
                    return
            return
        self.end_block()
        self.close_upto((tag,), frozenset())

    def read(self, source: str) -> None:
        at, n, low = 0, len(source), None
        while at < n:
            cut = source.find("<", at)
            if cut < 0:
                cut = n
            if cut > at:
                piece = source[at:cut]
                self.text.append(piece)
                if self.open.get("a"):
                    self.linked += len(piece.strip())
            if cut == n:
                break
            if source.startswith("<!--", cut):
                end = source.find("-->", cut + 4)
                at = n if end < 0 else end + 3
            elif found := TAG.match(source, cut):
                at = found.end()
                tag = found[2].lower()
                if found[1]:
                    self.end(tag)
                elif tag in RAW and not found[3].endswith("/"):
                    if tag not in INLINE:
                        self.end_block()
                    low = source.lower() if low is None or len(low) != n else low
                    if len(low) != n:  # lower-casing changed the length: search without it
                        closing = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(source, at)
                        end = closing.start() if closing else -1
                    else:
                        end = low.find(f"</{tag}", at)
                    at = n if end < 0 else end
                else:
                    self.start(tag, found[3])
            elif source[cut + 1 : cut + 2] in ("!", "?", "/"):  # declaration or nonsense
                end = source.find(">", cut)
                at = n if end < 0 else end + 1
            else:
                self.text.append("<")
                at = cut + 1
        self.end_block()

    # ---------------------------------------------------------------- choice

    def content(self, blocks: list[tuple[int, str, int]]) -> list[bool]:
        """Whether each block's tag path is content."""
        sums: dict[int, list[float]] = {}
        for e, text, linked in blocks:
            s = sums.setdefault(self.path[e], [0, 0, 0, 0])
            s[0] += 1
            s[1] += len(text)
            s[2] += len(PUNCTUATION.findall(text))
            s[3] += linked
        ratio = {p: (chars / k) * (1 + marks / k) * (1 - linked / chars) for p, (k, chars, marks, linked) in sums.items()}
        raw = [ratio[self.path[e]] for e, _, _ in blocks]
        kernel = [math.exp(-((d / SIGMA) ** 2) / 2) for d in range(-REACH, REACH + 1)]
        smooth = []
        for i in range(len(raw)):
            near = [(kernel[j - i + REACH], raw[j]) for j in range(max(0, i - REACH), min(len(raw), i + REACH + 1))]
            smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
        fused: dict[int, list[float]] = {}
        for (e, _, _), x in zip(blocks, smooth, strict=True):
            s = fused.setdefault(self.path[e], [0, 0])
            s[0] += 1
            s[1] += x
        mean = sum(smooth) / len(smooth)
        limit = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
        text = {p for p, (_, chars, _, linked) in sums.items() if linked <= LINKS * chars} or set(sums)  # links are none, whatever is next to them
        best = max(fused[p][1] / fused[p][0] for p in text)
        chosen = {p for p in text if fused[p][1] / fused[p][0] >= min(limit, best)}
        return [self.path[e] in chosen for e, _, _ in blocks]

    def inherited(self, mark: list[bool]) -> list[bool]:
        """Whether an element or one around it is marked."""
        out = list(mark)
        for e in range(1, len(out)):  # children stand behind their parents
            out[e] = out[e] or out[self.parent[e]]
        return out

    def sums(self, blocks: list[tuple[int, str, int]], of: list[int]) -> list[int]:
        """The numbers ``of`` blocks added up in each element."""
        out = [0] * len(self.tag)
        for (e, _, _), n in zip(blocks, of, strict=True):
            out[e] += n
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def beside(self) -> list[bool]:
        """Elements beside the main text. A named part that holds much of the text is not; nor is a soft one with a paragraph as rich as others."""
        hard = self.inherited([k == SIDE for k in self.side])
        blocks = [b for b in self.blocks if not hard[b[0]]]
        chars = self.sums(blocks, [len(t) for _, t, _ in blocks])
        large = [n > TOO_MUCH * chars[0] for n in chars]
        marked = self.inherited([t in ("article", "main") for t in self.tag])
        own = self.sums(blocks, [len(t) * marked[e] for e, t, _ in blocks])
        if own[0]:  # an article, however short, is the text rather than what stands beside it
            large = [x and (marked[e] or own[e] > 0) for e, x in enumerate(large)]
        named = self.inherited([h or k == COMMENTS or k == NAMED and not x for h, k, x in zip(hard, self.side, large, strict=True)])
        rest = [b for b in blocks if not named[b[0]]]
        if not rest:
            return hard
        rich = [len(t) * (1 + len(PUNCTUATION.findall(t))) * (1 - linked / len(t)) for _, t, linked in rest]
        usual = sum(r * len(t) for r, (_, t, _) in zip(rich, rest, strict=True)) / sum(len(t) for _, t, _ in rest) / 2
        good = self.sums(rest, [r >= usual for r in rich])
        return self.inherited([x or k == SOFT and not g for x, k, g in zip(named, self.side, good, strict=True)])

    def container(self, e: int) -> int:
        while e and self.tag[e] not in CONTAINER:
            e = self.parent[e]
        return e

    def main_text(self) -> str:
        side = self.beside()
        blocks = [b for b in self.blocks if not side[b[0]]]
        if not blocks:
            return ""
        chosen = self.content(blocks)
        weight = self.sums(blocks, [len(t) * c for (_, t, _), c in zip(blocks, chosen, strict=True)])
        for tag in ("article", "main"):
            roots = [t == tag and w > 0 for t, w in zip(self.tag, weight, strict=True)]
            inside = self.inherited(roots)
            if 2 * sum(len(t) for (e, t, _), c in zip(blocks, chosen, strict=True) if c and inside[e]) >= weight[0]:
                return "\n".join(t for e, t, _ in blocks if inside[e])
        root = 0
        for e in range(1, len(self.tag)):  # the lowest container that holds all
            if weight[e] == weight[0] and self.tag[e] in CONTAINER:
                root = e
        around, at = {root}, root
        while at > 0:
            at = self.parent[at]
            around.add(at)
        chars, links = self.sums(blocks, [len(t) for _, t, _ in blocks]), self.sums(blocks, [k for _, _, k in blocks])
        menu = self.inherited([e != root and not w and links[e] > LINKS * chars[e] for e, w in enumerate(weight)])
        inside = self.inherited([e == root for e in range(len(self.tag))])
        return "\n".join(t for e, t, _ in blocks if not menu[e] and (inside[e] or self.container(e) in around))


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [main_text(s) for s in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
