"""Operator 3: main text of web pages by line-block distribution."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import small_batches, table

#: Elements whose content is never text of a page.
UNSHOWN = frozenset("head script style noscript template svg math canvas iframe object embed audio video select textarea button".split())
#: Elements around an article.
AROUND = frozenset("nav header footer aside form menu dialog".split())
#: Words of class and id tokens that mark what isn't the article: what a page may also call a frame of the article, and what it doesn't.
FRAMES = frozenset("banner footer header legal login masthead menu modal nav navbar navigation notice notices overlay popup copyright search side sidebar toolbar widget".split())
EXTRAS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus gdpr newsletter pagination promo promotion recommended related replies respond share sharing signup social sponsor sponsored subscribe teaser teasers".split()
)
#: Words that may stand beside them in a token.
BESIDE = frozenset("area bar block bottom box buttons container cookie first global group inner item items last left link links list main outer page panel post posts primary reader right row secondary section site slot sub thread top user unit wrap wrapper".split())
#: Inside an article these words name parts of it.
IN_ARTICLE = frozenset("header footer side legal copyright masthead banner".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
#: Elements that end a line; text between two of them is a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose lines belong together, and those that the end tag of an inline element doesn't end.
CONTAINERS = frozenset("article aside div main section td".split())
BARRIERS = AROUND | {"article", "main", "table", "td", "div", "section"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the same kind ends.
SELF_CLOSING = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"})}
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: One attribute from left to right: a name, and a value in quotes or without.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?|[\s/=]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Lines in the sliding window, the code points in it at which text surges, and those that the name of an article element counts for in each line.
WINDOW, SURGE, NAMED = 3, 80, 27


@dataclass
class Mark:
    """An element that isn't the article by its name, class, id or role."""

    parent: int
    frame: bool  # it may turn out to be around the article
    text: int = 0
    article: int = 0
    off: bool = False


@dataclass
class Lines:
    """A page's lines: text, code points of it inside links, whether in an article element, innermost mark (0: none) and container."""

    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    article: list[bool] = field(default_factory=list)
    mark: list[int] = field(default_factory=list)
    container: list[int] = field(default_factory=list)
    marks: list[Mark] = field(default_factory=lambda: [Mark(0, False)])


def marked_words(token: str, article: bool) -> frozenset[str]:
    """The marking words of a class or id token, if it has no others but those that may stand beside them."""
    words = {w.lower() for w in WORDS.findall(token)}
    found = frozenset(words & (FRAMES | EXTRAS) - (IN_ARTICLE if article else frozenset()))
    return found if found and all(w in FRAMES or w in EXTRAS or w in BESIDE or w.isdigit() for w in words) else frozenset()


class Page:
    """Reads a page once, from left to right, into lines; what it costs is linear in the page's length."""

    def __init__(self, page: str):
        self.page, self.lines = page, Lines()
        self.parts: list[str] = []
        self.linked = 0
        # name, hidden, in an article, mark, in a link, container
        self.stack: list[tuple[str, bool, bool, int, bool, int]] = [("", False, False, 0, False, 0)]
        self.at: dict[str, list[int]] = {}  # places of each open name
        self.blocks: list[int] = []
        self.barriers: list[int] = []
        self.containers = 0
        self.unended: set[str] = set()
        self._read()

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, _, article, mark, _, container = self.stack[-1]
            out = self.lines
            out.text.append(text)
            out.linked.append(min(self.linked, len(text)))
            out.article.append(article)
            out.mark.append(mark)
            out.container.append(container)
            node = out.marks[mark]
            node.text += len(text) - out.linked[-1]
            node.article += article * (len(text) - out.linked[-1])
        self.parts.clear()
        self.linked = 0

    def _text(self, s: str) -> None:
        _, hidden, _, _, link, _ = self.stack[-1]
        if s and not hidden:
            s = entities.unescape(s)
            self.parts.append(s)
            if link:
                self.linked += len(s.strip())

    def _push(self, entry: tuple[str, bool, bool, int, bool, int]) -> None:
        k, name = len(self.stack), entry[0]
        self.stack.append(entry)
        self.at.setdefault(name, []).append(k)
        if name in BLOCKS:
            self.blocks.append(k)
        if name in BARRIERS:
            self.barriers.append(k)

    def _pop_to(self, k: int) -> None:
        if self.blocks and self.blocks[-1] >= k:
            self._flush()
        while len(self.stack) > k:
            place, name = len(self.stack) - 1, self.stack.pop()[0]
            self.at[name].pop()
            for places in (self.blocks, self.barriers):
                if places and places[-1] == place:
                    places.pop()

    def _tag(self, i: int) -> tuple[dict[str, str], int, bool]:
        """Attributes from the end of a tag's name on, the place after the tag, and whether it ends itself; at the page's end the place is beyond."""
        page, got = self.page, {}
        while i < len(page) and page[i] != ">":
            m = ATTRIBUTE.match(page, i)
            if not m or m.end() == i:
                i += 1
                continue
            if m[1]:
                got.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
            i = m.end()
        return got, i + 1, page[i - 1] == "/"

    def _end(self, name: str) -> None:
        places = self.at.get(name)
        if places and (name in BLOCKS or not self.barriers or self.barriers[-1] <= places[-1]):
            self._pop_to(places[-1])
        if name in BLOCKS:
            self._flush()

    def _close_before(self, name: str) -> None:
        """A start tag ends an open element of its kind, and a block ends an open paragraph."""
        kinds = SELF_CLOSING.get(name, frozenset({"p"}) if name in BLOCKS else frozenset())
        for k in reversed(self.blocks[-3:] if kinds else []):
            if self.stack[k][0] in kinds:
                self._pop_to(k)
                return
            if self.stack[k][0] != "p":
                return

    def _start(self, name: str, attributes: dict[str, str], ends: bool, i: int) -> int:
        self._close_before(name)
        if name in BLOCKS:
            self._flush()
        if name == "br":
            self._text(" ")
        if name in VOID or ends and name not in BLOCKS:
            return i
        if name in RAW_END:
            end = None if name in self.unended else RAW_END[name].search(self.page, i)
            if not end:
                self.unended.add(name)
            return end.end() if end else (len(self.page) if name in ("script", "style") else i)
        _, hidden, article, mark, link, container = self.stack[-1]
        hidden |= name in UNSHOWN or "hidden" in attributes or bool(UNSEEN.search(attributes.get("style", "")))
        words: set[str] = set()
        if name not in ("html", "body"):
            for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
                words |= marked_words(token, article)
        own = name in ("article", "main")
        if own and not words & EXTRAS:
            words = set()
        if not hidden and (words or name in AROUND or attributes.get("role", "").lower() in ROLES and not own):
            self.lines.marks.append(Mark(mark, not words & EXTRAS and (bool(words) and name not in AROUND or name == "form")))
            mark = len(self.lines.marks) - 1
        if name in CONTAINERS:
            self.containers += 1
            container = self.containers
        self._push((name, hidden, article or own, mark, link or name == "a", container))
        return i

    def _read(self) -> None:
        page, i, n = self.page, 0, len(self.page)
        while i < n:
            k = page.find("<", i)
            if k < 0:
                break
            self._text(page[i:k])
            nxt = page[k + 1 : k + 2]
            if nxt in ("!", "?"):
                if page.startswith("<!--", k):
                    end = page.find("-->", k + 4)
                    i = end + 3 if end >= 0 else n
                elif page.startswith("<![CDATA[", k):
                    end = page.find("]]>", k)
                    self._text(page[k + 9 : end if end >= 0 else n])
                    i = end + 3 if end >= 0 else n
                else:
                    end = page.find(">", k)
                    i = end + 1 if end >= 0 else n
                continue
            named = NAME.match(page, k)
            if not named:  # a sign, not a tag
                self._text("<")
                i = k + 1
                continue
            name = named[1].lower()
            attributes, i, ends = self._tag(named.end())
            if i > n:
                break  # the page ends inside a tag
            if nxt == "/":
                self._end(name)
            else:
                i = self._start(name, attributes, ends, i)
        if i < n:
            self._text(page[i:])
        self._flush()


def settle_marks(marks: list[Mark]) -> None:
    """Sums texts over nested marks and switches a frame off where it holds most of the articles' text, or of all where there is no article."""
    for node in reversed(marks[1:]):
        marks[node.parent].text += node.text
        marks[node.parent].article += node.article
    whole, article = marks[0].text, marks[0].article
    for node in marks[1:]:
        node.off = marks[node.parent].off or not (node.frame and (2 * node.article > article if article else 2 * node.text > whole))


def surges(length: list[int], container: list[int], threshold: int) -> list[bool]:
    """Which lines are between a surge and a dive of the sums over sliding windows.

    Behind the last surge a window still reaches back to it; lines of another
    container than the last heavy line's don't belong to it.
    """
    total = [0]
    for x in length:
        total.append(total[-1] + x)
    n, out, inside, heavy = len(length), [], False, 0
    for i in range(n):
        ahead = total[min(n, i + WINDOW)] - total[i]
        behind = total[i + 1] - total[max(0, i + 1 - WINDOW)]
        if not inside:
            inside = bool(length[i]) and ahead >= threshold
        elif max(ahead, behind) < threshold or ahead < threshold and container[i] != heavy:
            inside = False
        if inside and length[i] * WINDOW >= threshold:
            heavy = container[i]
        out.append(inside)
    return out


def main_text(page: str | None) -> str:
    """The text between the surges and dives of a page's line blocks.

    A line weighs its code points outside links, and nothing inside elements
    that are marked as other than the article. Where article elements hold a
    third of the text or more, their names add a third of a surge to each
    line in them, and lines outside of them weigh nothing. Text surges where
    the weights in a window of lines reach a threshold, and dives where the
    windows before and after are below it. Lines of a container that holds a
    surge stay with it, and lines of links between two lines that stay, so
    that short paragraphs, lists and verse aren't torn out of a text. A page
    with less text than a surge keeps all of it.
    """
    if not page:
        return ""
    lines = Page(page).lines
    settle_marks(lines.marks)
    n = len(lines.text)
    shown = [not lines.marks[m].off for m in lines.mark]
    plain = [len(t) - k for t, k in zip(lines.text, lines.linked, strict=True)]
    held = sum(p for p, s, a in zip(plain, shown, lines.article, strict=True) if s and a)
    other = sum(p for p, s, a in zip(plain, shown, lines.article, strict=True) if s and not a)
    leads = held > 0 and 2 * held >= other
    length, menu = [], []
    for i in range(n):
        menu.append(2 * lines.linked[i] > len(lines.text[i]) and len(lines.text[i]) < SURGE)
        if not shown[i] or leads and not lines.article[i]:
            length.append(0)
        else:
            length.append((0 if menu[i] else plain[i]) + (NAMED if leads else 0))
    able = [shown[i] and (not leads or lines.article[i]) for i in range(n)]
    total = sum(p for p, x in zip(plain, able, strict=True) if x)
    if total < SURGE:
        inside = able  # too little text to surge anywhere: all of it is the page's
    else:
        inside = surges(length, [0] * n if leads else lines.container, SURGE)
    # what is kept around a line of links in one container keeps the line
    whole = {lines.container[i] for i in range(n) if inside[i] and length[i] >= SURGE and lines.container[i]}
    keep = [able[i] and not menu[i] and (inside[i] or lines.container[i] in whole) for i in range(n)]
    firm: dict[int, list[int]] = {}
    for i in range(n):
        if keep[i]:
            firm.setdefault(lines.container[i], []).append(i)
    between = lambda i: (c := firm.get(lines.container[i])) is not None and lines.container[i] and c[0] < i < c[-1]
    return "\n".join(lines.text[i] for i in range(n) if keep[i] or able[i] and menu[i] and between(i))


def extract(column: Column) -> Column:
    """The main text of each page of a column, in Arrow batches; pages are read whole."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text, na_action=None)

    return of(column)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages.

    Null and empty pages have the empty text; repeated rows and null ids give
    a row each; other columns are ignored; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", extract(F.coalesce(F.col("html"), F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_pages() of all pages; nulls, ties, repeated rows and empty tables as stated there."""
    return extract_pages(table(spark, sf_dir, "pages"))
