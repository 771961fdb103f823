"""Main text of web pages by two passes of block rules (operator 12).

A page is cut into blocks of text at its block-level tags. The first pass
decides a block by what surrounds it (a menu, a footer, a form, an advert, comments) or, elsewhere, by its link density, its
length and the share of stop words in it; short or doubtful blocks stay
undecided. In the second pass these inherit the label of the nearest decided
block. What is labelled content is joined in page order.

A page is one row; it is read once from left to right, whatever its markup.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwin.llm.common import pieces_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names of HTML elements, and words that authors use in their class and id attributes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_HIDDEN = frozenset("head script style template title iframe object svg canvas audio video noscript noembed noframes xmp math map dialog".split())
_APART = frozenset("nav footer aside form button select textarea fieldset menu label datalist option".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul caption".split()
)
_CELLS = frozenset("td th br".split())
_INSIDE = frozenset("article main".split())
_LISTS = frozenset("li ul ol".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are tracked until they are closed; of the others, a block ends where the next begins.
_HELD = (_BLOCKS | _HIDDEN | _APART | frozenset("td th span".split())) - frozenset("p hr dd dt option tr tbody thead tfoot".split()) - _VOID
_CUES = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising advertorial sponsor sponsored promo promoted promotion banner "
    "cookie cookies consent gdpr notice notices notification alert disclaimer sidebar sidenav menu nav navbar navigation navi breadcrumb "
    "breadcrumbs topbar toolbar masthead footer header comment comments commentlist respond replies disqus share sharing social related "
    "recommended recommendations newsletter subscribe subscription popup modal overlay login signin signup search pagination pager tags toc widget".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_CONTENT = frozenset("article content post entry story main body text".split())
_NEGATED = frozenset("no has with without is non".split())
# Frequent words of English, German, French and Spanish.
_STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ou mais comme nous "
    "el los las y del se por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando muy".split()
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass; lengths are in characters."""

    short: int = 70
    long: int = 200
    many_stop_words: float = 0.25
    few_stop_words: float = 0.08
    many_links: float = 0.5


@dataclass
class _Block:
    text: str
    linked: int
    heading: bool
    apart: bool
    inside: int
    label: int | None = None


@dataclass
class _State:
    """Open elements, how many of them hide text, set it apart or hold the article, and the block being read."""

    open: list = field(default_factory=list)
    names: Counter = field(default_factory=Counter)
    hidden: int = 0
    apart: int = 0
    holders: Counter = field(default_factory=Counter)
    lists: list = field(default_factory=list)
    link: bool = False
    heading: bool = False
    unseen: bool = False
    aside: bool = False
    parts: list = field(default_factory=list)
    links: list = field(default_factory=list)
    blocks: list = field(default_factory=list)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and not self.unseen:
            linked = len(" ".join("".join(self.links).split()))
            self.blocks.append(_Block(text, linked, self.heading, self.aside or self.apart > 0, self.inside()))
        self.parts.clear()
        self.links.clear()
        self.heading = self.unseen = self.aside = False

    def inside(self) -> int:
        """2 in an element for articles, 1 in one whose attributes say that it holds the content, else 0."""
        return 2 if self.holders[2] else 1 if self.holders[1] else 0

    def push(self, name: str, hidden: bool, apart: bool, inside: int) -> None:
        self.open.append((name, hidden, apart, inside, self.link))
        self.names[name] += 1
        if name in _LISTS:
            self.lists.append(name)
        self.hidden += hidden
        self.apart += apart
        self.holders[inside] += 1

    def pop(self, name: str) -> None:
        """Close the nearest open element of this name and all within it; none, if there is none."""
        if not self.names[name]:
            return
        closed = None
        while closed != name:
            closed, hidden, apart, inside, self.link = self.open.pop()
            self.names[closed] -= 1
            if closed in _LISTS:
                self.lists.pop()
            self.hidden -= hidden
            self.apart -= apart
            self.holders[inside] -= 1


def _cue(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """What an element's attributes say: that it is not shown, that it isn't the article, that it holds the article."""
    if not attributes or name in ("html", "body"):
        return False, False, False
    hidden = apart = content = False
    bare = _ATTRIBUTE.sub(" ", attributes).lower().split()
    if "hidden" in bare:
        hidden = True
    for match in _ATTRIBUTE.finditer(attributes):
        key, value = match[1].lower(), match[2] or match[3] or match[4] or ""
        if key in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in _PARTS.findall(token)]
                content |= set(words) <= _CONTENT and words not in (["body"], ["text"])
                told = [w for i, w in enumerate(words) if w in _CUES and not (i and words[i - 1] in _NEGATED)]
                if name == "main" or name == "article" and not {"comment", "ad", "ads", "advert", "sponsored", "promo"} & set(told):
                    continue
                # "entry-header" heads the article; "post-comments" still are comments.
                if told and not (set(told) <= {"header", "banner", "tags", "toc", "notice"} and _CONTENT & set(words)):
                    apart = True
        elif key == "role":
            apart |= value.strip().lower() in _ROLES
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return hidden, apart, content and not apart


def blocks_of(page: str) -> list[_Block]:
    """The blocks of text of a page that are not markup, scripts or styles."""
    s, at, end, tag = _State(), 0, len(page), _TAG
    lower = None
    while at < end:
        less = page.find("<", at)
        if less < 0:
            less = end
        if less > at and not s.hidden:
            text = html.unescape(page[at:less])
            s.parts.append(text)
            if s.link:
                s.links.append(text)
        if less == end:
            break
        if page.startswith("<!--", less):
            close = page.find("-->", less + 4)
            # A comment that isn't closed reaches to the end, as in browsers.
            at = end if close < 0 else close + 3
            continue
        match = tag.match(page, less)
        if match is None and tag is _TAG and less + 1 < end and (page[less + 1].isalpha() or page[less + 1] == "/"):
            # A quote that is never closed: from here on quotes mean nothing.
            match = _PLAIN_TAG.match(page, less)
            if match is not None:
                tag = _PLAIN_TAG
        if match is None:
            after = page[less + 1:less + 2]
            if after in ("!", "?", "/"):
                close = page.find(">", less)
                at = end if close < 0 else close + 1
            elif after.isalpha() and after.isascii():
                at = end  # a tag cut off by the end of the page
            else:
                if not s.hidden:
                    s.parts.append("<")
                at = less + 1
            continue
        at = match.end()
        closing, name, attributes = match[1] == "/", match[2].lower(), match[3]
        if name == "a":
            s.link = not closing and not attributes.rstrip().endswith("/")
            continue
        if name in _CELLS:
            s.parts.append(" ")
            if s.link:
                s.links.append(" ")
        elif name in _BLOCKS:
            s.flush()
        if closing:
            if name in _HELD:
                s.pop(name)
            continue
        if name in _BLOCKS:
            # A head that was not closed ends here.
            s.pop("head")
        if name in _RAW:
            lower = lower or page.lower()
            close = lower.find(f"</{name}", at)
            at = end if close < 0 else close
            if name == "textarea" or close < 0:
                continue
        if name in _HEADINGS:
            s.heading = True
        if name not in _HELD:
            if name in _BLOCKS:
                s.unseen, s.aside, _ = _cue(name, attributes)
            continue
        if name == "li" and s.lists and s.lists[-1] == "li":
            s.pop("li")
        hidden, apart, content = _cue(name, attributes)
        apart = apart or name in _APART or name == "header" and not s.inside()
        # Within a line, what isn't the article is left out of its block.
        hidden = hidden or name in _HIDDEN or apart and name not in _BLOCKS
        s.push(name, hidden, apart, 2 if name in _INSIDE else 1 if content else 0)
    s.flush()
    return s.blocks


def _stop_share(text: str) -> float:
    words = _LETTERS.findall(text.lower())
    return sum(w in _STOP for w in words) / len(words) if words else 0.0


def _marked(blocks: list[_Block]) -> int:
    """How well the page marks its article: as the best of its blocks that aren't apart."""
    return max((b.inside for b in blocks if not b.apart), default=0)


def _first_pass(blocks: list[_Block], rules: Rules) -> None:
    """Labels 1 (content) and 0; doubtful blocks keep None."""
    marked = _marked(blocks)
    free = [b for b in blocks if not b.apart]
    # In a language without known stop words their absence says nothing.
    written = sum(len(b.text) for b in free)
    telling = written > 0 and sum(_stop_share(b.text) * len(b.text) for b in free if len(b.text) >= rules.short) / written >= rules.few_stop_words
    for b in blocks:
        length = len(b.text)
        links = b.linked / length
        if b.apart or b.inside < marked:
            b.label = 0
        elif links > rules.many_links:
            b.label = None if b.heading else 0
        elif length < rules.short or b.heading:
            b.label = 0 if not marked and b.text.startswith("©") else None
        elif not telling:
            b.label = 1
        else:
            share = _stop_share(b.text)
            if share >= rules.many_stop_words or share >= rules.few_stop_words and (length >= rules.long or links == 0):
                b.label = 1
            elif length < rules.long or marked and links == 0:
                b.label = None
            else:
                b.label = 0


def _second_pass(blocks: list[_Block]) -> None:
    """Doubtful blocks take the label of the nearest decided one, a heading that of the block after it.

    Of two as near, one content and one not, sentences and what stands in a marked article follow the content, the rest the earlier.

    Where the page marks its article, only blocks in it are asked, and if none of them is decided all of them are content.
    """
    marked = _marked(blocks)
    asked = [b for b in blocks if not b.apart and b.inside >= marked]
    before: list[tuple[int, int] | None] = []
    last = None
    for i, b in enumerate(asked):
        last = (i, b.label) if b.label is not None else last
        before.append(last)
    following, found = None, []
    for i in range(len(asked) - 1, -1, -1):
        b = asked[i]
        if b.label is not None:
            following = (i, b.label)
            continue
        previous = before[i]
        if previous is None or following is None:
            near = previous or following
            label = near[1] if near else 1
        elif i - previous[0] != following[0] - i and not (b.heading and following[0] == i + 1):
            label = (previous if i - previous[0] < following[0] - i else following)[1]
        else:
            sentence = b.text.rstrip("\"'»”’)").endswith((".", "!", "?", "…", ":"))
            label = max(previous[1], following[1]) if marked or sentence else following[1] if b.heading else previous[1]
        found.append((b, label))
    for b, label in found:
        b.label = label


def main_text(page: str, rules: Rules = Rules()) -> str:
    """The article of a page: blocks with single spaces, joined by two line feeds; empty if there is none."""
    blocks = blocks_of(page)
    _first_pass(blocks, rules)
    _second_pass(blocks)
    return "\n\n".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame, rules: Rules = Rules(), page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; a null page is an empty one, rows that repeat an id each give a row."""
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in pieces_of(batch, "html"):
                texts = [main_text(p or "", rules) for p in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
