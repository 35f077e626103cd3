"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags into blocks of text, each with its root-to-leaf path of block elements. Per path the
text length and the punctuation outside links are summed and divided by how many blocks share it; along the page both ratios are
smoothed over neighbouring blocks, fused into one score by multiplication, and paths are kept whose mean score reaches
a part of the scores' deviation. The innermost element that holds the kept blocks is the article, or the nearest one
around it that is an article by its name. Without such a name it is widened as long as it is a part of the text itself (a
paragraph, list or table) or has sections of text beside it. All blocks in it count; only where it has no such name, blocks
that are nearly all links are dropped at its two ends, with the headings over them.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by element,
role, or a name in class or id: a word for such a part, alone or with words of layout (``comment-list``), never a word of
a longer name (``related-work``), the id of a heading or paragraph, or an id that only repeats the element's own heading.
Such a name alone does not decide for an element around the article: it is overruled where the element holds the only
article or main, more than half of the scored text that is no reader comment, or all of it; one for reader comments only
at nine tenths of all scored text. Inside an article a part goes only if it looks like one: short, in small pieces, mostly
links, or reader comments. It never counts for inline elements in pre or code. The source is read forward once, so that
hostile pages take no longer than others of their length.
Character references are decoded once; white space in a block, ``<br>`` included,
becomes one space; blocks are joined by a line feed.

Defined cases. A page of any length is taken whole. A null or empty page, or one without text outside those parts, gives an empty text. Elements left open
end with their parents, paragraphs and list items also where the next one begins; a comment or script left open goes to
the end of the page. Repeated rows are extracted alike, each on its own; an empty table gives an empty result; other
columns are neither read nor kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.llm.common import per_batch
from telltale.sources.tables import table

#: Part of the deviation of all scores that the mean score of a path must reach.
THRESHOLD = 0.5
#: Weights of a block's neighbours in smoothing, at distances 0, 1 and 2.
KERNEL = (0.4, 0.24, 0.06)

#: What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
#: An element on the left ends where one on the right begins.
ENDED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: Elements that bound what an end tag or an implied end may close.
SCOPES = frozenset("html body table td th article section main aside nav footer header form div ul ol dl blockquote".split())

#: Elements that are never part of an article.
BOILERPLATE = frozenset(
    "nav footer aside form button select menu dialog svg canvas object audio video head".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Words of a class or id that mark such parts.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus replies "
    "reply respond related recommended pagination pager toolbar widget skip".split()
)
#: Words of layout that may stand beside a mark in one name, such as comment-list; other words make it another name.
LAYOUT = frozenset(
    "area bar block body bottom box btn button buttons col column container content desktop entry fixed footer global group header "
    "icon icons inner item items js left link links list listing main mobile module network networks outer page panel pane post "
    "posts primary right row secondary section site slot sticky strip thread top unit wrap wrapper".split()
)
#: Words that begin a name which says that a part is not there.
NEGATED = frozenset("no with without has".split())
#: Elements with a mark, or articles, inside each other, beyond which further ones say nothing.
DEEP = 256
#: A marked part inside an article that is longer, in larger pieces, with few links and no reader comments is its text.
SMALL, PIECE = 400, 40
#: Those of them that mean reader comments, which may well be longer than the article.
READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Part of the scored text above which an element around it is no mere part of the page, for other marks and for these.
MOST, NEARLY_ALL = 0.5, 0.9
#: Part of a block's text above which its links make it a menu, at the ends of an article without a name.
LINKS = 0.8
#: Elements that are parts of a text and never all of it.
TEXTS = frozenset(
    "p pre blockquote figure figcaption address details summary ul ol dl li dt dd table caption thead tbody tfoot tr td th h1 h2 "
    "h3 h4 h5 h6".split()
)
PARTS = TEXTS - {"td", "th"}
#: Rank of a block that is no heading.
NO_RANK = 9
CODE = frozenset(["pre", "code"])
ARTICLES = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A tag with its attributes, quotes respected, or up to the next end where a quote is left open.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(?:((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|([^>]*)>)")
#: One whole attribute, its value with the quotes; a quote left open goes to the end of the tag.
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")
_WORD = re.compile(r"[a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？»«“”\"]")


@dataclass(slots=True)
class Element:
    name: str
    parent: int
    path: int
    left_out: bool
    mark: str
    linked: bool
    #: What holds for it and all around it: marks and articles from the outermost in, code, something left out.
    marks: tuple[int, ...] = ()
    articles: tuple[int, ...] = ()
    in_code: bool = False
    gone: bool = False
    #: The nearest element that is not inline, itself included, and the id that alone marked it.
    block: int = 0
    by_id: str = ""


@dataclass(slots=True)
class Block:
    text: str
    element: int
    #: Open elements with a mark, and open article elements, from the outermost in.
    marks: tuple[int, ...]
    articles: tuple[int, ...]
    #: Part of its characters that are in links.
    linked: float


def _mark_of(value: str) -> str:
    """What a class or id says: a word of MARKS as the whole of it, or such words with words of layout beside them."""
    found = ""
    for token in value.split():
        words = _WORD.findall(token)
        known = MARKS.intersection(words)
        if known and all(w in MARKS or w in LAYOUT or w.isdigit() for w in words) and not words[0] in NEGATED:
            if not READERS.isdisjoint(known):
                return "readers"
            found = "part"
    return found


def marked(name: str, attributes: str, inside_article: bool, inside_code: bool = False) -> tuple[bool, str, str]:
    """Whether an element and all in it is left out for certain, what its class or id says ("", part or readers), and the
    id if it alone says so."""
    if name in BOILERPLATE or (name == "header" and not inside_article):
        return True, "", ""
    if not attributes or name in ("html", "body", "article", "main"):
        return False, "", ""
    of = {"class": "", "id": ""}
    identity = ""
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True, "", ""
        if key == "role" and value in ROLES:
            return True, "", ""
        if key in of and not (inside_code and name in INLINE) and name not in HEADINGS:
            if key == "id" and name in TEXTS:
                continue  # the name of a place in the text
            of[key] = of[key] or _mark_of(value)
            identity = value.strip() if key == "id" else identity
    if of["class"]:
        return False, of["class"], ""
    return False, of["id"], identity if of["id"] else ""


def _slug(text: str) -> str:
    """The usual id of a heading."""
    return "-".join(re.findall(r"\w+", text.lower()))


class Page:
    """Elements and blocks of one page."""

    def __init__(self, source: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.elements = [Element("", -1, -1, False, "", False)]
        self.blocks: list[Block] = []
        #: Marked by an id that is only the name of their own heading.
        self.overruled: set[int] = set()
        self._open, self._text, self._linked = [0], [], 0
        self._names: Counter[str] = Counter()
        self._read(source)

    def _add(self, text: str) -> None:
        text = html.unescape(text)
        self._text.append(text)
        if self.elements[self._open[-1]].linked:
            self._linked += sum(map(len, text.split()))

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            now = self.elements[self._open[-1]]
            if text and not now.gone:
                linked = self._linked / (len(text) - text.count(" "))
                self.blocks.append(Block(text, now.block, now.marks, now.articles, linked))
                if now.marks and self.elements[now.block].name in HEADINGS:
                    own = self.elements[now.marks[-1]].by_id
                    if own and _slug(text) == own.replace("_", "-"):
                        self.overruled.add(now.marks[-1])
            self._text, self._linked = [], 0

    def _begin(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text.append(" ")
            return
        if name not in INLINE:
            self._flush()
            self._imply(name)
        if name in VOID:
            return
        parent, number = self._open[-1], len(self.elements)
        up = self.elements[parent]
        in_code = up.in_code or name in CODE
        left_out, mark, by_id = marked(name, attributes, bool(up.articles), in_code)
        if name in INLINE and (left_out or mark):
            self._flush()
        path = up.path if name in INLINE else self.paths.setdefault((up.path, name), len(self.paths))
        element = Element(name, parent, path, left_out, mark, up.linked or (name == "a" and "href" in attributes.lower()))
        element.marks = (*up.marks, number) if mark and len(up.marks) < DEEP else up.marks
        element.articles = (*up.articles, number) if name in ARTICLES and len(up.articles) < DEEP else up.articles
        element.in_code, element.gone, element.by_id = in_code, up.gone or left_out, by_id
        element.block = up.block if name in INLINE else number
        self.elements.append(element)
        self._open.append(number)
        self._names[name] += 1

    def _close(self, depth: int) -> None:
        """End the elements from this depth on."""
        for e in self._open[depth:]:
            self._names[self.elements[e].name] -= 1
        del self._open[depth:]

    def _imply(self, name: str) -> None:
        """Ends that the beginning of a block element implies."""
        for depth in range(len(self._open) - 1, 0, -1):
            open_name = self.elements[self._open[depth]].name
            if open_name == "p" or name in ENDED_BY.get(open_name, ()):
                self._close(depth)
                return
            if open_name in SCOPES:
                return

    def _end(self, name: str) -> None:
        if name in VOID or not self._names[name]:
            return
        for depth in range(len(self._open) - 1, 0, -1):
            element = self.elements[self._open[depth]]
            if element.name == name:
                if name not in INLINE or element.left_out or element.mark:
                    self._flush()
                self._close(depth)
                return
            if name in INLINE and element.name not in INLINE:
                return
            if element.name in SCOPES and name not in SCOPES:
                return

    def _read(self, source: str) -> None:
        """Forward only: nothing is looked at again, whatever is left open."""
        at, n, last = 0, len(source), source.rfind(">")
        while at < n:
            start = source.find("<", at)
            if start < 0 or (start > last and not source.startswith("<!--", start)):
                comment = source.find("<!--", max(start, at)) if start >= 0 else -1
                self._add(source[at : comment if comment >= 0 else n])
                break
            if start > at:
                self._add(source[at:start])
            follows = source[start + 1 : start + 2]
            if follows in ("!", "?"):
                at = self._skip(source, start)
                continue
            found = _TAG.match(source, start)
            if found is None:
                self._add("<")
                at = start + 1
                continue
            at = found.end()
            name, attributes = found.group(2).lower(), found.group(3) or found.group(4) or ""
            if found.group(1):
                self._end(name)
            elif name in RAW:
                if name not in INLINE and name != "noscript":
                    self._flush()
                end = re.compile(rf"</{name}\b", re.IGNORECASE).search(source, at)
                close = source.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else n
            else:
                self._begin(name, attributes)
        self._flush()

    def _skip(self, source: str, start: int) -> int:
        """The end of a comment, declaration or instruction; of none of them, that of its first character, which is text."""
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            return end + 3 if end >= 0 else len(source)
        if source[start + 1] == "?" or source[start + 2 : start + 3].isalpha() or source[start + 2 : start + 3] == "[":
            return source.find(">", start) + 1
        self._add("<")
        return start + 1


def _smooth(values: np.ndarray) -> np.ndarray:
    kernel = np.array([*KERNEL[:0:-1], *KERNEL])
    spread = np.convolve(values, kernel, "full")[len(KERNEL) - 1 :][: len(values)]
    weight = np.convolve(np.ones(len(values)), kernel, "full")[len(KERNEL) - 1 :][: len(values)]
    return spread / weight


def kept_paths(page: Page, blocks: list[Block]) -> set[int]:
    """Paths whose mean fused score reaches the threshold."""
    path = np.array([page.elements[b.element].path for b in blocks])
    # the text of links is what menus are made of; it says nothing for a path
    length = np.array([len(b.text) * (1 - b.linked) for b in blocks], float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) * (1 - b.linked) for b in blocks], float)
    kinds, at = np.unique(path, return_inverse=True)
    n = np.bincount(at)
    text_ratio, mark_ratio = np.bincount(at, length) / n, np.bincount(at, marks) / n
    fused = _smooth(text_ratio[at]) * _smooth(mark_ratio[at])
    score = np.bincount(at, fused) / n
    # the path's own ratios count as well, so a short block does not inherit all of its neighbours' score
    score = np.sqrt(score * text_ratio * mark_ratio)
    return {int(k) for k, s in zip(kinds, score, strict=True) if s >= THRESHOLD * score.std() and s > 0}


def prose_in_articles(page: Page) -> set[int]:
    """Marked parts inside an article whose blocks look like its text: long, with few links, and no reader comments."""
    size: Counter[int] = Counter()
    links: Counter[int] = Counter()
    blocks: Counter[int] = Counter()
    for b in page.blocks:
        if b.articles:
            for e in b.marks:
                if e > b.articles[0] and page.elements[e].mark == "part":
                    size[e] += len(b.text)
                    links[e] += b.linked * len(b.text)
                    blocks[e] += 1
    return {e for e, n in size.items() if n > SMALL and links[e] < 0.3 * n and n > PIECE * blocks[e]}


def unmarked(page: Page) -> list[Block]:
    """Blocks outside the marked parts, once the marks of elements around the article are overruled."""
    if not any(b.marks for b in page.blocks):
        return page.blocks
    kept = kept_paths(page, page.blocks)
    scored = [len(b.text) if page.elements[b.element].path in kept else 0 for b in page.blocks]
    weights = scored if any(scored) else [len(b.text) for b in page.blocks]
    overruled = page.overruled | prose_in_articles(page)

    def outermost(block: Block, region: int) -> int | None:
        return next((e for e in block.marks if e > region and e not in overruled), None)

    regions = [(0, list(zip(page.blocks, weights, strict=True)))]
    while regions:
        region, blocks = regions.pop()
        own, free = 0, {}
        tops: dict[str, dict[int, int]] = {"part": {}, "readers": {}}
        holders = set()
        for block, weight in blocks:
            top = outermost(block, region)
            article = next((e for e in block.articles if e > region), None)
            if top is None:
                own += weight
                if article is not None:
                    free.setdefault(article, []).append((block, weight))
                continue
            of = tops[page.elements[top].mark]
            of[top] = of.get(top, 0) + weight
            if any(e > top for e in block.articles):
                holders.add(top)
        parts, readers = tops["part"], tops["readers"]
        found: list[int] = []
        if parts:
            total, most = own + sum(parts.values()), max(parts.values())
            around = [e for e in parts if e in holders]
            if around and not free:
                found = [max(around, key=parts.get)]
            elif not own and most:
                found = [e for e, w in parts.items() if 2 * w >= most]
            else:
                found = [e for e, w in parts.items() if w > (NEARLY_ALL if free else MOST) * total]
        if not found and not free:
            total = own + sum(parts.values()) + sum(readers.values())
            found = [e for e, w in readers.items() if w > NEARLY_ALL * total]
        if found:
            overruled.update(found)
            regions.append((region, blocks))
        else:
            regions.extend(free.items())
    return [b for b in page.blocks if overruled.issuperset(b.marks)]


def article_blocks(page: Page, blocks: list[Block], chosen: list[Block]) -> tuple[bool, list[Block]]:
    """Blocks of the element that holds the article, given those on kept paths, and whether its name says that it does."""
    elements = page.elements
    # what is in an element has the numbers from its own up to its end
    end = list(range(1, len(elements) + 1))
    for e in range(len(elements) - 1, 0, -1):
        end[elements[e].parent] = max(end[elements[e].parent], end[e])

    def within(e: int, b: Block) -> bool:
        return e <= b.element < end[e]

    at, last = min(b.element for b in chosen), max(b.element for b in chosen)
    while last >= end[at]:
        at = elements[at].parent
    named = at
    while named > 0 and elements[named].name not in ARTICLES:
        named = elements[named].parent
    if named > 0:
        return True, [b for b in blocks if within(named, b)]

    def sections_beside(e: int, best: int, around: list[Block]) -> bool:
        for i, b in enumerate(around):
            rank = _rank(page, b)
            if elements[b.element].name not in TEXTS or b.linked >= LINKS:
                continue
            after = around[i + 1] if i + 1 < len(around) else None
            # a heading needs text under it, or to stand over the text found so far and above its headings
            if rank == NO_RANK or (b.element < e and rank < best):
                return True
            if after and (b.element < e) == (after.element < e) and _rank(page, after) == NO_RANK and after.linked < LINKS:
                return True
        return False

    # what is in an element is a run of blocks, which grows on the way up
    first = next(i for i, b in enumerate(blocks) if within(at, b))
    end_at = first
    while end_at < len(blocks) and within(at, blocks[end_at]):
        end_at += 1
    best = min((_rank(page, b) for b in blocks[first:end_at]), default=NO_RANK)
    while at > 0:
        up = elements[at].parent
        low, high = first, end_at
        while low > 0 and within(up, blocks[low - 1]):
            low -= 1
        while high < len(blocks) and within(up, blocks[high]):
            high += 1
        if (low, high) != (first, end_at):
            around = [*blocks[low:first], *blocks[end_at:high]]
            if elements[at].name not in PARTS and not sections_beside(at, best, around):
                break
            best = min([best, *(_rank(page, b) for b in around)])
            first, end_at = low, high
        at = up
    return False, blocks[first:end_at]


def _rank(page: Page, block: Block) -> int:
    name = page.elements[block.element].name
    return int(name[1]) if name in HEADINGS else NO_RANK


def without_menus(page: Page, blocks: list[Block], kept: set[int]) -> list[Block]:
    """Blocks without those at both ends that are nearly all links, and without the headings of these."""
    ranks = [_rank(page, b) for b in blocks]
    menu = [
        b.linked >= LINKS and r == NO_RANK and page.elements[b.element].path not in kept for b, r in zip(blocks, ranks, strict=True)
    ]
    first, n = 0, len(blocks)
    while True:
        links = first
        while links < n and ranks[links] < NO_RANK:
            links += 1
        text = links
        while text < n and menu[text]:
            text += 1
        # a heading over links is a title with its contents unless one of at least its rank follows
        if text == links or text == n or (links > first and ranks[text] > min(ranks[first:links])):
            break
        first = text
    last = n
    while last > first and menu[last - 1]:
        while last > first and menu[last - 1]:
            last -= 1
        while last > first and ranks[last - 1] < NO_RANK:
            last -= 1
    return blocks[first:last]


def main_text(source: str) -> str:
    """The article of a page, its blocks joined by line feeds."""
    page = Page(source)
    blocks = unmarked(page)
    if not blocks:
        return ""
    kept = kept_paths(page, blocks)
    chosen = [b for b in blocks if page.elements[b.element].path in kept]
    named, inside = article_blocks(page, blocks, chosen or blocks)
    if chosen and not named:
        inside = without_menus(page, inside, kept)
    return "\n".join(b.text for b in inside)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def start():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string())}

        return step

    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    out = per_batch(pages.select("page_id", "url", "html"), schema, start)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
