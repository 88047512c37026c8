"""Main text of web pages by tag-path ratios (operator 1).

A page becomes a list of blocks, each with its root-to-leaf path of block tags.
Per path, text length and punctuation are summed over its blocks; both ratios
(characters and punctuation marks a block) are smoothed with those of sibling paths,
fused, lowered by the share of link text, and held against a threshold that follows
the page's own spread. The deepest element that covers most of the text on the paths
above the threshold is the article if it lies in an <article> or <main>, which then
says where the article begins; else the article is the element around it that holds
all paths that are not mostly links, so titles, leads, lists, quotes and tables belong
to it. Everything in it is its text, but for parts that by their tag, role, class or id
are menus, adverts, comments and the like; where the page does not mark its article,
paths that are mostly links go too, headings excepted. A class or id says so only as a
whole ("share-bar", "related-posts"), not by a part of it ("share-price",
"related-work"), and never of a heading or paragraph.

Paths are numbers with a parent, and all sums over elements go up those parents once,
so time and memory are linear in the page, however deep its elements lie.

Defined results: null and empty pages have the empty text; broken markup is read as
browsers would (unclosed elements end with their parent, an unended tag or comment
takes the rest); a page without tags is text as a whole; whole pages are read, however
long; of elements that cover the same text the deepest is the article; repeated rows are
extracted one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import tables as T

# The HTML elements that begin a block, have no content, hold raw text, end one another.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody
td tfoot th thead tr ul""".split())
BREAK = frozenset(("br", "hr"))
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())    # what a head may hold
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes template svg annotation annotation-xml".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("ul ol dl table menu".split())        # an item does not end one outside its own list or table

# What is never an article by its tag, role, or a word of its class or id.
NEVER_TAGS = frozenset("head nav footer aside menu dialog button select option datalist label legend fieldset search noscript canvas object "
                       "audio video".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status".split())
_NEVER_WORD = (r"(?:ads?|advert\w*|adsense|alert|banner|breadcrumbs?|comment\w*|cookies?|consent|disqus|footer|footnav|gdpr|"
               r"login|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|notification|pager|pagination|paywall|popup|promos?|promotion|"
               r"recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|"
               r"teasers?|toolbar|topbar|widgets?)")
# What may stand beside such a word in a class or id.
_BESIDE = (r"(?:area|articles?|bar|block|body|bottom|box|buttons?|card|col|column|container|content|cta|default|email|floating|form|group|head|header|"
           r"icons?|inline|inner|items?|js|left|links?|list|main|media|mobile|module|news|outer|overlay|page|panel|plugin|policy|post|posts|primary|right|"
           r"section|secondary|site|slot|sticky|stories|tabs?|text|thread|title|top|topics?|unit|us|ui|wrap|wrapper|zone|\d+)")
NEVER_WORDS = re.compile(rf"(?:^|\s)(?:{_BESIDE}[_-]+)*{_NEVER_WORD}(?:[_-]+(?:{_NEVER_WORD}|{_BESIDE}))*(?:$|\s)", re.I)
LINES = frozenset("h1 h2 h3 h4 h5 h6 p pre".split())
NOT_NAMED = LINES | {"html", "body", "main"}        # no word makes these something else
STATES = re.compile(r"(?<![^\s_-])(?:has|no|not|with|without)[_-]\S*", re.I)      # what an element has or lacks, not what it is
READER_WORDS = re.compile(r"(?:^|[\s_-])(?:comment\w*|disqus|replies|reply|respond)(?:$|[\s_-])", re.I)
HEADER_WORDS = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)        # but in an article, which may have one of its own
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

HEADING = re.compile(r"h[1-6](?:$|\.)")

_TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([^\s=/"'>]+)""")
_PUNCTUATION = re.compile("[.,;:!?…。、，！？；：«»„“”]")

SHARE_OF_TEXT = 0.7     # of the text on chosen paths that the article element must cover
THRESHOLD = 0.25        # times the standard deviation of the path scores, taken from their mean
MOSTLY_LINKS = 0.6
MOST_OF_PAGE = 0.5      # of the text of a page: no class word excludes an element that holds so much


class Tree:
    """Numbered nodes under node 0, each with its parent and name; a parent's number is lower than its children's."""

    def __init__(self) -> None:
        self.parent, self.name, self.depth = [0], [""], [0]
        self.known: dict[tuple[int, str], int] = {}

    def child(self, parent: int, name: str) -> int:
        """The child of that name, the same for all elements of one path."""
        found = self.known.get((parent, name))
        if found is None:
            found = self.known[parent, name] = self.add(parent, name)
        return found

    def add(self, parent: int, name: str = "") -> int:
        self.parent.append(parent)
        self.name.append(name)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def upward(self, own: dict[int, int]) -> list[int]:
        """Per node, the sum of ``own`` over its subtree."""
        total = [own.get(i, 0) for i in range(len(self.parent))]
        for i in range(len(total) - 1, 0, -1):
            total[self.parent[i]] += total[i]
        return total


@dataclass
class Block:
    """Text between two block boundaries, with the path of block elements around it."""

    path: int
    text: str
    links: int          # characters inside <a>
    excluded: bool
    in_form: bool


@dataclass
class _Open:
    tag: str
    excluded: bool
    path: int           # of the innermost block element
    words: int          # node of the elements around it that a word of their class or id excludes


@dataclass
class _Part:
    """Text without a block boundary or an element that a word excludes beginning or ending in it."""

    block: int
    path: int
    words: int
    in_form: bool
    text: list[str] = field(default_factory=list)
    links: int = 0


def _named(attributes: dict[str, str]) -> str:
    return STATES.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}")


def _is_never(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Whether the element is no article whatever it holds."""
    if tag in NEVER_TAGS or (tag == "header" and not inside_article):
        return True
    if attributes.get("role", "").lower() in NEVER_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return "style" in attributes and bool(HIDDEN.search(attributes["style"]))


def _is_named_so(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Whether its class or id says that the element is no article."""
    if "class" not in attributes and "id" not in attributes or tag in NOT_NAMED:
        return False
    named = _named(attributes)
    if tag == "article":
        return "comment" in named.lower()
    return bool(NEVER_WORDS.search(named)) or not inside_article and bool(HEADER_WORDS.search(named))


class _Reader:
    """The open elements of a page, and the text said in them."""

    def __init__(self) -> None:
        self.paths, self.words = Tree(), Tree()
        self.parts: list[_Part] = []
        self.stack: list[_Open] = []
        self.at: dict[str, list[int]] = {}          # places in the stack of each tag
        self.blocks: list[int] = []                 # and of block elements
        self.hidden = self.block = 0                # open elements that are excluded; number of the block
        self.articles: dict[int, int] = {}          # <article> and <main> elements by the words around them
        self.titled: dict[int, int] = {}            # and <h1>
        self.readers: set[int] = set()              # words of what readers write

    def open(self, *tags: str) -> bool:
        return any(self.at.get(t) for t in tags)

    def last(self, tags) -> int:
        """Place of the innermost of the open elements with one of these tags, -1 without one."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=-1)

    def push(self, x: _Open) -> None:
        self.at.setdefault(x.tag, []).append(len(self.stack))
        if x.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.hidden += x.excluded
        self.stack.append(x)

    def close(self, upto: int) -> None:
        if self.blocks and self.blocks[-1] >= upto:
            self.block += 1
        while len(self.stack) > upto:
            x = self.stack.pop()
            self.at[x.tag].pop()
            if x.tag in BLOCK:
                self.blocks.pop()
            self.hidden -= x.excluded

    def say(self, text: str) -> None:
        if self.stack and self.stack[-1].tag == "head" and text.strip():      # a head holds no text
            self.close(len(self.stack) - 1)
        if self.hidden:             # block or not, and before its end is seen
            return
        words = self.stack[-1].words if self.stack else 0
        if not self.parts or self.parts[-1].block != self.block or self.parts[-1].words != words:
            path = self.stack[self.blocks[-1]].path if self.blocks else 0
            self.parts.append(_Part(self.block, path, words, self.open("form")))
        self.parts[-1].text.append(text)
        if self.open("a"):
            self.parts[-1].links += len(text.strip())

    def end(self, tag: str) -> None:
        if tag in BREAK:
            self.say(" ")
        elif tag == "p" and not self.open("p"):
            self.block += 1
        elif self.open(tag):
            found = self.at[tag][-1]
            # an inline end tag does not end the block it stands in
            if tag in BLOCK or not (self.blocks and self.blocks[-1] >= found):
                self.close(found)

    def begin(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in BLOCK:
            self.block += 1
            if self.open("p"):                       # a block ends an open paragraph
                self.close(self.at["p"][-1])
            while tag in ENDS and (ended := self.last(ENDS[tag])) > self.last(SCOPE):
                self.close(ended)
        if tag in VOID:
            return
        above, words = (self.stack[-1].path, self.stack[-1].words) if self.stack else (0, 0)
        path = above
        if tag in BLOCK:
            classes = attributes.get("class", "").split()
            path = self.paths.child(above, f"{tag}.{classes[0]}" if classes else tag)
        inside = self.open("article", "main")
        x = _Open(tag, _is_never(tag, attributes, inside), path, words)
        if not x.excluded and _is_named_so(tag, attributes, inside):
            if tag not in BLOCK and "-" not in tag:       # part of a line, never around a page
                x.excluded = True
            else:
                x.words = self.words.add(words)
                if READER_WORDS.search(_named(attributes)):
                    self.readers.add(x.words)
        if tag in ("article", "main") and x.words == words and not self.hidden and not x.excluded:
            self.articles[words] = self.articles.get(words, 0) + 1
        elif tag == "h1":
            self.titled[words] = 1
        self.push(x)


def blocks(page: str) -> tuple[list[Block], Tree]:
    """The page's text blocks in order, and the paths that their numbers mean."""
    r, at = _Reader(), 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            r.say(page[at:])
            break
        if token.start() > at:
            r.say(page[at:token.start()])
        at = token.end()
        slash, tag = token[1], (token[2] or "").lower()
        if not tag:
            continue
        if slash:
            r.end(tag)
            continue
        if r.open("head") and tag not in HEAD and not r.open("noscript"):
            r.close(r.at["head"][0])
        if tag == "head" and any(x.tag != "html" for x in r.stack[:2]):   # there is none in a body
            continue
        if tag in BREAK:
            r.say(" ")
            continue
        attributes = {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(token[3])} if token[3] else {}
        if tag in RAW and not token[0].endswith("/>"):
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        r.begin(tag, attributes)
    # an element that holds most of the page, and its article if it has one, is not left out for a word
    own: dict[int, int] = {}
    for p in r.parts:
        own[p.words] = own.get(p.words, 0) + len(" ".join("".join(p.text).split()))
    mass, articles, titled = (r.words.upward(x) for x in (own, r.articles, r.titled))
    left_out = [False] * len(mass)
    for w in range(1, len(mass)):
        kept = mass[w] >= MOST_OF_PAGE * mass[0] and articles[w] == articles[0] and (w not in r.readers or articles[w] or titled[w])
        left_out[w] = left_out[r.words.parent[w]] or not kept
    out = []
    for _, run in groupby(r.parts, lambda p: p.block):
        by: dict[bool, list[_Part]] = {}
        for p in run:
            by.setdefault(left_out[p.words], []).append(p)
        for excluded, some in by.items():
            text = " ".join(html.unescape("".join(t for p in some for t in p.text)).split())
            if text:
                out.append(Block(some[0].path, text, sum(p.links for p in some), excluded, some[0].in_form))
    return out, r.paths


def path_scores(found: list[Block], paths: Tree) -> dict[int, float]:
    """Fused score of each path: smoothed text and punctuation ratios, less the share of link text."""
    length, marks, links, count = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        length[b.path] += len(b.text)
        marks[b.path] += len(_PUNCTUATION.findall(b.text))
        links[b.path] += b.links
        count[b.path] += 1
    near = defaultdict(lambda: [0, 0, 0])          # of a path and its siblings: characters, marks, blocks
    for p in count:
        for i, of in enumerate((length, marks, count)):
            near[paths.parent[p]][i] += of[p]
    scores = {}
    for p in count:
        all_text, all_marks, all_blocks = near[paths.parent[p]]
        text = (length[p] / count[p] + all_text / all_blocks) / 2
        mark = (marks[p] / count[p] + all_marks / all_blocks) / 2
        scores[p] = text * (1.0 + mark) * (1.0 - min(1.0, links[p] / length[p]))
    return scores


def main_text(page: str | None) -> str:
    """Main text of one page."""
    found, paths = blocks(page or "")
    found = [b for b in found if not b.excluded]
    total = sum(len(b.text) for b in found)
    forms = sum(len(b.text) for b in found if b.in_form)
    if forms < 0.5 * total:                 # else the page as a whole stands in a form
        found = [b for b in found if not b.in_form]
    if not found:
        return ""
    scores = path_scores(found, paths)
    mean = sum(scores[b.path] for b in found) / len(found)
    spread = math.sqrt(sum((scores[b.path] - mean) ** 2 for b in found) / len(found))
    chosen = {p for p, s in scores.items() if s >= mean - THRESHOLD * spread}
    own, links, length = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        if b.path in chosen:
            own[b.path] += len(b.text)
        links[b.path] += b.links
        length[b.path] += len(b.text)
    mass = paths.upward(own)
    article = max((p for p in range(len(mass)) if mass[p] >= SHARE_OF_TEXT * mass[0]), key=lambda p: (paths.depth[p], mass[p]))
    content = {p for p in length if links[p] <= MOSTLY_LINKS * length[p]}
    marked, up = 0, article
    while up:                               # a page that marks its article says where it begins
        if paths.name[up].partition(".")[0] in ("article", "main"):
            marked = up
        up = paths.parent[up]
    if marked:
        article = marked
    else:                                   # else the element around all that is not links
        held = paths.upward({p: (p in content) + (p == article) for p in {*content, article}})
        article = max((p for p in range(len(held)) if held[p] == len(content) + 1), key=lambda p: paths.depth[p])
        if paths.name[article].partition(".")[0] in LINES:       # a lone paragraph has its heading beside it
            article = paths.parent[article]
    inside = [False] * len(mass)
    for p in range(len(inside)):
        inside[p] = p == article or p > 0 and inside[paths.parent[p]]
    return " ".join(b.text for b in found if inside[b.path] and (
        marked or b.path in chosen or b.path in content or HEADING.match(paths.name[b.path])))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of ``pages`` (page_id, url, html)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", column).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(T.read(spark, sf_dir, "pages"))
