"""Main text of web pages by tag-path ratios.

A page is split into blocks (text between the edges of block-level elements), each
with its root-to-leaf path of block-level tags. Per path the length of the text, the
punctuation, the link text and the number of blocks are aggregated. Two ratios follow:
text per block and punctuation per block, both of text outside links. Each is smoothed
over the sequence of blocks by a Gaussian, the two are fused by a geometric mean, and
a threshold (a share of the page's mean plus deviation) selects paths. The content
root is the deepest element that holds all selected blocks; the blocks below it are
the main text.

Left out by markup, wherever they stand: head, scripts, styles, forms and other
controls, nav, aside, footer and header elements (a header inside an article keeps
its headings), and elements whose class, id or role names an advert, a notice, a
menu, a sidebar or reader comments.

Defined results: null or empty html gives an empty text; so does a page without a
block left. Broken markup is read as browsers read it: a stray ``<`` is text, an
unclosed comment, script or tag runs to the end of the page, unclosed elements end
with their parents, ``p``, ``li`` and the like end where the next one begins. Pages
are independent rows: no exchange. Repeated rows repeat, extra columns pass through,
computed names replace columns of the same name.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import table

#: Width of the smoothing in blocks, and the threshold in deviations above the mean.
SIGMA = 1.0
DEVIATIONS = -0.25

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head script style template noscript iframe object svg math canvas form button select option textarea input label "
    "fieldset dialog nav aside footer menu noembed noframes title audio video map".split()
)
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header hgroup address details summary center hr nav aside footer form fieldset".split()
)
#: An element of the key's kind ends at the start of an element of the value's kind.
CLOSED_BY = {
    "p": BLOCKS - {"html", "body"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body", *BLOCKS]) - {"html"},
}
#: How far up an implied end may reach.
SCOPES = frozenset("table ul ol dl article section div main body html td th blockquote".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion promoted "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall subscribe subscription newsletter signup "
    "menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager toc sidebar aside rail widget widgets "
    "footer header masthead topbar toolbar comment comments commentlist disqus replies reply respond discussion "
    "share sharing social related recommended recommendations popular trending copyright disclaimer search login".split()
)
#: First words of names that tell of another part of the page.
MODIFIERS = frozenset("has with without no not is".split())
#: Names of articles, and words that are topics in front of one.
CONTENT_NAMES = frozenset("article content entry post story".split())
TOPICS = frozenset("search social popular related recommended".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog toolbar".split())

_TOKEN = re.compile(r"<(?:!--|/?[a-zA-Z]|[!?])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))")
_NAME_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？¿¡]")


def _bad_name(token: str) -> bool:
    """Whether a class or id names an unwanted part. Its first and its last word tell what
    it is; words between them, and names that only tell of another part (has-sidebar), don't.
    An article's own header, or an article among search results or on social matters, stays."""
    words = [w.lower() for w in _NAME_SPLIT.split(token) if w]
    if not words or words[0] in MODIFIERS:
        return False
    first, last = words[0], words[-1]
    if first in CONTENT_NAMES and last == "header" or first in TOPICS and last in CONTENT_NAMES:
        return False
    return first in BAD_NAMES or last in BAD_NAMES


def _unwanted(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    low = attrs.lower()
    if "class" not in low and "id" not in low and "role" not in low and "hidden" not in low:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if any(map(_bad_name, value.split())):
                return True
        elif (name == "role" and value.lower() in BAD_ROLES) or (name == "aria-hidden" and value.lower() == "true"):
            return True
    return re.search(r"(?:^|\s)hidden(?:\s|/|$)", _ATTR.sub(" ", low)) is not None


class _Node:
    __slots__ = ("article", "block", "bad", "index", "link", "parent", "path", "tag")

    def __init__(self, tag: str, parent: _Node | None, index: int, bad: bool):
        self.tag, self.parent, self.index = tag, parent, index
        self.block = tag in BLOCKS
        # an article inside a page-wide form is an article; the form's other parts are not
        above = parent.bad if parent is not None else False
        if above == "form" and tag in ("article", "main"):
            above = False
        self.bad = above if above is True or not bad else "form" if tag == "form" else True
        self.link = tag == "a" or (parent is not None and parent.link)
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        above = parent.path if parent is not None else ""
        self.path = f"{above}/{tag}" if self.block else above


def blocks_of(page: str) -> list[tuple[str, tuple[int, ...], str, int]]:
    """(path, ids of the elements above from the root down, text, characters in links)
    of each wanted block, in page order. Character references are decoded."""
    root = _Node("", None, 0, False)
    node, count, found = root, 1, []
    parts: list[str] = []
    linked = 0
    owner = root

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                chain, at = [], owner
                while at is not None:
                    if at.block or at.parent is None:
                        chain.append(at.index)
                    at = at.parent
                found.append((owner.path, tuple(reversed(chain)), text, linked))
        parts, linked = [], 0

    def put(text: str) -> None:
        nonlocal linked, owner
        if text and not node.bad:
            if not parts:
                owner = node
            parts.append(text)
            if node.link:
                linked += len(text)

    at, end = 0, len(page)
    while at < end:
        hit = _TOKEN.search(page, at)
        if hit is None:
            put(page[at:])
            break
        start = hit.start()
        if start > at:
            put(page[at:start])
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            if page.startswith(("<!-->", "<!--->"), start):
                close = page.find(">", start) - 2
            at = end if close < 0 else close + 3
            continue
        if page[start + 1] in "!?":
            close = page.find(">", start)
            at = end if close < 0 else close + 1
            continue
        tag_hit = _TAG.match(page, start) or _LOOSE_TAG.match(page, start)
        if tag_hit is None:
            break  # a tag that never ends
        at = tag_hit.end()
        closing, tag, attrs = tag_hit.group(1), tag_hit.group(2).lower(), tag_hit.group(3)
        if closing:
            up = node
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is None:
                if tag == "br":
                    put(" ")
                continue
            if tag in BLOCKS or up.block or any_block(node, up):
                flush()
            node = up.parent
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                put(" " if tag == "br" else "")
            continue
        up = node
        while up.parent is not None:
            ends = CLOSED_BY.get(up.tag)
            if ends and tag in ends:
                flush()
                node = up.parent
                break
            if up.tag in SCOPES and up.tag != tag:
                break
            up = up.parent
        bad = _unwanted(tag, attrs, node.article)
        if tag in BLOCKS or bad:
            flush()
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            if close is None:
                break
            at = page.find(">", close.start())
            if at < 0:
                break
            at += 1
            continue
        if attrs.endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "em", "strong", "span"):
            continue
        node = _Node(tag, node, count, bad)
        count += 1
    flush()
    return found


def any_block(node: _Node, up: _Node) -> bool:
    while node is not up:
        if node.block:
            return True
        node = node.parent
    return False


def path_scores(blocks: list[tuple[str, tuple[int, ...], str, int]]) -> list[float]:
    """The smoothed and fused tag-path ratio of each block."""
    totals: dict[str, list[float]] = {}
    for path, _, text, linked in blocks:
        t = totals.setdefault(path, [0.0, 0.0, 0.0])
        free = max(0.0, 1.0 - linked / len(text))
        t[0] += len(text) * free
        t[1] += len(_PUNCT.findall(text)) * free
        t[2] += 1
    lengths = [totals[p][0] / totals[p][2] for p, *_ in blocks]
    marks = [totals[p][1] / totals[p][2] for p, *_ in blocks]
    return [math.sqrt(a * (b + 0.1)) for a, b in zip(_smooth(lengths), _smooth(marks), strict=True)]


def _smooth(values: list[float]) -> list[float]:
    reach = math.ceil(2 * SIGMA)
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for w, j in zip(weights, range(i - reach, i + reach + 1), strict=True):
            if 0 <= j < len(values):
                total += w * values[j]
                weight += w
        out.append(total / weight)
    return out


def extract(page: str | None) -> str:
    """The main text of a page: blocks in page order, joined by two line feeds."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    scores = path_scores(blocks)
    best: dict[str, float] = {}
    for (path, *_), s in zip(blocks, scores, strict=True):
        best[path] = max(best.get(path, 0.0), s)
    mean = sum(best[p] for p, *_ in blocks) / len(blocks)
    deviation = math.sqrt(sum((best[p] - mean) ** 2 for p, *_ in blocks) / len(blocks))
    limit = mean + DEVIATIONS * deviation
    selected = [i for i, (p, *_) in enumerate(blocks) if best[p] >= limit]
    if not selected:
        selected = list(range(len(blocks)))
    chains = [blocks[i][1] for i in selected]
    common = set(chains[0]).intersection(*chains)
    root = next(e for e in reversed(chains[0]) if e in common)  # the page is in every chain
    if len(selected) == 1 and len(blocks[selected[0]][1]) > 1:
        root = blocks[selected[0]][1][-2]  # one block alone: its element's siblings belong to it
    return "\n\n".join(text for _, chain, text, _ in blocks if root in chain)


def extract_text(df: DataFrame, *, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """Replace ``html_col`` by ``text_col``, the page's main text."""
    rest = df.drop(text_col)
    at = rest.columns.index(html_col)
    kept = [f for f in rest.schema.fields if f.name != html_col]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                texts = pa.array([extract(x.as_py()) for x in batch.column(at)], pa.string())
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, texts], [*(f.name for f in kept), text_col])

    return rest.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    done = extract_text(pages, text_col="text")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
