"""Main text of HTML pages: flat text blocks classified by a decision tree."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, text_or_empty

# HTML elements that end a block, and those whose content is not text.
_BLOCK = set(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
_SILENT = "script style noscript noframes template svg math iframe object textarea select button canvas audio video title".split()
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_ASIDE = set("nav footer aside form menu dialog".split())
_MAIN = set("article main".split())
# Words in class, id or role that mark what is not the article, and what is; words that say only where or how large a part is.
_ASIDE_WORD = re.compile(
    r"ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|comments?|disqus|repl(?:y|ies)|respond|shar(?:e|ing)|social|side|sidebar\w*|widgets?|related|recommend\w*|newsletter|subscri\w*|sign-?up|log-?in|menus?|nav\w*|breadcrumbs?|foot|footer\w*|masthead|topbar|toolbar|pag(?:er|ination)|copyright|legal|contentinfo|complementary|search|hidden"
)
_PLAIN_WORD = re.compile(
    r"[a-z]|[0-9x]+|site|page|global|main|primary|secondary|left|right|top|bottom|upper|lower|inner|outer|sticky|fixed|float\w*|bar|box|block|area|zone|slot|unit|panel|pane|column|col|row|list|links?|items?|group|sections?|wrap\w*|container|content|body|text|message|form|buttons?|icons?|title|head\w*|thread|tree|post|posts|article\w*|stor(?:y|ies)|media|user|reader|web|mobile|desktop|js|ui|up|in|sign|log|policy|by|and|you|may|like|more|us|follow|email|footer|privacy|trail"
)
_MAIN_WORD = re.compile(r"(?<![a-z])(?:article\w*|main|post|entry|story|content|body-?text)(?![a-z])")


@lru_cache(1 << 16)
def _marks_aside(names: str) -> bool:
    """Whether a class, id or role names a part beside the article: one of its names is made of words for such parts and plain words only.

    ``site-footer`` or ``comment-list`` names a part; ``has-sidebar``, ``overflow-hidden`` or ``comments-closed`` tells of a state, and ``legal-analysis`` of a subject.
    """
    for name in names.split():
        words = [w for w in name.split("-") if w]
        if any(_ASIDE_WORD.fullmatch(w) for w in words) and all(_ASIDE_WORD.fullmatch(w) or _PLAIN_WORD.fullmatch(w) for w in words):
            return True
    return False


# The end tags of head and option may be left out. What a head may hold is silent or void, so it needs no end; an option ends
# at its end tag, else before the next option or group, or where a block ends. An svg or math that closes itself is empty.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<=/)>|<(%s)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<option(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</option\s*>|(?=</?(?:option|optgroup|select|datalist)[\s/>]|</(?:%s)[\s>])|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|</?[a-zA-Z][^>]*(?:>|\Z)"
    % ("|".join(_SILENT), "|".join(sorted(_BLOCK))),
    re.S | re.I,
)
# Elements that end an open p, and for those whose end tag may be left out what they end, and within which.
_ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_P_WITHIN = set("table caption td th button object".split())
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    **{x: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
}
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style|data-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"[\s\x00]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    aside: bool
    main: bool
    head: bool
    label: int | None


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page, in order. White space inside a block is one space; blocks without text are left out.

    If the names of classes put all of the article aside, they are not believed on that page, and only elements and hidden parts count.
    """
    out: list[Block] = []
    by_element: list[bool] = []
    text: list[str] = []
    # (element, marked as aside, so by an element, in the article, label)
    stack: list[tuple[str, bool, bool, bool, int | None]] = [("", False, False, False, None)]
    opened: Counter[str] = Counter()  # how many of each element are open, so that no search runs for nothing
    links = linked = 0
    head = False

    def end(names: set[str], within: set[str]) -> None:
        """End the nearest open element of ``names`` that stands in no nearer element of ``within``, those of ``names`` directly around it, and all inside them."""
        if not any(opened[x] for x in names):
            return
        at = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in within:
                break
            if stack[k][0] in names:
                at = k
            elif at is not None:
                break
        if at is not None:
            opened.subtract(x[0] for x in stack[at:])
            del stack[at:]

    def flush():
        nonlocal text, linked, head
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            if whole:
                n = whole.count(" ") + 1
                _, aside, element, main, label = stack[-1]
                out.append(Block(whole, n, min(linked, n), aside, main, head, label))
                by_element.append(element)
        text, linked, head = [], 0, False

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            part = entities.unescape(page[at : m.start()])
            text.append(part)
            if links:
                linked += len(part.split())
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "a":
            links = 0 if m[2] else 1
        elif name == "br":
            text.append(" ")
        if name not in _BLOCK:
            continue
        flush()
        head = head or (name in ("h1", "h2", "h3", "h4", "h5", "h6") and not m[2])
        if not m[2]:
            if name in _ENDS_P:
                end({"p"}, _P_WITHIN)
            if name in _ENDS:
                end(*_ENDS[name])
        if m[2]:
            if opened[name]:
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)
                opened.subtract(x[0] for x in stack[k:])
                del stack[k:]
        elif name not in _VOID and name != "head" and not m[4].endswith("/"):
            _, aside, element, main, label = stack[-1]
            attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[4])}
            marks = " ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower().replace("_", "-")
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
            element = element or name in _ASIDE or (name == "header" and not main) or hidden
            aside = aside or element or (name not in ("html", "body", "main") and _marks_aside(marks))
            main = main or name in _MAIN or bool(_MAIN_WORD.search(marks))
            stack.append((name, aside, element, main, int(attrs["data-label"]) if "data-label" in attrs else label))
            opened[name] += 1
    if at < len(page):
        text.append(entities.unescape(page[at:]))
    flush()
    if not any(b.main and not b.aside for b in out) and any(b.main and not e for b, e in zip(out, by_element)):
        for b, e in zip(out, by_element):
            b.aside = e
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "aside", "main", "heading", "page_has_main")


def features(blocks: Sequence[Block]) -> np.ndarray:
    """One row a block: its word count and link density, those of its neighbours, and its place in the page."""
    n = len(blocks)
    out = np.zeros((n, len(FEATURES)))
    words = np.array([0, *(b.words for b in blocks), 0], float)
    density = np.array([0, *(b.linked / b.words for b in blocks), 0], float)
    out[:, 0], out[:, 2], out[:, 4] = words[1:-1], words[:-2], words[2:]
    out[:, 1], out[:, 3], out[:, 5] = density[1:-1], density[:-2], density[2:]
    out[:, 6], out[:, 7], out[:, 8] = [b.aside for b in blocks], [b.main for b in blocks], [b.head for b in blocks]
    out[:, 9] = any(b.main and not b.aside for b in blocks)
    return out


_LONG = "The council met again on Tuesday to discuss the new bridge, which will cost more than was planned and open a year later than the town had hoped."
_MID = "Work on the bridge began in spring and stopped in June."


def _page(label_main: str, rest: Sequence[tuple[int, str]]) -> str:
    return "<html><body>" + label_main + "".join(x.replace(">", f' data-label="{y}">', 1) for y, x in rest) + "</body></html>"


# The labelled table: pages whose elements carry the label of their text, 1 for the article.
LABELLED_PAGES = [
    _page("", [(0, "<nav><ul><li><a href=x>Home</a></li><li><a href=y>World news</a></li></ul></nav>"), (1, f"<article><h1>A bridge too dear</h1><p>{_LONG}</p><p>{_MID}</p><p>Nobody.</p></article>"), (0, f"<footer><p>Copyright 2020. {_MID}</p></footer>")]),
    _page("", [(0, "<header><p>The Daily Paper</p><p>Founded in 1901.</p></header>"), (0, f"<div class=ad><p>{_MID} Buy now.</p></div>"), (1, f"<main><p>{_LONG}</p><h2>What comes next</h2><p>{_MID}</p><p>It rained.</p></main>"), (0, f"<aside><p>{_LONG}</p></aside>")]),
    _page("", [(0, "<div class=menu><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div>"), (1, f"<div><p>{_LONG}</p><p>{_MID}</p><p>{_LONG} {_LONG}</p></div>"), (0, f"<div class=comments><p>{_MID} I disagree with all of this.</p><p>{_LONG}</p></div>")]),
    _page("", [(0, "<div><a href=a>Politics</a> <a href=b>Sport</a></div>"), (0, "<div>Share this</div>"), (1, f"<div><p>{_LONG}</p><p>{_LONG}</p><p>{_MID}</p></div>"), (0, "<div><p><a href=q>More about bridges</a></p><p><a href=r>Ten bridges you must see before they fall down</a></p></div>"), (0, "<div>Terms of use</div>")]),
    _page("", [(0, f"<div class=cookie-notice><p>We use cookies. {_MID}</p></div>"), (1, f"<article><p>{_MID}</p><p>Yes.</p><p>See <a href=z>the plan</a> for what the council wants to build there in the end.</p></article>"), (0, f"<form><p>Your name and a message of at least ten words, please, before you send.</p></form>")]),
    _page("", [(0, f"<div id=sidebar><p>{_LONG}</p><p><a href=m>Older posts</a></p></div>"), (1, f"<article><h1>Short</h1><p>It is over.</p></article>"), (0, f"<div class=related><p>{_MID}</p></div>"), (0, "<footer>All rights reserved</footer>")]),
    _page("", [(0, "<div><a href=a>Start</a></div>"), (0, "<div>12 May</div>"), (1, f"<div><h1>The bridge that never was built</h1><p>{_LONG}</p><p>{_LONG}</p></div>"), (0, "<div><a href=b>Next</a></div>"), (0, "<div>Contact</div>")]),
    _page("", [(0, f"<div>Log in</div>"), (0, f"<section class=promo><p>{_LONG}</p></section>"), (1, f"<article><p>{_LONG}</p><ul><li>one reason</li><li>another reason</li></ul><p>{_MID}</p></article>"), (0, f"<article class=comment><p>{_LONG}</p></article>"), (0, "<p>Loading</p>")]),
    _page("", [(1, f"<article><h1>No frame</h1><p>{_MID}</p><p>Alone.</p></article>")]),
    _page("", [(1, f"<div><p>{_LONG}</p><p>{_MID}</p><p>{_LONG}</p></div>")]),
    _page("", [(0, "<div>Menu</div>"), (1, f"<main><p>Only this.</p></main>")]),
    _page("", [(0, "<div><a href=a>Start</a></div>"), (1, f"<div><p>{_MID}</p><p>{_LONG}</p><p>{_MID}</p></div>")]),
    _page("", [(1, f"<article><p>{_LONG}</p><p>So be it.</p></article>"), (0, "<div><a href=b>Back to the start of the page</a></div>"), (0, "<div>Imprint</div>")]),
    _page("", [(1, f"<article><p><a href=c>A plan</a></p><p>{_MID}</p><p><a href=d>Another plan that was dropped</a> too.</p></article>"), (0, f"<div><a href=e>Archive of all plans by year and by town</a></div>")]),
    _page("", [(0, f"<div>{_MID}</div>"), (1, f"<article><p>{_LONG}</p><p>No.</p></article>"), (0, f"<div>{_LONG}</div>")]),
    # without a landmark the neighbours tell: a short block between long ones is the article's, one between links or at the edge is not
    _page("", [(0, "<div><a href=a>Front</a></div>"), (0, "<div>Tuesday edition</div>"), (1, f"<div><p>{_LONG}</p><p>Why now?</p><p>{_LONG}</p><p>The vote was close.</p><p>{_LONG} {_MID}</p></div>"), (0, "<div>Printed in town</div>"), (0, "<div><a href=b>Back</a></div>")]),
    _page("", [(0, "<div>Our offers</div>"), (0, "<div><a href=a>Boats</a> <a href=b>Bridges</a> <a href=c>Ferries</a></div>"), (0, "<div>Pick one</div>"), (0, "<div><a href=d>All about boats and bridges and other ways to cross a river</a></div>"), (1, f"<div><p>{_LONG}</p><p>It did not.</p><p>{_LONG}</p></div>"), (0, "<div>Next up</div>"), (0, "<div><a href=e>The ferry that came too late for the fair</a></div>")]),
    _page("", [(1, f"<div><p>{_LONG} {_LONG}</p><p>So it went.</p><p>Then came the rain.</p><p>{_LONG}</p></div>"), (0, "<div>You are reader number nine</div>"), (0, "<div><a href=a>Up</a></div>")]),
    _page("", [(0, "<div><a href=a>Home</a></div>"), (0, "<div>Weather: fair</div>"), (0, "<div><a href=b>Sport</a></div>"), (0, "<div>Ferry: on time</div>"), (0, "<div><a href=c>Trade</a></div>"), (1, f"<div><p>{_MID} {_MID}</p><p>Few came.</p><p>{_LONG}</p></div>")]),
]
# Where a page has a landmark, the same blocks outside it are not the article.
LABELLED_PAGES += [
    p.replace('data-label="1"', 'data-label="0"').replace("<body>", f'<body><article data-label="1"><p>{_LONG}</p><p>{_MID}</p></article>')
    for p in LABELLED_PAGES
    if "<article" not in p and "<main" not in p
]


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    rows = [(features(b := blocks_of(p)), np.array([x.label for x in b])) for p in LABELLED_PAGES]
    return np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: a leaf is 0 or 1, a node (feature, threshold, at most, above)."""
    if depth == 0 or len(set(y)) == 1:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            p, q = y[low].mean(), y[~low].mean()
            score = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if best is None or score < best[0] - 1e-9:
                best = score, f, float(t)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@lru_cache(1)
def tree():
    return grow(*labelled_blocks())


def classify(x: np.ndarray, node) -> np.ndarray:
    if isinstance(node, int):
        return np.full(len(x), bool(node))
    f, t, low, high = node
    return np.where(x[:, f] <= t, classify(x, low), classify(x, high))


def main_text(page: str, node) -> str:
    """The article's blocks, one a line."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(blocks, classify(features(blocks), node)) if keep) if blocks else ""


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page, from the whole page.

    A page is cut into flat text blocks at block-level elements. Each block has a word
    count, a link density, those of the blocks beside it, and flags of the elements that
    it stands in; a decision tree grown on a small labelled table of pages tells the
    article from menus, headers, footers, sidebars, notices, adverts, forms and comments.
    Scripts, styles, comments and what a page's head may hold are never text; a head without
    its end tag ends at the first element or text that may not stand in it. Character references are decoded, white space in a block is one space, blocks are joined by line feeds.

    Returns ``id_col``, ``url_col``, ``text`` (empty if none), ``n_chars`` (code points).
    Null and empty pages give an empty text. Null ids or urls and repeated rows are kept.
    Other columns are left out. An empty table gives no rows.
    """
    prepare(df.sparkSession)
    node = tree()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), node) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    return out.mapInArrow(extract, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
