"""Main-text extraction: the maximum-scoring contiguous region of a page's words and tags.

A page is a sequence of tokens: words and tags. Words score positive, tags negative, both by weights learned from labelled
pages: pages that mark their own content with one `article` or `main` element label every token of theirs as inside or
outside. A word's weight depends on the kind of element that it stands in, a tag's on its name; the weight is the smoothed
log odds of being inside. Tags that follow each other without a word between them count once for each name, so that no number of
empty cells or line breaks outweighs the words behind them. One linear scan finds the contiguous run with the largest sum; an article
or main element that holds it, or that it enters, is taken whole. Elements that are never content
(scripts, styles, forms, menus, and those whose class or id as a whole names an advert, notice or comment) are taken out first: they
neither add to a sum nor take from it, and end a block. What is left of the region is joined by blocks.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that weights are learned from: at most so many, those with the smallest hash of their identifier.
SAMPLE = 2_000

# Element names of the HTML standard by role, and words that name boilerplate in a class or id.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "title", "xmp", "noembed", "noframes")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
)
BOILERPLATE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head")
HINTS = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar",
    "aside", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "comment", "comments",
    "commentlist", "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal",
    "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "widget", "toolbar",
    "pagination", "pager", "copyright", "legal", "disclaimer", "skip", "search",
)
#: Hints that name boilerplate wherever they stand; inside an article or main only these count.
PLAIN = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "sidebar", "navbar", "breadcrumb",
    "breadcrumbs", "comment", "comments", "commentlist", "disqus", "respond", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "popup", "newsletter", "pagination", "pager",
)
#: Words beside a hint that say nothing about what an element holds. With any other word a name is not boilerplate as a whole.
FRAME = (
    "area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "col", "container", "content", "div", "fixed", "form", "global", "group",
    "inline", "inner", "item", "items", "left", "links", "list", "main", "mobile", "module", "outer", "overlay", "panel", "primary", "reader", "readers",
    "right", "row", "secondary", "section", "site", "slot", "sticky", "thread", "top", "unit", "user", "users", "visitor", "visitors", "wrap", "wrapper",
)
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog")
CONTENT = ("article", "main")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements whose start closes an open p.
CLOSES_P = frozenset((
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", *HEADINGS, "header", "hgroup", "hr", "li", "listing", "main", "menu", "nav", "ol", "p", "plaintext", "pre", "search", "section",
    "summary", "table", "ul", "xmp",
))
#: What a start tag closes besides: the names, and the elements beyond which it doesn't look.
LISTS, TABLE, ROWS = ("ul", "ol", "menu", "dir"), ("table",), ("tbody", "thead", "tfoot")
IMPLIED = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("optgroup", "datalist")),
    "optgroup": (("optgroup", "option"), ("datalist",)), "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)),
    "td": (("td", "th"), ("tr", *TABLE)), "th": (("td", "th"), ("tr", *TABLE)), "tr": (("tr", "caption", "colgroup"), (*ROWS, *TABLE)),
    **{name: ((*ROWS, "caption", "colgroup"), TABLE) for name in (*ROWS, "caption", "colgroup")}, "button": (("button",), ()), "a": (("a",), ()),
}
#: Elements that neither an implied end nor an end tag from inside reaches beyond.
SCOPES = frozenset(("table", "td", "th", "caption"))
SCOPES_OF_P = SCOPES | {"button"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)", re.I)
NAMES = re.compile(r"[a-z]+|[0-9]+")
SPACES = re.compile(r"[\t\n\f\r ]+")


def is_boilerplate(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element never holds content.

    inside: it stands within an article, where a header may hold the title and only PLAIN hints count. A class or id counts if
    all its words are hints, frame words or numbers, with a hint among them; on headings none does.
    """
    if name in BOILERPLATE:
        return not (inside and name == "header")
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = "".join(values).lower(), key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and name not in (*CONTENT, *HEADINGS, "body", "html"):
            for one in value.split():
                parts = [x for x in NAMES.findall(one) if x not in FRAME and not x.isdigit()]
                if parts and all(x in HINTS for x in parts) and (not inside or any(x in PLAIN for x in parts)):
                    return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, bool, tuple[int, ...]]]:
    """(kind, value, dropped, content) for each token: kind "tag" with a name, or "text" with the decoded text.

    dropped: within an element that never holds content. content: the article and main elements that it is in, by number.
    """
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, boilerplate, content
    dropped = number = 0
    content: tuple[int, ...] = ()
    raw = ""
    count: Counter = Counter()  # of the open elements by name

    def close(at: int, upto: int | None = None) -> None:
        nonlocal dropped, content
        for name, bad, own in stack[at:upto]:
            dropped -= bad
            content = content[:-1] if own else content
            count[name] -= 1
        del stack[at:upto]

    def innermost(names: tuple[str, ...], beyond: Container[str]) -> int | None:
        """The place of the innermost open element of these names that isn't outside of one of `beyond`."""
        if any(count[n] for n in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in names:
                    return k
                if stack[k][0] in beyond:
                    return None
        return None

    for m in TOKEN.finditer(page):
        closing, name = m[1], (m[2] or "").lower()
        if raw:
            if name == raw and closing:
                raw = ""
                yield "tag", name, True, content
            continue
        if not name:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                continue  # a comment or declaration
            yield "text", entities.unescape(text), dropped > 0, content
        elif closing:
            table_part = name in SCOPES or name in ROWS or name == "tr"
            at = innermost(HEADINGS if name in HEADINGS else (name,), TABLE if table_part and name != "table" else () if name == "table" else SCOPES)
            inline = name in INLINE
            if at is not None and not inline:
                close(at + 1)  # whatever was left open in it
            yield "tag", "/" + name, dropped > 0, content
            if at is not None:
                close(at, at + 1)  # blocks within an inline element stay open
        else:
            own_end = m[3].rstrip().endswith("/")
            if name in CLOSES_P and (at := innermost(("p",), SCOPES_OF_P)) is not None:
                close(at)
            if name in IMPLIED and (at := innermost(IMPLIED[name][0], IMPLIED[name][1] or SCOPES)) is not None:
                close(at, at + 1 if name == "a" else None)
            elif name in HEADINGS and stack and stack[-1][0] in HEADINGS:
                close(len(stack) - 1)
            if name in RAW:
                raw = "" if own_end and name in ("svg", "math") else name
                yield "tag", name, True, content
                continue
            bad = is_boilerplate(name, m[3], len(content) > 0)
            if name not in VOID:
                own = not bad and name in CONTENT
                stack.append((name, bad, own))
                count[name] += 1
                dropped += bad
                if own:
                    number += 1
                    content = (*content, number)
            yield "tag", name, dropped > 0 or bad, content


def context(name: str) -> str:
    """The feature of a tag: its name without what a page made up."""
    base = name.lstrip("/")
    return name if len(base) <= 10 and base.isalnum() else "/other" if name[0] == "/" else "other"


def counted(page: str) -> Counter:
    """How often each feature stands inside and outside of the page's own content element: (feature, inside)."""
    out: Counter = Counter()
    near, gap = "body", set()
    seen = list(tokens(page))
    if sum(t[0] == "tag" and t[1] in CONTENT for t in seen) != 1:
        return out  # not a labelled page
    for kind, value, dropped, content in seen:
        if dropped:
            continue
        inside = len(content) > 0
        if kind == "tag":
            out["tag " + context(value), inside] += (context(value), inside) not in gap
            gap.add((context(value), inside))
            if value.lstrip("/") not in INLINE:
                near = context(value)
        elif n := len(value.split()):
            out["word " + near, inside] += n
            gap.clear()
    return out


#: Weights of features that no labelled page has.
WORD, TAG = 1.0, -0.1


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Weights by feature. Words score from 0.1 to 2, tags from -2 to -0.02."""
    out = {}
    for feature in {f for f, _ in counts}:
        odds = math.log((counts.get((feature, True), 0) + 1) / (counts.get((feature, False), 0) + 1))
        if feature.startswith("word"):
            out[feature] = min(2.0, max(0.1, odds))
        else:
            out[feature] = -0.02 if odds > 0 else max(-2.0, min(-0.02, odds / 4))
    return out


def region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the largest sum; the longest of equal ones that comes first."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def whole(content: list[tuple[int, ...]], lo: int, hi: int) -> tuple[int, int]:
    """The region taken to the ends of the innermost content element around it, or of those that it enters."""
    if lo >= hi:
        return lo, hi
    a, b = content[lo], content[hi - 1]
    common = [x for x, y in zip(a, b) if x == y]
    first, last = (common[-1], common[-1]) if common else (a[0] if a else 0, b[0] if b else 0)
    while first and lo and first in content[lo - 1]:
        lo -= 1
    while last and hi < len(content) and last in content[hi]:
        hi += 1
    return lo, hi


def extract(page: str | None, learned: dict[str, float]) -> str:
    """The text of the best region: blocks in page order joined by an empty line, white space within a block one space.

    Null, empty and wordless pages give an empty text. Omitted end tags are implied as in HTML; what is still open ends with
    the element around it, or with the page.
    """
    seen = list(tokens(page or ""))
    scores, near, gap = [], "body", set()
    for kind, value, dropped, _ in seen:
        if dropped:
            scores.append(0.0)
        elif kind == "tag":
            scores.append(0.0 if context(value) in gap else learned.get("tag " + context(value), TAG))
            gap.add(context(value))
            if value.lstrip("/") not in INLINE:
                near = context(value)
        else:
            n = len(value.split())
            scores.append(learned.get("word " + near, WORD) * n)
            if n:
                gap.clear()
    lo, hi = whole([content for *_, content in seen], *region(scores))
    blocks, block = [], []
    for kind, value, dropped, _ in seen[lo:hi]:
        if kind == "text":
            if not dropped:
                block.append(value)
        elif value.lstrip("/") == "br":
            block.append(" ")
        elif value.lstrip("/") not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    clean = (SPACES.sub(" ", b).strip(" ") for b in blocks)
    return "\n\n".join(b for b in clean if b)


def learn(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most `sample` pages that label themselves, those with the smallest hash of their identifier.

    The counts that come to the driver are bounded by what so many pages hold.
    """
    marks = F.size(F.regexp_extract_all("html", F.lit(r"(?i)<(article|main)(?=[\s/>])"), F.lit(1)))  # near enough; counted() decides
    ids = pages.where((marks == 1) & F.col("page_id").isNotNull()).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).distinct()
    rows = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                out.update(counted(page or ""))
        keys = list(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([out[k] for k in keys], pa.int64())],
            names=["feature", "inside", "n"],
        )

    each = rows.mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    return weights({(r.feature, r.inside): r.n for r in each.collect()})


def extract_pages(pages: DataFrame, learned: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html, ...).

    Null html gives an empty text. Repeated rows give equal rows, other columns are ignored, an empty table gives no rows.
    """
    learned = learn(pages) if learned is None else learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(page.as_py(), learned) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
