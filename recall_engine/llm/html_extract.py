"""Main text of web pages by two-pass block rules.

A scan of the markup cuts a page into blocks at block-level tags. The first pass labels each block from where it
stands and what it looks like: blocks inside menus, footers, asides, forms, adverts, notices and comments (by tag, role
or the words of class and id, also those of an article element) are out; all others are judged by length, link density
and the share of stop words, and short ones without links stay open. The second pass gives each open block the label of
its nearest decided neighbours: in if both sides are in, or if the nearer one is; where no block is decided, all are in.

Standing inside an article or main element is only a leaning: there a block is out in the first pass only where more than
half of it is links, headings stay open, long blocks are in whatever their stop words, and the rest stays open. An open
one is out only if its nearest decided neighbours inside are out on both sides, or for a heading, if the next one is. Blocks outside
are judged as on a page without such an element.

Defined results: null html and pages without text give an empty string; character references are decoded once;
white space inside a block becomes one space; nothing of a kept block is dropped or cut, however long; form controls, titles
of drawings and what media elements hold for readers that can't show them are no text; unclosed and stray tags are tolerated,
in time that grows with the page alone; ids and urls pass through as they are, also null or repeated ones; extra columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all an and are as at be been but by can for from had has have he her his if in is it its more no not of on or
    she so that the their there they this to was we were which who will with you
    als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach
    nicht noch nur oder sich sie sind so über um und von vor war werden wie wird zu zum zur
    au aux avec ce cette ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas plus
    pour qu que qui sa se ses son sont sur un une vous
    al como con cuando del desde donde el ella entre era es esta este esto ha hasta hay lo los las más muy no nos o para pero
    por porque se sin sobre su sus también un una uno y ya""".split()
)
#: Elements whose content a page doesn't show as text: scripts, styles, metadata, form controls, and what media elements have for
#: readers that can't show them.
RAW = frozenset("script style noscript template iframe canvas head title textarea select option button audio video datalist".split())
OUT_TAGS = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frame h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
_OUT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|side-bar|nav(?:bar|igation)?|menu|breadcrumbs?|"
    r"footer|masthead|cookies?|consent|gdpr|notices?|popup|modal|overlay|comments?|disqus|replies|respond|share|sharing|social|related|recommend(?:ed|ations)?|"
    r"newsletter|subscribe|subscription|signup|login|widget|toolbar|pagination|pager|hidden)(?=$|[\s_-])",
    re.I,
)
_IN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|article-?body|post-?(?:body|content)|entry-?content|story-?body|main-?content|main)(?=$|[\s_-])", re.I)
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: A tag after its "<": closing or not, name, attributes; values in quotes may hold ">". Nothing is read twice.
_TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
#: The same where a quote is never closed.
_BROKEN_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_CUT = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: Parameters of the first pass: code points, shares of words and of letters in links.
SHORT, LONG, STOP_LOW, STOP_HIGH, MAX_LINKS, MAX_LINKS_INSIDE = 70, 200, 0.30, 0.32, 0.2, 0.5
#: Class words that tell of a page's layout, not of the element that has them.
_LAYOUT = re.compile(r"(?<!\S)(?:has|no|with|without|show|hide)-\S+", re.I)


class Block:
    """What a page says between two block-level tags, and where."""

    __slots__ = ("text", "links", "out", "inside", "heading")

    def __init__(self, text: str, links: int, out: bool, inside: bool, heading: bool):
        self.text, self.links, self.out, self.inside, self.heading = text, links, out, inside, heading


def _place(tag: str, attrs: str, in_article: bool) -> str:
    """"out", "in" or "" for an element."""
    if tag in OUT_TAGS or tag == "header" and not in_article:
        return "out"
    said = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTR.findall(attrs)} if attrs else {}
    if "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in said.get("style", "").replace(" ", "").lower():
        return "out"
    role = said.get("role", "").lower()
    if role in _OUT_ROLES:
        return "out"
    if tag == "main" or role == "main":
        return "in"
    names = f"{said.get('class', '')} {said.get('id', '')}"
    article = tag == "article" or role == "article" or said.get("itemprop", "").lower() == "articlebody"
    if tag not in ("html", "body") and _OUT_WORDS.search(_LAYOUT.sub("", names) if article else names):
        return "out"
    if article:
        return "in"
    return "in" if tag not in ("html", "body") and _IN_WORDS.search(names) else ""


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each piece of markup, in one pass; comments, declarations and elements of RAW,
    whole, have no name. The page's end comes last, from where a tag may be cut off. Between the pieces lies text.

    Whatever is looked for and isn't there is not looked for again, so the time grows with the page alone.
    """
    at, last = 0, page.rfind(">")
    tag_form, cdata, missing = _TAG, True, set()
    while 0 <= (i := page.find("<", at)) < last:
        head = page[i + 1 : i + 9]
        if head.startswith("!--"):
            end = page.find("-->", i + 2)
            end = len(page) if end < 0 else end + 3
            yield i, end, False, "", ""
        elif cdata and head == "![CDATA[":
            end = page.find("]]>", i)
            cdata = end >= 0
            if not cdata:
                continue
            end += 3
            yield i, end, False, "", ""
        elif head[:1] in ("!", "?") or head[:1] == "/" and not (head[1:2].isascii() and head[1:2].isalpha()):
            end = page.find(">", i) + 1
            yield i, end, False, "", ""
        elif m := tag_form.match(page, i + 1):
            end, tag, closing = m.end(), m[2].lower(), m[1] == "/"
            if tag in RAW and not closing and not m[3].endswith("/"):
                shut = None if tag in missing else re.compile(rf"</{tag}\s*+>", re.I).search(page, end)
                if shut or tag in ("script", "style"):
                    end = shut.end() if shut else len(page)
                elif not shut:
                    missing.add(tag)
                tag = ""
            yield i, end, closing, tag, m[3]
        elif head[:1] == "/" or head[:1].isascii() and head[:1].isalpha():
            tag_form = _BROKEN_TAG  # a quote that no other closes: from here on a tag ends at the next ">"
            continue
        else:
            end = page.find("<", i + 1)  # a mere sign
            at = i + 1 if end < 0 else end
            continue
        at = end
    cut = _CUT.search(page, max(at, last + 1))
    if cut:
        yield cut.start(), len(page), False, "", ""
    else:
        yield len(page), len(page), False, "", ""


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []  # open elements that matter, and their places
    opened: dict[str, int] = {}  # how many of each are open
    parts: list[str] = []
    state = {"out": 0, "in": 0, "a": 0, "links": 0, "head": 0, "br": False}

    def end() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, state["links"], state["out"] > 0, state["in"] > 0, state["head"] > 0))
            parts.clear()
        state["links"], state["br"] = 0, False

    def text(t: str) -> None:
        parts.append(t)
        if state["a"]:
            state["links"] += len(t.strip())
        if not t.isspace():
            state["br"] = False

    def pop(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                for name, place in stack[i:]:
                    opened[name] -= 1
                    state["out"] -= place == "out"
                    state["in"] -= place == "in"
                    state["a"] -= name == "a"
                    state["head"] -= name in ("h1", "h2", "h3", "h4", "h5", "h6")
                del stack[i:]
                return

    at_text = 0
    for start, at, closing, tag, attrs in tags_of(page):
        if start > at_text:
            text(page[at_text:start])
        at_text = at
        if not tag:
            continue
        if tag == "br":
            if state["br"]:
                end()
            else:
                parts.append("\n")
                state["br"] = True
            continue
        if tag in BLOCKS:
            end()
        if tag in VOID:
            continue
        if closing:
            if opened.get(tag):
                pop(tag)
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            pop(tag)
        if tag == "a" and state["a"]:
            pop("a")
        place = _place(tag, attrs, state["in"] > 0)
        if place == "in" and state["out"] and tag in ("article", "main"):  # what stood open before it was never closed
            while stack and state["out"]:
                pop(stack[-1][0])
        stack.append((tag, place))
        opened[tag] = opened.get(tag, 0) + 1
        state["out"] += place == "out"
        state["in"] += place == "in"
        state["a"] += tag == "a"
        state["head"] += tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    end()
    return found


def classify(blocks: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    first = [_first(b) for b in blocks]
    decided = [i for i, x in enumerate(first) if x is not None]
    inside = [i for i in decided if blocks[i].inside and not blocks[i].out]
    out, j, k = [], 0, 0
    for i, label in enumerate(first):
        while j < len(decided) and decided[j] < i:
            j += 1
        while k < len(inside) and inside[k] < i:
            k += 1
        if label is None and blocks[i].inside:
            before, after = k == 0 or bool(first[inside[k - 1]]), k == len(inside) or bool(first[inside[k]])
            label = after if blocks[i].heading else before or after
        elif label is None:
            left = decided[j - 1] if j else None
            right = decided[j] if j < len(decided) else None
            if left is None or right is None:
                near = left if right is None else right
                label = near is None or bool(first[near])
            elif first[left] == first[right]:
                label = bool(first[left])
            else:
                label = bool(first[right] if right - i < i - left or blocks[i].heading else first[left])
        out.append(label)
    return out


def _first(b: Block) -> bool | None:
    if b.out:
        return False
    density = b.links / len(b.text)
    if b.inside:
        if b.heading:
            return None
        if density > MAX_LINKS_INSIDE:
            return False
    elif density > MAX_LINKS or "©" in b.text:
        return False
    if len(b.text) < SHORT:
        return False if density > 0 and not b.inside else None
    if b.inside and len(b.text) > LONG:
        return True
    words = _WORD.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stop >= STOP_HIGH or len(b.text) > LONG and stop > STOP_LOW / 3:
        return True
    return None if b.inside or stop >= STOP_LOW or len(b.text) > LONG else False


def main_text(page: str | None) -> str:
    """The kept blocks of a page, with a line feed between."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(blocks, classify(blocks), strict=True) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id_col, url_col, text, n_chars."""
    fields = [pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in fields])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, T.StructType(fields))
