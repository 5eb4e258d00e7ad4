"""Main text of web pages by block rules in two passes.

Pass one splits a page into blocks and labels each as text, boilerplate or open, by where it stands, its length,
its share of stop words and its share of link text. Pass two gives an open block the label of its nearest decided
neighbours; inside an article these are looked for in the article first.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings

# Frequent function words of several languages.
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with be this by from at or an have not but which you were they
    der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass
    le la les de et en un une que qui dans pour par sur pas au est plus avec ce il sont des du ne se
    el los las y que en un una por con para del se no su al lo como más pero sus
    il di che e per non sono una della con si come da nel alla
    o os as e do da em um uma para com não por mais dos na
    de het een van en in is dat op te zijn met voor niet""".split()
)
# Elements by their part in a page.
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table
    tbody td tfoot th thead title tr ul""".split()
)
_SILENT = frozenset("script style noscript template svg math iframe object canvas select textarea button head title".split())
_RAW = frozenset("script style textarea title noscript template iframe".split())
_AROUND = frozenset("nav footer aside form menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
# Words in class, id or role that name a part of a page which is not its text, and words that may stand
# beside them in such a name. ``comment-list`` is a part of the page; ``related-work`` and ``social-impact`` are not.
_ROLES = frozenset(
    """ad ads adbox adslot adunit adblock advert adverts advertisement advertising advertorial banner banners sponsor sponsored
    sponsors promo promos promotion cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay nav navbar
    navigation navigator navi menu menus breadcrumb breadcrumbs side sidebar sidebars widget widgets foot footer share sharing
    social related recommend recommended recommendations newsletter subscribe subscription signup login search pagination pager
    copyright disclaimer complementary contentinfo""".split()
)
_COMMENTS = frozenset("comment comments reply replies respond disqus".split())
_TOP_ROLES = frozenset("header masthead topbar toolbar hero".split())
_BESIDE = frozenset(
    """post posts page pages site user users reader readers article articles main global primary secondary top bottom left right
    entry story item items list lists link links box boxes bar bars section sections container wrapper wrap inner outer area
    block blocks holder panel form field button buttons icon icons slot unit group row col column count title thread body
    content text message msg in up by out mobile desktop sticky fixed small large the""".split()
)
#: Elements that hold text themselves; inside an article their names tell what they say, not what they are.
_TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote figcaption caption li dt dd td th".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
    r"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<self>/?)>",
    re.S,
)
_LOOSE = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>[^>]*)(?P<self>/?)(?:>|$)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_P_CLOSERS = _BLOCK - {"body", "html", "head", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}

GOOD, BAD, OPEN = 1, -1, 0
LONG_CHARS = 140
SHORT_CHARS = 60
STOP_LOW = 0.15
STOP_HIGH = 0.25
LINKS_HIGH = 0.5


class Block:
    __slots__ = ("text", "linked", "around", "main", "label")

    def __init__(self, text: str, linked: int, around: bool, main: int):
        self.text, self.linked, self.around, self.main = text, linked, around, main
        self.label = OPEN


def _names(value: str, roles: frozenset) -> bool:
    """Whether a name in the value is made of ``roles`` and words that may stand beside them."""
    for token in value.split():
        words = [w.lower() for w in re.findall("[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\\W_]+", token)]
        if any(w in roles for w in words) and all(w in roles or w in _ROLES or w in _BESIDE or w.isdigit() for w in words):
            return True
    return False


def _hidden_or_role(name: str, attrs: str, in_main: bool) -> bool:
    if name in _AROUND or (name == "header" and not in_main):
        return True
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name in ("article", "main"):  # of the roles only that of a reader's comment
            if _names(value, _COMMENTS):
                return True
        elif name not in ("body", "html", "h1") and not (in_main and name in _TEXTUAL):
            if _names(value, _ROLES | _COMMENTS) or (not in_main and _names(value, _TOP_ROLES)):
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Unclosed and misnested tags, cut-off pages and stray ``<`` are allowed."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, silent, around, main
    silent = around = main_depth = links = section = 0
    parts: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, around > 0, section if main_depth else 0))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not silent:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len("".join(text.split()))

    def pop(k: int) -> None:
        nonlocal silent, around, main_depth
        while len(stack) > k:
            _, s, a, m = stack.pop()
            silent -= s
            around -= a
            main_depth -= m

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = _TOKEN.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        got = m.groupdict()
        name = got.get("name")
        if name is None:
            if got.get("cdata"):
                add(html.escape(got["cdata"]))
            continue
        name = name.lower()
        if got["close"]:
            if name == "a":
                links = max(0, links - 1)
            elif name in _BLOCK or name in _SILENT:
                end()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop(k)
                        break
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            links += 1
            continue
        if name in _VOID:
            if name == "hr":
                end()
            continue
        if name in _RAW and not got["self"]:  # its content is not markup
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name in _BLOCK or name in _SILENT:
            end()
            links = 0
            if name == "body":  # ends a head that was not closed
                pop(0)
            if name in _P_CLOSERS and stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            elif name in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                pop(len(stack) - 1)
            mine = name in _MAIN
            if mine and not main_depth:
                section += 1
            if got["self"] and name not in ("p", "div"):
                continue
            s, a = name in _SILENT, _hidden_or_role(name, got["attrs"] or "", main_depth > 0 or mine)
            stack.append((name, s, a, mine))
            silent += s
            around += a
            main_depth += mine
    end()
    return out


def _shares(b: Block) -> tuple[float, float]:
    """Share of stop words among the words, and of link text among the characters."""
    words = b.text.lower().split()
    stop = sum(w.strip(".,;:!?\"'()%*#&$") in STOP_WORDS for w in words) / max(len(words), 1)
    return stop, b.linked / max(len("".join(words)), 1)


def _other_script(text: str) -> bool:
    """Whether most letters are beyond the Latin ones, where the list of stop words has none."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" for c in letters) > len(letters)


def classify(found: list[Block]) -> list[Block]:
    """Both passes; every block has a label of ``GOOD`` or ``BAD`` afterwards."""
    any_main = any(b.main and not b.around for b in found)
    shares = [_shares(b) for b in found]
    # the list of stop words says nothing about a page on which no longer text has any
    listed = any(len(b.text) >= SHORT_CHARS and stop >= STOP_LOW and links <= LINKS_HIGH for b, (stop, links) in zip(found, shares))
    for b, (stop, links) in zip(found, shares):
        size = len(b.text)
        foreign = not listed or _other_script(b.text)
        if b.around or (any_main and not b.main):
            b.label = BAD
        elif b.main:
            if links <= LINKS_HIGH and size >= SHORT_CHARS and (stop >= STOP_LOW or foreign):
                b.label = GOOD
        elif links > LINKS_HIGH or "©" in b.text[:40]:
            b.label = BAD
        elif foreign:
            if size >= SHORT_CHARS:
                b.label = GOOD
        elif size >= LONG_CHARS:
            b.label = GOOD if stop >= STOP_LOW else OPEN if stop else BAD
        elif size >= SHORT_CHARS and stop >= STOP_HIGH:
            b.label = GOOD
    _inherit(found)
    return found


def _inherit(found: list[Block]) -> None:
    """An open block takes the label both nearest decided neighbours have, else the nearer one's; in an article
    those outside don't count, and with none inside it is text."""
    n = len(found)
    before: list[int | None] = [None] * n
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        before[i] = last.get(b.main)
        if b.label != OPEN and not (b.main and b.around):
            last[b.main] = i
    after: list[int | None] = [None] * n
    last = {}
    for i in range(n - 1, -1, -1):
        b = found[i]
        after[i] = last.get(b.main)
        if b.label != OPEN and not (b.main and b.around):
            last[b.main] = i
    decided = [b.label for b in found]
    for i, b in enumerate(found):
        if decided[i] != OPEN:
            continue
        left, right = before[i], after[i]
        near = [decided[k] for k in (left, right) if k is not None]
        if not near:
            b.label = GOOD if b.main else BAD
        elif b.main:
            b.label = GOOD if GOOD in near else BAD if b.linked else GOOD
        elif len(set(near)) == 1:
            b.label = near[0]
        else:
            b.label = decided[left] if i - left <= right - i else decided[right]


def main_text(page: str) -> str:
    """Text blocks of a page, one per line."""
    return "\n".join(b.text for b in classify(blocks(page)) if b.label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row; null or blank html gives empty text.

    One pass over the rows without a shuffle; repeated rows repeat their result, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(x) for x in strings(part.column("html"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
