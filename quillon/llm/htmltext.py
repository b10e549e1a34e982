"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags, whatever is left open or misnested. Elements that say what
they are (navigation, footers, asides, forms, hidden or so named by class, id or role) are boilerplate as a
whole. Pass one judges every other block by itself: many linked characters are bad; long prose with enough
stop words is good, shorter prose nearly good; few stop words are bad; what is too short to tell is short.
Pass two decides the rest: nearly good and short blocks inherit the label of their nearest decided
neighbours of the same section (an article, or what lies outside of all). Where both sides differ, nearly
good blocks are kept and short ones follow the nearer side.

What is particular here: inside an article or main element a long block of few stop words is ambiguous, not
bad, and a section without any decided block is kept. On a page of hardly any known stop word the language
is taken as unknown and stop words do not count. Where sections hold at least half of a page's good
characters, what lies outside of them is dropped.

Defined results: a null or empty page, and one without any kept block, has the text ''; pages that repeat have
equal texts; a page is handled whole, in time that grows with its length; an empty table gives an empty
result; all columns but the page itself come back under `page`, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textcols as tc
from quillon.llm.tables import table

MOST_LINKED = 0.2
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.2, 0.3
#: Share of stop words in a whole page below which its language counts as unknown.
UNKNOWN = 0.04

#: Frequent words of English, German, French, Spanish, Italian and Portuguese.
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with his they at be this have from or had by but not what were we when your can there an which their if will how about
    der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über
    le la les de des et en un une du que qui dans est pour pas sur par plus au il ne se ce avec son sont aux cette mais ou nous
    el los las y una por con para como su lo del más al pero sus este ya o cuando muy sin sobre también me
    il che di non per gli sono della si nel alla dei anche più
    os um uma não com mais foi ao ele tem à seu sua ser""".split()
)

RAW = "script|style|textarea|title|iframe|xmp"
#: The rest of a tag; one that the page ends in is dropped with all that it swallowed, so no tag is looked at twice.
TAG = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^'">]++)*+(?:>|\Z)"""
#: Elements deeper than this are not opened.
DEEPEST = 512
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b{TAG}.*?(?:</(?P=raw)\b[^>]*>|\Z)|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>{TAG})|<(?:[!?]|/(?=[^\s]))[^>]*+(?:>|\Z)""",
    re.I | re.S,
)
ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARTS = re.compile(r"[^a-zA-Z]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Where short text counts as the main text of a page that has no other.
TEXT = frozenset(("", "body", "p", "h1", "h2", "h3", "blockquote", "pre"))
SECTIONS = frozenset(("article", "main"))
#: Elements that are boilerplate by their name.
SAID = frozenset("nav aside footer dialog menu search head template noscript select button option datalist object svg math canvas audio video form".split())
#: Parts of a class or id, and roles, that say boilerplate.
NAMED = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead topbar
    toolbar cookie cookies consent gdpr notice notification alert popup modal overlay comment comments commentlist disqus respond reply replies share sharing social related
    recommended recommendations newsletter subscribe subscription signup login search widget pagination pager skip copyright disclaimer legal tags""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: An opening tag closes an open one of these, up to the nearest of the second set.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt",), ("dl",)), "dd": (("dd",), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td",), ("tr", "table")), "th": (("th",), ("tr", "table")), "option": (("option",), ("select", "datalist"))}

GOOD, NEAR, BRIEF, BAD = 3, 2, 1, 0


class _Open:
    """An open element: its cue (0 none, 1 by class, id or form, 2 by what it is), whether its own end tag came and whether a section lies in it."""

    __slots__ = ("closed", "cue", "depth", "holds", "name", "section", "up")

    def __init__(self, name: str, up: _Open | None, cue: int, section: int):
        self.name, self.up, self.cue, self.section, self.closed, self.holds = name, up, cue, section, False, False
        self.depth = up.depth + 1 if up is not None else 0

    def boilerplate(self) -> bool:
        at = self
        while at is not None:
            if at.cue == 2 or at.cue == 1 and not (at.holds and (at.name == "form" or not at.closed)):
                return True
            at = at.up
        return False


def _cue(name: str, attrs: str, in_section: bool) -> int:
    if name == "header":
        return 0 if in_section else 2
    found = 2 if name in SAID and name != "form" else 1 if name == "form" else 0
    if len(attrs) > 3 and name not in ("html", "body", "main"):
        for key, *values in ATTR.findall(attrs):
            key, value = key.lower(), values[0] or values[1] or values[2]
            if key in ("class", "id"):
                parts = set(PARTS.split(CAMEL.sub(" ", value).lower()))
                found = max(found, int(not parts.isdisjoint(NAMED) and parts.isdisjoint(("has", "no", "with", "without"))))
            elif key == "role":
                found = max(found, int(value.lower() in ROLES))
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and NOT_SHOWN.search(value):
                found = 2
    return found


def blocks(html: str) -> list[tuple[str, str, int, _Open]]:
    """(text, tag, linked characters, innermost open element) of every block that has text, in page order."""
    out: list[tuple[str, str, int, _Open]] = []
    at: _Open = _Open("", None, 0, 0)
    parts: list[str] = []
    linked: list[str] = []
    tag, links, breaks, sections = "", 0, 0, 0
    n_open: Counter[str] = Counter()

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, tag, len(" ".join(unescape(" ".join(linked)).split())), at))
            parts, linked = [], []

    def back_to(names: tuple, stops: tuple) -> None:
        nonlocal at
        found = at
        while found.up is not None and found.name not in names:
            if found.name in stops:
                return
            found = found.up
        if found.up is not None:
            while at is not found.up:
                n_open[at.name] -= 1
                at = at.up

    end = 0
    for m in TOKEN.finditer(html):
        if m.start() > end:
            piece = html[end : m.start()]
            parts.append(piece)
            if breaks and not piece.isspace():
                breaks = 0
            if links:
                linked.append(piece)
        end = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                flush()
            continue
        is_block = name in BLOCKS
        if is_block:
            flush()
            breaks = 0
        if m["end"]:
            if name == "a":
                links = 0
            if n_open[name]:
                found = at
                while found.name != name:
                    found = found.up
                found.closed = True
                back_to((name,), ())
            if is_block:
                tag = at.name
            continue
        if name == "a":
            links = 1
        if name in VOID:
            continue
        if is_block:
            if n_open["p"]:
                back_to(("p",), ("td", "th", "table", "button"))
            if name in CLOSES and n_open[name]:
                back_to(*CLOSES[name])
            tag = name
            links = 0
        attrs = m["attrs"].removesuffix(">")
        if attrs.endswith("/") and name in ("svg", "math", "object"):
            continue
        cue = _cue(name, attrs, at.section > 0)
        section = at.section
        if name in SECTIONS and not cue:
            sections += 1
            section = sections
            up = at
            while up is not None:
                up.holds = True
                up = up.up
        if (is_block or cue) and at.depth < DEEPEST:
            at = _Open(name, at, cue, section)
            n_open[name] += 1
    if end < len(html):
        parts.append(html[end:])
        if links:
            linked.append(html[end:])
    flush()
    return out


def _first_pass(found: list) -> tuple[list[int], list[int]]:
    """(label of each block, its section); -1 as a section for boilerplate."""
    labels, section, counts = [], [], []
    for text, _, n_linked, at in found:
        if at.boilerplate():
            counts.append((0, 0))
            section.append(-1)
        else:
            words = LETTERS.findall(text.lower())
            counts.append((len(words), sum(map(STOP_WORDS.__contains__, words))))
            section.append(at.section)
    known = sum(s for _, s in counts) > UNKNOWN * sum(n for n, _ in counts)
    for (text, _, n_linked, _), s, (n, stops) in zip(found, section, counts, strict=True):
        density = stops / n if n else 0.0
        if s < 0 or n_linked > MOST_LINKED * len(text):
            labels.append(BAD)
        elif len(text) < SHORT:
            labels.append(BAD if n_linked and not s else BRIEF)
        elif not known or density >= STOPS_HIGH:
            labels.append(GOOD if len(text) > LONG else NEAR)
        elif density >= STOPS_LOW:
            labels.append(NEAR)
        else:
            labels.append(BRIEF if s else BAD)
    return labels, section


def _second_pass(labels: list[int], section: list[int], found: list) -> list[bool]:
    """Is each block kept?"""
    n = len(labels)
    inside = sum(len(f[0]) for f, x, s in zip(found, labels, section, strict=True) if x == GOOD and s > 0)
    outside = sum(len(f[0]) for f, x, s in zip(found, labels, section, strict=True) if x == GOOD and s == 0)
    only_sections = any(s > 0 for s in section) and inside >= outside
    # the nearest decided block of the section before and after each: (distance, label); boilerplate is a neighbour of what lies in no section
    sides: list[list[tuple[int, int]]] = [[(n + 1, -1)] * n, [(n + 1, -1)] * n]
    for side, order in zip(sides, (range(n), range(n - 1, -1, -1)), strict=True):
        last: dict[int, int] = {}
        for i in order:
            s = max(section[i], 0)
            if s in last:
                side[i] = (abs(i - last[s]), labels[last[s]])
            if labels[i] in (GOOD, BAD):
                last[s] = i
    any_good = GOOD in labels
    kept = []
    for i, label in enumerate(labels):
        s = section[i]
        if label in (GOOD, BAD):
            keep = label == GOOD
        else:
            (d0, before), (d1, after) = sides[0][i], sides[1][i]
            if s > 0 and BAD == max(before, after):
                keep = True  # all that is decided in the section are lists of links
            elif before < 0 and after < 0:
                keep = s > 0 or not any_good and (label == NEAR or found[i][1] in TEXT)
            elif label == NEAR or s > 0:
                keep = GOOD in (before, after) or label == NEAR and not any_good
            else:
                keep = (after if found[i][1] in HEADINGS or d1 < d0 else before) == GOOD
                if not any_good:
                    keep = found[i][1] in TEXT
        kept.append(keep and s >= 0 and (s > 0 or not only_sections))
    return kept


def page_text(html: str | None) -> tuple[str, int, int]:
    """(main text, blocks, kept blocks) of a page."""
    found = blocks(html) if html else []
    if not found:
        return "", 0, 0
    labels, section = _first_pass(found)
    texts = [f[0] for f, keep in zip(found, _second_pass(labels, section, found), strict=True) if keep]
    return "\n".join(texts), len(found), len(texts)


def main_text(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """page (all columns but html), text, n_blocks and n_kept of every page."""
    rest = [c for c in pages.columns if c != html]
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("page"), F.col(f"`{html}`").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [page_text(h.as_py()) for h in batch.column(1)]
            texts, n, kept = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())], ["page", "text", "n_blocks", "n_kept"])

    return whole.mapInArrow(tc.tidied_batches(run), f"page {whole.schema['page'].dataType.simpleString()}, text string, n_blocks long, n_kept long")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")
