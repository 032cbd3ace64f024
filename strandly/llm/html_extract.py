"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare, slices, texts

#: Comments, declarations and tags; an attribute's quoted value may hold ">".
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w-])(hidden)(?![\w=-])""")
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video head select button option datalist".split())
BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre article section main header footer nav aside form fieldset legend figure figcaption address hr details summary body html center menu dialog".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements that a stack of open elements follows; p and headings end by themselves.
HOLDER = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 hr li dt dd tr td th".split()) | frozenset(("a", "span"))
INLINE = frozenset(("a", "span"))
MAIN = frozenset(("article", "main"))
AWAY = frozenset("nav footer aside form menu dialog".split())
#: Words of class, id and role that name what is not the article (fixed values).
AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sidebar menu nav navbar navigation footer contentinfo complementary cookie cookies consent notice notices alert promo promotion popup modal dialog newsletter subscribe subscription share sharing social related recommended comment comments reply replies respond disqus breadcrumb breadcrumbs pagination pager widget sponsor sponsored login signin signup register search toolbar topbar masthead skip".split()
)
HEAD_NAMES = frozenset(("header", "banner", "masthead"))
#: Frequent words by language (fixed values).
STOP = {
    "en": "the of and to a in is it that for was on are as with be by this from or an at not have has but they you which their were had we he she his her its all can will".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son ou aux mais comme elle ses sa cette".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta".split(),
}
SETS = {name: frozenset(ws) for name, ws in STOP.items()}
ALL_STOP = frozenset(w for ws in STOP.values() for w in ws)
#: Limits of the first pass: characters; words of a short block that speak for it, and that speak
#: against it if none is a stop word; share of stop words; share of characters in links.
SHORT, SOME, SEVERAL, STOP_LOW, STOP_HIGH, LINKS = 70, 4, 6, 0.07, 0.20, 0.20
WORD = re.compile(r"[^\W\d_]+")
#: What notices of rights begin with (fixed values).
NOTICE = re.compile(r"\s*(©|\(c\)|copyright\b)", re.I)


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    main: bool = False
    away: bool = False
    text: str = ""
    label: str = ""
    size: int = 0
    stops: list[str] = field(default_factory=list)
    #: What decided: "density", "links", "notice", "neighbours" or "marks".
    by: str = ""


def _names(raw: str) -> tuple[set[str], bool, str]:
    """Words of class, id and role; whether hidden; the lang attribute."""
    names: set[str] = set()
    hidden, lang = False, ""
    for m in ATTRIBUTE.finditer(raw):
        key, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "")
        if key in ("class", "id", "role"):
            names |= {x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", value)}
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif key == "lang":
            lang = value
    return names, hidden, lang


def blocks(page: str) -> tuple[list[Block], str]:
    """The page's blocks in order, and its language."""
    out: list[Block] = []
    here = Block()
    # of each open holder: name, leads into the article, leads away
    stack: list[tuple[str, bool, bool]] = []
    language, at, links = "", 0, 0

    def close() -> None:
        nonlocal here
        here.text = " ".join("".join(here.parts).split())
        if here.text:
            out.append(here)
        here = Block()

    def put(raw: str) -> None:
        nonlocal here
        if raw:
            words = html.unescape(raw)
            away = any(x[2] for x in stack)
            if away and here.parts and not here.away:
                return  # a part of a block that is no text of it
            if here.away and not away:
                here = Block()
            here.main = here.main or any(x[1] for x in stack)
            here.away = away
            here.parts.append(words)
            if links:
                here.linked += len(words)

    while m := TAG.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        ending, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if not ending and name in RAW and not raw.endswith("/"):
            if end := re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at):
                at = end.end()
            elif name not in ("head", "svg", "math"):
                at = len(page)
            continue
        if name == "br":
            put(" ")
        elif name in BLOCK:
            close()
            while stack and stack[-1][0] in INLINE:  # left open in the block before
                stack.pop()
        if name in VOID:
            continue
        if name == "a":
            links = max(0, links - 1) if ending else 1
        if name not in HOLDER:
            continue
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        names, hidden, lang = _names(raw) if raw.strip() else (set(), False, "")
        if name == "html":
            language = lang[:2].lower()
        within = any(x[1] for x in stack)
        away = hidden or name in AWAY or bool(names & AWAY_NAMES) and name not in ("html", "body")
        away = away or not within and (name == "header" or bool(names & HEAD_NAMES) and name not in ("html", "body"))
        stack.append((name, name in MAIN or "main" in names and name in ("div", "section"), away))
    put(re.sub(r"<[/!]?[a-zA-Z][^>]*\Z", "", page[at:]))
    close()
    return out, language


def counted(b: Block) -> None:
    """Counts a block's words, and keeps those that are stop words of any language."""
    if not b.size and b.text:
        words = WORD.findall(b.text.lower())
        b.size, b.stops = len(words), list(filter(ALL_STOP.__contains__, words))


def spoken(found: list[Block], language: str) -> frozenset[str]:
    """The stop words of the language that most of the page's words outside links are of; of equal
    ones the page's own."""
    counts = dict.fromkeys(STOP, 0)
    for b in found:
        if not b.linked:
            counted(b)
            for name, own in SETS.items():
                counts[name] += len(list(filter(own.__contains__, b.stops)))
    best = max(STOP, key=lambda name: (counts[name], name == language))
    return SETS[best] if counts[best] else ALL_STOP


def judged(b: Block, stop: frozenset[str]) -> tuple[str, str]:
    """First pass: label and what decided, from the block alone; "short" and "near" are undecided."""
    if b.linked > LINKS * max(1, sum(map(len, b.parts))):
        return "bad", "links"
    if NOTICE.match(b.text):
        return "bad", "notice"
    counted(b)
    density = len(list(filter(stop.__contains__, b.stops))) / b.size if b.size else 0.0
    if len(b.text) < SHORT:
        if b.size >= SOME and density >= STOP_HIGH:
            return "good", "density"
        return ("bad", "density") if b.size >= SEVERAL and not density else ("short", "")
    if density >= STOP_HIGH or density < STOP_LOW:
        return "good" if density >= STOP_HIGH else "bad", "density"
    return "near", ""


def classify(found: list[Block], language: str) -> None:
    """First pass: each block by itself. Second pass: undecided ones by the nearest decided ones.

    Marks of the page (an article, what stands apart from it) overrule what the rules say, after
    each pass: what is marked as boilerplate is none of the text, and nothing of a marked article
    is dropped for its density, length or links."""
    stop = spoken(found, language)
    has_main = any(b.main and not b.away for b in found)

    def overrule(b: Block) -> None:
        marked = "bad" if b.away or has_main and not b.main else "good" if b.main else ""
        if marked and b.label in ("good", "bad") and b.label != marked:
            b.label, b.by = marked, "marks"

    for b in found:
        b.label, b.by = judged(b, stop)
        overrule(b)
    first = [b.label for b in found]
    before, after = _nearest(first), [(len(first) - 1 - i, x) if x else (i, x) for i, x in reversed(_nearest(first[::-1]))]
    for i, b in enumerate(found):
        if first[i] in ("good", "bad"):
            continue
        (l, left), (r, right) = before[i], after[i]
        if left and right and left != right and i - l != r - i:
            b.label = left if i - l < r - i else right
        elif left and right and left != right:  # between text and none: a heading, or the last line
            b.label = "good"
        else:
            b.label = left or right or ("good" if first[i] == "near" else "bad")
        b.by = "neighbours"
        overrule(b)


def _nearest(labels: list[str]) -> list[tuple[int, str]]:
    """Of each place the last decided one before it, and its label."""
    out, last = [], (-1, "")
    for i, x in enumerate(labels):
        out.append(last)
        if x in ("good", "bad"):
            last = (i, x)
    return out


def main_text(page: str) -> str:
    """Blocks of the article, white space in each turned into one blank, two newlines between."""
    found, language = blocks(page)
    classify(found, language)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The columns `keep` of each page, its main text and n_chars (code points).

    Null or empty html gives empty text; broken or cut markup is read as far as it goes. Rows that
    repeat come back as often. Other columns are dropped, so none can clash. Empty tables give no rows."""
    prepare(pages.sparkSession)
    schema = pages.select(keep).schema.add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__html"):
            done = pa.array([main_text(x) for x in texts(part, "__html")], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], done], names=schema.names)

    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(lean(run), schema).withColumn("n_chars", F.length(text_col).cast("long"))
