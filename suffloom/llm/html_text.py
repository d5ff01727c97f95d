"""Main-text extraction from HTML: two-pass block rules.

A tag scanner cuts a page into blocks of text. The first pass classes each block by its
stop-word density, length and link density, and by where it stands: in an element that HTML
sets apart (navigation, asides, forms ...) or one whose class, id or role names such a part.
The second gives ambiguous short blocks the label of the nearest decided neighbours. An
element marked as the article is believed if the passes find text in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from suffloom.llm.common import table, text_batches

#: Frequent words of European languages; a page's own short frequent words count, too.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein
    de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son lui nous mais comme être ont si leur elle cette ses été aux
    el los las del por con una su para como más pero sus este ya o sí porque muy sin sobre ser también me hasta hay donde quien desde todo nos durante
    che di non è sono della nel alla ma anche dei gli dal più questo si lo come o os da em uma não com dos na no mais ao das foi pelo
    het een van dat die te zijn op met voor niet aan er ook maar bij och att som på det är av med för inte den till har og til ikke af jeg
    i w na z że się nie do jest to jak o ale po co и в не на что с по как это из за ve bir bu da için ile""".split()
)
#: Frequent signs of Chinese and Japanese, which have no spaces between words.
_STOP_SIGNS = frozenset("的了是在不有他这和就也与のにはをたがでてとし")
#: Elements set apart from the article that hold blocks, and those within a line, whose text goes.
_APART = frozenset("nav header footer aside form menu dialog figure fieldset head".split())
_INLINE_APART = frozenset("select option button textarea input label svg math canvas iframe object embed video audio map picture datalist title".split())
#: Elements whose content is raw: it ends at the same end tag only, and is no text.
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Of those, the ones that hold others.
_HOLDERS = frozenset("article aside blockquote body center dialog div fieldset figure footer form header main menu nav section table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of names in class, id or role of elements outside the article: surely so, or in company with a neutral part.
_SURE = frozenset(
    """nav navbar navigation menu menubar topbar breadcrumb breadcrumbs masthead footer sidebar ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored
    taboola outbrain promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup signin login sharing social
    comment comments commentlist respond replies disqus pagination pager toolbar popup modal overlay dialog toast widget complementary contentinfo disclaimer""".split()
)
_MAYBE = frozenset("aside banner notice alert register share related recommended recommendations discussion search skip form copyright rail".split())
_NEUTRAL = frozenset(
    """area bar block body bottom box button buttons card center col column container content element global group head header holder icon icons inner item items left link links list main middle
    module msg message panel page post posts primary right row secondary section site slot small stories story text thread top unit user users web wrap wrapper article articles reader readers mobile desktop fixed sticky""".split()
)
#: A header is outside the article if it's a page's: alone, or with one of these.
_PAGE_PARTS = frozenset("site page main global top app web".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# A quote opens a value only behind an equals sign; elsewhere it is a sign like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s\"'>][^\s>]*)?|[^>=])*+)(?:>|$)", re.S)
_ATTRS = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>][^\s>]*)))?[\"']?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_WORD = re.compile(r"[^\W_]+")
GOOD, BAD, SHORT, NEAR_GOOD = "good", "bad", "short", "near_good"


@dataclass(slots=True)
class Block:
    """named: 0, or whether the names around may (1) or do (2) say that this is outside the article. place: a number of the element that holds it."""

    text: str
    linked: int = 0
    heading: bool = False
    inside: bool = False
    apart: bool = False
    named: int = 0
    place: int = 0
    label: str = ""
    words: Counter = field(default_factory=Counter)


def _name_level(value: str, inside: bool) -> int:
    level = 0
    for name in value.split():
        parts = {x.lower() for x in _NAME.findall(name)}
        if "header" in parts and not inside and (len(parts) == 1 or parts <= _PAGE_PARTS | {"header"}):
            return 2
        sure, maybe = parts & _SURE, parts & _MAYBE
        if sure or maybe:
            company = parts <= _SURE | _MAYBE | _NEUTRAL and (sure or len(parts) > 1)
            level = max(level, 2 if company else 1)
    return level


def _told(attrs: str, tag: str, inside: bool) -> tuple[bool, int]:
    """Whether the element is hidden, and what its names say."""
    level, seen = 0, set()
    for name, a, b, c in _ATTRS.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in seen:
            continue
        seen.add(name)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)) or (name == "class" and "hidden" in value.lower().split()):
            return True, 0
        if name in ("class", "id", "role") and tag not in ("article", "main", "body", "html"):
            level = max(level, _name_level(value, inside))
    return False, level


class _Open:
    """An open element and what holds within it."""

    __slots__ = ("tag", "link", "inside", "heading", "apart", "gone", "named", "place")

    def __init__(self, tag: str, up: _Open | None, place: int = 0):
        self.tag, self.place = tag, place if tag in _HOLDERS or not up else up.place
        self.link, self.inside, self.heading, self.apart, self.gone, self.named = (up.link, up.inside, up.heading, up.apart, up.gone, up.named) if up else (False, False, False, False, False, 0)


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order. Tags need not be closed or well nested; hidden elements and those within a line that are no text give none."""
    out: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[_Open] = [_Open("", None)]

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                out.append(Block(text, len(" ".join("".join(links).split())), top.heading, top.inside, top.apart, top.named, top.place))
            parts.clear()
            links.clear()

    def keep(raw: str) -> None:
        top = stack[-1]
        if raw and not top.gone:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if top.link:
                links.append(raw)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            keep(page[at:])
            break
        keep(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                keep(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing, attrs = m[2].lower(), m[1], m[3]
        if closing:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            # Formatting doesn't end a block element that was opened in it.
            if k and (tag in BLOCKS or not any(x.tag in BLOCKS for x in stack[k + 1 :])):
                if tag in BLOCKS:
                    flush()
                del stack[k:]
            elif k:
                for x in stack[k + 1 :]:
                    x.link = x.link and tag != "a"
                del stack[k]
            elif tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS:
            flush()
        if tag in ("br", "hr"):
            keep(" ")
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(page, at)
            at = close.start() if close else end
            if close:
                over = page.find(">", at)
                at = over + 1 if over >= 0 else end
            continue
        if tag in BLOCKS:
            # A block opened within a paragraph ends it, and with it the formatting left open there.
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in BLOCKS), 0)
            if stack[k].tag == "p":
                del stack[k:]
        own = _Open(tag, stack[-1], at)
        stack.append(own)
        if tag == "a":
            own.link = True
        elif tag in ("article", "main"):
            own.inside = not own.apart
        elif tag in HEADINGS:
            own.heading = True
        if tag in _INLINE_APART:
            own.gone = True
        elif tag in _APART and not (tag in ("header", "figure") and own.inside):
            own.apart = True
        if attrs and _TELLING.search(attrs):
            gone, level = _told(attrs, tag, own.inside)
            own.gone = own.gone or gone or (level == 2 and tag not in BLOCKS)
            if tag in BLOCKS:
                own.named = max(own.named, level)
    flush()
    return out


def _words(text: str) -> Counter:
    signs = [c for c in text if c >= "\u2e80"] if not text.isascii() else []
    return Counter(signs if 3 * len(signs) > len(text) else _WORD.findall(text.lower()))


def classify(blocks: list[Block], max_link: float, short: int, stop_low: float, stop_high: float) -> None:
    """First pass: each block by itself.

    Bad: set apart, or mostly links without prose; what names surely tell of, if other blocks are good without
    them; what they may tell of, unless it is long prose. Good: long enough, with many stop words.
    Nearly good: the same with fewer. Short: too short, or with too few stop words to tell by itself.
    """
    seen: Counter = Counter()
    for b in blocks:
        if not b.apart:
            b.words = _words(b.text)
            seen.update(b.words)
    often = max(4, seen.total() // 100)
    stop_words = STOP_WORDS.union(w for w, n in seen.items() if n >= often and len(w) < 5)
    for b in blocks:
        n, link = len(b.text), b.linked / len(b.text)
        signs = next(iter(b.words), "") >= "\u2e80"
        stops = sum(b.words[w] for w in b.words.keys() & (_STOP_SIGNS if signs else stop_words)) * (5 if signs else 1)
        density = stops / max(b.words.total(), 1)
        long = n >= (short // 3 if signs else short)
        if b.apart:
            b.label = BAD
        elif link > max_link:
            b.label = NEAR_GOOD if long and density >= stop_high and link < 0.9 else BAD
        elif b.named == 1 and not (n >= 2 * short and density >= stop_high):
            b.label = BAD
        elif not long or density < stop_low:
            b.label = SHORT
        else:
            b.label = GOOD if density >= stop_high else NEAR_GOOD
    text = (GOOD, NEAR_GOOD)
    if any(b.named < 2 and (b.label in text or (b.label == SHORT and len(b.text) >= short)) for b in blocks):
        for b in blocks:
            if b.named == 2:
                b.label = BAD
    if not any(b.label == GOOD for b in blocks):
        # Nothing is surely text: the longest block that may be is taken for it.
        seed = max((b for b in blocks if b.label != BAD and not b.linked), key=lambda b: (b.label, b.named == 0, len(b.text)) if b.label == NEAR_GOOD else ("", b.named == 0, len(b.text)), default=None)
        if seed:
            seed.label = GOOD


def inherit(blocks: list[Block], ends: str | None) -> None:
    """Second pass: short and nearly good blocks take the label of the nearest decided neighbours.

    Where both neighbours agree, their label; else a nearly good block is kept, and a short one takes
    that of the nearer neighbour (a heading that of the next one). A neighbour in the same element is
    nearer than one in another. ends: what counts as decided beyond the first and last block; None for
    nothing, and what has no decided neighbour at all is kept.
    """
    n = len(blocks)
    far = 2 * n + 2

    def found(order: Iterable[int], last: int) -> list[tuple[str | None, int]]:
        """Each block's last decided neighbour in this order, and how far it is."""
        out: list[tuple[str | None, int]] = [(None, 0)] * n
        label, place = ends, -1
        for i in order:
            b = blocks[i]
            out[i] = (label, abs(i - last) + (far if place != b.place else 0))
            if b.label in (GOOD, BAD):
                label, last, place = b.label, i, b.place
        return out

    before, after = found(range(n), -1), found(range(n - 1, -1, -1), n)
    for b, (x, dx), (y, dy) in zip(blocks, before, after, strict=True):
        if b.label in (GOOD, BAD):
            continue
        x, y = x or y or GOOD, y or x or GOOD
        if x == y:
            b.label = x
        elif b.label == NEAR_GOOD:
            b.label = GOOD
        elif b.heading and not dx < far <= dy:
            b.label = y
        else:
            b.label = x if dx <= dy else y


def main_text(page: str | None, max_link: float = 0.4, short: int = 70, stop_low: float = 0.08, stop_high: float = 0.18) -> str:
    """The article's blocks, joined by newlines; empty for a null or empty page.

    The passes run over all blocks. Where the page marks an article or main element, and the first
    pass finds text in it or none elsewhere, the others are bad, and the second pass runs over
    its blocks alone.
    """
    if not page:
        return ""
    blocks = blocks_of(page)
    classify(blocks, max_link, short, stop_low, stop_high)
    inside = [b for b in blocks if b.inside and not b.apart]
    text = (GOOD, NEAR_GOOD)
    if inside and (any(b.label in text for b in inside) or not any(b.label == GOOD and not b.named for b in blocks)):
        blocks = inside
        inherit(blocks, None)
    else:
        inherit(blocks, BAD)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame, key: str = "page_id", also: tuple[str, ...] = ("url",), **rules: float) -> DataFrame:
    """Key and further columns of each row with text and n_chars (code points).

    A null or empty html gives an empty text. Whole pages are read, however long; nothing is
    capped. Rows may repeat; each gives one row. An empty table gives an empty result. No
    shuffle: one pass over the scan, in batches of bounded bytes.
    """
    kept = [key, *also]
    fields = [pages.schema[c] for c in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            texts = [main_text(x, **rules) for x in b.column("__html").to_pylist()]
            cols = [b.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "text", "n_chars"])

    return pages.select(*kept, pages["html"].alias("__html")).mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
