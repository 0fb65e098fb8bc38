"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block elements. Where an article or main element holds most of the running text
(that is not mostly links), blocks outside are left out; a smaller one, such as a teaser card, says nothing. Containers that name their purpose (navigation, forms,
adverts, comments and so on, by element, role, class or id) drop their blocks. The first pass
decides the others by length, link density and stop-word density: many links are bad, many stop words good;
blocks inside an article or main element need no stop words. Blocks too short, or with too few stop
words, to decide take the label of the nearest decided block in
the second pass; between two at equal distance the good one wins. Where no block is decided, those in
such an element are good, or all if there is none. A class or id counts by its parts; words
such as search or alert do not count where the name ends in one of content, such as ``search-result``.

Character references are decoded, white space in a block becomes one space, blocks are joined by an
empty line.

Defined cases: null and empty pages give an empty text; elements that are never closed end with their
container or the page; repeated rows are kept; other columns are kept, a column named ``text`` is replaced.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent function words.
STOP_WORDS = frozenset(
    # English
    "the of and to in is it that for was on are as with be at by this from or an not but have has he she they we you a i his her their its which were been will would can"
    # German
    " der die das und ist nicht von zu mit den des dem ein eine einer einem für auf im sich auch als wie an aus bei nach er sie es wir ich war sind"
    # French
    " le la les de du des un une et est que qui dans pour pas sur avec ce cette il elle nous vous je au aux par plus ne se en ou son sa"
    # Spanish
    " el los las y en del que no por con para una su se lo como más pero al es o este esta".split()
)

#: Elements and marks of what is no main text.
DROPPED_ELEMENTS = frozenset("nav footer aside form menu dialog select button iframe object canvas svg audio video head noscript template fieldset".split())
RAW_ELEMENTS = "script|style|textarea|title|noscript|template|iframe|svg|math|xmp|noembed|noframes"
DROPPED_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toolbar "
    "header masthead footer copyright sidebar aside widget related recommended trending popular "
    "comment comments commentlist disqus reply replies respond discussion "
    "cookie cookies consent gdpr notice alert warning popup modal overlay newsletter subscribe subscription signup login search "
    "share sharing social follow skip hidden".split()
)
#: Marks that say little where the name ends in one of content (``search-result``, ``alert-level-story``), and
#: the only ones that count on an article element.
WEAK_MARKS = frozenset("header search cookie cookies consent notice alert warning share sharing social follow popular trending".split())
CONTENT_NAMES = frozenset("article articles story stories content body text result results paragraph entry post level".split())
ARTICLE_MARKS = frozenset("comment comments reply related ad sponsored promo".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MAIN_ELEMENTS = frozenset(("article", "main"))
CONTAINERS = frozenset(
    "html body div section article main header footer nav aside form ul ol dl table figure fieldset menu details blockquote dialog select button object canvas audio video head center".split()
)
BLOCK_ELEMENTS = CONTAINERS | frozenset(
    "p li h1 h2 h3 h4 h5 h6 tr td th thead tbody tfoot caption dt dd figcaption address pre hr legend summary option optgroup hgroup search".split()
)

#: Lengths and densities of the first pass.
SHORT, LONG = 70, 200
MOST_LINKS = 0.4
LEAST_STOPS, MANY_STOPS = 0.12, 0.25

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW_ELEMENTS})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*+[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?P<odd>/?[a-zA-Z][^<>]*+)>?"
    r"|<[!?/][^>]*+>?"
    r"|[^<]++|<",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|aria-label)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class _Block:
    main: bool
    dropped: bool
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())

    def link_density(self, text: str) -> float:
        return len(" ".join(html.unescape("".join(self.linked)).split())) / max(1, len(text))


def _marks(token: str) -> set[str]:
    """Marks among the parts of one class or id; a weak one does not count before a name of content."""
    parts = [part.lower() for part in _PART.findall(token)]
    found = set(parts) & DROPPED_MARKS
    return found - WEAK_MARKS if parts and parts[-1] in CONTENT_NAMES else found


def _marked(name: str, rest: str, marks: bool) -> bool:
    """Whether an element says that it is no main text."""
    if name in DROPPED_ELEMENTS:
        return True
    if not rest or name in ("html", "body", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.lower() in DROPPED_ROLES:
            return True
        if marks and key in ("class", "id"):
            found = set().union(*map(_marks, value.split()))
            if found and (name != "article" or found & ARTICLE_MARKS):
                return True
    return False


def _blocks(page: str, marks: bool) -> list[_Block]:
    out: list[_Block] = []
    open_containers: list[tuple[str, bool, bool]] = []  # name, in main element, dropped
    main = dropped = False
    block = _Block(False, False)
    links = 0

    def fresh(own_drop: bool = False) -> None:
        nonlocal block
        if block.parts:
            out.append(block)
        block = _Block(main, dropped or own_drop)

    for token in _TOKEN.finditer(page):
        name = token["name"]
        if name is None:
            start = token[0]
            if token["raw"] or start[:2] in ("<!", "<?", "</") or token["odd"]:
                block.parts.append(" " if token["raw"] else "")
                continue
            block.parts.append(start)
            if links:
                block.linked.append(start)
            continue
        name, closing = name.lower(), bool(token["close"])
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            block.parts.append(" ")
        elif name in CONTAINERS:
            links = 0
            if not closing:
                open_containers.append((name, main, dropped))
                in_article_header = name == "header" and main
                main = main or name in MAIN_ELEMENTS
                dropped = dropped or (name == "header" and not in_article_header) or _marked(name, token["rest"], marks and not in_article_header)
            else:
                for k in range(len(open_containers) - 1, -1, -1):
                    if open_containers[k][0] == name:
                        _, main, dropped = open_containers[k]
                        del open_containers[k:]
                        break
            fresh()
        elif name in BLOCK_ELEMENTS:
            links = 0
            fresh(not closing and _marked(name, token["rest"], marks))
    fresh()
    return out


def _labels(blocks: list[tuple[_Block, str]]) -> list[bool]:
    """True for main text."""
    first: list[bool | None] = []
    for block, text in blocks:
        if block.dropped or block.link_density(text) > MOST_LINKS:
            first.append(False)
        elif len(text) < SHORT:
            first.append(None)
        elif block.main:
            first.append(True)
        else:
            words = _WORD.findall(text.lower())
            stops = sum(word in STOP_WORDS for word in words) / max(1, len(words))
            if stops >= MANY_STOPS or (stops >= LEAST_STOPS and len(text) >= LONG):
                first.append(True)
            else:
                first.append(None)
    # blocks of dropped containers say nothing about their neighbours
    telling = [label if not block.dropped else None for label, (block, _) in zip(first, blocks, strict=True)]
    before, after = _nearest(telling), _nearest(telling[::-1])[::-1]
    any_main = any(block.main and not block.dropped for block, _ in blocks)
    out = []
    for k, label in enumerate(first):
        if label is None:
            near = [x for x in (before[k], after[k]) if x is not None]
            if near:
                closest = min(distance for distance, _ in near)
                label = any(good for distance, good in near if distance == closest)
            else:
                label = blocks[k][0].main or not any_main
        out.append(label)
    return out


def _nearest(labels: list[bool | None]) -> list[tuple[int, bool] | None]:
    """Distance and label of the last decided block before each."""
    out: list[tuple[int, bool] | None] = []
    last: tuple[int, bool] | None = None
    for label in labels:
        last = (last[0] + 1, last[1]) if last is not None else None
        out.append(last)
        if label is not None:
            last = (0, label)
    return [None if x is None else (x[0], x[1]) for x in out]


def main_text(page: str | None) -> str:
    """The main text; marks in classes and ids are left aside if they leave nothing."""
    for marks in (True, False):
        blocks = [(block, block.text()) for block in _blocks(page or "", marks)]
        blocks = [(block, text) for block, text in blocks if text]
        running = [(block.main, len(text)) for block, text in blocks if not block.dropped and block.link_density(text) <= MOST_LINKS]
        if 2 * sum(length for main, length in running if main) >= sum(length for _, length in running) > 0:
            # an article that holds most of the page's running text stands for itself; what is outside is no part of it
            blocks = [(block, text) for block, text in blocks if block.main]
        else:  # a teaser, or none: the elements say nothing, and all blocks are judged by their text
            for block, _ in blocks:
                block.main = False
        kept = [text for (_, text), good in zip(blocks, _labels(blocks), strict=True) if good]
        if kept:
            return "\n\n".join(kept)
    return ""


def extracted(page: str = "html") -> Column:
    """The main text of the pages in a column."""

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(x) for x in pages.to_pylist()], pa.string())

    return extract(F.col(page))
