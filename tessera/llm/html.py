"""Main-text extraction from HTML by two-pass block rules.

Pass one cuts the page in blocks at block-level tags and measures each: its length, the
share of stop words among its words, the share of its characters inside links, and whether
a container marks it as page furniture (menu, header, footer, sidebar, advert, form, comment
or notice) or stands in an article or main element. Decisions, in this order:

* *bad*: in a furniture container, or more than ``max_links`` of its characters linked, or
  it opens with a copyright sign;
* *good*: at least ``min_chars`` long and stop words make up ``high`` or more of its words;
* *bad*: at least ``min_chars`` long, outside articles, and stop words are below ``low``;
* *open*: everything else: short blocks, headings, middling density, odd text in articles.

Pass two gives each open block the label of the nearest decided block: of its own container
if that has one, else of its side (inside or outside articles), else of the page; of two
equally near the later one counts. In an article without any decided block open blocks are
good; on a page without any they are good too. Both passes take time linear in the page.

Scripts, styles and markup never become text; nor do noscript, select and textarea, which
are notices and forms. Character references are decoded, white space inside a block becomes
one space, blocks join by two newlines in page order. Null or empty html gives an empty text.
Unclosed, crossing and cut-off tags are tolerated; very long pages take no cap; every row
stands alone, so repeated rows give repeated results, an empty table gives an empty one, and
other columns pass through (``out`` replaces a column of its name).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Tag sets, container words and stop words of the supported languages.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr math mi mn mo mrow msup msub mfrac mtext msqrt semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg textarea title head select option canvas".split())
BAD_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GROUND = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promotion related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "teaser toolbar widget".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have in is it not of on or that the this to was were which with "
    "au aux avec ce dans de des du elle en est et il la le les ne on ou par pas pour que qui se sur un une "
    "als auf auch aus bei das dem den der des die ein eine einer für im ist mit nicht sich sie und von werden zu zum "
    "al con como del el ella en es esta la las lo los no o para pero por que se su sus un una y".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
CLASS = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPLIT = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[^\W\d_]+")
# Words before a container word that say the page has such a part, not that this is it.
HAVING = frozenset("has have with without no not is".split())
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


@dataclass
class Block:
    words: list[str] = field(default_factory=list)
    linked: int = 0
    path: int = 0
    bad: bool = False
    ground: int = 0
    heading: bool = False
    text: str = ""
    label: str = ""


def _bad_container(tag: str, attrs: str, in_ground: bool) -> bool:
    if tag in BAD_TAGS or tag == "header" and not in_ground:
        return True
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    for name, value in CLASS.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in BAD_ROLES:
            return True
        if name in ("class", "id"):
            for part in value.split():
                words = [w.lower() for w in SPLIT.split(part)]
                if any(w in BAD_WORDS and not (k and words[k - 1] in HAVING) for k, w in enumerate(words)):
                    return True
    return False


def blocks(page: str) -> list[Block]:
    """Non-empty text blocks in page order."""
    out: list[Block] = []
    # Open elements: tag, number of the container, in furniture, number of the article (0: none).
    stack: list[tuple[str, int, bool, int]] = []
    opened: Counter[str] = Counter()
    serial, links, at, n, skip = 0, 0, 0, len(page), ""
    now = Block()

    def close() -> None:
        nonlocal now
        if now.words:
            now.text = " ".join("".join(now.words).split())
            if now.text:
                out.append(now)
            now = Block()
        tag, now.path, now.bad, now.ground = stack[-1] if stack else ("", 0, False, 0)
        now.heading = tag in HEADINGS

    def add(piece: str) -> None:
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            now.words.append(piece)
            if links:
                now.linked += len(piece)

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    while at < n:
        if skip:
            m = ENDS[skip].search(page, at)
            at, skip = (m.end() if m else n), ""
            continue
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        m = TOKEN.match(page, start)
        if not m:
            if start + 1 < n and (page[start + 1].isalpha() or page[start + 1] in "/!"):
                add(page[at:start])  # a tag cut off at the end of the page
                end = page.find(">", start)
                if end < 0:
                    break
                at = end + 1
                continue
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "a":
                links = max(0, links - 1)
            elif tag in INLINE:
                pass
            elif opened[tag]:
                while pop() != tag:
                    pass
                links = 0
                close()
            else:
                close()
            continue
        if tag in RAW:
            if tag in ("head",):
                continue
            if not m.group(3).endswith("/"):
                skip = tag
            continue
        if tag == "a":
            links += 1
        elif tag == "br":
            add(" ")
        elif tag in INLINE:
            pass
        elif tag in VOID:
            close()
        else:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") or tag[0] == "h" and tag[1:].isdigit():
                if stack and stack[-1][0] == tag or stack and stack[-1][0] == "p":
                    pop()
            serial += 1
            top = stack[-1] if stack else ("", 0, False, 0)
            path = top[1] if tag in HEADINGS or tag in ("p", "li") else serial
            ground = top[3] or (serial if tag in GROUND else 0)
            stack.append((tag, path, top[2] or _bad_container(tag, m.group(3), ground > 0), ground))
            opened[tag] += 1
            links = 0
            close()
    close()
    return out


def stop_density(text: str) -> float:
    """Share of stop words among the words (runs of letters) of a text."""
    words = WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))


def decide(b: Block, min_chars: int = 60, high: float = 0.12, low: float = 0.05, max_links: float = 0.4) -> str:
    """Pass one: ``good``, ``bad`` or an empty string for an open block."""
    if b.bad or b.linked > max_links * len(b.text) or b.text.startswith("©"):
        return "bad"
    if b.heading or len(b.text) < min_chars:
        return ""
    density = stop_density(b.text)
    return "good" if density >= high else "bad" if density < low and not b.ground else ""


def classify(found: list[Block], **limits) -> list[Block]:
    """Label every block good or bad. ``limits``: those of ``decide``."""
    first = [decide(b, **limits) for b in found]
    scopes = [lambda b: ("container", b.path), lambda b: ("side", b.ground), lambda b: ("page",)]
    near: list[list[tuple[int, bool, str] | None]] = [[None] * len(scopes) for _ in found]
    for order, later in ((range(len(found)), False), (range(len(found) - 1, -1, -1), True)):
        last: dict[tuple, int] = {}
        for i in order:
            for s, scope in enumerate(scopes):
                j = last.get(scope(found[i]))
                if j is not None and not first[i]:
                    seen = (abs(i - j), not later, first[j])
                    near[i][s] = seen if near[i][s] is None else min(near[i][s], seen)
                # Furniture is decided by where it stands; it says nothing of its container.
                if first[i] and (s or not found[i].bad):
                    last[scope(found[i])] = i
    for i, b in enumerate(found):
        closest = near[i][0] or near[i][1] or (None if b.ground else near[i][2])
        b.label = first[i] or (closest[2] if closest else "good")
    return found


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in classify(blocks(page)) if b.label == "good") if page else ""


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each row."""

    @pandas_udf("string")
    def main(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(x) for x in part], dtype=object)

    return pages.withColumn(out, main(F.col(html)))
