"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks of text at block elements. The first pass decides what it can: a block in an element that
says what it is (navigation, footer, advert, form, comments ...) or with too many characters in links is boilerplate;
a long block with many stop words is text, and so is one of some length with a middling share in an article (an
``article`` or ``main`` element, or a container named so). The second pass gives each undecided block (too short, or
with too small a share of stop words for its place) the label of its nearest decided neighbours in the same region:
theirs if they agree, else the nearer one's, else its own leaning, which is text in an article. On a page without any
text by these rules, the undecided blocks are the text. Regions are the articles (or
``main``) and what stands outside them, so the page's frame says nothing about an article's short lines.

Character references are decoded once. White space inside a block, line breaks included, becomes one space.

Edge cases: a null, empty or text-free page has an empty text; unclosed, crossed and stray tags are closed as browsers
do; an unclosed comment or script reaches to the end of the page; repeated rows give repeated rows; an empty table
gives an empty result; further columns are not read. A page is held whole, and its time is in proportion to its length
whatever it holds; after a tag with an unclosed quote, a ">" inside quotes ends a tag.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import map_arrow, slices

#: Thresholds: characters of a short and of a long block, shares of stop words, share of characters in links.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.2, 0.3, 0.35
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset("""
the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when we
there can an your which their said if do will each about how up out them then she many some so these would other into has
de la le et les des en un une du que est dans qui par pour au sur pas plus avec ce il sont ne se elle son aux
der die das und zu den von ist mit nicht auf sich dem ein eine als auch es an werden aus er hat dass sie nach wird bei einer um
el los y las del se por con para una su al lo como más pero sus le ha o este sí porque esta entre cuando muy sin sobre
""".split())
#: Element names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title xmp noframes noembed audio video".split())
FRAME = frozenset("nav footer aside form button menu dialog head label fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of a class or id that name boilerplate.
MARKS = re.compile(
    r"(?:^|[^a-z])(?:nav(?:bar|igation)?|menus?|breadcrumbs?|header|masthead|footer|side-?bars?|ads?|advert\w*|adsense|banners?|promos?|promotion|sponsor\w*|cookies?\w*|consent|gdpr|notices?|"
    r"popups?|modals?|overlay|comments?|comment-?list|respond|repl(?:y|ies)|disqus|shar(?:e|ing)|social|pagination|pager|related|recommend\w*|newsletter|subscribe|"
    r"sign-?up|log-?in|search|forms?|widgets?|toolbar|skip-?link|disclaimer|copyright|legal)(?:[^a-z]|$)",
    re.I,
)
#: Classes and ids of an article's container, and of what an ``article`` element may be instead.
CONTENT = re.compile(r"(?:^|\s)(?:(?:main|article|post|entry|story|page)[-_]?(?:content|body|text)|content|article|story)(?:\s|$)", re.I)
OTHER = re.compile(r"(?:^|\s)(?:comment[\w-]*|reply|ads?|advert\w*|promo\w*|sponsor\w*|related[\w-]*|teaser|widget|sidebar)(?:\s|$)", re.I)
_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_plain = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_attribute = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: What may stand at the edges of a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00ab\u00bb\u201c\u201d\u201e\u2018\u2019\u2039\u203a\u2026\u2013\u2014\u00bf\u00a1\u00b7\u2022"


@dataclass
class Block:
    text: str
    links: int
    frame: str
    region: int
    heading: bool


def _attributes(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(attributes)} if "=" in attributes else {}


def _frame_of(name: str, attributes: str, found: dict[str, str], in_article: bool) -> str:
    """Why an element is frame: ``element`` or ``mark`` (its class or id), or "" if it isn't."""
    if name in FRAME or (name == "header" and not in_article):
        return "element"
    if found.get("aria-hidden") == "true" or "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _attribute.sub(" ", attributes)):
        return "element"
    if not found:
        return ""
    if found.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "element"
    named = f"{found.get('class', '')} {found.get('id', '')}"
    if name in ("body", "html"):
        return ""
    if name in ("article", "main"):
        return "mark" if OTHER.search(named) else ""
    if name == "header" or name in HEADINGS:  # an article's own head may be called so
        named = re.sub(r"(?i)header", "", named)
    return "mark" if MARKS.search(named) else ""


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # name, why it is frame, region
    opened: Counter[str] = Counter()  # names on the stack
    upper: list[int] = []  # the places of block elements on the stack
    regions, parts, linked, in_link, at, pos = 0, [], 0, 0, 0, 0
    heading = False

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = unescape(raw)
            parts.append(raw)
            if in_link:
                linked += len("".join(raw.split()))

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            whole = " ".join("".join(parts).split())
            if whole:
                _, frame, region = stack[-1] if stack else ("", "", 0)
                out.append(Block(whole, linked, frame, region, heading))
            parts, linked = [], 0

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        if upper and upper[-1] == len(stack):
            upper.pop()
        return name

    def pop_to(name: str) -> bool:
        if not opened[name]:
            return False
        while pop() != name:
            pass
        return True

    # No search may run to the end of the page for each tag anew: none begins beyond the last ">", after a tag with an
    # unclosed quote quotes count no more, and a name whose end tag is missing is remembered.
    token, bound, unended = _token, page.rfind(">") + 1, set()
    low = None
    while m := token.search(page, pos, bound):
        text(page[at : m.start()])
        at = pos = m.end()
        if token is _token:
            name, closing, attributes = m[2] or m[5] or "", m[1] or m[4], m[3] or m[6] or ""
            token = _plain if m[5] else _token
        else:
            name, closing, attributes = m[2] or "", m[1], m[3] or ""
        name = name.lower()
        if not name:
            if page.startswith("<!--", m.start()) and not m[0].endswith("-->"):
                at = len(page)
                break
            continue
        if not closing and name in RAW and not attributes.endswith("/"):
            low = page.lower() if low is None else low
            end = -1 if name in unended else low.find(f"</{name}", pos)
            if name in ("title", "svg", "math", "template", "noscript", "object", "audio", "video", "canvas") and end < 0:
                unended.add(name)
                continue
            stop = len(page) if end < 0 else page.find(">", end) + 1 or len(page)
            if name in BLOCKS:
                flush()
            at = pos = stop
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if name == "a":
            in_link = 0 if closing else 1
        if name in VOID:
            continue
        if closing:
            if pop_to(name) and name in HEADINGS:
                heading = False
            continue
        if name in BLOCKS and name != "html":
            in_link = 0 if name in ("p", "li", "article", "nav", "footer") else in_link
            nearest = stack[upper[-1]][0] if upper else ""  # a block closes an open paragraph, an item its predecessor
            if nearest == "p" or nearest == name and name in ("li", "dt", "dd", "tr", "td", "th"):
                pop_to(nearest)
            heading = name in HEADINGS
        _, frame, region = stack[-1] if stack else ("", "", 0)
        found = _attributes(attributes)
        own = _frame_of(name, attributes, found, bool(region))
        article = name in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articleBody"
        if article and frame == "mark" and not own and not regions:
            frame = ""  # a wrapper named after what stands beside the article
        frame = frame or own
        if not frame and not region and (article or name in ("div", "section") and CONTENT.search(f"{found.get('class', '')} {found.get('id', '')}")):
            regions += 1
            region = regions
        if name in BLOCKS:
            upper.append(len(stack))
        opened[name] += 1
        stack.append((name, frame, region))
    comment = page.find("<!--", at)
    text(page[at:comment] if comment >= 0 else page[at:])
    flush()
    return out


def stop_share(text: str) -> float:
    words = [w for w in (w.strip(EDGES) for w in text.lower().split()) if w]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(b: Block) -> tuple[bool | None, bool]:
    """(label, leaning): label is True for text, False for boilerplate, None if undecided."""
    n = len(b.text)
    if b.frame or b.links > LINKS * len("".join(b.text.split())):
        return False, False
    if n < SHORT:
        return (None, b.region > 0) if not b.links or b.region else (False, False)
    share = stop_share(b.text)
    if b.region:
        return (True if share >= STOP_LOW else None), True
    if share >= STOP_HIGH:
        return (True, True) if n > LONG else (None, True)
    return (None, True) if share >= STOP_LOW else (False, False)


def second_pass(found: list[Block]) -> list[bool]:
    """The labels of all blocks."""
    first = [first_pass(b) for b in found]
    # decided neighbours: an article's own boilerplate says nothing about its text
    decided = [label if label is None or label or not b.region else None for (label, _), b in zip(first, found, strict=True)]
    before: list[int | None] = []
    after: list[int | None] = [None] * len(found)
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        before.append(last.get(b.region))
        if decided[i] is not None:
            last[b.region] = i
    last = {}
    for i in range(len(found) - 1, -1, -1):
        after[i] = last.get(found[i].region)
        if decided[i] is not None:
            last[found[i].region] = i
    out = []
    for i, ((label, leaning), b) in enumerate(zip(first, found, strict=True)):
        if label is None:
            near = [(abs(k - i), decided[k]) for k in (before[i], after[i]) if k is not None]
            if b.heading and after[i] is not None:
                label = decided[after[i]]
            elif not near:
                label = leaning and b.region > 0
            elif len({x for _, x in near}) == 1:
                label = near[0][1]
            else:
                (p, x), (q, y) = near
                label = leaning if p == q else (x if p < q else y)
        out.append(bool(label))
    if not any(out):  # nothing stands out: what no rule spoke against is the text
        out = [label is None for label, _ in first]
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, second_pass(found), strict=True) if keep)


def extract(pages: DataFrame, id_column: str = "page_id", html: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each whole page; ``carry`` names the columns kept beside the id."""
    chosen = pages.select(id_column, *carry, F.col(html).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_html", 8 << 20):
            texts = [main_text(p) for p in b.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"]
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_arrow(chosen, run, f"{kept}, text string, n_chars long")


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages)
