"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text between the edges of block elements, each
with its root-to-leaf path of tags and classes. For each path the text length and
punctuation per block are aggregated (less linked text), the two are fused, the values
are smoothed over the blocks in page order, and paths that stay above a share of the
page's mean are content, inside an article or main element and outside; such an element
raises the values of its paths. What stands beside content under the same parent, or in
the article that holds it (headings, lists, short lines), is content too unless most of
it is linked.
Menus, headers, footers, sidebars, notices, adverts, forms and comments are left out
by their element, whatever their ratios, or by the noun of a role, class or id; but names
leave out no element that holds a chief article or most of the page's unlinked text.
There, and where a name is in doubt, they lower the values of the paths.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm._common import append_columns

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'][^\s]*)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content isn't markup or isn't shown; all of it is skipped.
RAW = frozenset("script style title textarea iframe noembed noframes template annotation annotation-xml metadata desc".split())
BOILERPLATE = frozenset("head nav header footer aside form menu button select label dialog input".split())
#: Elements that close themselves by a slash, as all do inside them.
FOREIGN = ("svg", "math")
#: Blocks of text, whose ids are often made from what they say.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd th td pre blockquote figcaption caption".split())
CONTENT = frozenset(("article", "main"))
#: Blocks that hold text and stand in a container.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption ul ol dl table tbody thead".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Parts of names in class, id and role values that say that it isn't the article.
_NOT_CONTENT = re.compile(r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|paywall|nav\w*|menu\w*|breadcrumbs?|topbar|masthead|siteheader|pageheader|foot\w*|copyright|legal|sidebars?|side|aside|widgets?|related|recommend\w*|trending|popular|morefrom|share|sharing|social|comments?|commentlist|respond|disqus|replies|reply|login|signup|search|form|toolbar|pagination|pager|tags?|bylinelinks?|skiplink|complementary|contentinfo|dialog)")
_COMMENTS = re.compile(r"(?:comments?|commentlist|respond|disqus|replies)")
#: Two parts of a name that are one, words that leave a name to the element that it is of, and words after which what stands before still is the noun.
_JOINED = re.compile(r"(?<![^\W_])(site|page|more|byline|skip)[-_]?(header|from|links?)(?![^\W_])")
_MODIFIERS = frozenset("has with without no non not is hide show".split())
_GENERIC = frozenset("area articles bar block body bottom box buttons column container content icons inner items item left links link list main module outer panel posts primary region right row secondary section slot stories text title top unit widget wrap wrapper".split())
#: Words that are sections of articles too.
_UNSURE = frozenset(("legal",))
#: What the values of paths are multiplied by whose names leave it open, or that hold most of the page.
LOWERED = 0.5
#: Smoothing weights over neighbouring blocks, and the share of the mean value that content must reach.
KERNEL = (0.25, 0.5, 0.25)
SHARE = 0.3
#: What the ratios of a path in an article or main element are multiplied by.
ARTICLE = 1.5


@dataclass
class Block:
    path: int
    container: int
    inside: int
    text: str
    linked: int
    mark: int = 0


def naming(names: str) -> int:
    """What class, id and role values say: 0 nothing, 1 perhaps boilerplate, 2 boilerplate, 3 comments.

    A name is boilerplate if its noun, the last part but for numbers and generic words, is.
    """
    most = 0
    for name in _JOINED.sub(r"\1\2", names).split():
        parts = [p for p in re.split(r"[-_]+", name) if p and not p.isdigit()]
        if _MODIFIERS.intersection(parts):
            continue
        while len(parts) > 1 and parts[-1] in _GENERIC and not _NOT_CONTENT.fullmatch(parts[-1]):
            parts.pop()
        if parts and _NOT_CONTENT.fullmatch(parts[-1]) and parts[-1] not in _UNSURE:
            most = max(most, 3 if _COMMENTS.fullmatch(parts[-1]) else 2)
        elif any(map(_NOT_CONTENT.fullmatch, parts)):
            most = max(most, 1)
    return most


def blocks(page: str) -> tuple[list[Block], dict[int, int], dict[int, tuple[int, int]]]:
    """The page's blocks outside boilerplate elements, in order, the last number inside each element, and the marks.

    Elements are numbered as they open. A block has numbers for its path, the container
    that it stands in (0: the body), its article (0: none) and the innermost element whose
    names mark it (0: none). A mark has the number of the marked element around it and what
    the names say.
    """
    found: list[Block] = []
    paths: dict[tuple[int, str], int] = {}
    last: dict[int, int] = {}
    marks: dict[int, tuple[int, int]] = {}
    # An open element: tag, number of its path, of its container, whether it is boilerplate, its article's number, its mark's, its own number.
    stack: list[tuple[str, int, int, bool, int, int, int]] = [("", 0, 0, False, 0, 0, 0)]
    opened: dict[str, int] = {}
    count = links = 0
    text: list[str] = []
    linked = 0
    home = stack[0]
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            if words := " ".join(html.unescape("".join(text)).split()):
                found.append(Block(home[1], home[2], home[4], words, min(linked, len(words)), home[5]))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        for tag, *_, own in stack[depth:]:
            last[own] = count
            opened[tag] -= 1
            links -= tag == "a"
        del stack[depth:]

    def say(piece: str) -> None:
        nonlocal home, linked
        if piece and not stack[-1][3]:
            if not text and not piece.isspace():
                home = stack[-1]
            if text or not piece.isspace():
                text.append(piece)
                linked += len(piece) if links else 0

    while m := _TAG.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if not (tag := (m[2] or "").lower()):
            continue
        if m[3] and m[3].endswith("/") and any(map(opened.get, FOREIGN)):
            continue
        block = tag in BLOCK
        if block:
            flush()
        if m[1]:
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            continue
        if tag == "br":
            say(" ")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in VOID:
            continue
        if block and opened.get("p"):  # a paragraph ends where a block begins
            depth = len(stack) - 1
            while stack[depth][0] not in BLOCK:
                depth -= 1
            if stack[depth][0] == "p":
                close(depth)
        if tag in CLOSES:
            depth = len(stack) - 1
            while depth and stack[depth][0] not in BLOCK:
                depth -= 1
            if stack[depth][0] in CLOSES[tag]:
                close(depth)
                if tag == "tr" and stack[-1][0] == "tr":
                    close(len(stack) - 1)
        _, above, container, out, inside, mark, _ = stack[-1]
        names = ""
        hidden = main = False
        if m[3] and not m[3].isspace():
            given: dict[str, str] = {}
            for a in _ATTRIBUTE.finditer(m[3]):
                given.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
            names = " ".join(given[k].lower() for k in ("class", "id", "role") if k in given and (k != "id" or tag not in TEXT))
            hidden = "hidden" in given or given.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", given.get("style", "")))
            main = "main" in given.get("role", "").lower().split()
        count += 1
        key = (above, f"{tag}.{names.strip()}")
        path = paths.setdefault(key, len(paths) + 1)
        content = tag in CONTENT or main
        # Only blocks are marked by class: an inline mark may be named anything.
        says = naming(names) if block and names and tag not in ("body", "html") else 0
        # What stands in for scripts is a notice, but for what it stands in for within an article.
        out = out or hidden or tag in BOILERPLATE or tag == "noscript" and not inside or tag in CONTENT and says == 3
        if says and not out and tag not in CONTENT:
            marks[count] = mark, says
            mark = count
        if block and tag not in LEAF and tag not in ("body", "html"):
            container = count
        stack.append((tag, path, container, out, inside or (count if content and not out else 0), mark, count))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
    say(page[at:])
    flush()
    close(1)
    return found, last, marks


def judged(found: list[Block], last: dict[int, int], marks: dict[int, tuple[int, int]]) -> dict[int, float]:
    """What the values of each mark's paths are multiplied by; 0 where its element is left out."""
    total = 0
    text: dict[int, int] = dict.fromkeys(marks, 0)
    articles: dict[int, int] = {}
    for b in found:
        n = len(b.text) - b.linked
        total += n
        if b.mark:
            text[b.mark] += n
        if b.inside:
            articles[b.inside] = articles.get(b.inside, 0) + n
    for own in sorted(marks, reverse=True):
        if around := marks[own][0]:
            text[around] += text[own]
    chief = sorted(a for a, n in articles.items() if n >= SHARE * max(articles.values()))
    factors = {0: 1.0}
    for own in sorted(marks):
        around, says = marks[own]
        at = bisect_right(chief, own)
        if at < len(chief) and chief[at] <= last[own]:  # no name tells against what holds the article
            factor = 1.0
        elif says == 1:
            factor = 1.0 if 2 * text[own] > total else LOWERED
        else:  # comments may be longer than what they are about, and what stands beside an article than the article
            factor = LOWERED if text[own] > (0.9 if says == 3 or chief else 0.5) * total else 0.0
        factors[own] = factor * factors[around]
    return factors


def select(found: list[Block], last: dict[int, int], factors: dict[int, float]) -> list[bool]:
    """Which blocks are content, by the fused and smoothed ratios of their paths."""
    if not found:
        return []
    ids = {p: i for i, p in enumerate(dict.fromkeys(b.path for b in found))}
    of = np.array([ids[b.path] for b in found])
    length = np.array([len(b.text) - b.linked for b in found], dtype=float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) for b in found], dtype=float)
    nodes = np.bincount(of)
    fused = np.bincount(of, length) / nodes * (1.0 + np.bincount(of, marks) / nodes)
    inside = np.array([b.inside for b in found])
    row = fused[of] * np.where(inside > 0, ARTICLE, 1.0)
    padded = np.concatenate([row[:1], row, row[-1:]])
    smooth = sum(w * padded[i : i + len(row)] for i, w in enumerate(KERNEL))
    smooth = smooth * np.array([factors[b.mark] for b in found])
    value = np.bincount(of, smooth) / nodes
    keep = value[of] >= SHARE * (smooth * length).sum() / max(1.0, length.sum())
    holders = {b.container for b, k in zip(found, keep) if k}
    of_article, place = np.unique(inside, return_inverse=True)
    held = np.bincount(place, length * keep)
    holders |= {int(a) for a, n in zip(of_article, held) if a and n and n >= SHARE * held.sum()}  # an article with a fair part of what is kept
    within, end = set(holders), 0
    for c in sorted({b.container for b in found} | holders):  # containers inside a holder hold content too
        if c and c in holders:
            end = max(end, last[c])
        if c and c <= end:
            within.add(c)
    return [bool(k) or b.container in (within if factors[b.mark] == 1.0 else holders) and b.linked <= 0.5 * len(b.text) for b, k in zip(found, keep)]


def main_text(page: str | None) -> str:
    found, last, marks = blocks(page or "")
    factors = judged(found, last, marks)
    found = [b for b in found if factors[b.mark]]
    return "\n\n".join(b.text for b, kept in zip(found, select(found, last, factors), strict=True) if kept)


def extract(df: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of every page; empty where there is none, as for a null page.

    Keeps every row, repeated ones too, and every column; one with the name of `text` is
    replaced. A page of any length is read whole.
    """
    return append_columns(df, [page], lambda pages: {text: [main_text(p) for p in pages]}, f"`{text}` string", rows=64)
