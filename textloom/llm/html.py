"""HTML extraction by tree scoring.

A light parser builds the element tree of a whole page in linear time. Boilerplate elements (by tag, or hidden by attribute or
style) are cut; those whose class, id or role only sounds like boilerplate are cut unless they wrap an article or main element or,
where the page has neither, over half of its text, and paragraphs, list items and the like only for words of advertising. Each block of text passes
points for its length and commas to its ancestors, halved at each step and discounted by the ancestor's link density; the best
container (or the article or main element around it) is kept with those siblings that score well and the headings right before
what is kept.

Null, empty and text-free pages give the empty string. Rows are judged one by one, so equal rows and repeated ids give equal
rows; of equally good containers the outermost first in the page is kept; an empty table gives no rows; other columns, whatever
their names, are not read. A page of any length is read whole; elements nest 512 deep at most, further ones stand side by side.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: One attribute: name, then a value in quotes that close, or bare.
ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)?))?")
GAP = re.compile(r"[\s/]*")
DEPTH = 512
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CUT = frozenset("head script style noscript template nav footer header aside form button select textarea iframe object svg canvas dialog menu title noembed noframes datalist".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr center fieldset legend".split())
#: What an opening tag closes, up to a border.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ADVERT = r"ads?|advert\w*|adsense|sponsor\w*|promo|promoted|banner"
UNLIKELY = re.compile(
    rf"(?:[\w]+[_-])?(?:{ADVERT}|cookies?|consent|gdpr|notices?|popup|modal|overlay|paywall|sidebar|aside|comments?|disqus|respond|replies|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|toolbar|widget|complementary|contentinfo|dialog)(?:[_-][\w-]*)?",
    re.I,
)
ADS = re.compile(rf"(?:{ADVERT})(?:[_-][\w-]*)?", re.I)
#: Of these, a class that sounds like boilerplate says little ("market share"); none of NOT is boilerplate whatever it is called.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr tbody thead dd dt pre blockquote span em strong b i a figure figcaption caption code".split())
KEEP = frozenset(("html", "body", "article", "main"))
NEGATED = re.compile(r"(?:no|without|has|with|hide|show)[_-]", re.I)
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class Node:
    __slots__ = ("tag", "up", "cut", "odd", "core", "depth", "score", "size", "linked")

    def __init__(self, tag: str, up: Node | None, cut: bool, odd: bool = False):
        self.tag, self.up, self.cut, self.odd, self.core, self.depth = tag, up, cut, odd, False, up.depth + 1 if up else 0
        self.score, self.size, self.linked = 0.0, 0, 0


def _tag(page: str, at: int, last: dict[str, int]) -> tuple[int, str, list[tuple[str, str]], bool] | None:
    """(end, name, attributes, closed by itself) of the tag at a "<"; None if it is text."""
    m = NAME.match(page, at + 1)
    if not m or at > last[">"]:
        return None
    pos, found = m.end(), []
    while True:
        here = GAP.match(page, pos).end()
        if here >= len(page):
            end = page.find(">", at)  # quotes that swallow the page: the tag ends with the first angle
            return end + 1, m[0], found, False
        if page[here] == ">":
            return here + 1, m[0], found, page[here - 1] == "/"
        x = ATTR.match(page, here)
        pos = x.end()
        if x[2] is None and x[3] is None and not x[4] and pos < len(page) and page[pos] in "\"'" and page[here:pos].rstrip().endswith("="):
            if last[page[pos]] > pos:  # a quote that closes is part of the match above
                pos += 1
            else:
                y = re.compile(r"[^\s>]*").match(page, pos + 1)
                found.append((x[1].lower(), y[0]))
                pos = y.end()
            continue
        found.append((x[1].lower(), x[2] or x[3] or x[4] or ""))


def _sounds(tag: str, attrs: list[tuple[str, str]]) -> bool:
    words = [w for k, v in attrs if k in ("class", "id", "role") for w in v.split()]
    return any((ADS if tag in TEXT else UNLIKELY).fullmatch(w) and not NEGATED.match(w) for w in words)


def _unseen(attrs: list[tuple[str, str]]) -> bool:
    return any(k == "hidden" or k == "aria-hidden" and v.strip().lower() == "true" or k == "style" and UNSEEN.search(v) for k, v in attrs)


def _space(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def blocks(page: str) -> list[tuple[Node, str]]:
    """(element, text) of each block of text outside boilerplate, in page order."""
    root = top = Node("", None, False)
    out: list[tuple[Node, str]] = []
    run: list[str] = []
    owner = root
    linked = links = 0
    pos, n = 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    open_tags: Counter[str] = Counter()

    def pop(to: Node) -> None:
        nonlocal top
        while top is not to:
            open_tags[top.tag] -= 1
            top = top.up

    def flush() -> None:
        nonlocal linked
        if run:
            text = _space(run)
            if text and not owner.cut:
                out.append((owner, text))
                a = owner
                while a is not None:
                    a.size += len(text)
                    a.linked += min(linked, len(text))
                    a = a.up
            run.clear()
        linked = 0

    def close(tags, border) -> None:
        if not any(open_tags[t] for t in tags):
            return
        a = top
        while a.up is not None and a.tag not in border:
            if a.tag in tags:
                flush()
                pop(a.up)
            a = a.up

    def said(text: str) -> None:
        nonlocal owner, linked
        if text and not top.cut:
            if not run:
                owner = top
                while owner.tag and owner.tag not in BLOCK:
                    owner = owner.up
            run.append(text)
            if links:
                linked += len(text)

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            said(page[pos:])
            break
        said(page[pos:at])
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = end + 3 if end >= 0 else n
            continue
        if page[at + 1 : at + 2] in ("!", "?") and at < last[">"]:
            pos = page.find(">", at) + 1
            continue
        got = _tag(page, at, last)
        if got is None:
            said("<")
            pos = at + 1
            continue
        pos, tag, attrs, alone = got
        tag = tag.lower()
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "a":
                links = max(0, links - 1)
            if open_tags[tag] > 0:
                a = top
                while a.tag != tag:
                    a = a.up
                if tag in BLOCK or tag in CUT:
                    flush()
                pop(a.up)
            continue
        if tag in ("br", "wbr"):
            if tag == "br" and run:
                run.append(" ")
            continue
        if tag in BLOCK or tag in CUT:
            flush()
            close({"p"}, {"td", "th", "li", "div", "article", "section", "blockquote"})
            if tag in CLOSES:
                close(*CLOSES[tag])
        if tag in VOID or alone and tag not in BLOCK:
            continue
        if top.depth >= DEPTH:
            flush()
            pop(top.up)
        cut = top.cut or tag in CUT or bool(attrs) and tag not in KEEP and _unseen(attrs)
        top = Node(tag, top, cut, not cut and bool(attrs) and tag not in KEEP and _sounds(tag, attrs))
        open_tags[tag] += 1
        if tag in ("article", "main"):
            a = top
            while a is not None and not a.core:
                a.core, a = True, a.up
        links += tag == "a"
        if tag in RAW:  # no markup inside
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, pos)
            if not end:
                break
            pos = end.start()
    flush()
    return _without_odd(out, root)


def _without_odd(found: list[tuple[Node, str]], root: Node) -> list[tuple[Node, str]]:
    """Leaves out what stands in elements that sound like boilerplate, but for those around an article or most of the text."""
    ruled: dict[int, bool] = {}
    kept = []
    for node, text in found:
        path, a = [], node
        while a is not None and id(a) not in ruled:
            path.append(a)
            a = a.up
        out = ruled[id(a)] if a is not None else False
        for x in reversed(path):
            out = out or x.odd and not x.core and (root.core or 2 * x.size <= root.size)
            ruled[id(x)] = out
        if not out:
            kept.append((node, text))
    if len(kept) < len(found):
        for node, text in ((n, t) for n, t in found if ruled[id(n)]):  # sizes and links of what is left
            a = node
            while a is not None:
                a.size -= len(text)
                a.linked = min(a.linked, a.size)
                a = a.up
    return kept


def extract(page: str) -> str:
    found = blocks(page)
    if not found:
        return ""
    for node, text in found:
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        up, share = (node.up if node.tag in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "td", "li", "blockquote", "dd", "dt") and node.up else node), 1.0
        while up is not None and share > 0.05:
            up.score += points * share
            up, share = up.up, share / 2
    density = lambda x: 1 - x.linked / max(x.size, 1)
    seen: dict[int, Node] = {}
    for node, _ in found:
        while node is not None and id(node) not in seen:
            seen[id(node)] = node
            node = node.up
    best = max(seen.values(), key=lambda x: x.score * density(x))
    a = best
    while a is not None and a.tag not in ("article", "main"):
        a = a.up
    best = a or best
    value = best.score * density(best)
    chosen = {id(best)}
    for x in seen.values():
        if x.up is best.up and x is not best and best.up is not None:
            if x.score * density(x) >= max(1, 0.2 * value) or x.tag in ("p", "pre", "blockquote") and density(x) > 0.75 and x.size >= 80:
                chosen.add(id(x))
    stays: list[bool] = []
    for node, _ in found:
        a = node
        while a is not None and id(a) not in chosen:
            a = a.up
        stays.append(a is not None)
    for k in range(len(found) - 2, -1, -1):  # headings right before it
        node = found[k][0]
        if stays[k + 1] and re.fullmatch("h[1-6]", node.tag) and node.up in (best.up, best.up and best.up.up) and density(node) > 0.5:
            stays[k] = True
    return "\n\n".join(text for (_, text), stay in zip(found, stays) if stay)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""

    def run(ids, urls, values):
        got = [extract(h) for h in values]
        return ids, urls, got, [*map(len, got)]

    return map_batches(pages.select("page_id", "url", F.coalesce("html", F.lit(""))), run, "page_id long, url string, text string, n_chars long")
