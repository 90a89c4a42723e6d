"""HTML to a tree of blocks, forgiving what pages leave open, and numbers about its nodes."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

import numpy as np

#: HTML's elements without content, with raw content, those of the latter that run
#: to the page's end when left open, those of formulas and drawings, those within a line, and
#: what an open element ends at.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
TO_THE_END = {"script", "style"}
FOREIGN = set(
    "math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded "
    "mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover none semantics svg animate circle clippath defs desc ellipse filter foreignobject g image line "
    "lineargradient marker mask metadata path pattern polygon polyline radialgradient rect set stop switch "
    "symbol text textpath tspan use view".split())
INLINE = FOREIGN | set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr "
             "output picture progress q rp rt ruby s samp slot small span strike strong sub sup time tt u var".split())
BLOCK = set("address article aside blockquote body button caption center colgroup dd details dialog dir div dl dt "
            "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav "
            "ol optgroup option p pre section search select summary table tbody td template tfoot th thead tr ul".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
P_ENDS = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 "
             "h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))",
                        re.I)
_LABEL = re.compile(r'data-keep="(\w)"')
_PAIR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_MAYBE_HIDDEN = re.compile("hidden|display", re.I)
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")

#: Words in attributes, and elements, by what they hint at.
HINTS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip",
    "edge": "header footer head foot masthead banner topbar bottombar copyright colophon contentinfo",
    "side": "aside sidebar side rail widget complementary",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion adsense dfp",
    "notice": "cookie cookies consent notice gdpr alert modal popup overlay newsletter subscribe paywall dialog",
    "form": "form login signin signup register search searchbox contact button input select fieldset",
    "comment": "comment comments reply replies discussion disqus respond reader feedback",
    "social": "share sharing social related recommend recommended more trending popular tags follow",
    "content": "content article post entry story main body text prose page read copy",
    "wrap": "wrapper wrap container layout site app root row col grid outer inner",
}
_HINT = {word: 1 << i for i, words in enumerate(HINTS.values()) for word in words.split()}
_TAG_HINT = {"nav": "nav", "header": "edge", "footer": "edge", "aside": "side", "form": "form",
             "button": "form", "select": "form", "fieldset": "form", "dialog": "notice", "menu": "nav",
             "article": "content", "main": "content"}
_TAG_BIT = {tag: 1 << list(HINTS).index(hint) for tag, hint in _TAG_HINT.items()}
KINDS = [{"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"},
         {"table", "tbody", "tr", "td", "th", "thead"}, {"div", "section"}, {"html", "body"},
         {"pre", "blockquote", "figure", "figcaption"}, {"#text"}, {"article", "main"}, {"header"}, {"head"}]
_KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags}


def is_hidden(attributes: str) -> bool:
    """Whether an element has the attribute hidden, or a style without display."""
    if not _MAYBE_HIDDEN.search(attributes):
        return False
    return any(name.lower() == "hidden" or name.lower() == "style" and _NOT_SHOWN.search(html.unescape(a or b or c))
               for name, a, b, c in _PAIR.findall(attributes))


@dataclass
class _Open:
    """An open element: its node, or that of the block around it for a part of a line; for an
    unknown element of a line its attributes, and where in the line it began."""

    tag: str
    node: int
    line: bool = False
    lines: int = 0  # parts of lines that lie on each other up to this one
    attributes: str | None = None
    begin: int = 0
    linked: int = 0


class Page:
    """Blocks of a page: nodes in page order, parents before children.

    ``runs`` holds the texts: (node, text). A node that has both text and blocks gets a
    "#text" child for each run.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.hint, self.label = ["#page"], [-1], [0], [""]
        self.links: list[int] = [0]
        self.hidden = [False]
        self.runs: list[tuple[int, str, int]] = []
        self._read(source)
        self._split_mixed()

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        bits = _TAG_BIT.get(tag, 0)
        if "=" in attributes:
            for _, a, b, c in _ATTRIBUTE.findall(attributes):
                for word in _NAME.findall(a or b or c):
                    bits |= _HINT.get(word.lower(), 0)
        label = _LABEL.search(attributes) if "data-keep" in attributes else None
        self.tag.append(tag)
        self.parent.append(parent)
        self.hint.append(bits)
        self.label.append(label[1] if label else "")
        self.hidden.append(is_hidden(attributes))
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        """Text to runs, elements to nodes.

        An element that HTML does not know is part of a line until a block opens in it; then it
        is a block itself, from where it began. Counts of open elements by tag say what need not be
        looked for, so reading takes time in proportion to the page, however deep its nesting.
        """
        stack = [_Open("#page", 0)]
        count: dict[str, int] = {}
        text: list[str] = []
        linked = 0
        in_link = 0
        at = 0
        never_closed: set[str] = set()

        def emit(node: int, pieces: list[str], links: int) -> None:
            run = SPACE.sub(" ", "".join(pieces)).strip(" ")
            if run:
                self.runs.append((node, run, min(links, len(run))))

        def flush() -> None:
            nonlocal linked
            if text:
                emit(stack[-1].node, text, linked)
                text.clear()
            linked = 0

        def take(piece: str) -> None:
            nonlocal linked
            piece = html.unescape(piece)
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

        def push(element: _Open) -> None:
            stack.append(element)
            count[element.tag] = count.get(element.tag, 0) + 1

        def cut(depth: int) -> None:
            for element in stack[depth:]:
                count[element.tag] -= 1
            del stack[depth:]

        def find(tag: str) -> int:
            """Where the innermost open element of the tag is, 0 if there is none."""
            if not count.get(tag):
                return 0
            return next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)

        def make_blocks() -> None:
            """Unknown elements of the open line become blocks; what the line has in them goes along."""
            nonlocal linked
            first = len(stack)
            while stack[first - 1].line:
                first -= 1
            gone = spent = 0
            for i in range(first, len(stack)):
                element = stack[i]
                element.node = stack[i - 1].node
                if element.attributes is not None:
                    emit(element.node, text[gone:element.begin], element.linked - spent)
                    gone, spent = element.begin, element.linked
                    element.node = self._open(element.tag, element.node, element.attributes)
                    element.line, element.attributes = False, None
            del text[:gone]
            linked -= spent

        n = len(source)
        while at < n:
            found = _TOKEN.search(source, at)
            if not found:
                take(source[at:])
                break
            if found.start() > at:
                take(source[at:found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            tag = name.lower()
            if found[1] or found[4]:
                depth = find(tag)
                if tag == "a" and in_link:
                    in_link -= 1
                if depth and stack[depth].line:
                    if stack[-1].lines >= len(stack) - depth:  # nothing but parts of lines above it
                        cut(depth)
                elif depth:
                    flush()
                    cut(depth)
                    in_link = 0
                elif tag in ("p", "br"):
                    text.append(" ")
                continue
            if tag == "br":
                text.append(" ")
                continue
            attributes = found[3] if found[2] else found[6]
            if tag in RAW:
                if not attributes.endswith("/") and tag not in never_closed:
                    end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(source, at)
                    if end:
                        at = end.end()
                    elif tag in TO_THE_END:
                        at = n
                    else:
                        never_closed.add(tag)
                continue
            if tag in FOREIGN and attributes.endswith("/"):
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag not in BLOCK:
                if tag == "a":
                    in_link += 1
                told = None if tag in INLINE else attributes
                push(_Open(tag, stack[-1].node, True, stack[-1].lines + 1, told, len(text), linked))
                continue
            if tag in P_ENDS and count.get("p"):
                flush()
                cut(find("p"))
            if tag in ENDS:
                ended, bound = ENDS[tag]
                if any(count.get(x) for x in ended):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in bound:
                            break
                        if stack[i].tag in ended:
                            flush()
                            cut(i)
                            break
            if stack[-1].line:
                make_blocks()
            flush()
            in_link = 0
            lines = len(stack)
            while stack[lines - 1].line:
                lines -= 1
            cut(lines)
            push(_Open(tag, self._open(tag, stack[-1].node, attributes)))
        flush()

    def _split_mixed(self) -> None:
        has_blocks = set(self.parent)
        runs = []
        for node, text, linked in self.runs:
            if node in has_blocks:
                child = self._open("#text", node, "")
                self.label[child] = "0" if self.label[node] == "w" else self.label[node]
                node = child
            runs.append((node, text, linked))
        self.runs = runs

    def features(self) -> np.ndarray:
        """One row per node: its hints, its subtree's make-up and its place among siblings."""
        n = len(self.tag)
        own, linked, marks, blocks = ([0] * n for _ in range(4))
        first, last = [None] * n, [0] * n
        offset = 0
        for node, text, link in self.runs:
            own[node] += len(text)
            linked[node] += link
            marks[node] += text.count(".") + text.count(",")
            blocks[node] += 1
            if first[node] is None:
                first[node] = offset
            offset += len(text)
            last[node] = offset
        size, tags, heads, paras = own[:], [1] * n, [0] * n, [0] * n
        link, mark, runs = linked[:], marks[:], blocks[:]
        depth, above = [0] * n, [0] * n
        children, same = [0] * n, {}
        place = [0] * n
        # Text children come after all elements, so parents still precede children.
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            above[i] = above[p] | self.hint[p]
            place[i] = children[p]
            children[p] += 1
            same[p, self.tag[i]] = same.get((p, self.tag[i]), 0) + 1
        for i in range(n - 1, 0, -1):
            p, tag = self.parent[i], self.tag[i]
            size[p] += size[i]
            link[p] += link[i]
            mark[p] += mark[i]
            runs[p] += runs[i]
            tags[p] += tags[i]
            heads[p] += heads[i] + (_KIND.get(tag) == 1)
            paras[p] += paras[i] + (tag == "p")
            if first[i] is not None:
                first[p] = first[i] if first[p] is None else min(first[p], first[i])
            last[p] = max(last[p], last[i])
        total = max(1, offset)
        rows = []
        bits = range(len(HINTS))
        for i in range(n):
            p = max(0, self.parent[i])
            s = size[i]
            kind = [0.0] * (len(KINDS) + 1)
            kind[_KIND.get(self.tag[i], len(KINDS))] = 1.0
            h, a = self.hint[i], above[i]
            rows.append([
                depth[i], math.log1p(s), link[i] / max(1, s), math.log1p(tags[i]), s / tags[i],
                math.log1p(own[i]), mark[i] / max(1, s), math.log1p(runs[i]), s / max(1, runs[i]),
                s / total, (first[i] or 0) / total, last[i] / total, children[i],
                place[i] / max(1, children[p]), children[p], same.get((p, self.tag[i]), 0),
                heads[i], paras[i], paras[p], link[p] / max(1, size[p]), size[p] / total,
                *kind, *[h >> b & 1 for b in bits], *[a >> b & 1 for b in bits]])
        return np.array(rows, np.float64)


def keep_nodes(page: Page, odds: np.ndarray) -> list[bool]:
    """The most likely choice in which no kept node lies under a dropped one.

    ``odds`` are the nodes' log odds of being kept. From the leaves up, a node knows its best sum
    when kept, where each child may go either way, and when dropped, where all below it is.
    """
    n = len(page.tag)
    kept = np.minimum(0, odds) - np.log1p(np.exp(-np.abs(odds)))
    dropped = (kept - odds).tolist()
    kept = kept.tolist()
    for i in range(n):
        if page.hidden[i]:
            kept[i] = -1e9
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        kept[p] += max(kept[i], dropped[i])
        dropped[p] += dropped[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[page.parent[i]] and kept[i] >= dropped[i]
    return out
