"""Main text of web pages by tag-path ratios.

A page is read into text leaves, each under its path of tags from the root. Leaves inside elements
that are never article text by their tag (scripts, form controls and so on) are left out first, then
those inside elements that are usually not (navigation, headers, forms, hidden parts): but a form or
dialog that holds more text outside links than is left is a wrapper of the page and stays, and so does
any of them that holds ten times as much, what is in links not counted.
Elements with a class, id or role that is, or begins with, a word of a list are left out as well,
unless they hold more than half the characters of the page's content paths (for a whole name that is
not enough if an article or main part with text stands elsewhere); if that leaves nothing, the list is
not used. For every path the lengths and the punctuation marks of its leaves
are added up: the ratio of a path is its characters per leaf, the extended ratio weights them with
its punctuation per leaf. Both are smoothed over neighbouring leaves in page order, fused by
multiplication, and paths whose mean fused value passes a share of the page's mean are content if
their own value, without the neighbours, passes that share of it again. So are paths with a mark or
more per leaf whose own ratio passes the share of the page's mean ratio: few marks in a single leaf,
as in a lead, do not weigh against those of many leaves.
The content region is the article, main part or lowest container that holds all characters of these
paths. An article or main part in it with content is taken whole. Elsewhere leaves of content paths
make the text, and beside them every branch without content whose parent holds content directly, or
which has a heading, a punctuation mark or content before and after it and is not mostly links.

Pages are independent, so the work is one pass without a shuffle. Time and memory grow in proportion
to the page: tags are found by scanning once, paths are numbers, and what holds for an element is
handed down or added up once. After a tag whose quotes never close, tags end at the next `>`.

Defined results: null or empty html, or one without text, gives an empty text; html of any length
is read whole; an empty table gives no rows; a null id or url is kept; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by role, and words in class, id or role that mark what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NEVER = set("script style noscript template head title button select option textarea input "
            "iframe object svg math canvas audio video noembed noframes xmp".split())
ASIDE = set("nav header footer aside menu".split())
WRAPPERS = set("form fieldset label dialog".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong "
             "sub sup time tt u var wbr".split())
UNWANTED = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
               "consent disqus footer header masthead menu nav navbar navigation newsletter notice notices popup modal promo promoted "
               "related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget banner "
               "complementary contentinfo search login signup pagination pager".split())
REGIONS = ("article", "main", "section", "div", "td", "body")
KEPT_WHOLE = set("html body main article".split())
# An open element of the second kind ends when one of the first begins.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
             "main menu nav ol p pre section table ul".split())

_OPENS = re.compile(r"<(?:[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOPS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?¡¿…、。]")
_SPACE = re.compile(r"\s+")
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


@dataclass(slots=True)
class _Node:
    tag: str
    parent: int
    path: int  # number of its path of tags
    wanted: bool  # not in an element of NEVER
    link: bool = False
    named: int = 0  # by a word of UNWANTED, evidence only: 1 a name begins with one, 2 a name is one
    doubtful: int = 0  # usually no article text: 1 unless it holds more than is left, 2 unless it holds ten times as much


@dataclass
class _Page:
    nodes: list[_Node] = field(default_factory=lambda: [_Node("", -1, 0, True)])
    leaves: list[tuple[int, int, str]] = field(default_factory=list)  # node, block, raw text
    paths: dict[tuple[int, str], int] = field(default_factory=dict)  # by the path above and the last tag
    lengths: list[int] = field(default_factory=lambda: [0])  # characters a path has when written
    headings: list[bool] = field(default_factory=lambda: [False])  # whether a path leads through a heading

    def path(self, above: int, tag: str) -> int:
        key = above, tag
        if key not in self.paths:
            self.paths[key] = len(self.lengths)
            self.lengths.append(self.lengths[above] + 1 + len(tag))
            self.headings.append(self.headings[above] or tag in _HEADINGS)
        return self.paths[key]


def _attributes(written: str) -> dict[str, str]:
    """Names in lower case and values; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(written):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _doubtful(tag: str, attributes: dict[str, str]) -> int:
    if tag in WRAPPERS:
        return 1
    if tag in ASIDE:
        return 2
    if not attributes or tag in KEPT_WHOLE:
        return 0
    hidden = "hidden" in attributes and attributes["hidden"].lower() != "false" or attributes.get("aria-hidden", "").lower() == "true"
    return 2 if hidden or _NONE.search(attributes.get("style", "")) else 0


def _named(tag: str, attributes: dict[str, str]) -> int:
    if not attributes or tag in KEPT_WHOLE:
        return 0
    names = [name for a in ("class", "id", "role") for name in attributes.get(a, "").lower().split()]
    return max((1 + (w[0] == name) for name in names if (w := _WORD.match(name)) and w[0] in UNWANTED), default=0)


def read(page: str) -> _Page:
    """The text leaves of a page and their elements; unclosed and stray tags are taken as browsers do."""
    out = _Page()
    open_nodes, block, at = [0], 0, 0
    open_tags: defaultdict[str, int] = defaultdict(int)
    end = len(page)
    quotes = True  # a `>` in quotes does not end a tag

    def text(piece: str) -> None:
        if piece:
            out.leaves.append((open_nodes[-1], block, piece))

    def close(names: set[str], within: set[str]) -> None:
        """End the innermost open element of these names, unless one of `within` holds it back."""
        for name in names:
            if open_tags.get(name):
                break
        else:
            return
        for k in range(len(open_nodes) - 1, 0, -1):
            tag = out.nodes[open_nodes[k]].tag
            if tag in names:
                for n in open_nodes[k:]:
                    open_tags[out.nodes[n].tag] -= 1
                del open_nodes[k:]
                return
            if tag in within:
                return

    def past(mark: str, start: int) -> int:
        found = page.find(mark, start)
        return end if found < 0 else found + len(mark)

    def tag_end(start: int) -> int:
        """Place of the `>` that ends a tag, -1 if none does."""
        nonlocal quotes
        here = start
        while quotes:
            stop = _STOPS.search(page, here)
            if stop is None:
                quotes = False
            elif stop[0] == ">":
                return stop.start()
            else:
                here = page.find(stop[0], stop.end()) + 1
                quotes = here > 0
        return page.find(">", start)

    position = 0
    while position < end:
        m = _OPENS.search(page, position)
        if m is None:
            break
        if not m[2]:
            text(page[at:m.start()])
            if page.startswith("<!--", m.start()):
                at = position = past("-->", m.start() + 4)
            elif page.startswith("<![CDATA[", m.start()):
                at = position = past("]]>", m.start() + 9)
                text(entities.escape(page[m.start() + 9:at].removesuffix("]]>")))
            else:
                at = position = past(">", m.end())
            continue
        stop = tag_end(m.end())
        if stop < 0:
            break
        text(page[at:m.start()])
        written = page[m.end():stop]
        at = position = stop + 1
        tag = m[2].lower()
        if tag not in INLINE:
            block += 1
        if m[1]:
            close({tag}, set())
            continue
        if tag in ENDS_P:
            close({"p"}, {"article", "aside", "blockquote", "div", "li", "main", "section", "td", "th", "body", "button"})
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], {"ul", "ol", "dl", "table", "select", "div"})
        if tag in VOID or written.endswith("/") and tag not in RAW:
            if tag == "br":
                text(" ")
            continue
        above = open_nodes[-1]
        parent, attributes = out.nodes[above], _attributes(written) if written else {}
        out.nodes.append(_Node(tag, above, out.path(parent.path, tag) if tag not in INLINE else parent.path, parent.wanted and tag not in NEVER,
                               parent.link or tag == "a", _named(tag, attributes), _doubtful(tag, attributes)))
        open_nodes.append(len(out.nodes) - 1)
        open_tags[tag] += 1
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            text(page[at: closing.start() if closing else end])
            at = position = closing.start() if closing else end
    text(page[at:])
    return out


def _settled(nodes: list[_Node], leaves: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The leaves outside doubtful elements, or in those that hold too much to be left out."""
    around = [0] * len(nodes)  # the innermost doubtful element, itself included
    for k, node in enumerate(nodes[1:], 1):
        around[k] = k if node.doubtful else around[node.parent]
    holds: dict[int, int] = defaultdict(int)  # characters by innermost doubtful element, links not counted in one
    for node, _, piece in leaves:
        if not (around[node] and nodes[node].link):
            holds[around[node]] += len(piece.strip())
    kept, rest = {0}, sorted((k for k in holds if k), key=lambda k: (-holds[k], k))
    left = holds[0]
    for k in rest:
        chain, up = [], k
        while up not in kept:
            chain.append(up)
            up = around[nodes[up].parent]
        most = max(nodes[c].doubtful for c in chain)
        if holds[k] > left * (1 if most == 1 else 10):
            kept.update(chain)
            left += holds[k]
    return [leaf for leaf in leaves if around[leaf[0]] in kept]


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.array([0.25, 0.5, 0.25])
    return np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid") if len(x) > 1 else x


@dataclass
class _Found:
    """Blocks of text in page order, with what main_text chooses by."""

    blocks: list[tuple[int, int, str]]  # block, node, text
    path: list[int]
    chars: np.ndarray
    marks: np.ndarray
    linked: dict[int, int]  # characters in links, by block
    content: set[int]  # paths
    held: list[float]  # characters of content below each element


def _content(nodes: list[_Node], lengths: list[int], leaves: list[tuple[int, int, str]], share: float) -> _Found | None:
    """The content paths of these leaves; None without text."""
    blocks: dict[int, list[str]] = defaultdict(list)
    first: dict[int, int] = {}
    linked: dict[int, int] = defaultdict(int)
    for node, block, piece in leaves:
        blocks[block].append(piece)
        linked[block] += len(piece.strip()) * nodes[node].link
        if block not in first or lengths[nodes[node].path] < lengths[nodes[first[block]].path]:
            first[block] = node
    found = [(b, first[b], t) for b, parts in blocks.items() if (t := _SPACE.sub(" ", "".join(parts)).strip())]
    if not found:
        return None
    path = [nodes[node].path for _, node, _ in found]
    chars = np.array([len(t) for *_, t in found], float)
    marks = np.array([len(_MARKS.findall(t)) for *_, t in found], float)
    total: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for p, c, k in zip(path, chars, marks):
        for i, v in enumerate((1.0, c, k)):
            total[p][i] += v
    ratio = np.array([total[p][1] / total[p][0] for p in path])
    extended = np.array([total[p][1] / total[p][0] * (1 + total[p][2]) / (1 + total[p][0]) for p in path])
    own = dict(zip(path, np.sqrt(ratio * extended)))
    fused = np.sqrt(_smooth(ratio) * _smooth(extended))
    by_path: dict[int, list[float]] = defaultdict(list)
    for p, v in zip(path, fused):
        by_path[p].append(v)
    limit, plain = (share * float(np.average(x, weights=chars)) for x in (fused, ratio))
    content = {p for p, v in by_path.items() if sum(v) / len(v) >= limit and own[p] >= share * limit
               or total[p][1] >= plain * total[p][0] and total[p][2] >= total[p][0]} or set(path)
    held = [0.0] * len(nodes)
    for (_, node, _), p, c in zip(found, path, chars.tolist()):
        if p in content:
            held[node] += c
    for k in range(len(nodes) - 1, 0, -1):  # an element comes after its parent
        held[nodes[k].parent] += held[k]
    return _Found(found, path, chars, marks, linked, content, held)


def _unnamed(nodes: list[_Node], leaves: list[tuple[int, int, str]], it: _Found) -> list[tuple[int, int, str]]:
    """The leaves outside the named elements that are not taken for the text itself."""
    filled = set()  # elements with text
    for _, k, _ in it.blocks:
        while k >= 0 and k not in filled:
            filled.add(k)
            k = nodes[k].parent
    inside, articles = [False] * len(nodes), [0] * len(nodes)  # a named element; number of articles around, itself included
    for k, node in enumerate(nodes[1:], 1):
        inside[k] = inside[node.parent] or node.named > 0
        articles[k] = articles[node.parent] + (not inside[k] and k in filled and node.tag in ("article", "main"))
    declared = sum(articles[k] > articles[node.parent] for k, node in enumerate(nodes[1:], 1))
    out = [False] * len(nodes)
    for k, node in enumerate(nodes[1:], 1):
        most = 2 * it.held[k] > it.held[0]
        out[k] = out[node.parent] or node.named > 0 and not (most and (node.named == 1 or declared == articles[k]))
    return [leaf for leaf in leaves if not out[leaf[0]]]


def main_text(page: str | None, share: float = 0.25) -> str:
    """The article of a page: blocks joined by an empty line.

    `share` of the page's mean fused ratio makes a path content; the region holds all of them.
    """
    if not page:
        return ""
    tree = read(page)
    nodes, lengths = tree.nodes, tree.lengths
    leaves = _settled(nodes, [(node, block, entities.unescape(raw)) for node, block, raw in tree.leaves if nodes[node].wanted])
    all_found = _content(nodes, lengths, leaves, share)
    if all_found is None:
        return ""
    left = _unnamed(nodes, leaves, all_found)
    it = all_found if len(left) == len(leaves) else _content(nodes, lengths, left, share) or all_found
    found, path, chars, marks, linked, content, held = it.blocks, it.path, it.chars, it.marks, it.linked, it.content, it.held
    region = max(n for n, c in enumerate(held) if c >= held[0])  # the last opened one is the lowest
    above, k = [], region
    while k > 0:
        above.append(k)
        k = nodes[k].parent
    # A single block is no region: the article around it is, or else the next element that holds blocks.
    region = next((k for tags in (REGIONS[:1], REGIONS[:2], REGIONS) for k in above if nodes[k].tag in tags), 0)

    # What holds for an element of the region is handed down to those in it: the nearest container, whether an article or main
    # part with content is around, the nearest element with content, and the one below that, which begins a branch without content.
    n = len(nodes)
    inside, home, whole, filled, branch = [False] * n, [region] * n, [False] * n, [region] * n, [0] * n
    for k in range(region, n):
        node = nodes[k]
        if k != region and not inside[node.parent]:
            continue
        up = node.parent if k != region else region
        inside[k] = True
        home[k] = k if node.tag in REGIONS else home[up]
        whole[k] = (k != region and whole[up]) or node.tag in KEPT_WHOLE - {"html", "body"} and held[k] > 0
        filled[k] = k if held[k] else filled[up]
        branch[k] = 0 if held[k] else k if k != region and held[up] else branch[up]
    branches: dict[tuple[int, int], list[int]] = defaultdict(list)
    chosen, homes = set(), set()
    for i, (_, node, _) in enumerate(found):
        if not inside[node]:
            continue
        if path[i] in content:
            homes.add(home[node])
        if path[i] in content or whole[node]:
            chosen.add(i)
            continue
        branches[filled[node], branch[node] or -1 - i].append(i)
    inner = [i for i in range(len(found)) if path[i] in content]
    for (parent, _), beside in branches.items():
        text_like = (any(tree.headings[path[i]] for i in beside) or sum(marks[i] for i in beside) > 0 or inner[0] < beside[0] < inner[-1])
        if parent in homes or text_like and 2 * sum(linked[found[i][0]] for i in beside) <= sum(chars[i] for i in beside):
            chosen.update(beside)
    return "\n\n".join(found[i][2] for i in sorted(chosen))


def _extracted(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of pages but the html, and text, which replaces a column of that name."""
    kept = [c for c in pages.columns if c not in (html, "text")]
    return pages.select(*kept, F.pandas_udf(_extracted, "string")(F.col(html).cast("string")).alias("text"))
