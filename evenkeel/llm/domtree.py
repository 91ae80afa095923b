"""Blocks of text in a page and the elements around them, as a flat tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

#: Elements without content, those that don't begin a block, and those whose content isn't markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br img wbr input picture source track embed param area map link meta base".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that show no text.
UNSEEN = frozenset("script style title template iframe noembed noframes noscript object svg math canvas audio video".split())
#: What an opening element ends, and the elements that keep it from reaching further up.
ENDS = {t: (frozenset({"li"}), frozenset({"ul", "ol", "menu"})) for t in ("li",)}
ENDS |= {t: (frozenset({"dd", "dt"}), frozenset({"dl"})) for t in ("dd", "dt")}
ENDS |= {t: (frozenset({"td", "th"}), frozenset({"tr", "table"})) for t in ("td", "th")}
ENDS |= {"tr": (frozenset({"tr"}), frozenset({"table"})), "option": (frozenset({"option"}), frozenset({"select", "datalist"}))}
ENDS |= {t: (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")}
WALLS = frozenset("td th table button caption body html".split())

_MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_SENTENCE = re.compile(r"[.!?:;…。！？][\"'»”’)\]]*$")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Tree:
    """Nodes in page order, parents first. A node is an element that begins a block, or a block of text ("#text")."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)  # class, id and role
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters within links

    def add(self, tag: str, parent: int, names: str = "", text: str = "", linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def _tag(page: str, at: int, gone: set[str]) -> tuple[dict[str, str], int, bool]:
    """(attributes, place after the tag, closed by itself) of a tag whose name ends at ``at``. ``gone`` holds the quotes that don't occur any more."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if not m:
            end = page.find(">", at)
            return found, len(page) if end < 0 else end + 1, end > 0 and page[end - 1] == "/"
        at, value = m.end(), ""
        if m[2]:
            quote = page[at : at + 1]
            end = page.find(quote, at + 1) if quote in ("'", '"') and quote not in gone else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                if quote in ("'", '"'):
                    gone.add(quote)
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.setdefault(m[1].lower(), value)


def parse(page: str) -> Tree:
    """The tree of a page, in time that grows with its length; nothing in it is an error. Node 0 is the page."""
    tree = Tree()
    open_ = [(tree.add("#page", -1), "#page")]
    count: dict[str, int] = {}
    pieces: list[str] = []
    gone: set[str] = set()
    linked, link, unseen = 0, 0, 0  # link: depth of the block in which a link is open

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not unseen:
            pieces.append(unescape(raw) if "&" in raw else raw)
            if link:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if pieces:
            whole = " ".join("".join(pieces).split())
            if whole:
                tree.add("#text", open_[-1][0], text=whole, linked=min(linked, len(whole)))
            pieces.clear()
        linked = 0

    def pop() -> None:
        nonlocal link, unseen
        name = open_.pop()[1]
        count[name] -= 1
        unseen -= name in UNSEEN
        if link > len(open_):
            link = 0

    def close(names: frozenset[str], walls: frozenset[str]) -> None:
        """Ends the innermost open element of these names, unless a wall is in the way."""
        if any(count.get(n) for n in names):
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth][1] in names:
                    while len(open_) > depth:
                        pop()
                    return
                if open_[depth][1] in walls:
                    return

    at, size, ends = 0, len(page), {}
    while at < size:
        m = _MARKUP.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            if page.startswith((">", "->"), at):  # an empty comment
                at = page.index(">", at) + 1
                continue
            end = ends.get("-->", 0) if ends.get("-->", 0) < 0 else page.find("-->", at)
            ends["-->"] = end
            at = size if end < 0 else end + 3
            continue
        if m[0][-1] in "!?":
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        n = _NAME.match(page, at - 1)
        name, closing = n[0].lower(), m[0][1] == "/"
        attributes, at, alone = _tag(page, n.end(), gone)
        if closing:
            if name == "a":
                link = 0
            elif name not in INLINE and count.get(name):
                flush()
                close(frozenset({name}), frozenset())
            continue
        if name in INLINE:
            if name == "br":
                text(" ")
            elif name == "a":
                link = len(open_)
            continue
        if name in RAW:
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at) if ends.get(name, 0) >= 0 else None
            ends[name] = 0 if m else -1
            body, at = page[at : m.start() if m else size], m.end() if m else size
            at = (page.find(">", at) + 1 or size) if m else size
            if name not in UNSEEN:
                flush()
                open_.append((tree.add(name, open_[-1][0], _names(attributes)), name))
                count[name] = count.get(name, 0) + 1
                text(body)
                flush()
                pop()
            continue
        flush()
        if count.get("p"):
            close(frozenset({"p"}), WALLS)
        if name in ENDS:
            close(*ENDS[name])
        if name in VOID:
            continue
        if name in ("html", "body") and count.get(name):
            continue
        open_.append((tree.add(name, open_[-1][0], _names(attributes)), name))
        count[name] = count.get(name, 0) + 1
        unseen += name in UNSEEN
        if alone and name in ("svg", "math"):
            pop()
    flush()
    return tree


def _names(attributes: dict[str, str]) -> str:
    hidden = "hidden" in attributes or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I) or attributes.get("aria-hidden", "").lower() == "true"
    return " ".join([*(attributes.get(a, "") for a in ("class", "id", "role", "aria-label", "itemprop")), *(["hidden"] if hidden else [])]).strip()


@lru_cache(maxsize=100_000)
def name_parts(names: str) -> tuple[str, ...]:
    """Lower-case runs of letters of class, id and role, taken apart at capitals."""
    return tuple(dict.fromkeys(_PARTS.findall(_CAMEL.sub(" ", unescape(names[:400])).lower())))


def _step(x: float, ends: tuple[float, ...]) -> int:
    return sum(x >= e for e in ends)


#: What couples a node to its parent, by tag; the kinds below BOX are single blocks of text.
_KINDS = {t: k for k, ts in enumerate(("#text", "h1 h2 h3 h4 h5 h6 caption figcaption", "p li blockquote pre td th dd dt", "ul ol dl table tbody thead tr figure", "div section center", "article main", "nav aside footer header form button select textarea menu address dialog", "#page html body"), 0) for t in ts.split()}
KINDS = 9
BOX = 3


def features(tree: Tree) -> list[list[str]]:
    """The features of each node: tag, names and shape of what is below it for elements; size, links and end for text."""
    n = len(tree.tag)
    chars, linked, paragraphs, sentences = [len(t) for t in tree.text], list(tree.linked), [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        if tree.tag[i] == "#text":
            sentences[i] = int(bool(_SENTENCE.search(tree.text[i])))
        paragraphs[p] += tree.tag[i] == "p"
        sentences[p] += sentences[i]
    out, total = [], chars[0] or 1
    for i in range(n):
        tag, link = tree.tag[i], _step(linked[i] / (chars[i] or 1), (0.01, 0.3, 0.7))
        if tag == "#text":
            own = tree.text[i]
            size = f"words:{_step(own.count(' ') + 1, (2, 4, 8, 16, 32))}"
            found = ["#text", size, f"link:{link}", f"end:{sentences[i]}", f"in:{tree.tag[tree.parent[i]]}"]
            if "©" in own or "(c)" in own[:200].lower():
                found.append("copyright")
        else:
            found = ["tag:" + tag, f"at:{tag}/{tree.tag[tree.parent[i]] if i else ''}"]
            if _KINDS.get(tag, BOX) >= BOX:
                found += [f"share:{_step(chars[i] / total, (0.001, 0.05, 0.2, 0.4, 0.6, 0.9))}", f"links:{link}", f"paragraphs:{_step(paragraphs[i], (1, 2, 4))}", f"sentences:{_step(sentences[i], (1, 2, 4, 8))}"]
            found += ["name:" + p for p in name_parts(tree.names[i])]
        out.append(found)
    return out


def kinds(tree: Tree) -> list[int]:
    """What couples a node to its parent."""
    return [_KINDS.get(t, KINDS - 1) for t in tree.tag]
