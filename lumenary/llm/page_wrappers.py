"""Operator 6: main text of web pages by inferred wrappers (union-free regular expressions).

A page is a tree of blocks and texts; inline marks are no structure. Among siblings, groups that stand side by side
again and again fold into a repeated group (one sibling first, then two, and so on); a long list of siblings
that no repetition explains becomes a repeated group of optional ones. The pages of a host are then aligned one after
the other, from the root down: texts that differ at one place become a slot, equal ones stay constants with the number
of pages that show them; a mismatch of blocks is resolved first as a repetition (one side shows once what the other repeats),
and else what one side lacks becomes optional. What is left is the host's wrapper.

The wrapper decides what is main text, place by place:

1. Never: what stands in menus, asides, footers, scripts, dialogs and the like, by element or role.
2. Elements named after such parts (class or id; a whole name, not any that contains the word) are boilerplate unless they hold the article or
   nearly all of the host's text. Names that can be either (header, notice, related, ...) and `header` are read off the
   wrapper: inside an article they stay where their text changes from page to page.
3. With article or main elements: the outermost ones with the most text; a headline outside stays if it changes from page to page.
4. Without: all in the innermost block that holds most of the text; outside it, constants of the host's pages and link lists go.

Each page is matched against its host's wrapper, and each of its texts takes the decision of the place that it matches.
A host with one page has a wrapper without evidence, and rules 2 to 4 go by what that page holds. If nothing of a page is kept, its texts
outside named parts are, and then all of them but those of rule 1.

All pages take part in the inference. Tasks align their own pages host by host and send one partial wrapper for each host; these are
merged in two steps, so that no task meets all of a host with a third of all pages. Places deeper than DEPTH blocks belong to
the block there. A wrapper is as large as a host's layouts, not as its pages.

Nulls: null or empty html gives empty text; a null or odd url belongs to the host ''. Empty table: empty result. Repeated rows
are read alike, and count once within a task. Pages of any length, and cut off anywhere, are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialize

HOSTS_AT_ONCE, MERGERS, DEPTH, LONG, FOLDED = 2_000, 64, 100, 48, 512

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
#: Elements without content; those that a like one ends; those that end a paragraph and part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIBLINGS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
#: What is never main text: elements and roles.
NEVER_TAGS = frozenset("head nav footer aside script style noscript template textarea title button select option iframe svg canvas dialog menu object".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Names of parts. A class or id is the name of a part if it is one of these words, ends in one, or is a topic with a holder ("related-posts").
PARTS = frozenset("ad ads advert adverts advertisement sponsor sponsored sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus cookie cookies consent gdpr newsletter subscribe subscription signup login popup modal pagination pager".split())
TOPICS = frozenset("ad ads advert banner cookie cookies consent gdpr newsletter share sharing social related recommended popular sponsored promo comment comments reply nav menu sidebar footer signup login subscribe".split())
HOLDERS = frozenset("box bar list links link buttons button icons posts articles stories items widget area wrap wrapper container section block panel slot unit banner form notice popup thread tools consent message overlay".split())
#: Names of either; words that make a name something else ("no-comments", "article-header").
EITHER = frozenset("header banner promo notice notices notification alert respond reply share sharing social related recommended popular widget overlay toolbar".split())
OTHERWISE = frozenset("with without no non not has have is and or of article content post entry main story text body page-body".split())
SOFT, FIRM, NEVER = 1, 2, 3


def name_mark(name: str) -> int:
    """What a class or id says of its element: FIRM if it names a part that is no main text, SOFT if it may, else 0."""
    found = [x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if x]
    if not found or not OTHERWISE.isdisjoint(found):
        return 0
    if found[-1] in PARTS or len(found) > 1 and found[0] in TOPICS and found[-1] in HOLDERS:
        return FIRM
    return SOFT if found[-1] in EITHER else 0


def _label(name: str, attributes: str) -> tuple[str, int]:
    """A tag with its class and id, and its mark."""
    mark, label = NEVER if name in NEVER_TAGS else FIRM if name == "form" else 0, name
    if attributes and not attributes.isspace():
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                label += ("." if key == "class" else "#") + ".".join(value.split())
                if name not in ("article", "main", "body", "html"):
                    mark = max(mark, *(name_mark(x) for x in value.split()), 0)
            elif key == "role":
                mark = max(mark, NEVER if value.lower() in NEVER_ROLES else FIRM if value.lower() == "form" else 0)
                label += "@main" if value.lower() == "main" else ""
            elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                mark = NEVER
    return label, mark


def tokens(html: str) -> list[tuple]:
    """('o', label, name, mark), ('c', name), ('v', name) and ('t', decoded text); bodies of scripts and the like are left out."""
    out, at, size = [], 0, len(html)
    labels: dict[tuple[str, str], tuple[str, int]] = {}
    while at < size:
        m = MARKUP.search(html, at)
        if m is None:
            out.append(("t", unescape(html[at:])))
            break
        if m.start() > at:
            out.append(("t", unescape(html[at : m.start()])))
        at = max(m.end(), m.start() + 1)
        if (name := m[2]) is None:
            continue
        name = name.lower()
        if m[1]:
            out.append(("c", name))
        elif name in VOID:
            out.append(("v", name))
        else:
            key = (name, m[3])
            if key not in labels:
                labels[key] = _label(*key)
            out.append(("o", labels[key][0], name, labels[key][1]))
            if m[3].endswith("/") and name in ("svg", "path"):
                out.append(("c", name))
            elif name in RAW:
                end = RAW[name].search(html, at)
                at = end.end() if end else size
                out.append(("c", name))
    return out


def walk(stream: list[tuple]) -> Iterator[tuple]:
    """Each token with the open elements [(name, mark)] in which it stands; elements that HTML ends by itself are ended."""
    open_: list[tuple] = []
    for token in stream:
        if token[0] == "o":
            _, _, name, mark = token
            ends = SIBLINGS.get(name, ("p",) if name in BLOCKS else ())
            if ends:
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] in ends:
                        del open_[k:]
                        break
                    if open_[k][0] in BLOCKS:
                        break
            yield token, open_
            open_.append((name, mark))
        elif token[0] == "c":
            yield token, open_
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == token[1]:
                    del open_[k:]
                    break
        else:
            yield token, open_


class Node:
    """A block ("e": label, mark, items), a text ("t") or a repeated group ("+": items) of a page or wrapper. A text is a constant,
    or None for a slot; it has the number of pages with it, the characters taken, and those in links. Of a page it also has the
    numbers of the texts there (leaves)."""

    __slots__ = ("kind", "label", "mark", "items", "text", "pages", "mass", "links", "optional", "leaves", "keep")

    def __init__(self, kind: str, label: str = "", mark: int = 0, items: list | None = None, text: str | None = None, pages: int = 1, mass: int = 0, links: int = 0, optional: bool = False, leaves: list | None = None):
        self.kind, self.label, self.mark, self.items = kind, label, mark, items
        self.text, self.pages, self.mass, self.links, self.optional, self.leaves, self.keep = text, pages, mass, links, optional, leaves, None

    def key(self) -> str:
        if self.kind == "e":
            return self.label
        return "#" if self.kind == "t" else "+" + ("*" if self.label else "|".join(x.key() for x in self.items))

    def pack(self) -> list:
        return [self.kind, self.label, self.mark, [x.pack() for x in self.items] if self.items is not None else None, self.text, self.pages, self.mass, self.links, int(self.optional)]

    @classmethod
    def unpack(cls, a: list) -> Node:
        return cls(a[0], a[1], a[2], [cls.unpack(x) for x in a[3]] if a[3] is not None else None, a[4], a[5], a[6], a[7], bool(a[8]))

    def __str__(self) -> str:
        """As an expression: constants as they are, # for a slot."""
        if self.kind == "t":
            out = "#" if self.text is None else repr(self.text)
        else:
            out = " ".join(map(str, self.items))
            out = f"({out})+" if self.kind == "+" else f"<{self.label}> {out} </>" if out else f"<{self.label}/>"
        return f"({out})?" if self.optional else out


def page_tree(html: str | None) -> tuple[Node, list[str]]:
    """A page as a tree, and its texts in order: those of no element that is never main text. A text ends where a block begins or ends."""
    root, leaves = Node("e", "", 0, []), []
    nodes: list[Node | None] = []  # of each open element; None for inline marks
    held, links, place = [], 0, root

    def flush():
        nonlocal links
        text = " ".join("".join(held).split())
        if text:
            place.items.append(Node("t", text=text, mass=len(text), links=min(links, len(text)), leaves=[len(leaves)]))
            leaves.append(text)
        held.clear()
        links = 0

    depth = 0
    for token, open_ in walk(tokens(html or "")):
        kind = token[0]
        if len(nodes) > len(open_):
            gone = [x for x in nodes[len(open_) :] if x is not None]
            del nodes[len(open_) :]
            if gone:
                flush()
                depth -= len(gone)
                place = next((x for x in reversed(nodes) if x is not None), root)
        if kind == "t" or kind == "v" and token[1] == "br":
            if not any(m == NEVER or m == FIRM and n not in BLOCKS for n, m in open_):
                text = token[1] if kind == "t" else "\n"
                held.append(text)
                if any(n == "a" for n, _ in open_):
                    links += len(text)
        elif kind == "o":
            _, label, name, mark = token
            node = None
            if name in BLOCKS:
                flush()
                if mark != NEVER and depth < DEPTH and not any(m == NEVER for _, m in open_):
                    if name == "header" and not any(n in ("article", "main") for n, _ in open_):
                        mark = max(mark, SOFT)
                    node = Node("e", label, mark, [])
                    place.items.append(node)
                    place = node
                    depth += 1
            elif name in ("td", "th"):
                held.append(" ")
            nodes.append(node)
        elif token[1] in BLOCKS:
            flush()
    flush()
    _settle(root)
    return root, leaves


def _settle(root: Node) -> None:
    """Folds what repeats, from the leaves up; blocks without text are left out."""
    stack, order = [root], []
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in node.items if x.kind == "e")
    for node in reversed(order):
        node.items = fold([x for x in node.items if x.kind == "t" or x.items])


def _join(a: Node, b: Node, within: bool) -> Node:
    """One node from two with one key, of one page or of two."""
    a.optional |= b.optional
    if a.kind == "t":
        a.text = a.text if a.text == b.text else None
        a.pages = max(a.pages, b.pages) if within else a.pages + b.pages
        a.mass += b.mass
        a.links += b.links
        if a.leaves is not None and b.leaves is not None:
            a.leaves += b.leaves
    else:
        if a.kind == "e":
            a.mark = max(a.mark, b.mark)
            a.pages = max(a.pages, b.pages) if within else a.pages + b.pages
        a.items = align(a.items, b.items, within)
    return a


def _any_order(items: list[Node]) -> list[Node]:
    """A repeated group of optional items, one for each key, that stands for any sequence of them."""
    found: dict[str, Node] = {}
    for x in items:
        for y in x.items if x.kind == "+" else [x]:
            own = y.key()
            found[own] = _join(found[own], y, True) if own in found else y
    for x in found.values():
        x.optional = True
    return [Node("+", "*", 0, list(found.values()))]


def fold(items: list[Node]) -> list[Node]:
    """Groups that repeat side by side become one repeated group; short groups first. What stays too long becomes one group of optional ones."""
    size = 1
    while 2 * size <= len(items):
        if size > 1 and len(items) > FOLDED:
            break
        keys, out, k = [x.key() for x in items], [], 0
        while k < len(items):
            group, end = keys[k : k + size], k + size
            if keys[end : end + size] == group and len(group) == size and not (size == 1 and items[k].kind == "+"):
                held = items[k:end]
                while keys[end : end + size] == group:
                    held = [_join(a, b, True) for a, b in zip(held, items[end : end + size])]
                    end += size
                out.append(Node("+", items=held))
                k = end
            else:
                out.append(items[k])
                k += 1
        size = size + 1 if len(out) == len(items) else 1
        items = out
    return items if len(items) <= LONG else _any_order(items)


def _grouped(items: list[Node], want: list[str]) -> list[Node]:
    """Each run of items with these keys becomes a group."""
    keys, k, out = [x.key() for x in items], 0, []
    while k < len(items):
        if keys[k : k + len(want)] == want:
            held = items[k : k + len(want)]
            group = Node("+", items=held, optional=all(x.optional for x in held))
            for x in held if group.optional else ():
                x.optional = False
            out.append(group)
            k += len(want)
        else:
            out.append(items[k])
            k += 1
    return out


def _repeats(items: list[Node], others: list[Node]) -> list[Node]:
    """Where the other side repeats a group that stands here once, it becomes a repeated group here too."""
    for group in others:
        if group.kind == "+" and not group.label:
            items = _grouped(items, [x.key() for x in group.items])
    return items


def align(a: list[Node], b: list[Node], within: bool = False) -> list[Node]:
    """The items that match what either side matches."""
    loose = any(x.kind == "+" and x.label for x in (*a, *b))
    if not loose and [x.key() for x in a] == [x.key() for x in b]:
        return [_join(x, y, within) for x, y in zip(a, b)]
    if not a or not b:
        for x in a or b:
            x.optional = True
        return a or b
    if loose or max(len(a), len(b)) > LONG:
        (one,), (two,) = _any_order(a), _any_order(b)
        own = {x.key(): x for x in one.items}
        for y in two.items:
            k = y.key()
            own[k] = _join(own[k], y, within) if k in own else y
        one.items = list(own.values())
        return [one]
    a, b = _repeats(a, b), _repeats(b, a)
    out: list[Node] = []
    for kind, i, j, k, m in SequenceMatcher(None, [x.key() for x in a], [x.key() for x in b], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [_join(x, y, within) for x, y in zip(a[i:j], b[k:m])]
        else:
            for x in (*a[i:j], *b[k:m]):
                x.optional = True
                out.append(x)
    return out if len(out) <= LONG else _any_order(out)


class HostWrapper:
    """What a host's pages have in common so far."""

    def __init__(self):
        self.root: Node | None = None

    def add(self, tree: Node) -> None:
        if tree.items:
            self.root = tree if self.root is None else _join(self.root, tree, False)


def infer(pages: list[str | None]) -> Node:
    """The wrapper of a host's pages, with its decisions."""
    host = HostWrapper()
    for html in pages:
        host.add(page_tree(html)[0])
    return decide(host.root or Node("e", "", 0, []))


def _named(node: Node) -> bool:
    return node.kind == "e" and (re.split(r"[.#@]", node.label)[0] in ("article", "main") or "@main" in node.label)


def _places(root: Node) -> list[tuple[Node, tuple[Node, ...]]]:
    """The texts of a wrapper with the blocks above each, from the root down."""
    out, stack = [], [(root, ())]
    while stack:
        node, above = stack.pop()
        if node.kind == "t":
            out.append((node, above))
        else:
            here = (*above, node) if node.kind == "e" else above
            stack.extend((x, here) for x in reversed(node.items))
    return out


def _holder(node: Node) -> bool:
    """Whether a block can hold an article (and is not the page)."""
    return re.split(r"[.#@]", node.label)[0] in ("div", "section", "center", "details", "fieldset", "form", "table", "tbody", "tr", "dd")


def decide(root: Node) -> Node:
    """Sets `keep` of each text; see the module's note."""
    places, pages = _places(root), root.pages
    mass: dict[int, int] = {}
    slots: dict[int, int] = {}
    articles: set[int] = set()
    heads: set[int] = set()
    for t, above in places:
        fixed = t.text is not None and t.pages >= 2
        headline = any(x.label.split(".")[0].split("#")[0] == "h1" for x in above)
        for k, x in enumerate(above):
            mass[id(x)] = mass.get(id(x), 0) + t.mass
            slots[id(x)] = slots.get(id(x), 0) + (0 if fixed else t.mass)
            if any(_named(y) for y in above[k + 1 :]):
                articles.add(id(x))
            if headline and not fixed and pages >= 2:
                heads.add(id(x))
    total = mass.get(id(root), 0)

    def part(node: Node, inside: bool) -> bool:
        """Whether a marked block is boilerplate."""
        own = mass[id(node)]
        if not node.mark or id(node) in articles:
            return False
        if node.mark == FIRM:
            return own <= 0.9 * total
        if inside:
            return pages >= 2 and 2 * slots[id(node)] < own
        return own <= 0.5 * total and id(node) not in heads

    left = []
    for t, above in places:
        inside = t.keep = False
        for x in above:
            if part(x, inside):
                break
            inside |= _named(x)
        else:
            left.append((t, above, next((x for x in above if _named(x)), None)))
    # what three pages or all show alike, and three in ten of those that have the block around it
    around = {id(t): above[max(0, len(above) - 2)].pages for t, above in places}
    common = lambda t: t.text is not None and t.pages >= max(2, min(3, pages)) and t.pages >= 0.3 * around[id(t)]
    roots: dict[int, int] = {}
    for t, _, named in left:
        if named is not None:
            roots[id(named)] = roots.get(id(named), 0) + t.mass
    if roots:
        best = max(roots.values())
        chosen = {k for k, n in roots.items() if 2 * n >= best}
        inner: dict[int, int] = {}
        headed = False
        for t, above, named in left:
            if named is not None and id(named) in chosen:
                if any(_named(x) and x is not named for x in above):
                    inner[id(named)] = inner.get(id(named), 0) + t.mass
                headed |= any(x.label.startswith("h1") for x in above)
        for t, above, named in left:
            if named is not None and id(named) in chosen:
                beside = 2 * inner.get(id(named), 0) >= roots[id(named)] and not any(_named(x) and x is not named for x in above)
                t.keep = not (beside and (2 * t.links > t.mass or common(t)))
            elif named is None and not headed and pages >= 2:
                t.keep = any(x.label.startswith("h1") for x in above) and not common(t)
        return root
    known, fixed = sum(t.mass for t, *_ in left), sum(t.mass for t, *_ in left if common(t))
    varied = pages >= 2 and 2 * fixed <= known
    plain: dict[int, int] = {}
    for t, above, _ in left:
        for x in above:
            plain[id(x)] = plain.get(id(x), 0) + (t.mass - t.links if not (varied and common(t)) else 0)
    most = plain.get(id(root), 0)
    core, deepest = None, 0
    for _, above, _ in left:
        for k, x in enumerate(above):
            if k > deepest and most and _holder(x) and plain[id(x)] >= 0.6 * most:
                core, deepest = x, k
    for t, above, _ in left:
        t.keep = core in above or not (varied and common(t)) and (2 * t.links <= t.mass or not most)
    return root


def compact(node: Node) -> list:
    """A decided wrapper for matching: [kind, label, optional, decision or items]. A block whose texts are decided alike is one decision."""
    if node.kind == "t":
        return ["t", "", node.keep]
    items = [compact(x) for x in node.items]
    found = {x[2] if not isinstance(x[2], list) else None for x in items}
    same = len(found) == 1 and None not in found
    if node.kind == "e":
        return ["e", node.label, found.pop() if same else items]
    return ["+", node.label, items]


def _key(c: list) -> str:
    return c[1] if c[0] == "e" else "#" if c[0] == "t" else "+" + ("*" if c[1] else "|".join(map(_key, c[2])))


def match(items: list[Node], wrapper: list[list], verdicts: dict[int, bool]) -> None:
    """Gives the texts of a page's items the decisions of the places of the wrapper that they match."""
    todo = [(items, wrapper)]
    while todo:
        a, b = todo.pop()
        pairs = _pairs(a, b)
        for x, c in pairs:
            if c[0] == "t" or c[0] == "e" and not isinstance(c[2], list):
                stack = [x]
                while stack:
                    y = stack.pop()
                    if y.kind == "t":
                        verdicts.update(dict.fromkeys(y.leaves, c[2]))
                    else:
                        stack += y.items
            else:
                todo.append((x.items, c[2]))


def _pairs(a: list[Node], b: list[list]) -> list[tuple[Node, list]]:
    """Items of a page and the places of a wrapper that match them."""
    keys_a, keys_b = [x.key() for x in a], [_key(c) for c in b]
    if keys_a == keys_b and "+*" not in keys_b:
        return list(zip(a, b))
    loose = lambda c: [y for x in c for y in (loose(x[2]) if x[0] == "+" else [x])]
    if "+*" in keys_b or "+*" in keys_a:
        by_key = {_key(c): c for c in reversed(loose(b))}
        flat = lambda xs: [y for x in xs for y in (flat(x.items) if x.kind == "+" else [x])]
        return [(x, by_key[x.key()]) for x in flat(a) if x.key() in by_key]
    for c in b:
        if c[0] == "+":  # what stands once here and is repeated there
            a = _grouped(a, [_key(x) for x in c[2]])
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, [x.key() for x in a], keys_b, autojunk=False).get_opcodes():
        if kind == "equal":
            out += zip(a[i:j], b[k:m])
        elif j > i:  # no place in order: by key alone
            by_key = {_key(c): c for c in reversed(loose(b))}
            out += [(y, by_key[y.key()]) for x in a[i:j] for y in (x.items if x.kind == "+" else [x]) if y.key() in by_key]
    return out


def extract(html: str | None, wrapper: list | None = None) -> str:
    """The blocks of main text, parted by an empty line, by a compact wrapper, or by that of the page alone."""
    tree, leaves = page_tree(html)
    if not leaves:
        return ""
    if wrapper is None:
        wrapper = compact(decide(_copy(tree)))
    verdicts: dict[int, bool] = {}
    match([tree], [wrapper], verdicts)
    marks = {k: mark for t, above in _places(tree) for mark in [max(x.mark for x in above)] for k in t.leaves}
    kept = [k for k in range(len(leaves)) if verdicts.get(k, marks[k] < FIRM)]
    if not kept:
        kept = [k for k in range(len(leaves)) if marks[k] < FIRM] or range(len(leaves))
    return "\n\n".join(leaves[k] for k in kept)


def _copy(tree: Node) -> Node:
    return Node.unpack(tree.pack())


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, expression, wrapper): a host's wrapper as an expression and, for matching, as JSON; from rows with host and html, over all pages."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % MERGERS
        hosts: dict[str, HostWrapper] = {}
        seen: set[int] = set()

        def send():
            found = [(h, json.dumps(w.root.pack())) for h, w in sorted(hosts.items()) if w.root is not None]
            hosts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([part] * len(found), pa.int32()), pa.array([x[1] for x in found], pa.string())], names=["host", "part", "wrapper"])

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mark = xxhash.xxh64_intdigest(html or "")
                if mark in seen:
                    continue
                seen.add(mark)
                hosts.setdefault(host, HostWrapper()).add(page_tree(html)[0])
                if len(hosts) >= HOSTS_AT_ONCE:
                    yield send()
        yield send()

    def merged(rows: pd.DataFrame) -> Node:
        host = HostWrapper()
        for w in sorted(rows["wrapper"]):
            host.add(Node.unpack(json.loads(w)))
        return host.root

    def some(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(merged(rows).pack())]})

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        root = decide(merged(rows))
        return pd.DataFrame({"host": [key[0]], "expression": [str(root)], "wrapper": [json.dumps(compact(root))]})

    first = pages.select("host", "html").mapInArrow(partial, "host string, part int, wrapper string")
    fewer = first.groupBy("host", "part").applyInPandas(some, "host string, wrapper string")
    return fewer.groupBy("host").applyInPandas(whole, "host string, expression string, wrapper string")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row with page_id, url, html."""
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    # written first, so that its size is known: small enough, it is broadcast and no page moves; else AQE splits the pages of a hot host
    wrappers = materialize(host_wrappers(rows).select("host", "wrapper"), "wrappers")

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, list] = {}
        for html, wrapper in batches:
            out = []
            for h, w in zip(html, wrapper):
                if w is not None and w not in known:
                    if len(known) > 5_000:
                        known.clear()
                    known[w] = json.loads(w)
                out.append(extract(h, known[w] if w is not None else None))
            yield pd.Series(out, dtype=object)

    found = rows.join(wrappers, "host", "left").select("page_id", "url", read("html", "wrapper").alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_page_wrappers(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
