"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is read into a tree of block elements. Pages of a host are aligned one
after the other with what is known of the host: child lists are matched by tag
and class; what only one side has becomes optional, what repeats (one element
or a group of any size) becomes a repetition, and texts become slots that
are fixed (the same on every page) or free. The result is a wrapper such as

    html(head(title(#)) body(nav(ul(li(#)+)) (div.ad(#))? article(h1(#) (p(#))+)))

Alignment also takes two wrappers, so partial wrappers of partitions are
merged in rounds: a host with a third of all pages is spread over all tasks.
All pages take part; their texts stay where they are.

The wrapper says what is template and what is content. A text is template where
it is the same in its slot while at least ``EVIDENCE`` different contents stand
around it (copies of a page count once; as many checksums are kept as that
takes). Of the host's article or main elements the one with most free text
outside links is its content; a host without them has it where most of the free
text is, found from the root downwards. A page without the host's content
element is judged alone.

Within an article or main element all stays that its page has, however often
other pages say the same, but for what HTML itself or a name takes out:
elements and roles for navigation, forms and the like, and a container one of
whose classes is, as a whole, a word for menus, adverts, notices or reader comments
("notice", "comment-list", but not "notice-board"). A paragraph, heading, list item or
cell with such a name goes only where the wrapper says that it is template. In
other content elements, which may be wider than the text, containers of template
go as well; headings and paragraphs don't. Around the content, and there alone,
such a word as a part of a name is enough.

A wrapper keeps every child that any page of its host has, so it grows with what
differs between pages. A list of more than ``LONG`` children is held packed, and
wrappers of about as many pages each are joined, so a child is unpacked once for
each doubling of the pages. Signs have three classes at most, none with digits.

Defined results
- null or empty html, or a page without text: an empty text, 0 characters
- a null or unreadable url is a host of its own kind ("")
- unclosed elements end where HTML ends them, elements nested deeper than DEEPEST are
  read as text of the one around; a lone "<" is text
- pages of any length are read whole; repeated pages and ids give repeated rows
- only the chosen columns are read; an empty table gives an empty table
"""

from __future__ import annotations

import base64
import html as entities
import json
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismill.llm.bpe import texts
from prismill.llm.store import Scratch

#: Fixed: elements of HTML by their part in a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
#: Drawings, players and notes of formulas: what stands in them isn't shown as text. Those of FOREIGN close themselves by "/>", and end where one of HTML's begins outside of HTML_IN.
MEDIA = frozenset("svg object canvas audio video annotation annotation-xml".split())
FOREIGN, HTML_IN = frozenset(("svg", "math")), frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
INLINE = frozenset(
    (
        "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
        "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot munder mover munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose mmultiscripts semantics"
    ).split()
)
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ENDS_FOREIGN = CLOSES_P | frozenset("b big body br center code dd dt em embed head i img li meta nobr ruby s small span strike strong sub sup tt u var".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: Elements and roles that are never content, and words for such things: a name made of these and of STRUCTURE says nothing else.
DROP_TAGS = frozenset("head nav footer aside form button select option menu dialog fieldset input search".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices notification alert banner popup modal overlay "
    "newsletter subscribe subscription signup login paywall social share sharing related recommended recommendations comment comments reply replies respond disqus widget toolbar pagination pager skip hidden search form".split()
)
STRUCTURE = frozenset("list section box area container wrapper wrap block thread panel bar content item inner outer top bottom left right main site page".split())
#: The same for elements outside the content only.
OUTER_WORDS = frozenset("header masthead topbar".split()) | DROP_WORDS
#: Elements that are text themselves: a name alone doesn't take them out of the content.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr caption figcaption address hr".split()) | INLINE
#: So many different contents around a text that stays the same make it template.
EVIDENCE = 4

#: Elements nested deeper are read as part of the element at this depth.
DEEPEST = 200

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element: its sign (tag and classes), children (elements or texts), and how it is to be read."""

    __slots__ = ("tag", "sign", "children", "drop", "outer", "block")

    def __init__(self, tag: str, sign: str, drop: bool, outer: bool, block: bool):
        self.tag, self.sign, self.drop, self.outer, self.block, self.children = tag, sign, drop, outer, block, []


_KNOWN: dict[tuple[str, str], tuple] = {}


def _element(tag: str, attributes: str) -> Node:
    key = (tag, attributes)
    if key not in _KNOWN:
        if len(_KNOWN) > 20_000:
            _KNOWN.clear()
        a = {m[0].lower(): entities.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(attributes)} if attributes else {}
        classes = [c for c in a.get("class", "").split() if not any(x.isdigit() for x in c)][:3]
        named = [{w.lower() for w in _PARTS.findall(c)} for c in (a.get("class", "") + " " + a.get("id", "")).split()]
        content = tag in ("main", "body", "html") or a.get("role") in ("main", "article")
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
        plain = not content and any(w & DROP_WORDS and w <= DROP_WORDS | STRUCTURE for w in named)
        comment = any(w & {"comment", "comments"} for w in named)
        drop = tag in DROP_TAGS or tag in MEDIA or hidden or plain and tag not in TEXT_LEVEL and (comment or tag != "article") or not content and a.get("role") in DROP_ROLES
        outer = tag == "header" or plain or not content and tag != "article" and any(w & OUTER_WORDS for w in named)
        sign = ".".join([tag, *classes]) if classes else f"{tag}#{a['id']}" if a.get("id", "").isalpha() else tag
        sign = "main" if a.get("role") == "main" else sign
        _KNOWN[key] = (tag, sign.replace("/", ""), drop, outer, tag not in INLINE)
    return Node(*_KNOWN[key])


def _foreign(stack: list[Node]) -> int:
    """Where the open elements of svg or math begin that end with the next one of HTML; the stack's length without any."""
    begin = len(stack)
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in HTML_IN:
            break
        if stack[k].tag in FOREIGN:
            begin = k
    return begin


def parse(page: str | None) -> Node:
    """The tree of a page below a root element."""
    root = Node("", "", False, False, True)
    stack, at, page, foreign = [root], 0, page or "", False
    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attributes = (m[3] if m[2] else m[6]) or ""
        begin = _foreign(stack) if foreign else len(stack)
        own = begin < len(stack)
        foreign = own or foreign and any(x.tag in FOREIGN for x in stack)
        if m[1] or m[4]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].block and k < begin:
                    break
            continue
        if own and tag in ENDS_FOREIGN:
            del stack[begin:]
            own = False
        if (own or tag in FOREIGN) and attributes.endswith("/"):
            stack[-1].children.append(_element(tag, attributes.rstrip("/")))
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table", "button", "object", "caption"):
                    break
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in BOUNDS.get(tag, ()):
                    break
                if stack[k].tag in SIBLINGS[tag]:
                    del stack[k:]
        if tag == "body" and stack[-1].tag == "head":
            stack.pop()
        node = _element(tag, attributes.rstrip("/"))
        stack[-1].children.append(node)
        raw = tag in RAW and (not own or tag in ("script", "style"))
        end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at) if raw else None
        if raw and (end or not own):
            node.drop = True
            if end is None:
                break
            at = page.find(">", end.start()) + 1 or n
        elif tag not in VOID and (len(stack) < DEEPEST or node.drop):
            stack.append(node)
            foreign = foreign or tag in FOREIGN
    return root


def blocks(node: Node, drops: dict[str, set[int]] | None = None, path: str = "", inner: bool = True) -> list[str]:
    """Texts of the blocks below an element in page order, white space made one space, without what is left out: drops has checksums by path."""
    drops = drops or {}
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            if text := " ".join(entities.unescape("".join(line)).split()):
                out.append(text)
            line.clear()

    def walk(x: Node, path: str) -> None:
        for c in x.children:
            if isinstance(c, str):
                line.append(c)
                continue
            if c.block:
                end()
            p = f"{path}/{c.sign}"
            if not c.drop and (inner or not c.outer) and not (p in drops and drops[p].intersection(wrapper(c)[SEEN])):
                walk(c, p)
            if c.block:
                end()

    walk(node, path)
    end()
    return out


# A wrapper's node is a list: sign, optional, repeated, for a fixed text up to EVIDENCE checksums of each element around it
# (parent first), characters, characters in links, the checksum of its text (None once two differ, "" without text), up to
# EVIDENCE checksums of the text, whether its name speaks against it, how many pages have it, children (packed where they are many).
SIGN, OPTIONAL, MANY, AROUND, CHARS, LINKS, FIXED, SEEN, OUTER, PAGES, KIDS = range(11)
#: Children beyond which their list is held packed.
LONG = 200


def _packed(kids: list[list]) -> list[list] | str:
    """The children of a node as it keeps them: a long list as compressed JSON."""
    return base64.b64encode(zlib.compress(json.dumps(kids, separators=(",", ":")).encode())).decode() if len(kids) > LONG else kids


def children(w: list) -> list[list]:
    """The children of a wrapper's node."""
    return json.loads(zlib.decompress(base64.b64decode(w[KIDS]))) if isinstance(w[KIDS], str) else w[KIDS]


def _opened(w: list) -> list:
    """A wrapper with no list packed."""
    return [*w[:KIDS], [_opened(k) for k in children(w)]]


def wrapper(node: Node, in_link: bool = False) -> list:
    """The wrapper of one page: inline elements are part of their block's text, left-out elements keep only their sign."""
    chars = links = crc = 0
    kids: list[list] = []
    todo = [(c, in_link) for c in reversed(node.children)]
    while todo:
        c, link = todo.pop()
        if isinstance(c, str):
            if text := c.strip():
                crc = zlib.crc32(text.encode("utf-8", "replace"), crc)
                chars += len(text)
                links += len(text) * link
        elif c.drop:
            if c.block and c.tag not in RAW and c.tag not in MEDIA:
                kids.append([c.sign, 0, 0, [], 0, 0, "", [], 1, 1, []])
        elif c.block:
            kids.append(wrapper(c, link))
        else:
            todo += [(x, link or c.tag == "a") for x in reversed(c.children)]
    for k in kids:
        chars, links = chars + k[CHARS], links + k[LINKS]
        if k[SEEN]:
            crc = zlib.crc32(str(k[SEEN]).encode(), crc)
    kids = folded(kids)
    below = kids[:]
    while below:
        k = below.pop()
        below += k[KIDS]
        if k[FIXED] not in (None, ""):
            k[AROUND].append([crc])
    return [node.sign, 0, 0, [], chars, links, crc if chars else "", [crc] if chars else [], int(node.outer), 1, kids]


def _joined(a: list, b: list, same_page: bool = False) -> list:
    """One node for two that match."""
    fixed = a[FIXED] if a[FIXED] == b[FIXED] else b[FIXED] if a[FIXED] == "" else a[FIXED] if b[FIXED] == "" else None
    kids = aligned(children(a), children(b))
    kids = kids if same_page else _packed(kids)
    pages = max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES]
    around = [] if fixed is None else b[AROUND] if a[FIXED] == "" else a[AROUND] if b[FIXED] == "" else [sorted({*x, *y})[:EVIDENCE] for x, y in zip(a[AROUND], b[AROUND], strict=True)]
    return [a[SIGN], a[OPTIONAL] | b[OPTIONAL], a[MANY] | b[MANY] | same_page, around, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], fixed, sorted({*a[SEEN], *b[SEEN]})[:EVIDENCE], a[OUTER] & b[OUTER], pages, kids]


def folded(kids: list[list]) -> list[list]:
    """Repetitions of one sibling, then of groups of siblings from short to long, made one node."""
    out: list[list] = []
    for k in kids:
        if out and out[-1][SIGN] == k[SIGN]:
            out[-1] = _joined(out[-1], k, same_page=True)
            out[-1][MANY] = 1
        else:
            out.append(k)
    done = 1
    while size := _shortest([k[SIGN] for k in out], done):
        done, i = size, 0
        while i + 2 * size <= len(out):
            if _same(out, i, i + size, size):
                group = _group(out[i : i + size])
                j = i + size
                while _same(out, i, j, size):
                    group = _joined(group, _group(out[j : j + size]), same_page=True)
                    j += size
                group[MANY] = 1
                out[i:j] = [group]
            i += 1
    return out


def _same(kids: list[list], i: int, j: int, size: int) -> bool:
    return j + size <= len(kids) and all(kids[i + t][SIGN] == kids[j + t][SIGN] for t in range(size))


def _shortest(signs: list[str], above: int) -> int:
    """The least length over ``above``, which is 1 at least, of a run of signs that follows on itself; 0 where none does."""
    at: dict[tuple[str, str], list[int]] = {}
    best = 0
    for j, pair in enumerate(zip(signs, signs[1:], strict=False)):
        for i in reversed(at.get(pair, ())):
            size = j - i
            if best and size >= best:
                break
            if size > above and j + size <= len(signs) and signs[i + 1 : j] == signs[j + 1 : j + size]:
                best = size
        at.setdefault(pair, []).append(j)
    return best


def _group(kids: list[list]) -> list:
    return ["(" + " ".join(k[SIGN] for k in kids) + ")", 0, 0, [], sum(k[CHARS] for k in kids), sum(k[LINKS] for k in kids), None, [], 0, max(k[PAGES] for k in kids), kids]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Two child lists as one: matches in order, everything else optional. What repeats in one is looked for in the other."""
    for x, y in ((a, b), (b, a)):
        known = {k[SIGN] for k in y}
        for g in [k for k in x if k[SIGN].startswith("(")]:
            signs, i = [k[SIGN] for k in children(g)], 0
            while known.issuperset(signs) and i + len(signs) <= len(y):
                if [k[SIGN] for k in y[i : i + len(signs)]] == signs:
                    y[i : i + len(signs)] = [_group(y[i : i + len(signs)])]
                    known.add(g[SIGN])
                i += 1
    alike = next((t for t, (x, y) in enumerate(zip(a, b, strict=False)) if x[SIGN] != y[SIGN]), min(len(a), len(b)))
    out = [_joined(x, y) for x, y in zip(a[:alike], b[:alike], strict=True)]
    a, b = a[alike:], b[alike:]
    longest, i, j = _longest([k[SIGN] for k in a], [k[SIGN] for k in b]), 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][SIGN] == b[j][SIGN]:
            out.append(_joined(a[i], b[j]))
            i, j = i + 1, j + 1
        else:
            take_a = j >= len(b) or i < len(a) and longest(i + 1, j) >= longest(i, j + 1)
            k = (a[i] if take_a else b[j])[:]
            k[OPTIONAL] = 1
            out.append(k)
            i, j = i + take_a, j + (not take_a)
    return folded(out)


def _longest(a: list[str], b: list[str]) -> Callable[[int, int], int]:
    """The length of the longest common subsequence of a[i:] and b[j:], as a function of i and j.

    Of a row of the table a bit says where it doesn't grow, for those of b that a has as well, the last one first;
    what b doesn't have leaves the row as it is. So long lists with little in common cost little more than their length.
    """
    both, left, at = set(a).intersection(b), [0], {}
    for sign in reversed(b):
        if sign in both:
            at[sign] = at.get(sign, 0) | 1 << left[-1]
        left.append(left[-1] + (sign in both))
    left.reverse()
    whole = (1 << left[0]) - 1
    rows = [whole]
    for sign in reversed(a):
        row, some = rows[-1], rows[-1] & at.get(sign, 0)
        rows.append(((row + some) | (row - some)) & whole if some else row)
    rows.reverse()
    return lambda i, j: left[j] - (rows[i] & ((1 << left[j]) - 1)).bit_count()


def pattern(w: list) -> str:
    """The wrapper as an expression: # is a free text slot, = a fixed one."""
    kids = children(w)
    own = " ".join(map(pattern, kids))
    slot = "" if kids or w[FIXED] == "" else "#" if w[FIXED] is None else "="
    text = own if w[SIGN].startswith("(") or not w[SIGN] else f"{w[SIGN]}({own or slot})"
    return f"({text})" + "+" * w[MANY] * (not w[OPTIONAL]) + "*" * (w[MANY] and w[OPTIONAL]) + "?" * (w[OPTIONAL] and not w[MANY]) if w[MANY] or w[OPTIONAL] else text


def _children(w: list, path: str) -> Iterator[tuple[list, str]]:
    for k in w[KIDS]:
        if k[SIGN].startswith("("):
            yield from _children(k, path)
        else:
            yield k, f"{path}/{k[SIGN]}"


def _tag(sign: str) -> str:
    return re.split(r"[.#]", sign)[0]


def template(w: list, depth: int = 0) -> bool:
    """Whether a node's text stays the same while what stands around it differs: around its ancestor of that number, its root by default."""
    return w[FIXED] not in (None, "") and len(w[AROUND][depth - 1] if w[AROUND] else ()) >= EVIDENCE


def free(w: list) -> int:
    """Characters below a node that are neither template nor in links."""
    if w[OUTER] or template(w):
        return 0
    own = w[CHARS] - w[LINKS] - sum(k[CHARS] - k[LINKS] for k in w[KIDS])
    return own + sum(map(free, w[KIDS]))


def content(w: list) -> tuple[list[str], list[tuple[str, int]]]:
    """From a host's wrapper the path of its content, and path and checksum of the template's blocks that go."""
    w = _opened(w)
    found: dict[str, list[list]] = {}

    def look(x: list, path: str, tag: str) -> None:
        for k, p in _children(x, path):
            if _tag(k[SIGN]) == tag and k[CHARS]:
                found.setdefault(p, []).append(k)
            else:
                look(k, p, tag)

    for tag in ("article", "main"):
        if not found:
            look(w, "", tag)
    if found:
        best = max(found, key=lambda p: (sum(map(free, found[p])), sum(k[CHARS] for k in found[p])))
        found = {best: found[best]}
    else:
        node, path = w, ""
        while True:
            some = [(free(k) - k[LINKS], k, p) for k, p in _children(node, path) if not k[MANY] or _tag(k[SIGN]) in ("div", "section")]
            top = max(some, key=lambda x: x[0], default=(0, None, ""))
            if top[1] is None or top[0] < 0.6 * max(1, free(node) - node[LINKS]) or _tag(top[1][SIGN]) in ("p", "h1", "h2", "h3", "pre", "ul", "ol", "table", "blockquote"):
                break
            node, path = top[1], top[2]
        found = {path: [node]}
    drops = []
    for path, nodes in found.items():
        for x in nodes:
            todo = list(_children(x, path)) if len(x[SEEN]) >= EVIDENCE else []
            wide = _tag(x[SIGN]) not in ("article", "main")
            while todo:
                k, p = todo.pop()
                if (k[OUTER] or wide and _tag(k[SIGN]) not in TEXT_LEVEL) and template(k, p.count("/") - path.count("/")):
                    drops.append((p, k[FIXED]))
                else:
                    todo += _children(k, p)
    return sorted(found), sorted(set(drops))


def at_path(root: Node, paths: set[str]) -> list[tuple[Node, str]]:
    """Elements at these paths, outermost only, in page order and not below what is left out."""
    out: list[tuple[Node, str]] = []

    def walk(x: Node, path: str) -> None:
        for c in x.children:
            if not isinstance(c, str) and not c.drop:
                p = f"{path}/{c.sign}" if c.block else path
                if p in paths:
                    out.append((c, p))
                else:
                    walk(c, p)

    if "" in paths:
        return [(root, "")]
    walk(root, "")
    return out


def main_text(page: str | None, rule: str | None) -> str:
    """The main text of a page under its host's rule (JSON of content paths, and of paths and checksums of fixed blocks)."""
    root = parse(page)
    paths, drops = json.loads(rule) if rule else ([], [])
    found = at_path(root, set(paths)) if paths else []
    if not found:
        paths, drops = content(wrapper(root))
        found = at_path(root, set(paths))
    fixed: dict[str, set[int]] = {}
    for p, crc in drops:
        fixed.setdefault(p, set()).add(crc)
    # A header within an article is part of it; around anything wider it is the site's.
    parts = [blocks(x, fixed, p, inner=_tag(x.sign) in ("article", "main")) for x, p in found]
    return " ".join(b for part in parts for b in part)


def host(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


#: Hosts whose wrappers a task holds at once before it passes them on, and characters of the pages that these are of.
HELD_HOSTS, HELD_CHARS = 2000, 16 << 20
#: Rules of so many bytes are sent to every executor; beyond that pages are joined with them by host.
BROADCAST_BYTES = 8 << 20


def _add(held: list[tuple[int, list]], w: list) -> None:
    """Put a wrapper to those of its host: two that have been joined as often are joined, so what is held doubles in size."""
    times = 0
    while held and held[-1][0] <= times:
        before, other = held.pop()
        w, times = _joined(other, w), before + 1
    held.append((times, w))


def _whole(held: list[tuple[int, list]]) -> list:
    w = held[-1][1]
    for _, other in reversed(held[:-1]):
        w = _joined(other, w)
    return w


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[int, list]]] = {}
    chars = 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([json.dumps(_whole(x)) for x in held.values()])], names=["host", "wrapper"])
    for batch in batches:
        at = 0
        for part in texts(batch.column("html")):
            urls = batch.column("url").slice(at, len(part)).to_pylist()
            at += len(part)
            for u, page in zip(urls, part, strict=True):
                _add(held.setdefault(host(u), []), wrapper(parse(page)))
                chars += len(page or "")
                if len(held) > HELD_HOSTS or chars > HELD_CHARS:
                    yield out()
                    held.clear()
                    chars = 0
    if held:
        yield out()


def _merged(frame):
    import pandas as pd

    held: list[tuple[int, list]] = []
    for x in frame["wrapper"]:
        _add(held, json.loads(x))
    return pd.DataFrame({"host": frame["host"].iloc[:1], "part": [0], "wrapper": [json.dumps(_whole(held))]})


#: Partial wrappers of one host that a task puts together.
FAN_IN = 16


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wrapper as JSON) from pages with url and html. Partial wrappers meet in rounds of ``FAN_IN``, so no host is one task's work."""
    some = pages.select("url", "html").mapInArrow(_partial, "host string, wrapper string")
    some = scratch.table(some.withColumn("part", F.lit(0)).select("host", "part", "wrapper"), "partial")
    while (most := some.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 1:
        parts = 1 if most <= FAN_IN else -(-2 * most // FAN_IN)  # by hash, so about half of what a task may get
        dealt = some.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(parts)).cast("int"))
        some = scratch.table(dealt.groupBy("host", "part").applyInPandas(_merged, "host string, part int, wrapper string"), "partial")
    return some.select("host", "wrapper")


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rules = [json.dumps(content(json.loads(w))) for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(rules)], names=["host", "rule"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text (the main text) and n_chars (its code points)."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    d = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    rules = scratch.table(wrappers(d, scratch).mapInArrow(_rules, "host string, rule string"), "rules")
    size = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + F.octet_length("host")), F.lit(0))).first()[0]
    kind = d.schema["key"].dataType.simpleString()
    if size <= BROADCAST_BYTES:
        known = {r.host: r.rule for r in rules.collect()}

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _texts(batch, lambda b: [known.get(host(u)) for u in b.column("url").to_pylist()])

        out = d.mapInArrow(apply, f"key {kind}, url string, text string, n_chars bigint")
    else:

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(host, batch.column("url").to_pylist()), pa.string())], names=[*batch.schema.names, "host"])

        def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _texts(batch, lambda b: b.column("rule").to_pylist())

        hosted = d.mapInArrow(named, f"key {kind}, url string, html string, host string")
        out = hosted.join(rules.hint("merge"), "host", "left").mapInArrow(given, f"key {kind}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("key", key).withColumnRenamed("url", url)


def _texts(batch: pa.RecordBatch, rules) -> Iterator[pa.RecordBatch]:
    at = 0
    for part in texts(batch.column("html")):
        rows = batch.slice(at, len(part))
        at += len(part)
        got = [main_text(p, r) for p, r in zip(part, rules(rows), strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["key", "url", "text", "n_chars"])
