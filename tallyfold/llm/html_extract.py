"""Main text of web pages by wrapper induction.

Pages become trees of elements, in which neighbouring paragraphs, items, rows and the like (and long
runs of any one label) are one node, so that a list or an article of any length has one shape.  The
trees of one host are aligned by simple tree matching into one template per host.  Each aligned node
knows how many pages have it, how much text they have there and which texts most of them share there:
what is shared is constant, the rest varies.  The slot is found on the template: the article or main
element with much of the varying text, else the deepest node with nearly all of it, but never below a
varying heading or paragraphs of its own.  A page's tree is then aligned with its host's template, and
its text is all that stands where the slot is, constant or not.  Only a slot that no tag marks as
content loses the constant blocks at its two ends.

Labels say what alignment cannot: adverts and menus vary from page to page too.  Elements whose tag,
class, id or role names navigation, adverts, forms, comments and the like are never content.
"""

from __future__ import annotations

import html as html_entities
import json
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, Scratch, slices

# HTML elements by their role.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER_TAGS = set("head nav footer aside form button select option input textarea menu dialog template svg object iframe noscript script style title".split())
NEVER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login search form share sharing social related recommended recommendations comment comments commentlist respond disqus reviews "
    "widget widgets toolbar pager pagination skip copyright feedback discussion replies".split()
)
#: The part before them counts where the last ones only say what kind of box it is.
BOX_NAMES = set("area bar block bottom box buttons container icons inner item items left links list main posts right section slot text thread top unit widgets wrap wrapper zone".split())
#: Names with one of these and a box are those of layouts.
CONTENT_NAMES = {"article", "content", "entry", "page", "post", "story"}
NOT_NAMES = {"has", "no", "not", "with", "without"}
NEVER_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
CONTENT_TAGS = {"article", "main"}
CLOSES_P = BLOCKS - {"caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "summary"}

#: Levels of blocks that a path tells apart; what is nested deeper counts as part of the element there.
DEPTH = 64
#: Labels that are longer are told apart by their hash.
LABEL_CHARS = 40
#: Neighbouring siblings of these tags, and more than ``RUN`` of any one label, are one node.
REPEATED = set("p li tr td th dt dd pre blockquote h2 h3 h4 h5 h6".split())
RUN = 8
TEXT_TAGS = REPEATED | {"h1"}
#: Share of a node's pages that have one text there, for it to be constant (from two different pages on).
CONSTANT_SHARE = 0.6
#: Texts that a node counts: of a page at most the first and last two and all as one, so a count misses at
#: most a fifth of the node's pages: what 80 % share is found, what less than 60 % share is not.
SLOTS = 24
#: Share of the varying text that an article or main element has, to be the slot.
CONTENT_SHARE = 0.2
#: Share of a node's varying text that one kid has, for the slot to lie within it.
INNER_SHARE = 0.7
#: Share that paragraphs of its own have in a node that is the slot itself.
OWN_SHARE = 0.1
#: A template drops nodes that fewer of its pages have, unless they lead to the slot.
RARE_SHARE = 0.02
#: Trees that are aligned in one step.
FAN_IN = 128
#: Bytes of all hosts' names, paths and template texts up to which they are sent to every task.
BROADCAST_BYTES = 8_000_000
#: Beyond, the templates of hosts with more than one in so many of all rows are sent; the others' rows are shuffled.
HOT_HOSTS = 500

#: A quote counts right after an equals sign only; a tag whose quote is never closed ends at its first ``>``.
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)>?)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


class Node:
    __slots__ = ("label", "tag", "never", "named", "kids", "looked")

    def __init__(self, tag: str, label: str, never: bool, named: bool = False):
        self.tag, self.label, self.never, self.named, self.kids, self.looked = tag, label, never, named, [], False


def _never_name(name: str, inside: bool) -> bool:
    """Whether a class or id is that of no content; headers within an article are content."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x and not any(c.isdigit() for c in x)]
    if not parts or NOT_NAMES.intersection(parts):
        return False
    last = len(parts) - 1
    while last and parts[last] in BOX_NAMES:
        last -= 1
    if last < len(parts) - 1 and CONTENT_NAMES.intersection(parts):
        return False
    key = parts[last]
    return key in NEVER_NAMES and not (inside and key == "header")


def _names(attrs: str, inside: bool = False) -> tuple[str, bool, bool]:
    """The label's addition, whether the attributes say that this is no content, and whether the names do."""
    label, never, named = "", False, False
    if not attrs.strip():
        return label, never, named
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id"):
            # names with digits are mostly numbers of posts
            label += ("." if key == "class" else "#") + " ".join(x for x in value.split() if not any(c.isdigit() for c in x))
            named |= any(_never_name(x, inside) for x in value.split())
        elif key == "role":
            never |= value in NEVER_ROLES
        elif key == "hidden":
            never |= value != "until-found"
        elif key == "aria-hidden":
            never |= value == "true"
        elif key == "style":
            never |= "display:none" in value.replace(" ", "")
    if len(label) > LABEL_CHARS:
        label = f"{label[:16]}~{_hash('', label) & 0xFFFFFFFFFFFF:x}"
    return label.replace("/", "|"), never, named


def _sizes(root: Node) -> dict[int, int]:
    """Characters of text below each element, and in all of it, that may be content but for names."""
    size: dict[int, int] = {}
    stack = [(root, iter(root.kids))]
    size[id(root)] = 0
    while stack:
        node, kids = stack[-1]
        for k in kids:
            if isinstance(k, str):
                size[id(node)] += len(k) - k.count(" ") - k.count("\n")
            elif not k.never or k.named:
                size[id(k)] = 0
                stack.append((k, iter(k.kids)))
                break
        else:
            stack.pop()
            if stack:
                size[id(stack[-1][0])] += size[id(node)]
    return size


def parse(page: str) -> Node:
    """The page's tree; text is kept as str among the kids.  Open elements end with their parent;
    a paragraph also ends at the next block, a list item, cell or row at the next of its kind."""
    root = Node("html", "html", False)
    stack, at, inside, body = [root], 0, 0, False
    around: list[Node] = []  # named as no content, around a page's main part or heading
    names: list[Node] = []  # all that are
    opened: dict[str, int] = {}  # elements that are open, by tag

    def pop_to(i: int) -> None:
        nonlocal inside
        for n in stack[i:]:
            inside -= n.tag in CONTENT_TAGS
            opened[n.tag] -= 1
        del stack[i:]

    def push(node: Node) -> None:
        opened[node.tag] = opened.get(node.tag, 0) + 1
        stack.append(node)

    def close(*tags: str, until: tuple = ()) -> None:
        if not any(opened.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                pop_to(i)
                return
            if stack[i].tag in until:
                return

    while True:
        m = _TAG.search(page, at)
        if m is None:
            if at < len(page):
                stack[-1].kids.append(page[at:])
            if names:
                size = _sizes(root)
                for node in around:
                    node.never &= size.get(id(node), 0) <= size[id(root)] / 2
                if size[id(root)] and not blocks(root):
                    for node in names:  # names that leave nothing say nothing
                        node.never = False
            return root
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            close(tag, until=("html",))
            continue
        attrs = m[3] or ""
        if tag in ("html", "body"):
            if tag == "body" and not body:
                body = True
                close("head")
                node = Node("body", "body", False)
                root.kids.append(node)
                pop_to(1)
                push(node)
            continue
        if tag in CLOSES_P:
            close("p", until=("td", "th", "button", "li", "div", "article", "section", "blockquote"))
        if tag == "li":
            close("li", until=("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            close("dt", "dd", until=("dl",))
        elif tag in ("td", "th"):
            close("td", "th", until=("tr", "table"))
        elif tag == "tr":
            close("tr", until=("table",))
        elif tag == "option":
            close("option", until=("select",))
        name, never, named = _names(attrs, inside > 0)
        never = never or tag in NEVER_TAGS or tag == "header" and not inside
        named = named and not never and tag not in CONTENT_TAGS
        node = Node(tag, tag + name, never or named, named)
        if named:
            names.append(node)
        if tag in ("main", "h1"):
            for n in reversed(stack):
                if n.looked:
                    break
                n.looked = True
                if n.named:
                    around.append(n)
        stack[-1].kids.append(node)
        if tag in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag == "textarea":
                node.kids.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            inside += tag in CONTENT_TAGS
            push(node)


# --- a page's tree: [label, places of its own blocks, 0, kids]


def outline(root: Node) -> tuple[list, list[str]]:
    """The tree of a page's elements with text that may be content, and its blocks in page order."""
    texts: list[str] = []
    held: list[str] = []

    def flush(node: list) -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            node[1].append(len(texts))
            texts.append(text)

    tree: list = [root.label, [], 0, []]
    stack = [(iter(root.kids), tree, 0, True)]
    while stack:
        kids, node, depth, block = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                held.append(html_entities.unescape(kid))
            elif kid.tag == "br":
                held.append(" ")
            elif kid.tag in BLOCKS or kid.never:
                flush(node)
                if not kid.never:
                    inner = node
                    if depth < DEPTH:
                        inner = [kid.label, [], 0, []]
                        node[3].append(inner)
                    stack.append((iter(kid.kids), inner, min(depth + 1, DEPTH), True))
                    break
            else:
                stack.append((iter(kid.kids), node, depth, False))
                break
        else:
            stack.pop()
            if block:
                flush(node)
    return _fold(tree), texts


def _fold(node: list) -> list:
    """The tree without elements that have no text, runs of siblings as one node."""
    kids: list = []
    for label, run in groupby((k for k in map(_fold, node[3]) if k[1] or k[3]), key=lambda k: k[0]):
        same = list(run)
        if len(same) > 1 and (_tag(label) in REPEATED or len(same) > RUN):
            same = [_fold([label, [i for k in same for i in k[1]], 0, [x for k in same for x in k[3]]])]
        kids += same
    return [node[0], node[1], 0, kids]


def _tag(label: str) -> str:
    return re.split("[.#]", label, maxsplit=1)[0]


def blocks(root: Node) -> list[tuple[str, str]]:
    """(label, text) of each block with text that may be content, in page order."""
    tree, texts = outline(root)
    labels = [""] * len(texts)
    stack = [tree]
    while stack:
        node = stack.pop()
        for i in node[1]:
            labels[i] = node[0]
        stack += node[3]
    return list(zip(labels, texts, strict=True))


# --- templates: [label, pages, characters of its own, kids, [text, pages, characters] of frequent texts]


def shape(node: list, texts: list[str]) -> list:
    """The template of one page."""
    own = [texts[i] for i in node[1]]
    seen = {_hash(node[0], t): len(t) for t in (own if len(own) <= 4 else own[:2] + own[-2:])}
    size = sum(map(len, own))
    if len(own) > 1:
        seen[_hash(node[0], "\n".join(own))] = size
    return [node[0], 1, size, [shape(k, texts) for k in node[3]], sorted([h, 1, n] for h, n in seen.items())]


def _frequent(a: list, b: list) -> list:
    """Both lists of counted texts in one; of more than ``SLOTS`` the rarest go, and all lose as many pages (Misra-Gries)."""
    counts: dict[int, list[int]] = {}
    for h, pages, size in [*a, *b]:
        old = counts.setdefault(h, [0, size])
        old[0] += pages
    least = sorted((c for c, _ in counts.values()), reverse=True)[SLOTS] if len(counts) > SLOTS else 0
    return sorted([h, c - least, size] for h, (c, size) in counts.items() if c > least)


def constants(node: list) -> list[int]:
    """The texts that most pages with the node share there."""
    return [h for h, pages, _ in node[4] if pages >= 2 and pages >= CONSTANT_SHARE * node[1]]


def _pairs(xs: list, ys: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest set of pairs of kids with one label that keeps both orders, and its weight.

    Few kids share a label, so pairs are chained by a prefix maximum over the second order."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(ys):
        places.setdefault(y[0], []).append(j)
    best: list[tuple[int, int]] = [(0, -1)] * (len(ys) + 1)  # Fenwick tree: (weight, last pair)
    found: list[tuple[int, int, int]] = []
    top = (0, -1)
    for i, x in enumerate(xs):
        for j in reversed(places.get(x[0], ())):
            before, k = (0, -1), j
            while k:
                before = max(before, best[k])
                k -= k & -k
            mine = (before[0] + _match(x, ys[j], memo), len(found))
            found.append((i, j, before[1]))
            if mine[0] > top[0] or mine[0] == top[0] and found[top[1]][0] == i:  # of equals the first
                top = mine
            k = j + 1
            while k <= len(ys):
                if mine[0] > best[k][0] or mine[0] == best[k][0] and found[best[k][1]][0] == i:
                    best[k] = mine
                k += k & -k
    chain, at = [], top[1]
    while at >= 0:
        i, j, at = found[at]
        chain.append((i, j))
    return top[0], chain[::-1]


def _match(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the most pairs of nodes that keep labels, parents and order."""
    if a[0] != b[0]:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = _pairs(a[3], b[3], memo)[0] + 1 if a[3] and b[3] else 1
    return memo[key]


def align(a: list, b: list, memo: dict | None = None) -> list:
    """Both trees in one: matched nodes add up, the others are put in where they stand."""
    memo = {} if memo is None else memo
    xs, ys, kids, i, j = a[3], b[3], [], 0, 0
    for x, y in _pairs(xs, ys, memo)[1]:
        kids += [*xs[i:x], *ys[j:y], align(xs[x], ys[y], memo)]
        i, j = x + 1, y + 1
    return [a[0], a[1] + b[1], a[2] + b[2], [*kids, *xs[i:], *ys[j:]], *map(_frequent, a[4:], b[4:])]


def times(tree: list, n: int) -> list:
    """The template of ``n`` equal pages."""
    if n == 1:
        return tree
    return [tree[0], tree[1] * n, tree[2] * n, [times(k, n) for k in tree[3]], [[h, c * n, size] for h, c, size in tree[4]]]


def slot(tree: list) -> tuple[list[int], bool]:
    """The places of the kids that lead to the node of the content, and whether its tag says that it is content."""
    weights: dict[int, int] = {}

    def weigh(node: list) -> int:
        known = set(constants(node))
        own = max(0, node[2] - sum(pages * size for h, pages, size in node[4] if h in known))
        weights[id(node)] = own + sum(map(weigh, node[3]))
        return weights[id(node)]

    def weight(node: list) -> int:
        return weights[id(node)]

    def marked(node: list, least: float, path: list[int]) -> tuple[int, list[int], list] | None:
        """The heaviest content element below a node; the node above where there are several side by side."""
        here = [(weight(k), [*path, i], k) for i, k in enumerate(node[3]) if _tag(k[0]) in CONTENT_TAGS and weight(k)]
        if len(here) > 1 and _tag(node[0]) in CONTENT_TAGS:
            return None
        if len(here) > 1 and sum(w for w, _, _ in here) >= least:
            return sum(w for w, _, _ in here), path, node
        found = [x for x in here if x[0] >= least]
        for i, k in enumerate(node[3]):
            if _tag(k[0]) not in CONTENT_TAGS and weight(k) >= least and (x := marked(k, least, [*path, i])):
                found.append(x)
        return max(found, key=lambda x: x[0], default=None)

    def heading(node: list) -> bool:
        return bool(weight(node)) and (_tag(node[0]) in ("h1", *CONTENT_TAGS) or any(map(heading, node[3])))

    node, path, total = tree, [], weigh(tree)
    if not total:
        return path, False
    while (found := marked(node, CONTENT_SHARE * weight(node), path)) and found[1] != path:
        path, node = found[1], found[2]
    if _tag(node[0]) in CONTENT_TAGS or found:
        return path, _tag(node[0]) in CONTENT_TAGS
    while node[3]:
        at = max(range(len(node[3])), key=lambda i: weight(node[3][i]))
        kid, own = node[3][at], weight(node) - sum(map(weight, node[3]))
        own += sum(weight(k) for k in node[3] if _tag(k[0]) in TEXT_TAGS)
        if _tag(kid[0]) in TEXT_TAGS or weight(kid) < INNER_SHARE * weight(node) or own > OWN_SHARE * weight(node):
            break
        if any(heading(k) for i, k in enumerate(node[3]) if i != at):
            break
        node, path = kid, [*path, at]
    return path, False


#: Marks of a wrapper's nodes: off the way, on the way to the slot, the slot, a slot whose tag says that it is content.
OFF, WAY, SLOT, CONTENT = range(4)


def wrapper(tree: list) -> list:
    """What a page is held against: [label, constant texts, mark, kids], without nodes that few pages have."""
    path, content = slot(tree)
    least = RARE_SHARE * tree[1]

    def lean(node: list, depth: int) -> list:
        mark = OFF if depth < 0 else (CONTENT if content else SLOT) if depth == len(path) else WAY
        kids = []
        for i, k in enumerate(node[3]):
            way = mark == WAY and path[depth] == i
            if way or k[1] >= least:
                kids.append(lean(k, depth + 1 if way else -1))
        return [node[0], constants(node), mark, kids]

    return lean(tree, 0)


def _below(node: list) -> dict[int, str]:
    """The places of the blocks at and below a node, with their labels."""
    out: dict[int, str] = {}
    stack = [node]
    while stack:
        at = stack.pop()
        out.update((i, at[0]) for i in at[1])
        stack += at[3]
    return out


def main_text(page: str, wrap: list) -> str:
    """A page's text by its host's wrapper; where it has no such slot, by the slot of what varies on the page itself."""
    tree, texts = outline(parse(page))
    memo: dict = {}
    constant: set[int] = set()
    found, mark = None, SLOT
    stack = [(tree, wrap)]
    while stack:
        node, known = stack.pop()
        if known[2] in (SLOT, CONTENT):
            found, mark = node, known[2]
        if same := set(known[1]):
            whole = _hash(node[0], "\n".join(texts[i] for i in node[1])) in same
            constant.update(i for i in node[1] if whole or _hash(node[0], texts[i]) in same)
        stack += [(node[3][i], known[3][j]) for i, j in _pairs(node[3], known[3], memo)[1]]
    if found is None or not _below(found):
        path, content = slot(shape(tree, ["" if i in constant else t for i, t in enumerate(texts)]))
        found, mark = tree, CONTENT if content else SLOT
        for i in path:
            found = found[3][i]
    places = _below(found)
    kept = sorted(places)
    if mark == SLOT:
        deep = _tag(found[0]) not in ("html", "body")
        own = [i for i in places if i not in constant or deep and _tag(places[i]) == "h1"]
        kept = [i for i in kept if own and min(own) <= i <= max(own)]
    return "\n".join(texts[i] for i in kept)


def _hash(path: str, text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{path}\0{text}") - (1 << 63)


def _merge_trees(key: list[str]):
    """All trees of a group in one; their order doesn't depend on the order of arrival."""

    def merge(rows: pa.Table) -> pa.Table:
        trees = [times(json.loads(t), n) for t, n in sorted(zip(rows.column("tree").to_pylist(), rows.column("n").to_pylist(), strict=True), key=_shape_first)]
        out = trees[0]
        for t in trees[1:]:
            out = align(out, t)
        return pa.table({"host": rows.column("host").slice(0, 1), "tree": [json.dumps(out, separators=(",", ":"))], "n": pa.array([1], pa.int64())})

    return merge


def _shape_first(tree: tuple[str, int]) -> tuple:
    """Trees of one shape follow each other."""
    return re.sub("[0-9]+", "", tree[0]), tree


def _templates(trees: DataFrame, scratch: Scratch) -> DataFrame:
    """One aligned tree per host (``host``, ``tree``), in steps of about ``FAN_IN`` trees each, so that a
    host of any number of shapes is never in one task as a whole."""
    trees = trees.groupBy("host", "tree").agg(F.count("*").alias("n"))  # equal trees add up before they move
    step = scratch.save(trees, "trees")
    while True:
        most = step.groupBy("host").agg(F.count("*").alias("trees")).agg(F.max("trees").alias("m")).first().m or 0
        if most <= FAN_IN:
            return step.groupBy("host").applyInArrow(_merge_trees(["host"]), "host string, tree string, n long").select("host", "tree")
        salt = F.pmod(F.xxhash64("tree"), F.lit(-(-most // FAN_IN)))
        salted = step.select("host", "tree", "n", salt.alias("salt")).repartition("host", "salt")
        after = scratch.save(salted.groupBy("host", "salt").applyInArrow(_merge_trees(["host", "salt"]), "host string, tree string, n long"), "trees")
        scratch.drop(step)
        step = after


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (``page_id``, ``url``, ``html``; other columns ignored): ``page_id``,
    ``url``, ``text`` (blocks joined by line feeds, empty if there is none) and ``n_chars``.

    A null or empty page has no text, an empty table gives no rows.  Pages without a host (a null or odd
    address) share the empty one.  Repeated pages count once for their host's template, and each gets
    its text; a host of one page is its own template.  Where a page lacks its host's slot, the slot is
    found on the page alone.  Of kids with equally much varying text the first is taken.  A page of any
    length is read whole, by itself where it is longer than a batch.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def look(batches):
        for batch in batches:
            for part in slices(batch, "html", STEP_BYTES):
                marks, trees = [], []
                for page in part.column("html").to_pylist():
                    tree, texts = outline(parse(page))
                    trees.append(json.dumps(shape(tree, texts), separators=(",", ":")))
                    marks.append(_hash("", "\n".join(texts)))
                hosts = [host_of(u) for u in part.column("url").to_pylist()]
                yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "mark": pa.array(marks, pa.int64()), "tree": pa.array(trees, pa.string())})

    def wrap(batches):
        for batch in batches:
            wraps = [json.dumps(wrapper(json.loads(t)), separators=(",", ":")) for t in batch.column("tree").to_pylist()]
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "wrap": pa.array(wraps, pa.string())})

    looked = rows.select("url", "html").mapInArrow(look, "host string, mark long, tree string")
    seen = looked.groupBy("host", "mark").agg(F.min("tree").alias("tree"))
    wraps = scratch.save(_templates(seen.select("host", "tree"), scratch).mapInArrow(wrap, "host string, wrap string"), "wraps")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "html", STEP_BYTES):
                known: dict[str, list] = {}
                out = []
                for page, at in zip(part.column("html").to_pylist(), part.column("wrap").to_pylist(), strict=True):
                    if at not in known:
                        known[at] = json.loads(at)
                    out.append(main_text(page, known[at]))
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(out, pa.string())})

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = rows.withColumn("host", host)
    size = wraps.agg(F.coalesce(F.sum(F.length("host") + F.length("wrap") + 32), F.lit(0)).alias("bytes")).first().bytes
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(wraps), "host", "left")
    else:
        counts = scratch.save(rows.groupBy("host").agg(F.count("*").alias("rows")), "hosts")
        least = counts.agg(F.sum("rows")).first()[0] / HOT_HOSTS
        hot = F.broadcast(counts.filter(F.col("rows") > least).select("host"))
        joined = rows.join(F.broadcast(wraps.join(hot, "host", "left_semi")), "host").unionByName(
            rows.join(hot, "host", "left_anti").join(wraps, "host", "left").select("host", *[c for c in rows.columns if c != "host"], "wrap")
        )
    kind = next(f.dataType.simpleString() for f in rows.schema if f.name == "page_id")
    done = joined.select("page_id", "url", "html", "wrap").mapInArrow(cut, f"page_id {kind}, url string, text string")
    return done.withColumn("n_chars", F.char_length("text").cast("long"))
