"""Main-text extraction by wrapper induction over pages of one host.

Pages are parsed into light DOM trees. A host's pages are dealt into chunks of
about ``chunk`` pages, so a hot host is many groups. Within a chunk the trees
are aligned by simple tree matching (dynamic programming over the children of
nodes with equal tags) against a wrapper tree, which starts as the first page and
grows by the nodes of later pages that it lacks. A text node whose aligned counterparts
read alike on nearly all distinct pages is template, inside <article> and <main> too
(there on ``INNER_PAGES`` at least: a few articles may share a line); nodes that vary are
slots. Only texts that occur on so many distinct pages can become
template, so subtrees without any are left out of the alignment, which changes nothing.
Pages that read alike count once: copies of an article do not make it a template.

Content is what stands in slots, without the parts that HTML itself or common
class names mark as page furniture (menus, footers, forms, adverts, notices,
comments). Where a page marks its content by <article> or <main>, the outermost of these
hold it; of several, those that are mostly links are left out.

Defined cases: null or empty html gives empty text; unclosed tags, comments and
truncated markup are read to the end of the page; nesting may be of any depth; of
attributes only those of exactly the names looked for count (not data-class); repeated pages each get their
row; null or odd URLs share the empty host.
"""

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import plus
from strandloom.llm.url_filter import host_of

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']*(?:\"[^\"]*\"|'[^']*'))*[^>\"']*|[^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Fixed values of HTML: elements without content, with raw text, and those that end an open <p>.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BLOCK - frozenset("body br html legend option tbody td tfoot th thead title tr summary figcaption".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol menu dl table article section div main aside nav header footer form body blockquote".split())
# Page furniture by element, by ARIA role and by word of class or id.
DROP = frozenset("head nav footer aside form script style noscript template svg math iframe button select textarea dialog menu object canvas audio video title noembed noframes xmp search".split())
DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form tablist".split())
DROP_WORD = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination paywall pager popup promo promos promotion related recommended replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
SPLIT_WORDS = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
FURNITURE_SHARE, LEAST_PAGES, INNER_PAGES, LINKS = 0.8, 4, 16, 0.5


class Node:
    __slots__ = ("drop", "kids", "of", "tag", "text")

    def __init__(self, tag: str, text: str = "", drop: bool = False, of: "Node | None" = None):
        self.tag, self.text, self.drop, self.of, self.kids = tag, text, drop, of, []


def _furniture(tag: str, attrs: str) -> bool:
    if tag in DROP:
        return True
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in DROP_ROLE:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "id") and tag not in ("article", "main", "body", "html"):
            words = [w.lower() for w in SPLIT_WORDS.split(value) if w]
            if any(w in DROP_WORD for w in words) or "side" in words and "bar" in words:
                return True
        if name in ("class", "id") and tag == "article" and {"comment", "comments", "reply"} & {w.lower() for w in SPLIT_WORDS.split(value)}:
            return True
    return False


def parse(page: str) -> Node:
    """The DOM of a page; text nodes have the tag '#'."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)
    lower = None

    def text(s: str) -> None:
        if s:
            stack[-1].kids.append(Node("#", s))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = TAG.match(page, lt)
        if not m:  # a lone '<' is text
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        if tag in ENDS_P or tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t == "p" and tag in ENDS_P or t in SIBLINGS.get(tag, ()):
                    del stack[i:]
                    break
                if t in SCOPE or t in ("li", "td", "th") and tag not in SIBLINGS:
                    break
        node = Node(tag, drop=_furniture(tag, m[3] or ""))
        stack[-1].kids.append(node)
        if tag in RAW:
            lower = page.lower() if lower is None and len(page.lower()) == n else lower
            end = (lower or page).find(f"</{tag}", at)
            stop = n if end < 0 else end
            node.kids.append(Node("#", page[at:stop]))
            at = n if end < 0 else (page.find(">", end) + 1 or n)
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
    return root


def walk(root: Node, inner: bool = True):
    """The nodes of a tree in order; without inner, not what is inside furniture."""
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        if inner or not x.drop:
            todo += reversed(x.kids)


def link_share(root: Node) -> float:
    """The share of a subtree's text that stands in links."""
    size = lambda x: sum(len(y.text.strip()) for y in walk(x) if y.tag == "#")
    return sum(size(x) for x in walk(root) if x.tag == "a") / max(1, size(root))


def content_roots(root: Node) -> list[Node]:
    """The outermost <article>s and <main>s outside page furniture; of several, those
    that are not mostly links."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.drop:
            continue
        if x.tag in ("article", "main"):
            found.append(x)
        else:
            todo += reversed(x.kids)
    if len(found) > 1:
        return [x for x in found if link_share(x) <= LINKS] or found
    return found


def squeeze(s: str) -> str:
    return " ".join(entities.unescape(s).split())


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the pairs of the largest matching of the trees a and b that
    keeps their order, parents first."""
    if a.tag != b.tag:
        return []
    pairs = [(a, b)]
    for x, y in pairs:  # grows: every pair of children with equal tags
        pairs += [(i, j) for i in x.kids for j in y.kids if i.tag == j.tag]
    memo: dict[tuple[int, int], tuple[int, list]] = {}
    for x, y in reversed(pairs):
        rows, cols = x.kids, y.kids
        table = [[0] * (len(cols) + 1) for _ in range(len(rows) + 1)]
        for i, p in enumerate(rows, 1):
            for j, q in enumerate(cols, 1):
                s = memo[id(p), id(q)][0] if p.tag == q.tag else 0
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + s)
        chosen, i, j = [], len(rows), len(cols)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                chosen.append((rows[i - 1], cols[j - 1]))
                i, j = i - 1, j - 1
        memo[id(x), id(y)] = (table[-1][-1] + 1, chosen[::-1])
    out = [(a, b)]
    for x, y in out:
        out += memo[id(x), id(y)][1]
    return out


def outline(root: Node, texts: dict[int, str], common: set[str]) -> Node:
    """A copy of the tree's paths to common texts, whose nodes refer to their originals."""
    order, parents, todo = [], [], [(root, -1)]
    while todo:
        x, parent = todo.pop()
        order.append(x)
        parents.append(parent)
        if not x.drop:
            at = len(order) - 1
            todo += [(k, at) for k in reversed(x.kids)]
    keep = [x.tag == "#" and texts.get(id(x)) in common for x in order]
    for i in range(len(order) - 1, 0, -1):
        keep[parents[i]] |= keep[i]
    copies: list[Node | None] = [None] * len(order)
    for i, x in enumerate(order):
        if keep[i] or not i:
            copies[i] = Node(x.tag, texts.get(id(x), ""), of=x)
            if i:
                copies[parents[i]].kids.append(copies[i])
    return copies[0]


def grow(wrapper: Node, page: Node) -> list[tuple[Node, Node]]:
    """Aligns a page's outline with the wrapper, adds what the wrapper lacks, and gives
    (wrapper's, page's) text nodes."""
    pairs = align(wrapper, page)
    at = {id(y): x for x, y in pairs}
    out = []
    for x, y in pairs:
        if y.tag == "#":
            out.append((x, y))
        place = 0
        for kid in y.kids:
            if id(kid) in at:
                place = next(i for i, k in enumerate(x.kids) if k is at[id(kid)]) + 1
            else:
                x.kids.insert(place, kid)
                place += 1
                out += [(z, z) for z in walk(kid) if z.tag == "#"]
    return out


def template_nodes(trees: list[Node]) -> set[int]:
    """ids of text nodes that read alike on nearly all distinct pages of a chunk."""
    texts = [{id(x): t for x in walk(tree, inner=False) if x.tag == "#" and (t := squeeze(x.text))} for tree in trees]
    shapes = [hash(tuple(t.values())) for t in texts]
    distinct = {s: t for s, t in zip(shapes, texts, strict=True) if t}
    least = max(LEAST_PAGES, FURNITURE_SHARE * len(distinct))
    if len(distinct) < LEAST_PAGES:
        return set()
    pages = Counter(x for t in distinct.values() for x in set(t.values()))
    common = {x for x, n in pages.items() if n >= least}
    if not common:
        return set()
    wrapper = None
    slots: dict[int, dict[str, set]] = {}
    held: dict[int, list[tuple[str, Node]]] = {}
    for tree, text, shape in zip(trees, texts, shapes, strict=True):
        page = outline(tree, text, common)
        if wrapper is None:
            wrapper = Node(page.tag)
        for w, x in grow(wrapper, page):
            slots.setdefault(id(w), {}).setdefault(x.text, set()).add(shape)
            held.setdefault(id(w), []).append((x.text, x.of))
    inner = {id(x) for tree in trees for r in content_roots(tree) for x in walk(r) if x.tag == "#"}
    enough = lambda x, seen: len(seen) >= (max(least, INNER_PAGES) if id(x) in inner else least)
    return {id(x) for w, found in slots.items() for s, seen in found.items() for t, x in held[w] if t == s and enough(x, seen)}


def main_text(root: Node, template: set[int]) -> str:
    roots = content_roots(root)
    inside = bool(roots)
    blocks: list[str] = []
    part: list[str] = []

    def flush() -> None:
        s = squeeze("".join(part))
        part.clear()
        if s:
            blocks.append(s)

    todo: list = [(r, False) for r in reversed(roots or [root])]
    while todo:
        x, leaving = todo.pop()
        if leaving:
            flush()
            continue
        if x.tag == "#":
            if id(x) not in template:
                part.append(x.text)
            continue
        if x.drop or x.tag == "header" and not inside:
            flush()
            continue
        if x.tag in BLOCK:
            flush()
            todo.append((x, True))
        todo += [(k, False) for k in reversed(x.kids)]
    flush()
    return "\n".join(blocks)


def extract_group(pages: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    trees = [parse(p or "") for p in pages]
    template = template_nodes(trees) if len(trees) >= LEAST_PAGES else set()
    return [main_text(t, template) for t in trees]


def extract(pages: DataFrame, chunk: int = 64, keep: tuple[str, ...] = ("page_id", "url"), broadcast_bytes: int = 32 << 20) -> DataFrame:
    """keep columns, text and n_chars for every row of pages."""
    base = pages.select(*keep, "html", host_of(F.col("url")).alias("host"))
    fields = [f"c{i}" for i in range(len(keep))]
    rows = base.toDF(*fields, "html", "host")
    hot = rows.groupBy("host").count().where(F.col("count") > chunk).select(F.col("host").alias("h"), F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    size = hot.agg(F.coalesce(F.sum(F.length("h") + 24), F.lit(0)).alias("b")).first().b
    dealt = rows.join(F.broadcast(hot) if size <= broadcast_bytes else hot, F.col("host") == F.col("h"), "left")
    number = F.pmod(F.xxhash64(fields[0], F.length("html")), F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("part", F.xxhash64("host", number)).select(*fields, "html", "host", "part")
    schema = plus(rows.select(*fields), "text string, n_chars bigint")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(fields[0])
        texts = extract_group(t.column("html").to_pylist())
        return pa.table([*[t.column(c) for c in fields], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return dealt.groupBy("part", "host").applyInArrow(run, schema).toDF(*keep, "text", "n_chars")
