"""Main text of web pages by wrapper induction.

A page is parsed once into blocks of text and its shape: the tree of block elements without texts, inline elements and
elements that show nothing (scripts, styles, ...), where neighbours with one tag and class are one repeated node, and so are all
children of one name or tag where there are more than WIDE. Shapes of one host
are aligned by simple tree matching, which gives the most nodes that two trees have in common with ancestors and order kept,
and united into the host's wrapper: HOST shapes at a time, in rounds, so no task takes a host whole, and a shape counts once
however many pages have it. Each node of a shape then has its slot in the wrapper.

A text that stands in one slot on a share CONSTANT of the host's pages which fill that slot is template, there and in
the host's other slots; a slot whose texts vary is content.
Counts are exact, over all pages. That alone can't tell reader comments, rotating adverts and per-page menus, which vary, from an
article, nor an article from a notice on a host of a few pages. So names decide first: elements and classes that say menu,
header, footer, sidebar, notice, advert, form or comments are no content, with all below them; where a shape has an article or a main
element, content is sought there only; elsewhere, list items and cells that are links from end to end are menus. A page that has
nothing left but constant texts keeps those, as all pages of its host may be copies of one article. On hosts with fewer than PAGES
pages in a slot nothing is called constant.

Text: character references are decoded once, as browsers do; white space in a block, no-break spaces and line breaks too, is one
space; blocks are trimmed, and joined by two line feeds; empty ones are none.

Defined results: a null or empty page has an empty text; a null url, or one without host, belongs to a host of its own; pages that
share an id are pages of their own; unclosed elements end with the page, as browsers end them; markup that isn't
closed is none. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, stored

#: Shapes of a host that one task unites.
HOST = 64
#: Children of a node that a shape tells apart by place; below DEPTH open elements no further ones make nodes.
WIDE, DEPTH = 32, 200
#: Rows of the table of hosts' shapes that go to every task, each a few hundred bytes.
SMALL = 10_000
#: A text in a slot is template from this share of the pages that fill the slot, if so many pages do.
CONSTANT, PAGES = 0.9, 8
#: Elements without end tag, elements whose content is no markup, elements that show no text of the page. Fixed values.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style template noscript iframe object svg math canvas audio video map datalist title xmp noembed noframes".split())
#: Elements that begin and end a block; all others run on in the text around them. Fixed values.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button textarea".split()
)
#: What a start tag ends: the open element, and the elements that keep it from being seen. Fixed values.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
#: Names of what is no article: elements, roles, and words of class and id.
OUTER = set("nav header footer aside form menu dialog button select search fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|topbar|footer|sidebar|aside|widget|related|recommended|ads?|adv|advert|adverts|advertisement|advertising|"
    r"banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|"
    r"comments?|commentlist|disqus|replies|respond|form|search|skip|copyright|pagination|pager|toc)(?:$|[\s_-])"
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"[^a-z]*\d[^a-z]*")


def label(tag: str, attributes: str) -> str:
    """A node's name in the shape: tag, and what class, id and role say, with ``-`` before it where it is no article or not shown."""
    if not attributes.strip():
        return f"-{tag}" if tag in OUTER else tag
    given = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    said = CAMEL.sub("-", f"{given.get('class', '')} {given.get('id', '')}").lower()
    role = given.get("role", "").strip().lower()
    off = tag in OUTER or role in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or WORDS.search(said)
    name = "main" if role == "main" else tag
    words = ".".join(sorted(set(DIGITS.sub(" ", given.get("class", "").lower()).split())))
    return re.sub(r"[()\s,]", "_", f"{'-' if off else ''}{name}{'.' + words if words else ''}")


def tag_of(name: str) -> str:
    return name.lstrip("-").partition(".")[0]


class Node:
    """A node of a shape or a wrapper: its name, children in order, and what it stands for (``own``)."""

    __slots__ = ("name", "children", "own")

    def __init__(self, name: str, children: list[Node] | None = None, own: list | None = None) -> None:
        self.name, self.children, self.own = name, children or [], own if own is not None else []


def parsed(html: str | None) -> tuple[Node, list[list]]:
    """The page's tree, not yet folded, and its blocks ``[node, text, characters in links]`` in page order."""
    root = Node("root")
    html = html or ""
    path, tags = [root], ["root"]  # open block elements
    hidden, links = 0, 0
    quiet: list[str] = []  # open hidden elements
    blocks: list[list] = []
    text: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        own = " ".join("".join(text).split())
        if own:
            blocks.append([path[-1], own, min(linked, len(own))])
        text.clear()
        linked = 0

    def close(wanted: set[str], fence: set[str]) -> None:
        for k in range(len(tags) - 1, 0, -1):
            if tags[k] in wanted:
                end()
                del tags[k:], path[k:]
                return
            if tags[k] in fence:
                return

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        run = html[at : m.start() if m else size]
        if run and not quiet:
            run = unescape(run)
            text.append(run)
            if links:
                linked += len(run.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if quiet:
                if tag in quiet:
                    del quiet[len(quiet) - 1 - quiet[::-1].index(tag) :]
                elif tag in ("head", "html"):
                    quiet.clear()
            elif tag == "a":
                links = 0
            elif tag in BLOCKS and tag not in ("body", "html"):
                close({tag}, {"root"})
            elif tag == "br":
                text.append(" ")
            continue
        if quiet and quiet == ["head"] and tag in BLOCKS | {"body"}:
            quiet.clear()  # the body begins, though the head wasn't closed
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*/?\s*>", re.I).search(html, at)
            if tag != "textarea" and stop is None and tag in ("script", "style"):
                break
            at = stop.end() if stop else at
            continue
        if quiet:
            if tag in HIDDEN and tag not in VOID and not m[3].rstrip().endswith("/"):
                quiet.append(tag)
            continue
        if tag in HIDDEN:
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math", "canvas"):
                quiet.append(tag)
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "hr":
            end()
        elif tag in ("html", "body"):
            continue
        elif tag == "a":
            links = 1
        elif tag in BLOCKS:
            if tag not in ("option", "button", "legend", "caption", "summary"):
                close({"p"}, {"table", "td", "th", "caption", "button"})
            if tag in CLOSES:
                close(*CLOSES[tag])
            elif tag[0] == "h" and tag[1:].isdigit():
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, set(tags) - {"h1", "h2", "h3", "h4", "h5", "h6"})
            end()
            if len(path) > DEPTH:
                continue
            node = Node(label(tag, m[3]))
            path[-1].children.append(node)
            path.append(node)
            tags.append(tag)
    end()
    return root, blocks


def alike(children: list[Node]) -> list[tuple[str, list[Node]]]:
    """Children by name: neighbours of one name; of more than WIDE such runs all of one name; of more names all of one tag."""
    runs: list[tuple[str, list[Node]]] = []
    for child in children:
        if runs and runs[-1][0] == child.name:
            runs[-1][1].append(child)
        else:
            runs.append((child.name, [child]))
    for name_of in (lambda n: n, lambda n: ("-" if n[0] == "-" else "") + tag_of(n)):
        if len(runs) <= WIDE:
            break
        by: dict[str, list[Node]] = {}
        for name, some in runs:
            by.setdefault(name_of(name), []).extend(some)
        runs = list(by.items())
    return runs


def folded(root: Node) -> Node:
    """The tree with repeated children made one, which knows the nodes it stands for."""
    top = Node(root.name, own=[root])
    todo = [top]
    while todo:
        at = todo.pop()
        at.children = [Node(name, own=some) for name, some in alike([c for x in at.own for c in x.children])]
        todo += at.children
    return top


def written(root: Node) -> str:
    """A tree as text: names in order, each followed by its children in brackets."""
    out, todo = [], [root]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        else:
            out.append(f"{at.name}(")
            todo.append(")")
            todo += at.children[::-1]
    return "".join(out)


def read(shape: str) -> tuple[Node, list[Node]]:
    """A tree from its text, and its nodes in order."""
    top = Node("")
    path, nodes = [top], []
    for name, mark in re.findall(r"([^()]*)([()])", shape):
        if mark == "(":
            node = Node(name)
            path[-1].children.append(node)
            path.append(node)
            nodes.append(node)
        else:
            path.pop()
    return top.children[0], nodes


def matched(a: Node, b: Node, known: dict) -> int:
    """Simple tree matching: nodes in the largest common tree that keeps roots, ancestors and order."""
    if a.name != b.name:
        return 0
    key = id(a), id(b)
    if key not in known:
        last = [0] * (len(b.children) + 1)
        for x in a.children:
            row = [0]
            for j, y in enumerate(b.children):
                row.append(max(row[j], last[j + 1], last[j] + matched(x, y, known)))
            last = row
        known[key] = 1 + last[-1]
    return known[key]


def united(a: Node, b: Node, known: dict | None = None) -> None:
    """Adds ``b`` to the wrapper ``a``: matched nodes are one (``b`` gets it as ``own``), others are put in their order."""
    known = {} if known is None else known
    b.own = [a]
    m, n = len(a.children), len(b.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + matched(a.children[i], b.children[j], known))
    i = j = 0
    out = []
    while i < m or j < n:
        both = i < m and j < n and matched(a.children[i], b.children[j], known)
        if both and best[i][j] == best[i + 1][j + 1] + both:
            united(a.children[i], b.children[j], known)
            out.append(a.children[i])
            i, j = i + 1, j + 1
        elif i < m and (j == n or best[i][j] == best[i + 1][j]):
            out.append(a.children[i])
            i += 1
        else:
            out.append(adopted(b.children[j]))
            j += 1
    a.children = out


def adopted(b: Node) -> Node:
    """A copy of ``b`` for the wrapper, which ``b`` gets as ``own``."""
    copy = Node(b.name)
    todo = [(b, copy)]
    while todo:
        x, y = todo.pop()
        x.own = [y]
        y.children = [Node(c.name) for c in x.children]
        todo += list(zip(x.children, y.children))
    return copy


def slots(wrapper: str, shapes: list[str]) -> tuple[str, list[list[int]]]:
    """The wrapper with ``shapes`` united into it, and for each shape the wrapper's node number of each of its nodes."""
    root, _ = read(wrapper)
    trees = []
    for shape in shapes:
        tree, nodes = read(shape)
        united(root, tree)
        trees.append(nodes)
    order = {}
    todo = [root]
    while todo:
        at = todo.pop()
        order[id(at)] = len(order)
        todo += at.children[::-1]
    return written(root), [[order[id(x.own[0])] for x in nodes] for nodes in trees]


def kinds(shape: str) -> list[int]:
    """Of each node: 0 no content, 1 content unless constant, 2 content unless constant or all links."""
    root, nodes = read(shape)
    inside: dict[int, tuple[bool, bool]] = {}
    todo = [(root, False, False)]
    any_main = False
    while todo:
        at, off, main = todo.pop()
        tag = tag_of(at.name)
        own_off = at.name.startswith("-") and not (main and tag == "header") and tag != "main"
        off, main = off or own_off, main or tag in ("article", "main")
        any_main |= main and not off
        inside[id(at)] = off, main
        todo += [(c, off, main) for c in at.children]
    return [0 if inside[id(x)][0] or any_main and not inside[id(x)][1] else 1 if any_main else 2 for x in nodes]


def pages(rows: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``uid, id, url, host, shape, blocks`` of each page; a block is its node's number in the shape, its text, and whether it is all links; stored."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string()), ("links", pa.bool_())]))
        for b in batches:
            shapes, found = [], []
            for html in b.column("html").to_pylist():
                root, blocks = parsed(html)
                order, todo = {}, [folded(root)]
                shapes.append(written(todo[0]))
                count = 0
                while todo:
                    at = todo.pop()
                    order |= {id(x): count for x in at.own}
                    count += 1
                    todo += at.children[::-1]
                found.append([{"node": order[id(n)], "text": t, "links": k >= 0.9 * len(t)} for n, t, k in blocks])
            own = [b.column(c) for c in ("uid", "id", "url", "host")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(shapes, pa.string()), pa.array(found, kind)], ["uid", "id", "url", "host", "shape", "blocks"])

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^.*?://([^/?#]*)", 1))
    some = rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    own = ", ".join(f"{c} {some.schema[c].dataType.simpleString()}" for c in ("uid", "id", "url", "host"))
    found = some.mapInArrow(each, f"{own}, shape string, blocks array<struct<node:int,text:string,links:boolean>>")
    return stored(found.withColumn("key", F.sha2(F.concat("host", F.lit("\n"), "shape"), 256)), "parsed")


def wrappers(shapes: DataFrame) -> DataFrame:
    """``host, wrapper`` from ``host, shape, n``: shapes are united HOST at a time, then what comes of them, until a host has one."""

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [slots(own[0], own[1:])[0] for own in b.column("shapes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(out, pa.string()), b.column("n")], ["host", "shape", "n"])

    while True:
        counts = shapes.groupBy("host").agg(F.count("*").alias("shapes"))
        most = counts.agg(F.max("shapes")).first()[0] or 0
        if most <= 1:
            return shapes.select("host", F.col("shape").alias("wrapper"))
        dealt = shapes.hint("merge").join(counts.hint("merge"), "host")
        dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("shape"), F.ceil(F.col("shapes") / HOST)))
        order = F.struct((-F.col("n")).alias("n"), "shape")  # the commonest first
        groups = dealt.groupBy("host", "deal").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["shape"]).alias("shapes"), F.sum("n").alias("n"))
        shapes = stored(groups.select("host", "shapes", "n").mapInArrow(unite, "host string, shape string, n long"), "wrappers")


def laid(shapes: DataFrame, found: DataFrame) -> DataFrame:
    """``key, host, slots, kinds`` of each host's shapes: each node's place in the host's wrapper, and what it can be."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = list(zip(b.column("wrapper").to_pylist(), b.column("shape").to_pylist()))
            columns = [pa.array([slots(w, [s])[1][0] for w, s in some], pa.list_(pa.int32())), pa.array([kinds(s) for _, s in some], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("host"), *columns], ["key", "host", "slots", "kinds"])

    both = salted_join(shapes.select("key", "host", "shape"), found, "host", "key", shapes.count())
    return stored(both.select("key", "host", "wrapper", "shape").mapInArrow(each, "key string, host string, slots array<int>, kinds array<int>"), "slots")


def constants(own: DataFrame, places: DataFrame) -> DataFrame:
    """``host, constant``: hashes of the texts that are template on a host; what is counted has no texts."""
    marks = F.array_distinct(F.transform("blocks", lambda b: F.struct(b.node.alias("node"), F.xxhash64(b.text).alias("hash"))))
    texts = stored(own.select("key", F.explode(marks).alias("b")).groupBy("key", "b.node", "b.hash").agg(F.count("*").alias("n")), "texts")
    nodes = own.select("key", F.explode(F.array_distinct(F.transform("blocks", lambda b: b.node))).alias("node")).groupBy("key", "node").agg(F.count("*").alias("n"))
    slot = places.select("key", "host", F.posexplode("slots").alias("node", "slot"))
    filled = nodes.hint("merge").join(slot.hint("merge"), ["key", "node"]).groupBy("host", "slot").agg(F.sum("n").alias("pages")).where(F.col("pages") >= PAGES)
    counts = salted_join(texts, places.select("key", "host", "slots"), "key", "hash", texts.count()).withColumn("slot", F.col("slots")[F.col("node")])
    counts = counts.groupBy("host", "slot", "hash").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES * CONSTANT)
    same = counts.hint("merge").join(filled.hint("merge"), ["host", "slot"]).where(F.col("n") >= CONSTANT * F.col("pages"))
    return same.groupBy("host").agg(F.collect_set("hash").alias("constant"))


def extracted(rows: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small: int = SMALL) -> DataFrame:
    """``id, url, text`` of each page. Up to ``small`` shapes of hosts go to the pages; beyond that, pages are joined with them."""
    own = pages(rows, id_col, url_col, html_col)
    shapes = stored(own.groupBy("key", "host", "shape").agg(F.count("*").alias("n")), "shapes")
    places = laid(shapes, wrappers(shapes.select("host", "shape", "n")))
    info = places.hint("merge").join(constants(own, places).hint("merge"), "host", "left").select("key", "kinds", "constant")
    info = stored(info, "info")
    own = own.select("uid", "id", "url", "key", "blocks")
    own = own.join(F.broadcast(info), "key") if info.count() <= small else salted_join(own, info, "key", "uid", own.count())
    open_ = F.filter("blocks", lambda b: (F.col("kinds")[b.node] == 1) | ((F.col("kinds")[b.node] == 2) & ~b.links))
    own = own.withColumn("open", open_)
    varying = F.when(F.col("constant").isNull(), F.col("open")).otherwise(F.filter("open", lambda b: ~F.array_contains("constant", F.xxhash64(b.text))))
    own = own.withColumn("varying", varying)
    kept = F.when(F.size("varying") > 0, F.col("varying")).otherwise(F.col("open"))
    return own.select("id", "url", F.array_join(F.transform(kept, lambda b: b.text), "\n\n").alias("text"))


def op11_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
