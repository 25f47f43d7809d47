"""Main text of web pages with a site style tree.

The DOMs of a host's pages are merged: elements with the same path of tags, classes and ids are one node of the site's tree. For
every node the pages' styles (the sequence of child elements) and contents (what is below) are counted, and the node's importance
is the larger of the two normalised entropies: a branch that looks and reads the same on all pages is part of the site's
template, one that differs is content. The tree judges every block element, inside articles and of whatever name; all elements of a page on
one path count together, and pages that read the same count once, so that copies of an article stay. Importance on hosts with few pages leans
on what the same path is like in all hosts. Branches of low importance are cut from each page, but for an article or main and what
holds one.

Names come after the tree: what HTML itself says isn't text (nav, footer, form, ...) goes, and so does what a class, id or role names (an
advert, a sidebar, comments), unless nothing would be left.

The tree is never gathered in one place: it is rows of (host, node, style, content) counts, combined before the shuffle, and
only the nodes to cut go back to the pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelog.llm.common import checkpoint

#: A node is cut below this importance.
MIN_IMPORTANCE = 0.3
#: How many pages the importance of a path in all hosts weighs, and from how many hosts on it says anything.
PRIOR_PAGES, PRIOR_HOSTS = 2, 5
#: Nodes to cut that are sent to all tasks at most; beyond, hosts and pages meet in a shuffle.
BROADCAST_NODES = 50_000
SALTS = 16

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOREIGN = frozenset("svg math".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea title xmp noembed noframes".split())
NOISE = frozenset("nav aside footer form button select option input label fieldset dialog menu head".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element on the left ends an open one on the right, within the nearest of the scopes.
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div main blockquote td th".split())
#: Words of a class, id or role that name what doesn't belong to the text, and words beside them that make them say something else.
NOISE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header masthead menu modal nav "
    "navbar navigation newsletter notice notices pagination popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
STATE_WORDS = frozenset("no not non without with has have is open opened closed enabled disabled allowed on off free less hidden page layout wrapper container".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAMING = frozenset(("class", "id", "role"))
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_BLANK = re.compile(r"\s+")


class Node:
    """An element: its children are elements and texts (str) in order. Its path is a hash of the tags and names down to it."""

    __slots__ = ("tag", "names", "children", "parent", "path")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.names, self.parent, self.children = tag, names, parent, []
        self.path = _digest(f"{parent.path if parent else 0}/{tag}.{_DIGITS.sub('#', names)}")

    @property
    def named_noise(self) -> bool:
        """Whether a class, id or role says that it isn't text of the page. "no-sidebar" or "comments-open" doesn't."""
        if not self.names or self.tag in ("html", "body", "article", "main"):
            return False
        for name in self.names.split():
            words = {w.lower() for w in _WORDS.findall(name)}
            if words & NOISE_WORDS and not words & STATE_WORDS:
                return True
        return False


def _digest(s: str | bytes) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(s.encode("utf-8", "replace") if isinstance(s, str) else s) - (1 << 63)


def parse(page: str | None) -> Node:
    """The DOM of a page, which may be damaged: unknown ends are ignored, missing ones implied."""
    root = here = Node("#root", "", None)
    page, at = page or "", 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            here.children.append(html.unescape(text))
        if not m:
            return root
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            up = here
            while up.parent and up.tag != tag:
                up = up.parent
            if up.parent:
                here = up.parent
            elif tag == "p":  # an end without a start is an empty paragraph
                here.children.append(Node("p", "", here))
            continue
        rest = m[3] or m[6] or ""
        ends = IMPLIED.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        up = here
        while ends and up.parent and up.tag not in ends and (up.tag not in SCOPES or up.tag in ends):
            up = up.parent
        if up.tag in ends:
            here = up.parent
        names = " ".join(next(filter(None, n[1:]), "") for n in _ATTRIBUTE.findall(rest) if n[0].lower() in _NAMING) if "=" in rest else ""
        node = Node(tag, names, here)
        here.children.append(node)
        closed = rest.rstrip().endswith("/")
        if tag in FOREIGN and closed:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not closed:
            here = node


def walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """(element, inside an article or main) of every element, parents first, without recursion."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        yield node, inside
        inside = inside or node.tag in ("article", "main")
        stack.extend((c, inside) for c in reversed(node.children) if isinstance(c, Node))


def _judged(root: Node) -> tuple[list[Node], list[Node]]:
    """The block elements that importance may cut, and the page's outermost articles and mains."""
    found, holds, articles = list(walk(root)), set(), []
    for node, inside in found:
        if node.tag in ("article", "main"):
            if not inside:
                articles.append(node)
            up = node
            while up and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    return [n for n, _ in found if n.tag in BLOCK and n.tag not in ("html", "body") and id(n) not in holds], articles


def _contents(root: Node) -> dict[int, int]:
    """Hash of what each element holds, 0 for nothing: from the hashes of its children, so that the work is linear in the page."""
    out: dict[int, int] = {}
    for node, _ in reversed(list(walk(root))):  # children first
        parts = []
        for c in node.children if node.tag not in RAW else ():
            h = out[id(c)] if isinstance(c, Node) else _digest(s) if (s := _BLANK.sub(" ", c).strip()) else 0
            if h:
                parts.append(h.to_bytes(8, "little", signed=True))
        out[id(node)] = parts[0] and int.from_bytes(parts[0], "little", signed=True) if len(parts) == 1 else _digest(b"".join(parts)) if parts else 0
    return out


def site_nodes(page: str | None) -> Iterator[tuple[int, int, int, int]]:
    """(node, style, content, page), as hashes, of the paths of the page's block elements: its part of the site style tree. Pages whose
    articles, or else whole texts, are equal have the same hash."""
    root = parse(page)
    merged: dict[int, tuple[list[str], list[int]]] = {}
    judged, articles = _judged(root)
    holds = _contents(root)
    for node in judged:
        styles, contents = merged.setdefault(node.path, ([], []))
        styles.append(" ".join(c.tag for c in node.children if isinstance(c, Node)))
        contents.append(holds[id(node)])
    same = _digest(repr([holds[id(n)] for n in articles or [root]]))
    for path, (styles, contents) in merged.items():
        yield path, _digest("\n".join(styles)), _digest(repr(contents)), same


def _kept(root: Node, cut: frozenset[int], by_name: bool) -> dict[int, bool]:
    """Whether each element stays."""
    keep: dict[int, bool] = {}
    low = {id(n) for n in _judged(root)[0] if n.path in cut} if cut else ()
    for node, _ in walk(root):
        ok = keep[id(node.parent)] if node.parent else True
        keep[id(node)] = ok and not (node.tag in NOISE or id(node) in low or (by_name and node.named_noise))
    return keep


def _blocks(root: Node, keep: dict[int, bool], articles_only: bool) -> list[str]:
    """The texts of the blocks that stay; a header gives its headings and paragraphs if it is inside an article or main, nothing elsewhere."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _BLANK.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    # (element or text or None for the end of a block, whether it is read, inside an article or main, inside a header)
    stack: list[tuple[Node | str | None, bool, bool, bool]] = [(root, not articles_only, False, False)]
    while stack:
        n, read, article, header = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            if read:
                line.append(n)
        elif keep[id(n)]:
            if n.tag in ("article", "main"):
                article, read = True, read or (articles_only and not header)
            if n.tag == "header":
                read, header = False, True
            elif header and article and (n.tag in HEADING or n.tag == "p"):
                read = True
            if n.tag == "br":
                line.append(" ")
            if n.tag in BLOCK:
                flush()
                stack.append((None, read, article, header))
            stack.extend((c, read, article, header) for c in reversed(n.children))
    flush()
    return blocks


def extract(page: str | None, cut: frozenset[int] = frozenset()) -> str:
    """Text of a page without the nodes in ``cut``: blocks in order, one a line, white space inside a block one space.

    If there is a main with text, or if articles hold half of what is left or more, only they are read: a teaser doesn't stand for its
    page. If names leave nothing, they are not believed.
    """
    root = parse(page)
    for by_name in (True, False):
        keep = _kept(root, cut, by_name)
        everything = _blocks(root, keep, False)
        if everything:
            break
    inner = _blocks(root, keep, True)
    text, whole = "\n".join(inner), "\n".join(everything)
    main = any(n.tag == "main" and keep[id(n)] for n, _ in walk(root))
    return text if text and main or 2 * len(text) >= len(whole) else whole


def host(url: str | None) -> str:
    """Lower-cased host of a URL; empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def low_importance(pages: DataFrame) -> DataFrame:
    """(host, cut array<long>): the nodes of each site's style tree that are to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(host(u.as_py()), *n) for u, p in zip(b.column(0), b.column(1), strict=True) for n in site_nodes(p.as_py())]
            columns = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), *[pa.int64()] * 4), strict=True)], names=["host", "node", "style", "content", "page"])

    nodes = checkpoint(pages.select("url", "html").mapInArrow(run, "host string, node long, style long, content long, page long").dropDuplicates(["host", "node", "page"]))

    def entropies(of: str) -> tuple[DataFrame, DataFrame]:
        """(host, node, m, entropy) and (node, hosts, entropy): of a host's distinct pages, and of those of all hosts."""
        # -sum p log p, over log m: 1 when all pages differ or there is but one, 0 when all are alike
        sums = [F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("nlogn")]
        entropy = F.when(F.col("m") > 1, 1 - F.try_divide(F.col("nlogn"), F.col("m") * F.ln("m"))).otherwise(F.lit(1.0)).alias(f"{of}_entropy")
        counts = nodes.groupBy("host", "node", of).agg(F.count(F.lit(1)).alias("n"))
        own = counts.groupBy("host", "node").agg(*sums)
        everywhere = counts.groupBy("node", of).agg(F.sum("n").alias("n")).groupBy("node").agg(*sums)
        return own.select("host", "node", F.col("m").alias(f"{of}_m"), entropy), everywhere.select("node", entropy)

    (style, styles), (content, contents) = entropies("style"), entropies("content")
    own = style.join(content, ["host", "node"]).withColumn("own", F.greatest("style_entropy", "content_entropy")).select("host", "node", F.col("style_m").alias("m"), "own")
    hosts = own.groupBy("node").agg(F.count(F.lit(1)).alias("hosts"))
    common = styles.join(contents, "node").join(hosts, "node").where(F.col("hosts") >= PRIOR_HOSTS).select("node", F.greatest("style_entropy", "content_entropy").alias("common"))
    both = own.join(common, "node", "left").withColumn("common", F.coalesce("common", F.lit(1.0)))
    # one page of a host says nothing by itself
    importance = F.when(F.col("m") > 1, (F.col("m") * F.col("own") + PRIOR_PAGES * F.col("common")) / (F.col("m") + PRIOR_PAGES)).otherwise(F.col("common"))
    return both.where(importance < MIN_IMPORTANCE).groupBy("host").agg(F.collect_list("node").alias("cut"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without text, give an empty text. Pages without a host in their url are one site. Null and repeated
    page_ids are rows like any other. An empty table gives no rows. Other columns are ignored.
    """
    cut = checkpoint(low_importance(pages))
    n = cut.agg(F.coalesce(F.sum(F.size("cut")), F.lit(0))).first()[0]
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def rows(batch: pa.RecordBatch, cuts: list[frozenset[int]]) -> pa.RecordBatch:
        texts = [extract(p.as_py(), c) for p, c in zip(batch.column(2), cuts, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if n <= BROADCAST_NODES:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: frozenset(r["cut"]) for r in cut.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield rows(b, [known.value.get(host(u.as_py()), frozenset()) if known.value else frozenset() for u in b.column(1)])

        return pages.select("page_id", "url", "html").mapInArrow(run, schema)

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host(u.as_py()) for u in b.column(1)], pa.string())], names=["page_id", "url", "html", "host"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, frozenset[int]] = "", frozenset()  # rows of a host lie together after the join
        for b in batches:
            cuts = []
            for h, c in zip(b.column(3).to_pylist(), b.column(4), strict=True):
                if h != last[0] or not cuts:
                    last = h, frozenset(c.as_py() or ())
                cuts.append(last[1])
            yield rows(b, cuts)

    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    with_host = pages.select("page_id", "url", "html").mapInArrow(hosts, f"page_id {kind}, url string, html string, host string")
    with_host = with_host.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    met = with_host.join(cut.withColumn("salt", salt), ["host", "salt"], "left")
    return met.select("page_id", "url", "html", "host", "cut").mapInArrow(joined, schema)
