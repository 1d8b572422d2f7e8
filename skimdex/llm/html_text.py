"""Main text of pages by a site style tree.

Pages of one host are merged into a style tree. A node of it is a path of tags with their classes; it
counts on how many pages it occurs, in which presentations (sequences of child tags) and with which
contents. Pages that repeat count once. A node that looks alike on all pages has low entropy and matters little; the main text
varies. A node's own importance mixes both entropies; that of a branch is composed from below, as the
largest among its nodes on the page at hand.

A host's importance of a path is drawn towards that of the same path on all hosts by the weight of
``EVIDENCE`` pages, and that in turn towards a prior, so a host of few pages borrows what others show
and no number of pages switches a rule on. The prior and the bar depend on what is known ahead:

* What HTML itself or an unmistakable name declares to be a menu, header, footer, sidebar, advert, form,
  script, style or reader comment goes always; comments vary like a story, so no entropy finds them.
* A telling class (``HINT``) is a guess. Inside an article such a branch goes only where the pages
  confirm it, below ``TOLD``; elsewhere it goes unless they refute it and it reaches ``SURE``.
* Other branches go below ``LEAST``. In an article only whole blocks do, since repeated words are part of
  a sentence, and none where all of the article repeats.
* Beside an article everything goes but branches without a telling class that are sure to matter.

Only node hashes of distinct pages and their counts are gathered: a host of any size is summed by
(path, presentation) and (path, content) with partial sums in each task, and the pages themselves are
never shuffled by host unless the list of judged paths outgrows a broadcast.

Defined results: null and empty html give an empty text; unclosed, misnested and cut tags are closed
where HTML closes them; a null url shares one nameless host; rows may repeat and change nothing for
others; the tree never cuts a page down to nothing; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import BROADCAST_ROWS, session, shippable, stored

#: nodes less important than the first are cut, with a telling class in an article those below the
#: second; the third is asked of nodes that stay against a guess, or beside an article
LEAST, TOLD, SURE = 0.3, 0.5, 0.8
#: weight, in pages, of what other hosts and the prior say about a path
EVIDENCE = 4
#: the share of content against presentation in a node's importance
GAMMA = 0.9

# fixed values of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul caption".split()
)
DROPPED = set(
    "head script style noscript template title nav footer aside form button select option textarea iframe object embed svg "
    "canvas audio video menu dialog noembed noframes xmp datalist map".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "legend"}
#: a start tag ends these open elements, up to the named containers
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
#: names that mean nothing but an advert, a sidebar, a menu or reader comments
DECLARED = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|adsbygoogle|sponsored|ad[-_](?:slot|box|banner|unit|container|wrapper)|sidebar|navbar|"
    r"breadcrumbs?|cookie[-_](?:notice|banner|consent|bar))\d*(?:$|\s)|"
    r"(?:^|[-_\s])(?:comments?|commentlist|disqus)(?:$|[-_\s\d])", re.I
)
#: names that tell of noise as often as of a story about it
HINT = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu|menus|breadcrumbs?|"
    r"sidebar|side|aside|widgets?|footer|reply|replies|respond|"
    r"cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"login|share|sharing|social|related|recommended|toolbar|pagination|pager|skip)(?:$|[-_\s\d])", re.I
)
HEADER = re.compile(r"(?:^|[-_\s])(?:header|masthead|banner)(?:$|[-_\s\d])", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "path", "noise", "hint", "main", "up", "kids")

    def __init__(self, tag: str, label: str, up: Node | None, noise: bool, hint: bool, main: int):
        self.tag, self.up, self.noise, self.hint, self.main = tag, up, noise, hint, main
        self.path = xxhash.xxh64_intdigest(label, up.path if up else 0)
        self.kids: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), entities.unescape(a or b or c))
    return found


def parse(page: str) -> Node:
    """The element tree of a page."""
    root = Node("#page", "#page", None, False, False, 0)
    at = root
    pos, end = 0, len(page)
    while pos < end:
        m = TOKEN.match(page, pos)
        pos = m.end()
        name = m.group(2)
        if name is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                at.kids.append(piece)
            elif piece.startswith("<![CDATA["):
                at.kids.append(piece[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m.group(1):
            node = at
            while node is not root and node.tag != name:
                node = node.up
            if node is not root:
                at = node.up
            continue
        if name in CLOSES_P:
            node = at
            while node is not root and node.tag not in ("p", "td", "th", "li", "div", "article", "section", "main", "body", "table"):
                node = node.up
            if node.tag == "p":
                at = node.up
        if name in ENDS:
            ended, stop = ENDS[name]
            node, top = at, None
            while node is not root and node.tag not in stop:
                if node.tag in ended:
                    top = node
                node = node.up
            if top is not None:
                at = top.up
        attrs = _attributes(m.group(3)) if m.group(3) else {}
        css = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        role = attrs.get("role", "").lower()
        main = max(at.main, 2 if name == "article" else 1 if name == "main" or role == "main" else 0)
        named = css if name not in ("html", "body", "article", "main") else ""
        noise = (
            name in DROPPED or role in ROLES or "hidden" in attrs or (name == "header" and not main)
            or bool(named and DECLARED.search(named))
            or (name == "article" and bool(re.search(r"(?:^|[-_\s])(?:comment|reply)", css, re.I)))
        )
        # a guess covers what is below it, up to an article
        hint = at.hint and not (main == 2 > at.main) or bool(named and (HINT.search(named) or not main and HEADER.search(named)))
        label = name + ("." + re.sub(r"\d+", "0", css) if css else "")
        node = Node(name, label, at, noise, hint, main)
        at.kids.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, pos)
            node.kids.append(page[pos : close.start() if close else end])
            pos = close.start() if close else end
            at = node
        elif name not in VOID:
            at = node
    return root


def _squeeze(text: str) -> str:
    return BLANK.sub(" ", entities.unescape(text)).strip()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def tree_rows(page: str) -> list[tuple[int, int, int, int]]:
    """(path, presentation, content, marks) of a page's nodes, equal paths taken together.

    ``marks`` adds 1 for text beside the article of a page that has one, 2 for a telling class on the
    path and 4 for a path inside an article.
    """
    shapes: dict[int, list] = {}
    root = parse(page)
    inside = _has_main(root)
    stack = [root]
    while stack:
        node = stack.pop()
        shape = shapes.setdefault(node.path, [xxhash.xxh64(), xxhash.xxh64(), 2 * node.hint + 4 * (node.main == 2)])
        look, words, _ = shape
        for kid in node.kids:
            if isinstance(kid, str):
                text = _squeeze(kid)
                words.update(text)
                look.update(b"#")
                if text and node.main < inside:
                    shape[2] |= 1
            else:
                look.update(kid.path.to_bytes(8, "little"))
                if not kid.noise:
                    stack.append(kid)
    return [(_signed(p), _signed(s.intdigest()), _signed(c.intdigest()), o) for p, (s, c, o) in shapes.items()]


def _in_order(root: Node) -> list[Node]:
    """Nodes without declared noise, parents before their children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(k for k in node.kids if not isinstance(k, str) and not k.noise)
    return order


def _unimportant(root: Node, low: Collection[int], high: Collection[int]) -> set[int]:
    """Identities of the branches in which every node is in ``low``, or has a telling class and is not in ``high``.

    The latter does not count in an article. An article is none of them, and holds none if nothing in it is important.
    """
    order = _in_order(root)
    poor: set[int] = set()
    holds: set[int] = set()  # what an article is in
    for node in reversed(order):  # children come before their parents
        if node.up and (node.main == 2 or id(node) in holds):
            holds.add(id(node.up))
        path = _signed(node.path)
        if (path in low or node.hint and node.main < 2 and path not in high) and all(isinstance(k, str) or k.noise or id(k) in poor for k in node.kids):
            poor.add(id(node))
    whole: set[int] = set()  # articles that repeat as they are, and what is in them
    for node in order:
        if node.main == 2 and (id(node) in poor if node.up.main < 2 else id(node.up) in whole):
            whole.add(id(node))
    for node in order:
        if node.main == 2 and (id(node) in whole or node.tag not in BLOCKS or node.up.main < 2):
            poor.discard(id(node))
        elif node.main < 2 and id(node) in holds:
            poor.discard(id(node))
    return poor


def _important(root: Node, high: set[int], inside: int) -> set[int]:
    """Identities of the nodes outside the article whose own text stays.

    Beside the article a branch stays whole if one of its nodes is in ``high``; of what contains the
    article, each node answers for its own text.
    """
    order = _in_order(root)
    holds: set[int] = set()
    rich: set[int] = set()
    for node in reversed(order):
        if node.main >= inside or id(node) in holds:
            holds.add(id(node))
            if node.up:
                holds.add(id(node.up))
        elif not node.hint and (_signed(node.path) in high or id(node) in rich):
            rich.add(id(node))
            if node.up:
                rich.add(id(node.up))
    kept: set[int] = set()
    for node in order:
        if id(node) in holds:
            if not node.hint and _signed(node.path) in high:
                kept.add(id(node))
        elif node.hint:
            continue
        elif id(node) in rich if id(node.up) in holds else id(node.up) in kept:
            kept.add(id(node))
    return kept


def page_text(page: str, low: Collection[int], high: Collection[int] = ()) -> str:
    """Blocks of the page's main text, without declared noise and branches of paths in ``low`` only.

    Beside an article, and below a telling class outside of one, only branches with a path in ``high``
    count. A page of which the tree would leave nothing is given without its cuts.
    """
    root = parse(page)
    return _blocks(root, low, high) or (_blocks(root, (), high) if low else "")


def _blocks(root: Node, low: Collection[int], high: Collection[int]) -> str:
    poor = _unimportant(root, low, high)
    inside = _has_main(root)
    extra = _important(root, high, inside) if high and inside else set()
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _squeeze("".join(line))
        line.clear()
        if text:
            blocks.append(text)

    # an explicit stack: pages may nest deeper than Python calls may
    todo: list = [root]
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            line.append(node)
        elif node.tag == "br":
            line.append(" ")
        elif node.noise or id(node) in poor:
            if node.tag in BLOCKS:
                flush()
        else:
            kids = node.kids
            if node.main < inside and id(node) not in extra:  # only what it contains counts
                kids = [k for k in kids if not isinstance(k, str)]
            if node.tag in BLOCKS or node.tag == "#page":
                flush()
                todo.append(None)
            todo.extend(reversed(kids))
    flush()
    return "\n\n".join(blocks)


def _has_main(root: Node) -> int:
    """2 if the page has an article with text, else 1 if it has a main element with text, else 0."""
    best, todo = 0, [root]
    while todo:
        node = todo.pop()
        for kid in node.kids:
            if isinstance(kid, str):
                if kid.strip():
                    best = max(best, node.main)
            elif not kid.noise:
                todo.append(kid)
    return best


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance, marks) by each host alone; entropies are relative to its pages, in [0, 1].

    Pages of a host with the same nodes count once, however often they repeat: each gives one row
    with its digest, and copies are combined before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows = [np.array(tree_rows(page.as_py() or ""), np.int64) for page in part.column(1)]
                digests = pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in rows], pa.binary())
                flat = np.concatenate(rows)
                cols = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(4)]
                ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
                nodes = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(cols, ["path", "look", "words", "marks"]))
                yield pa.RecordBatch.from_arrays([part.column(0), digests, nodes], ["host", "page", "nodes"])

    slim = pages.select(host_of(F.col("url")).alias("host"), "html")
    each = slim.mapInArrow(run, "host string, page binary, nodes array<struct<path: long, look: long, words: long, marks: long>>")
    each = each.groupBy("host", "page").agg(F.first("nodes").alias("nodes"))
    seen = each.select("host", F.inline("nodes"))
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("look", "words"))]
    each = seen.select("host", "path", "marks", F.explode(F.array(*kinds)).alias("of"))
    counts = each.groupBy("host", "path", "of.kind", "of.value").agg(F.count("*").alias("n"), F.bit_or("marks").alias("marks"))
    m = F.sum("n")
    entropy = F.when(m > 1, (F.log(m) - F.sum(F.col("n") * F.log("n")) / m) / F.log(m)).otherwise(F.lit(1.0))
    spread = counts.groupBy("host", "path", "kind").agg(m.alias("pages"), entropy.alias("h"), F.bit_or("marks").alias("marks"))
    share = F.when(F.col("kind") == 0, 1 - GAMMA).otherwise(GAMMA)
    return spread.groupBy("host", "path").agg(
        F.max("pages").alias("pages"), F.sum(share * F.col("h")).alias("importance"), F.bit_or("marks").alias("marks")
    )


def judged_paths(tree: DataFrame, least: float = LEAST, told: float = TOLD, sure: float = SURE) -> DataFrame:
    """(host, path, low, high) of the paths of ``style_tree`` that are cut, or that stay against a guess."""
    tree = stored(tree, "style_tree")
    seen, mark = F.col("pages") - 1, lambda bit: F.col("marks").bitwiseAND(bit) > 0
    everywhere = tree.groupBy("path").agg(F.sum(seen).alias("weight"), F.sum(seen * F.col("importance")).alias("total"))
    everywhere = everywhere.where("weight > 0")  # what one page shows nowhere repeats and nowhere varies

    def drawn(prior: float) -> Column:
        of_all = (F.col("total") + EVIDENCE * prior) / (F.col("weight") + EVIDENCE)
        return (seen * F.col("importance") + EVIDENCE * of_all) / (seen + EVIDENCE)

    guess, article = mark(2), mark(4)
    low = F.when(guess, article & (drawn(1.0) < told)).otherwise(drawn(1.0) < least)
    high = F.when(guess, ~article).otherwise(mark(1)) & (drawn(0.0) >= sure)
    judged = tree.join(shippable(stored(everywhere, "paths")), "path").select("host", "path", low.alias("low"), high.alias("high"))
    return judged.where("low or high")


def extract_text(pages: DataFrame, least: float = LEAST, told: float = TOLD, sure: float = SURE) -> DataFrame:
    """Per row of ``pages``: page_id, url, text."""
    session(pages)
    judged = judged_paths(style_tree(pages), least, told, sure)
    sets = [F.collect_set(F.when(F.col(k), F.col("path"))).alias(k) for k in ("low", "high")]
    known = stored(judged.groupBy("host").agg(*sets), "importance")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    few = (known.agg(F.sum(F.size("low") + F.size("high"))).head()[0] or 0) <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(known) if few else known, "host", "left").select("page_id", "url", "html", "host", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, (), ())  # the sets of the last host: its pages often follow each other
        for batch in batches:
            texts = []
            for k, (html, host) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                if host != last[0]:
                    last = (host, *(set(batch.column(c)[k].as_py() or ()) for c in (4, 5)))
                texts.append(page_text(html.as_py() or "", *last[1:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
