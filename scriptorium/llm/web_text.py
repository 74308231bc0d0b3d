"""Main text of web pages, with site templates removed.

A small tree is built of each page. Every element subtree gets a hash of its tags and text; Spark counts per host, and
per section of a host (the first directory of the path), on how many pages a hash occurs, and subtrees that recur on
many of these pages are deleted before the content is chosen. Inside an article or main element that the page marks,
what recurs may be prose that the site repeats; only blocks of links or controls, and containers at its edges, are
taken for template there. Menus, forms, adverts, comments of readers and the like go everywhere by what they call themselves, if they
call themselves nothing else. The headline and lead that stand before a lone article in its main element belong to it, unless the site repeats them.

Per host and section only the recurring hashes are kept. As a page adds its subtrees once to each, at most ``subtrees
per page / share`` of them can recur, however large the host is. They are joined to the pages by host and section:
broadcast when counted and small, else shuffled, where a large host's pages are split.

Defined results: null or empty html gives an empty text; a page with a null or unusable url belongs to no site, so nothing
of it is a template; repeated rows are extracted alike and kept apart, and count as pages of their own; subtrees that recur on exactly the least share of pages are template; pages of any length and
depth are read whole; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import broadcast_if_small, materialize

#: A subtree belongs to the template of its host from this share of the host's pages, and from this many pages.
SHARE = 0.3
LEAST_PAGES = 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold main text.
DROPPED = frozenset("head script style noscript template iframe textarea title nav aside form fieldset button select option input dialog menu svg math canvas object audio video footer".split())
#: Words in class, id or role that say so too.
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay paywall newsletter "
    "subscribe subscription signup sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs toolbar footer copyright comment comments commentlist disqus respond replies "
    "share sharing social related recommended search login pagination pager widget contentinfo complementary skiplink".split()
)
HEADERS = frozenset("header masthead".split())
#: Words that only say where or what such an element is: a name may hold them beside those above, but no other word.
BESIDE = frozenset("left right top bottom upper lower area box bar block container wrapper wrap inner outer list section widget primary secondary site page post entry global local main item items link links button buttons form panel zone slot unit content header".split())
#: What may stand before an article in the main element that holds it: its headline and lead.
LEADS = frozenset("h1 h2 h3 p header hgroup".split())
#: Names that describe a layout and not the element: has-sidebar, no-menu.
LAYOUT = re.compile(r"^(?:has|with|without|no|is|hide|show)[-_]", re.I)
#: Elements that hold blocks of a page, and parts that only chrome has.
CONTAINERS = frozenset("div section ul ol dl table center details figure".split())
CONTROLS = frozenset("form input button select textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element whose start ends an open one of the same group, and where the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "li", "dt", "dd"} | {"li", "dt", "dd"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
LABEL = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    label: str = ""
    hidden: bool = False
    inside: list = field(default_factory=list)
    hash: int = 0
    size: int = 0  # code points of its text, less what is unwanted by name
    linked: int = 0  # those of them in links
    control: bool = False
    title_link: bool = False


def tree(html: str) -> Node:
    """Elements and text of a page; what is not closed ends with its parent."""
    root = Node("html")
    stack, at, n = [root], 0, len(html)
    opened: Counter[str] = Counter()  # so that no stack of any depth is searched in vain

    def close(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        m = TOKEN.search(html, at)
        begin = m.start() if m else n
        if begin > at:
            stack[-1].inside.append(references.unescape(html[at:begin]))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for k in range(len(stack) - 1 if opened[name] else 0, 0, -1):
                if stack[k].tag == name:
                    close(k)
                    break
            continue
        if name in CLOSES:
            group, stop = CLOSES[name]
            for k in range(len(stack) - 1 if any(opened[t] for t in group) else 0, 0, -1):
                if stack[k].tag in group:
                    close(k)
                    break
                if stack[k].tag in stop:
                    break
        if name in ENDS_P:
            for k in range(len(stack) - 1 if opened["p"] else 0, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        node = Node(name)
        if m[3] and m[3].strip(" /"):
            found = {a.lower(): b or c or d for a, b, c, d in LABEL.findall(m[3])}
            node.hidden = "hidden" in found or found.get("aria-hidden") == "true"
            node.label = " ".join(v for k, v in found.items() if k in ("class", "id", "role"))
        stack[-1].inside.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
        elif name not in VOID and not (m[3].endswith("/") and name in ("svg", "path")):
            stack.append(node)
            opened[name] += 1
    return root


def walk(node: Node) -> Iterator[Node]:
    pending = [node]
    while pending:
        x = pending.pop()
        yield x
        pending.extend(c for c in reversed(x.inside) if isinstance(c, Node))


def hash_subtrees(root: Node) -> None:
    """Hashes of tags, labels and text below each element, leaves first."""
    for node in reversed(list(walk(root))):
        inner = [c.hash.to_bytes(8, "little") if isinstance(c, Node) else " ".join(c.split()).encode("utf-8", "replace") for c in node.inside]
        node.hash = xxhash.xxh3_64_intdigest(b"\0".join([node.tag.encode("utf-8", "replace"), node.label.encode("utf-8", "replace"), *inner]))


def named(node: Node, names: frozenset[str]) -> bool:
    """Whether one of the element's names is made of the names, and of words that say where it is; related-work is not."""
    if not node.label:
        return False
    for token in node.label.lower().split():
        parts = [p for p in re.split(r"[-_]+", token) if p and not p.isdigit()]
        if not LAYOUT.match(token) and any(p in names for p in parts) and all(p in names or p in BESIDE or p in CHROME for p in parts):
            return True
    return False


def measure(root: Node) -> None:
    """Sizes of the text below each element, leaves first."""
    for node in reversed(list(walk(root))):
        node.size = node.linked = 0
        links = titles = False
        for c in node.inside:
            if isinstance(c, str):
                node.size += len("".join(c.split()))
                continue
            node.control |= c.control or c.tag in CONTROLS
            if unwanted(c, True) or c.tag in RAW:
                continue
            node.size += c.size
            node.linked += c.linked
            node.title_link |= c.title_link
            links |= c.tag == "a" or c.linked > 0
            titles |= c.tag in HEADINGS
        if node.tag == "a":
            node.linked = node.size
            node.title_link |= titles
        node.title_link |= node.tag in HEADINGS and links


def of_links(node: Node) -> bool:
    """Whether a block is made of links, or has controls."""
    return node.control or 0 < node.size <= 2 * node.linked


def chrome_in(top: Node) -> Iterator[tuple[Node, Node]]:
    """(parent, block) of what may be template inside marked content: blocks of links, and containers at its edges.

    A container is at an edge if only containers lie between it and the start or the end of its parent, which itself is
    at that edge or the content.
    """
    pending = [(top, True, True)]
    while pending:
        x, first, last = pending.pop()
        held = [c for c in x.inside if isinstance(c, Node) or c.strip()]
        boxes = [isinstance(c, Node) and (c.tag in CONTAINERS or not c.size) for c in held]
        lead = next((k for k, box in enumerate(boxes) if not box), len(boxes))
        trail = next((k for k in range(len(boxes), 0, -1) if not boxes[k - 1]), 0)
        for k, c in enumerate(held):
            if not isinstance(c, Node):
                continue
            starts, ends = first and k <= lead, last and k >= trail - 1
            if c.tag in BLOCK and (of_links(c) or c.tag in CONTAINERS and (starts and k < lead or ends and k >= trail)):
                yield x, c
            pending.append((c, starts, ends))


def unwanted(node: Node, inside_article: bool) -> bool:
    if node.tag in ("html", "body", "article", "main"):
        return node.tag == "article" and named(node, CHROME)
    if node.tag in DROPPED or node.hidden or named(node, CHROME):
        return True
    return not inside_article and (node.tag == "header" or named(node, HEADERS))


def contents(root: Node) -> list[Node]:
    """The outermost articles that are not comments or the like; without one the main element, without that the whole page.

    What lies in an element that is chrome by name counts only if nothing else is found: the name may be a layout's.
    """
    for strict in (True, False):
        for wanted in ("article", "main"):
            found, pending = [], [root]
            while pending:
                x = pending.pop()
                if x.tag == wanted or wanted == "main" and named(x, frozenset(["main"])) and x.tag in BLOCK and x.tag != "body":
                    if not named(x, CHROME):
                        found.append(x)
                    continue
                if x.tag in DROPPED or strict and x.tag not in ("html", "body") and named(x, CHROME):
                    continue
                pending.extend(c for c in reversed(x.inside) if isinstance(c, Node))
            if found:
                return found
    return [root]


def leads(root: Node, article: Node) -> list[Node]:
    """The headline and lead that stand before an article in the main element around it."""
    path = {id(article)}
    for node in reversed(list(walk(root))):
        if any(id(c) in path for c in node.inside):
            path.add(id(node))
    inner = [x for x in walk(root) if id(x) in path and x.tag == "main"]
    if not inner or article.tag == "main":
        return []
    found, pending = [], list(reversed(inner[-1].inside))
    while pending:
        x = pending.pop()
        if x is article:
            break
        if not isinstance(x, Node) or x.tag in RAW:
            continue
        if id(x) in path:
            pending.extend(reversed(x.inside))
        elif x.tag in LEADS and not x.hidden and not named(x, CHROME) and not of_links(x):
            found.append(x)
        elif x.tag in ("div", "section") and not x.hidden and not named(x, CHROME | HEADERS):
            pending.extend(reversed(x.inside))
    return found


def prune(root: Node, template: set[int] | frozenset[int]) -> None:
    """Delete the recurring subtrees: outside marked content all, inside it those that are chrome by form or place."""
    tops = [x for x in contents(root) if x is not root]
    marked, above = {id(x) for x in tops}, set()
    for node in reversed(list(walk(root))):
        if any(id(c) in marked or id(c) in above for c in node.inside):
            above.add(id(node))
    pending = [root]
    while pending:
        x = pending.pop()
        if id(x) not in marked:
            x.inside = [c for c in x.inside if not isinstance(c, Node) or id(c) in marked or id(c) in above or signed(c.hash) not in template]
            pending.extend(c for c in x.inside if isinstance(c, Node))
    for top in tops:
        gone: dict[int, tuple[Node, Node]] = {id(c): (parent, c) for parent, c in chrome_in(top) if signed(c.hash) in template}
        outer, pending = [], [top]
        while pending:
            x = pending.pop()
            if id(x) in gone:
                outer.append(gone[id(x)])
            else:
                pending.extend(c for c in x.inside if isinstance(c, Node))
        if 2 * sum(c.size for _, c in outer) > top.size:  # a copy of a whole article recurs too
            outer = [(p, c) for p, c in outer if of_links(c)]
        if sum(c.size for _, c in outer) < top.size:
            for parent, c in outer:
                parent.inside = [k for k in parent.inside if k is not c]


def chosen(root: Node) -> list[Node]:
    """The contents; articles that are only cards of other pages go where the prose of the page lies outside them."""
    tops = contents(root)
    cards = [x for x in tops if x.tag == "article" and (x.title_link or of_links(x))]
    if cards and len(cards) == len(tops):
        prose = lambda x: x.size - x.linked
        held = {id(x) for x in cards}
        outside, pending = 0, [root]
        while pending:
            x = pending.pop()
            for c in x.inside:
                if isinstance(c, str):
                    outside += len("".join(c.split()))
                elif id(c) not in held and not unwanted(c, False) and c.tag not in RAW and c.tag != "a":
                    pending.append(c)
        if outside > sum(map(prose, cards)):
            for x in walk(root):
                x.inside = [c for c in x.inside if id(c) not in held]
            return contents(root)
    return [*leads(root, tops[0]), *tops] if len(tops) == 1 and tops[0] is not root else tops


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def template_candidates(html: str | None) -> set[int]:
    """Hashes of the subtrees outside marked content, and of those inside it that are chrome by form or place."""
    root = tree(html or "")
    hash_subtrees(root)
    measure(root)
    tops = [x for x in contents(root) if x is not root]
    marked = {id(x) for x in tops}
    out = {signed(c.hash) for top in tops for _, c in chrome_in(top)}
    pending = [root]
    while pending:
        x = pending.pop()
        if id(x) in marked or x.tag in DROPPED and x.tag not in ("nav", "aside", "form", "footer"):
            continue
        if x.tag not in ("html", "body") and x.tag in BLOCK:
            out.add(signed(x.hash))
        pending.extend(c for c in x.inside if isinstance(c, Node))
    return out


def main_text(html: str | None, template: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks of the main text, joined by an empty line."""
    root = tree(html or "")
    measure(root)
    if template:
        hash_subtrees(root)
        prune(root, template)
        measure(root)
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    for top in chosen(root):
        end()
        pending: list[tuple[object, bool]] = [(top, False)]
        while pending:
            x, closing = pending.pop()
            if isinstance(x, str):
                line.append(x)
                continue
            if closing:
                end()
                continue
            if x is not top and unwanted(x, top is not root):
                if x.tag in BLOCK:
                    end()
                continue
            if x.tag in ("br", "hr", "img"):
                line.append(" ")
            if x.tag in BLOCK:
                end()
                pending.append((x, True))
            pending.extend((c, False) for c in reversed(x.inside))
    end()
    return "\n\n".join(blocks)


def host(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark or hash, A-Z lower-cased; empty without one."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(after, r"^[^/?#]*", 0), F.lit("")), upper, upper.lower())


def section(url: Column) -> Column:
    """The first directory of the path; null without one."""
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.regexp_extract(after, r"^[^/?#]*/([^/?#]+)/", 1)
    return F.when((F.instr(url, "://") > 0) & (found != ""), found)


def recurring(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(host, section, template): the hashes that recur on enough pages of each host (null section) and of its sections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [sorted(template_candidates(t.as_py())) for t in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("section"), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "section", "hashes"])

    placed = pages.select(host(F.col("url")).alias("host"), section(F.col("url")).alias("section"), "html").where("host != ''")
    each = placed.mapInArrow(run, "host string, section string, hashes array<long>")
    # 0 stands for the page itself, so that one aggregation counts pages and subtrees
    seen = each.select("host", "section", F.explode(F.concat(F.array(F.lit(0).cast("long")), "hashes")).alias("hash")).groupBy("host", "section", "hash").count()
    seen = materialize(seen, "web-subtrees")
    whole = seen.groupBy("host", "hash").agg(F.sum("count").alias("count")).select("host", F.lit(None).cast("string").alias("section"), "hash", "count")
    both = whole.unionByName(seen.where("section is not null")).where(F.col("count") >= least)
    total = both.where("hash = 0").select(F.col("host").alias("h"), F.col("section").alias("s"), F.col("count").alias("pages"))
    often = both.where("hash != 0").join(total, (F.col("host") == F.col("h")) & F.col("section").eqNullSafe(F.col("s"))).where(F.col("count") >= share * F.col("pages"))
    return often.groupBy("host", "section").agg(F.collect_set("hash").alias("template"))


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(host, template): the hashes that recur on enough pages of each host that has any."""
    return recurring(pages, share, least).where("section is null").select("host", "template")


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = materialize(recurring(pages, share, least), "web-templates")
    whole = found.where("section is null").select("host", F.col("template").alias("_whole"))
    part = found.where("section is not null").select("host", "section", F.col("template").alias("_part"))
    source = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), section(F.col("url")).alias("section"))
    source = source.join(broadcast_if_small(whole), "host", "left").join(broadcast_if_small(part), ["host", "section"], "left")
    none = F.array().cast("array<long>")
    source = source.withColumn("template", F.array_union(F.coalesce("_whole", none), F.coalesce("_part", none)))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py(), frozenset(t.as_py() or ())) for h, t in zip(batch.column("html"), batch.column("template"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.select("page_id", "url", "html", "template").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
