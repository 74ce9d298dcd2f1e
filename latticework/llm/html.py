"""Main text of web pages by consensus of a host's pages.

Every container of a page is scored by the text in it: a block's characters, less twice those in links, count wholly for the element around
its paragraph, half for the next and a quarter for the one above, and wholly once more for its article or main element; text in elements named after other kinds (``KINDS``) a quarter. Each container
votes, with its share of its page's scores, for its generalised path (tags and classes from the root down, digits replaced). Spark adds the votes up by
host and path, pre-aggregated before the shuffle; a path whose text varies little over the host's pages counts less. The path with most votes wins,
and every page is extracted again with its host's winner; a page without text there falls back to its own best container.

From the winner's text go the kinds that aren't article: elements that say so by tag, role or hidden state (menus, page headers, footers, sidebars,
forms), elements within the winner that are named after adverts, notices, forms or reader comments (``KINDS``), and boxes voted out: containers within the
winner whose text is the same on most different pages of the host (``TEMPLATE_PAGES`` at least). Character references are decoded; white
space within a block becomes one space; blocks are joined by one line end.

Paths travel as 128-bit digests, so a page costs memory in proportion to its length, however deep it nests. Winners (one row per host) are broadcast only if
they and their boxes are few enough (``BROADCAST_HOSTS``, checked); else the join shuffles, and adaptive execution splits a hot host.

Edge cases: a null html is an empty page with empty text; a null or odd url belongs to the host ""; a very long page is parsed whole in one
worker's memory; ties among paths go to the larger digest; null ids and repeated rows give one row each; an empty table gives an empty
result; extra columns are dropped.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, stored, table, text_udf, tidy

BROADCAST_HOSTS = 100_000
#: Different pages of a host that must have a box, and the share of different texts in it up to which it is a template.
TEMPLATE_PAGES, TEMPLATE_SHARE = 4, 0.5

TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?][^>]*(?:>|\Z)|/[^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """html body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr ul
    head object video audio canvas""".split()
)
#: What an opening tag closes, up to the elements that shield it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
DROPPED = frozenset("head nav footer aside form select button dialog menu svg object video audio canvas fieldset search optgroup option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: What an element within the article may be named after that isn't article.
KINDS = re.compile(r"(?:ads?|advert(?:s|isement|ising)?|sponsored|promo|cookies?|consent|notice|newsletter|comments?)(?:[-_](?:box|block|list|section|banner|form|area|\d+))?", re.I)
#: Elements that hold blocks; only these vote.
PARAGRAPH = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote td th dd dt tr caption figcaption summary address center legend".split())
NEVER = frozenset("html body main article".split())
ROOT = b""


class Node:
    """An open or closed block element. ``step``: its part of the generalised path, ``key``: digest of that path; ``named``: after something that isn't article, ``quiet``: it or
    an element around it is."""

    __slots__ = ("tag", "step", "key", "parent", "dropped", "named", "quiet", "article")

    def __init__(self, tag: str, step: str, parent: Node | None, dropped: bool, named: bool):
        self.tag, self.step, self.parent, self.dropped, self.named = tag, step, parent, dropped, named
        self.key = below(parent.key, step) if parent is not None else ROOT
        self.quiet = named or (parent is not None and parent.quiet)
        self.article = self if tag in ("article", "main") else parent.article if parent is not None else None


def generalised(tag: str, classes: str) -> str:
    return ".".join([tag, *sorted({re.sub(r"\d+", "0", c.lower()).replace(">", "") for c in classes.split()})])


def below(key: bytes, segment: str) -> bytes:
    """Digest of a path and one more element."""
    return blake2b(key + segment.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def path_of(x: Node) -> str:
    """A written path, as ``>html>body>div.post``."""
    steps = []
    while x.parent is not None:
        steps.append(f">{x.step}")
        x = x.parent
    return "".join(reversed(steps))


def path_key(path: str) -> bytes:
    """Digest of a written path."""
    key = ROOT
    for step in path.split(">")[1:]:
        key = below(key, step)
    return key


def told(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element says by its attributes that it isn't article, whether it is named after such a kind, and its classes."""
    given = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    classes = given.get("class", "")
    if tag in NEVER:
        return False, False, classes
    if given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return True, False, classes
    if re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return True, False, classes
    return False, any(KINDS.fullmatch(n) for n in (*classes.split(), *given.get("id", "").split())), classes


def parse(html: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """Blocks (element, text, characters in links) in page order, boilerplate left out, and all block elements."""
    root = Node("", "", None, False, False)
    at, nodes, blocks = root, [root], []
    parts: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not at.dropped:
                blocks.append((at, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not at.dropped:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text)

    def close(names, shield) -> None:
        """Close the nearest element of ``names`` and all within, unless one of ``shield`` comes first."""
        nonlocal at
        x = at
        while x.parent is not None:
            if x.tag in names:
                at = x.parent
                return
            if x.tag in shield:
                return
            x = x.parent

    pos, n = 0, len(html)
    while pos < n:
        m = TAG.search(html, pos)
        if m is None:
            say(html[pos:])
            break
        say(html[pos : m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:  # end tag
            if tag in BLOCK:
                flush()
                close((tag,), ())
            elif tag == "a":
                in_link = False
            continue
        if tag in RAW:
            end = RAW[tag].search(html, pos)
            pos = end.start() if end else n
            continue
        if tag in BLOCK:
            flush()
            in_link = in_link and tag not in ("p", "div", "li", "article", "section")
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag != "option" and at.tag == "p":
                at = at.parent
            other, named, classes = told(tag, attributes) if attributes and not attributes.isspace() else (False, False, "")
            dropped = at.dropped or other or tag in DROPPED or (tag == "header" and at.article is None)
            at = Node(tag, generalised(tag, classes), at, dropped, named)
            nodes.append(at)
        elif tag == "br":
            say(" ")
        elif tag == "hr":
            flush()
        elif tag == "a":
            in_link = True
    flush()
    return blocks, nodes


def scores_of(blocks: list[tuple[Node, str, int]]) -> dict[Node, int]:
    """What each container scores by the blocks in it."""
    scores: dict[Node, int] = {}
    for node, text, linked in blocks:
        gain = len(text) - 2 * linked
        if node.quiet:
            gain //= 4
        box, share = node, 4
        while box.tag in PARAGRAPH and box.parent is not None:
            box = box.parent
        while box is not None and share:
            scores[box] = scores.get(box, 0) + gain * share
            box, share = box.parent, share // 2
        if node.article is not None:
            scores[node.article] = scores.get(node.article, 0) + gain * 4
    return scores


def best_container(blocks: list[tuple[Node, str, int]]) -> tuple[Node, int] | None:
    """The container with the highest score, and the score; None without blocks."""
    return max(scores_of(blocks).items(), key=lambda kv: (kv[1], kv[0].key), default=None)


def vote(html: str) -> tuple[str, int]:
    """Path and score of a page's own best container."""
    best = best_container(parse(html)[0])
    return (path_of(best[0]), best[1]) if best else ("", 0)


def votes_of(html: str) -> tuple[list[tuple[bytes, float, int]], int]:
    """Votes (path, share of the page's scores, digest of its text), one for each path of a container, and a digest of the page's text."""
    blocks, nodes = parse(html)
    best: dict[bytes, int] = {}
    for node, score in scores_of(blocks).items():
        best[node.key] = max(best.get(node.key, 0), score)
    whole = sum(best.values())
    words: dict[Node, int] = {}
    for i, (node, text, _) in enumerate(blocks):
        words[node] = words.get(node, 0) + xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) * (2 * i + 1)
    by_path: dict[bytes, int] = {}
    for node in reversed(nodes):  # a parent comes before its children
        n = words.get(node, 0)
        if n and node.parent is not None:
            words[node.parent] = words.get(node.parent, 0) + n
        if n and node.tag not in PARAGRAPH:
            by_path[node.key] = by_path.get(node.key, 0) + n
    signed = lambda n: ((n + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)
    votes = [(key, best.get(key, 0) / whole if whole else 0.0, signed(n)) for key, n in by_path.items()]
    return votes, signed(sum(words.get(node, 0) for node in nodes[:1]))


def inside(blocks: list[tuple[Node, str, int]], key: bytes, boxes: frozenset[bytes] = frozenset()) -> str:
    """Text of the blocks in elements of this path, without elements within that are named after other kinds or voted out (``boxes``)."""
    known: dict[Node, bool | None] = {}  # True in the article, False in a part that goes, None outside of it

    def state(x: Node) -> bool | None:
        chain, found = [], None
        while x is not None and x not in known:
            chain.append(x)
            x = x.parent
        found = known[x] if x is not None else None
        for y in reversed(chain):
            if found and (y.named or y.key in boxes):
                found = False
            elif found is None and y.key == key:
                found = True
            known[y] = found
        return found

    return "\n".join(text for node, text, _ in blocks if state(node))


def extract(html: str, path: str | bytes | None, boxes=()) -> str:
    """Main text by the winning path (written or as a digest); where that holds none by the page's own best container."""
    blocks, _ = parse(html)
    key = path_key(path) if isinstance(path, str) else path
    found = inside(blocks, key, frozenset(boxes or ())) if key is not None else ""
    if found or not blocks:
        return found
    return inside(blocks, best_container(blocks)[0].key)


def host_paths(pages: DataFrame) -> DataFrame:
    """``host``, ``path``: the digest of the path with most votes of each host, and ``boxes``: paths of containers that hold the same text on most pages. The boxes of a
    host are paths of its templates, not of its pages. ``pages`` has ``host`` and ``html``."""
    run = text_udf(lambda: votes_of, "votes array<struct<path: binary, share: double, words: bigint>>, page bigint")
    votes = pages.select("host", run(F.col("html")).alias("v")).select("host", F.explode("v.votes").alias("x"), "v.page").select("host", "x.*", "page")
    counted = votes.groupBy("host", "path").agg(F.sum("share").alias("share"), F.approx_count_distinct("words").alias("texts"), F.approx_count_distinct("page").alias("pages"))
    variety = F.least(F.lit(1.0), F.col("texts") / F.col("pages"))
    counted = counted.select("host", "path", (F.col("share") * variety).alias("share"), ((F.col("pages") >= TEMPLATE_PAGES) & (variety <= TEMPLATE_SHARE)).alias("template"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("share", "path")).alias("path"), F.collect_set(F.when(F.col("template"), F.col("path"))).alias("boxes"))


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """A row per page: id, url, ``text``, ``n_chars``."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    winners = stored(host_paths(rows), "hosts")
    few = (winners.agg(F.sum(1 + F.size("boxes"))).first()[0] or 0) <= broadcast_hosts

    @F.arrow_udf("string")
    def run(texts: pa.Array, paths: pa.Array, boxes: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), SLICE_ROWS):
            out += [extract(t or "", p, b) for t, p, b in zip(*(x.slice(at, SLICE_ROWS).to_pylist() for x in (texts, paths, boxes)), strict=True)]
        tidy()
        return pa.array(out, pa.string())

    found = rows.join(F.broadcast(winners) if few else winners, "host", "left").select("id", "url", run("html", "path", "boxes").alias("text"))
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
