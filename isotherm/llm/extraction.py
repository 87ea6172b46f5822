"""Main text of web pages from site style trees.

The pages of a host are merged into one tree: a node is the path of an element from the root (tag, classes and id without
digits; runs of equal elements count once), its presentation styles are the sequences of its children's kinds, its content
features are the texts of its blocks. Over the m pages that show a node,

* presentation importance is the entropy of its styles to the base m, 0 where all pages show one style;
* content importance is 1 less the mean over distinct texts of log c to the base m, c being the pages that show the text,
  so a text on every page weighs 0 and one on a single page 1; inner nodes take all texts below them;
* the importance of a node with l kinds of children is (1 - 0.9^l) * presentation + 0.9^l * content.

Hosts of few pages lean on the tree of all hosts, as if it had shown the node on FEW further pages. A branch goes if it was
seen on SEEN pages or more and its importance is under RELATIVE times the largest of its host's text nodes; where all pages of
a host are copies of each other nothing stands out, and nothing goes.

Entropy cannot tell reader comments from an article (both are unique) nor an article from its copies. Where an element
says what it is, by tag, role, class or id (nav, footer, ``class="ad"``, ``class="comments"``; article, main), that settles it; the
tree decides about all other branches.

Defined results: null html is empty and gives an empty text; a null url is a host of its own kind; repeated pages stay
rows of their own; an empty table gives no rows; further columns are not read; broken markup is read as browsers roughly do
(open elements end with their parents, an unfinished script hides the rest). Pages are parsed whole, one at a time.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.session import discard, materialize

DAMPING = 0.9
#: pages that the tree of all hosts counts for; pages needed before a branch may go; share of the best importance it must reach
FEW, SEEN, RELATIVE = 10, 3, 0.4
#: low-importance branches that may travel to all tasks; more are joined by host
BROADCAST_BRANCHES, SALTS = 1 << 20, 32

# fixed values: names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "html body head address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section select summary table tbody td template tfoot th thead tr ul svg object canvas".split()
)
CLOSES_P = BLOCKS - {"html", "body", "head", "button", "select", "template", "svg", "object", "canvas", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = frozenset("ul ol dl menu table".split())
# fixed values: elements and names that never belong to a main text, or always do
NOISE_TAGS = frozenset("head nav footer aside form button select menu dialog template svg object canvas".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter "
    "subscribe menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar footer sidebar widget related recommended "
    "share sharing social comment comments commentlist disqus respond replies login signup search".split()
)
HEADER_NAMES = frozenset(["header"])
MAIN_TAGS, MAIN_ROLES = frozenset(["article", "main"]), frozenset(["article", "main"])

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node(NamedTuple):
    """An element of a page: its place in the site's tree, its parent (index, -1 for the root), its kind, and what its names say."""

    path: int
    parent: int
    kind: str
    noise: bool
    main: bool


class Page(NamedTuple):
    nodes: list[Node]
    #: node index and text of each block in page order
    blocks: list[tuple[int, str]]


def key(text: str) -> int:
    """A signed 64-bit key."""
    whole = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return whole - (1 << 64) if whole >> 63 else whole


def _named(tag: str, attributes: str, in_main: bool) -> tuple[str, bool, bool]:
    """Kind of an element, whether its names call it noise, whether they call it the main text."""
    kind, roles, names = tag, set(), set()
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            value = entities.unescape(m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                roles |= set(value.split())
            else:
                value = re.sub(r"\d+", "", value)
                names |= {w for w in re.split(r"[^a-z]+", value) if w}
                kind += ("." if m[1].lower() == "class" else "#") + ".".join(sorted(value.split()))
    noise = tag in NOISE_TAGS or bool(roles & NOISE_ROLES or names & NOISE_NAMES) or (not in_main and (tag == "header" or bool(names & HEADER_NAMES)))
    if tag in ("html", "body"):
        noise = False
    return kind, noise, (tag in MAIN_TAGS or bool(roles & MAIN_ROLES)) and not noise


def parse(source: str) -> Page:
    """Elements and text blocks of a page."""
    nodes = [Node(key(""), -1, "", False, False)]
    blocks: list[tuple[int, str]] = []
    #: open elements: tag, node, and whether it lies in the main text
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    is_open: Counter[str] = Counter()
    held: list[str] = []
    at = 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((stack[-1][1], text))

    def close(to: int) -> None:
        flush()
        is_open.subtract(tag for tag, _, _ in stack[to:])
        del stack[to:]

    def find(names: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> int:
        """Place of the innermost open element of these names, before one of ``stop``; 0 if there is none."""
        if not any(is_open[name] for name in names):
            return 0
        for place in range(len(stack) - 1, 0, -1):
            if stack[place][0] in names:
                return place
            if stack[place][0] in stop:
                return 0
        return 0

    while (m := _TOKEN.search(source, at)) is not None:
        held.append(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ends, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if ends:
            place = find({tag})
            if place:
                close(place)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            # its text is no markup; it ends at its own end tag only
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        kind, noise, main = _named(tag, attributes, stack[-1][2])
        if tag not in BLOCKS and not noise:
            continue  # inline markup is part of its block
        if tag in CLOSES_P and (place := find({"p"}, frozenset(["button", "td", "th"]))):
            close(place)
        if tag in SAME_LEVEL and (place := find(SAME_LEVEL[tag], LISTS)):
            close(place)
        flush()
        parent = nodes[stack[-1][1]]
        path = parent.path if parent.kind == kind else key(f"{parent.path}>{kind}")
        nodes.append(Node(path, stack[-1][1], kind, noise, main))
        stack.append((tag, len(nodes) - 1, stack[-1][2] or main))
        is_open[tag] += 1
    held.append(source[at:])
    flush()
    return Page(nodes, blocks)


def main_text(page: Page, low: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks left when noisy elements and the branches in ``low`` are gone, a line each."""
    gone = [False] * len(page.nodes)
    for i, node in enumerate(page.nodes[1:], 1):
        kept = node.main or node.kind.split(".")[0].split("#")[0] in ("html", "body")
        gone[i] = gone[node.parent] or node.noise or (not kept and node.path in low)
    return "\n".join(text for i, text in page.blocks if not gone[i])


STYLE, CONTENT, BRANCH = 0, 1, 2
NODES = "host string, path long, kind byte, feature long, children int, pages long"


def _page_rows(page: Page) -> Iterator[tuple[int, int, int, int]]:
    """``path, kind, feature, children`` of one page: a style for each path, and each distinct text of a path."""
    children: dict[int, list[str]] = {}
    for node in page.nodes[1:]:
        children.setdefault(node.path, [])
        own = children.setdefault(page.nodes[node.parent].path, [])
        if node.path != page.nodes[node.parent].path and (not own or own[-1] != node.kind):
            own.append(node.kind)
    for path, kinds in children.items():
        yield path, STYLE, key(" ".join(kinds)), len(set(kinds))
    for path, text in {(page.nodes[i].path, t): None for i, t in page.blocks}:
        yield path, CONTENT, key(text), 0


def site_nodes(pages: DataFrame) -> DataFrame:
    """The merged trees of ``host, html`` pages: ``host, path, kind, feature, children, pages``.

    Kind 0: pages that show the path in this style; 1: pages with this text in the path; 2: the feature is an ancestor of
    the path. Tasks add up their pages, and Spark theirs, so a hot host is no hot task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            rows: list[tuple] = []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = parse(source)
                for node in page.nodes[1:]:
                    if (host, node.path) not in seen:
                        seen.add((host, node.path))
                        chain, up = [], node.parent
                        while up >= 0:
                            chain.append(page.nodes[up].path)
                            up = page.nodes[up].parent
                        rows += [(host, node.path, BRANCH, a, 0) for a in dict.fromkeys(chain) if a != node.path]
                rows += [(host, *row) for row in _page_rows(page)]
            if len(seen) > 1 << 19:  # bounded; naming an ancestor again does no harm
                seen.clear()
            if rows:
                columns = list(zip(*rows))
                types = (pa.string(), pa.int64(), pa.int8(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)] + [pa.array([1] * len(rows), pa.int64())], [f.split()[0] for f in NODES.split(", ")])

    found = pages.select("host", "html").mapInArrow(run, NODES)
    return found.groupBy("host", "path", "kind", "feature").agg(F.max("children").alias("children"), F.sum("pages").alias("pages"))


def importance(nodes: DataFrame, site: list[str]) -> DataFrame:
    """``site columns, path, shown, texts, importance`` of every node; ``texts`` are the distinct texts right in it."""
    style, content = F.col("kind") == STYLE, F.col("kind") == CONTENT
    logs = F.log(F.col("pages"))
    own = nodes.where(F.col("kind") < BRANCH).groupBy(*site, "path").agg(
        F.sum(F.when(style, F.col("pages")).otherwise(0)).alias("shown"),
        F.sum(F.when(style, F.col("pages") * logs).otherwise(0.0)).alias("styled"),
        F.count_if(content).alias("texts"),
        F.sum(F.when(content, logs).otherwise(0.0)).alias("repeated"),
        F.max("children").alias("children"),
    )
    base = F.log(F.col("shown"))
    # a node of a single page weighs 1
    single = F.col("shown") <= 1
    below = own.select(*site, "path", "texts", F.when(single, 0.0).otherwise(F.col("repeated") / base).alias("entropy"))
    up = nodes.where(F.col("kind") == BRANCH).select(*site, "path", F.col("feature").alias("above")).distinct()
    sums = (
        below.join(up, [*site, "path"]).select(*site, F.col("above").alias("path"), "texts", "entropy")
        .unionByName(below)
        .groupBy(*site, "path").agg(F.sum("texts").alias("all_texts"), F.sum("entropy").alias("entropy"))
    )
    presentation = F.when(single, 1.0).otherwise(1 - F.col("styled") / (F.col("shown") * base))
    inner = F.when(F.col("all_texts") > 0, 1 - F.col("entropy") / F.col("all_texts")).otherwise(1.0)
    damped = F.pow(F.lit(DAMPING), F.col("children"))
    return own.join(sums, [*site, "path"]).select(*site, "path", "shown", "texts", ((1 - damped) * presentation + damped * inner).alias("importance"))


def _salt(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _each_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def low_branches(pages: DataFrame) -> DataFrame:
    """``host, path`` of the branches of low importance, from ``host, html`` pages."""
    nodes = materialize(site_nodes(pages), "site-nodes")
    everywhere = nodes.groupBy("path", "kind", "feature").agg(F.max("children").alias("children"), F.sum("pages").alias("pages"))
    web = importance(everywhere, []).select("path", F.col("importance").alias("anywhere"), _each_salt())
    own = importance(nodes, ["host"]).withColumn("salt", _salt(F.col("host")))
    blended = (F.col("shown") * F.col("importance") + FEW * F.col("anywhere")) / (F.col("shown") + FEW)
    judged = materialize(own.join(web, ["path", "salt"]).select("host", "path", "shown", "texts", blended.alias("importance")), "importance")
    best = judged.where("texts > 0").groupBy("host").agg(F.max("importance").alias("best"))
    low = materialize(judged.join(best, "host").where((F.col("shown") >= SEEN) & (F.col("importance") < RELATIVE * F.col("best"))).select("host", "path"), "low")
    discard(nodes, judged)
    return low


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; what has none is its own host."""
    found = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    return F.coalesce(found, F.lit(""))


TEXTS = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    low = low_branches(whole)
    listed = low.groupBy("host").agg(F.collect_set("path").alias("low"))
    if low.count() <= BROADCAST_BRANCHES:
        joined = whole.join(F.broadcast(listed), "host", "left")
    else:
        joined = whole.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(listed.select("host", "low", _each_salt()), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(parse(source), set(low or ())) for source, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return joined.select("page_id", "url", "html", "low").mapInArrow(run, TEXTS)
