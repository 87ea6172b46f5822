"""Main text of pages: the parser by cases, the site tree by importance worked out by hand, and whole sites."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from isotherm.llm import extraction

PAGES = "page_id long, url string, html string, host string, low string, path int, salt int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 1, 2) for i, u, h in rows], PAGES)


@pytest.mark.parametrize(
    "source, text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>A</h1><p>b\n\t c<p>d<b>e</b> f<br>g</article><footer>x</footer>", "A\nb c\nde f g"),
        ("<article><p><b>open<br><p>next</p></article>", "open\nnext"),
        ("<nav><ul><li>a<li>b</ul></nav><article>t<div class='ad'>buy</div>u</article>", "t\nu"),
        ("<article><p>a</p><section class='x comments'><article><p>reader</p></article></section></article>", "a"),
        ("<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>a</p></article>", "T\na"),
        ("<script>var t='</p><article>';</script><style>p{}</style><article>a<!-- <p>no</p> -->b</article>", "ab"),
        ("<article>&lt;p&gt; &#233;&eacute;&nbsp;x &amp</article><script>open <article>z", "<p> éé x &"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<ARTICLE><P>Up</P></ARTICLE><div ROLE=navigation>n</div><form>f</form><aside>s</aside>", "Up"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>x<ul><li>y</ul><li>z</ul></article>", "1\n2\n3\nx\ny\nz"),
        ("<article><p class='q\" title=\">a</p><p>b</p></article>", "a\nb"),
        ("</p></div><article>a</b></article>b", "a\nb"),
    ],
)
def test_cases(source, text):
    assert extraction.main_text(extraction.parse(source)) == text


def test_any_markup_is_read():
    random_ = random.Random(2)
    bits = ["<", ">", "</", "p", "div", " ", "'", '"', "=", "class", "<!--", "-->", "&", "amp;", "<article>", "</article>", "<p>", "é", "<script>", "</script", "/>"]
    for _ in range(2000):
        extraction.main_text(extraction.parse("".join(random_.choice(bits) for _ in range(random_.randrange(60)))))
    deep = extraction.parse("<div>" * 50_000 + "a")
    assert len({n.path for n in deep.nodes}) == 2 and deep.blocks[-1][1] == "a"
    assert len(extraction.parse("<a '" * 2000).blocks) <= 2000


def site(random_, host, number, same=False):
    """Pages of one template without any telling name: a bar, a text, a strip of one of three texts, and a last line."""
    words = [f"w{k}" for k in range(400)]

    def sentence():
        return " ".join(random_.choice(words) for _ in range(12))

    strips = [sentence() for _ in range(3)]
    out = []
    for k in range(number):
        own = [] if same and out else [sentence() for _ in range(random_.randrange(2, 6))]
        own = own or out[0][2]
        body = "".join(f"<p>{t}</p>" for t in own)
        strip = strips[k % 3] if not same else strips[0]
        out.append((f"http://{host}/{k}", f"<html><body><div class='a{k}'><ul><li>Home<li>News</ul></div><div class='b'>{body}</div><div class='c'>{strip}</div><div class='d'>All rights</div></body></html>", own))
    return out


def test_the_tree_finds_unnamed_boilerplate(spark):
    random_ = random.Random(7)
    rows, texts = [], {}
    for host, number in (("one.example", 40), ("two.example", 60)):
        for url, source, own in site(random_, host, number):
            texts[len(rows)] = "\n".join(own)
            rows.append((len(rows), url, source))
    got = {r["page_id"]: r for r in extraction.extract(pages(spark, rows).repartition(5)).collect()}
    assert {i: r["text"] for i, r in got.items()} == texts
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == rows[i][1] for i, r in got.items())


def test_the_join_by_host_gives_the_same(spark, monkeypatch):
    rows = [(k, u, s) for k, (u, s, _) in enumerate(site(random.Random(3), "h.example", 30))]
    once = {tuple(r) for r in extraction.extract(pages(spark, rows)).collect()}
    monkeypatch.setattr(extraction, "BROADCAST_BRANCHES", -1)
    assert {tuple(r) for r in extraction.extract(pages(spark, rows)).collect()} == once


def test_a_site_of_copies_keeps_its_text(spark):
    rows = [(k, u, s) for k, (u, s, _) in enumerate(site(random.Random(5), "copies.example", 6, same=True))]
    own = site(random.Random(5), "copies.example", 6, same=True)[0][2]
    assert all("\n".join(own) in r["text"] for r in extraction.extract(pages(spark, rows)).collect())


def test_odd_rows(spark):
    source = "<article>a</article><footer>f</footer>"
    rows = [(1, None, None), (1, "", ""), (None, "HTTP://U@Host:1/x", source), (2, "no host", source), (2, "no host", source), (3, "http://host:1", "<p>" + "long word " * 200_000)]
    got = extraction.extract(pages(spark, rows)).collect()
    assert sorted(((r["page_id"] or 0), r["text"][:9], r["n_chars"]) for r in got) == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "a", 1), (2, "a", 1), (3, "long word", 1_999_999)]
    assert extraction.extract(pages(spark, [])).collect() == []
    hosts = pages(spark, rows).select(extraction.host_of(F.col("url")).alias("h")).collect()
    assert [h["h"] for h in hosts] == ["", "", "host:1", "", "", "host:1"]


def test_importance_by_hand(spark):
    """Against the definitions, counted in Python."""
    random_ = random.Random(11)
    rows = [(k, u, s) for k, (u, s, _) in enumerate(site(random_, "a.example", 12) + site(random_, "b.example", 5))]
    styles, texts, kinds, above = defaultdict(Counter), defaultdict(Counter), defaultdict(int), defaultdict(set)
    for _, url, source in rows:
        host, page = url.split("/")[2], extraction.parse(source)
        for path, kind, feature, children in extraction._page_rows(page):
            (styles if kind == extraction.STYLE else texts)[host, path][feature] += 1
            kinds[host, path] = max(kinds[host, path], children)
        for node in page.nodes[1:]:
            up = node.parent
            while up >= 0:
                if page.nodes[up].path != node.path:
                    above[host, page.nodes[up].path].add((host, node.path))
                up = page.nodes[up].parent
    want = {}
    for node, seen in styles.items():
        m = sum(seen.values())
        presentation = 1.0 if m == 1 else -sum(c / m * math.log(c / m, m) for c in seen.values())
        entropies = []
        for place in {node, *above[node]}:
            shown = sum(styles[place].values())
            entropies += [0.0 if shown == 1 else math.log(c, shown) for c in texts[place].values()]
        content = 1 - sum(entropies) / len(entropies) if entropies else 1.0
        damped = 0.9 ** kinds[node]
        want[node] = (1 - damped) * presentation + damped * content
    frame = pages(spark, rows).select("html", extraction.host_of(F.col("url")).alias("host"))
    got = {(r["host"], r["path"]): r["importance"] for r in extraction.importance(extraction.site_nodes(frame), ["host"]).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_given_pages(spark):
    """Articles of the given template, cut out by pattern."""
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    for row in rows:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", row["html"], re.S)[1]
        parts = [" ".join(extraction.entities.unescape(re.sub(r"</?(?:b|br)>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", inside)]
        assert got[row["page_id"]] == "\n".join(p for p in parts if p)
