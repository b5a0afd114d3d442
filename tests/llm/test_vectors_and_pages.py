import html
import math
import random
import re

import numpy as np
import pytest

from tracemill.llm import embedding_neighbours, html_extract
from tracemill.llm.queries import op2_embedding_neighbours, op9_html_extract


def brute(rows):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = np.array(v, np.float64)
            usable[i] = v / np.linalg.norm(v)
    links = {i: [j for j in usable if j != i and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= 0.95] for i, _ in rows if i in usable}
    owner = {i: i for i, _ in rows if i is not None}
    for _ in owner:
        for i, others in links.items():
            for j in others:
                owner[i] = owner[j] = min(owner[i], owner[j])
    return {i: (len(links.get(i, ())), owner[i]) for i in owner}


def near(base, rng, noise):
    v = base + noise * rng.standard_normal(len(base)) / math.sqrt(len(base))
    return v.astype(np.float32).tolist()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(24).astype(np.float32).tolist()) for i in range(300)]
    unit = lambda v: v / np.linalg.norm(v)
    dense = unit(rng.standard_normal(24))
    rows += [(1000 + k, near(dense, rng, 0.22)) for k in range(90)]
    rows += [(2000 + k, rows[k][1]) for k in range(30)] + [(2100 + k, rows[k][1]) for k in range(10)]
    rows += [(3000 + k, near(np.array(rows[k][1]) / np.linalg.norm(rows[k][1]), rng, 0.3)) for k in range(60)]
    a, b = (unit(rng.standard_normal(24)) for _ in range(2))
    b = unit(b - (a @ b) * a)
    rows += [(4000 + k, (math.cos(k * 0.1) * a + math.sin(k * 0.1) * b).astype(np.float32).tolist()) for k in range(40)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [1.0, None] * 12), (5004, [float("nan")] * 24), (5005, [float("inf")] + [0.0] * 23)]
    rows += [(5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (5008, [1e30, 2e30]), (5009, [1e-30, 2e-30])]
    return rows


def as_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "vec_id as id", "1 as unit", "2 as times").repartition(3)


@pytest.mark.parametrize("tile", [1024, 16])
def test_links_against_brute_force(spark, vectors, monkeypatch, tile):
    monkeypatch.setattr(embedding_neighbours, "TILE", tile)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_neighbours.near_duplicates(as_frame(spark, vectors)).collect()}
    assert got == brute(vectors)


@pytest.mark.parametrize("tile", [1024, 16])
def test_dense_clusters_joined_by_a_few_links(spark, monkeypatch, tile):
    """The links between two clusters are among the nearest of neither end."""
    monkeypatch.setattr(embedding_neighbours, "TILE", tile)
    rng = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v)
    a, b = (unit(rng.standard_normal(64)) for _ in range(2))
    b = 0.94 * a + math.sqrt(1 - 0.94**2) * unit(b - (a @ b) * a)
    rows = [(2 * k + c if c < 2 else 2000 + k, near(centre, rng, 0.12)) for c, centre in enumerate((a, b, unit(rng.standard_normal(64)))) for k in range(300)]
    true = brute(rows)
    across = sum(n - 299 for i, (n, _) in true.items() if i < 1000)
    assert 0 < across < 3000 and {c for _, c in true.values()} == {0, 2000}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_neighbours.near_duplicates(as_frame(spark, rows)).collect()}
    assert got == true


def test_audit_asks_for_more_tables(spark, vectors, monkeypatch):
    """With far too few tables the audit notices, and further rounds find the rest."""
    monkeypatch.setattr(embedding_neighbours, "MEETING", 0.2)
    monkeypatch.setattr(embedding_neighbours, "ROUNDS", 40)
    monkeypatch.setattr(embedding_neighbours, "RECALL", 1.0)
    got = {r["vec_id"]: r["component_id"] for r in embedding_neighbours.near_duplicates(as_frame(spark, vectors)).collect()}
    assert got == {i: c for i, (_, c) in brute(vectors).items()}


def test_empty_and_repeated_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embedding_neighbours.near_duplicates(empty).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embedding_neighbours.near_duplicates(as_frame(spark, rows)).collect())
    assert got == [(0, 0, None), (1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_vector_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op2_embedding_neighbours(spark, sf_dir).collect()}
    assert got == brute(rows)


def article(page):
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(x for x in parts if x)


def test_page_query(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op9_html_extract(spark, sf_dir).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: article(h) for i, h in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_markup():
    page = (
        "<html><head><title>x</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>a<li>b</ul></nav>"
        '<div class="cookie-notice">We use</div><script>var t="</p><article>";</script><main><article><header><h1>T &amp; u</h1></header>'
        '<p>one <b>two<br>three</b><p class="ad">buy</p><p>fo\n ur &#233;<!-- no --></p><div id="comments"><p>cc</p></div><ul><li>x<li>y</ul>'
        "</article><aside>s</aside></main><form><p>f</p></form><footer>&copy; z</footer><p unclosed"
    )
    assert html_extract.main_text(html_extract.lines(page), []) == "T & u\n\none two three\n\nfo ur é\n\nx\n\ny"


@pytest.mark.parametrize(
    "block, text",
    [
        ('<p class="share-price">a</p>', "a"),
        ('<section id="social-history"><p>a</p></section>', "a"),
        ('<table class="related-work"><tr><td>a</table>', "a"),
        ('<p data-id="menu-1">a</p>', "a"),
        ('<p title="hidden gems" data-x=\'class="ad"\'>a</p>', "a"),
        ('<div class="article-header"><h1>a</h1></div><div class=header>b</div>', "a\n\nb"),
        ('<p class="lead ad-slot">a</p><div id="comment-list-2">b</div><p hidden>c</p><p CLASS=\'Cookie-Banner\'>d</p>', ""),
    ],
)
def test_blocks_inside_an_article(block, text):
    assert html_extract.main_text(html_extract.lines(f"<nav>n</nav><article>{block}</article>"), []) == text


def test_copies_are_not_differenced(spark):
    """Repeated rows and query strings of one path keep their texts; other neighbours still take the frame."""
    page = "<div>frame</div>" + "".join(f"<p>own {k}</p>" for k in range(9))
    other = "<div>frame</div><p>else</p>"
    rows = [(1, "http://h/a", page), (2, "http://h/a?x=1", page), (2, "http://h/a?x=1", page), (3, "http://i/a", page), (4, "http://i/a?x", page), (5, "http://i/b", other)]
    got = sorted((r["page_id"], r["text"].startswith("frame"), r["text"].count("own")) for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    assert got == [(1, True, 9), (2, True, 9), (2, True, 9), (3, True, 9), (4, False, 9), (5, False, 0)]


def test_differencing_decides_beside_an_article():
    """A headline before the article is the page's own; the site's name beside it is not. Without a frame in common the article is all."""
    page = "<nav>a</nav><div>site</div><div><h1>head {0}</h1></div><article><p>text {0}</p><p>same</p></article><div>by {0}</div><div>more</div><footer>z {1}</footer>"
    lines = [html_extract.lines(page.format(k, f)) for k, f in ((1, 1), (2, 2), (3, 1))]
    others = [html_extract.frame_lines(p) for p in lines]
    assert html_extract.main_text(lines[0], others[1]) == html_extract.main_text(lines[0], others[2]) == "head 1\n\ntext 1\n\nsame\n\nby 1"
    assert html_extract.main_text(lines[0], []) == html_extract.main_text(lines[0], ["else"]) == html_extract.main_text(lines[0], ["site", "more"]) == "text 1\n\nsame"


@pytest.mark.parametrize("parts", [1, 40])
def test_own_blocks_beside_articles_are_kept(spark, parts):
    """Frames are equal on a site without the pages being copies; copies and lone pages are left to the markup."""
    frame = "".join(f"<li>item {k}" for k in range(30))
    page = lambda k: f"<nav><ul>{frame}</ul></nav><div>site</div><div><h1>head {k}</h1></div><article><p>text {k}</p></article><footer>end</footer>"
    rows = [(k, f"http://h/{k:03}", page("<p>".join(f"{k}.{n}" for n in range(9)))) for k in range(12)]
    rows += [(20, "http://i/a", page(20)), (21, "http://i/a?x", page(20)), (22, "http://j/a", page(22))]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["page_id"]: r["text"].split("\n\n") for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    own = lambda k: [f"{k}.{n}" for n in range(1, 9)]
    assert {k: got[k] for k in range(12)} == {k: [f"head {k}.0", *own(k), f"text {k}.0", *own(k)] for k in range(12)}
    assert [got[k] for k in (20, 21, 22)] == [["text 20"], ["text 20"], ["text 22"]]


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html_extract.shared(a, b))
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in rest for i in found)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_differencing_does_not_depend_on_partitions(spark, parts):
    """Pages without a main element lose what the nearest URL has too, wherever partitions are cut."""
    rows = [(k, f"http://h{k % 3}.example/{'a' if k % 2 else 'b'}/{k:03}", f"<div>frame {k % 2}</div><p>own {k}</p><div>end</div>") for k in range(60)]
    rows += [(100, None, "<p>alone</p>"), (101, "http://single.example/x", "<p>only &lt;here&gt;</p>"), (102, "http://h0.example/zz", None), (103, "http://h0.example/zzz", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as path", "3 as page", "4 as part")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {k: f"own {k}" for k in range(60)} | {100: "alone", 101: "only <here>", 102: "", 103: ""}
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.extract(none).count() == 0
