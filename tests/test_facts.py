"""Document trees, facts, exports, stores, per-file log formats and the entry file without its training-data folder."""

import gzip
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tarnmill.functions import dom
from tarnmill.functions import html as H
from tarnmill.functions import signals as S
from tarnmill.functions import urls as U
from tarnmill.functions.stopwords import stopwords
from tarnmill.operators import graph as G
from tarnmill.operators import simhash
from tarnmill.sources import log_lines, stores

PAGE = '<html><body><div id=main class="a b"><p>one<p>two <b>bold</b></p><ul><li>x<li data-k="v-1">y</ul><table><tr><td>1<td>2<tr><td>3</table></div><p class=b>three</body></html>'


@pytest.mark.parametrize(
    "selector, texts",
    [("p", ["one", "two bold", "three"]), ("#main > p", ["one", "two bold"]), (".a.b b", ["bold"]), ("li[data-k]", ["y"]), ('li[data-k^="v-"]', ["y"]), ("li:first-child", ["x"]), ("li:nth-child(2), b", ["bold", "y"]), ("p + p", ["two bold"]), ("p ~ ul li:last-child", ["y"]), ("td:not(:first-child)", ["2"]), ("div p.b", []), ("*[class~=b] b", ["bold"])],
)
def test_selectors(selector, texts):
    assert [n.words() for n in dom.parse(PAGE).select(selector)] == texts


def test_selector_errors():
    for bad in ("", "p >", "p[", "p::x", ","):
        with pytest.raises(ValueError):
            dom.compiled(bad)
    assert H.extraction_rule("a:css:p > b") == ("a", "p > b") and H.extraction_rule("a:p:first-child") == ("a", "p:first-child")
    with pytest.raises(ValueError):
        H.extraction_rule("no rule")


def test_facts():
    d = H.document('<script type="application/ld+json">[1</script><div itemscope itemtype="https://schema.org/Thing"><i itemscope itemtype="x/Y"></i></div><meta name=author content=" Ann "><time datetime="2024-02-03">', "https://e.com/")
    assert [(s["type"], s["format"]) for s in d["structured"]] == [("Unknown", "json-ld"), ("Thing", "microdata")]
    assert d["author"] == "Ann" and d["dates"]["times"] == ["2024-02-03"] and d["words"] == 0
    assert H.document("<body>written by: John Smith</body>", "https://e.com/")["author"] == "John Smith"
    assert H.document('<body><div id="root"></div><script>x</script>', "https://e.com/")["spa"]
    assert not H.document('<body><div id="root">' + "word " * 60, "https://e.com/")["spa"]
    assert H.document("<p>x", "https://e.com/", {"Strict-Transport-Security": "1"})["security"] == {"https": True, "hsts": True, "frame_options": False, "csp": False}
    assert H.document(None, "")["title"] == "" and H.document("<a><b><c>" * 3000, "https://e.com/")["words"] == 0
    assert H.plain(" See More ") and H.plain("") and not H.plain("see more of it")


def test_dates_and_marks(spark):
    made = [("2024-03-01T10:00:00+02:00",), ("March 3, 2024",), ("2024/03/04",), ("nonsense",), ("",), (None,)]
    got = [r.d for r in spark.createDataFrame(made, "t string").select(S.parsed_date(F.col("t")).alias("d")).collect()]
    assert [str(x)[:10] if x else None for x in got] == ["2024-03-01", "2024-03-03", "2024-03-04", None, None, None]
    pad = "x" * (2 * 1024 * 1024 + 10)
    pages = [("<title>" + pad,), (pad + "<H1>",), ('<a href="a">' + pad + '<a href="b">',), ("<h1>",)]
    got = [r.m for r in spark.createDataFrame(pages, "h string").select(H.truncation_markers(F.col("h")).alias("m")).collect()]
    assert got == [[], ["h1 (at 2.0MB)"], ["last internal link (at 2.0MB)"], []]


def test_template_by_types(spark):
    c = lambda x: F.lit(x)
    t = lambda types, ads: U.template(c("https://e.com/x"), c("h"), c(50), c(1), c(1), c(0), c(0), c(0), c(0), F.array(*map(F.lit, types)).cast("array<string>"), None, c(0), c(ads))
    row = spark.range(1).select(t(["Product", "Offer"], 0).alias("a"), t(["NewsArticle"], 0).alias("b"), t([], 2).alias("c"), t([], -1).alias("d"), t([], 0).alias("e")).first()
    assert tuple(row) == ("product", "article", "ad_detail", "product", "other")


def test_words_of_a_language():
    assert {"the", "loading"} <= set(stopwords()) and {"the", "für", "loading"} <= set(stopwords("de")) and stopwords("xx") == stopwords()


def test_every_source_sampled_equals_the_whole(spark):
    import random

    r = random.Random(2)
    nodes = spark.createDataFrame([(i,) for i in range(25)], "id long")
    links = {(a, b) for a, b in ((r.randrange(25), r.randrange(24)) for _ in range(60)) if a != b}
    edges = spark.createDataFrame(sorted(links), "src long, dst long")
    whole = {x.id: (x.betweenness, x.closeness) for x in G.centralities(nodes, edges).collect()}
    sampled = {x.id: (x.betweenness, x.closeness) for x in G.sampled_centralities(nodes, edges, 25, at_once=10).collect()}
    assert sampled.keys() == whole.keys()
    for i, (b, c) in whole.items():
        assert abs(sampled[i][0] - b) < 2e-6 and sampled[i][1] == c
    few = [x for x in G.sampled_centralities(nodes, edges, 6).collect() if x.closeness is not None]
    assert len(few) == 6 and all(whole[x.id][1] == x.closeness for x in few)


def test_keys_hold_few():
    for n in (10, 1 << 21, 1 << 27):
        every = simhash.near_keys(n)
        assert all(sum(size for _, size in runs) >= min(16, 14 + n.bit_length() // 8) for runs in every)


def test_log_files_of_several_formats(spark, tmp_path):
    combined = '203.0.113.9 - - [02/Feb/2025:10:00:00 +0000] "GET /one HTTP/1.1" 200 10 "-" "curl/8"\n'
    (tmp_path / "a.log").write_text(combined * 3)
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("#Fields: date time cs-uri-stem sc-status sc-bytes\n" + "2025-02-02 10:00:01 /two 404 7\n" * 2)
    (tmp_path / "c.log").write_text("#Fields: sc-status cs-uri-stem date time\n503 /three 2025-02-02 10:00:02\n")
    (tmp_path / "_hidden").write_text("x\n")
    got = sorted((r.path, r.status) for r in log_lines.read(spark, str(tmp_path)).collect())
    assert got == [("/one", 200)] * 3 + [("/three", 503)] + [("/two", 404)] * 2
    with pytest.raises(FileNotFoundError):
        log_lines.read(spark, f"{tmp_path}/absent*")


def test_sitemap_indexes(spark, tmp_path):
    (tmp_path / "index.xml").write_text("<sitemapindex><sitemap><loc> https://e.com/a.xml </loc></sitemap><sitemap><loc>https://e.com/deep.xml</loc></sitemap></sitemapindex>")
    (tmp_path / "deep.xml").write_text("<sitemapindex><sitemap><loc>https://e.com/b.xml</loc></sitemap><sitemap><loc>https://e.com/index.xml</loc></sitemap></sitemapindex>")
    for name in "ab":
        (tmp_path / f"{name}.xml").write_text(f"<urlset><url><loc>https://e.com/{name}</loc></url><url><loc>https://other.com/x</loc></url><url><loc>https://e.com/{name}#top</loc></url></urlset>")
    files = stores.sitemap_files(spark, [f"{tmp_path}/index.xml"], lambda loc: f"{tmp_path}/{loc.rsplit('/', 1)[-1]}")
    assert sorted(f.rsplit("/", 1)[-1] for f in files) == ["a.xml", "b.xml"]
    urls = stores.discovered(spark.read.format("xml").option("rowTag", "url").schema("loc string").load(files).select(F.col("loc").alias("url")), "https://e.com/")
    assert sorted(r.url for r in urls.collect()) == ["https://e.com/a", "https://e.com/b"]
    xml, cut = stores.capped_sitemap(urls, 1)
    assert cut and xml.count() == 1 and not stores.capped_sitemap(urls, 2)[1]


def test_stores_and_long_lines(spark, tmp_path):
    stores.create_store(spark, f"{tmp_path}/s")
    stores.create_store(spark, f"{tmp_path}/s")  # what is there stays
    assert spark.read.parquet(f"{tmp_path}/s/page_index").columns[0] == "url"
    (tmp_path / "p.jsonl").write_text('{"url": "a", "bodyText": "x"}\n\n{"url": "' + "b" * 500 + '"}\n')
    got = stores.read_pages(spark, f"{tmp_path}/p.jsonl", "url string, bodyText string", longest=100)
    assert [r.url for r in got.collect()] == ["a"] and got.columns == ["url"]
    html = spark.createDataFrame([("u", "old", "r", 1), ("u", "new", None, 2), ("v", "x", "y", 3)], "url string, source_html string, rendered_html string, seq long")
    assert [tuple(r) for r in stores.page_html(html, "u").collect()] == [("new", None)]
    links = spark.createDataFrame([("u", ["a", "b"]), ("v", [])], "url string, internal_links array<string>")
    assert sorted(r.dst for r in stores.out_links(links, "u").collect()) == ["a", "b"]


def test_link_intelligence(spark):
    pages = spark.createDataFrame([(k, f"https://e.com/{k}" if k else "https://e.com/", f"https://e.com/{k}" if k else "https://e.com/", k % 3, 200, float(k)) for k in range(8)], "k long, url string, final_url string, depth int, status_code int, page_rank double")
    links = spark.createDataFrame([(f"https://e.com/{a or ''}", f"https://e.com/{b or ''}", True) for a, b in ((0, 1), (0, 2), (1, 3), (3, 4), (4, 5), (5, 6), (2, 0))], "src string, dst string, internal boolean")
    out = G.intelligence(pages, links, "https://www.e.com")
    assert {r.id: r.depth for r in out["depths"].collect()}[6] == 5
    assert {r.id for r in out["near_orphans"].collect()} >= {6} and out["leaders"].where("kind = 'bridge'").first().id == 3
    assert G.intelligence(pages, links, "https://e.com/", centrality=False)["centralities"] is None
    assert out["suggestions"].where("source = target").count() == 0


def test_entry_without_its_imports():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as E; q = E.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q), len(E.oracle_sql()))"
    n, some, sql = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(n) >= 190 and some == "False" and int(sql) >= 190
