import json

from pyspark.sql import functions as F

from tarnmill.functions import html as H
from tarnmill.functions import schema_org as J
from tarnmill.functions import urls as U
from tarnmill.operators import logs as L
from tarnmill.sources import log_lines, stores
from tarnmill.streaming import hits as S

COMBINED = '198.51.100.7 - - [11/Mar/2025:21:40:05 +0000] "GET /pricing HTTP/1.1" 200 5120 "https://ref.example.net" "Googlebot/2.1"'
TSV = "\t".join(["2025-03-11", "21:40:05", "IAD", "7331", "198.51.100.7", "GET", "host", "/pricing", "200", "-", "Googlebot/2.1", "-", "-", "x"])
JSON = json.dumps({"ClientIP": "198.51.100.7", "ClientRequestMethod": "GET", "ClientRequestURI": "/pricing", "EdgeResponseStatus": 200, "EdgeResponseBytes": 8000, "ClientRequestUserAgent": "Googlebot/2.1", "EdgeStartTimestamp": 1741729205000000000, "EdgeEndTimestamp": 1741729205050000000})
ALB = 'https 2025-03-11T21:40:05.000000Z app/x 198.51.100.7:443 10.0.0.1:80 0.0 0.1 0.0 200 200 100 7331 "GET https://shop.example.net:443/pricing HTTP/2.0" "Googlebot/2.1"'
HEADER = "date time c-ip cs-method cs-uri-stem sc-status sc-bytes cs(User-Agent) cs(Referer)".split()
W3C = "2025-03-11 21:40:05 198.51.100.7 GET /pricing 200 512 Googlebot/2.1+(x) -"


def one(spark, line, kind, **more):
    return log_lines.parse(spark.createDataFrame([(line,), ("",), ("# comment",)], "value string"), kind, **more).collect()


def test_formats(spark):
    for line, kind, size, more in ((COMBINED, "combined", 5120, {}), (COMBINED, "clf", 5120, {}), (TSV, "cloudfront", 7331, {}), (JSON, "cloudflare", 8000, {}), (ALB, "alb", 7331, {}), (W3C, "w3c", 512, {"header": HEADER})):
        (r,) = one(spark, line, kind, **more)
        assert (r.ip, r.method, r.path, r.status, r.bytes) == ("198.51.100.7", "GET", "/pricing", 200, size), kind
        assert r.ts.strftime("%Y-%m-%d %H:%M:%S") == "2025-03-11 21:40:05", kind
        assert kind == "clf" or r.user_agent.startswith("Googlebot/2.1"), kind
    assert abs(one(spark, JSON, "cloudflare")[0].response_time - 0.05) < 1e-9
    (r,) = one(spark, "1.2.3.4|/x|503", "combined", pattern=r"^(?P<ip>[^|]+)\|(?P<path>[^|]+)\|(?P<status>\d+)$")
    assert (r.ip, r.path, r.status) == ("1.2.3.4", "/x", 503)
    assert one(spark, "garbage", "combined")[0].status is None


def test_sniff():
    assert log_lines.sniff([COMBINED, COMBINED])[0] == "combined"
    assert log_lines.sniff([TSV])[0] == "cloudfront"
    assert log_lines.sniff([JSON])[0] == "cloudflare"
    assert log_lines.sniff([ALB])[0] == "alb"
    assert log_lines.sniff(["#Version: 1.0", "#Fields: " + " ".join(HEADER), W3C]) == ("w3c", HEADER)


def test_waste_classes(spark):
    want = {"/products?color=red&size=xl": "faceted_nav", "/page?p=10": "pagination", "/checkout?sid=abc123": "session_ids", "/search?q=test": "search", "/blog/2024/03/": "calendar", "/assets/style.css": "resources", "/api/v1/users": "api", "/tag/seo/": "taxonomy", "/pricing": ""}
    got = spark.createDataFrame([(p,) for p in want], "path string").select("path", L.waste_class(F.col("path")).alias("w")).collect()
    assert {r.path: r.w for r in got} == want


def test_document():
    page = """<html lang="en"><head><title> A  b </title><meta name="description" content="d"><link rel="canonical" href="/c">
    <script type="application/ld+json">{"@type": "Product"}</script><script>var x = "<a href='/no'>no</a>";</script></head>
    <body><nav><a href="/n">Nav</a></nav><main><h1>One</h1><p>two three <a href="https://o.org/x" rel="nofollow">here</a><img src="i.png"></main><div role="contentinfo"><a href="#top">t</a><a href="/f">F</a></div>"""
    d = H.document(page, "https://e.com/a/b")
    assert (d["title"], d["description"], d["canonical"], d["lang"], d["h1"]) == ("A b", "d", "https://e.com/c", "en", ["One"])
    assert d["internal_links"] == ["https://e.com/n", "https://e.com/f"] and d["external_links"] == ["https://o.org/x"]
    assert [a["place"] for a in d["anchors"]] == ["navigation", "content", "footer"]
    assert [a["generic"] for a in d["anchors"]] == [False, True, False] and d["anchors"][1]["nofollow"]
    assert d["images"] == [{"src": "https://e.com/a/i.png", "has_alt": False, "alt": "", "sized": False}]
    assert d["words"] == 7 and [r["type"] for r in J.validate(d["json_ld"][0])] == ["Product"]
    assert ("title", "A b", "") in H.render_diff(d, H.document("<p>x", "https://e.com/a/b"))


def test_schema_rules():
    good = {"@context": "https://schema.org", "@type": "Event", "name": "x", "startDate": "2024-01-02", "location": "y"}
    assert J.validate_object(good)["eligible"] and not J.validate_object({**good, "location": ""})["eligible"]
    assert J.validate("[]")[0]["issues"] == [("error", "invalid JSON")]
    assert [r["type"] for r in J.validate('{"@graph": [{"@type": "Person", "name": "a"}, {"@type": "WebPage"}]}')] == ["Person", "WebPage"]
    assert ("error", "question without name") in J.validate_object({"@type": "FAQPage", "mainEntity": [{}]})["issues"]


def test_robots():
    rules = U.robots_rules("User-agent: A\nUser-agent: b\nDisallow: /x # no\nAllow: /x/y\n\nUser-agent: *\nDisallow: /")
    assert rules == {"a": [(False, "/x"), (True, "/x/y")], "b": [(False, "/x"), (True, "/x/y")], "*": [(False, "/")]}
    assert U.robots_extras("User-agent: *\nCrawl-delay: 3\nSitemap: https://e/s.xml") == ({"*": 3.0}, ["https://e/s.xml"])


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 1, {"k": 1}), ("b", [], 2, None), ("a", ["z"], 3, None)], "url string, tags array<string>, seq int, m map<string,int>")
    kept = {r.url: r.seq for r in stores.latest(df).collect()}
    assert kept == {"a": 3, "b": 2}
    stores.write_pages(df, f"{tmp_path}/j", "json", "gzip")
    assert stores.read_pages(spark, f"{tmp_path}/j", df.schema).count() == 3
    stores.write_pages(df, f"{tmp_path}/c", "csv")
    assert sorted(r.tags or "" for r in spark.read.csv(f"{tmp_path}/c", header=True).collect()) == ["", "x|y", "z"]
    part, n = stores.page_range(df, 1, 5, "a")
    assert n == 2 and [r.seq for r in part.collect()] == [3]
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://e/1 </loc></url><url><loc>https://e/1</loc></url><url><loc>https://e/2</loc><priority>0.5</priority></url></urlset>")
    assert sorted(r.url for r in stores.read_sitemap(spark, f"{tmp_path}/s.xml").collect()) == ["https://e/1", "https://e/2"]


def test_stream_equals_batch(spark, tmp_path):
    lines = [COMBINED.replace("21:40", f"{h:02}:40").replace("/pricing", f"/p{h % 3}").replace("Googlebot", "Googlebot" if h % 2 else "Mozilla") for h in range(12)]
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.log").write_text("\n".join(lines[4 * i : 4 * i + 4]) + "\n")
    stream = S.hit_stream(spark, f"{tmp_path}/in", files=1)
    q = S.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = L.with_bot(log_lines.read(spark, f"{tmp_path}/in")).withColumn("seq", F.monotonically_increasing_id())
    assert {(r.bot, r.hits) for r in spark.table("daily").collect()} == {(r.bot, r.hits) for r in S.daily_counts(batch).collect()}
    q = stream.writeStream.foreachBatch(S.upsert_urls(f"{tmp_path}/urls")).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    merged = L.merged_url_stats(spark.read.parquet(f"{tmp_path}/urls/seq_of=*"))
    want = {(r.path, r.hits, r.bot_hits) for r in L.url_stats(batch).collect()}
    assert {(r.path, r.hits, r.bot_hits) for r in merged.collect()} == want
