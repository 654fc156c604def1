"""Page records in JSON lines, CSV and Parquet; upserts; sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import frontier_form, is_internal
from ..operators.pages import indexability


LINE_BYTES = 10 * 1024 * 1024
#: Tables of a page store, a Parquet folder each.
TABLES = {
    "pages": "url string, data string, status_code int, crawled_at timestamp, seq long",
    "queue": "url string, depth int, referrer string, status string, requeues int",
    "crawl_meta": "key string, value string",
    "cache_headers": "url string, etag string, last_modified string, seq long",
    "page_html": "url string, source_html string, rendered_html string, seq long",
    "content_hashes": "url string, hash string, seq long",
    "page_index": "url string, status_code int, indexable boolean, canonical string, depth int, inlinks int, word_count long, title string, has_noindex boolean, is_redirect boolean",
}


def create_store(spark: SparkSession, root: str) -> None:
    """An empty folder for each table that is not there yet."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def read_pages(spark: SparkSession, path: str, schema: T.StructType | str, heavy: tuple[str, ...] = ("bodyText", "resources"), longest: int = LINE_BYTES) -> DataFrame:
    """JSON lines, compressed or not; blank lines and those of over ``longest`` bytes are skipped and heavy columns dropped."""
    lines = spark.read.text(path).where((F.octet_length("value") <= longest) & (F.trim("value") != ""))
    df = lines.select(F.from_json("value", schema).alias("x")).select("x.*")
    return df.drop(*[c for c in heavy if c in df.columns])


def page_index(p: DataFrame) -> DataFrame:
    """The narrow table that merges and lists read: one row a page, null texts empty."""
    i = indexability(p)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    noindex = F.contains(F.lower(F.concat_ws(" ", "meta_robots", "x_robots")), F.lit("noindex"))
    return i.select("url", "status_code", "indexable", text("canonical"), "depth", "inlinks", "word_count", text("title"), noindex.alias("has_noindex"), (F.col("status_code").between(300, 399) | (F.col("final_url") != F.col("url"))).alias("is_redirect"))


def lookup(index: DataFrame, urls: DataFrame | list[str]) -> DataFrame:
    """Rows of the given urls: a short list goes into the scan's filter, a table (url) is joined."""
    return index.where(F.col("url").isin(urls)) if isinstance(urls, list) else index.join(urls.select("url").distinct(), "url", "left_semi")


def edges(p: DataFrame) -> DataFrame:
    """src, dst of internal links; no other column of the pages is read."""
    return p.select(F.col("url").alias("src"), F.explode("internal_links").alias("dst"))


def out_links(p: DataFrame, url: str) -> DataFrame:
    return edges(p.where(F.col("url") == url)).select("dst")


def page_html(store: DataFrame, url: str) -> DataFrame:
    """Source and rendered markup of one page, as written last."""
    return latest(store.where(F.col("url") == url)).select("source_html", "rendered_html")


def cache_entries(answers: DataFrame) -> DataFrame:
    """answers (url, etag, last_modified, seq) -> the last entry of each url that has either."""
    some = answers.where((F.coalesce("etag", F.lit("")) != "") | (F.coalesce("last_modified", F.lit("")) != ""))
    return latest(some).select("url", F.coalesce("etag", F.lit("")).alias("etag"), F.coalesce("last_modified", F.lit("")).alias("last_modified"))


def revalidated(answers: DataFrame, cache: DataFrame, previous: DataFrame) -> DataFrame:
    """url, state, content_hash of answers (url, status_code, content_hash) to conditional requests: 304 keeps the page of the crawl
    before (url, content_hash), if there was an entry to ask with; else a hash tells new, unchanged and changed pages."""
    c = cache.select(F.col("url").alias("_c"))
    p = previous.select(F.col("url").alias("_u"), F.col("content_hash").alias("_h"))
    both = answers.join(c, F.col("url") == F.col("_c"), "left").join(p, F.col("url") == F.col("_u"), "left")
    kept = (F.col("status_code") == 304) & F.col("_c").isNotNull() & F.col("_h").isNotNull()
    state = F.when(kept, "not-modified").when(F.col("_h").isNull(), "new").when(F.col("_h") == F.col("content_hash"), "unchanged").otherwise("changed")
    return both.select("url", state.alias("state"), F.when(kept, F.col("_h")).otherwise(F.col("content_hash")).alias("content_hash"))


def write_pages(df: DataFrame, path: str, form: str = "json", compression: str = "none", mode: str = "overwrite") -> None:
    """JSON lines, CSV with a header (nested columns joined or written as JSON) or Parquet."""
    if form == "csv":
        df = flat(df)
    w = df.write.mode(mode).option("compression", compression if form != "parquet" or compression != "none" else "zstd")
    {"json": w.json, "csv": w.option("header", True).csv, "parquet": w.parquet}[form](path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays of strings joined by '|', other nested columns as JSON."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.concat_ws("|", c)
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def latest(df: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def page_range(df: DataFrame, offset: int, limit: int, search: str = "", order: str = "seq") -> tuple[DataFrame, int]:
    """A page of rows whose url contains ``search``, and the number of all of them."""
    found = df.where(F.contains("url", F.lit(search)))
    return found.orderBy(order, "url").offset(offset).limit(limit), found.count()


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """url, lastmod, priority of <url> entries of sitemap files, compressed or not."""
    df = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string, priority double").load(path)
    return df.select(F.trim("loc").alias("url"), "lastmod", "priority").dropDuplicates(["url"])


def sitemap_files(spark: SparkSession, paths: list[str], locate, deepest: int = 3) -> list[str]:
    """The files that hold urls: of index files those they name, down to ``deepest`` levels. locate(loc) gives a named file's path, or
    None. Only the names of index files reach the driver."""
    found, todo, seen = [], list(paths), set(paths)
    for _ in range(deepest + 1):
        named = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(todo).select(F.trim("loc").alias("loc"), F.input_file_name().alias("file")).collect() if todo else []
        indexes = {r.file.rsplit("/", 1)[-1] for r in named if r.loc}
        found += [p for p in todo if p.rsplit("/", 1)[-1] not in indexes]
        todo = [p for r in named if r.loc and (p := locate(r.loc)) and p not in seen and not seen.add(p)]
        if not todo:
            break
    return found


def discovered(urls: DataFrame, seed: str) -> DataFrame:
    """Sitemap urls (url) of the seed's host, one of each normal form: the least."""
    own = urls.where(is_internal(F.col("url"), seed))
    return own.groupBy(frontier_form(F.col("url")).alias("key")).agg(F.min("url").alias("url")).select("url")


SITEMAP_URLS = 50_000


def sitemap_xml(urls: DataFrame) -> DataFrame:
    """urls (url, file) -> one <url> element a row, to be written as text per file."""
    x = F.col("url")
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(raw), F.lit(escaped))
    return urls.select("file", F.concat(F.lit("<url><loc>"), x, F.lit("</loc></url>")).alias("value"))


def capped_sitemap(urls: DataFrame, most: int = SITEMAP_URLS) -> tuple[DataFrame, bool]:
    """The first ``most`` urls of a single sitemap file, and whether some are cut."""
    first = urls.orderBy("url").limit(most)
    return sitemap_xml(first.withColumn("file", F.lit(1).cast("long"))), urls.limit(most + 1).count() > most


def sitemap_index(files: DataFrame, base: str) -> DataFrame:
    """One <sitemap> element for each file (file) of urls: the index."""
    return files.select("file").distinct().select("file", F.concat(F.lit(f"<sitemap><loc>{base.rstrip('/')}/sitemap-"), F.col("file").cast("string"), F.lit(".xml</loc></sitemap>")).alias("value"))


def replace_pair(df: DataFrame, path: str, log_id: str, crawl_id: str) -> None:
    """Merge rows of one (log, crawl) pair; other pairs' partitions stay."""
    out = df.withColumns({"log_id": F.lit(log_id), "crawl_id": F.lit(crawl_id)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_id", "crawl_id").parquet(path)
