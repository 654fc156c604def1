"""Access-log lines of seven formats, and of a user's own, as hit records.

Every parser is a projection of the column ``value``; a line that does not fit gives a row with a null
status, which parse_errors counts. Times keep the line's own wall clock. Missing numbers are 0.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The line formats.
COMBINED = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) ([^"]*?) \S*" (\d{3}) (\S+) "([^"]*)" "([^"]*)"'
COMMON = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) ([^"]*?) \S*" (\d{3}) (\S+)'
BALANCER = r'^\S+ (\S+) \S+ (\S+:\d+) \S+:\d+ [\d.-]+ [\d.-]+ [\d.-]+ (\d{3}) \d{3} \d+ (\d+) "(\S+) ([^ ]+) [^"]*" "([^"]*)"'
#: Header names that mean one field.
ALIASES = {
    "date": ("date", "timestamp", "datetime"),
    "time": ("time",),
    "status": ("sc-status", "status", "status_code"),
    "bytes": ("sc-bytes", "bytes", "response_bytes", "bytes_sent"),
    "path": ("cs-uri-stem", "uri", "uri_stem", "path", "url"),
    "query": ("cs-uri-query", "query_string", "query"),
    "user_agent": ("cs(user-agent)", "cs-user-agent", "user_agent", "user-agent", "useragent"),
    "referer": ("cs(referer)", "cs-referer", "referer", "referrer"),
    "ip": ("c-ip", "client-ip", "client_ip", "request_ip", "remote_ip", "remote_addr"),
    "method": ("cs-method", "method", "request_method"),
}
FORMATS = ("combined", "clf", "cloudfront", "cloudflare", "alb", "w3c")


def _number(c: Column, kind: str = "long") -> Column:
    return F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))


def _decoded(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("+"), F.lit(" ")), F.lit("%20"), F.lit(" "))
    return F.when(c == "-", "").otherwise(c)


def _record(ip, ts, method, path, status, size, referer=None, user_agent=None, seconds=None) -> list[Column]:
    none = F.lit("")
    return [ip.alias("ip"), ts.alias("ts"), method.alias("method"), path.alias("path"), status.alias("status"), _number(size).alias("bytes"), (none if referer is None else referer).alias("referer"), (none if user_agent is None else user_agent).alias("user_agent"), (F.lit(0.0) if seconds is None else seconds).alias("response_time")]


def _status(c: Column) -> Column:
    return c.try_cast("int")


def _apache(pattern: str, full: bool) -> list[Column]:
    g = lambda i: F.regexp_extract("value", pattern, i)
    ts = F.try_to_timestamp(F.substring(g(2), 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss"))
    return _record(g(1), ts, g(3), g(4), _status(g(5)), g(6), g(7) if full else None, g(8) if full else None)


def _cloudfront() -> list[Column]:
    p = F.split("value", "\t")
    g = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
    path = F.when(g(11) != "-", F.concat(g(7), F.lit("?"), g(11))).otherwise(g(7))
    return _record(g(4), F.try_to_timestamp(F.concat(g(0), F.lit(" "), g(1)), F.lit("yyyy-MM-dd HH:mm:ss")), g(5), path, F.when(F.size(p) >= 13, _status(g(8))), g(3), F.when(g(9) == "-", "").otherwise(g(9)), _decoded(g(10)))


def _cloudflare() -> list[Column]:
    j = F.from_json("value", "ClientIP string, ClientRequestMethod string, ClientRequestURI string, ClientRequestPath string, EdgeResponseStatus int, EdgeResponseBytes long, ClientRequestReferer string, ClientRequestUserAgent string, EdgeStartTimestamp long, EdgeEndTimestamp long")
    text = lambda n: F.coalesce(j[n], F.lit(""))
    start, end = j["EdgeStartTimestamp"], j["EdgeEndTimestamp"]
    ts = F.when(start > 10**15, F.timestamp_micros((start / 1000).cast("long"))).when(start > 0, F.timestamp_seconds(start))
    delta = F.when((end > start) & (start > 0), F.when((start > 10**15) | (end > 10**15), (end - start) / 1e9).otherwise((end - start).cast("double"))).otherwise(0.0)
    return _record(text("ClientIP"), ts, text("ClientRequestMethod"), F.when(text("ClientRequestURI") != "", text("ClientRequestURI")).otherwise(text("ClientRequestPath")), j["EdgeResponseStatus"], j["EdgeResponseBytes"], text("ClientRequestReferer"), text("ClientRequestUserAgent"), F.coalesce(delta, F.lit(0.0)))


def _balancer() -> list[Column]:
    g = lambda i: F.regexp_extract("value", BALANCER, i)
    path = F.when(F.startswith(g(6), F.lit("http")), F.regexp_replace(g(6), r"^[^/]*//[^/]*", "")).otherwise(g(6))
    ts = F.coalesce(F.try_to_timestamp(F.regexp_replace(g(1), "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.try_to_timestamp(F.regexp_replace(g(1), "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return _record(F.regexp_replace(g(2), r":\d+$", ""), ts, g(5), path, _status(g(3)), g(4), None, g(7))


def flexible_time(c: Column) -> Column:
    """Common layouts, then epoch seconds, milliseconds or nanoseconds."""
    n = c.try_cast("long")
    epoch = F.when(n > 10**15, F.timestamp_micros((n / 1000).cast("long"))).when(n > 10**11, F.timestamp_millis(n)).when(n > 0, F.timestamp_seconds(n))
    plain = F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", "")
    layouts = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(x)) for x in layouts], epoch)


def _headed(header: list[str], separator: str) -> list[Column]:
    """Fields by the header's names; several names may mean one field."""
    at = {n.strip().lower(): i for i, n in reversed(list(enumerate(header)))}
    quoted = separator == ","  # fields may be in quotation marks
    parts = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(header))), {"sep": ","}) if quoted else F.split("value", separator)

    def g(field: str) -> Column:
        i = next((at[n] for n in ALIASES[field] if n in at), None)
        return F.lit("") if i is None else F.coalesce(parts[f"c{i}"] if quoted else F.get(parts, F.lit(i)), F.lit(""))

    q = g("query")
    path = F.when((q != "") & (q != "-"), F.concat(g("path"), F.lit("?"), q)).otherwise(g("path"))
    ts = flexible_time(F.when(g("time") != "", F.concat(g("date"), F.lit(" "), g("time"))).otherwise(g("date")))
    return _record(g("ip"), ts, g("method"), path, _status(g("status")), g("bytes"), _decoded(g("referer")), _decoded(g("user_agent")))


def _custom(pattern: str) -> list[Column]:
    """A regular expression with named groups; names are the record's own, or their aliases."""
    names = {n.lower(): i for n, i in re.compile(pattern.replace("(?<", "(?P<")).groupindex.items()}
    java = pattern.replace("(?P<", "(?<")

    def g(field: str, *more: str) -> Column:
        i = next((names[n] for n in (field, *more, *[a.replace("-", "_") for a in ALIASES.get(field, ())]) if n in names), None)
        return F.lit("") if i is None else F.regexp_extract("value", java, i)

    stamp = g("timestamp", "time", "ts", "date")
    ts = F.coalesce(F.try_to_timestamp(F.substring(stamp, 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss")), flexible_time(stamp))
    return _record(g("ip"), ts, g("method"), g("path"), _status(g("status")), g("bytes"), g("referer"), g("user_agent"), _number(g("response_time"), "double"))


def parse(lines: DataFrame, kind: str, header: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Hit records of lines (value) of one format; blank lines and comments are skipped, and a byte-order mark is dropped."""
    clean = lines.withColumn("value", F.regexp_replace("value", "^﻿", "")).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    if pattern:
        return clean.select(*_custom(pattern))
    if header:
        clean = clean.where(F.lower("value") != "\t".join(header).lower()).where(F.lower("value") != ",".join(header).lower())
    by = {"combined": lambda: _apache(COMBINED, True), "clf": lambda: _apache(COMMON, False), "cloudflare": _cloudflare, "alb": _balancer, "cloudfront": lambda: _headed(header, "\t") if header else _cloudfront(), "csv": lambda: _headed(header or [], ","), "w3c": lambda: _headed(header or [], r"\s+")}
    return clean.select(*by[kind]())


def parse_errors(hits: DataFrame) -> int:
    return hits.where(F.col("status").isNull()).count()


def sniff(sample: list[str]) -> tuple[str, list[str] | None]:
    """(format, header) of a sample of lines: the format that most lines fit; W3C wins ties."""
    votes, header = dict.fromkeys(("w3c", *FORMATS), 0), None
    for line in sample:
        line = line.lstrip("﻿")
        if line.startswith("#Fields:"):
            header, votes["w3c"] = line[8:].split(), votes["w3c"] + 1
        elif not line.strip() or line.startswith("#"):
            continue
        elif line.lower().startswith(("date\t", "date,", "timestamp,", "timestamp\t")):
            header = re.split("[\t,]", line.strip())
            votes["cloudfront"] += 1
        elif line.startswith("{"):
            votes["cloudflare"] += 1
        elif re.match(COMBINED, line):
            votes["combined"] += 1
        elif re.match(COMMON, line):
            votes["clf"] += 1
        elif re.match(BALANCER, line):
            votes["alb"] += 1
        elif line.count("\t") >= 12 or (header and "\t" in line):
            votes["cloudfront"] += 1
        elif header:
            votes["w3c"] += 1
    best = max(votes, key=lambda k: votes[k])
    return ("csv" if best == "cloudfront" and header and any("," in x for x in sample[:1]) else best), header


def files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files under paths, patterns and folders included, as the file system lists them."""
    jvm, out = spark.sparkContext._jvm, []
    for path in [paths] if isinstance(paths, str) else paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in fs.globStatus(at) or ():
            inside = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
            out += [x.getPath().toString() for x in inside if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return sorted(out)


def formats(spark: SparkSession, paths: str | list[str], sample: int = 50, at_once: int = 16) -> tuple[dict[tuple, list[str]], list[str]]:
    """((format, header) -> files, files that cannot be read). Each file's first lines tell its own format; a look reads no more."""

    def look(path: str):
        try:
            return path, sniff([r.value for r in spark.read.text(path).limit(sample).collect()])
        except Exception:  # an unreadable file must not stop the others
            return path, None

    with ThreadPoolExecutor(at_once) as pool:
        seen = list(pool.map(look, files(spark, paths)))
    groups: dict[tuple, list[str]] = {}
    for path, found in seen:
        if found is not None:
            groups.setdefault((found[0], tuple(found[1] or ())), []).append(path)
    return groups, [path for path, found in seen if found is None]


def read(spark: SparkSession, paths: str | list[str], kind: str | None = None, pattern: str | None = None, sample: int = 50) -> DataFrame:
    """Log files, compressed or not, each in a format of its own unless one is given. Files that cannot be read are left out; it is an
    error if that is all of them."""
    if kind is not None or pattern is not None:
        return parse(spark.read.text(paths), kind or "combined", None, pattern)
    groups, bad = formats(spark, paths, sample)
    if not groups:
        raise FileNotFoundError(f"no log file can be read: {bad or paths}")
    return reduce(DataFrame.unionByName, [parse(spark.read.text(some), kind, list(header) or None) for (kind, header), some in groups.items()])
