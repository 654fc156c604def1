"""URL filters: rules first, then a path-template tree for what no rule covers.

A url's path becomes segments whose digit runs are written ``0`` (its *shape*); counts by host and
shape are all that the tree reads, so a host with a third of all urls is a few rows. Level by level,
a segment stays literal if it has enough of its parent's urls, else it becomes the wildcard ``*``:
that is where ids and slugs go. At every level siblings are merged that have the same set of templates
below and labelled shares that do not differ by a chi-square test; likeness is closed over chains, so the
branches of one component are judged together, under the least of their names. A parent has 1 / SHARE
literal children at most, and a wildcard, so its children are one small row. A template is rejected if its
smoothed labelled share, (blocked + PRIOR * WEIGHT) / (labelled + WEIGHT), reaches ``REJECT``; a
template without labelled urls has share PRIOR and is allowed. Labels are the rules' own verdicts.

Verdicts go back to urls by a join whose frequent templates are dealt to as many tasks as they fill.
Null urls, and those without ``://``, have empty host and path and one template of their own. Rows
that repeat count each; an empty table gives no rows, other columns are not read. A url of any length is
read whole. Of rules of one length the first listed wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rows

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LEVELS = 3
SUPPORT, SHARE = 5, 0.02
PRIOR, WEIGHT, REJECT = 0.25, 4.0, 0.5
CHI_SQUARE = 3.841  # one degree of freedom, 5 %
SPLIT, HOT_KEYS = 1 << 16, 10_000  # rows of one template to a task, or total / HOT_KEYS if that is more


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or where there is no ``://``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.coalesce(ascii_lower(F.regexp_extract(url, whole, 1)), F.lit("")), F.coalesce(F.regexp_extract(url, whole, 2), F.lit(""))


def by_rules(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _segments(path: Column) -> list[Column]:
    """LEVELS shaped segments; what lies deeper is joined into the last, an absent one is null."""
    every = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda s: s != "")
    head = [F.get(every, F.lit(k)) for k in range(LEVELS - 1)]
    tail = F.array_join(F.slice(every, LEVELS, F.greatest(F.size(every) - LEVELS + 1, F.lit(0))), "/")
    return [*head, F.nullif(tail, F.lit(""))]


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """left with right's other columns; nulls in the keys are equal."""
    r = right.select(*[F.col(c).alias(f"_{c}" if c in on else c) for c in right.columns])
    return left.join(r, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on)), how).drop(*[f"_{c}" for c in on])


def templates(shapes: DataFrame) -> DataFrame:
    """shapes (host, s0..s2, n, labelled, blocked) with g0..g2: each segment or its wildcard. Every level reads the one
    before several times, so each is written out; else plans double from level to level."""
    out = shapes
    for k in range(LEVELS):
        s, parent = f"s{k}", ["host", *[f"g{i}" for i in range(k)]]
        child = out.groupBy(*parent, s).agg(F.sum("n").alias("own"))
        total = child.groupBy(*parent).agg(F.sum("own").alias("all"))
        kept = _joined(child, total, parent, "inner").where((F.col("own") >= F.greatest(F.lit(SUPPORT), F.col("all") * SHARE)) & F.col(s).isNotNull())
        out = _joined(out, kept.select(*parent, s, F.lit(True).alias("kept")), [*parent, s])
        out = rows.stored(out.withColumn(f"g{k}", F.when(F.col("kept") | F.col(s).isNull(), F.col(s)).otherwise(F.lit("*"))).drop("kept"), "url-templates")
    return out


def alike(siblings: list[dict]) -> list[int]:
    """For each sibling (below, labelled, blocked) the place of the first of its component."""
    up = list(range(len(siblings)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(siblings):
        for j, b in enumerate(siblings[:i]):
            if a["below"] != b["below"] or not a["labelled"] or not b["labelled"]:
                continue
            n, blocked = a["labelled"] + b["labelled"], a["blocked"] + b["blocked"]
            cross = a["blocked"] * (b["labelled"] - b["blocked"]) - b["blocked"] * (a["labelled"] - a["blocked"])
            spread = a["labelled"] * b["labelled"] * blocked * (n - blocked)
            if not spread or n * cross * cross / spread < CHI_SQUARE:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(siblings))]


def merged(tree: DataFrame) -> DataFrame:
    """tree with b0..b2: at each level the branch of the segment's component."""
    out = tree
    for k in range(LEVELS):
        parent, g = ["host", *[f"b{i}" for i in range(k)]], f"g{k}"
        deeper = [F.coalesce(f"g{i}", F.lit("-")) for i in range(k + 1, LEVELS)]
        leaves = out.groupBy(*parent, *[f"g{i}" for i in range(k, LEVELS)]).agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        below = F.xxhash64(F.sort_array(F.collect_set(F.concat_ws("/", *deeper) if deeper else F.lit(""))))
        child = leaves.where(F.col(g).isNotNull()).groupBy(*parent, g).agg(below.alias("below"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        family = child.groupBy(*parent).agg(F.sort_array(F.collect_list(F.struct(F.col(g).alias("name"), "below", "labelled", "blocked"))).alias("family")).where(F.size("family") > 1)

        def fn(batch, parent=parent, g=g):
            names = {c: [] for c in (*parent, g, "branch")}
            for r in batch.to_pylist():
                for x, first in zip(r["family"], alike(r["family"]), strict=True):
                    if r["family"][first] is not x:
                        for c in parent:
                            names[c].append(r[c])
                        names[g].append(x["name"])
                        names["branch"].append(r["family"][first]["name"])
            return names if names["branch"] else None

        found = rows.map_batches(family, fn, ", ".join(f"{c} string" for c in (*parent, g, "branch")))
        out = rows.stored(_joined(out, found, [*parent, g]).withColumn(f"b{k}", F.coalesce("branch", g)).drop("branch"), "url-branches")
    return out


def judged(pages: DataFrame, rules=RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict and template of every row of pages."""
    host, path = parts(pages[url])
    p = pages.select(pages[page_id].cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("by", by_rules(F.col("host"), F.col("path"), rules))
    names = [f"s{k}" for k in range(LEVELS)]
    p = p.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("ruled"), *[s.alias(n) for s, n in zip(_segments(F.col("path")), names, strict=True)])
    shapes = p.groupBy("host", *names).agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    tree = merged(templates(rows.stored(shapes, "url-shapes")))
    branch = ["host", *[f"b{k}" for k in range(LEVELS)]]
    share = (F.sum("blocked") + PRIOR * WEIGHT) / (F.sum("labelled") + WEIGHT)
    tree = _joined(tree, tree.groupBy(*branch).agg(F.when(share >= REJECT, "block").otherwise("allow").alias("judged")), branch)
    key = lambda *c: F.concat_ws("\x01", *[F.coalesce(x, F.lit("\x02")) for x in c])
    found = tree.select(key(F.col("host"), *map(F.col, names)).alias("_key"), F.concat(F.lit("/"), F.concat_ws("/", "g0", "g1", "g2")).alias("template"), "judged", "n")
    found = rows.stored(found, "url-verdicts")
    unit = max(SPLIT, -(-found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_KEYS))
    hot = found.where(F.col("n") > unit).select(F.col("_key").alias("_hot"), F.ceil(F.col("n") / unit).cast("int").alias("_parts"))  # HOT_KEYS rows at most
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / unit).cast("int") - 1)))
    p = p.withColumn("key", key(F.col("host"), *map(F.col, names))).join(F.broadcast(hot), F.col("key") == F.col("_hot"), "left")
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.coalesce("_parts", F.lit(1))).cast("int"))
    out = p.join(found, (F.col("key") == F.col("_key")) & (F.col("salt") == F.col("_salt")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged", F.lit("allow")).alias("verdict"), "template")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
