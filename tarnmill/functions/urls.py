"""URL expressions: pieces, normal forms, issues, template scores, robots rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid")
EXTENSIONS = ("html", "htm", "php", "asp", "aspx", "jsp", "cgi", "xml", "json", "pdf", "js", "css")

_ALL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _ALL, 1))


def authority(u: Column) -> Column:
    return F.regexp_extract(u, _ALL, 2)


def hostname(u: Column) -> Column:
    return F.regexp_replace(F.lower(authority(u)), ":[0-9]*$", "")


def port(u: Column) -> Column:
    return F.regexp_extract(authority(u), ":([0-9]+)$", 1)


def raw_path(u: Column) -> Column:
    return F.regexp_extract(u, _ALL, 3)


def query(u: Column) -> Column:
    return F.regexp_extract(u, _ALL, 4)


def fragment(u: Column) -> Column:
    return F.regexp_extract(u, _ALL, 5)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def parameters(q: Column) -> Column:
    """Distinct names of the query's parameters."""
    return F.array_distinct(F.filter(F.transform(F.split(q, "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1))), lambda n: n != ""))


def extension(u: Column) -> Column:
    """The last segment's extension, if it is a common one."""
    e = F.regexp_extract(raw_path(u), r"\.([^./]+)/*$", 1)
    return F.when(F.lower(e).isin(*EXTENSIONS), e).otherwise("")


def decoded_path(u: Column) -> Column:
    """Percent-decoded path; a plus sign stays one, and what cannot be decoded stays as it is."""
    p = raw_path(u)
    p = F.when(p == "", "/").otherwise(p)
    return F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)


def path_and_query(u: Column) -> Column:
    q = query(u)
    return F.concat(decoded_path(u), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def frontier_form(u: Column) -> Column:
    """http(s) only, else null: no fragment, no default port, '/' for an empty path, no trailing slash, sorted query."""
    s, h, p = scheme(u), F.lower(authority(u)), raw_path(u)
    h = F.when(s == "http", F.regexp_replace(h, ":80$", "")).otherwise(F.regexp_replace(h, ":443$", ""))
    p = F.when(F.length(p) <= 1, F.lit("/")).otherwise(F.rtrim(p, F.lit("/")))
    q = F.array_join(F.array_sort(F.filter(F.split(query(u), "&"), lambda x: x != "")), "&")
    return F.when(s.isin("http", "https"), F.concat(s, F.lit("://"), h, F.when(p == "", "/").otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def comparison_form(u: Column) -> Column:
    """Host without www., path without trailing slash, sorted query."""
    p = raw_path(u)
    q = F.array_join(F.array_sort(F.filter(F.split(query(u), "&"), lambda x: x != "")), "&")
    return F.concat(F.regexp_replace(hostname(u), r"^www\.", ""), F.when(F.length(p) <= 1, F.lit("/")).otherwise(F.rtrim(p, F.lit("/"))), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def without_slash(u: Column) -> Column:
    """One trailing slash less."""
    return F.regexp_replace(u, "(.)/$", "$1")


def metric_key(u: Column) -> Column:
    """Key of search metrics: lower case, no fragment, no trailing slash."""
    return F.rtrim(F.regexp_replace(F.lower(u), "#.*$", ""), F.lit("/"))


def path_key(u: Column) -> Column:
    """Key of session metrics: lower-cased decoded path without its trailing slash."""
    p = F.lower(decoded_path(u))
    return F.when(F.length(p) > 1, F.rtrim(p, F.lit("/"))).otherwise(p)


def issues(u: Column) -> Column:
    """Array of the url's issues, in a fixed order."""
    p = decoded_path(u)
    tests = (
        ("uppercase-in-path", p.rlike("[A-Z]")),
        ("spaces-in-url", F.contains(p, F.lit(" ")) | F.contains(p, F.lit("%20"))),
        ("underscores-in-path", F.contains(p, F.lit("_"))),
        ("double-slashes", F.contains(p, F.lit("//"))),
        ("url-too-long", F.octet_length(u) > 200),
        ("tracking-parameters", F.arrays_overlap(parameters(query(u)), F.array(*map(F.lit, TRACKING)))),
        ("deep-path", F.size(F.split(F.trim(p, F.lit("/")), "/")) > 5),
    )
    return F.array_compact(F.array(*[F.when(t, name) for name, t in tests]))


#: What in a url speaks for a page type, and by how much. Ties go to the earlier type.
TEMPLATES = (
    ("listing", r"(?i)/categor|/collections?/|/shop/|/archive|/tags?/|/browse|/listings?/|/page/\d+|\?page=\d+|/classified|/results/|/strona-\d+|/pagina-\d+|/seite-\d+", 3),
    ("listing", r"(?i)[?&](sort|order|filter|price|brand|make|category)=", 2),
    ("product", r"(?i)/products?/|/items?/|/p/|/pd/|/sku/|/goods/|/products/[^/]+$", 3),
    ("ad_detail", r"(?i)/(oferta|offer|annonce|anuncio|oglas|ilan|inserat)/[^/?]+|/d/oferta/|/marketplace/item/|/(itm|item|listing)/[^/]*-?\d{5,}|/classified/[^/?]+", 3),
    ("article", r"(?i)/blog/|/articles?/|/posts?/|/news/|/stories/|/journal/|/magazine/|/editorial/|/\d{4}/\d{2}/", 3),
    ("legal", r"(?i)/privacy|/terms|/tos|/legal|/disclaimer|/cookie|/gdpr|/imprint|/impressum|/agb|/datenschutz|/conditions|/compliance|/policy|/terms-of-service|/privacy-policy", 3),
    ("contact", r"(?i)/contacts?/|/contacto/|/kontakt|/get-in-touch|/reach-us|/support|/help|/feedback", 3),
    ("faq", r"(?i)/faqs?/|/frequently-asked|/help-center|/knowledge-base|/kb/|/questions", 3),
    ("search", r"(?i)/search|/results|\?q=|\?query=|\?search=|\?s=|\?keyword=", 3),
    ("login", r"(?i)/login|/signin|/sign-in|/log-in|/register|/signup|/sign-up|/auth|/authenticate|/account/login|/my-account", 3),
)
#: What in the first heading does.
HEADINGS = (
    ("faq", r"(?i)\b(faq|frequently\s+asked|questions)\b", 3),
    ("contact", r"(?i)\b(contact|get\s+in\s+touch|reach\s+us)\b", 3),
    ("login", r"(?i)\b(login|log\s+in|sign\s+in|register|sign\s+up|create\s+account)\b", 3),
    ("search", r"(?i)\b(search\s+results?|results?\s+for)\b", 3),
    ("legal", r"(?i)\b(privacy|terms|legal|disclaimer|cookie)\b", 2),
)
#: What in the types of structured data does.
SCHEMA_TYPES = {
    "product": (("product", "offer", "aggregateoffer", "productgroup"), 3),
    "ad_detail": (("vehicle", "car", "realestatelisting", "jobposting"), 3),
    "ad_detail ": (("apartment", "singlefamilyresidence", "house"), 2),
    "article": (("article", "newsarticle", "blogposting", "techarticle"), 3),
    "faq": (("faqpage", "qapage", "question"), 3),
    "search": (("searchresultspage",), 3),
    "listing": (("collectionpage", "itemlist"), 3),
    "contact": (("contactpage",), 3),
}
ORDER = ("homepage", "listing", "product", "ad_detail", "article", "legal", "contact", "faq", "search", "login")


def is_homepage(u: Column) -> Column:
    return raw_path(u).isin("", "/") & (query(u) == "")


def template(u: Column, h1: Column, words: Column, depth: Column, h1_count: Column, h2_count: Column, internal: Column, external: Column, images: Column, types: Column | None = None, og_type: Column | None = None, listing_signals: Column | None = None, ad_signals: Column | None = None) -> Column:
    """Page type by additive scores; under 2 points it is 'other'. types are those of structured data, each of which counts."""
    point = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    rules: dict[str, list[Column]] = {t: [F.lit(0)] for t in ORDER}
    for name, pattern, n in TEMPLATES:
        rules[name].append(point(u.rlike(pattern), n))
    for name, pattern, n in HEADINGS:
        rules[name].append(point(h1.rlike(pattern), n))
    rules["article"] += [F.when(words > 800, 2).when(words > 400, 1).otherwise(0), point((external > 3) & (words > 500), 1), point((h1_count == 1) & (h2_count >= 3), 2)]
    rules["listing"] += [point((words < 300) & (internal > 15), 2), F.when(internal > 30, 2).when(internal > 15, 1).otherwise(0), point((internal > 20) & (words > 0) & (words < internal * 30), 2)]
    rules["homepage"].append(point(internal > 30, 1))
    rules["product"].append(point(words.between(100, 600) & (images >= 2), 1))
    rules["ad_detail"].append(point(words.between(100, 800) & (images >= 5), 1))
    rules["legal"].append(point((internal < 5) & (words > 200), 1))
    rules["faq"].append(point(h2_count >= 5, 1))
    for name in ("login", "search"):
        rules[name].append(point((words < 100) & (depth > 1), 1))
    if types is not None:
        for name, (kinds, n) in SCHEMA_TYPES.items():
            hits = [F.size(F.array_compact(F.transform(types, lambda t: F.when(F.lower(t) == kind, 1)))) for kind in kinds]  # noqa: B023  called at once
            rules[name.strip()].append(reduce(lambda a, b: a + b, hits) * n)
    if og_type is not None:
        rules["article"].append(point(F.lower(og_type).isin("article", "blog"), 2))
        rules["product"].append(point(F.lower(og_type).isin("product", "product.item"), 2))
        rules["homepage"].append(point((F.lower(og_type) == "website") & (depth == 0), 1))
    if listing_signals is not None:
        rules["listing"].append(point(listing_signals >= 1, 3))
    if ad_signals is not None:
        rules["ad_detail"].append(F.when(ad_signals > 0, 3).when(ad_signals < 0, -2).otherwise(0))
        rules["product"].append(point(ad_signals < 0, 3))
    best = F.array_max(F.array(*[F.struct(reduce(lambda a, b: a + b, rules[t]).alias("n"), F.lit(-i).alias("place"), F.lit(t).alias("t")) for i, t in enumerate(ORDER)]))
    return F.when(is_homepage(u), "homepage").when(best["n"] < 2, "other").otherwise(best["t"])


def robots_rules(text: str) -> dict[str, list[tuple[bool, str]]]:
    """agent -> rules (allow, path) of a robots.txt; agents in a row share what follows."""
    rules: dict[str, list[tuple[bool, str]]] = {}
    agents: list[str] = []
    fresh = False
    for line in text.splitlines():
        name, _, value = line.strip().partition(":")
        name, value = name.strip().lower(), value.split("#")[0].strip()
        if not name or name.startswith("#") or not value:
            continue
        if name == "user-agent":
            agents = [*(agents if fresh else []), value.lower()]
            fresh = True
            continue
        fresh = False
        if name in ("allow", "disallow"):
            for a in agents:
                rules.setdefault(a, []).append((name == "allow", value))
    return rules


def robots_extras(text: str) -> tuple[dict[str, float], list[str]]:
    """(crawl delay by agent, sitemaps)."""
    delays, maps, agents, fresh = {}, [], [], False
    for line in text.splitlines():
        name, _, value = line.strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            agents, fresh = [*(agents if fresh else []), value.lower()], True
            continue
        fresh = False
        if name == "crawl-delay":
            delays |= dict.fromkeys(agents, float(value))
        elif name == "sitemap":
            maps.append(value)
    return delays, maps


def robots_allowed(u: Column, text: str, agent: str) -> Column:
    """Longest prefix wins, the first of one length; the agent's own rules, else those for ``*``; without a match allowed."""
    p, rules = decoded_path(u), robots_rules(text)

    def decide(of: str, otherwise: Column) -> Column:
        out = otherwise
        ranked = sorted(enumerate(rules.get(of, [])), key=lambda r: (-len(r[1][1].encode()), r[0]))
        for _, (allow, path) in reversed(ranked):
            out = F.when(F.startswith(p, F.lit(path)), F.lit(allow)).otherwise(out)
        return out

    return decide(agent.lower(), decide("*", F.lit(True)))


def is_private(u: Column) -> Column:
    """Hosts that name this machine or a private network."""
    return hostname(u).rlike(r"^(localhost|.*\.local|127\.|10\.|192\.168\.|169\.254\.|0\.0\.0\.0|172\.(1[6-9]|2[0-9]|3[01])\.|\[?::1\]?$|\[?f[cd])")


def is_internal(u: Column, seed: str, allowed: tuple[str, ...] = ()) -> Column:
    """Whether the url's host is the seed's or one of those allowed."""
    own = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", seed)
    return hostname(u).isin(*([own[1].lower()] if own else []), *allowed)


def frontier_verdict(u: Column, include: list[str] = (), exclude: list[str] = (), params: list[str] = ()) -> Column:
    """'kept', 'not-included' if no include pattern fits, or 'excluded:' and the first exclude pattern that does; a pattern is a
    regular expression, and ``params`` are query parameters each of which excludes."""
    out, rules = F.lit("kept"), [*exclude, *(rf"[?&]{re.escape(p)}(=|&|$)" for p in params)]
    for pattern in reversed(rules):
        out = F.when(u.rlike(pattern), f"excluded:{pattern}").otherwise(out)
    return F.when(~reduce(lambda a, b: a | b, (u.rlike(p) for p in include)), "not-included").otherwise(out) if include else out


def budget_rule(u: Column, prefixes: list[str]) -> Column:
    """The longest of the prefixes that the url's path has, or null."""
    out = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        out = F.when(F.startswith(raw_path(u), F.lit(p)), p).otherwise(out)
    return out


def encoded_path(u: Column) -> Column:
    """u with its path percent-encoded, slashes and what is encoded already left alone."""
    p = raw_path(u)
    safe = F.replace(F.replace(F.replace(F.url_encode(F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    head = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return F.concat(head, safe, F.substr(u, F.length(head) + F.length(p) + 1))
