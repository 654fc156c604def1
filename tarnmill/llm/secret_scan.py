"""Secret scans: Aho-Corasick finds keywords, anchored expressions run only there, embedded checksums decide the rest.

Kinds, in the order in which spans with one start are listed: ``assign`` (a secret's name, ``:`` or
``=``, and a value), ``access`` (cloud access keys), ``hex`` (long runs of hexadecimal digits), then
the kinds that carry their own checksum: ``github`` and ``npm`` (base-62 CRC-32 in the last six
characters) and ``iban`` (97-remainder). A keyword's match is tried at each of its places from left to
right, after the end of the kind's match before, which is the leftmost non-overlapping scan, as no
match can begin elsewhere. A kind without a keyword (hex) is one scan for its least run.

Texts: null counts as empty and has no spans; spans count code points, end exclusive. A text of any length
is scanned whole. Rows that repeat are scanned each, an empty table gives no rows; ``secrets`` reads no other
columns, ``without_secrets`` keeps them.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
import zlib

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from . import rows

#: Names, prefixes and lengths of the scanned formats.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
IBAN = re.compile(r"iban[\x20:=]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)
KINDS = ("assign", "access", "hex", "github", "npm", "iban")
BASE = KINDS[:3]
ALPHABET = string.digits + string.ascii_uppercase + string.ascii_lowercase

_LOWER = {ord(c): ord(c.lower()) for c in string.ascii_uppercase}


def crc_ok(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the rest of the body, in base 62."""
    value = 0
    for c in m[2]:
        value = value * 62 + ALPHABET.index(c)
    return value == zlib.crc32(m[1].encode())


def iban_ok(m: re.Match) -> bool:
    code = m[1].replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


#: keyword, kind, expression, test of a match, group whose span counts
RULES = (
    *((name, "assign", ASSIGN, lambda m: len(m[2]) >= 6, 0) for name in NAMES),
    ("akia", "access", ACCESS, lambda m: len(m[0]) >= 20, 0),
    *((f"gh{c}_", "github", GITHUB, crc_ok, 0) for c in "pousr"),
    ("npm_", "npm", NPM, crc_ok, 0),
    ("iban", "iban", IBAN, iban_ok, 1),
)


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, (word, *_) in enumerate(RULES):
        a.add_word(word, (i, len(word)))
    a.make_automaton()
    return a


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start, then kind as listed."""
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    past: dict[str, int] = {}
    hits = [(end + 1 - size, i) for end, (i, size) in automaton().iter(text.translate(_LOWER))]
    for start, i in sorted(hits) if len(hits) > 1 else hits:
        _, kind, expression, good, group = RULES[i]
        if start >= past.get(kind, 0) and (m := expression.match(text, start)):
            past[kind] = m.end()
            if good(m):
                found.append((m.start(group), m.end(group), kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """text with each stretch that spans cover replaced by mark."""
    out, at = [], 0
    for start, end, _ in scan(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def _listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs (doc_id, text)."""

    def fn(batch):
        every = [scan(t) for t in batch.column("text").to_pylist()]
        base = [[s for s in spans if s[2] in BASE] for spans in every]
        return {"doc_id": batch.column("doc_id")} | {f"n_{kind}": [sum(s[2] == kind for s in x) for x in base] for kind in BASE} | {"base_sha256": [hashlib.sha256(_listed(x).encode()).hexdigest() for x in base], "spans": [_listed(x) for x in every]}

    return rows.map_batches(rows.texts(docs), fn, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by a mark; n_chars, where there is such a column, follows. Null texts stay null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def clean(text):
        return text.map(redact, na_action="ignore")

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(rows.documents(spark, sf_dir))
