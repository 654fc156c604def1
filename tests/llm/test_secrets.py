import hashlib
import random
import re
import zlib

from tarnmill.llm.secret_scan import ALPHABET, redact, scan, secrets, without_secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], ("assign", "access", "hex").index(x[2])))


def checked(prefix, body):
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        tail = ALPHABET[r] + tail
    return prefix + body + tail


def test_base_spans_equal_plain_scans():
    r = random.Random(2)
    parts = ["password", "PassWd", "token", "secret", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH01234567", "deadbeef" * 3, "abc123", "é", "İ", "ſecret=abcdefgh", "x", "token=password=abcdef", "AKIAAKIA" + "Z" * 12]
    for _ in range(3000):
        t = "".join(r.choices(parts, k=r.randint(0, 14)))
        assert [s for s in scan(t) if s[2] in ("assign", "access", "hex")] == brute(t), t


def test_checksums_decide():
    body = "aB3" * 10
    good, bad = checked("ghp_", body), "ghp_" + body + "000000"
    assert [(s, e, k) for s, e, k in scan(f"x {good} y {bad} {checked('npm_', body)}")] == [(2, 42, "github"), (86, 126, "npm")]
    assert [k for *_, k in scan("IBAN: DE89 3704 0044 0532 0130 00.")] == ["iban"]
    assert scan("IBAN: DE88 3704 0044 0532 0130 00.") == []
    assert redact(f"a {good} b") == "a [SECRET] b"


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "é token = abcdef1 x", 19), (3, "é token = abcdef1 x", 19)], "doc_id long, text string, n_chars long")
    got = secrets(docs).orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in got[:2]] == [(1, 0, 0, 0, empty, ""), (2, 0, 0, 0, empty, "")]
    assert got[2] == got[3] and got[3].spans == "assign:2:17" and got[3].n_assign == 1
    out = without_secrets(docs).orderBy("doc_id").collect()
    assert out[0].text is None and out[2].text == "é [SECRET] x" and out[2].n_chars == 12
    assert secrets(docs.limit(0)).count() == 0
