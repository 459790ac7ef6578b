"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions near hits only, then checksum validation.

Base kinds are ``assign`` (a keyword, a separator and a value of 12 or more characters), ``access`` (AKIA keys of 18 or
more characters) and ``hex`` (runs of 16 or more hex digits; they have no keyword, so the whole text is searched).  The
method adds ``github`` and ``npm`` tokens whose last six characters are the base-62 CRC32 of the rest, and ``card`` (13 to
19 digits with a card prefix that pass the Luhn checksum).  Two further kinds carry no checksum; what they hold is checked
instead: ``jwt`` (three base64url parts, header and payload JSON objects, ``alg`` in the header and a signature as long as
that algorithm makes) and ``pem`` (a private-key block with its end line, whose bytes are one DER sequence of exactly the
length that it states, or start as an OpenSSH key).

Time is linear in the text: hits of a kind within its last span, or inside a longer run of its letters, are skipped.

Spans are code points, end exclusive.  A null or empty text has no spans.  Repeated rows give repeated results; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "card", "pem")
_ci = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
ASSIGN = re.compile(
    f"({'|'.join(map(_ci, ('password', 'passwd', 'secret', 'token')))}|{_ci('api')}_?{_ci('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CHECKED = re.compile(r"(gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)")
PEM = re.compile(r"-----BEGIN ([A-Z ]{0,32})PRIVATE KEY-----([A-Za-z0-9+/=\s]*+)(?:-----END \1PRIVATE KEY-----)?")
CARD = re.compile(r"(?<![^\W_])[3-6][0-9]{12,18}(?![^\W_])")
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132}  # bytes, by algorithm
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
WORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access", **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "checked"), "eyj": "jwt", "-----begin": "pem",
    **dict.fromkeys(map(str, range(30, 70)), "card"),
}


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out.rjust(width, "0")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _part(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def is_jwt(head: str, payload: str, signature: str) -> bool:
    try:
        h, p, s = json.loads(_part(head)), json.loads(_part(payload)), _part(signature)
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(p, dict) and "alg" in h and len(s) == SIGNATURE.get(str(h["alg"]), len(s))


def is_private_key(body: str) -> bool:
    """Whether base64 text is one DER sequence of the length that it states, or an OpenSSH key."""
    try:
        data = base64.b64decode("".join(body.split()), validate=True)
    except binascii.Error:
        return False
    if data.startswith(b"openssh-key-v1\0"):
        return True
    if len(data) < 2 or data[0] != 0x30:
        return False
    more = data[1] & 0x7F if data[1] & 0x80 else 0
    size = int.from_bytes(data[2 : 2 + more], "big") if more else data[1]
    return more <= 4 and len(data) == 2 + more + size


@lru_cache(1)
def _automaton():
    a = ahocorasick.Automaton()
    for w, kind in WORDS.items():
        a.add_word(w, (len(w), kind))
    a.make_automaton()
    return a


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each span, by start, then by kind as in KINDS."""
    found: list[tuple[int, int, str]] = []
    low = text.replace("İ", "i").lower()  # the one letter whose lower case is longer
    last = dict.fromkeys(("assign", "access", "checked", "jwt", "card", "pem"), 0)
    # no keyword is part of another, so hits come in the order of their starts
    for end, (n, kind) in _automaton().iter(low):
        at = end + 1 - n
        if at < last[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                last[kind] = m.end()
                if len(m[2]) >= 12:
                    found.append((at, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                last[kind] = m.end()
                if len(m[0]) >= 18:
                    found.append((at, m.end(), kind))
        elif kind == "checked":
            if (m := CHECKED.match(text, at)) and base62(zlib.crc32(m[2].encode())) == m[3]:
                last[kind] = m.end()
                found.append((at, m.end(), "npm" if m[1] == "npm_" else "github"))
        elif kind == "jwt":
            if m := JWT.match(text, at):
                last[kind] = m.end()
                if is_jwt(m[1], m[2], m[3]):
                    found.append((at, m.end(), kind))
        elif kind == "card":
            if (m := CARD.match(text, at)) and luhn(m[0]):
                last[kind] = m.end()
                found.append((at, m.end(), kind))
        elif m := PEM.match(text, at):
            last[kind] = m.end()
            if m.end() > m.end(2) and is_private_key(m[2]):  # with its end line
                found.append((at, m.end(), kind))
    for m in HEX.finditer(text):
        found.append((*m.span(), "hex"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of the base kinds, a digest of the base spans, and all spans."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                spans = scan(t or "")
                base = [s for s in spans if s[2] in KINDS[:3]]
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def mask(text: str | None, mark: str = "<SECRET>") -> str | None:
    """The text with each run of overlapping spans replaced by ``mark``."""
    spans = scan(text or "")
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; in ``text`` secrets are masked, and ``n_chars`` (if there) counts the new text."""

    @F.pandas_udf("string")
    def masked(s):
        return s.map(mask, na_action="ignore").astype(object)

    out = docs.withColumn("text", masked(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op5_secrets": op5_secrets}
ORACLE: dict[str, str] = {}
