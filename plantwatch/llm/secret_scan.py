"""2. Secret scans with structural confirmation.

Base patterns (assign, access, hex) report every match that is long enough. Runs
of base64 or hex characters are candidates only: they are decoded and must parse
as a private key (DER with nested lengths, or the OpenSSH container with its
nested strings) or as a signed token whose header and payload are JSON. Confirmed
ones are reported with kinds der, ssh and jwt.

Defined cases: a null text is an empty one; empty texts have no spans; rows are
scanned one by one, so repeated rows and ids repeat. Spans are in code points,
end exclusive, over whole texts.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame, functions as F, types as T

from plantwatch.llm.catalog import query
from plantwatch.llm.rows import append, raw, read

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")  # whole runs, as matching shorter ones and dropping them would give
ENCODED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?:\r?\n[A-Za-z0-9+/_-]+)*")
TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
HEX_ONLY = re.compile(rb"[0-9A-Fa-f]+")
MARK = b"openssh-key-v1\x00"


def decoded(chars: bytes) -> bytes:
    """Base64 (either alphabet, padding optional) or b"" if it isn't."""
    chars = chars.translate(bytes.maketrans(b"-_", b"+/"), b"\r\n=")
    try:
        return base64.b64decode(chars[:len(chars) - (len(chars) % 4 == 1)] + b"=" * (-len(chars) % 4 % 3), validate=True)
    except binascii.Error:
        return b""


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER element at `at`, if it fits before `end`."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at:at + n], "big"), at + n
        if size < 0x80:
            return None  # DER lengths are as short as can be
    return (tag, at, at + size) if at + size <= end else None


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill start..end exactly."""
    out = []
    while start < end:
        one = element(data, start, end)
        if one is None:
            return None
        out.append(one)
        start = one[2]
    return out


def der_key(data: bytes) -> int:
    """Bytes of the private key that `data` begins with, else 0 (PKCS#1, PKCS#8 and SEC1 layouts)."""
    top = element(data, 0, len(data))
    if top is None or top[0] != 0x30:
        return 0
    parts = children(data, top[1], top[2])
    if not parts:
        return 0
    tags = [p[0] for p in parts]
    first = data[parts[0][1]:parts[0][2]]
    if tags[0] != 0x02:
        return 0
    rsa = first in (b"\x00", b"\x01") and len(tags) >= 9 and set(tags[:9]) == {0x02}
    pkcs8 = tags[:3] == [0x02, 0x30, 0x04] and first in (b"\x00", b"\x01") and \
        bool(inner := children(data, *parts[1][1:])) and inner[0][0] == 0x06
    sec1 = tags[:2] == [0x02, 0x04] and first == b"\x01" and 16 <= parts[1][2] - parts[1][1] <= 66 and \
        set(tags[2:]) <= {0xA0, 0xA1}
    return top[2] if rsa or pkcs8 or sec1 else 0


def ssh_key(data: bytes) -> int:
    """Bytes of the OpenSSH private key container that `data` begins with, else 0."""
    if not data.startswith(MARK):
        return 0
    at, counts = len(MARK), []
    for part in ("cipher", "kdf", "options", None, "public", "private"):
        if at + 4 > len(data):
            return 0
        size, at = int.from_bytes(data[at:at + 4], "big"), at + 4
        if part is None:
            counts.append(size)
            if size != 1:
                return 0
            continue
        if at + size > len(data) or part in ("cipher", "public", "private") and not size:
            return 0
        at += size
    return at


def signed_token(header: bytes, payload: bytes) -> bool:
    try:
        head, body = (json.loads(decoded(x)) for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str) and \
        head["alg"].lower() != "none"


def keys_in(chars: bytes):
    """(kind, start, end) of the private key that a run of encoded characters begins with."""
    plain = chars.translate(None, b"\r\n")
    forms = [(decoded(plain), lambda n: -(-n * 4 // 3))]
    if HEX_ONLY.fullmatch(plain):
        forms.insert(0, (bytes.fromhex(plain[:len(plain) // 2 * 2].decode()), lambda n: 2 * n))
    for data, width in forms:
        for kind, size in (("der", der_key(data)), ("ssh", ssh_key(data))):
            if size:
                left, end = width(size), 0
                while left:
                    left -= chars[end] not in b"\r\n"
                    end += 1
                return kind, end
    return None


def spans_of(text: bytes | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then kind as listed."""
    if not text:
        return []
    found = []
    if b"=" in text or b":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in ENCODED.finditer(text):
        if key := keys_in(m[0]):
            found.append((m.start(), KINDS.index(key[0]), m.start() + key[1]))
    if b"eyJ" in text:
        found += [(m.start(), 5, m.end()) for m in TOKEN.finditer(text) if signed_token(m[1], m[2])]
    found.sort()
    if found and not text.isascii():
        edges = sorted({x for s, _, e in found for x in (s, e)})
        at, points, last = {}, 0, 0
        for x in edges:
            points, last = points + len(text[last:x].decode("utf-8", "replace")), x
            at[x] = points
        found = [(at[s], k, at[e]) for s, k, e in found]
    return [(s, KINDS[k], e) for s, k, e in found]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`docs` with `secrets`: the spans of every secret in `text`."""
    def run(texts):
        return [[[{"kind": k, "start": s, "end": e} for s, k, e in spans_of(t)] for t in texts]]
    return append(docs, [raw("text")], T.StructType([T.StructField("secrets", SPANS)]), run, keep)


def digest_of(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op2_secrets")
def op2_secrets(spark, sf_dir: str) -> DataFrame:
    spans = F.col("secrets")
    def of(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return scan(read(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"))
