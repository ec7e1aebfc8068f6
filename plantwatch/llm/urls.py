"""6. URL filters: all glob rules at once with a bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL `.host/path?query` (host in lower
case, no scheme, no fragment). All globs are packed into one multiword Shift-And
automaton: a step shifts the states of every URL of a batch, masks them by the
next byte and keeps those that stand on a wildcard. `*` takes any run within the
host or one path part (no `/`, `?`, `#`), `**` any run, `?` any one byte, and
`\\` makes the next character literal.

Of the base rules that fit, the longest decides; else the first glob that fits;
else `default`. Defined cases: a null url or one without `://` has empty host and
path, fits no base rule and gets the globs' or the default verdict. Rows are
judged one by one. Rules are parameters (at most `MAX_RULE_BYTES` of text) and
travel to the tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plantwatch.llm.catalog import query
from plantwatch.llm.rows import append, col, read, shared, without

MAX_RULE_BYTES = 1 << 20
CELLS = 1 << 21  # state words held at once per batch
BASE = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
        ("block", "net", "/es/"), ("block", "net", "/fr/"))
GLOBS = tuple(("block", g) for g in (
    "*.*spam*.*/**", "*.*casino*.*/**", "*.free-bets.*/**", "*.cheap-pills.*/**", "*.adult-*.*/**",
    "*.ads-*.*/**", "*.ads.*/**", "**/ads/**", "**/login**", "**sessionid=**"))


def literal(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


class ShiftAnd:
    """Globs as bits: one per position, plus a start bit; wildcards keep their bit while they run."""

    def __init__(self, globs: list[str]):
        self.starts, self.finals, steps, any_run, part_run = [], [], [], [], []
        bit = 0
        for glob in globs:
            self.starts.append(bit)
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i:i + 2] == b"**":
                    any_run.append(bit)
                    i += 2
                elif data[i:i + 1] == b"*":
                    part_run.append(bit)
                    i += 1
                else:
                    bit += 1
                    escaped = data[i:i + 1] == b"\\" and i + 1 < len(data)
                    steps.append((bit, None if data[i:i + 1] == b"?" else data[i + escaped]))
                    i += 1 + escaped
            self.finals.append(bit)
            bit += 1
        self.words = -(-max(bit, 1) // 64)
        self.take = np.zeros((256, self.words), dtype=np.uint64)
        for b, c in steps:
            rows = slice(None) if c is None else c
            self.take[rows, b // 64] |= np.uint64(1 << b % 64)
        self.stay = np.zeros((256, self.words), dtype=np.uint64)
        for b in any_run + part_run:
            self.stay[:, b // 64] |= np.uint64(1 << b % 64)
        for c in b"/?#":
            self.stay[c] = 0
            for b in any_run:
                self.stay[c, b // 64] |= np.uint64(1 << b % 64)
        self.first = np.zeros(self.words, dtype=np.uint64)
        for b in self.starts:
            self.first[b // 64] |= np.uint64(1 << b % 64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Boolean (text, glob): the glob takes the whole text."""
        out = np.zeros((len(texts), len(self.finals)), dtype=bool)
        size = max(1, CELLS // self.words)
        for at in range(0, len(texts), size):
            out[at:at + size] = self._match(texts[at:at + size])
        return out

    def _match(self, texts):
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts) + b"\0", dtype=np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.tile(self.first, (len(texts), 1))
        live = len(texts)
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(lengths[0]) if len(lengths) else 0):
            while live and lengths[live - 1] <= i:  # the longest texts run on
                live -= 1
            c, now = data[begin[:live] + i], state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = moved & self.take[c] | now & self.stay[c]
        bits = np.array(self.finals, dtype=np.int64)
        out = np.zeros((len(texts), len(bits)), dtype=bool)
        if len(bits):
            out[order] = (state[:, bits // 64] >> (bits % 64).astype(np.uint64)) & one != 0
        return out


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a url, empty where it is null or has no `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    def piece(pattern):
        return F.regexp_extract(rest, pattern, 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (F.translate(piece(r"^([^/?#]*)"), upper, lower), piece(r"^[^/?#]*([^?#]*)"),
            piece(r"^[^?#]*(\?[^#]*)"))


JUDGED = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()),
                       T.StructField("glob", T.StringType())])


def filter_urls(pages: DataFrame, base=BASE, globs=GLOBS, default: str = "allow", url: str = "url",
                keep: list[str] | None = None) -> DataFrame:
    """`pages` with host, path, rule (the longest base rule that fits), verdict and glob (the first
    glob that fits). Base rules are (verdict, host, path): their host with all subdomains, and
    paths that start with theirs."""
    base = sorted(base, key=lambda r: -len(r[1] + r[2]))  # the longest first; ties as listed
    patterns = [f"*.{literal(h)}{literal(p)}**" for _, h, p in base] + [g for _, g in globs]
    if sum(map(len, patterns)) > MAX_RULE_BYTES:
        raise ValueError(f"more than {MAX_RULE_BYTES} bytes of rules")
    names = np.array([h + p for _, h, p in base] + [None], dtype=object)
    verdicts = np.array([v for v, *_ in base] + [v for v, _ in globs] + [default], dtype=object)
    globbed = np.array([g for _, g in globs] + [None], dtype=object)
    automaton, n = shared(pages.sparkSession, ShiftAnd(patterns)), len(base)

    def first(hits):
        return np.where(hits.any(axis=1), hits.argmax(axis=1), hits.shape[1]) if hits.shape[1] else \
            np.zeros(len(hits), dtype=np.int64)

    def run(urls):
        hits = automaton().match(urls)
        rule, glob = first(hits[:, :n]), first(hits[:, n:])
        return [names[rule].tolist(), verdicts[np.where(rule < n, rule, n + glob)].tolist(), globbed[glob].tolist()]

    kept = without(pages.select(*[col(c) for c in (keep or pages.columns)]), ("host", "path", *JUDGED.names))
    host, path, tail = parts(col(url))
    source = pages.select(*[col(c) for c in kept], host.alias("host"), path.alias("path"), tail.alias("_tail"))
    canonical = F.concat(F.lit("."), "host", "path", "_tail").cast("binary")
    return append(source, [canonical], JUDGED, run, [*kept, "host", "path"], rows=1 << 12)


OP6_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS tail FROM u),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(h, s, v)),
m AS (SELECT p.*, h || s AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches('.' || host || path || tail,
       '(?s)^[^/?#]*\.[^/?#]*(spam|casino)[^/?#]*\.[^/?#]*/|^[^/?#]*\.(free-bets|cheap-pills|ads)\.[^/?#]*/|^[^/?#]*\.(adult|ads)-[^/?#]*\.[^/?#]*/|/ads/|/login|sessionid=')
       THEN 'block' ELSE 'allow' END) AS verdict
FROM m WHERE k = 1
"""


@query("op6_urls", OP6_SQL)
def op6_urls(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict")
