"""1. Benchmark decontamination with a generalised suffix automaton.

Items become word sequences; a suffix automaton over all of them is built per
block of items. Documents stream through it word by word. The longest match that
ends at a word tells whether a window (13 item words, or a whole shorter item)
ends there, and the automaton's state tells which items hold it. Nothing is
shuffled: each block's automaton is broadcast (its size is bounded by
`block_words`) and documents pass all blocks in turn, stored after every `PASSES`.

Defined cases: null and empty texts have no words, no hits and are clean. Items
without words never match. Repeated items count once per item_id; an item whose
id is null marks words but isn't listed. Empty tables give empty results.
Documents keep their rows one by one, repeated ones too.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from plantwatch.llm.catalog import query
from plantwatch.llm.rows import append, raw, read, shared, without, words
from plantwatch.session import stored

WINDOW = 13
COVERAGE = 20  # a document with at least 1 hit word in 20 is contaminated
BLOCK_WORDS = 50_000
PASSES = 4      # blocks that documents pass before they are stored
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Automaton:
    """Suffix automaton of several word sequences; states carry the items of their windows."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        coded = [(i, [self.ids.setdefault(w, len(self.ids) + 1) for w in ws]) for i, ws in items if ws]
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.shortest = min((min(window, len(s)) for _, s in coded), default=window)
        self.windows: dict[int, set] = {}          # state -> items with that window
        self.whole: dict[int, list] = {}           # state -> (words, item) of whole short items
        for item, seq in coded:
            state = 0
            for i, w in enumerate(seq):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.windows.setdefault(self._at(state), set()).add(item)
            if len(seq) < window:
                self.whole.setdefault(state, []).append((len(seq), item))

    def _extend(self, last: int, w: int) -> int:
        nxt, length, link = self.next, self.length, self.link
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state({}, length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, edges: dict, length: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _at(self, state: int) -> int:
        """The state of the last `window` words read."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit word ranges (merged), items found, longest match of a window or more."""
        get = self.ids.get
        codes = [get(w, 0) for w in seq]
        cuts = np.concatenate(([-1], np.flatnonzero(np.array(codes, dtype=np.int64) == 0), [len(seq)]))
        spans: list[list[int]] = []
        items: set = set()
        longest = 0
        for k in np.flatnonzero(np.diff(cuts) > self.shortest):  # shorter runs hold no window
            state = size = 0
            for i in range(int(cuts[k]) + 1, int(cuts[k + 1])):
                w = codes[i]
                while state and w not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                to = self.next[state].get(w)
                state, size = (0, 0) if to is None else (to, size + 1)
                reach = 0
                if size >= self.window:
                    reach = self.window
                    items |= self.windows.get(self._at(state), set())
                up = state
                while up > 0 and self.whole:
                    for n, item in self.whole.get(up, ()):
                        if n <= size:
                            items.add(item)
                            reach = max(reach, n)
                    up = self.link[up]
                if reach:
                    longest = max(longest, size)
                    start, end = i + 1 - reach, i + 1
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, end])
        return [tuple(s) for s in spans], items, longest


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def cut_words(text: bytes, spans) -> bytes:
    """The text without the words of the spans; what stands around them stays."""
    at = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done:at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()), T.StructField("longest", T.LongType()),
    T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType()))])


def _pieces(window: int, size: int = 1000):
    """Items as pieces of bounded size that overlap by a window less one word: no window is lost."""
    def run(item, text):
        ids, seqs = [], []
        for i, t in zip(item, text):
            ws = words(t)
            starts = range(0, max(1, len(ws) - window + 1), size) if ws else ()
            ids.append([i] * len(starts))
            seqs.append([b" ".join(ws[s:s + size + window - 1]) for s in starts])
        return ids, seqs
    return run


def blocks(items: DataFrame, window: int, block_words: int) -> list:
    """Broadcast automata over all items, each of about `block_words` words."""
    fields = T.StructType([T.StructField("ids", T.ArrayType(T.StringType())),
                           T.StructField("seqs", T.ArrayType(T.BinaryType()))])
    parts = (append(items, [F.col("item_id").cast("string"), raw("text")], fields, _pieces(window), keep=[])
             .select(F.explode(F.arrays_zip("ids", "seqs")).alias("p"))
             .select(F.col("p.ids").alias("item"), F.col("p.seqs").alias("seq")).distinct())
    parts = stored(parts.withColumn("size", F.size(F.split(F.col("seq").cast("string"), " "))), "benchmark")
    total = parts.agg(F.sum("size")).first()[0] or 0
    n = -(-total // block_words)
    for b in range(n):
        rows = parts.where(F.pmod(F.xxhash64("item", "seq"), F.lit(n)) == b).collect()
        yield shared(items.sparkSession, Automaton([(r.item, bytes(r.seq).split()) for r in rows], window))
    if not n:
        yield None


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
                  block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """`docs` (with `text`) and what of `items` (item_id, text) occurs in them.

    Adds n_words, n_hit, n_items, items_sha256, contaminated, longest (match in
    words), spans (hit word ranges) and items. With `cut`, the text loses its hit
    spans.
    """
    empty = (F.lit(None).cast(SPAN), F.lit(None).cast("array<string>"), F.lit(0).cast("long"))
    held = docs.select(*without(docs, FOUND.names))
    inputs = list(empty)
    for k, automaton in enumerate(blocks(items, window, block_words)):
        if k and k % PASSES == 0:  # keeps plans short and few Python steps in a task
            held = stored(held, "decontaminate")
        def run(text, spans, found, longest, automaton=automaton):
            out: list[list] = [[] for _ in FOUND.names]
            for t, s, f, far in zip(text, spans, found, longest):
                ws = words(t)
                hits, ids, size = automaton().match(ws) if automaton and ws else ([], set(), 0)
                hits = merged([*hits, *((x["start"], x["end"]) for x in s or ())])
                ids = sorted({*(i for i in ids if i is not None), *(f or ())})
                hit = sum(b - a for a, b in hits)
                for o, v in zip(out, (len(ws), hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                                      hit > 0 and coverage * hit >= len(ws), max(size, far),
                                      [{"start": a, "end": b} for a, b in hits], ids)):
                    o.append(v)
            return out
        held = append(held, [raw("text"), *inputs], FOUND, run)
        inputs = [F.col("spans"), F.col("items"), F.col("longest")]
    if cut:
        def trim(text, spans):
            return [[cut_words(t, [(x["start"], x["end"]) for x in s]).decode("utf-8", "replace") if s
                     else None if t is None else t.decode("utf-8", "replace") for t, s in zip(text, spans)]]
        order = held.columns
        held = append(held, [raw("text"), F.col("spans")],
                      T.StructType([T.StructField("text", T.StringType())]), trim).select(*order)
    return held


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, n, item FROM grams JOIN win USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op1_decontaminate", OP1_SQL)
def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
