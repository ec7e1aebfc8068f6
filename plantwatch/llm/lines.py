"""8. Fuzzy line deduplication: blocks of words, edit similarity, connected groups.

Lines are normalised to lower-case words; equal lines are counted first, so a
line that millions of documents share is one row. Distinct lines are near-equal
if they reach the edit similarity `SIMILAR` (over words, 1 - distance / longer
length). One edit changes at most `q` of a line's runs of `q` words, so of all runs
in any fixed order, the first few of two such lines (`blocks`) must have one in
common (pigeonhole): joining on those finds every such pair. The order puts runs
that a part of the documents shows to be common last, which changes the cost, not
the result. Of the pairs met, those whose lengths or parities of hashed words
(`parities`) differ by more than the edits allow can't be near-equal; the others
are compared. Connected lines form a group, and the group's first occurrence
stays: smallest doc_id, then place.

SimHash doesn't choose pairs: one changed word moves the hash of a short line by more
bits than blocks of it can leave alone, so most near-equal lines were lost.

No pairs are written: a task compares one bucket, or two blocks of a large one, and
marks the lines that have a partner. Marked lines of buckets with the same first marked
line then meet once, not once per bucket; after their texts have come, a task returns
one edge per connected line.

Defined cases: null texts stay null, and lines of fewer than `MIN_WORDS` words are
never removed; rows that repeat both id and text are one document, of which one
row stays; null ids are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from plantwatch.llm.catalog import query
from plantwatch.llm.components import components
from plantwatch.llm.hashes import mixed, sequence_hashes, slices, word_hashes
from plantwatch.llm.rows import WORD_BYTES, append, col, hidden, raw, read, shared, small, without, words
from plantwatch.session import stored

MIN_WORDS = 3
SIMILAR = 0.9
BLOCK = 1024     # lines of a bucket compared by one task
FEW = 32         # lines of a bucket that is compared beside others, all buckets at once
CHUNK = 1 << 14  # rows, or pairs, that a task takes up at once
PROBE = 8        # share of lines (one in so many) that large buckets are looked for in
SAMPLE = 64      # share of documents (one in so many) that common runs of words are looked for in
COMMON = 1 << 16  # common runs that are known at most
LINE_BYTES = WORD_BYTES[:10] + b"\n" + WORD_BYTES[11:]


def run_length(least: float) -> int:
    """Words per run: two, if lines of similarity `least` always share such a run."""
    return 2 if 4 * (1 - least) <= 1 + 1e-9 else 1


def block_count(n: int, least: float) -> int:
    """How many first runs of a line of n words must be looked at; none if no other line can be near-equal."""
    q, top = run_length(least), int(n / least + 1e-6)
    edits = [int((1 - least) * m + 1e-9) for m in range(n, top + 1)]
    return max(n - m + q * e + 1 for m, e in zip(range(n, top + 1), edits)) if edits[-1] else 0


def run_values(one: np.ndarray, size: np.ndarray, least: float):
    """Number of its line and a hash of 48 bits, for every run of words of lines that can have near-equal ones."""
    length, at = np.unique(size, return_inverse=True)
    want = np.array([block_count(n, least) for n in length.tolist()], dtype=np.int64)[at]
    line = np.repeat(np.arange(len(size)), size)
    ok = want[line] > 0
    if run_length(least) == 2:
        ok[np.cumsum(size) - 1] = False
        one = mixed(one, 10) + np.append(one[1:], one[:1])
    return line[ok], mixed(one[ok], 11) >> np.uint64(16), want


def blocks(one: np.ndarray, size: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray]):
    """Per line the number of its blocks, and all blocks (hashes of 32 bits)."""
    line, value, want = run_values(one, size, least)
    known, count = common
    if len(known) and len(value):
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        value = value | np.where(known[at] == value, count[at], 0).astype(np.uint64) << np.uint64(48)
    order = np.lexsort((value, line))
    line, value = line[order], value[order]
    begin = np.searchsorted(line, np.arange(len(size)))
    keep = np.arange(len(line)) - begin[line] < want[line]
    keep[1:] &= (line[1:] != line[:-1]) | (value[1:] != value[:-1])
    return np.bincount(line[keep], minlength=len(size)), (mixed(value[keep], 12) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def parities(one: np.ndarray, size: np.ndarray, half: int | None = None) -> np.ndarray:
    """64 parities of each line's words, dealt by hash: one edit changes at most two. With `half`, of the words
    of that half alone, so that both halves are 128 parities: long lines would pass 64 by chance."""
    bits = np.uint64(1) << (one & np.uint64(63))
    if half is not None:
        bits = np.where(one >> np.uint64(6) & np.uint64(1) == half, bits, np.uint64(0))
    return np.bitwise_xor.reduceat(bits, np.cumsum(size) - size)


def line_words(texts: list[bytes | None], min_words: int):
    """Of every line with enough words: number of its text, its place, number of words; and all word hashes."""
    counts = np.array([0 if t is None else t.count(b"\n") + 1 for t in texts], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    data = b"\n".join(t for t in texts if t is not None).translate(LINE_BYTES)
    one, starts = word_hashes(data)
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    line = np.searchsorted(ends, starts)
    size = np.bincount(line, minlength=len(text))
    kept = size >= max(1, min_words)
    return text[kept], place[kept], size[kept], one[kept[line]]


def line_hashes(texts: list[bytes | None], min_words: int, least: float, common):
    """Of every line with enough words: number of its text, its place, key (two longs), number of words,
    parities (two longs) and number of blocks; and all blocks."""
    text, place, size, one = line_words(texts, min_words)
    if not len(size):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, none, none, none, none.astype(np.int32)
    keys = [k.view(np.int64) for k in sequence_hashes(one, size)]
    odd = [parities(one, size, half).view(np.int64) for half in (0, 1)]
    return text, place, *keys, size, *odd, *blocks(one, size, least, common)


LINE = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("k1", T.LongType()),
                                 T.StructField("k2", T.LongType()), T.StructField("n", T.IntegerType()),
                                 T.StructField("odd", T.LongType()), T.StructField("odd2", T.LongType()),
                                 T.StructField("blocks", T.ArrayType(T.IntegerType()))]))


def common_runs(docs: DataFrame, min_words: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of words that a part of the documents has more than once, sorted, and their counts."""
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).select(raw("text").alias("t"))

    def run(batches):
        for batch in batches:
            for texts in slices(batch.column(0).to_pylist()):
                _, _, size, one = line_words(texts, min_words)
                if len(size):
                    value, count = np.unique(run_values(one, size, least)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(count)], names=["v", "c"])
    found = (part.mapInArrow(run, "v long, c long").groupBy("v").agg(F.sum("c").alias("c")).where("c > 1")
             .orderBy(F.desc("c"), "v").limit(COMMON).collect())
    pairs = np.array(sorted((r.v, min(r.c, (1 << 16) - 1)) for r in found), dtype=np.uint64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def hashed(docs: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """(doc_id, digest, lines) for every row."""
    common = shared(docs.sparkSession, common_runs(docs, min_words, similarity))

    def run(texts):
        groups = slices(texts)
        parts = [line_hashes(part, min_words, similarity, common()) for part in groups]
        size = np.concatenate([[0], *(np.bincount(p[0], minlength=n) for p, n in zip(parts, map(len, groups)))])
        pos, k1, k2, n, odd, odd2, many, block = (np.concatenate(c) for c in list(zip(*parts))[1:])
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(block))
        each = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(k1), pa.array(k2),
                                           pa.array(n.astype(np.int32)), pa.array(odd), pa.array(odd2), inner],
                                          fields=list(to_arrow_type(LINE).value_type))
        return [pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), each)]
    source = docs.withColumn("digest", F.xxhash64("text"))
    return append(source, [raw("text")], T.StructType([T.StructField("lines", LINE)]), run, ["doc_id", "digest"])


PLACE = ["key", "low", "high"]


def runs(batches, columns: list[str], rows: int = 1):
    """Arrow batches sorted by PLACE, as lists of columns that hold whole places, with their edges;
    about `rows` at once."""
    held, waiting, many = None, [], 0

    def edges(c):
        new = np.concatenate(([True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])))
        return np.flatnonzero(new)
    for batch in batches:
        waiting.append([batch.column(batch.schema.names.index(n)).to_numpy(zero_copy_only=False) for n in columns])
        many += batch.num_rows
        if many < rows:
            continue
        c = [np.concatenate(x) for x in zip(*([held] if held else []), *waiting)]
        waiting, many = [], 0
        if len(c[0]):
            at = edges(c)
            held = [x[at[-1]:] for x in c]
            if at[-1]:
                yield [x[:at[-1]] for x in c], at
    if waiting:
        held = [np.concatenate(x) for x in zip(*([held] if held else []), *waiting)]
    if held is not None and len(held[0]):
        yield held, np.append(edges(held), len(held[0]))


def measures(n: np.ndarray, odd: np.ndarray, odd2: np.ndarray, least: float):
    """What `alike` compares, per line: length, edits that it allows, and parities."""
    return n, ((1 - least) * n + 1e-9).astype(np.int32), *(x.astype(np.int64).view(np.uint64) for x in (odd, odd2))


def alike(one, other):
    """Whether lengths and parities of lines (their `measures`) allow the similarity."""
    edits = np.maximum(one[1], other[1])
    odd = np.bitwise_count(one[2] ^ other[2]) + np.bitwise_count(one[3] ^ other[3])  # 128 at most
    return (np.abs(one[0] - other[0]) <= edits) & (odd <= 2 * edits)


def close(each, block: np.ndarray, within: bool):
    """Pairs (i, j), i < j, of one place whose `measures` allow the similarity; in slices, as places can be large."""
    step = max(1, (1 << 20) // len(block))
    for at in range(0, len(block), step):
        i, j = np.nonzero(alike([x[at:at + step, None] for x in each], [x[None, at:] for x in each]))
        keep = j > i
        if not within:
            keep &= block[at + i] != block[at + j]
        if keep.any():
            yield at + i[keep], at + j[keep]


def partners(least: float):
    """Task that marks, in rows sorted by place, those with a possible partner. Undivided places are named
    by the first line marked in them: lines that meet in several places mostly come under one name."""
    def run(batches):
        for (key, low, high, block, many, n, odd, odd2, ids), at in runs(
                batches, [*PLACE, "block", "many", "n", "odd", "odd2", "id"], CHUNK):
            each = measures(n, odd, odd2, least)
            hit, size = np.zeros(len(key), dtype=bool), np.diff(at)
            left = np.repeat(at[1:], size) - np.arange(len(key))  # rows from here to the end of the place
            i = np.flatnonzero(np.repeat(size <= FEW, size))
            for step in range(1, FEW):
                i = i[left[i] > step]
                if not len(i):
                    break
                j = i + step
                near = alike([x[i] for x in each], [x[j] for x in each])
                near &= (low[i] == high[i]) | (block[i] != block[j])
                hit[i[near]] = hit[j[near]] = True
            for k in np.flatnonzero(size > FEW):
                a, b = at[k], at[k + 1]
                for i, j in close([x[a:b] for x in each], block[a:b], low[a] == high[a]):
                    hit[a + i] = hit[a + j] = True
            first = np.minimum.reduceat(np.where(hit, ids, np.iinfo(np.int64).max), at[:-1])
            # negative, as the places of divided buckets are not
            key = np.where(many == 1, np.repeat(first, size) | np.int64(-1 << 63), key)
            yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (key, low, high, block, ids, n, odd, odd2)],
                                             names=[*PLACE, "block", "id", "n", "odd", "odd2"])
    return run


def distance(a: list, b: list) -> int:
    """Edit distance of two sequences (bit-parallel)."""
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    top, whole = 1 << len(a) - 1, (1 << len(a)) - 1
    plus, minus, d = whole, 0, len(a)
    for x in b:
        eq = where.get(x, 0)
        xv, eq = eq | minus, (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(eq | plus) & whole, plus & eq
        d += (ph & top > 0) - (mh & top > 0)
        ph = (ph << 1 | 1) & whole
        plus, minus = (mh << 1 & whole) | ~(xv | ph) & whole, ph & xv
    return d


def within(a: list, b: list, most: int) -> bool:
    """Whether the edit distance is `most` or less: the furthest place that so many edits reach on each diagonal."""
    n, m = len(a), len(b)
    reach: dict[int, int] = {}
    for d in range(most + 1):
        now = {}
        for k in range(max(-d, -n), min(d, m) + 1):
            x = min(max(reach.get(k, -1) + 1, reach.get(k - 1, -1), reach.get(k + 1, -1) + 1), n, m - k) if d else 0
            while x < n and x + k < m and a[x] == b[x + k]:
                x += 1
            now[k] = x
        if now.get(m - n) == n:
            return True
        reach = now
    return False


def similar(a: list, b: list, least: float) -> bool:
    n = max(len(a), len(b))
    most = int((1 - least) * n + 1e-9)
    if len(a) == len(b) and sum(map(ne, a, b)) <= most:  # changed words alone
        return True
    if n - min(len(a), len(b)) > most:
        return False
    # `within` takes most * most steps, `distance` n longer ones
    return within(a, b, most) if most * most <= 2 * n else distance(a, b) <= most


def signatures(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """4,096 parities of each line's words, and 8,192 of its runs of two words: an edit changes at most two and four."""
    out = np.zeros((len(lines), 64), dtype=np.uint64), np.zeros((len(lines), 128), dtype=np.uint64)
    at = 0
    for part in slices(lines):
        text, _, size, one = line_words(part, 1)
        owner = at + np.repeat(text, size)
        same = owner[1:] == owner[:-1]
        two = mixed(mixed(one[:-1], 14)[same] + one[1:][same], 15)
        for held, line, value in zip(out, (owner, owner[:-1][same]), (one, two)):
            slot = (value >> np.uint64(6)) % np.uint64(held.shape[1])
            np.bitwise_xor.at(held, (line, slot.astype(np.int64)), np.uint64(1) << (value & np.uint64(63)))
        at += len(part)
    return out


def connect(least: float):
    """Task that links the marked lines of each place; pairs that are linked already aren't compared."""
    def run(batches):
        for (_, low, high, block, n, odd, odd2, ids, line), at in runs(batches, [*PLACE, "block", "n", "odd", "odd2", "id", "line"]):
            each, (one, two) = measures(n, odd, odd2, least), signatures(line.tolist())
            out: list = []
            for a, b in zip(at[:-1], at[1:]):
                text: dict[int, list] = {}
                root = np.arange(a, b)
                for left, right in close([x[a:b] for x in each], block[a:b], low[a] == high[a]):
                    near = []
                    for k in range(0, len(left), CHUNK):
                        i, j = left[k:k + CHUNK], right[k:k + CHUNK]
                        apart = root[i] != root[j]
                        i, j = i[apart], j[apart]
                        edits = np.maximum(each[1][a + i], each[1][a + j])
                        ok = np.bitwise_count(one[a + i] ^ one[a + j]).sum(axis=1) <= 2 * edits
                        i, j, edits = i[ok], j[ok], edits[ok]
                        differ = np.bitwise_count(two[a + i] ^ two[a + j]).sum(axis=1)
                        ok = differ <= 4 * edits
                        near.append((differ[ok], i[ok], j[ok]))
                    differ, i, j = map(np.concatenate, zip(*near))
                    order = np.argsort(differ, kind="stable")  # the nearest first: most others are linked by then
                    for k in range(0, len(order), CHUNK):
                        x, y = i[order[k:k + CHUNK]], j[order[k:k + CHUNK]]
                        apart = root[x] != root[y]
                        for x, y in zip(x[apart].tolist(), y[apart].tolist()):
                            if root[x] != root[y]:
                                for z in (x, y):
                                    if z not in text:
                                        text[z] = line[a + z].split(b" ")
                                if similar(text[x], text[y], least):
                                    root[root == root[y]] = root[x]
                out.append(np.stack([np.arange(a, b), root]))
            x, y = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[x[x != y]]), pa.array(ids[y[x != y]])], names=["a", "b"])
    return run


LINES = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("line", T.BinaryType())]))


def wished(texts: list[bytes], wishes: list[list]) -> pa.ListArray:
    """Of each text, the wished lines (id and words) that are at their place; all hashed together."""
    lines, each, owner = [], [], []
    for k, (t, wish) in enumerate(zip(texts, wishes)):
        own = t.split(b"\n")
        lines += [own[x["pos"]] if x["pos"] < len(own) else b"" for x in wish]
        each += wish
        owner += [k] * len(wish)
    ok, at = np.zeros(len(lines), dtype=bool), 0
    for part in slices(lines):
        text, _, size, one = line_words(part, 1)
        if len(size):
            keys = np.array([(each[at + i]["k1"], each[at + i]["k2"]) for i in text.tolist()], dtype=np.int64)
            ok[at + text] = np.all([k.view(np.int64) == w for k, w in zip(sequence_hashes(one, size), keys.T)], axis=0)
        at += len(part)
    found = np.flatnonzero(ok).tolist()
    ends = np.cumsum([0, *np.bincount(np.array(owner, dtype=np.int64)[ok], minlength=len(texts))]).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array([each[i]["id"] for i in found], pa.int64()),
                                        pa.array([b" ".join(words(lines[i])) for i in found], pa.binary())],
                                       fields=list(to_arrow_type(LINES).value_type))
    return pa.ListArray.from_arrays(pa.array(ends), inner)


def fuzzy_groups(docs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """(node, root) over ids of `distinct` (id, n, odd, odd2, blocks, doc_id, digest, pos, k1, k2) that have near-equal lines."""
    rows = distinct.select("id", "n", "odd", "odd2", F.explode("blocks").alias("key"))
    rows = rows.withColumn("key", F.col("key").cast("long") + F.lit(1 << 31))  # not negative, see `partners`
    # Buckets that look large in a part of the lines are dealt in blocks; the result is the same.
    large = (rows.where(F.pmod(F.xxhash64("id"), F.lit(PROBE)) == 0).groupBy("key").agg(F.count("*").alias("c"))
             .where(F.col("c") * PROBE > BLOCK).select("key", F.ceil(F.col("c") * PROBE / BLOCK).cast("int").alias("blocks")))
    large = stored(large, "large-buckets")
    rows = rows.join(small(large, large.count(), 32), "key", "left")
    many = F.coalesce("blocks", F.lit(1))
    rows = (rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), many).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
            .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                    "block", many.alias("many"), "n", "odd", "odd2", "id"))
    marked = stored(rows.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(
        partners(similarity), "key long, low int, high int, block int, id long, n int, odd long, odd2 long").distinct(), "partners")
    ids = stored(marked.select("id").distinct(), "marked")
    wanted = distinct.select("id", "doc_id", "digest", "pos", "k1", "k2").join(small(ids, ids.count(), 16), "id")
    wanted = stored(wanted, "wanted")
    per_doc = wanted.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("pos", "id", "k1", "k2")).alias("at"))
    source = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    held = source.join(small(per_doc, wanted.count(), 48),
                       F.col("_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("digest")))

    texts = append(held, [raw("text"), F.col("at")], T.StructType([T.StructField("found", LINES)]),
                   lambda texts, at: [wished(texts, at)], [])
    texts = texts.select(F.explode("found").alias("f")).select("f.id", "f.line")
    met = marked.join(texts, "id").repartition(*PLACE).sortWithinPartitions(*PLACE)
    return components(met.mapInArrow(connect(similarity), "a long, b long"), "line-groups")


def removals(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILAR) -> DataFrame:
    """(doc_id, digest, n_lines, rows, gone): documents with lines to remove, and those whose rows repeat."""
    whole = docs.select("doc_id", F.xxhash64("text").alias("digest")).groupBy("doc_id", "digest").agg(
        F.count("*").cast("int").alias("rows")).where("rows > 1")
    again = stored(whole, "repeated-rows")
    once = hashed(docs, min_words, similarity)
    if not again.isEmpty():  # rows that repeat id and text are one document
        once = once.dropDuplicates(["doc_id", "digest"])
    once = stored(once, "lines")
    each = once.select("doc_id", "digest", F.explode("lines").alias("l")).select("doc_id", "digest", "l.*")
    distinct = stored(each.groupBy("k1", "k2").agg(
        *[F.first(c).alias(c) for c in ("n", "odd", "odd2", "blocks")], F.min(F.struct("doc_id", "digest", "pos")).alias("f"), F.count("*").alias("times"))
        .select("k1", "k2", "n", "odd", "odd2", "blocks", "f.*", "times").withColumn("id", F.monotonically_increasing_id()), "distinct-lines")
    groups = fuzzy_groups(docs, distinct, similarity)
    groups = stored(groups, "line-groups")
    groups = small(groups, groups.count(), 32)
    known = (distinct.join(groups, distinct["id"] == groups["node"], "left").where("times > 1 or root is not null")
             .select("k1", "k2", F.coalesce("root", "id").alias("root"), F.struct("doc_id", "digest", "pos").alias("f")))
    known = stored(known, "repeated-lines")
    stays = known.groupBy("root").agg(F.min("f").alias("stays"))
    known = stored(known.join(stays, "root").select("k1", "k2", "stays"), "repeated-lines")
    gone = (each.join(small(known, known.count(), 80), ["k1", "k2"])
            .where(~F.struct("doc_id", "digest", "pos").eqNullSafe(F.col("stays")))
            .groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list("pos")).alias("gone")))
    none = F.lit(None).cast("array<int>")
    again = again.withColumn("gone", none)
    return stored(gone.select("doc_id", "digest", F.lit(1).alias("rows"), "gone").union(again)
                  .groupBy("doc_id", "digest").agg(F.max("rows").alias("rows"),
                                                   F.first("gone", ignorenulls=True).alias("gone")), "removals")


CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
                    T.StructField("n_removed", T.LongType())])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILAR) -> DataFrame:
    """`docs` with `text` without its repeated lines, n_lines (lines before) and n_removed."""
    docs, back = hidden(docs.select(*[col(c) for c in without(docs, CUT.names[1:])]), ("doc_id", "text"))
    found = removals(docs, min_words, similarity)
    found = small(found.toDF("_id", "_digest", "_rows", "_gone"), found.count(), 128)
    kept = [c for c in without(docs, CUT.names)]
    source = docs.select(*[col(c) for c in kept], F.col("text").cast("string").alias("_text"), F.col("doc_id").alias("_doc"),
                         F.xxhash64("text").alias("_dig"))
    source = source.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_dig") == F.col("_digest")), "left")

    def cut(texts, gone):
        out: tuple = ([], [], [])
        for t, g in zip(texts, gone):
            lines = [] if t is None else t.split(b"\n")
            drop = set(g or ())
            left = b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else t
            for o, v in zip(out, (None if left is None else left.decode("utf-8", "replace"), len(lines), len(drop))):
                o.append(v)
        return out
    done = append(source, [raw("_text"), F.col("_gone")], CUT, cut, [*kept, "_doc", "_dig", "_rows"])
    several = F.coalesce(F.col("_rows"), F.lit(1)) > 1
    once = done.where(several).dropDuplicates(["_doc", "_dig"])
    return done.where(~several).unionByName(once).select(*back, *CUT.names[1:])


@query("op8_lines")
def op8_lines(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), "text")
