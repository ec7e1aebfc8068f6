"""Operators that shuffle, against brute force, with skew, copies, nulls and empty tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from plantwatch.llm import hashes, jaccard, lines, mix, toxicity
from plantwatch.llm.components import components
from plantwatch.llm.rows import words


def some_words(rng, n, size=400):
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


def altered(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"z{rng.randint(0, 10 ** 9)}"
    return ws


class Groups(dict):
    def find(self, a):
        while self.setdefault(a, a) != a:
            a = self[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    edges += [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(70)]
    rng.shuffle(edges)
    want = Groups()
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: want.find(a) for e in edges for a in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 3 ---------------------------------------------------------------------------------------

def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mix.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        out = {s: 3.0 * sizes[s] if s in capped else weight[s] * rest / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if out[s] >= 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mix_equals_plain_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(some_words(rng, rng.randint(0, 50))), rng.choice(["big"] * 30 + ["b", "a", "é", "Z", None]), 1.5) for i in range(900)]
    rows += [(None, "null id words", "a", 0.0), (None, "null id words", "a", 0.0), (7, None, "b", 0.0), (8, "", "only empty", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, SIZE double")
    got = mix.mix(df).collect()
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.passes)
        assert all(0 <= p.position <= 1 for p in r.passes)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = sorted(map(str, mix.mix(df.repartition(7)).collect()))
    assert again == sorted(map(str, got))


def test_training_rows_are_in_order_and_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mix.training_rows(docs).collect()
    at = [r.position for r in rows]
    assert at == sorted(at) and max(Counter((r.doc_id) for r in rows).values()) <= 3
    total = sum(len(r.text.split()) for r in docs.collect())
    assert abs(sum(r["take"] for r in rows) - total) <= 20
    assert all(len(r.text.split()) == r["take"] for r in rows)
    assert mix.training_rows(docs.limit(0)).count() == 0


@pytest.mark.parametrize("knots", mix.SHAPES)
def test_inverted_schedules(spark, knots):
    from pyspark.sql import functions as F
    u = [i / 200 for i in range(201)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in u], "u double").select(mix.when_due(F.col("u"), knots)).collect()]
    ts = np.linspace(0, 1, 20001)
    h = np.interp(ts, [t for t, _ in knots], [x for _, x in knots])
    area = np.concatenate([[0], np.cumsum((h[1:] + h[:-1]) / 2) / 20000])
    assert np.allclose(got, np.interp(u, area / area[-1], ts), atol=1e-4)


# ---- 4 ---------------------------------------------------------------------------------------

def test_segments_are_the_maximal_ones():
    rng = random.Random(0)
    for _ in range(300):
        n = rng.randint(1, 14)
        hits = sorted((i, rng.choice([0.5, 1.0, 2.0])) for i in rng.sample(range(n), rng.randint(0, n)))
        seq = [dict(hits).get(i, -0.7) for i in range(n)]

        def maximal(lo, hi):  # the definition: best segment, then both sides
            best = max(((sum(seq[a:b]), a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            _, _, _, a, b = best
            return maximal(lo, a) + [(a, b)] + maximal(b, hi)
        got = toxicity.segments(hits, 0.7)
        assert sum(s for *_, s in got) == pytest.approx(sum(sum(seq[a:b]) for a, b in maximal(0, n)))
        assert all(s == pytest.approx(sum(seq[a:b])) for a, b, s in got)
        top = max((sum(seq[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        assert max((s for *_, s in got), default=0) == pytest.approx(max(top, 0))


def toxic_docs(n=600, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        ws = some_words(rng, rng.randint(20, 200), 3000)
        if bad:
            at = rng.randrange(len(ws))
            ws[at:at] = [rng.choice(["vile", "rotten"]), "w1", "grim" + rng.choice(["o", "ster", "ish"])]
        rows.append((i, " ".join(ws), 0.5))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_docs()
    rows += [(9000, None, 0.5), (9001, "", 0.5), (None, "vile grimster", 0.5), (9001, "", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels + [(9000, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    want = {i: t for i, _, t in labels}
    import zlib
    held = [r for r in got if r.doc_id in want and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == 0 for r in got if not r.text)
    assert toxicity.toxicity(docs.limit(0), known).count() == 0
    none = toxicity.toxicity(docs, known.limit(0)).collect()
    assert len({r.score for r in none}) == 1 and not any(r.predicted for r in none)


def test_held_out_labels_are_not_used(spark):
    import zlib
    rows, labels = toxic_docs(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x double")
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())
                for x in (labels, turned))
    assert one == two


# ---- 7 ---------------------------------------------------------------------------------------

def plain_join(rows):
    sets, links, groups = [], Counter(), Groups()
    for k, (_, t) in enumerate(rows):
        ws = words((t or "").encode())
        sets.append({tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    for a in range(len(rows)):
        groups.find(a)
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[groups.find(k)].append(i)
    def least(k):
        return min((i for i in ids[groups.find(k)] if i is not None), default=None)
    return sorted(((i, least(k), links[k]) for k, (i, _) in enumerate(rows)), key=str), len(ids)


def near_rows(seed=3):
    rng = random.Random(seed)
    texts = [" ".join(some_words(rng, rng.randint(1, 120))) for _ in range(150)]
    base, passage = some_words(rng, 150), some_words(rng, 60)
    texts += [" ".join(altered(rng, base, rng.randint(0, 6))) for _ in range(120)]         # one large near group
    texts += [" ".join(passage + some_words(rng, rng.randint(5, 80))) for _ in range(120)]  # a passage many share
    for _ in range(40):
        t = some_words(rng, rng.randint(6, 80))
        texts += [" ".join(t), " ".join(altered(rng, t, 1)), " ".join(t).upper() + "!"]
    texts += ["same copy of a text"] * 30 + ["two words", "Two, words", "", "", "--"]
    rows = list(enumerate(texts)) + [(10_000, None), (None, texts[0]), (None, "null id and its own words here"), (3, texts[3]), (3, texts[9])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket,block", [(64, 1024), (8, 16)])
def test_jaccard_equals_brute_force(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cls string")
    want, n_groups = plain_join(rows)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(df).collect()), key=str)
    assert got == want
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and kept.count() == n_groups


def test_jaccard_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(none).count() == 0 and jaccard.keep_one(none).count() == 0
    one = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(one).collect())) == [(1, 1, 0), (2, 2, 0)]


def test_promised_recall():
    assert jaccard.expected_recall() > 0.9999
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(300):
        x = np.unique(rng.integers(0, 2 ** 63, 90).astype(np.uint64))
        a, b = x[:85], np.concatenate([x[10:85], x[85:]])  # just above the threshold
        met += any(set(p) & set(q) for p, q in zip(jaccard.draws(a)[::jaccard.LEVELS], jaccard.draws(b)[::jaccard.LEVELS]))
    assert met == 300


# ---- 8 ---------------------------------------------------------------------------------------

def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(9)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert lines.distance(a, b) == plain_distance(a, b)


def plain_word_hash(word):
    """The definition of hashes.word_hashes, on whole numbers."""
    m = hashes.mixed(np.array([5], dtype=np.uint64), 3)[0] | np.uint64(1)
    total = sum(int(hashes.VALUES[b]) * pow(int(m), i, 2 ** 64) for i, b in enumerate(word)) + len(word)
    return int(hashes.mixed(np.array([total % 2 ** 64], dtype=np.uint64), 5)[0])


def test_word_hashes():
    rng = random.Random(6)
    ws = [bytes(rng.choice(b"abz09\xc3\xa9") for _ in range(rng.choice([1, 5, 63, 64, 65, 900]))) for _ in range(80)]
    got, starts = hashes.word_hashes(b"  " + b" \n".join(ws) + b" ")
    assert got.tolist() == [plain_word_hash(w) for w in ws] and len(set(starts)) == len(ws)
    assert hashes.word_hashes(b" \n ")[0].tolist() == [] and hashes.word_hashes(b"")[0].tolist() == []
    size = np.array([3, 1, 76])
    one = hashes.sequence_hashes(got, size)
    two = hashes.sequence_hashes(got[4:], np.array([76]))
    assert [x[2] for x in one] == [x[0] for x in two] and one[0][0] != one[1][0]
    swapped = hashes.sequence_hashes(got[[1, 0, 2]], np.array([3]))
    assert swapped[0][0] != one[0][0] and swapped[1][0] != one[1][0]


def plain_dedup(rows):
    """Rows left, as (id, text), by comparing all lines with all."""
    docs = list(dict.fromkeys(rows))
    keys, groups = {}, Groups()
    for d, (i, t) in enumerate(docs):
        for p, x in enumerate((t or "").split("\n")):
            ws = words(x.encode())
            if len(ws) >= lines.MIN_WORDS:
                keys.setdefault(tuple(ws), []).append((d, p))
    by_length = defaultdict(list)
    for a in keys:
        groups.find(a)
        by_length[len(a)].append(a)
    for a in keys:
        for n in range(len(a), int(len(a) / lines.SIMILAR) + 2):  # longer ones can't be near-equal
            most = (1 - lines.SIMILAR) * max(len(a), n) + 1e-9
            for b in by_length.get(n, ()):
                # words that only one of the two has: an edit changes at most two
                if (len(a), a) < (n, b) and ((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).total() <= 2 * most \
                        and plain_distance(a, b) <= most:
                    groups.join(a, b)
    where = defaultdict(list)
    for k, v in keys.items():
        where[groups.find(k)] += v
    gone = defaultdict(set)
    def order(x):
        return docs[x[0]][0] is not None, docs[x[0]][0] or 0, x[1]
    for v in where.values():
        for d, p in sorted(v, key=order)[1:]:
            gone[d].add(p)
    return sorted(((i, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[d]))
                   for d, (i, t) in enumerate(docs)), key=str)


def line_rows(seed=8):
    rng = random.Random(seed)
    hot, long = "We use cookies on this site", " ".join(some_words(rng, 90))
    rows = []
    for i in range(160):
        text = [" ".join(some_words(rng, rng.randint(1, 40))) for _ in range(rng.randint(0, 4))]
        text += [hot.upper() + "."] * (i % 3 == 0) + [" ".join(altered(rng, long.split(), rng.randint(0, 2)))] * (i % 2)
        rng.shuffle(text)
        rows.append((i, "\n".join(text)))
    return rows + [(500, None), (501, ""), (502, "\n\n"), (7, rows[7][1]), (None, "a line with a null id"), (503, "a b\na b")]


@pytest.mark.parametrize("block", [1024, 8])
def test_lines_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    rows = line_rows()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_lines int, KEY string")
    got = lines.dedup_lines(df).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == plain_dedup(rows)
    assert all(r.n_removed >= 0 for r in got) and sum(r.n_removed for r in got) > 100


def edited(rng, ws, n):
    """n words replaced, left out or put in."""
    ws = list(ws)
    for _ in range(n):
        k, at = rng.randrange(3), rng.randrange(len(ws))
        ws[at:at + (k > 0)] = [f"w{rng.randint(0, 400)}"] * (k < 2)
    return ws


@pytest.mark.parametrize("block", [1024, 8])
def test_all_similar_lines_are_found(spark, monkeypatch, block):
    """As comparing all lines with all."""
    monkeypatch.setattr(lines, "BLOCK", block)
    monkeypatch.setattr(lines, "SAMPLE", 4)
    rng, rows = random.Random(12), []
    phrase = some_words(rng, 6)
    for i in range(36):
        ws = some_words(rng, rng.choice([8, 9, 10, 11, 19, 20, 29, 30, 60, 100])) + phrase * (i % 3 == 0)
        rows += [(4 * i, " ".join(ws)), (4 * i + 1, " ".join(edited(rng, ws, len(ws) // 10))),
                 (4 * i + 2, " ".join(edited(rng, ws, len(ws) // 9))), (4 * i + 3, " ".join(edited(rng, ws, 1 + len(ws) // 9)))]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == plain_dedup(rows)
    assert sum(r.n_removed for r in got) > 40


@pytest.mark.parametrize("least", [0.9, 0.95, 0.8, 0.75, 0.5])
def test_similar_lines_share_blocks(least):
    rng, met = random.Random(13), 0
    none = np.zeros(0, dtype=np.uint64)
    for _ in range(1500):
        a = [f"w{rng.randint(0, 30)}".encode() for _ in range(rng.choice([3, 9, 10, 19, 20, 40, 90]))]
        b = [w.encode() for w in edited(rng, [w.decode() for w in a], max(1, int((1 - least) / least * len(a))))]
        if not b or a == b or not lines.similar(a, b, least):
            continue
        one, size = hashes.word_hashes(b" ".join(a + b))[0], np.array([len(a), len(b)])
        value = np.unique(lines.run_values(one, size, least)[1])[::3]
        for common in ((none, none), (value, np.arange(len(value), dtype=np.uint64) + np.uint64(2))):
            count, keys = lines.blocks(one, size, least, common)
            assert set(keys[:count[0]]) & set(keys[count[0]:])
        x, y = lines.parities(one, size)
        assert int(x ^ y).bit_count() <= 2 * plain_distance(a, b)
        met += 1
    assert met > 100


def test_lines_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(none).count() == 0


def test_log_odds_shrink_rare_units():
    odds, z, _ = toxicity.log_odds(np.array([[50.0, 0.0], [2.0, 0.0], [50.0, 500.0]]), np.array([10_000.0, 100_000.0]))
    assert z[0] > toxicity.CLEAR > z[1] and abs(odds[2]) < 0.01 and math.isfinite(odds[1])


def test_line_code_travels_without_the_repository():
    """What tasks get names no module of this repository, so executors need no copy of it."""
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle
    none = np.zeros(0, dtype=np.uint64)
    sent = cloudpickle.dumps((lines.line_hashes, ([b"some words of a line\nmore of these words here", None], 3, 0.9, (none, none))))
    code = "import pickle, sys; f, a = pickle.load(sys.stdin.buffer); print([x.tolist() for x in f(*a)])"
    done = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd="/", env={"PATH": ""})
    assert done.returncode == 0, done.stderr.decode()
    f, a = pickle.loads(sent)
    assert done.stdout.decode().strip() == str([x.tolist() for x in f(*a)])


def test_lines_that_meet_again_come_under_one_name():
    """Buckets whose first marked line is the same are one place: a pair isn't compared in each bucket it shares."""
    import pyarrow as pa
    rng = random.Random(5)
    words_ = [f"w{k}" for k in range(400)]
    long = [rng.sample(words_, 100) for _ in range(8)]
    texts = [long[0], long[0][:99] + ["x"], long[0][:50] + ["y"] + long[0][51:], *long[1:]]
    one, size = hashes.word_hashes("\n".join(map(" ".join, texts)).encode())[0], np.array([len(t) for t in texts])
    odd, odd2 = (lines.parities(one, size, half).view(np.int64) for half in (0, 1))
    # two buckets share the first two lines, and the second has the third one too
    places = [(5, k) for k in (0, 1, *range(3, 7))] + [(9, k) for k in (0, 1, 2, *range(7, 10))]
    at = [k for _, k in places]
    none = pa.array(np.zeros(len(places), dtype=np.int32))
    rows = pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in places]), none, none, none, pa.array(np.ones(len(places), dtype=np.int32)),
         pa.array(size[at].astype(np.int32)), pa.array(odd[at]), pa.array(odd2[at]), pa.array(at)],
        names=[*lines.PLACE, "block", "many", "n", "odd", "odd2", "id"])
    for parts in ([rows], [rows.slice(0, 3), rows.slice(3, 5), rows.slice(8)]):
        got = pa.Table.from_batches(list(lines.partners(0.9)(iter(parts))))
        assert sorted(got.column("id").to_pylist()) == [0, 0, 1, 1, 2]  # long lines that differ aren't marked
        assert len(set(got.column("key").to_pylist())) == 1


def test_bounded_edit_distance():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.randint(0, 5) for _ in range(rng.randint(12, 30))]
        b = edited(rng, [str(x) for x in a], rng.randint(0, 6)) if rng.random() < 0.7 else [str(rng.randint(0, 5)) for _ in range(20)]
        a = [str(x) for x in a]
        for most in (0, 1, 3, 8):
            assert lines.within(a, b, most) == (plain_distance(a, b) <= most)
            one, two = lines.signatures([" ".join(x).encode() for x in (a, b)])
            if lines.within(a, b, most):
                assert np.bitwise_count(one[0] ^ one[1]).sum() <= 2 * most and np.bitwise_count(two[0] ^ two[1]).sum() <= 4 * most
