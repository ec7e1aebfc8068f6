"""Clusters, filter audits and token ids against plain versions, and their defined edge cases."""

import hashlib
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from plantwatch.llm import bpe, centroids, filter_audit

# ---- 11 --------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) by comparing with every centroid."""
    kept = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    name = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    centre = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centre]
            out.append((i, d.index(min(d)), min(d), v))
        return out
    for _ in range(rounds):
        found = assign()
        for c in range(len(centre)):
            mine = [v for _, b, _, v in found if b == c]
            if mine:
                centre[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    per = [sum(d for _, b, d, _ in found if b == c) for c in range(len(centre))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    fit = lambda n: n if n < 2 ** 63 else None
    return [(i, c, fit(d), fit(per[c]), fit(sum(per)), digest[c]) for i, c, d, _ in found]


def vectors(seed, n, scale=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.3, (5, 64))
    return [(i, (scale * (middle[i % 5] + rng.normal(0, 0.05, 64))).astype(np.float32).astype(float).tolist()) for i in range(n)]


def clustered(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows],
                               f"vec_id long, embedding array<{kind}>, cluster string, DISTANCE int")
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[n] for n in names) for r in centroids.cluster(df).collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rows = vectors(1, 120)
    rows += [(200, None), (201, []), (202, [0.1] * 63), (203, [0.1] * 63 + [None]), (204, [0.1] * 63 + [math.nan]),
             (205, [math.inf] + [0.1] * 63), (None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1])]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # copies: equal distances and equal first centroids
    assert clustered(spark, rows) == sorted(plain_clusters(rows), key=str)


@pytest.mark.parametrize("rows", [[], vectors(2, 3), [(i, [0.5] * 64) for i in range(20)], [(1, None)]])
def test_few_and_equal_vectors(spark, rows):
    assert clustered(spark, rows) == sorted(plain_clusters(rows), key=str)


def test_large_components_stay_exact(spark):
    rows = vectors(3, 30, 1e6) + [(100, [1e6] * 64), (101, [-1e6] * 64)]
    assert clustered(spark, rows) == sorted(plain_clusters(rows), key=str)
    rows = vectors(3, 30, 1e9)  # squared distances beyond 64 bits are null
    got = clustered(spark, rows)
    assert got == sorted(plain_clusters(rows), key=str) and any(r[3] is None for r in got)


def test_tournament_finds_the_nearest_and_smallest():
    rng = np.random.default_rng(5)
    for k in (1, 2, 8):
        centre = rng.integers(-3, 4, (k, 6))
        centre[-1] = centre[0]
        x = rng.integers(-3, 4, (500, 6))
        d = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2)
        assert (centroids.Planes(centre.tolist(), False).nearest(x) == d.argmin(axis=1)).all()


# ---- 12 --------------------------------------------------------------------------------------

def plain_audit(docs, labels):
    """Every order applied filter by filter to every document."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, t, lang in docs:
        t = t or ""
        ws = word.findall(t)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append({f for f, bad in zip("ABCDE", (
            len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search("[#$%&*|]", t)), smaller)) if bad})
    out = []
    for part in {lang or "" for _, _, lang in docs}:
        mine = [(i, f) for (i, _, lang), f in zip(docs, fails) if (lang or "") == part]
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                total[name] += len(gone)
                failing = sum(name in f for _, f in mine)
                rows.append([part, "".join(order), step, len(left), len(gone), failing - len(gone),
                             sum(f == {name} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name])
        out += [(*r[:-1], total[r[-1]]) for r in rows]
    return sorted(out)


def audit_rows(seed=4):
    rng = random.Random(seed)
    docs = []
    for i in range(90):
        n = rng.choice([0, 3, 99, 100, 101, 150])
        ws = [rng.choice(["Word", "word", "WORD", "é", "x#", "x"]) + str(rng.randint(0, 400 if i % 2 else 30)) for _ in range(n)]
        docs.append((i, " ".join(ws), rng.choice(["en", "de", None, ""])))
    docs += [(rng.randint(0, 200), docs[k][1], rng.choice(["en", "fr"])) for k in range(30)]
    docs += [(5, docs[5][1], "en"), (5, docs[5][1], "en"), (None, docs[6][1], "en"), (None, docs[6][1], None), (-1, None, "en"), (500, None, "en"),
             (501, "", "de"), (502, " \n\t", "de"), (503, "A\x0bB\x0cC D", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(-1, 120)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    return docs, labels


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_brute_force(spark):
    docs, labels = audit_rows()
    d = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, lang string, n int, MASK string")
    got = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(tuple(r[c] for c in AUDIT) for r in got) == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a text", "en")], docs.schema)
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and {r.shapley for r in rows if r.filter_order[r.step - 1] == "A"} == {120}


# ---- 13 --------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


BITS = ["a", "b", " ", "  ", "\n", "é", "ß", "1", "2", "'", "'s", "'ll", ".", "#", "日", "本", "<|endoftext|>", "<|endof", "՘", "​", "\x1c",
        "\x85", "　", "the", "ing", "Ġ", "\U0003fc3f", "\U00011de0", "\x00", "�", "\U0001f600"]


def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", " " * 70_000 + "a", "\n" * 70_000 + " b", "x" * 50_000, "ab1" * 20_000, "<|endoftext|>" * 300, "é" * 20_000, " a" * 30_000]
    return texts


def test_tokens_equal_the_library(vocabulary, library):
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = list(encoder.ids(text))
        assert got == want, text[:80]
        assert decoder.decoded(got) == text == library.decode(want, skip_special_tokens=False)


def test_long_pieces_in_small_steps(vocabulary):
    """Tokens that leave the buffer are those of the whole piece."""
    rng = random.Random(2)
    whole, small = bpe.Encoder(vocabulary, step=1 << 20), bpe.Encoder(vocabulary, step=500)
    for k in range(12):
        piece = "".join(rng.choice("abcdefghinrst" if k % 3 else "ae") for _ in range(6000)) if k % 2 else rng.choice(["the", "ation", "=", "-", "_ "]) * 2000
        data = piece.encode()
        got = list(small.stream(data[i:i + 500] for i in range(0, len(data), 500)))
        assert got == whole.merged(data)


def test_lookahead_bounds_what_a_continuation_changes(vocabulary):
    """For merges with long chains: prefixes of random texts keep their tokens up to the lookahead."""
    merges = [(b"a", b"a"), (b"b", b"a"), (b"aa", b"b"), (b"ba", b"aa"), (b"a", b"b"), (b"ab", b"ab")]
    far = bpe.lookahead(merges)
    made = Plain(merges)
    rng, tight = random.Random(3), 0
    for _ in range(3000):
        text = "".join(rng.choice("ab") for _ in range(30)).encode()
        cut = rng.randint(far + 1, 29)
        ends = lambda ts: {sum(map(len, ts[:k + 1])) for k in range(len(ts))}
        a, b = ends(made.tokens(text[:cut])), ends(made.tokens(text))
        assert {e for e in a if e < cut - far} == {e for e in b if e < cut - far}
        tight += any((e in a) != (e in b) for e in range(max(1, cut - 3), cut))
    assert tight and 2 <= far < 20 and vocabulary.lookahead == bpe.lookahead(vocabulary.merges)


class Plain:
    """Merges applied one after the other, each from left to right."""

    def __init__(self, merges):
        self.merges = merges

    def tokens(self, text):
        ts = [text[i:i + 1] for i in range(len(text))]
        for u, v in self.merges:
            out = []
            for t in ts:
                if out and out[-1] == u and t == v and not (len(out) > 1 and False):
                    out[-1] = u + v
                else:
                    out.append(t)
            ts = out
        return ts


def test_decoding_any_ids(vocabulary, library):
    rng, decoder = random.Random(4), bpe.Decoder(vocabulary, step=3)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 25))]
        assert decoder.decoded(ids) == library.decode(ids, skip_special_tokens=False)


def test_vocabularies_that_are_not_plain():
    with open("/opt/tokenizers/word_bpe_49k.json", "rb") as f, pytest.raises(ValueError):
        bpe.Vocabulary(f.read())


def test_round_trip_on_spark(spark, library):
    rows = [(i, t, "x", [1]) for i, t in enumerate(odd_texts()[-300:])] + [(1000, None, "n", None), (7, "again", "x", None), (7, "again", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, DECODED string, ids array<int>")
    got = bpe.round_trip(df)
    assert got.columns == ["doc_id", "text", "ids", "decoded"] and got.count() == len(rows)
    for r in got.collect():
        assert r.decoded == (r.text or "") and r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.round_trip(df.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(df))
    assert all(r.decoded == (r.text or "") for r in back.collect())
    lists = spark.createDataFrame([(1, None), (2, []), (3, [None, 99_999_999, 64])], "k int, ids array<int>")
    assert [r.decoded for r in bpe.decode(lists).orderBy("k").collect()] == ["", "", "a"]


def test_query_digests(spark, sf, library):
    from plantwatch.llm.catalog import QUERIES
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op13_bpe"](spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
