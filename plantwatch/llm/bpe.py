"""13. Byte pair encoding and decoding as streaming transducers.

Encoding reads a text from left to right. A split pattern cuts it into pieces (added
tokens are cut out before); within a piece merges apply, lowest rank first, leftmost
first. Whether two neighbouring bytes end in one token depends on bytes to their right
only within the merge list's sufficient lookahead (`lookahead`): a merge can differ
between two continuations only if its right side reaches their difference, directly or
through a chain of earlier merges, each starting where the one before ends. The longest
such chain bounds the distance. So a piece is held in a buffer; tokens that end farther
than the lookahead from what has been read are stable and leave it, and the buffer keeps
a bounded number of bytes, however long the piece.

Decoding is a state machine from bytes to text: tokens give bytes, and an incomplete
character waits for the next token. Bytes that are no UTF-8 become U+FFFD.

The vocabulary is a file of the `tokenizers` library with byte-level splits; anything the
transducer doesn't know (normalizers, dropout, merges of tokens that no earlier merge
makes) raises ValueError. Its bytes (at most `MAX_VOCABULARY`) are broadcast.

Defined cases: null and empty texts have no tokens and decode to the empty text; bytes
that are no UTF-8 are replaced before encoding; a null list of ids decodes to the empty
text, null and unknown ids in a list to nothing; columns named like a result are replaced;
rows are independent, so repeats and empty tables need no care.
"""

from __future__ import annotations

import codecs
import json
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from plantwatch.llm.catalog import query
from plantwatch.llm.rows import append, col, raw, read, shared, without

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
MAX_VOCABULARY = 16 << 20
WINDOW = 1 << 14   # characters split at once
STEP = 1 << 13     # bytes of a long piece added to the buffer at once
SHORT = 64         # characters of a piece whose tokens are remembered
REMEMBERED = 1 << 18  # pieces; as many again that were met before those

# Letters and numbers that Unicode has only since the version the vocabulary's
# split pattern goes by; there they are neither.
LATE_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")
LATE_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"


def split_pattern(letter: str, number: str, other: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"


#: Bytes of texts that can't hold such a character.
EARLY_BYTES = bytes(range(0xD5))
#: For texts without and with such characters (both give the same where there are none).
PLAIN = regex.compile(split_pattern(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"))
CAREFUL = regex.compile("(?V1)" + split_pattern(
    rf"[\p{{L}}--[{LATE_LETTERS}]]", rf"[\p{{N}}--[{LATE_NUMBERS}]]",
    rf"[[^\s\p{{L}}\p{{N}}]||[{LATE_LETTERS}{LATE_NUMBERS}]]"))
#: White space after something else always begins a piece: the last such place.
LAST_EDGE = regex.compile(r"(?r)\S(?=\s)")


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable ones for themselves, the
    others by number from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right of a token boundary that decide about it, whatever follows them.

    A merge (u, v) at a boundary can differ between two continuations of the text only if v
    reaches what differs. Then a boundary inside v or at its end differs by an earlier merge
    whose left side is a token that ends there and begins inside v, and so on. Going through
    the merges in order, `far` keeps for each left side how far from the difference such a
    merge can stand; the farthest is the lookahead.
    """
    far: dict[bytes, int] = {}
    most = 0
    for u, v in merges:
        reach = len(v)
        for end in range(1, len(v) + 1):
            for begin in range(end):
                before = far.get(v[begin:end])
                if before is not None and before + end > reach:
                    reach = before + end
        far[u] = max(reach, far.get(u, 0))
        most = max(most, reach)
    return most


class Vocabulary:
    """Merges and tokens of a vocabulary file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        self._check(spec)
        model, to_byte = spec["model"], byte_of_char()
        ids = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in to_byte for c in t)}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merges = [tuple(bytes(to_byte[c] for c in side) for side in p) for p in pairs]
        made = {bytes([b]) for b in range(256)}
        for u, v in self.merges:
            if u not in made or v not in made or u + v in made:
                raise ValueError("every merge must join tokens of earlier merges to a new one")
            made.add(u + v)
        self.first = [ids[bytes([b])] for b in range(256)]
        self.rank = {(ids[u], ids[v]): k for k, (u, v) in enumerate(self.merges)}
        self.joined = [ids[u + v] for u, v in self.merges]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text = {i: t for t, i in ids.items()}
        for t, i in self.added.items():
            self.text[i] = bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode()
        self.lookahead = lookahead(self.merges)

    @staticmethod
    def _check(spec: dict) -> None:
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        decoder = spec.get("decoder") or {}
        plain = (model.get("type") == "BPE" and split.get("type") == decoder.get("type") == "ByteLevel"
                 and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                    "fuse_unk", "byte_fallback", "ignore_merges"))
                 and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")))
        if not plain:
            raise ValueError("only plain byte-level merge lists are supported")


class Encoder:
    """Text to ids, for use in tasks."""

    def __init__(self, vocabulary: Vocabulary, step: int = STEP, window: int = WINDOW):
        self.first, self.rank, self.joined, self.text = vocabulary.first, vocabulary.rank, vocabulary.joined, vocabulary.text
        self.lookahead, self.added, self.window = vocabulary.lookahead, vocabulary.added, window
        self.step = step
        special = sorted(self.added, key=lambda t: (-len(t), t))
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known = Known(self)

    def merged(self, data: bytes) -> list[int]:
        """Tokens of a buffer: the pair of lowest rank, then leftmost, is joined until none is left."""
        ids = [self.first[b] for b in data]
        return self._few(ids) if len(ids) < 24 else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        rank, joined, none = self.rank.get, self.joined, len(self.joined)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at:at + 2] = [joined[best]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), none)
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), none)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links between neighbours."""
        rank, joined, n = self.rank, self.joined, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapify(heap)
        while heap:
            k, i, pair = heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue  # one of the two has been joined since
            ids[i], ids[j] = joined[k], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    p = (ids[left], ids[after[left]])
                    if p in rank:
                        heappush(heap, (rank[p], left, p))
        return [t for t in ids if t >= 0]

    def stream(self, parts) -> "array":
        """Tokens of one piece that comes in parts of bytes; holds a buffer of bounded size."""
        out, held = array("i"), b""
        for part in parts:
            held += part
            if len(held) < self.step + self.lookahead:
                continue
            stable, end = len(held) - self.lookahead, 0
            for token in self.merged(held):
                if end + len(self.text[token]) >= stable:
                    break
                end += len(self.text[token])
                out.append(token)
            held = held[end:]
        out.extend(self.merged(held))
        return out

    def long(self, text: str, begin: int, end: int) -> "array":
        """Tokens of the piece text[begin:end], read in steps."""
        return self.stream(text[at:min(end, at + self.step)].encode() for at in range(begin, end, self.step))

    def ids(self, text: str) -> "array":
        out, at = array("i"), 0
        if self.special is not None:
            for m in self.special.finditer(text):
                self._plain(text[at:m.start()], out)
                out.append(self.added[m.group()])
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def _plain(self, text: str, out: "array") -> None:
        """Add the tokens of a text without added tokens, window by window."""
        pattern = CAREFUL if not text.isascii() and text.encode().translate(None, EARLY_BYTES) else PLAIN
        at, n, tokens = 0, len(text), self.known.__getitem__
        while at < n:
            edge = n if n - at <= self.window else 0
            if not edge:
                found = LAST_EDGE.search(text, at, at + self.window)
                edge = found.end() if found else 0
            if edge:
                out.extend(chain.from_iterable(map(tokens, pattern.findall(text, at, edge))))
                at = edge
                continue
            limit = at + self.window  # white space, or none: pieces one by one
            for m in pattern.finditer(text, at):
                begin, at = m.span()
                out.extend(self.long(text, begin, at) if at - begin > self.step else tokens(m.group()))
                if at >= limit:
                    break


class Known(dict):
    """Tokens of short pieces, as far as remembered: those met lately, and before those."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str):
        if len(piece) > SHORT:
            return self.encoder.long(piece, 0, len(piece))
        found = self.older.get(piece)
        if found is None:
            found = tuple(self.encoder.merged(piece.encode()))
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class Decoder:
    """Ids to text: bytes of an incomplete character wait for the next token."""

    def __init__(self, vocabulary: Vocabulary, step: int = WINDOW):
        self.bytes_of, self.step = vocabulary.text, step

    def parts(self, ids):
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), self.step):
            yield machine.decode(b"".join([self.bytes_of.get(i, b"") for i in ids[at:at + self.step]]))
        yield machine.decode(b"", True)

    def decoded(self, ids) -> str:
        return "".join(self.parts(ids))


def coder(spark, vocabulary: str = VOCABULARY):
    """A function that gives a task its encoder and decoder, read from the vocabulary once."""
    with open(vocabulary, "rb") as f:
        content = f.read(MAX_VOCABULARY + 1)
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY} bytes")
    sent, held = shared(spark, Vocabulary(content)), []

    def get() -> tuple[Encoder, Decoder]:
        if not held:
            held.append((Encoder(sent()), Decoder(sent())))
        return held[0]
    return get


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DECODED = T.StructField("decoded", T.StringType())


def lists(rows: list) -> pa.Array:
    """Arrays of 32-bit ids as one Arrow column."""
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(chain.from_iterable(rows), pa.int32(), size=ends[-1]))


def text_of(data: bytes | None) -> str:
    return data.decode("utf-8", "replace") if data else ""


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """`docs` with `ids`, the tokens of the whole text."""
    get = coder(docs.sparkSession, vocabulary)
    return append(docs, [raw("text")], T.StructType([IDS]),
                  lambda texts: [lists([get()[0].ids(text_of(t)) for t in texts])], keep)


def decode(df: DataFrame, vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """`df` (with `ids`) with `decoded`, their text."""
    get = coder(df.sparkSession, vocabulary)
    return append(df, [col("ids").cast("array<int>")], T.StructType([DECODED]),
                  lambda rows: [[get()[1].decoded(r or ()) for r in rows]], keep)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """`docs` with `ids` and the text `decoded` from them, in one pass."""
    get = coder(docs.sparkSession, vocabulary)

    def run(texts):
        encoder, decoder = get()
        ids = [encoder.ids(text_of(t)) for t in texts]
        return [lists(ids), [decoder.decoded(i) for i in ids]]
    return append(docs, [raw("text")], T.StructType([IDS, DECODED]), run,
                  without(docs.select(*[col(c) for c in (keep or docs.columns)]), ("ids", "decoded")))


@query("op13_bpe")
def op13_bpe(spark, sf_dir: str) -> DataFrame:
    docs = round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
