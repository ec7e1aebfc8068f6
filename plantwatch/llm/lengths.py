"""10. Exact histogram of encoded lengths, and what every context limit would keep.

Documents are encoded whole with a public vocabulary and counted by length; the
histogram has one row per distinct length, whatever the number of documents.
Suffix sums over it answer totals, quantiles and truncated totals for every
limit. Sums run inside blocks of lengths plus block totals, so no task sorts the
whole histogram.

Defined cases: null and empty texts have length 0 and count as documents; bytes
that are no UTF-8 are replaced before encoding; an empty table gives no rows; white space
runs of any length are pieces of their own, counted apart from the text around them.
The vocabulary's bytes (at most `MAX_VOCABULARY`) are broadcast.
"""

from __future__ import annotations

import base64
import re

import tiktoken
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plantwatch.llm.catalog import query
from plantwatch.llm.rows import append, raw, read, shared
from plantwatch.session import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY = 16 << 20
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space (as the pattern has it) that is too long for the pattern's matcher.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
BLOCK = 64
LIMITS = (512, 1024, 2048, 4096, 8192, 32768)


def counter(spark, vocabulary: str = VOCABULARY):
    """A function from UTF-8 bytes to the number of tokens, for use in tasks."""
    with open(vocabulary, "rb") as f:
        content = f.read(MAX_VOCABULARY + 1)
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY} bytes")
    content, held = shared(spark, content), []

    def count(text: bytes | None) -> int:
        if not held:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content().splitlines())}
            held.append(tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
        return counted(held[0], text.decode("utf-8", "replace")) if text else 0
    return count


def counted(encoding, text: str) -> int:
    """Number of tokens. A long run of white space is one piece, but for its last character where more follows."""
    n, at = 0, 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        n += len(encoding.encode_ordinary(text[at:m.start()])) + len(encoding._encode_single_piece(text[m.start():end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:] if at else text))


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with `n_tokens`."""
    count = counter(docs.sparkSession, vocabulary)
    return append(docs, [raw("text")], T.StructType([T.StructField("n_tokens", T.LongType())]),
                  lambda texts: [[count(t) for t in texts]])


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(length, docs): exact counts of documents by encoded length."""
    return (encoded_lengths(docs.select("text"), vocabulary)
            .groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("docs")))


def curve(hist: DataFrame) -> DataFrame:
    """Per length L: docs, docs_at_least (length >= L), tokens_at_least, docs_up_to, tokens_up_to,
    truncated_total (tokens kept if every document is cut at L) and quantile (share of documents
    up to L). `hist` is read more than once; store it."""
    hist = hist.withColumn("_block", F.floor(F.col("length") / BLOCK)).withColumn("_tokens", F.col("length") * F.col("docs"))
    blocks = hist.groupBy("_block").agg(F.sum("docs").alias("_d"), F.sum("_tokens").alias("_t"))
    up = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per 64 lengths
    whole = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("_block", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(c + "_before") for c in ("_d", "_t")],
                           *[F.sum(c).over(whole).alias(c + "_all") for c in ("_d", "_t")])
    inside = Window.partitionBy("_block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    n, t = F.col("docs_up_to"), F.col("tokens_up_to")
    return (hist.join(blocks, "_block")
            .withColumn("docs_up_to", F.col("_d_before") + F.sum("docs").over(inside))
            .withColumn("tokens_up_to", F.col("_t_before") + F.sum("_tokens").over(inside))
            .select("length", "docs", (F.col("_d_all") - n + F.col("docs")).alias("docs_at_least"),
                    (F.col("_t_all") - t + F.col("_tokens")).alias("tokens_at_least"),
                    "docs_up_to", "tokens_up_to",
                    (t + F.col("length") * (F.col("_d_all") - n)).alias("truncated_total"),
                    (n / F.col("_d_all")).alias("quantile")))


def at_limits(hist: DataFrame, limits=LIMITS) -> DataFrame:
    """Per context limit: documents, tokens, documents that fit, tokens after cutting at the limit."""
    def sums(limit: int) -> list[Column]:
        fits = F.col("length") <= limit
        return [F.sum("docs").alias("docs"), F.sum(F.col("length") * F.col("docs")).alias("tokens"),
                F.sum(F.when(fits, F.col("docs")).otherwise(0)).alias("docs_that_fit"),
                F.sum(F.least("length", F.lit(limit)) * F.col("docs")).alias("truncated_total")]
    each = F.array(*[F.struct(F.lit(m).cast("long").alias("context_limit"), *sums(m)) for m in limits])
    return hist.agg(each.alias("_all")).select(F.explode("_all").alias("_one")).select("_one.*")


def length_at(hist: DataFrame, share: float) -> int | None:
    """The smallest length up to which at least `share` of the documents fall."""
    return curve(hist).where(F.col("quantile") >= share).agg(F.min("length")).first()[0]


@query("op10_lengths")
def op10_lengths(spark, sf_dir: str) -> DataFrame:
    return curve(stored(histogram(read(spark, sf_dir, "documents")), "lengths"))
