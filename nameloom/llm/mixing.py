"""Mixing sources to target shares of tokens (problem 9).

Tokens are counted once a document and kept in a table. From the tokens of each
source follows its repetition rate for the wanted total; a document is emitted
floor(rate) times and once more if a hash of its identifier and a seed falls below
the fraction. Every document is decided on its own, so the draw needs no order, no
shuffle and is the same on every run.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameloom.operators import scratch

#: Where a vocabulary lies unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that cuts text before byte-pair merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest piece handed to the tokenizer at once; a longer text is cut at white space or before punctuation, or in the middle of a run that has none.
PIECE = 100_000
#: Places where no token of PATTERN can reach across: the last white space before a word, and the end of a word.
_CUT = re.compile("[ \\t\\n\\r\u3000](?=\\S)|(?<=[^\\W_])(?=[^\\w\\s])")


def pieces(text: str, longest: int = PIECE) -> Iterator[str]:
    """The text in pieces of at most `longest` characters that have together as many tokens as the whole, unless a run without a place to cut is longer."""
    at = 0
    while len(text) - at > longest:
        end = max((m.start() for m in _CUT.finditer(text, at + 1, at + longest + 1)), default=at + longest)
        yield text[at:end]
        at = end
    yield text[at:]


def count_tokens(df: DataFrame, text: str, vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of a text column; null and empty texts have none. The vocabulary file must lie on every node."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        at = names.index(text)
        for batch in batches:
            counts = [sum(len(enc.encode_ordinary(p)) for p in pieces(t or "")) for t in batch.column(at).to_pylist()]
            cols = [batch.column(i) for i in range(len(names)) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=[*(n for n in names if n != text), out])

    schema = df.drop(text).withColumn(out, F.lit(0).cast("bigint")).schema
    return df.mapInArrow(run, schema)


def rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, tokens, rate): how often a document of each source is to be emitted.

    sizes: source, tokens. targets: source, target_share, max_repeats. total: the
    tokens wanted; without it, or if it is more, the most that the caps allow with
    every share met: the smallest of max_repeats * tokens / target_share. A source
    with a share but without tokens has rate 0 and sets no bound; one with a null
    or zero share is not used; a null cap is 1. The targets are a handful of rows
    and are aggregated; one number reaches the driver.
    """
    t = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    known = t.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    most = known.where("tokens > 0").agg(F.min(F.col("cap") * F.col("tokens") / F.col("target_share"))).first()[0] or 0.0  # one number
    wanted = float(most if total is None else min(most, total))
    rate = F.when(F.col("tokens") > 0, F.least(F.col("cap").cast("double"), F.col("target_share") * F.lit(wanted) / F.col("tokens"))).otherwise(F.lit(0.0))
    return known.select("source", "target_share", "tokens", rate.alias("rate"))


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1, vocabulary: str = VOCABULARY, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens, copy_no): one row for each emitted copy, copy_no from 1.

    Documents with a null or unknown source are not used. Texts that repeat under
    different ids are different documents; a null id has its own draw by its text
    size. No document appears more than its source's max_repeats times.
    """
    counted = scratch.write(count_tokens(docs.select(F.col(ident).alias("doc_id"), "source", F.col(text).alias("_text")), "_text", vocabulary), "token-counts").df
    sizes = counted.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    plan = scratch.write(rates(sizes, targets, total), "rates").df  # one row a source of the targets
    draw = F.pmod(F.xxhash64("doc_id", "n_tokens", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    times = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    chosen = counted.join(F.broadcast(plan.select("source", "rate")), "source").withColumn("_times", times.cast("int")).where("_times > 0")
    return chosen.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy_no"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, copies, tokens, actual_share) of a mix, for every source of the targets."""
    per = mixed.groupBy("source").agg(F.sum(F.when(F.col("copy_no") == 1, 1).otherwise(0)).alias("documents"), F.count(F.lit(1)).alias("copies"), F.sum("n_tokens").alias("tokens"))
    every = per.agg(F.sum("tokens")).first()[0] or 0  # one number
    named = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share")).join(per, "source", "left").na.fill(0, ["documents", "copies", "tokens"])
    return named.withColumn("actual_share", F.when(F.lit(every) > 0, F.col("tokens") / F.lit(every)))
