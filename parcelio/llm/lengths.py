"""Exact token counts: one histogram of encoded lengths answers every context limit."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelio.llm.shared import texts, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public vocabulary's texts are cut before merging (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of white space longer than this is encoded apart: the cutting pattern would exhaust the stack on it.
RUN_LENGTH = 100_000
_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % RUN_LENGTH)
#: Lengths that are summed together first, so that no window holds all lengths.
SPAN = 1 << 10


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    """The coder of a file of ranks."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(coder: tiktoken.Encoding, text: str) -> list[int]:
    """The text's token ids; a very long run of white space is no trouble.

    PATTERN takes such a run as one piece, but for its last character where
    something follows; so the run is merged alone and the rest goes on from
    that character.
    """
    found, done = [], 0
    for run in _RUN.finditer(text) if len(text) >= RUN_LENGTH else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        found += coder.encode_ordinary(text[done : run.start()]) + coder._encode_single_piece(text[run.start() : end])
        done = end
    return found + coder.encode_ordinary(text[done:])


def _lengths(vocabulary: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary, pattern)
        for batch in batches:
            many = np.fromiter((len(encode(coder, t.as_py() or "")) for t in batch.column("text")), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(many)], ["doc_id", "n_tokens"])

    return run


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The file of token ranks, some MB at most, read by Spark from any store."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`doc_id` and `n_tokens` of every row; null and empty texts have 0 tokens.

    Strings that look like special tokens are ordinary text. Texts may be of any
    length and hold runs of any length. Repeated rows are counted each; an empty
    table gives no rows; other columns are ignored.
    """
    ranks = read_vocabulary(docs.sparkSession, vocabulary)
    return texts(docs).mapInArrow(_lengths(ranks, pattern), "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, from a column `n_tokens`.

    `n_docs` and `total_tokens` of that length; `docs_at_least` and
    `tokens_at_least` of it and all greater ones; `truncated_total`, the tokens
    of all documents when each is cut to this length; `quantile`, the share of
    documents of at most this length. A null length is not counted. An empty
    table gives no rows.
    """
    rows = lengths.filter("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    rows = written(rows, "lengths")  # read twice below, so that texts are encoded once
    rows = rows.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("total_tokens"), F.floor(F.col("n_tokens") / SPAN).alias("span"))
    spans = rows.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("total_tokens").alias("t"))
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    spans = spans.select(
        "span",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(spans, "span").select(
        "n_tokens",
        "n_docs",
        "total_tokens",
        (F.sum("n_docs").over(within) + F.col("d_after")).alias("docs_at_least"),
        (F.sum("total_tokens").over(within) + F.col("t_after")).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    cut = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    up_to = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return rows.select(
        "n_tokens", "n_docs", "total_tokens", "docs_at_least", "tokens_at_least", cut.alias("truncated_total"), (up_to / F.col("all_docs")).alias("quantile")
    )


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """`context_limit`, `truncated_total` and `docs_cut` for any limits, from the histogram alone."""
    wanted = histogram.sparkSession.createDataFrame([(int(n),) for n in limits], "context_limit long")
    # A limit acts like the next length that occurs; beyond the last one nothing is cut.
    one = histogram.agg(
        *[F.sum(F.least("n_tokens", F.lit(int(n))) * F.col("n_docs")).alias(f"t{k}") for k, n in enumerate(limits)],
        *[F.sum(F.when(F.col("n_tokens") > int(n), F.col("n_docs")).otherwise(0)).alias(f"d{k}") for k, n in enumerate(limits)],
    ).first()
    found = [(int(n), one[f"t{k}"] or 0, one[f"d{k}"] or 0) for k, n in enumerate(limits)]
    answers = histogram.sparkSession.createDataFrame(found, "context_limit long, truncated_total long, docs_cut long")
    return wanted.join(answers.dropDuplicates(), "context_limit")


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> list[int | None]:
    """For each share the least length that at least this share of documents doesn't exceed."""
    least = [F.min(F.when(F.col("quantile") >= s, F.col("n_tokens"))) for s in shares]
    return list(histogram.agg(*least).first())
