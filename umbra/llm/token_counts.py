"""Exact histogram of encoded lengths, and what suffix sums over it answer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.common import materialise, whole_ids

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths per block of the two-level sums.
SPAN = 1024

_encoders: dict = {}


def _encoder(ranks: bytes):
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def _lengths(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks).encode_ordinary
        for batch in batches:
            # Nulls and empty texts have no tokens.
            n = [len(encode(text)) if (text := x.as_py()) else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, ranks_path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every document's whole text; null and empty texts have 0.

    Repeated rows each get a row, null ids stay null; texts of any length are
    encoded whole; other columns are not read; an empty table gives no rows. The
    vocabulary (of fixed size) is read by the driver and travels with the plan.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    rows = docs.select(whole_ids(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_lengths(ranks), "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per occurring length L, with its counts and the sums before and after it.

    length, n_docs, n_docs_le (documents of at most L tokens), n_docs_gt,
    total_tokens (of all documents), tokens_gt (all tokens of documents longer
    than L), truncated_total (tokens left if all are cut to L) and
    quantile (n_docs_le over all documents).

    Documents fold into the histogram before the shuffle, so a length that a
    third of all documents have is one row per task. Running sums go in two
    levels, over blocks of SPAN lengths and inside each, so that no task holds
    more lengths than a block or more rows than there are blocks. Repeated rows
    count each, null lengths and other columns don't; an empty table gives no rows.
    """
    hist = lengths.where("n_tokens IS NOT NULL").groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    hist = hist.withColumn("tokens", F.col("n_docs") * F.col("length")).withColumn("span", F.expr(f"length div {SPAN}"))
    hist = materialise(hist, "lengths")  # read twice, and small beside the texts that were encoded for it
    spans = hist.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("long")
    spans = spans.select("span", F.coalesce(F.sum("d").over(after), none).alias("d_after"), F.coalesce(F.sum("t").over(after), none).alias("t_after"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    inside = Window.partitionBy("span").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = hist.join(spans, "span").withColumns({"n_docs_gt": F.col("d_after") + F.coalesce(F.sum("n_docs").over(inside), none), "tokens_gt": F.col("t_after") + F.coalesce(F.sum("tokens").over(inside), none)})
    return both.select(
        "length",
        "n_docs",
        (F.col("all_docs") - F.col("n_docs_gt")).alias("n_docs_le"),
        "n_docs_gt",
        F.col("all_tokens").alias("total_tokens"),
        "tokens_gt",
        (F.col("all_tokens") - F.col("tokens_gt") + F.col("n_docs_gt") * F.col("length")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("n_docs_gt")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut to ``limit`` tokens, from the histogram alone."""
    # Of the lengths up to the limit the largest holds the counts after it; below all of them every document is longer.
    row = histogram.where(F.col("length") <= limit).agg(F.max(F.struct("length", "truncated_total", "n_docs_gt")).alias("x")).first()["x"]
    if row is None:
        n = histogram.agg(F.sum("n_docs")).first()[0] or 0
        return n * limit
    return row["truncated_total"] + row["n_docs_gt"] * (limit - row["length"])


def length_quantile(histogram: DataFrame, q: float) -> int | None:
    """The least length that at least a share ``q`` of the documents don't exceed."""
    return histogram.where(F.col("quantile") >= q).agg(F.min("length")).first()[0]
