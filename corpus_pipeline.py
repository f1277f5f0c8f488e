"""Corpus pipeline: quality rules, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all
but the last return the columns of documents, whatever these are. An empty table
stays empty in every stage, texts of any length are taken whole. What a stage
does with nulls, ties and repeated rows:

- quality: null, empty and depleted texts go, repeated rows stay or go together;
- exact: null and empty texts are equal, of copies the largest id stays (null ids
  only where no other has the text), of repeated rows one;
- near: texts without words are all kept, of a group the least id stays, of
  repeated rows one;
- pack: every token of every row is packed, repeated rows and null ids too, an
  empty or null text as one end mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbra.llm.common import materialise, table
from umbra.llm.exact_dedup import drop_exact_copies
from umbra.llm.near_dedup import drop_near_copies
from umbra.llm.packing import pack_documents
from umbra.llm.quality_rules import keep_good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are frequent on their host (:func:`keep_good_documents`)."""
    return keep_good_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, upper and lower case A-Z taken alike (:func:`drop_exact_copies`)."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by at least 80 % of 5-word shingles (:func:`drop_near_copies`)."""
    return drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' chunks in sequences of the permitted lengths (:func:`pack_documents`)."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("best_fit_packing", pack)]
#: Neither the groups of near copies nor the packing can be stated in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each hands on is written once, so that no stage runs those before it again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
