"""Stores and sinks: mappings, the audit log with its retention, reports, model manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbra.settings import Settings

REDACTED = "[REDACTED]"


# ---- Mappings: (doc_id, placeholder, original, version) ----


def mapping_rows(results: DataFrame, version: Column, doc_id: str = "doc_id") -> DataFrame:
    """Flat mapping rows of channel results."""
    return results.select(F.col(doc_id), version.alias("version"), F.explode("mapping").alias("placeholder", "original"))


def latest_mappings(rows: DataFrame) -> DataFrame:
    """A document's last stored mapping replaces its earlier ones as a whole."""
    last = rows.groupBy("doc_id").agg(F.max("version").alias("version"))
    return rows.join(last, ["doc_id", "version"], "left_semi")


def store_mapping(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with the documents of ``new`` replaced."""
    return stored.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def lookup_mapping(rows: DataFrame, document_id) -> DataFrame:
    return rows.where(F.col("doc_id") == document_id).select("placeholder", "original")


def list_documents(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id").distinct()


def forget(rows: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of a mapping or audit table without those of the documents in ``gone``."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


# ---- Audit log ----


def audit_rows(results: DataFrame) -> DataFrame:
    """Audit entries of kapa results, one row each."""
    return results.select(F.inline("audit_entries"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Appended by day, so that retention touches whole folders."""
    rows.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def audit_trail(rows: DataFrame, document_id: str) -> DataFrame:
    return rows.where(F.col("document_id") == document_id)


def flagged(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("action") == "flagged_for_review")


def age_days(now: Column, at: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400e6)


def enforce_retention(rows: DataFrame, now: Column, settings: Settings | None = None) -> DataFrame:
    """Entries past the last limit gone, words past the first redacted. Entries without a time stay as they are.

    Column changed: whether the word was redacted by this run.
    """
    settings = settings or Settings()
    age = age_days(now, F.col("timestamp"))
    redact = F.coalesce((age > settings.pii_redact_after_days) & (F.col("entity_word") != REDACTED), F.lit(False))
    kept = rows.where(~F.coalesce(age > settings.hard_delete_after_days, F.lit(False)))
    return kept.withColumn("changed", redact).withColumn("entity_word", F.when(F.col("changed"), REDACTED).otherwise(F.col("entity_word")))


def retention_summary(rows: DataFrame, now: Column, settings: Settings | None = None) -> DataFrame:
    """One row: redacted, deleted."""
    settings = settings or Settings()
    age = age_days(now, F.col("timestamp"))
    gone = F.coalesce(age > settings.hard_delete_after_days, F.lit(False))
    redact = ~gone & F.coalesce((age > settings.pii_redact_after_days) & (F.col("entity_word") != REDACTED), F.lit(False))
    return rows.agg(F.count_if(redact).alias("redacted"), F.count_if(gone).alias("deleted"))


def export_json(rows: DataFrame, include_pii: bool = False) -> DataFrame:
    """(document_id, json) of entries, the confidence to three places, review fields only where set."""
    names = ["timestamp", "document_id", *(["entity_word"] if include_pii else []), "entity_group", "confidence", "source_layer", "action", "placeholder", "context_snippet", "reviewer", "review_decision"]
    return rows.withColumn("confidence", F.round("confidence", 3)).select("document_id", F.to_json(F.struct(*names)).alias("json"))


def export_csv(rows: DataFrame, path: str, include_pii: bool = False) -> None:
    (rows if include_pii else rows.drop("entity_word")).withColumn("confidence", F.round("confidence", 3)).write.option("header", True).csv(path)


# ---- Texts, responses, metrics, reports ----


def write_texts(results: DataFrame, path: str, column: str = "output") -> None:
    results.select(F.col(column).alias("value")).write.text(path, lineSep="\n")


def write_mappings(results: DataFrame, path: str) -> None:
    results.select("doc_id", "mapping").write.json(path)


def responses(results: DataFrame) -> DataFrame:
    """Results in the shape of the service's answers: scores to three places, no words for ifg."""
    shaped = F.transform("entities", lambda e: F.struct(e["word"].alias("word"), e["entity_group"].alias("entity_group"), F.round(e["score"], 3).alias("score"), e["start"].alias("start"), e["end"].alias("end"), e["source"].alias("source"), e["placeholder"].alias("placeholder")))
    extra = [c for c in ("mapping", "redaction_protocol", "flagged_for_review", "document_id", "quality") if c in results.columns]
    return results.select(F.to_json(F.struct(F.col("output").alias("text"), "channel", shaped.alias("entities"), "entity_count", *extra)).alias("json"))


def entity_metrics(results: DataFrame) -> DataFrame:
    """Counts by category, layer, channel and tenth of confidence (le: the bucket's upper end). No words."""
    e = results.select("channel", F.explode("entities").alias("e"))
    le = F.when(F.col("e.score") > 1.0, F.lit(None)).otherwise(F.greatest(F.lit(0.1), F.ceil(F.round(F.col("e.score"), 9) * 10) / 10))
    return e.groupBy("channel", F.col("e.entity_group").alias("category"), F.col("e.source").alias("layer"), le.alias("le")).agg(F.count(F.lit(1)).alias("n"))


def protocol_report(results: DataFrame) -> DataFrame:
    """Redaction protocols of many documents in one: category, documents, count, least and greatest confidence."""
    rows = results.select(F.inline("redaction_protocol"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("documents"), F.sum("count").alias("count"), F.min("min_confidence").alias("min_confidence"), F.max("max_confidence").alias("max_confidence"))


def compare_channels(documents: DataFrame, anonymize, channels=("govgpt", "ifg", "kapa")) -> DataFrame:
    """(doc_id, channel, output, entity_count, passed, leak_count) of every document in every channel."""
    out = None
    for name in channels:
        one = anonymize(documents, name).select("doc_id", "channel", "output", "entity_count", F.col("quality.passed").alias("passed"), F.col("quality.leak_count").alias("leak_count"))
        out = one if out is None else out.unionByName(one)
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of the files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def verify_manifest(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): files missing, unknown or changed."""
    both = expected.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("want") != F.col("have"), "changed")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def first_version(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key by ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
