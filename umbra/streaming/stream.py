"""The same plan over streams: results, mappings and audit entries of each batch to their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from umbra.plans.pipeline import anonymize
from umbra.settings import Settings
from umbra.sources import stores


def sinks(out: str, channel: str, settings: Settings | None = None):
    """A foreachBatch function. A batch writes a folder of its own and replaces it, so a repeated batch leaves no rows twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = anonymize(batch, channel, settings=settings).persist()
        plain = held.drop("entities", "mapping", "audit_entries")
        plain.write.mode("overwrite").parquet(f"{out}/results/batch={batch_id}")
        if "mapping" in held.columns:
            stores.mapping_rows(held, F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/mappings/batch={batch_id}")
        if "audit_entries" in held.columns:
            stores.audit_rows(held).write.mode("overwrite").parquet(f"{out}/audit/batch={batch_id}")
        held.unpersist()

    return write


def redact_stream(spark: SparkSession, source: str, out: str, schema: str, channel: str = "govgpt", settings: Settings | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Everything new below ``source`` (Parquet) once, then stop: no state across rows is needed."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(sinks(out, channel, settings)).option("checkpointLocation", checkpoint or f"{out}/checkpoint").trigger(availableNow=True).start()


def without_redelivery(stream: DataFrame, key: str = "doc_id", at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Documents delivered again within the delay dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def category_counts(entities: DataFrame, at: str = "ts", width: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Entities by category in windows of time, for monitoring."""
    return entities.withWatermark(at, delay).groupBy(F.window(at, width), "entity_group").agg(F.count(F.lit(1)).alias("n"))
