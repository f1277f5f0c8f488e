"""Merging overlapping entities of several detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.operators.spans import entity, sorted_by_start
from umbra.schema import ENTITIES

_GROUP = "struct<n:int,miss:double,best:double,label:string,start:int,end:int,word:string,score:double,source:string,sources:array<string>,context:string,anomaly:double>"


def _alone(e: Column) -> Column:
    return F.struct(
        F.lit(1).alias("n"), (1 - e["score"]).alias("miss"), e["score"].alias("best"), e["entity_group"].alias("label"), e["start"].alias("start"), e["end"].alias("end"), e["word"].alias("word"),
        e["score"].alias("score"), e["source"].alias("source"), F.array(e["source"]).alias("sources"), e["context"].alias("context"), e["anomaly_score"].alias("anomaly"),
    ).cast(_GROUP)


def _joined(g: Column, e: Column) -> Column:
    return F.struct(
        (g["n"] + 1).alias("n"),
        (g["miss"] * (1 - e["score"])).alias("miss"),
        F.greatest(g["best"], e["score"]).alias("best"),
        F.when(e["score"] > g["best"], e["entity_group"]).otherwise(g["label"]).alias("label"),
        g["start"].alias("start"),
        F.greatest(g["end"], e["end"]).alias("end"),
        g["word"].alias("word"),
        g["score"].alias("score"),
        g["source"].alias("source"),
        F.array_distinct(F.concat(g["sources"], F.array(e["source"]))).alias("sources"),
        F.when(e["context"] != "", e["context"]).otherwise(g["context"]).alias("context"),
        F.greatest(g["anomaly"], e["anomaly_score"]).alias("anomaly"),
    ).cast(_GROUP)


def merge_entities(entities: Column, text: Column) -> Column:
    """One entity for each group of transitively overlapping ones; touching spans stay apart.

    The score is 1 - product(1 - score), the label that of the best score (the
    first on ties, by start, falling width and order of detection), the span
    the union, its word cut from the text again. A single entity keeps its word.
    """

    def step(acc: Column, e: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (e["start"] < last["end"])
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(_joined(last, e)))).otherwise(F.concat(acc, F.array(_alone(e)))).cast(f"array<{_GROUP}>")

    def merged(g: Column) -> Column:
        one = g["n"] == 1
        return entity(
            F.when(one, g["word"]).otherwise(F.substring(text, g["start"] + 1, g["end"] - g["start"])),
            g["label"],
            F.when(one, g["score"]).otherwise(1 - g["miss"]),
            g["start"],
            g["end"],
            F.when(F.size(g["sources"]) > 1, "ensemble").otherwise(F.get(g["sources"], F.lit(0))),
            g["context"],
            g["anomaly"],
            sources=g["sources"],
        )

    groups = F.aggregate(sorted_by_start(entities, widest_first=True), F.array().cast(f"array<{_GROUP}>"), step)
    return F.transform(groups, merged).cast(ENTITIES)


def islands(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flat form: ``spans`` (key, start, end, ord, ...) with the number of the group of overlapping spans."""
    order = Window.partitionBy(key).orderBy("start", (F.col("start") - F.col("end")), "ord")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(F.col("start") < before, 0).otherwise(1))
    return opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("opens")


def merge_flat(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flat form of :func:`merge_entities`: key, island, start, end, score, entity_group, n, n_sources."""
    first = F.struct(F.col("score"), -F.col("start"), F.col("end") - F.col("start"), -F.col("ord"))
    merged = islands(spans, key).groupBy(key, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (1 - F.product(1 - F.col("score"))).alias("joint"), F.max("score").alias("one"), F.max_by("entity_group", first).alias("entity_group"), F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources")
    )
    return merged.select(key, "island", "start", "end", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("joint")).alias("score"), "entity_group", "n", "n_sources")
