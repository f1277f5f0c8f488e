"""Output policies: reversible placeholders (govgpt), redaction (ifg), audited placeholders (kapa)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import lexicons as L
from umbra.functions.text import strip_blanks
from umbra.operators.quality import check_output
from umbra.operators.resolve import resolve_entities
from umbra.operators.spans import entity, sorted_by_start
from umbra.schema import AUDITS, ENTITIES
from umbra.settings import Settings

_NAMED = "array<struct<type:string,key:string,placeholder:string,original:string,flagged:boolean>>"


def placeholder_label(group: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in L.PLACEHOLDER_LABELS.items() for x in pair))
    return F.coalesce(F.element_at(labels, group), group)


def is_art9(group: Column) -> Column:
    return group.isin(list(L.ART9_GROUPS))


def public_category(group: Column) -> Column:
    """Special categories all look the same in public."""
    return F.when(is_art9(group), "BESONDERE_KATEGORIE").otherwise(placeholder_label(group))


def rewrite(text: Column, entities: Column) -> Column:
    """``text`` with the placeholders of ``entities`` (sorted by start) in place, from the right.

    A space parts a placeholder from what stands before and after it, unless
    that is blank or punctuation. What stands after is what is already rewritten.
    """

    def step(acc: Column, e: Column) -> Column:
        before, after = F.substring(acc, F.lit(1), e["start"]), F.substring(acc, e["end"] + 1, F.length(acc))
        left = F.when(before.rlike(r"[^ \n\t(]\z"), " ").otherwise("")
        right = F.when(after.rlike(r"\A[^ \n\t.,;:!?)]"), " ").otherwise("")
        return F.concat(before, left, e["placeholder"], right, after)

    return F.aggregate(F.reverse(F.filter(entities, lambda e: e["placeholder"] != "")), text, step)


def snippet(text: Column, start: Column, end: Column, placeholder: Column, window: int = 30) -> Column:
    left = F.greatest(start - window, F.lit(0))
    return F.concat(F.lit("..."), F.substring(text, left + 1, start - left), placeholder, F.substring(text, end + 1, F.lit(window)), F.lit("..."))


def _named(df: DataFrame, settings: Settings, review: bool) -> DataFrame:
    """Columns __e (entities by start), __k (what numbering needs), __named (placeholders in order of first mention)."""
    df = df.withColumn("__e", sorted_by_start(F.col("entities")))
    df = df.withColumn("__keys", resolve_entities(F.col("__e")))

    def row(e: Column, key: Column) -> Column:
        word = strip_blanks(e["word"])
        low = (e["score"] < settings.kapa_review_threshold) | (is_art9(e["entity_group"]) if settings.always_review_art9 else F.lit(False))
        return F.struct(placeholder_label(e["entity_group"]).alias("type"), key.alias("key"), word.alias("word"), ((word != "") & (e["score"] >= settings.anomaly_threshold)).alias("kept"), (low if review else F.lit(False)).alias("low"))

    df = df.withColumn("__k", F.zip_with("__e", "__keys", row))

    def step(acc: Column, k: Column) -> Column:
        same = lambda x: (x["type"] == k["type"]) & (x["key"] == k["key"])
        number = F.size(F.filter(acc, lambda x: x["type"] == k["type"])) + 1
        base = F.concat(k["type"], F.lit("_"), number.cast("string"))
        made = F.concat(F.when(k["low"], "[PRÜFEN:").otherwise("["), base, F.lit("]"))
        new = F.struct(k["type"].alias("type"), k["key"].alias("key"), made.alias("placeholder"), k["word"].alias("original"), k["low"].alias("flagged"))
        longer = F.transform(acc, lambda x: F.when(same(x) & (F.length(k["word"]) > F.length(x["original"])), x.withField("original", k["word"])).otherwise(x))
        return F.when(~k["kept"], acc).when(F.exists(acc, same), longer).otherwise(F.concat(acc, F.array(new))).cast(_NAMED)

    df = df.withColumn("__named", F.aggregate("__k", F.array().cast(_NAMED), step))

    def placed(e: Column, k: Column) -> Column:
        mine = F.get(F.filter("__named", lambda x: (x["type"] == k["type"]) & (x["key"] == k["key"])), F.lit(0))["placeholder"]
        return e.withField("placeholder", F.when(k["kept"], mine).otherwise(e["placeholder"]))

    return df.withColumn("__e", F.zip_with("__e", "__k", placed).cast(ENTITIES))


def _mapping() -> Column:
    return F.map_from_entries(F.transform("__named", lambda x: F.struct(x["placeholder"], x["original"])))


def _done(df: DataFrame, settings: Settings) -> DataFrame:
    df = df.withColumn("entity_count", F.size("entities"))
    return df


def govgpt(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(..., norm_text, entities) to channel, text, entities, mapping, quality, counts. Numbered placeholders, reversible."""
    settings = settings or Settings()
    df = _named(df, settings, review=False)
    df = df.withColumns({"channel": F.lit("govgpt"), "output": rewrite(F.col("norm_text"), F.filter("__e", lambda e: e["score"] >= settings.anomaly_threshold)), "mapping": _mapping(), "entities": F.col("__e")})
    df = df.drop("__e", "__k", "__keys", "__named").withColumn("unique_entity_count", F.size("mapping"))
    return _done(check_output(df, "output") if settings.run_quality_check else df, settings)


def ifg(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Redaction by category with a protocol; neither mapping, original text nor words stay."""
    settings = settings or Settings()
    kept = F.filter(sorted_by_start(F.col("entities")), lambda e: e["score"] >= settings.anomaly_threshold)
    df = df.withColumn("__e", F.transform(kept, lambda e: e.withField("placeholder", F.concat(F.lit("[GESCHWÄRZT:"), public_category(e["entity_group"]), F.lit("]")))))
    df = df.withColumn("output", rewrite(F.col("norm_text"), F.col("__e"))).withColumn("entities", F.col("__e").cast(ENTITIES))
    if settings.run_quality_check:
        df = check_output(df, "output")
    stats = F.transform("__e", lambda e: F.struct(public_category(e["entity_group"]).alias("c"), e["score"].alias("s")))
    df = df.withColumn("__s", stats)

    def entry(c: Column) -> Column:
        scores = F.transform(F.filter("__s", lambda x: x["c"] == c), lambda x: x["s"])
        return F.struct(c.alias("category"), F.size(scores).alias("count"), F.array_min(scores).alias("min_confidence"), F.array_max(scores).alias("max_confidence"))

    protocol = F.transform(F.array_sort(F.array_distinct(F.transform("__s", lambda x: x["c"]))), entry)
    blank = F.transform("__e", lambda e: entity(F.lit("[REDACTED]"), e["entity_group"], e["score"], e["start"], e["end"], e["source"], placeholder=e["placeholder"]))
    df = df.withColumns({"channel": F.lit("ifg"), "redaction_protocol": protocol, "entities": blank.cast(ENTITIES)})
    return _done(df.drop("__e", "__s", "norm_text", "original_text"), settings)


def kapa(df: DataFrame, settings: Settings | None = None, document_id: str | None = "doc_id", now: Column | None = None) -> DataFrame:
    """Placeholders with an audit entry for every mention and marks for review.

    Whether a placeholder is marked goes by its first mention, a mention's
    action by its own score. Rows without an id get a random one.
    """
    settings = settings or Settings()
    own = F.col(document_id).cast("string") if document_id else F.lit(None).cast("string")
    df = _named(df.withColumn("document_id", F.coalesce(own, F.uuid())), settings, review=True)
    at = F.current_timestamp() if now is None else now
    both = F.filter(F.arrays_zip(F.col("__e").alias("e"), F.col("__k").alias("k")), lambda x: x["k"]["kept"])

    def audit(x: Column) -> Column:
        e, k = x["e"], x["k"]
        none = F.lit(None).cast("string")
        return F.struct(
            at.alias("timestamp"), F.col("document_id").alias("document_id"), k["word"].alias("entity_word"), k["type"].alias("entity_group"), e["score"].alias("confidence"), e["source"].alias("source_layer"),
            F.when(k["low"], "flagged_for_review").otherwise("anonymized").alias("action"), e["placeholder"].alias("placeholder"), snippet(F.col("norm_text"), e["start"], e["end"], e["placeholder"]).alias("context_snippet"), none.alias("reviewer"), none.alias("review_decision"),
        )

    df = df.withColumns({
        "channel": F.lit("kapa"),
        "output": rewrite(F.col("norm_text"), F.filter("__e", lambda e: e["score"] >= settings.anomaly_threshold)),
        "mapping": _mapping(),
        "flagged_for_review": F.transform(F.filter("__named", lambda x: x["flagged"]), lambda x: x["placeholder"]),
        "audit_entries": F.transform(both, audit).cast(AUDITS),
        "entities": F.col("__e"),
    })
    df = df.drop("__e", "__k", "__keys", "__named").withColumn("unique_entity_count", F.size("mapping"))
    return _done(check_output(df, "output") if settings.run_quality_check else df, settings)


CHANNELS = {"govgpt": govgpt, "ifg": ifg, "kapa": kapa}


def channel(name: str):
    if name not in CHANNELS:
        raise ValueError(f"unknown channel {name!r}; known: {', '.join(CHANNELS)}")
    return CHANNELS[name]


def reidentify(text: Column, mapping: Column) -> Column:
    """Placeholders put back to what they stand for. Longer placeholders go first, so that none is cut."""
    pairs = F.array_sort(F.transform(F.map_entries(mapping), lambda p: F.struct((-F.length(p["key"])).alias("n"), p["key"].alias("k"), p["value"].alias("v"))))
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["k"], p["v"]))
