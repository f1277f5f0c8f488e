"""The pipeline as a plan: normalise, detect, merge, filter, look at the context, redact.

Nothing here shuffles; each document is worked on where it is read, in batch
and in streams alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import text as T
from umbra.functions.checks import is_whitelisted
from umbra.operators.channels import channel as channel_of
from umbra.operators.context import Scorer, company_anomalies, quasi_identifiers
from umbra.operators.ensemble import merge_entities
from umbra.operators.finders import find_entities
from umbra.operators.recognizers import recognize
from umbra.operators.spans import sorted_by_start, without_marks
from umbra.schema import ENTITIES
from umbra.settings import Settings

#: A plug-in detector: text column to a column of entities. Models sit behind one of these.
Detector = Callable[[Column], Column]


def normalise(text: Column, settings: Settings | None = None) -> Column:
    settings = settings or Settings()
    text = without_marks(F.coalesce(text, F.lit("")))
    if settings.fix_encoding:
        text = T.fix_encoding(text)
    if settings.use_adversarial_normalization:
        text = T.normalize_adversarial(text, settings.use_leetspeak_normalization)
    return text


def _kept_apart(value: Column) -> Column:
    """``value`` as it is, but no filter above is moved below it.

    Filters on entities (explode adds one by itself) would otherwise be pushed
    through every stage, with the whole detection written out in their place.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def detect(df: DataFrame, text: str = "text", settings: Settings | None = None, detectors: Sequence[Detector] = (), recognizers: Sequence | None = None, scorer: Scorer | None = None) -> DataFrame:
    """``df`` with norm_text and entities (sorted, disjoint but for context entities that touch none).

    Columns of these two names are replaced; others stay, whatever they are called.
    """
    settings = settings or Settings()
    own, df = df.columns, df.withColumnsRenamed({c: f"own {c}" for c in df.columns if c.startswith("__")})
    text = f"own {text}" if text.startswith("__") else text
    df = df.withColumn("norm_text", normalise(F.col(text), settings))
    norm = F.col("norm_text")
    found = []
    if settings.use_regex_fallback:
        df = df.withColumn("__regex", find_entities(norm))
        found.append(F.col("__regex"))
    for i, detector in enumerate(detectors):
        df = df.withColumn(f"__plug{i}", detector(norm))
        found.append(F.col(f"__plug{i}"))
    if settings.use_presidio_compat:
        df = df.withColumn("__recognized", recognize(norm, settings, recognizers))
        found.append(F.col("__recognized"))
    df = df.withColumn("__raw", F.concat(*found) if found else F.array().cast(ENTITIES))
    df = df.withColumn("__merged", merge_entities(F.col("__raw"), norm))
    if settings.use_whitelist:
        df = df.withColumn("__merged", F.filter("__merged", lambda e: ~is_whitelisted(e["word"], e["entity_group"])))
    if settings.use_anomaly_detection:
        merged = F.col("__merged")
        if scorer is not None:
            df = df.withColumn("__odd", company_anomalies(norm, merged, settings, scorer))
            df = df.withColumn("__merged", F.concat("__merged", "__odd"))
        df = df.withColumn("__quasi", quasi_identifiers(norm, F.col("__merged"), settings))
        df = df.withColumn("__merged", F.concat("__merged", "__quasi"))
    df = df.withColumn("entities", _kept_apart(sorted_by_start(F.col("__merged"))))
    return df.drop(*[c for c in df.columns if c.startswith("__")]).withColumnsRenamed({f"own {c}": c for c in own if c.startswith("__")})


def overridden(settings: Settings, overrides: str) -> Settings:
    """``settings`` whose thresholds each row may override: ``overrides`` names a map column from threshold to value."""
    fields = ("presidio_threshold", "pii_threshold", "org_threshold", "gliner_threshold", "anomaly_threshold", "perplexity_threshold", "kapa_review_threshold")
    return settings.replace(**{f: F.coalesce(F.col(overrides)[f], F.lit(getattr(settings, f))) for f in fields})


def anonymize(df: DataFrame, channel: str = "govgpt", text: str = "text", settings: Settings | None = None, overrides: str | None = None, **plugins) -> DataFrame:
    """Detect and apply a channel. ``df`` keeps its other columns; the redacted text is ``output``.

    ``overrides``: a map column of thresholds by name that go before ``settings``
    for the row (as requests carry them); null and missing ones change nothing.
    """
    settings = settings or Settings()
    apply = channel_of(channel)
    if overrides is not None:
        settings = overridden(settings, overrides)
    found = detect(df, text, settings, **plugins)
    if channel == "kapa" and "doc_id" not in found.columns:
        return apply(found, settings, document_id=None)
    return apply(found, settings)
