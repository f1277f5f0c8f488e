"""Detectors from models: what a model returns, made into entities of the pipeline.

A model is a function from the text column to a column of MODEL_OUTPUT, such as
an Arrow UDF around it; offsets may be null. Rules for what counts are plans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions import lexicons as L
from umbra.functions.checks import is_blacklisted
from umbra.functions.text import clean_entity, let
from umbra.operators.spans import entity
from umbra.schema import ENTITIES
from umbra.settings import Settings

MODEL_OUTPUT = "array<struct<word:string,entity_group:string,score:double,start:int,end:int>>"
Model = Callable[[Column], Column]


def _mapped(label: Column, to: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in to.items() for x in pair)), label), other)


def normal_label(label: Column) -> Column:
    """Labels of named-entity models in the pipeline's terms; unknown ones stay."""
    return _mapped(label, L.NER_LABELS, label)


def zero_shot_label(label: Column) -> Column:
    """Labels that a zero-shot model was asked for in the pipeline's terms; unknown ones in capitals."""
    return _mapped(label, L.ZERO_SHOT_LABELS, F.upper(label))


def located(text: Column, e: Column) -> Column:
    """struct(start, end) of a model's entity: its own offsets, else the first place of its word (without a tokenizer's blank marks); null if there is none."""
    needle = F.trim(F.regexp_replace(e["word"], "^[▁ ]+", ""))
    at = F.position(needle, text)
    found = F.when((needle != "") & (at > 0), F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(needle)).cast("int").alias("end")))
    return F.when(e["start"].isNotNull() & e["end"].isNotNull(), F.struct(e["start"].alias("start"), e["end"].alias("end"))).otherwise(found)


def ner_detector(model: Model, source: str, threshold: Column | float, labels: Sequence[str] = ()) -> Callable[[Column], Column]:
    """Entities of a named-entity model: located, widened to words and cleaned, at the threshold or above, not blacklisted.

    ``labels``: only these (after normalisation) count; all if empty.
    """
    least = threshold if isinstance(threshold, Column) else F.lit(threshold)

    def detect(text: Column) -> Column:
        group = lambda e: normal_label(e["entity_group"])
        counts = lambda e: (e["score"] >= least) & (group(e).isin(list(labels)) if labels else F.lit(True))
        placed = F.transform(F.filter(model(text), counts), lambda e: F.struct(e.alias("e"), located(text, e).alias("at")))
        cleaned = F.transform(F.filter(placed, lambda x: x["at"].isNotNull()), lambda x: F.struct(x["e"].alias("e"), clean_entity(x["e"]["word"], text, x["at"]["start"], x["at"]["end"]).alias("c")))
        kept = F.filter(cleaned, lambda x: ~is_blacklisted(x["c"]["word"]))
        return F.coalesce(F.transform(kept, lambda x: entity(x["c"]["word"], group(x["e"]), x["e"]["score"], x["c"]["start"], x["c"]["end"], source)), F.array()).cast(ENTITIES)

    return detect


def zero_shot_detector(model: Model, threshold: Column | float) -> Callable[[Column], Column]:
    """Entities of a zero-shot model, taken where it says, at the threshold or above, not blacklisted. A model that returns null found nothing."""
    least = threshold if isinstance(threshold, Column) else F.lit(threshold)

    def detect(text: Column) -> Column:
        kept = F.filter(model(text), lambda e: (e["word"] != "") & (e["score"] >= least) & ~is_blacklisted(e["word"]))
        return F.coalesce(F.transform(kept, lambda e: entity(e["word"], zero_shot_label(e["entity_group"]), e["score"], F.coalesce(e["start"], F.lit(0)), F.coalesce(e["end"], F.lit(0)), "gliner")), F.array()).cast(ENTITIES)

    return detect


def model_detectors(settings: Settings | None = None, pii: Model | None = None, org: Model | None = None, zero_shot: Model | None = None) -> list[Callable[[Column], Column]]:
    """Detectors of the models at hand with the thresholds of ``settings``; the zero-shot one only if they use it."""
    settings = settings or Settings()
    found = []
    if pii is not None:
        found.append(ner_detector(pii, "pii", settings.pii_threshold))
    if org is not None:
        found.append(ner_detector(org, "org", settings.org_threshold, L.NER_ORG_LABELS))
    if zero_shot is not None and settings.use_gliner:
        found.append(zero_shot_detector(zero_shot, settings.gliner_threshold))
    return found


def rank_anomaly(predicted: Column, word: Column) -> Column:
    """How unexpected ``word`` is among a fill-mask model's ranked tokens: its place over their number, 1 where it isn't among them.

    Of several words the first counts; tokens and word are compared in lower case and without blanks.
    """
    first = F.get(F.split(F.lower(word), " "), F.lit(0))
    ranked = F.transform(predicted, lambda t: F.lower(F.trim(t)))
    return let(ranked, lambda r: F.when(F.array_position(r, first) > 0, (F.array_position(r, first) - 1) / F.size(r)).otherwise(F.lit(1.0)))
