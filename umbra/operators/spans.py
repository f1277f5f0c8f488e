"""Spans of texts: finding, overlap, greedy de-duplication.

A span is half open and counts code points from 0. ``find_all`` marks every
match, splits at the marks and adds up lengths, all inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions.text import MARKS
from umbra.schema import ENTITIES, ENTITY, SPAN, SPANS


def without_marks(text: Column) -> Column:
    return F.translate(text, MARKS, "")


def safe(text: Column) -> Column:
    """``text`` for finders that read it raw: marks of its own become U+FFFD, so that offsets stay and no match is missed."""
    return F.when(text.rlike(f"[{MARKS}]"), F.translate(text, MARKS, "\ufffd" * len(MARKS))).otherwise(text)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def no_entities() -> Column:
    return F.array().cast(ENTITIES)


def find_all(text: Column, pattern: Column | str, marked: str = "\ufdd0$0\ufdd1", guard: Column | None = None) -> Column:
    """Leftmost matches that don't overlap, as spans. ``marked``: the replacement that sets the marks.

    Texts without a match (or for which ``guard`` is false) are not taken apart.
    ``text`` holds none of the marks: it is normalised or :func:`safe`.
    """
    parts = F.split(F.regexp_replace(text, pattern, marked), "[\ufdd0\ufdd1]", -1)
    return F.when(text.rlike(pattern) if isinstance(pattern, str) and guard is None else guard, split_spans(parts)).otherwise(no_spans())


def split_spans(parts: Column) -> Column:
    """Spans of the odd parts."""
    kind = f"struct<at:int,odd:boolean,found:{SPANS}>"

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("word")).cast(SPAN)
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found")).cast(kind)

    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), no_spans().alias("found")).cast(kind)
    return F.aggregate(parts, zero, step, lambda acc: acc["found"])


def entity(word: Column, group: Column | str, score: Column | float, start: Column, end: Column, source: Column | str, context: Column | str = "", anomaly: Column | float = 0.0, placeholder: Column | str = "", sources: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (word, group, score, start, end, source, context, anomaly, placeholder, F.array().cast("array<string>") if sources is None else sources)
    names = ("word", "entity_group", "score", "start", "end", "source", "context", "anomaly_score", "placeholder", "sources")
    return F.struct(*(lit(v).alias(n) for v, n in zip(values, names, strict=True))).cast(ENTITY)


def as_entities(spans: Column, group: str, score: float, source: str = "regex") -> Column:
    return F.transform(spans, lambda s: entity(s["word"], group, score, s["start"], s["end"], source))


def overlap(a: Column, b: Column) -> Column:
    """Spans that share a character; touching ones don't."""
    return ~((a["end"] <= b["start"]) | (a["start"] >= b["end"]))


def greedy_dedup(entities: Column, against: Column | None = None) -> Column:
    """In order, the entities that overlap none taken before (nor one of ``against``)."""

    def step(acc: Column, e: Column) -> Column:
        taken = F.exists(acc, lambda x: overlap(e, x))
        if against is not None:
            taken = taken | F.exists(against, lambda x: overlap(e, x))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(e)).cast(ENTITIES))

    return F.aggregate(entities, no_entities(), step)


def sorted_by_start(entities: Column, widest_first: bool = False) -> Column:
    """Sorted by start (and falling width); ties keep their order."""

    def key(e: Column, i: Column) -> Column:
        width = e["start"] - e["end"] if widest_first else F.lit(0)
        return F.struct(e["start"].alias("a"), width.alias("b"), i.alias("i"), e.alias("e"))

    return F.transform(F.array_sort(F.transform(entities, key)), lambda x: x["e"])


def inside(start: Column, end: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] <= start) & (end <= s["end"]))


Validator = Callable[[Column], Column]
