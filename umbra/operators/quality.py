"""Checks of redacted texts: leaks, left words, placeholders, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import checks
from umbra.functions.text import let, strip_blanks
from umbra.operators import finders
from umbra.operators.spans import find_all, inside
from umbra.schema import ISSUES

PLACEHOLDER = r"\[[^\]]+\]"
VALID_PLACEHOLDER = r"^\[(?:GESCHWÄRZT:[A-ZÄÖÜ_]+|PRÜFEN:[A-ZÄÖÜ_]+_\d+|[A-ZÄÖÜ_]+_\d+)\]$"
CAPITALISED = r"(?U)\b[A-ZÄÖÜ][a-zäöüß]{2,}\b"
#: Finders run again over the output, in this order.
RESCANNED = (
    ("EMAIL", finders.emails),
    ("IBAN", finders.ibans),
    ("SVN", finders.svnrs),
    ("STEUERNUMMER", finders.tax_numbers),
    ("TELEFON", finders.phones),
    ("REISEPASS", finders.passports),
    ("PERSONALAUSWEIS", finders.id_cards),
    ("KFZ", finders.plates),
)


def issue(kind: str, of: Column | str, at: Column, snippet: Column, description: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), (of if isinstance(of, Column) else F.lit(of)).alias("pii_type"), at.alias("position"), snippet.alias("snippet"), description.alias("description"))


def _none() -> Column:
    return F.array().cast(ISSUES)


def _leaks(entities: Column, name: str) -> Column:
    return F.transform(entities, lambda e: issue("leak", name, e["start"], e["word"], F.lit(f"{name} still present in output"))).cast(ISSUES)


def rescan(text: Column, placeholders: Column) -> Column:
    """What the finders still find outside placeholders."""
    found = []
    for name, find in RESCANNED:
        found.append(_leaks(F.filter(find(text), lambda e: ~inside(e["start"], e["end"], placeholders)), name))
    return F.concat(*found)


def left_words(text: Column, entities: Column, placeholders: Column) -> Column:
    """Redacted words that still stand in the output as whole words, once each."""
    words = F.transform(F.filter(entities, lambda e: (e["placeholder"] != "") & (strip_blanks(e["word"]) != "")), lambda e: F.struct(strip_blanks(e["word"]).alias("word"), e["entity_group"].alias("g")))
    once = let(words, lambda every: F.filter(every, lambda w, i: F.size(F.filter(every, lambda o, j: (j < i) & (F.lower(o["word"]) == F.lower(w["word"])))) == 0))

    def first(w: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iuU)\b\Q"), F.replace(w["word"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
        hits = F.filter(find_all(text, pattern, guard=F.regexp(text, pattern)), lambda s: ~inside(s["start"], s["end"], placeholders))
        return F.struct(w.alias("w"), F.get(hits, F.lit(0)).alias("s"))

    met = F.filter(F.transform(once, first), lambda x: x["s"].isNotNull())
    return F.transform(met, lambda x: issue("leak", x["w"]["g"], x["s"]["start"], x["s"]["word"], F.concat(F.lit("Anonymized entity '"), x["w"]["word"], F.lit("' remains in output")))).cast(ISSUES)


def malformed(placeholders: Column) -> Column:
    bad = F.filter(placeholders, lambda s: ~s["word"].rlike(VALID_PLACEHOLDER))
    return F.transform(bad, lambda s: issue("format", "PLACEHOLDER", s["start"], s["word"], F.concat(F.lit("Malformed placeholder: "), s["word"]))).cast(ISSUES)


def left_names(text: Column, placeholders: Column) -> Column:
    """Names of the dictionary: a first and a last name side by side are a leak, a lone last name a warning."""
    words = F.filter(find_all(text, CAPITALISED), lambda s: (checks.is_first_name(s["word"]) | checks.is_last_name(s["word"])) & ~inside(s["start"], s["end"], placeholders))
    tagged = F.transform(words, lambda s: F.struct(s.alias("s"), checks.is_first_name(s["word"]).alias("f"), checks.is_last_name(s["word"]).alias("l")))

    def pairs(a: Column, b: Column) -> Column:
        return b.isNotNull() & (b["s"]["start"] - a["s"]["end"] <= 3) & ((a["f"] & b["l"]) | (a["l"] & b["f"]))

    linked = let(tagged, lambda every: F.transform(every, lambda t, i: F.struct(t.alias("t"), F.get(every, i + 1).alias("next"), F.when(i > 0, F.get(every, i - 1)).alias("prev"))))
    return let(linked, lambda found: _name_issues(found, pairs))


def _name_issues(linked: Column, pairs) -> Column:
    leaks = F.transform(F.filter(linked, lambda x: pairs(x["t"], x["next"])), lambda x: issue("leak", "PER_DICT", x["t"]["s"]["start"], F.concat_ws(" ", x["t"]["s"]["word"], x["next"]["s"]["word"]), F.concat(F.lit("AT name dictionary match in output: '"), F.concat_ws(" ", x["t"]["s"]["word"], x["next"]["s"]["word"]), F.lit("'"))))
    alone = F.filter(linked, lambda x: ~F.coalesce(pairs(x["t"], x["next"]), F.lit(False)) & ~F.coalesce(pairs(x["prev"], x["t"]), F.lit(False)) & x["t"]["l"] & ~x["t"]["f"])
    warnings = F.transform(alone, lambda x: issue("warn", "PER_DICT", x["t"]["s"]["start"], x["t"]["s"]["word"], F.concat(F.lit("Possible AT surname in output: '"), x["t"]["s"]["word"], F.lit("'"))))
    return F.concat(leaks.cast(ISSUES), warnings.cast(ISSUES))


def check_output(df: DataFrame, text: str = "text", entities: str = "entities", out: str = "quality") -> DataFrame:
    """``df`` with struct(passed, leak_count, issues). Warnings are issues but no leaks."""
    spans = df.withColumn("__placeholders", find_all(F.col(text), PLACEHOLDER))
    redacted = (F.size("__placeholders") > 0) | F.exists(F.col(entities), lambda e: e["placeholder"] != "")
    issues = F.concat(
        rescan(F.col(text), F.col("__placeholders")),
        left_words(F.col(text), F.col(entities), F.col("__placeholders")),
        malformed(F.col("__placeholders")),
        F.when(redacted, left_names(F.col(text), F.col("__placeholders"))).otherwise(_none()),
    )
    found = spans.withColumn("__issues", issues)
    leaks = F.size(F.filter("__issues", lambda i: i["type"] == "leak"))
    report = F.struct((F.size("__issues") == 0).alias("passed"), leaks.alias("leak_count"), F.col("__issues").alias("issues"))
    return found.withColumn(out, report).drop("__placeholders", "__issues")
