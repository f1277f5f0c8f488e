"""Linking mentions of one person or organisation: canonical keys, then names in part and by sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import lexicons as L
from umbra.functions.text import cologne, let, strip_blanks

_EDGE = r"^[.,;:!?]+|[.,;:!?]+$"


def tokens(text: Column) -> Column:
    parts = F.split(strip_blanks(F.lower(text)), r"(?U)[\s,]+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, _EDGE, "")), lambda p: p != "")


def canonical_key(word: Column, group: Column) -> Column:
    """Lower-cased tokens without articles and titles (persons) or legal forms (organisations); others lower-cased whole."""
    bare = strip_blanks(word)
    person = F.array_join(F.filter(tokens(bare), lambda t: ~t.isin(list(L.ARTICLES + L.TITLES))), " ")
    company = F.array_join(F.filter(tokens(bare), lambda t: ~t.isin(list(L.ARTICLES + L.ORG_TOKENS))), " ")
    key = F.when(group == "PER", person).when(group.isin("ORG", "ORG_DETECTED"), company).otherwise(F.lower(bare))
    return F.when(key == "", F.lower(bare)).otherwise(key)


def resolve_entities(entities: Column) -> Column:
    """Keys parallel to ``entities``.

    A person's single name goes to the one full name that has it as a token;
    if none has, to the one with a token that sounds alike. With several it
    stays by itself.
    """
    every = F.transform(entities, lambda e: F.struct(canonical_key(e["word"], e["entity_group"]).alias("key"), (e["entity_group"] == "PER").alias("per")))

    def names_of(keyed: Column) -> Column:
        full = F.array_distinct(F.transform(F.filter(keyed, lambda k: k["per"] & k["key"].contains(" ")), lambda k: k["key"]))
        return F.transform(full, lambda m: F.struct(m.alias("name"), F.split(m, " ").alias("tokens"), F.transform(F.split(m, " "), cologne).alias("codes")))

    def link(k: Column, names: Column) -> Column:
        literal = F.filter(names, lambda m: F.array_contains(m["tokens"], k["key"]))
        code = cologne(k["key"])
        alike = F.filter(names, lambda m: (code != "") & F.array_contains(m["codes"], code))
        single = k["per"] & (k["key"] != "") & ~k["key"].contains(" ")
        return (
            F.when(~single | (F.size(names) == 0), k["key"])
            .when(F.size(literal) == 1, F.get(literal, F.lit(0))["name"])
            .when(F.size(literal) > 1, k["key"])
            .when(F.size(alike) == 1, F.get(alike, F.lit(0))["name"])
            .otherwise(k["key"])
        )

    return let(every, lambda keyed: let(names_of(keyed), lambda names: F.transform(keyed, lambda k: link(k, names))))


def phonetic_names(spark: SparkSession, names: tuple[str, ...] = L.LAST_NAMES) -> DataFrame:
    """(code, name): the index of names (lower-cased) by how they sound."""
    df = spark.createDataFrame([(n.lower(),) for n in names], "name string").distinct()
    return df.select(cologne(F.col("name")).alias("code"), "name").where("code <> ''")


def names_by_sound(words: DataFrame, word: str = "word", names: tuple[str, ...] = L.LAST_NAMES) -> DataFrame:
    """``words`` with a column name: a row for every name that sounds like the word; words that sound like none are left out."""
    coded = words.withColumn("__code", cologne(F.col(word)))
    # The names are a fixed list of the library's, so they are safe to broadcast.
    return coded.join(F.broadcast(phonetic_names(words.sparkSession, names)), F.col("__code") == F.col("code")).drop("__code", "code")
