"""Sources: texts, annotated samples, generated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import lexicons as L
from umbra.functions.checks import SVNR_WEIGHTS
from umbra.schema import BENCHMARK


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): a document for each file, the path its id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(doc_id, text) of texts at hand, as typed or posted."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def read_requests(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Requests as JSON lines, with a column problem that says what is wrong with one (null: nothing)."""
    schema = "text string, channel string, document_id string, settings_override map<string,double>"
    df = spark.readStream.schema(schema).json(path) if streaming else spark.read.schema(schema).json(path)
    return df.withColumn("problem", request_problem())


def request_problem(max_chars: int = 50_000) -> Column:
    bad = F.exists(F.map_entries("settings_override"), lambda e: e["key"].endswith("threshold") & ~e["value"].between(0, 1))
    return (
        F.when(F.coalesce(F.length("text"), F.lit(0)) < 1, "text is empty")
        .when(F.length("text") > max_chars, "text is too long")
        .when(~F.coalesce(F.col("channel"), F.lit("govgpt")).isin("govgpt", "ifg", "kapa"), "unknown channel")
        .when(F.coalesce(bad, F.lit(False)), "threshold out of range")
    )


def sample_problem() -> Column:
    """What is wrong with an annotated sample; null if nothing is."""
    e = F.col("entities")
    off = F.exists(e, lambda x: x["start"].isNull() | x["end"].isNull() | (x["start"] < 0) | (x["start"] >= x["end"]) | (x["end"] > F.length("text")))
    return (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "id is missing")
        .when(F.coalesce(F.col("text"), F.lit("")) == "", "text is missing")
        .when(e.isNull(), "entities are missing")
        .when(F.exists(e, lambda x: F.coalesce(x["type"], F.lit("")) == ""), "an entity has no type")
        .when(F.coalesce(off, F.lit(False)), "an entity lies outside the text")
    )


def read_samples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(id, text, entities) of a JSON list of annotated samples. Strict: a bad sample fails the job; else it keeps its problem."""
    df = spark.read.schema(BENCHMARK).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    df = df.withColumn("problem", F.when(F.col("_corrupt_record").isNotNull(), "not valid JSON").otherwise(sample_problem())).drop("_corrupt_record")
    if not strict:
        return df
    fine = F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", F.lit("bad sample"), "id", "problem")))
    return df.where(fine).drop("problem")


def _svnr(key: Column) -> Column:
    """A valid social-insurance number from a key: serials whose check digit would be 10 step on by one."""
    day = F.lpad((key % 28 + 1).cast("string"), 2, "0")
    month = F.lpad((key % 12 + 1).cast("string"), 2, "0")
    year = F.lpad((key * 7 % 100).cast("string"), 2, "0")
    born = F.concat(day, month, year)

    def check(serial: Column) -> Column:
        digits = F.concat(serial.cast("string"), F.lit("0"), born)
        total = F.lit(0)
        for i, w in enumerate(SVNR_WEIGHTS):
            total = total + F.substring(digits, i + 1, 1).cast("int") * w
        return total % 11

    serial = (key * 13 % 899 + 100).cast("int")
    # Weight 3 or 7 or 9 on the serial's digits: one step changes the sum by 9 mod 11 or wraps, never staying at 10.
    serial = F.when(check(serial) == 10, serial + 1).otherwise(serial)
    return F.concat(serial.cast("string"), check(serial).cast("string"), F.lit(" "), born)


def _iban(key: Column) -> Column:
    """A valid Austrian IBAN in groups from a key."""
    account = (F.lit(1_200_000_000_000_000) + key.cast("long") * 7_919).cast("long")
    check = F.lpad((98 - ((account % 97) * 1_000_000 + 102_900) % 97).cast("string"), 2, "0")
    a = account.cast("string")
    return F.concat(F.lit("AT"), check, *(x for i in range(4) for x in (F.lit(" "), F.substring(a, 4 * i + 1, 4))))


def _pick(words: tuple[str, ...], key: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), (key % len(words)).cast("int"))


def person(key: Column) -> Column:
    return F.concat_ws(" ", _pick(L.FIRST_NAMES, key), _pick(L.LAST_NAMES, key * 5 + 3))


#: (template, parts). A part in braces is an annotated value; the rest is text.
TEMPLATES = (
    ("Sehr geehrte Frau {PER}, Ihre Anfrage zu {AKTENZAHL} ist eingelangt. Kontakt: {EMAIL}."),
    ("Herr {PER} gab die SVNR {SVN} und den IBAN {IBAN} bekannt."),
    ("Das Fahrzeug {KFZ} ist auf Frau {PER} zugelassen, geboren am {GEBURTSDATUM}."),
    ("Bescheid vom {GEBURTSDATUM}: {AKTENZAHL}, zugestellt an {EMAIL} und Herrn {PER}."),
)


def _values(key: Column) -> dict[str, Column]:
    return {
        "PER": person(key),
        "AKTENZAHL": F.concat(F.lit("GZ BMI-"), (key % 30 + 1995).cast("string"), F.lit("/"), F.lpad((key * 3 % 10_000).cast("string"), 4, "0")),
        "EMAIL": F.concat(F.lit("k"), key.cast("string"), F.lit("@example.at")),
        "SVN": _svnr(key),
        "IBAN": _iban(key),
        "KFZ": F.concat(_pick(("W", "GU", "LL", "SB"), key), F.lit("-"), (key % 89_999 + 10_000).cast("string"), F.lit("A")),
        "GEBURTSDATUM": F.concat((key % 28 + 1).cast("string"), F.lit("."), (key % 12 + 1).cast("string"), F.lit("."), (key % 60 + 1940).cast("string")),
    }


def build(parts: list[tuple[Column, str | None]]) -> tuple[Column, Column]:
    """(text, entities) of parts (value, type or None for plain text), offsets from the lengths before."""
    at, spans = F.lit(0), []
    for value, kind in parts:
        end = at + F.length(value)
        if kind:
            spans.append(F.struct(at.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("type")))
        at = end
    return F.concat(*(v for v, _ in parts)), F.array(*spans)


def annotated(df: DataFrame, key: Column, turn: Column) -> DataFrame:
    """``df`` with text and entities: a template by ``turn`` filled with values of ``key``."""
    texts, spans, columns = None, None, df.columns
    # Values first, as columns of their own: offsets name them many times.
    df = df.withColumn("__key", key)
    made = _values(F.col("__key"))
    df = df.withColumns({f"__{kind}": value for kind, value in made.items()} | {"__turn": turn})
    values, turn = {kind: F.col(f"__{kind}") for kind in made}, F.col("__turn")
    for n, template in enumerate(TEMPLATES):
        parts = []
        for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
            if piece:
                parts.append((values[piece[1:-1]], piece[1:-1]) if piece[0] == "{" else (F.lit(piece), None))
        text, entities = build(parts)
        mine = turn % len(TEMPLATES) == n
        texts = F.when(mine, text) if texts is None else texts.when(mine, text)
        spans = F.when(mine, entities) if spans is None else spans.when(mine, entities)
    return df.select(*columns, texts.alias("text"), spans.alias("entities"))


def generate(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """(id, text, entities): ``count`` annotated samples with valid numbers, templates in turn, the same for the same seed."""
    ids = spark.range(count)
    key = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_003))
    return annotated(ids, key, F.col("id")).select(F.format_string("syn-%06d", "id").alias("id"), "text", "entities")
