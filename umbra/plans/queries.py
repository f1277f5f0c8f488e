"""Registered queries: each operator over whole tables, or over documents derived from their keys.

The raw tables hold few of the things the detectors look for, so most queries
run over texts and spans that both engines derive alike from customer and
lineitem keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import checks, text
from umbra.functions import lexicons as L
from umbra.operators import channels, context, detectors, ensemble, evaluate, finders, quality, recognizers, resolve
from umbra.operators.spans import entity, find_all, greedy_dedup, overlap, safe
from umbra.plans.pipeline import anonymize, detect, normalise
from umbra.schema import ENTITIES
from umbra.settings import Settings
from umbra.sources import documents as docs
from umbra.sources import stores

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Below so many bytes for each core a table is dealt anew before detection, whose work far outweighs that of a shuffle.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: one file of one row group would be a single task's work. Larger ones stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < SMALL * cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, entities): an annotated document for each customer."""
    df = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")))
    return docs.annotated(df, F.col("doc_id"), F.col("doc_id"))


def spans_of(df: DataFrame, found: Column, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.explode(found).alias("s")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.word").alias("word"))


GROUPS, SOURCES = ("LOC", "EMAIL", "KFZ", "PER"), ("regex", "pii", "presidio_compat")
WORDS = ("Wien", "WIEN", "wien ", "Graz", "Linz", "graz-umgebung", "Steyr")


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, start, end, score, entity_group, source, word): spans from order lines, many of them overlapping."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    pick = lambda of, n: F.get(F.array(*map(F.lit, of)), (n % len(of)).cast("int"))
    start = (F.col("p") % 40).cast("int")
    return lines.select(
        "doc_id", "ord", start.alias("start"), (start + 1 + F.col("s") % 12).cast("int").alias("end"), ((F.col("p") * 7 + F.col("ord")) % 70 / 100 + 0.3).alias("score"),
        pick(GROUPS, F.col("p")).alias("entity_group"), pick(SOURCES, F.col("s")).alias("source"), pick(WORDS, F.col("p") * 3 + F.col("s")).alias("word"),
    )


def nested(spans: DataFrame) -> DataFrame:
    """(doc_id, entities) of flat spans, in the order of ``ord``."""
    each = F.struct("ord", "word", "entity_group", "score", "start", "end", "source")
    rows = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("x"))
    return rows.select("doc_id", F.transform("x", lambda e: entity(e["word"], e["entity_group"], e["score"], e["start"], e["end"], e["source"])).cast(ENTITIES).alias("entities"))


# ---- Sources and normalisation ----


@query
def at_corpus(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "text", F.to_json("entities").alias("entities"))


@query
def generated_samples(spark, sf_dir):
    """The generator's own annotations all hold: every value is where it says, every number valid."""
    df = docs.generate(spark, 500, seed=7)
    e = df.select("id", "text", F.explode("entities").alias("e")).select("id", F.col("e.type").alias("type"), F.substring("text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("w"))
    ok = F.when(F.col("type") == "SVN", checks.svnr_ok(F.col("w"))).when(F.col("type") == "IBAN", checks.iban_ok(F.col("w"))).otherwise(F.length("w") > 0)
    return e.groupBy("type").agg(F.count_if(~ok).alias("bad"))


def noisy(spark, sf_dir) -> DataFrame:
    """Customers' names with the characters that normalisation undoes, by key."""
    k = F.col("c_custkey")
    odd = ["‰", "÷", "—", "…", "“", " ", "​", "­", "‮", "а", "о", "С", "ο"]
    a, b = (F.get(F.array(*map(F.lit, odd)), (k * m % len(odd)).cast("int")) for m in (1, 5))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("Fr"), a, F.lit("u  \t "), docs.person(k), b, F.lit("-\nEnde  "), a, F.lit(" Mü-  \nller")).alias("text"))


@query
def fix_encoding(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.fix_encoding(F.col("text")).alias("text"))


@query
def strip_invisible(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.remove_invisible(F.col("text")).alias("text"))


@query
def homoglyphs(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.replace_homoglyphs(F.col("text")).alias("text"))


@query
def collapse_ws(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.normalize_whitespace(F.col("text")).alias("text"))


@query
def rejoin_hyphenation(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", text.rejoin_hyphenation(F.col("text")).alias("text"))


@query
def leetspeak(spark, sf_dir):
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("Frau "), F.translate(docs.person(k), "oleast", "013457"), F.lit(", Nr. 10345")).alias("text"))
    return df.select("doc_id", text.normalize_leetspeak_in_names(F.col("text")).alias("text"))


@query
def normalised_text(spark, sf_dir):
    """Whole normalisation, NFKC included, over the noisy names and over documents."""
    both = noisy(spark, sf_dir).unionByName(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return both.select("doc_id", F.sha2(normalise(F.col("text")), 256).alias("sha256"))


@query
def cologne_phonetic(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), docs.person(F.col("c_custkey")).alias("name"))
    words = df.select("doc_id", F.explode(F.split("name", " ")).alias("word")).unionByName(table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.col("text"), "[^A-Za-z]+")).alias("word")).where("word <> ''").distinct())
    return words.select("doc_id", "word", text.cologne(F.col("word")).alias("code"))


# ---- Finders ----


@query
def email_spans(spark, sf_dir):
    return spans_of(table(spark, sf_dir, "documents"), finders.emails(safe(F.col("text"))))


@query
def phone_spans(spark, sf_dir):
    return spans_of(table(spark, sf_dir, "documents"), finders.phones(safe(F.col("text"))))


def _corpus_finder(name: str, find):
    def run(spark, sf_dir):
        return spans_of(corpus(spark, sf_dir), find(F.col("text")))

    run.__name__ = name
    return query(run)


for _name, _find in (
    ("svnr_spans", finders.svnrs),
    ("iban_spans", finders.ibans),
    ("date_spans", finders.birth_dates),
    ("plate_spans", finders.plates),
    ("file_number_spans", finders.file_numbers),
    ("titled_name_spans", finders.titled_names),
    ("corpus_email_spans", finders.emails),
):
    _corpus_finder(_name, _find)


def towns(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    street = F.get(F.array(*map(F.lit, ("Hauptgasse", "Ringweg", "Am Markt", "Kaiplatz"))), (k % 4).cast("int"))
    gap = F.get(F.array(*map(F.lit, (", ", ",   ", " und dann, ", ",\n"))), (k * 3 % 4).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("wohnt "), street, F.lit(" "), (k % 90 + 1).cast("string"), gap, (k % 9000 + 1000).cast("string"), F.lit(" Wien. Zuvor, 8010 Graz")).alias("text"))


@query
def address_spans(spark, sf_dir):
    """Streets joined with towns at most five characters on."""
    return spans_of(towns(spark, sf_dir), finders.addresses(F.col("text")))


@query
def tax_spans(spark, sf_dir):
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("St.-Nr. "), (k % 90 + 10).cast("string"), F.when(k % 3 == 0, "-").otherwise("/"), (k % 900 + 100).cast("string"), F.lit("/"), (k % 9000 + 1000 - F.when(k % 5 == 0, 950).otherwise(0)).cast("string"), F.lit(" gilt")).alias("text"))
    return spans_of(df, finders.tax_numbers(F.col("text")))


@query
def context_numbers(spark, sf_dir):
    """Passport and card numbers right behind their context, and none elsewhere."""
    k = F.col("c_custkey")
    lead = F.get(F.array(*map(F.lit, ("Reisepass: ", "Passnummer ", "Reisepass-Nr. ", "Ausweisnummer: ", "Raum "))), (k % 5).cast("int"))
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("Der "), lead, F.lit("P"), F.lpad((k % 10_000_000).cast("string"), 7, "0"), F.lit(" liegt vor")).alias("text"))
    return spans_of(df, F.concat(finders.passports(F.col("text")), finders.id_cards(F.col("text"))))


@query
def long_date_spans(spark, sf_dir):
    """Dates with the month's name; days and months that don't exist, and years out of range, are none."""
    k = F.col("c_custkey")
    month = F.get(F.array(*map(F.lit, (*finders.MONTHS.split("|"), "Brumaire"))), (k % 14).cast("int"))
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("Bescheid, Wien "), (k % 33).cast("string"), F.lit(". "), month, F.lit(" "), (k * 7 % 300 + 1850).cast("string"), F.lit(" (Kopie)")).alias("text"))
    return spans_of(df, finders.long_dates(F.col("text")))


@query
def labeled_name_spans(spark, sf_dir):
    """Names behind a role and a colon; without the colon, or in small letters, none."""
    k = F.col("c_custkey")
    lead = F.get(F.array(*map(F.lit, ("Verfasserin: ", "Protokollführer:  ", "Kontakt:", "Autor ", "Leser: ", "Erstellt von: "))), (k % 6).cast("int"))
    name = F.when(k % 5 == 0, F.lower(docs.person(k))).otherwise(docs.person(k))
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("Akt 7. "), lead, name, F.lit(", am Amt")).alias("text"))
    return spans_of(df, finders.labeled_names(F.col("text")))


#: (recognizer, a valid value, a value that is none, words of its context)
RECOGNIZED = (
    (recognizers.SVNR, "1237 010180", "1234 151587", "SVNR"),
    (recognizers.IBAN, "AT61 1904 3002 3457 3201", "AT00 0000 0000 0000 0000", "Konto"),
    (recognizers.PLATE, "GU-1234A", "QQ-1234A", "Kennzeichen"),
    (recognizers.COMPANY_NUMBER, "FN 12345a", "FN 1234567a", "Firmenbuch"),
    (recognizers.PASSPORT, "P1234567", "P123456", "Reisepass"),
    (recognizers.UID, "ATU13585627", "ATU12345678", "UID"),
    (recognizers.BIC, "GIBAATWWXXX", "ZZZZZZ99", "Bankleitzahl"),
    (recognizers.ICD10, "F32.1", "U07.1", "Diagnose"),
    (recognizers.DRIVING_LICENCE, "12345678", "1234567", "Führerschein"),
    (recognizers.RESIDENTS_NUMBER, "123 456 789 012", "123 456 789 01", "Melderegister"),
    (recognizers.COURT_NUMBER, "3 Ob 12/24", "3 Xy 12/24", "Urteil"),
)


@query
def recognizer_values(spark, sf_dir):
    """Each recognizer on a valid value near its context, far from it and without, and on a value that is none."""
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"))
    out = None
    for i, (of, valid, wrong, about) in enumerate(RECOGNIZED):
        text = F.concat(F.when(F.col("doc_id") % 3 == 0, f"{about}: ").when(F.col("doc_id") % 3 == 1, "Wert: ").otherwise(f"{about} {'x' * 60} "), F.when(F.col("doc_id") % 7 == 0, wrong).otherwise(valid), F.lit(" folgt"))
        own = df.where(F.col("doc_id") % len(RECOGNIZED) == i).select("doc_id", text.alias("text"))
        own = own.select("doc_id", F.explode(of.find(F.col("text"))).alias("e"))
        out = own if out is None else out.unionAll(own)
    return out.select("doc_id", "e.entity_group", "e.start", "e.end", "e.word", F.round("e.score", 6).alias("score"))


@query
def model_detector_rules(spark, sf_dir):
    """The rules around models, with stubs for these: offsets looked up, labels mapped, words cleaned, thresholds and the blacklist."""
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("Bericht: der Kunde"), k.cast("string"), F.lit(", wohnt in Wien; Termin.")).alias("text"))

    def said(*rows):
        fields = ("word", "entity_group", "score", "start", "end")
        return lambda text: F.array(*(F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(f) for f, v in zip(fields, r, strict=True))) for r in rows)).cast(detectors.MODEL_OUTPUT)

    score, whole = F.col("doc_id") % 10 / 10, F.concat(F.lit("Kunde"), F.col("doc_id").cast("string"))
    pii = said((F.concat(F.lit("\u2581"), whole), "B-PER", score, None, None), ("der Kunde", "USERNAME", 0.9, 9, 18), ("fehlt", "PER", 0.9, None, None), ("Termin", "PER", 0.95, None, None))
    org = said(("Wien", "I-LOC", 1 - score, None, None), ("Bericht", "B-MISC", 0.99, 0, 7))
    asked = said((whole, "person name", 0.5, 13, 20), ("wohnt", "hobby", score, 0, 0), ("Termin", "date of birth", 0.9, 0, 6))
    found = F.concat(*(d(F.col("text")) for d in detectors.model_detectors(Settings(), pii, org, asked)))
    e = df.select("doc_id", F.explode(found).alias("e"))
    return e.select("doc_id", "e.word", "e.entity_group", "e.score", "e.start", "e.end", "e.source")


@query
def mask_rank_anomaly(spark, sf_dir):
    k = F.col("c_custkey")
    tokens = F.array(F.lit(" Wien"), F.lit("Graz "), F.lit("linz"), F.lit("Amt"))
    word = F.get(F.array(*map(F.lit, ("WIEN", "Graz Umgebung", "Steyr", "amt", "Linz"))), (k % 5).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), detectors.rank_anomaly(tokens, word).alias("anomaly"))


@query
def names_by_sound(spark, sf_dir):
    """Last names found by how a variant of one sounds."""
    k = F.col("c_custkey")
    last = F.get(F.array(*map(F.lit, L.LAST_NAMES)), (k % len(L.LAST_NAMES)).cast("int"))
    spelt = F.replace(F.replace(F.translate(last, "dbgckvwf", "tpkkcfvv"), F.lit("ai"), F.lit("ey")), F.lit("l"), F.lit("ll"))
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"), spelt.alias("word"))
    return resolve.names_by_sound(df)


@query
def regex_layer(spark, sf_dir):
    """All finders in order of priority, overlaps resolved."""
    df = corpus(spark, sf_dir).select("doc_id", F.explode(finders.find_entities(F.col("text"))).alias("e"))
    return df.groupBy((F.col("doc_id") % 4).alias("template"), F.col("e.entity_group").alias("entity_group")).agg(F.count(F.lit(1)).alias("n"))


@query
def recognizer_layer(spark, sf_dir):
    df = corpus(spark, sf_dir).select("doc_id", F.explode(recognizers.recognize(F.col("text"))).alias("e"))
    return df.select("doc_id", "e.entity_group", "e.start", "e.end", "e.word", F.round("e.score", 6).alias("score"))


@query
def name_lexicon_hits(spark, sf_dir):
    """Dictionary names in documents, in any case."""
    return spans_of(table(spark, sf_dir, "documents"), recognizers.NAME.find(safe(F.col("text")))).groupBy(F.lower("word").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query
def art9_terms(spark, sf_dir):
    k = F.col("c_custkey")
    terms = [t for of in L.ART9_TERMS.values() for t in of]
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("Bekenntnis "), F.get(F.array(*map(F.lit, terms)), (k % len(terms)).cast("int")), F.lit(" laut Akt")).alias("text"))
    found = df.select("doc_id", F.explode(recognizers.ART9.find(F.col("text"))).alias("e"))
    return found.groupBy("doc_id").agg(F.max("e.end").alias("end"), F.min("e.start").alias("start"))


# ---- Checks and lexicons ----


def numbers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))


@query
def svnr_check(spark, sf_dir):
    """Valid numbers and ones with a wrong last digit."""
    v = F.col("value")
    df = numbers(spark, sf_dir).select("k", docs._svnr(F.col("k")).alias("good")).select("k", F.when(F.col("k") % 3 == 0, F.concat(F.substring("good", 1, 10), ((F.substring("good", 11, 1).cast("int") + 1) % 10).cast("string"))).otherwise(F.col("good")).alias("value"))
    return df.select("k", "value", checks.svnr_ok(v).alias("ok"))


@query
def iban_check(spark, sf_dir):
    v = F.col("value")
    df = numbers(spark, sf_dir).select("k", docs._iban(F.col("k")).alias("good")).select("k", F.when(F.col("k") % 3 == 0, F.concat(F.substring("good", 1, 23), ((F.substring("good", 24, 1).cast("int") + 1) % 10).cast("string"))).otherwise(F.col("good")).alias("value"))
    return df.select("k", "value", checks.iban_ok(v).alias("ok"))


@query
def uid_check(spark, sf_dir):
    df = numbers(spark, sf_dir).select("k", F.concat(F.lit("ATU"), F.lpad((F.col("k") * 7_919 % 100_000_000).cast("string"), 8, "0")).alias("value"))
    return df.select("k", "value", checks.uid_ok(F.col("value")).alias("ok"))


@query
def bic_check(spark, sf_dir):
    codes = ("GIBAATWW", "RLNWATWWXXX", "MINISTERRAT", "BKAUATWW123", "ABCDZZ22", "DEUTDEFF5", "diagnose", "OBKLAT2L")
    df = numbers(spark, sf_dir).select("k", F.get(F.array(*map(F.lit, codes)), (F.col("k") % len(codes)).cast("int")).alias("value"))
    return df.select("k", "value", checks.bic_ok(F.col("value")).alias("ok"))


@query
def icd10_check(spark, sf_dir):
    k = F.col("k")
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabc"), (k % 29 + 1).cast("int"), F.lit(1))
    df = numbers(spark, sf_dir).select("k", F.concat(letter, F.lpad((k * 31 % 100).cast("string"), 2, "0"), F.when(k % 4 == 0, F.concat(F.lit("."), (k % 7).cast("string"))).otherwise("")).alias("value"))
    return df.select("k", "value", checks.icd10_ok(F.col("value")).alias("ok"))


@query
def blacklist_anti(spark, sf_dir):
    """Distinct words of documents and conversations that the blacklist lets through, with their counts."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", r"[\s.,;:!?]+")).alias("word")).unionByName(numbers(spark, sf_dir).select(F.get(F.array(*map(F.lit, L.BLACKLIST)), (F.col("k") % len(L.BLACKLIST)).cast("int")).alias("word")))
    return words.where(~checks.is_blacklisted(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query
def whitelist_filter(spark, sf_dir):
    k = F.col("k")
    words = (*L.LEGAL_CODES[:20], *(a.upper() for a in L.AUTHORITIES[:30]), "Magistrat Wien", "Magistratisch", " BMI ", "avg", "Firma Huber")
    df = numbers(spark, sf_dir).select("k", F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int")).alias("word"), F.get(F.array(*map(F.lit, ("ORG", "LOC", "PER", "ORG_DETECTED"))), (k * 7 % 4).cast("int")).alias("entity_group"))
    return df.where(~checks.is_whitelisted(F.col("word"), F.col("entity_group")))


@query
def legal_paragraphs(spark, sf_dir):
    texts = ("§ 12", "§12a Abs. 3", "§ 5 Abs. 2 Z 3", "Art. 5", "Artikel 7 abs 1", "§ x", "siehe § 3", "§§ 4 Ziffer 2", "Art 9")
    df = numbers(spark, sf_dir).select("k", F.get(F.array(*map(F.lit, texts)), (F.col("k") % len(texts)).cast("int")).alias("value"))
    return df.select("k", "value", checks.is_legal_paragraph(F.col("value")).alias("ok"))


# ---- Span algebra ----


@query
def span_islands(spark, sf_dir):
    return ensemble.islands(line_spans(spark, sf_dir)).select("doc_id", "ord", "island")


@query
def noisy_or(spark, sf_dir):
    """Merging in nested form: score, label, span and sources of every group."""
    merged = nested(line_spans(spark, sf_dir)).select("doc_id", F.explode(ensemble.merge_entities(F.col("entities"), F.lit("x" * 60))).alias("e"))
    return merged.select("doc_id", "e.start", "e.end", F.round(F.round("e.score", 12), 5).alias("score"), "e.entity_group", F.size("e.sources").alias("n_sources"), (F.col("e.source") == "ensemble").alias("several"))


@query
def noisy_or_flat(spark, sf_dir):
    """The same by windows and grouping."""
    flat = ensemble.merge_flat(line_spans(spark, sf_dir))
    return flat.select("doc_id", "start", "end", F.round(F.round("score", 12), 5).alias("score"), "entity_group", F.col("n_sources").cast("int").alias("n_sources"), (F.col("n_sources") > 1).alias("several"))


@query
def span_dedup(spark, sf_dir):
    """Greedy de-duplication in order of detection."""
    kept = nested(line_spans(spark, sf_dir)).select("doc_id", F.explode(greedy_dedup(F.col("entities"))).alias("e"))
    return kept.select("doc_id", "e.start", "e.end", F.round("e.score", 6).alias("score"))


@query
def overlap_semijoin(spark, sf_dir):
    """Spans overlapped by another one with a score of 0.8 or more."""
    df = nested(line_spans(spark, sf_dir))
    own = F.transform("entities", lambda e, i: F.struct(e.alias("e"), F.exists(F.filter("entities", lambda o, j: j != i), lambda o: overlap(e, o) & (o["score"] >= 0.8)).alias("known")))
    return df.select("doc_id", F.explode(own).alias("x")).where("x.known").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query
def containment(spark, sf_dir):
    """Spans inside another span of the document."""
    df = nested(line_spans(spark, sf_dir))
    own = F.transform("entities", lambda e, i: F.size(F.filter("entities", lambda o, j: (j != i) & (o["start"] <= e["start"]) & (e["end"] <= o["end"]))))
    return df.select("doc_id", F.aggregate(own, F.lit(0), lambda a, n: a + n).alias("n"))


# ---- Resolution, channels ----


@query
def canonical_keys(spark, sf_dir):
    k = F.col("c_custkey")
    titled = F.concat(F.get(F.array(*map(F.lit, ("Dr. ", "Frau Mag. ", "", "der ", "Herr DI "))), (k % 5).cast("int")), docs.person(k), F.lit(", "))
    firm = F.concat(F.lit("Die Firma "), F.get(F.array(*map(F.lit, L.LAST_NAMES)), (k % len(L.LAST_NAMES)).cast("int")), F.lit(" & Co GmbH"))
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.when(k % 2 == 0, titled).otherwise(firm).alias("word"), F.when(k % 2 == 0, "PER").otherwise("ORG").alias("entity_group"))
    return df.select("doc_id", resolve.canonical_key(F.col("word"), F.col("entity_group")).alias("key"))


@query
def resolved_names(spark, sf_dir):
    """Single names linked to full ones, literally or by sound."""
    k = F.col("c_custkey")
    last = F.get(F.array(*map(F.lit, L.LAST_NAMES)), (k % len(L.LAST_NAMES)).cast("int"))
    mentions = F.array(F.concat(F.lit("Frau Anna "), last), last, F.replace(last, F.lit("ei"), F.lit("ai")), F.lit("Gruber-Fremd"), F.lit("Anna"))
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.transform(mentions, lambda m, i: entity(m, "PER", 0.9, i * 20, i * 20 + 5, "regex")).cast(ENTITIES).alias("entities"))
    return df.select("doc_id", F.array_join(resolve.resolve_entities(F.col("entities")), "|").alias("keys"))


@query
def placeholder_numbering(spark, sf_dir):
    """Placeholders of every mention, numbered by first mention."""
    df = nested(line_spans(spark, sf_dir)).withColumn("norm_text", F.lit("x" * 60))
    named = channels._named(df, Settings(), review=False).select("doc_id", F.explode("__e").alias("e")).where("e.placeholder <> ''")
    return named.groupBy("doc_id", "e.placeholder").agg(F.count(F.lit(1)).alias("n"))


@query
def mapping_longest(spark, sf_dir):
    df = nested(line_spans(spark, sf_dir)).withColumn("norm_text", F.lit("x" * 60))
    return channels._named(df, Settings(), review=False).select("doc_id", F.explode(channels._mapping()).alias("placeholder", "original"))


@query
def redaction_protocol(spark, sf_dir):
    df = nested(line_spans(spark, sf_dir)).withColumn("norm_text", F.lit("x" * 60))
    rows = channels.ifg(df, Settings(run_quality_check=False)).select("doc_id", F.inline("redaction_protocol"))
    return rows.select("doc_id", "category", "count", F.round("min_confidence", 6).alias("min_confidence"), F.round("max_confidence", 6).alias("max_confidence"))


@query
def kapa_actions(spark, sf_dir):
    df = nested(line_spans(spark, sf_dir)).withColumn("norm_text", F.lit("x" * 60))
    rows = stores.audit_rows(channels.kapa(df, Settings(run_quality_check=False), now=F.lit("2026-01-01 00:00:00").cast("timestamp")))
    return rows.groupBy("document_id", "action").agg(F.count(F.lit(1)).alias("n"))


@query
def context_snippets(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(find_all(F.col("text"), finders.EMAIL, guard=F.col("text").contains("@"))).alias("s"))
    return df.select("doc_id", F.col("s.start").alias("start"), channels.snippet(F.col("text"), F.col("s.start"), F.col("s.end"), F.lit("[EMAIL_1]")).alias("snippet"))


def _channel_text(name: str):
    def run(spark, sf_dir):
        return anonymize(corpus(spark, sf_dir).drop("entities"), name).select("doc_id", "output", F.col("quality.passed").alias("passed"))

    run.__name__ = f"{name}_text"
    return query(run)


for _name in channels.CHANNELS:
    _channel_text(_name)


@query
def redacted_emails(spark, sf_dir):
    """Documents with their addresses redacted."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("norm_text"), F.transform(finders.emails(F.col("text")), lambda e: e.withField("placeholder", F.lit("[GESCHWÄRZT:EMAIL]"))).alias("e"))
    return df.where(F.size("e") > 0).select("doc_id", F.size("e").alias("n"), channels.rewrite(F.col("norm_text"), F.col("e")).alias("output"))


@query
def detected_documents(spark, sf_dir):
    """The whole detection over documents: entities by category and layer."""
    found = detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", F.explode("entities").alias("e"))
    return found.groupBy("e.entity_group", "e.source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query
def reidentified(spark, sf_dir):
    """Reversible output put back gives the text again, but for spaces set around placeholders."""
    df = anonymize(corpus(spark, sf_dir).drop("entities"), "govgpt", settings=Settings(run_quality_check=False))
    return df.select("doc_id", channels.reidentify(F.col("output"), F.col("mapping")).alias("text"))


# ---- Context and quality ----


def attributes(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    pad = F.repeat(F.lit("x "), (k % 5 * 30).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("Der Fall: die Zeugin sah es. "), pad, F.get(F.array(*map(F.lit, ("Sie ist Notarin hier.", "Jahrgang 1980 laut Akt.", "die Patientin kam.", "Sohn des Bauern war da.", "nichts weiter."))), (k * 3 % 5).cast("int"))).alias("text"))


@query
def quasi_id_windows(spark, sf_dir):
    df = attributes(spark, sf_dir)
    found = context.quasi_identifiers(F.col("text"), F.array().cast(ENTITIES), Settings())
    return df.select("doc_id", F.explode(found).alias("e")).select("doc_id", "e.start", "e.end", "e.word", "e.context")


@query
def company_contexts(spark, sf_dir):
    """Candidates for company names, before any model scores them."""
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.get(F.array(*map(F.lit, ("Er kam zur Firma ", "Lieferung an die ", "Sie ist Kunde von ", "Wir gehen zum "))), (k % 4).cast("int")), F.get(F.array(*map(F.lit, L.LAST_NAMES)), (k % len(L.LAST_NAMES)).cast("int")), F.lit(" am Tag")).alias("text"))
    found = context.company_candidates(F.col("text"), F.array().cast(ENTITIES))
    return df.select("doc_id", F.explode(found).alias("c")).select("doc_id", F.col("c.s.start").alias("start"), F.col("c.s.word").alias("word"), F.col("c.masked").alias("masked"))


@query
def placeholder_format(spark, sf_dir):
    marks = ("[PERSON_1]", "[PRÜFEN:ORT_2]", "[GESCHWÄRZT:IBAN]", "[x]", "[AUSTRIAN VAT ID_1]", "[EMAIL]", "kein Zeichen")
    k = F.col("k")
    df = numbers(spark, sf_dir).select("k", F.concat(F.lit("Text "), F.get(F.array(*map(F.lit, marks)), (k % len(marks)).cast("int")), F.lit(" Ende")).alias("text"))
    return df.select("k", F.explode(quality.malformed(find_all(F.col("text"), quality.PLACEHOLDER))).alias("i")).select("k", F.col("i.position").alias("position"), F.col("i.snippet").alias("snippet"))


@query
def name_pair_leaks(spark, sf_dir):
    k = F.col("k")
    tail = F.get(F.array(*map(F.lit, (" kam", " Haus", " und", ""))), (k % 4).cast("int"))
    df = numbers(spark, sf_dir).select("k", F.concat(F.lit("[X_1] "), F.when(k % 2 == 0, docs.person(k)).otherwise(F.get(F.array(*map(F.lit, L.LAST_NAMES)), (k % len(L.LAST_NAMES)).cast("int"))), tail).alias("text"))
    found = quality.left_names(F.col("text"), find_all(F.col("text"), quality.PLACEHOLDER))
    return df.select("k", F.explode(found).alias("i")).select("k", "i.type", F.col("i.position").alias("position"), F.col("i.snippet").alias("snippet"))


@query
def quality_report(spark, sf_dir):
    """Quality of texts of which only some values are redacted."""
    df = corpus(spark, sf_dir).withColumn("entities", F.transform("entities", lambda g, i: entity(F.substring("text", g["start"] + 1, g["end"] - g["start"]), g["type"], 0.9, g["start"], g["end"], "regex", placeholder=F.when(i % 2 == 0, "[PERSON_1]").otherwise(""))).cast(ENTITIES))
    df = df.withColumn("output", channels.rewrite(F.col("text"), F.col("entities")))
    return quality.check_output(df, "output").select("doc_id", F.col("quality.leak_count").alias("leak_count"), F.col("quality.passed").alias("passed"))


# ---- Evaluation ----


def judged(spark, sf_dir) -> DataFrame:
    """(doc_id, predicted, truth): spans of order lines against the same ones moved by a few characters."""
    spans = line_spans(spark, sf_dir)
    both = nested(spans)
    moved = F.transform(F.filter("entities", lambda e, i: i % 3 != 0), lambda e, i: F.struct((e["start"] + i % 3).alias("start"), (e["end"] + i % 3).alias("end"), e["entity_group"].alias("type")))
    return both.select("doc_id", F.col("entities").alias("predicted"), moved.alias("truth"))


def _scored(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in ("precision", "recall", "f1")], *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query
def prf_by_category(spark, sf_dir):
    return _scored(evaluate.evaluate(judged(spark, sf_dir))).where("category IS NOT NULL")


@query
def prf_overall_rollup(spark, sf_dir):
    return _scored(evaluate.evaluate(judged(spark, sf_dir))).where("category IS NULL").drop("category")


@query
def prf_by_layer(spark, sf_dir):
    return _scored(evaluate.evaluate_layers(judged(spark, sf_dir)))


@query
def pipeline_accuracy(spark, sf_dir):
    """Detection against the corpus' own annotations: precision and recall by category."""
    df = detect(corpus(spark, sf_dir).withColumnRenamed("entities", "truth")).withColumnRenamed("entities", "predicted")
    return _scored(evaluate.evaluate(df)).where("category IS NOT NULL")


@query
def regression_gate(spark, sf_dir):
    """A run without every third document's predictions against the whole one."""
    df = judged(spark, sf_dir)
    worse = df.withColumn("predicted", F.when(F.col("doc_id") % 3 == 0, F.array().cast(ENTITIES)).otherwise(F.col("predicted")))
    return evaluate.compare(evaluate.evaluate(df), evaluate.evaluate(worse), critical=("EMAIL", "KFZ"))


@query
def leak_rescan(spark, sf_dir):
    """Outputs in which every second annotated value was left, by channel."""
    df = corpus(spark, sf_dir).withColumnRenamed("entities", "truth")
    df = df.withColumn("e", F.transform(F.filter("truth", lambda g, i: i % 2 == 0), lambda g: entity(F.lit(""), g["type"], 0.9, g["start"], g["end"], "regex", placeholder="[X_1]")).cast(ENTITIES))
    df = df.withColumn("output", channels.rewrite(F.col("text"), F.col("e"))).withColumn("channel", F.when(F.col("doc_id") % 2 == 0, "ifg").otherwise("kapa"))
    return evaluate.leak_summary(evaluate.leak_report(df))


# ---- Stores ----


def audit_log(spark, sf_dir) -> DataFrame:
    """An audit log from events."""
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    return e.select(
        F.when(F.col("event_id") % 97 == 0, F.lit(None)).otherwise(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("user_id").cast("string").alias("document_id"), F.when(F.col("event_id") % 11 == 0, stores.REDACTED).otherwise(F.concat(F.lit("Wert "), F.col("event_id").cast("string"))).alias("entity_word"), F.upper("event_type").alias("entity_group"),
        (F.col("value") % 1.0).alias("confidence"), F.lit("regex").alias("source_layer"), F.when(F.col("value") > 5, "flagged_for_review").otherwise("anonymized").alias("action"), F.concat(F.lit("["), F.upper("event_type"), F.lit("_1]")).alias("placeholder"), F.lit("").alias("context_snippet"), none.alias("reviewer"), none.alias("review_decision"), "event_id",
    )


NOW = "2024-05-01 00:00:00"


@query
def retention_sweep(spark, sf_dir):
    """Entries of 90 days redacted, of 110 days deleted, as of a fixed day."""
    settings = Settings(pii_redact_after_days=90, hard_delete_after_days=110)
    return stores.enforce_retention(audit_log(spark, sf_dir), F.lit(NOW).cast("timestamp"), settings).select("event_id", "entity_word", "changed")


@query
def retention_counts(spark, sf_dir):
    return stores.retention_summary(audit_log(spark, sf_dir), F.lit(NOW).cast("timestamp"), Settings(pii_redact_after_days=90, hard_delete_after_days=110))


@query
def forget_document(spark, sf_dir):
    log = audit_log(spark, sf_dir)
    gone = log.where("event_id % 100 = 3").select("document_id")
    return stores.forget(log, gone).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query
def audit_flagged(spark, sf_dir):
    return stores.flagged(audit_log(spark, sf_dir)).groupBy("entity_group").agg(F.count(F.lit(1)).alias("n"))


@query
def mapping_upsert(spark, sf_dir):
    """The last stored mapping of each document."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.hour("ts").alias("version"), F.concat(F.lit("["), F.upper("event_type"), F.lit("_"), (F.col("event_id") % 5).cast("string"), F.lit("]")).alias("placeholder"), F.col("event_id").cast("string").alias("original"))
    return stores.latest_mappings(rows)


@query
def entity_metrics_histogram(spark, sf_dir):
    df = nested(line_spans(spark, sf_dir)).withColumn("channel", F.lit("ifg"))
    return stores.entity_metrics(df)


def queries() -> dict[str, Query]:
    return dict(_found)
