"""Finders, recognizers, merging, context and channels on small texts."""

import re

import pytest
from pyspark.sql import functions as F

from umbra.functions import checks, text
from umbra.operators import channels, context, detectors, ensemble, finders, quality, recognizers, resolve
from umbra.operators.spans import entity, find_all, greedy_dedup, safe
from umbra.plans.pipeline import anonymize, detect, normalise
from umbra.schema import ENTITIES
from umbra.settings import Settings


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", column(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def words(spark, find, texts):
    return [[(e.word, e.start, e.end) for e in v] for v in values(spark, texts, find)]


def test_find_all_has_the_offsets_of_re(spark):
    texts = ["a1 b22", "𝐌 x9 ü7", "", "none", "12\n34"]
    got = values(spark, texts, lambda t: find_all(t, r"\d+"))
    assert [[(s.start, s.end, s.word) for s in v] for v in got] == [[(m.start(), m.end(), m.group()) for m in re.finditer(r"\d+", t)] for t in texts]


@pytest.mark.parametrize(
    ("find", "hit", "expected"),
    [
        (finders.emails, "an max@example.at.", ["max@example.at"]),
        (finders.file_numbers, "GZ BMI-2024/0815 und GZ 2024/4567", ["GZ BMI-2024/0815"]),
        (finders.svnrs, "1237 010180 und 1234 010180", ["1237 010180"]),
        (finders.ibans, "AT61 1904 3002 3457 3201, AT62 1904 3002 3457 3201", ["AT61 1904 3002 3457 3201"]),
        (finders.birth_dates, "am 1.2.1980, 32.1.1980", ["1.2.1980"]),
        (finders.long_dates, "am 20. Dezember 2023", ["20. Dezember 2023"]),
        (finders.addresses, "Schottenfeldgasse 29/3, 1070 Wien", ["Schottenfeldgasse 29/3, 1070 Wien"]),
        (finders.addresses, "Mariahilfer Straße 1a und dann,\n8010 Graz", ["Mariahilfer Straße 1a", "8010 Graz"]),
        (finders.titled_names, "Frau Dr. Maria Huber kam", ["Maria Huber"]),
        (finders.labeled_names, "Verfasserin: Eva Auer", ["Eva Auer"]),
        (finders.plates, "Kennzeichen W-12345A", ["W-12345A"]),
        (finders.phones, "Tel. 0664 1234567 oder 0316 12", ["0664 1234567"]),
        (finders.passports, "Reisepass: P1234567, Reisepass-Nr. P7654321", ["P1234567"]),
        (finders.id_cards, "Ausweisnummer: AB1234567", ["AB1234567"]),
        (finders.tax_numbers, "12-345/6789", ["12-345/6789"]),
    ],
)
def test_finders(spark, find, hit, expected):
    ((found),) = words(spark, find, [hit])
    assert [w for w, _, _ in found] == expected
    assert all(hit[s:e] == w for w, s, e in found)


def test_recognizers_ignore_case_and_use_context(spark):
    find = lambda t: recognizers.recognize(t)
    got = values(spark, ["ich weiß es", "Azubi", "Diagnose F32.1", "Raum F32.1", "BIC GIBAATWW", "römisch katholisch und SPÖ", "Führerschein 12345678, 87654321x", None, ""], find)
    pairs = [[(e.word, e.entity_group, round(e.score, 3)) for e in v or []] for v in got]
    assert pairs[0] == [("weiß", "PER", 0.7)]
    assert pairs[1] == [("Azubi", "AKTENZAHL", 0.85)]
    assert pairs[2] == [("F32.1", "HEALTH_DIAGNOSIS", 0.9)]
    assert pairs[3] == []
    assert ("GIBAATWW", "BIC", 0.9) in pairs[4]
    assert pairs[5] == [("römisch katholisch", "RELIGION", 0.9), ("SPÖ", "POLITICAL", 0.9)]
    assert pairs[6] == [("12345678", "FUEHRERSCHEIN", 0.85)]
    assert not pairs[7] and not pairs[8]


def test_checks(spark):
    assert values(spark, ["ATU13585627", "ATU13585626", "x"], checks.uid_ok) == [True, False, False]
    assert values(spark, ["U07.1", "A00", "c97", "C98", "V00"], checks.icd10_ok) == [False, True, False, False, False]
    assert values(spark, ["e - mail", "ab", "Huber", "Protokoll"], checks.is_blacklisted) == [True, True, False, True]
    assert values(spark, ["§ 12 Abs. 3", "Artikel 5", "siehe § 3"], checks.is_legal_paragraph) == [True, True, False]


def test_cologne(spark):
    assert values(spark, ["Meier", "Mayer", "Müller", "Schmidt", "", "123", "Weiß", "Philipp"], text.cologne) == ["67", "67", "657", "862", "", "", "38", "351"]


def test_normalise(spark):
    got = values(spark, ["M​üller", "Mü-\nller", "Herr M0s3r 10", "𝐌oser", "Моser", "a \t b", None], normalise)
    assert got == ["Müller", "Müller", "Herr Moser 10", "Moser", "Moser", "a b", ""]


def test_clean_entity(spark):
    df = spark.createDataFrame([("der Huber, kam", "Hub", 4, 7)], "t string, w string, s int, e int")
    r = df.select(text.clean_entity(F.col("w"), F.col("t"), F.col("s"), F.col("e")).alias("c")).first().c
    assert (r.word, r.start, r.end) == ("Huber", 4, 9)


def spans(*items):
    return F.array(*(entity(F.lit(w), g, s, F.lit(a), F.lit(b), src) for w, g, s, a, b, src in items)).cast(ENTITIES)


def test_merge_is_transitive_and_touching_spans_stay_apart(spark):
    e = spans(("aa", "PER", 0.9, 0, 4, "x"), ("bb", "LOC", 0.95, 3, 6, "y"), ("cc", "ORG", 0.5, 5, 8, "x"), ("dd", "PER", 0.7, 8, 9, "z"))
    got = spark.range(1).select(ensemble.merge_entities(e, F.lit("0123456789")).alias("m")).first().m
    assert [(x.word, x.entity_group, x.start, x.end, x.source, x.sources) for x in got] == [("01234567", "LOC", 0, 8, "ensemble", ["x", "y"]), ("dd", "PER", 8, 9, "z", ["z"])]
    assert got[0].score == pytest.approx(1 - 0.1 * 0.05 * 0.5)


def test_greedy_dedup_keeps_the_first(spark):
    e = spans(("b", "B", 0.5, 2, 5, "x"), ("a", "A", 0.9, 0, 9, "x"), ("c", "C", 0.9, 5, 6, "x"))
    assert [x.word for x in spark.range(1).select(greedy_dedup(e).alias("d")).first().d] == ["b", "c"]


def test_resolution(spark):
    def keys(*names):
        e = spans(*((n, "PER", 0.9, i * 10, i * 10 + 5, "x") for i, n in enumerate(names)))
        return spark.range(1).select(resolve.resolve_entities(e).alias("k")).first().k

    assert keys("Dr. Maria Huber", "Frau Huber", "Huber") == ["maria huber"] * 3
    assert keys("Karl Mayer", "Meier") == ["karl mayer"] * 2
    assert keys("Karl Huber", "Eva Huber", "Huber") == ["karl huber", "eva huber", "huber"]


def test_channels(spark):
    df = spark.createDataFrame([(1, "Frau Dr. Maria Huber ist evangelisch. Frau Huber: 0664 1234567."), (2, None), (3, "")], "doc_id long, text string")
    g = anonymize(df, "govgpt").orderBy("doc_id").collect()
    assert g[0].output == "Frau Dr. [PERSON_1] ist [RELIGION_1]. Frau [PERSON_1]: [TELEFON_1]."
    assert g[0].mapping == {"[PERSON_1]": "Maria Huber", "[RELIGION_1]": "evangelisch", "[TELEFON_1]": "0664 1234567"}
    assert g[0].quality.passed and [r.output for r in g[1:]] == ["", ""]
    i = anonymize(df, "ifg").orderBy("doc_id").first()
    assert "[GESCHWÄRZT:BESONDERE_KATEGORIE]" in i.output and {e.word for e in i.entities} == {"[REDACTED]"}
    assert not {"mapping", "norm_text"} & set(i.asDict())
    assert [(p.category, p["count"]) for p in i.redaction_protocol] == [("BESONDERE_KATEGORIE", 1), ("PERSON", 2), ("TELEFON", 1)]
    k = anonymize(df, "kapa").orderBy("doc_id").first()
    assert k.flagged_for_review == ["[PRÜFEN:RELIGION_1]"] and len(k.audit_entries) == 4
    with pytest.raises(ValueError, match="unknown channel"):
        anonymize(df, "other")


def test_rewrite_sets_spaces(spark):
    e = F.array(entity(F.lit("b"), "X", 0.9, F.lit(1), F.lit(2), "x", placeholder="[P_1]"), entity(F.lit("c"), "X", 0.9, F.lit(2), F.lit(3), "x", placeholder="[P_2]")).cast(ENTITIES)
    assert spark.range(1).select(channels.rewrite(F.lit("abc.d"), e).alias("o")).first().o == "a [P_1] [P_2].d"


def test_quasi_identifiers(spark):
    q = lambda t: context.quasi_identifiers(t, F.array().cast(ENTITIES), Settings())
    got = values(spark, ["die Zeugin, Jahrgang 1980", "die Zeugin", "die Zeugin " + "x " * 150 + "Jahrgang 1980"], q)
    assert [[e.word for e in v] for v in got] == [["die Zeugin", "Jahrgang 1980"], [], []]
    assert got[0][0].context == "Quasi-Identifikator: age, role in Kombination (k~4)"


def test_company_scorer(spark):
    d = detect(spark.createDataFrame([("Er kam zur Firma Nimbus heute",)], "text string"), scorer=lambda masked, word: F.lit(1.0)).first()
    assert [(e.word, e.entity_group, e.score) for e in d.entities] == [("Nimbus", "ORG_DETECTED", 0.95)]


def test_plugin_detector(spark):
    mine = lambda t: F.transform(find_all(t, "Nimbus"), lambda s: entity(s["word"], "ORG", 0.8, s["start"], s["end"], "org"))
    d = detect(spark.createDataFrame([("bei Nimbus",)], "text string"), detectors=[mine]).first()
    assert [(e.word, e.source) for e in d.entities] == [("Nimbus", "org")]


def test_quality_finds_leaks(spark):
    df = spark.createDataFrame([("[PERSON_1] max@example.at Karl Gruber und [x]",)], "output string").withColumn("entities", F.array().cast(ENTITIES))
    r = quality.check_output(df, "output").first().quality
    assert [(i.type, i.pii_type) for i in r.issues] == [("leak", "EMAIL"), ("format", "PLACEHOLDER"), ("leak", "PER_DICT")]
    assert not r.passed and r.leak_count == 2


def test_settings():
    s = Settings.from_env(env={"UMBRA_PII_THRESHOLD": "0.5", "UMBRA_USE_GLINER": "no"})
    assert (s.pii_threshold, s.use_gliner, s.quasi_id_window) == (0.5, False, 200)
    assert not Settings.profile("rest").use_whitelist
    with pytest.raises(ValueError, match="unknown profile"):
        Settings.profile("x")


def test_own_columns_stay_and_kapa_needs_no_id(spark):
    df = spark.createDataFrame([("Frau Maria Huber, max@example.at", "mine", "also", {"anomaly_threshold": 0.97})], "text string, __own string, __regex string, settings_override map<string,double>")
    d = detect(df).first()
    assert (d["__own"], d["__regex"]) == ("mine", "also") and {e.entity_group for e in d.entities} == {"PER", "EMAIL"}
    k = anonymize(df, "kapa").first()
    assert k.document_id and "max@example.at" not in k.output and k["__own"] == "mine"
    # A row's own threshold goes before the settings; missing ones change nothing.
    none = df.withColumn("settings_override", F.lit(None).cast("map<string,double>"))
    assert anonymize(none, overrides="settings_override").first().output == anonymize(df).first().output
    high = df.withColumn("settings_override", F.create_map(F.lit("anomaly_threshold"), F.lit(1.0)))
    assert anonymize(high, overrides="settings_override").first().output == df.first().text


def test_marks_of_the_text_hide_nothing(spark):
    raw = "x \ufdd0 a@b.at y \ufdd1 \ue000 c@d.at"
    found = spark.createDataFrame([(raw,)], "text string").select(finders.emails(safe(F.col("text"))).alias("e")).first().e
    assert [(e.start, e.end, e.word) for e in found] == [(raw.index("a@"), raw.index("a@") + 6, "a@b.at"), (raw.index("c@"), raw.index("c@") + 6, "c@d.at")]
    out = anonymize(spark.createDataFrame([(raw,)], "text string")).first().output
    assert "@" not in out and "\ue000" in out


def test_stable_characters_are_left_alone_by_nfkc():
    import re
    import unicodedata

    stable = re.compile(f"[{text.STABLE}]")
    seconds = {int(d[1], 16) for c in range(0x11_0000) if len(d := unicodedata.decomposition(chr(c)).split()) == 2 and not d[0].startswith("<")}
    for c in range(0x11_0000):
        if stable.match(chr(c)) and not 0xD800 <= c < 0xE000:
            assert unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c not in seconds, hex(c)
    assert all(stable.match(c) for c in "äöüÄÖÜß„“”–€§éàçñ") and not any(stable.match(c) for c in "ﬁ²½ ́Ａ…")


def test_model_detectors(spark):
    said = lambda *rows: lambda t: F.array(*(F.struct(*(F.lit(v).alias(f) for f, v in zip(("word", "entity_group", "score", "start", "end"), r, strict=True))) for r in rows)).cast(detectors.MODEL_OUTPUT)
    df = spark.createDataFrame([("Die Nimbus Bank schrieb Karla.",)], "text string")
    found = lambda **models: [(e.word, e.entity_group, e.start, e.end, e.source) for e in df.select(F.concat(*(d(F.col("text")) for d in detectors.model_detectors(**models))).alias("e")).first().e]
    assert found(pii=said(("▁Karla", "I-PER", 0.9, None, None), ("Kar", "PER", 0.9, 24, 27), ("x", "PER", 0.99, None, None), ("Nimbus", "PER", 0.1, 4, 10))) == [("▁Karla", "PER", 24, 29, "pii"), ("Karla", "PER", 24, 29, "pii")]
    assert found(org=said(("Die Nimbus", "B-ORG", 0.9, 0, 10), ("Bank", "MISC", 0.9, 11, 15))) == [("Nimbus", "ORG", 4, 10, "org")]
    assert found(zero_shot=said(("Nimbus Bank", "company name", 0.5, 4, 15), ("Karla", "pet", 0.39, 24, 29))) == [("Nimbus Bank", "ORG", 4, 15, "gliner")]
    assert found(zero_shot=lambda t: F.lit(None).cast(detectors.MODEL_OUTPUT)) == []
    assert detectors.model_detectors(Settings(use_gliner=False), zero_shot=said()) == []
    d = detect(df, detectors=detectors.model_detectors(org=said(("Nimbus Bank", "ORG", 0.9, 4, 15)))).first()
    assert ("Nimbus Bank", "ORG", "org") in [(e.word, e.entity_group, e.source) for e in d.entities]
