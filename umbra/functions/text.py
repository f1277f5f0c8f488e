"""Text normalisation and phonetics as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions import lexicons as L

#: Marks that find_all puts around matches: noncharacters, which Unicode keeps for a program's own use. Taken out of every text first.
MARKS = "\ufdd0\ufdd1\ufdd2"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fix_encoding(text: Column) -> Column:
    """Wrongly decoded characters made good."""
    return F.replace(F.translate(text, L.MISENCODED + L.MISENCODED_DROPPED, L.MISENCODED_AS), F.lit(L.ELLIPSIS), F.lit("..."))


def remove_invisible(text: Column) -> Column:
    return F.translate(text, L.INVISIBLE, "")


def rejoin_hyphenation(text: Column) -> Column:
    """Words split by a hyphen at a line's end, in one piece again."""
    return F.regexp_replace(text, r"(?U)(\w)-[ \t]*\n(\w)", "$1$2")


def _nfkc(text: Column) -> Column:
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(nfkc, "string")(text)


#: Characters that NFKC leaves as they are, whatever stands beside them: ASCII, Latin letters with marks, usual punctuation.
STABLE = "\x00-\x7f\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2010\u2012-\u2016\u2018-\u2023\u2030-\u2032\u2039-\u203b\u20a0-\u20a7\u20a9-\u20c0"


def normalize_unicode(text: Column) -> Column:
    """NFKC; Spark has no such function. Texts of STABLE characters alone, as German ones usually are, don't change and stay in the JVM."""
    return F.when(text.rlike(f"[^{STABLE}]"), _nfkc(text)).otherwise(text)


def replace_homoglyphs(text: Column) -> Column:
    return F.translate(text, L.HOMOGLYPHS, L.HOMOGLYPHS_AS)


def normalize_leetspeak_in_names(text: Column) -> Column:
    """Digits and signs read as letters in the word after a title."""
    pattern = r"(?U)((?:Herr|Herrn|Frau|Dr\.|Mag\.|Prof\.|Ing\.|DI|DKFM)\s+)([A-Za-zÄÖÜäöüß0-9@$]{2,30})"
    parts = F.split(F.regexp_replace(text, pattern, "$1\ufdd0$2\ufdd0"), "\ufdd0", -1)
    folded = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.translate(p, L.LEET, L.LEET_AS)).otherwise(p)), "")
    return F.when(text.rlike(pattern), folded).otherwise(text)


def normalize_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+", " ")


def normalize_adversarial(text: Column, leetspeak: bool = True) -> Column:
    """Obfuscation undone: invisible characters, hyphenation, NFKC, look-alikes, leetspeak, blanks, in this order."""
    text = replace_homoglyphs(normalize_unicode(rejoin_hyphenation(remove_invisible(text))))
    return normalize_whitespace(normalize_leetspeak_in_names(text) if leetspeak else text)


def normalize_entity(word: Column) -> Column:
    return F.trim(F.lower(word))


def strip_blanks(word: Column) -> Column:
    """White space taken off both ends, line ends included."""
    return F.regexp_replace(word, r"(?U)^\s+|\s+$", "")


def expand_to_words(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """(start, end) widened while the neighbours are letters or digits."""
    before = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), r"[\p{L}\p{N}]*$", 0))
    after = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^[\p{L}\p{N}]*", 0))
    return start - before, end + after


def clean_entity(word: Column, text: Column, start: Column, end: Column) -> Column:
    """struct(word, start, end): widened to words, blanks, leading articles and trailing punctuation gone."""
    wide_start, wide_end = expand_to_words(text, start, end)
    whole = F.substring(text, wide_start + 1, wide_end - wide_start)
    wider = (F.length(whole) > F.length(strip_blanks(word))) & (strip_blanks(whole) != "")
    w = F.when(wider, whole).otherwise(word)
    s, e = F.when(wider, wide_start).otherwise(start), F.when(wider, wide_end).otherwise(end)
    bare = strip_blanks(w)
    led = F.length(F.regexp_extract(w, r"(?U)^\s*", 0))
    s = F.when(bare != w, s + led).otherwise(s)
    e = F.when(bare != w, s + F.length(bare)).otherwise(e)
    lead = F.length(F.regexp_extract(bare, "(?iuU)^(?:" + "|".join(L.ENTITY_PREFIXES) + ")+", 0))
    rest = F.substring(bare, lead + 1, F.length(bare))
    final = F.regexp_replace(rest, r"[.,;:!?)]+$", "")
    return F.struct(final.alias("word"), (s + lead).alias("start"), (e - (F.length(rest) - F.length(final))).alias("end"))


def phonetic_equal(a: Column, b: Column) -> Column:
    """Whether two words sound alike; words without letters sound like nothing."""
    return (cologne(a) != "") & (cologne(a) == cologne(b))


def cologne(word: Column) -> Column:
    """Cologne phonetic code; empty without letters. A code depends on a letter and its two neighbours alone."""
    letters = F.regexp_replace(F.translate(F.upper(word), "ÄÖÜ", "AOU"), "[^A-Z]", "")
    chars = F.filter(F.split(letters, ""), lambda c: c != "")

    def code(c: Column, i: Column, every: Column) -> Column:
        before = F.when(i > 0, F.get(every, i - 1)).otherwise("")
        after = F.coalesce(F.get(every, i + 1), F.lit(""))
        hard = F.when(i == 0, after.isin(*"AHKLOQRUX")).otherwise(after.isin(*"AHKOQUX") & ~before.isin("S", "Z"))
        return (
            F.when(c.isin(*"AEIJOUY"), "0")
            .when(c == "B", "1")
            .when(c == "P", F.when(after == "H", "3").otherwise("1"))
            .when(c.isin("D", "T"), F.when(after.isin("C", "S", "Z"), "8").otherwise("2"))
            .when(c.isin("F", "V", "W"), "3")
            .when(c.isin("G", "K", "Q"), "4")
            .when(c == "C", F.when(hard, "4").otherwise("8"))
            .when(c == "X", F.when(before.isin("C", "K", "Q"), "8").otherwise("48"))
            .when(c == "L", "5")
            .when(c.isin("M", "N"), "6")
            .when(c == "R", "7")
            .when(c.isin("S", "Z"), "8")
            .otherwise("")
        )

    digits = let(chars, lambda every: F.regexp_replace(F.array_join(F.transform(every, lambda c, i: code(c, i, every)), ""), r"(.)\1+", "$1"))
    return let(digits, lambda d: F.concat(F.substring(d, 1, 1), F.replace(F.substring(d, F.lit(2), F.length(d)), F.lit("0"), F.lit(""))))
