"""Pattern finders: texts to entities with fixed scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions import checks
from umbra.functions import lexicons as L
from umbra.functions.text import let
from umbra.operators.spans import as_entities, entity, find_all, greedy_dedup, no_entities, no_spans, split_spans

# ---- Fixed values: patterns. (?U) makes \b, \w, \d and \s Unicode, (?d) leaves \n as the only line end. ----
_UP, _LOW = "A-ZÄÖÜ", "a-zäöüß"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
FILE_NUMBER = rf"(?U)\b(?:GZ|Zl\.?|AZ)\s+[{_UP}][{_UP}a-zäöü0-9.\-/]+(?:\d{{2,4}})"
SVNR = r"(?U)\b\d{4}\s?\d{6}\b"
IBAN = r"(?U)\b[A-Z]{2}\d{2}\s?(?:\d{4}\s?){3,7}\d{1,4}\b"
BIRTH_DATE = r"(?U)\b(?:0?[1-9]|[12]\d|3[01])[.\-/](?:0?[1-9]|1[0-2])[.\-/](?:19|20)\d{2}\b"
MONTHS = "Januar|Februar|März|Maerz|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
LONG_DATE = rf"(?U)\b(?:0?[1-9]|[12]\d|3[01])\.\s(?:{MONTHS})\s(?:19|20)\d{{2}}\b"
PLATE = rf"(?U)\b(?:{'|'.join(L.PLATE_CODES)})\s?[-]?\s?\d{{1,6}}\s?[A-Z]{{1,3}}\b"
PHONE = (
    r"(?U)(?:(?:\+43|0043)\s?[-./]?\s?(?:\(?\d{1,4}\)?\s?[-./]?\s?)?\d{3,4}\s?[-./]?\s?\d{2,6}"
    r"|0(?:650|660|664|67[06]|68[018]|699)\s?[-./]?\s?\d{3,4}\s?[-./]?\s?\d{2,6}"
    r"|0[1-9]\d{0,3}\s?[-./]?\s?\d{3,8})"
)
TAX_NUMBER = r"(?U)\b\d{2,3}[-/]\d{3,4}[-/]\d{4}\b"
_NAME = rf"[{_UP}][{_LOW}]+(?:\s+[{_UP}][{_LOW}]+)?"
TITLED = rf"(?U)(\b(?:Herrn?|Frau)\.?\s+(?:(?:Dr|Prof|Mag|Ing|Dipl|DI|DDr)\.?\s+)*)({_NAME})"
LABELED = rf"(?U)(\b(?:Protokollführer|Schriftführer|Verfasser|Autor|Erstellt von|Bearbeiter|Verantwortlich|Kontakt)(?:in)?:\s*)({_NAME})"
PASSPORT_CONTEXT, PASSPORT = r"(?iuU)(?:Reisepass|Pass-?Nr\.?|Passnummer|passport)\s*:?\s*", r"[A-Z]\d{7}"
ID_CARD_CONTEXT, ID_CARD = r"(?iuU)(?:Personalausweis|Ausweis-?Nr\.?|Ausweisnummer|ID-?Nr\.?)\s*:?\s*", "[A-Z0-9]{8,10}"
_STREETS = "stra(?:ß|ss)e gasse weg allee platz ring kai zeile promenade damm steig stiege gürtel ufer brücke markt hof".split()
_HOUSE = r"\s+\d{1,4}[a-z]?(?:\s?/\s?\d{1,4})*"
STREET_IN_WORD = rf"(?U)\b[{_UP}][{_LOW}]*(?:{'|'.join(_STREETS)}){_HOUSE}"
STREET_AS_WORD = rf"(?U)\b(?:[{_UP}][{_LOW}]+(?:-[{_UP}{_LOW}]+)*[\s-]){{1,3}}(?:{'|'.join(s[0].upper() + s[1:] for s in _STREETS)}){_HOUSE}"
TOWN = rf"(?Umd)((?:^|[,\n]\s*))(\d{{4}}\s+[{_UP}][{_LOW}]+(?:\s+(?:am|an|im|bei|ob|unter|in)\s+[{_LOW}]+(?:\s+[{_UP}][{_LOW}]+)?)?)"
_GROUP_2 = "$1\ufdd0$2\ufdd1"


def emails(text: Column) -> Column:
    return as_entities(find_all(text, EMAIL, guard=text.contains("@")), "EMAIL", 0.99)


def file_numbers(text: Column) -> Column:
    return as_entities(find_all(text, FILE_NUMBER), "AKTENZAHL", 0.99)


def svnrs(text: Column) -> Column:
    return as_entities(F.filter(find_all(text, SVNR), lambda s: checks.svnr_ok(s["word"])), "SVN", 0.95)


def ibans(text: Column) -> Column:
    return as_entities(F.filter(find_all(text, IBAN), lambda s: checks.iban_ok(s["word"])), "IBAN", 0.99)


def birth_dates(text: Column) -> Column:
    return as_entities(find_all(text, BIRTH_DATE), "GEBURTSDATUM", 0.95)


def long_dates(text: Column) -> Column:
    return as_entities(find_all(text, LONG_DATE), "GEBURTSDATUM", 0.9)


def addresses(text: Column) -> Column:
    """Streets with house numbers, joined with a town at most five characters on; other towns by themselves."""
    as_word = find_all(text, STREET_AS_WORD)
    streets = let(find_all(text, STREET_IN_WORD), lambda in_word: F.concat(in_word, F.filter(as_word, lambda b: ~F.exists(in_word, lambda a: a["start"] == b["start"]))))

    def street(x: Column) -> Column:
        s, t = x["s"], x["t"]
        alone = t.isNull()
        end = F.when(alone, s["end"]).otherwise(t["end"])
        word = F.when(alone, s["word"]).otherwise(F.substring(text, s["start"] + 1, end - s["start"]))
        return entity(word, "ADRESSE", F.when(alone, 0.9).otherwise(0.95), s["start"], end, "regex")

    def with_towns(towns: Column) -> Column:
        first = lambda s: F.get(F.filter(towns, lambda t: (t["start"] - s["end"]).between(0, 5)), F.lit(0))
        joined = F.transform(streets, lambda s: F.struct(s.alias("s"), first(s).alias("t")))
        free = lambda joined, t: ~F.exists(joined, lambda x: F.coalesce(x["t"]["start"] == t["start"], F.lit(False)))
        return let(joined, lambda j: F.concat(F.transform(j, street), as_entities(F.filter(towns, lambda t: free(j, t)), "ADRESSE", 0.85)))

    return F.when(text.rlike("[0-9]"), let(find_all(text, TOWN, _GROUP_2), with_towns)).otherwise(no_entities())


def titled_names(text: Column) -> Column:
    return as_entities(find_all(text, TITLED, _GROUP_2), "PER", 0.95, "regex_title")


def labeled_names(text: Column) -> Column:
    return as_entities(find_all(text, LABELED, _GROUP_2), "PER", 0.95, "regex_label")


def plates(text: Column) -> Column:
    return as_entities(find_all(text, PLATE), "KFZ", 0.95)


def phones(text: Column) -> Column:
    return as_entities(F.filter(find_all(text, PHONE), lambda s: checks.phone_ok(s["word"])), "TELEFON", 0.95)


def _after_context(text: Column, context: str, number: str, group: str) -> Column:
    """Numbers right behind a context match. Contexts are matched first and by themselves, so what they consume can't be undone."""
    marked = F.regexp_replace(text, context, "$0\ufdd2")
    found = F.regexp_replace(marked, rf"(?U)\ufdd2({number})\b", "\ufdd0$1\ufdd1")
    parts = F.split(F.translate(found, "\ufdd2", ""), "[\ufdd0\ufdd1]", -1)
    return as_entities(F.when(text.rlike(context), split_spans(parts)).otherwise(no_spans()), group, 0.85)


def passports(text: Column) -> Column:
    return _after_context(text, PASSPORT_CONTEXT, PASSPORT, "REISEPASS")


def id_cards(text: Column) -> Column:
    return _after_context(text, ID_CARD_CONTEXT, ID_CARD, "PERSONALAUSWEIS")


def tax_numbers(text: Column) -> Column:
    return as_entities(find_all(text, TAX_NUMBER), "STEUERNUMMER", 0.9)


#: In order of priority.
FINDERS = {
    "emails": emails,
    "file_numbers": file_numbers,
    "svnrs": svnrs,
    "ibans": ibans,
    "birth_dates": birth_dates,
    "long_dates": long_dates,
    "addresses": addresses,
    "titled_names": titled_names,
    "labeled_names": labeled_names,
    "plates": plates,
    "phones": phones,
    "passports": passports,
    "id_cards": id_cards,
    "tax_numbers": tax_numbers,
}


def find_entities(text: Column) -> Column:
    """All finders' entities; where they overlap the earlier finder's stays."""
    return greedy_dedup(F.concat(*(find(text) for find in FINDERS.values())))
