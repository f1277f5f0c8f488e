"""Pattern recognizers: matches in any case, validated, scored by the words around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions import checks
from umbra.functions import lexicons as L
from umbra.operators.spans import entity, find_all, no_entities
from umbra.schema import ENTITIES
from umbra.settings import Settings

#: validate(word, has_context) -> whether the match counts
Validate = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Recognizer:
    """Patterns with base scores; a context word within ``window`` characters adds ``boost``."""

    group: str
    patterns: Sequence[tuple[str, float]]
    context: Sequence[str] = ()
    boost: float = 0.2
    window: int = 50
    validate: Validate | None = None

    def find(self, text: Column, strict_case: bool = False) -> Column:
        found = [self._find(text, pattern, score, strict_case) for pattern, score in self.patterns]
        return F.concat(*found) if len(found) > 1 else found[0]

    def _find(self, text: Column, pattern: str, score: float, strict_case: bool) -> Column:
        def hit(s: Column) -> Column:
            near = self._has_context(text, s)
            valid = self.validate(s["word"], near) if self.validate else F.lit(True)
            return F.struct(s.alias("s"), near.alias("near"), valid.alias("valid"))

        hits = F.filter(F.transform(find_all(text, ("(?U)" if strict_case else "(?iuU)") + pattern), hit), lambda h: h["valid"])
        return F.transform(hits, lambda h: entity(h["s"]["word"], self.group, F.when(h["near"], min(1.0, score + self.boost)).otherwise(score), h["s"]["start"], h["s"]["end"], "presidio_compat"))

    def _has_context(self, text: Column, s: Column) -> Column:
        """A context word as a substring of the lower-cased surroundings, the match included."""
        if not self.context:
            return F.lit(False)
        start = F.greatest(s["start"] - self.window, F.lit(0))
        around = F.lower(F.substring(text, start + 1, s["end"] + self.window - start))
        found = F.lit(False)
        for word in self.context:
            found = found | around.contains(word.lower())
        return found


class NameRecognizer:
    """Words that are first or last names, whatever their case, at a fixed score without context."""

    group = "PER"

    def find(self, text: Column, strict_case: bool = False) -> Column:
        names = sorted({n.lower() for n in (*L.FIRST_NAMES, *L.LAST_NAMES)})
        if strict_case:
            pattern = r"(?U)\b[A-ZÄÖÜ][a-zäöüß]{2,}\b"
            hits = F.filter(find_all(text, pattern), lambda s: F.lower(s["word"]).isin(names))
        else:
            hits = find_all(text, rf"(?iuU)\b(?:{_by_head(names)})\b")
        return F.transform(hits, lambda s: entity(s["word"], "PER", 0.7, s["start"], s["end"], "presidio_compat"))


def _by_head(words: list[str]) -> str:
    """Alternation of words by their first two letters, so that most places in a text fail at once."""
    heads: dict[str, dict[str, list[str]]] = {}
    for w in words:
        heads.setdefault(w[0], {}).setdefault(w[1], []).append(w[2:])
    return "|".join(f"{a}(?:" + "|".join(f"{b}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for b, rest in tails.items()) + ")" for a, tails in heads.items())


class Art9Recognizer:
    """Terms of religion, politics and unions as whole words, blanks in them flexible.

    Each term is looked for by itself, since terms overlap; texts without any of them are told by one pattern.
    """

    group = "ART9"

    def find(self, text: Column, strict_case: bool = False) -> Column:
        case = "(?U)" if strict_case else "(?iuU)"
        quoted = {t: r"[\s\- ]+".join(rf"\Q{p}\E" for p in t.split()) for terms in L.ART9_TERMS.values() for t in terms}
        edge = r"[\wäöüÄÖÜß]"
        whole = lambda body: rf"{case}(?<!{edge})(?:{body})(?!{edge})"
        # In the row-wise pattern below edges are tested per term; here any term will do.
        guard = text.rlike(whole("|".join(sorted(quoted.values(), key=len, reverse=True))))
        terms = F.array(*(F.struct(F.lit(group).alias("group"), F.lit(whole(quoted[t])).alias("pattern")) for group, of in L.ART9_TERMS.items() for t in of))

        def one(t: Column) -> Column:
            return F.transform(find_all(text, t["pattern"], guard=F.lit(True)), lambda s: entity(s["word"], t["group"], 0.9, s["start"], s["end"], "presidio_compat"))

        hits = F.array_distinct(F.flatten(F.transform(terms, one)))
        return F.when(guard, hits).otherwise(no_entities())


def _checked(check: Callable[[Column], Column]) -> Validate:
    return lambda word, near: check(word)


def _in_context(word: Column, near: Column) -> Column:
    return near


# ---- Fixed values: patterns, base scores and context words. ----
SVNR = Recognizer("SVN", ((r"\b\d{4}\s\d{6}\b", 0.85), (r"\b\d{10}\b", 0.55)), ("svnr", "sozialversicherung", "versicherungsnummer", "sv-nr"), validate=_checked(checks.svnr_ok))
IBAN = Recognizer("IBAN", ((r"\bAT\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\b", 0.9),), ("iban", "konto", "bankverbindung", "kontonummer"), validate=_checked(checks.iban_ok))
PLATE = Recognizer("KFZ", ((rf"\b(?:{'|'.join(L.PLATE_CODES)})\s?[-]?\s?\d{{1,6}}\s?[A-Z]{{1,3}}\b", 0.85),), ("kennzeichen", "auto", "fahrzeug", "kfz", "wagen"))
COMPANY_NUMBER = Recognizer("FIRMENBUCH", ((r"\bFN\s?\d{1,6}\s?[a-z]\b", 0.9),), ("firmenbuch", "handelsregister", "firmenbuchnummer"))
PASSPORT = Recognizer("REISEPASS", ((r"\b[A-Z]\d{7}\b", 0.5),), ("reisepass", "passnummer", "passport", "pass-nr", "pass nr"))
FILE_NUMBER = Recognizer("AKTENZAHL", ((r"\b(?:GZ|Az|Zl)\.?\s?[A-Z]?[A-Z0-9]+(?:[-/.][A-Z0-9]+)*\b", 0.85),), ("geschäftszahl", "aktenzahl", "akt", "verfahrenszahl"))
NAME = NameRecognizer()
UID = Recognizer("UID", ((r"\bATU\s?\d{8}\b", 0.9),), ("uid", "umsatzsteuer-identifikationsnummer", "ust-id", "ust.-nr", "vat"), validate=_checked(checks.uid_ok))
BIC = Recognizer("BIC", ((r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 0.55),), ("bic", "swift", "bankleitzahl"), 0.35, validate=lambda w, near: (w == F.upper(w)) & checks.bic_ok(w))
ICD10 = Recognizer(
    "HEALTH_DIAGNOSIS",
    ((r"\b[A-TV-Z]\d{2}(?:\.\d{1,2})?\b", 0.55),),
    ("icd", "icd-10", "diagnose", "diagnosen", "befund", "anamnese", "arztbrief", "entlassungsbrief", "klassifikation", "krankheitsbild"),
    0.35,
    validate=lambda w, near: checks.icd10_ok(w) & near,
)
DRIVING_LICENCE = Recognizer("FUEHRERSCHEIN", ((r"\b\d{8}\b", 0.45),), ("führerschein", "fuehrerschein", "fs-nr", "fs nr", "lenkberechtigung", "driving licence", "driver licence"), 0.4, validate=_in_context)
RESIDENTS_NUMBER = Recognizer("ZMR", ((r"\b\d{3}\s?\d{3}\s?\d{3}\s?\d{3}\b", 0.55),), ("zmr", "zmr-zahl", "zmr-kennzahl", "melderegister", "zentrales melderegister", "meldezahl"), 0.35, validate=_in_context)
COURT_NUMBER = Recognizer("GERICHTSAKTENZAHL", ((r"\b\d{1,3}\s(?:Ob[SaA]?|Os|Nc|Ra|Bs|Bkd|Präs|AZ)\s\d{1,4}/\d{1,3}\b", 0.9),), ("gericht", "urteil", "beschluss", "ogh", "vwgh", "vfgh", "landesgericht"))
ART9 = Art9Recognizer()

#: In the order that decides ties.
RECOGNIZERS = (SVNR, IBAN, PLATE, COMPANY_NUMBER, PASSPORT, FILE_NUMBER, NAME, UID, BIC, ICD10, DRIVING_LICENCE, RESIDENTS_NUMBER, COURT_NUMBER, ART9)


def recognize(text: Column, settings: Settings | None = None, recognizers: Sequence | None = None) -> Column:
    """Entities of all recognizers at the threshold or above and not blacklisted. ``recognizers``: a set of one's own."""
    settings = settings or Settings()
    use = RECOGNIZERS if recognizers is None else recognizers
    if not use:
        return no_entities()
    found = F.concat(*(r.find(text, settings.strict_case) for r in use)).cast(ENTITIES)
    return F.filter(found, lambda e: (e["score"] >= settings.presidio_threshold) & ~checks.is_blacklisted(e["word"]))
