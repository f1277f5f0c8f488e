"""Entities from context: company names through a scorer, combinations of quasi-identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions import lexicons as L
from umbra.functions.text import let
from umbra.operators.spans import entity, find_all, greedy_dedup, no_entities, overlap
from umbra.schema import ENTITIES
from umbra.settings import Settings

# ---- Fixed values: signals that narrow down a person. ----
ROLES = (
    r"(?U)\b(?:der|die|dem|den|des)\s+(?:Beschwerdeführer(?:in)?|Antragsteller(?:in)?|Betroffene[rnm]?|Kläger(?:in)?|Beklagte[rnm]?|Berufungswerber(?:in)?"
    r"|Beschuldigte[rnm]?|Verdächtige[rnm]?|Zeugin|Zeuge[n]?|Geschädigte[rnm]?|Versicherte[rnm]?|Pensionist(?:in)?|Bedienstete[rnm]?|Beamt(?:e[rnm]?|in)"
    r"|Patientin|Patient(?:en)?|Mandantin|Mandant(?:en)?|Mieterin|Mieter[sn]?|Bewohner(?:in)?|Lehrerin|Lehrer[sn]?|Schüler(?:in)?)\b"
)
PROFESSIONS = (
    r"(?U)\b(?:als|ist|war|arbeitet(?:e)?\s+als|tätig\s+als)\s+(?:Ärzt(?:in|e)|Krankenschwester|Pfleger(?:in)?|Polizist(?:in)?|Soldat(?:in)?|Richter(?:in)?"
    r"|Staatsanwält(?:in|e)|Rechtsanwält(?:in|e)|Notar(?:in)?|Bäcker(?:in)?|Fleischer(?:in)?|Tischler(?:in)?|Elektriker(?:in)?|Landwirt(?:in)?|Gärtner(?:in)?"
    r"|Bauer|Bäuerin|Bürgermeister(?:in)?|Abgeordnete[rnm]?|Minister(?:in)?|Priester(?:in)?|Pfarrer(?:in)?|Rabbiner|Imam|Mufti|Lehrer(?:in)?|Professor(?:in)?"
    r"|Universitätsprofessor(?:in)?|Direktor(?:in)?|Geschäftsführer(?:in)?)\b"
)
RELATIONS = (
    r"(?U)\b(?:Sohn|Tochter|Bruder|Schwester|Vater|Mutter|Ehemann|Ehefrau|Ehegatt(?:e|in)|Lebensgefährt(?:e|in)|Partner(?:in)?|Cousin(?:e)?|Neffe|Nichte|Onkel"
    r"|Tante|Großvater|Großmutter|Enkel(?:in)?|Urenkel(?:in)?|Stief(?:sohn|tochter|vater|mutter))\s+(?:des|der|von)\s+[A-ZÄÖÜ]\w+\b"
)
AGES = r"(?U)\b(?:(?:geboren|geb\.?)\s+(?:im\s+(?:Jahr\s+)?)?\d{4}|\d{1,3}\s*[-–]?\s*[Jj]ähr(?:ig(?:e[rnms]?)?|ige[rnms]?)|[Jj]ahrgang\s+\d{4}|[Aa]lter\s+(?:von\s+)?\d{1,3})\b"
GENDERS = r"(?U)\b(?:die\s+(?:weibliche|männliche)|der\s+(?:männliche|weibliche)|(?:eine?\s+)?(?:Frau|Mann|Dame|Herr))\b"
SIGNALS = (("role", ROLES), ("profession", PROFESSIONS), ("relationship", RELATIONS), ("age", AGES), ("gender", GENDERS))

#: (what stands before the name, the name, what stands after, description). \w+ is the name but in the last.
_OF, _TO = r"(?:der\s+|dem\s+)?", r"(?:der\s+|dem\s+|von\s+)?"
_WORKS = r"\s+(?:arbeite|arbeitet|arbeiten|tätig|angestellt)"
COMPANY_CONTEXTS = (
    (rf"\bbei\s+uns\s+(?:in\s+)?{_OF}", r"\w+", "", 'nach "bei uns in"'),
    (rf"\barbeite[tn]?\s+(?:bei|für)\s+{_OF}", r"\w+", "", 'nach "arbeite bei"'),
    (rf"\bbei\s+{_OF}", r"\w+", r"\s+(?:arbeite|angestellt|beschäftigt)", 'vor "arbeite/angestellt"'),
    (rf"\bkunde[n]?\s+{_TO}", r"\w+", "", 'nach "Kunde"'),
    (rf"\bpartner\s+{_TO}", r"\w+", "", 'nach "Partner"'),
    (rf"\blieferant(?:en)?\s+{_TO}", r"\w+", "", 'nach "Lieferant"'),
    (r"\bfirma\s+", r"\w+", "", 'nach "Firma"'),
    (r"\bunternehmen\s+", r"\w+", "", 'nach "Unternehmen"'),
    (r"\b(?:der|die|das)\s+", r"\w+", r"\s+(?:AG|GmbH|SE|KG|OG|eG)\b", "vor AG/GmbH/etc"),
    (r"\bvon\s+(?:der\s+)?", r"\w+", r"\s+(?:bekommen|erhalten|gehört)", 'nach "von X bekommen"'),
    (r"\bzur\s+", r"\w+", r"\s+(?:gewechselt|gegangen|gekommen)", 'nach "zur X gewechselt"'),
    (r"\bbei\s+", r"\w+", r"\s+(?:angefangen|gestartet|begonnen)", 'nach "bei X angefangen"'),
    (r"\bbei\s+", r"\w+", r"\s+(?:einkaufen|eingekauft|shoppen|kaufen|gekauft)", 'nach "bei X einkaufen"'),
    (r"\bim\s+", r"\w+", r"\s+(?:einkaufen|eingekauft|shoppen|kaufen|gekauft)", 'nach "im X einkaufen"'),
    (r"\bzum\s+", r"\w+", r"\s+(?:gehen|gegangen|fahren|gefahren)", 'nach "zum X gehen"'),
    (r"\blieferung\s+(?:an|für|nach)\s+(?:die\s+|den\s+|das\s+)?", r"\w+", "", 'nach "Lieferung an X"'),
    (rf"\bbestellung\s+(?:von|bei|für)\s+{_OF}", r"\w+", "", 'nach "Bestellung von X"'),
    (r"\ban\s+", r"\w+", r"\s+(?:liefern|geliefert|senden|geschickt|soll)", 'nach "an X liefern"'),
    (r"\bbei\s+", r"\w+", rf"\s+als\s+\w+{_WORKS}", 'nach "bei X als [role]"'),
    (r"\bder\s+bei\s+", r"\w+", _WORKS, 'nach "der bei X arbeitet"'),
    (r"\bdie\s+bei\s+", r"\w+", _WORKS, 'nach "die bei X arbeitet"'),
    (r"\b(?:der|die|von\s+der)\s+", r"\w+\s+bank", r"\b", "X Bank"),
    (r"\b", r"\w+\s+bank", r"\b", "X Bank"),
    (r"\b", r"\w+\s+versicherung", r"\b", "X Versicherung"),
    (r"\b", r"\w+\s+sparkasse", r"\b", "X Sparkasse"),
    (r"\b", r"\w+\s+zentrale", r"\b", "X Zentrale"),
    (r"\b(?:der|die|bei\s+der|in\s+der)\s+", "Raiffeisen|Erste|BAWAG|Volksbank|Oberbank", r"\b", "Bankname"),
)

#: score(masked text, word) -> anomaly from 0 (expected) to 1, null for none: a plug-in around a fill-mask model.
Scorer = Callable[[Column, Column], Column]


def _described(spans: Column, description: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s.alias("s"), F.lit(description).alias("description")))


def company_candidates(text: Column, existing: Column) -> Column:
    """Spans that stand where company names do, with the masked surroundings a scorer needs."""
    found = []
    for before, name, after, description in COMPANY_CONTEXTS:
        marked = f"$1\ufdd0$2\ufdd1{'$3' if after else ''}"
        spans = find_all(text, f"(?iuU)({before})({name}){f'({after})' if after else ''}", marked)
        found.append(_described(spans, description))
    usual = list(L.NORMAL_CONTEXT_WORDS)

    def wanted(c: Column) -> Column:
        s = c["s"]
        head = F.regexp_extract(F.lower(s["word"]), r"(?U)^\S+", 0)
        known = F.exists(existing, lambda e: overlap(s, e) & (e["score"] >= 0.8))
        return ~head.isin(usual) & ~known & (F.length(s["word"]) >= 3)

    def masked(c: Column) -> Column:
        s = c["s"]
        left = F.greatest(s["start"] - 30, F.lit(0))
        around = F.concat(F.substring(text, left + 1, s["start"] - left), F.lit("[MASK]"), F.substring(text, s["end"] + 1, F.lit(30)))
        return F.struct(s.alias("s"), c["description"].alias("description"), around.alias("masked"), F.regexp_extract(F.lower(s["word"]), r"(?U)^\S+", 0).alias("head"))

    return F.transform(F.filter(F.concat(*found), wanted), masked)


def company_anomalies(text: Column, existing: Column, settings: Settings, scorer: Scorer | None) -> Column:
    """ORG_DETECTED for candidates that the scorer finds unexpected; none without a scorer."""
    if scorer is None:
        return no_entities()
    scored = F.transform(company_candidates(text, existing), lambda c: F.struct(c.alias("c"), scorer(c["masked"], c["head"]).alias("a")))
    odd = F.filter(scored, lambda x: (x["a"] > settings.perplexity_threshold) & F.substring(x["c"]["s"]["word"], 1, 1).rlike(r"\p{Lu}"))

    def hit(x: Column) -> Column:
        s = x["c"]["s"]
        return entity(s["word"], "ORG_DETECTED", F.least(F.lit(0.95), 0.6 + x["a"] * 0.35), s["start"], s["end"], "perplexity", x["c"]["description"], x["a"])

    return greedy_dedup(F.transform(odd, hit), existing)


def _signal(kind: Column, e: Column) -> Column:
    return F.struct(e["start"].alias("start"), e["end"].alias("end"), kind.alias("kind"), e["word"].alias("word"))


def _signals(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: _signal(F.lit(kind), s))


def quasi_identifiers(text: Column, existing: Column, settings: Settings) -> Column:
    """QUASI_ID entities for the free signals of the first window with two kinds and nobody named nearby."""
    window = settings.quasi_id_window
    found = [_signals(find_all(text, pattern), kind) for kind, pattern in SIGNALS]
    placed = F.filter(existing, lambda e: e["entity_group"].isin("LOC", "ADRESSE", "GEBURTSDATUM"))
    found.append(F.transform(placed, lambda e: _signal(F.when(e["entity_group"] == "GEBURTSDATUM", "age").otherwise("location"), e)))
    keyed = F.transform(F.concat(*found), lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s")))
    in_order = F.transform(F.array_sort(keyed), lambda x: x["s"])

    # A window holds the signals from its first on, by order, that start within reach of it.
    def window_of(s: Column, i: Column, every: Column) -> Column:
        within = F.filter(every, lambda o, j: (j >= i) & (o["start"] <= s["start"] + window))
        return F.struct(within.alias("signals"), F.array_sort(F.array_distinct(F.transform(within, lambda o: o["kind"]))).alias("kinds"), s["start"].alias("at"))

    def suspicious(w: Column) -> Column:
        named = F.exists(existing, lambda e: (e["entity_group"] == "PER") & (e["start"] >= w["at"] - 50) & (e["start"] <= w["at"] + window + 50))
        return (F.size(w["kinds"]) >= 2) & ~named

    windows = let(in_order, lambda every: F.transform(every, lambda s, i: window_of(s, i, every)))
    first = F.slice(F.filter(windows, suspicious), 1, 1)

    def report(w: Column) -> Column:
        k = F.greatest(F.lit(1), 6 - F.size(w["kinds"]))
        context = F.concat(F.lit("Quasi-Identifikator: "), F.array_join(w["kinds"], ", "), F.lit(" in Kombination (k~"), k.cast("string"), F.lit(")"))
        return greedy_dedup(F.transform(w["signals"], lambda s: entity(s["word"], "QUASI_ID", 0.7, s["start"], s["end"], "quasi_id", context)), existing)

    return F.flatten(F.transform(first, report)).cast(ENTITIES)
