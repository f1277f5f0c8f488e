"""Fixed values of the detectors: word lists, label maps, code tables.

Everything here is data that results depend on; there is no logic.
"""

from __future__ import annotations

# ---- Fixed values ----------------------------------------------------------

#: First and last names, matched in any case.
FIRST_NAMES = (
    "Karl", "Johann", "Franz", "Josef", "Michael", "Thomas", "Stefan", "Christian", "Markus", "Andreas", "Martin", "Peter", "Wolfgang", "Robert",
    "Christoph", "Gerhard", "Manfred", "Friedrich", "Hans", "Werner", "Klaus", "Alexander", "Daniel", "David", "Lukas", "Maximilian", "Tobias",
    "Jakob", "Leon", "Elias", "Florian", "Sebastian", "Matthias", "Patrick", "Philipp", "Simon", "Raphael", "Felix", "Niklas", "Paul", "Jonas",
    "Moritz", "Benjamin", "Leo", "Fabian", "Dominik", "Marcel", "Julian", "Samuel", "Herbert", "Rudolf", "Walter", "Gottfried", "Helmut", "Ernst",
    "Kurt", "Leopold", "Maria", "Anna", "Johanna", "Elisabeth", "Barbara", "Brigitte", "Helga", "Christine", "Gertrude", "Erika", "Ingrid",
    "Gabriele", "Ursula", "Monika", "Renate", "Sonja", "Andrea", "Sabine", "Karin", "Daniela", "Martina", "Sandra", "Katrin", "Melanie", "Julia",
    "Lisa", "Sarah", "Laura", "Lena", "Hannah", "Emma", "Sophie", "Marie", "Lea", "Emilia", "Mia", "Lina", "Nina", "Theresa", "Magdalena", "Nora",
    "Valentina", "Elena", "Katharina", "Eva", "Susanne", "Silvia", "Petra", "Heidi", "Angela", "Claudia", "Ulrike", "Irene", "Beate", "Waltraud",
    "Margarete", "Hildegard", "Hermine", "Franziska",
)

LAST_NAMES = (
    "Gruber", "Huber", "Bauer", "Wagner", "Müller", "Pichler", "Steiner", "Moser", "Mayer", "Hofer", "Leitner", "Berger", "Fuchs", "Eder", "Fischer",
    "Schmidt", "Weber", "Winkler", "Schwarz", "Maier", "Reiter", "Schuster", "Lang", "Baumgartner", "Wolf", "Haas", "Brunner", "Lehner", "Stadler",
    "Egger", "Auer", "Strasser", "Koller", "Ebner", "Aigner", "Schneider", "Wimmer", "Binder", "Lackner", "Hauser", "Graf", "Fellner", "Lindner",
    "Riedl", "Zimmermann", "Schwaiger", "Köck", "Koch", "Prinz", "Seidl", "Schachner", "Payer", "Pöll", "Zauner", "Jäger", "Bachler", "Bichler",
    "Neumann", "Meier", "Meyer", "Heinzl", "Kern", "Puchner", "Weiß", "Pachler", "Klammer", "Raab", "Pfeifer", "Resch", "Ortner", "Mitterer",
    "Zehetner", "Reisinger", "Kogler", "Schreiner", "Weissenbacher", "Langer", "Zechmeister", "Holzer", "Buchner", "Rieder", "Gartner", "Höfer",
    "Kraus", "Herzog", "Unger", "Neuhold", "Wastl", "Schober", "Gasser", "Pucher", "Grill", "Hofbauer", "Rauch", "Aumayr",
)

#: Words that are never personal data. Blanks are taken out of a word before it is looked up.
BLACKLIST = (
    "protokoll", "workshop", "meeting", "termin", "termine", "projektleiter", "projektleiterin", "leiter", "leiterin", "abteilung", "it-abteilung",
    "it", "hr", "pr", "e-mail", "email", "mail", "tel", "telefon", "telefonnummer", "januar", "februar", "märz", "april", "mai", "juni", "juli",
    "august", "september", "oktober", "november", "dezember", "jan", "feb", "mär", "apr", "jun", "jul", "aug", "sep", "okt", "nov", "dez", "montag",
    "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag", "uhr", "zeit", "datum", "tag", "woche", "monat", "jahr", "teilnehmer",
    "teilnehmerin", "kunde", "kundin", "kunden", "kontakt", "erreichbar", "büro", "office", "zentrale", "seine", "ihre", "der", "die", "das", "von",
    "vom", "unter", "herr", "herrn", "frau", "dr", "dr.", "mag", "mag.", "prof", "prof.", "ing", "ing.", "dipl", "dipl.", "dkfm", "dkfm.",
    "teambesprechung", "besprechung", "sitzung", "konferenz", "protokollführer", "protokollführerin", "schriftführer", "kontaktdaten",
    "ansprechpartner", "ansprechpartnerin", "weiters", "außerdem", "zusätzlich", "ferner", "protokollderteambesprechung", "seinekontaktdaten",
    "ihrekontaktdaten", "meinekontaktdaten", "unserekontaktdaten", "kollege", "kollegen", "kollegin", "kolleginnen", "mitarbeiter", "mitarbeiterin",
    "mitarbeiterinnen", "mein", "meine", "meiner", "meinem", "meinen", "dein", "deine", "deiner", "deinem", "deinen", "sein", "seiner", "seinem",
    "seinen", "ihr", "ihrer", "ihrem", "ihren", "einkaufen", "arbeiten", "arbeitet", "gehen", "kommen", "machen", "kaufen", "verkaufen", "sprechen",
    "sagen", "fragen", "seine e-mail", "seine e - mail", "seine email", "seine mail", "seinee-mail", "seineemail", "ihre e-mail", "ihre email",
    "ihreemail", "meine e-mail", "meine email", "meineemail", "e - mail", "nächster", "nächste", "nächstes", "letzter", "letzte", "letztes", "te",
    "er", "en", "el", "ho", "an", "in", "um", "zu", "bescheid", "beschwerde", "stellungnahme", "verfahren", "antrag", "bundesministerium",
    "ministerium", "republik", "österreich", "landesregierung", "bezirkshauptmannschaft", "magistrat",
)

#: Statute abbreviations, matched exactly.
LEGAL_CODES = (
    "B-VG", "BVG", "EMRK", "StGG", "EU-GRC", "AVG", "VStG", "VwGVG", "VwGG", "VfGG", "DSG", "DSGVO", "IFG", "AuskunftspflichtG", "ABGB", "EheG",
    "KSchG", "MRG", "WEG", "WGG", "StGB", "StPO", "JGG", "FinStrG", "SMG", "ASVG", "GSVG", "BSVG", "APG", "AlVG", "KBGG", "ArbVG", "AngG", "ArbZG",
    "UrlG", "MSchG", "VKG", "KJBG", "BEinstG", "UGB", "GewO", "EStG", "UStG", "KStG", "BAO", "BWG", "WAG", "VersVG", "AuslBG", "AsylG", "FPG", "NAG",
    "BFA-VG", "BFA-G", "KFG", "StVO", "FSG", "EisenbahnG", "LuftfahrtG", "ArzneimittelG", "MedProdG", "GuKG", "KAKuG", "SchOG", "SchUG", "UG", "PHG",
    "AWG", "WRG", "ForstG", "NaturschutzG",
)

#: Authorities, matched in any case.
AUTHORITIES = (
    "Bundeskanzleramt", "Bundesministerium für Inneres", "Bundesministerium für Finanzen", "Bundesministerium für Justiz",
    "Bundesministerium für Landesverteidigung", "Bundesministerium für Arbeit und Wirtschaft",
    "Bundesministerium für Bildung, Wissenschaft und Forschung", "Bundesministerium für Soziales, Gesundheit, Pflege und Konsumentenschutz",
    "Bundesministerium für Kunst, Kultur, öffentlichen Dienst und Sport", "Bundesministerium für europäische und internationale Angelegenheiten",
    "Bundesministerium für Klimaschutz, Umwelt, Energie, Mobilität, Innovation und Technologie",
    "Bundesministerium für Land- und Forstwirtschaft, Regionen und Wasserwirtschaft", "BMI", "BMF", "BMJ", "BMLV", "BMAW", "BMBWF", "BMSGPK",
    "BMKÖS", "BMEIA", "BMK", "BMLUK", "BKA", "Verfassungsgerichtshof", "Verwaltungsgerichtshof", "Oberster Gerichtshof", "VfGH", "VwGH", "OGH",
    "Datenschutzbehörde", "Rechnungshof", "Volksanwaltschaft", "DSB", "RH", "Bundesverwaltungsgericht", "Bundesfinanzgericht", "BVwG", "BFG",
    "Bundespolizei", "Bundesamt für Fremdenwesen und Asyl", "Bundesamt für Verfassungsschutz und Terrorismusbekämpfung", "BFA", "BVT", "DSN",
    "Statistik Austria", "Arbeitsmarktservice", "AMS", "Österreichische Gesundheitskasse", "ÖGK", "Sozialversicherungsanstalt der Selbständigen",
    "SVS", "Pensionsversicherungsanstalt", "PVA", "Allgemeine Unfallversicherungsanstalt", "AUVA", "Arbeiterkammer", "AK",
    "Wirtschaftskammer Österreich", "Wirtschaftskammer", "WKO", "WKÖ", "Österreichischer Gewerkschaftsbund", "ÖGB", "Landwirtschaftskammer", "LKÖ",
    "Landesregierung", "Bezirkshauptmannschaft", "Magistrat", "Gemeindeamt", "Finanzamt Österreich", "Zollamt Österreich",
)

AUTHORITY_STUBS = ("magistrat ", "bezirkshauptmannschaft ", "landesregierung ", "gemeindeamt ", "finanzamt ")
WHITELISTABLE = ("ORG", "ORG_DETECTED", "LOC")

RELIGION_TERMS = (
    "römisch-katholisch", "roemisch-katholisch", "römisch katholisch", "roemisch katholisch", "rk", "altkatholisch", "evangelisch",
    "evangelisch a.b.", "evangelisch h.b.", "evangelisch ab", "evangelisch hb", "evangelisch-lutherisch", "evangelisch-reformiert",
    "evangelisch-methodistisch", "orthodox", "griechisch-orthodox", "russisch-orthodox", "serbisch-orthodox", "rumänisch-orthodox",
    "syrisch-orthodox", "koptisch-orthodox", "armenisch-apostolisch", "muslimisch", "moslem", "islamisch", "alevitisch", "schiitisch", "sunnitisch",
    "jüdisch", "juedisch", "israelitisch", "buddhistisch", "hinduistisch", "jehovas zeugen", "zeugen jehovas", "neuapostolisch", "mormonisch",
    "bahai", "bahá'í", "sikhistisch", "ohne bekenntnis", "konfessionslos", "konfessionsfrei", "atheistisch", "agnostisch", "freikirchlich",
)

POLITICAL_TERMS = (
    "övp", "oevp", "spö", "spoe", "fpö", "fpoe", "neos", "die grünen", "die gruenen", "grüne", "gruene", "kpö", "kpoe", "bier", "mfg",
    "team kärnten", "team kaernten", "övp-mitglied", "spö-mitglied", "fpö-mitglied", "neos-mitglied", "grüne-mitglied", "kpö-mitglied", "övp-wähler",
    "spö-wähler", "fpö-wähler", "neos-wähler", "övp-funktionär", "spö-funktionär", "fpö-funktionär", "parteimitglied", "parteizugehörigkeit",
)

UNION_TERMS = (
    "ögb", "oegb", "gpa", "gpa-djp", "vida", "göd", "goed", "younion", "younion _ die daseinsgewerkschaft", "gbh", "pro-ge", "proge",
    "gewerkschaft bau-holz", "gewerkschaft öffentlicher dienst", "ögb-mitglied", "gewerkschaftsmitglied", "betriebsrat", "personalvertretung",
)

ART9_TERMS = {"RELIGION": RELIGION_TERMS, "POLITICAL": POLITICAL_TERMS, "UNION": UNION_TERMS}

NORMAL_CONTEXT_WORDS = (
    "uns", "mir", "dir", "ihm", "ihr", "ihnen", "euch", "hause", "haus", "arbeit", "küche", "büro", "office", "abteilung", "team", "gruppe",
    "projekt", "stadt", "land", "ort", "gegend", "region", "schule", "universität", "uni", "hochschule", "anfang", "ende", "mitte", "zeit", "montag",
    "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag", "heute", "morgen", "gestern",
)

TITLES = (
    "dr", "dr.in", "drin", "mag", "mag.a", "maga", "prof", "prof.in", "profin", "di", "dipl", "ing", "dipl.-ing", "dipling", "phd", "mba", "msc",
    "bsc", "ba", "ma", "mas", "herr", "frau", "fr", "hr", "sir", "lord", "lady", "baron", "baronin", "graf", "graefin", "gräfin", "fuerst",
    "fuerstin", "fürst", "fürstin", "edler", "edle", "ritter", "pater", "sen", "jr",
)

ORG_TOKENS = (
    "gmbh", "ag", "kg", "og", "ohg", "eu", "kgaa", "gen", "verein", "ev", "eg", "ltd", "inc", "corp", "co", "llc", "plc", "sa", "sarl", "firma",
    "gesellschaft", "unternehmen", "konzern", "gruppe", "group", "company", "&", "und", "and",
)

ARTICLES = (
    "der", "die", "das", "dem", "den", "des", "ein", "eine", "einer", "einen", "eines", "einem", "the", "a", "an",
)

#: Leading words that are no part of an entity.
ENTITY_PREFIXES = (
    "der ", "die ", "das ", "dem ", "den ", "von ", "vom ", "unter ", "ist ", "sind ", "war ", "waren ", "wird ", "werden ", "hat ", "haben ",
    "hatte ", "hatten ", "und ", "oder ", "aber ", "auch ", "herrn ", "frau ", "herr ", "kollegen ", "kollegin ", "kollege ", "ehemaligen ",
    "ehemaliger ", "ehemalige ", "unseren ", "unsere ", "unser ", "unserem ",
)

#: Codes of number plates.
PLATE_CODES = (
    "W", "S", "K", "B", "T", "V", "NÖ", "OÖ", "ST", "AM", "BA", "BL", "BN", "BR", "BZ", "DL", "EF", "EU", "FB", "FE", "FF", "FR", "GD", "GF", "GM",
    "GR", "GS", "GU", "HA", "HB", "HE", "HF", "HO", "IL", "IM", "JE", "JO", "JU", "KB", "KF", "KG", "KI", "KL", "KO", "KR", "KS", "LA", "LB", "LE",
    "LF", "LI", "LL", "LN", "LZ", "MA", "MD", "ME", "MI", "MK", "MT", "MU", "MZ", "NA", "NK", "ND", "OW", "OP", "PE", "PL", "PT", "RA", "RE", "RI",
    "RO", "SB", "SD", "SE", "SL", "SO", "SP", "SR", "SV", "SW", "SZ", "TA", "TU", "UU", "VB", "VI", "VK", "VL", "VO", "WB", "WE", "WK", "WL", "WN",
    "WT", "WU", "WY", "ZE", "ZT", "ZW",
)

#: Placeholder label of a group; other groups keep their name.
PLACEHOLDER_LABELS = {
    "PER": "PERSON",
    "ORG": "ORGANISATION",
    "ORG_DETECTED": "ORGANISATION",
    "LOC": "ORT",
    "EMAIL": "EMAIL",
    "IBAN": "IBAN",
    "BIC": "BIC",
    "SVN": "SVNR",
    "STEUERNUMMER": "STEUERNUMMER",
    "UID": "UID",
    "FIRMENBUCH": "FIRMENBUCH",
    "GEBURTSDATUM": "GEBURTSDATUM",
    "AKTENZAHL": "AKTENZAHL",
    "REISEPASS": "REISEPASS",
    "PERSONALAUSWEIS": "PERSONALAUSWEIS",
    "KFZ": "KFZ",
    "TELEFON": "TELEFON",
    "ADRESSE": "ADRESSE",
    "QUASI_ID": "QUASI_ID",
    "DATE": "DATUM",
    "PHONE": "TELEFON",
    "HEALTH_DIAGNOSIS": "GESUNDHEIT",
    "HEALTH_MEDICATION": "GESUNDHEIT",
    "RELIGION": "RELIGION",
    "ETHNICITY": "HERKUNFT",
    "POLITICAL": "POLITIK",
    "UNION": "GEWERKSCHAFT",
    "SEXUAL_ORIENTATION": "SEXUELLE_ORIENTIERUNG",
    "BIOMETRIC": "BIOMETRIE",
    "FUEHRERSCHEIN": "FUEHRERSCHEIN",
    "ZMR": "ZMR",
    "GERICHTSAKTENZAHL": "AKTENZAHL",
}

#: Special categories of personal data.
ART9_GROUPS = (
    "HEALTH_DIAGNOSIS", "HEALTH_MEDICATION", "RELIGION", "ETHNICITY", "POLITICAL", "UNION", "SEXUAL_ORIENTATION", "BIOMETRIC",
)

#: Labels of the zero-shot detector; others are upper-cased.
ZERO_SHOT_LABELS = {
    "person name": "PER",
    "email address": "EMAIL",
    "phone number": "TELEFON",
    "physical address": "ADRESSE",
    "date of birth": "GEBURTSDATUM",
    "organization": "ORG",
    "company name": "ORG",
    "social security number": "SVN",
    "bank account number": "IBAN",
    "license plate number": "KFZ",
}

#: Labels of the named-entity detectors; others stay.
NER_LABELS = {
    "B-PER": "PER",
    "I-PER": "PER",
    "B-ORG": "ORG",
    "I-ORG": "ORG",
    "B-LOC": "LOC",
    "I-LOC": "LOC",
    "B-MISC": "MISC",
    "I-MISC": "MISC",
    "USERNAME": "EMAIL",
}
NER_ORG_LABELS = ("ORG", "LOC", "PER")

#: Invisible and directional characters, dropped.
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u00ad\u2060\u2061\u2062\u2063\u2064\ufeff\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"

#: Look-alikes and the Latin letters they stand for.
HOMOGLYPHS = "\u0430\u0441\u0435\u043e\u0440\u0445\u0443\u0456\u0458\u0455\u0410\u0412\u0421\u0415\u041d\u041a\u041c\u041e\u0420\u0422\u0425\u0406\u0408\u0405\u03bf\u039f\u0585"
HOMOGLYPHS_AS = "aceopxyijsABCEHKMOPTXIJSoOo"
#: Digits and signs read as letters in names.
LEET, LEET_AS = "013457@$", "oleastas"

#: Characters of wrong encodings, what they stand for, those dropped, and the one that becomes three dots.
MISENCODED = "\u2030\u0160\u00f7\u00b8\u00b3\u0192\ufb02\ufb01\u00d0\u2044\u00b4\u0060\u2014\u2013\u201c\u201d\u2018\u2019\u00a0"
MISENCODED_AS = 'ääöüüäßßÄÜ\'\'--""\'\' '
MISENCODED_DROPPED = "\ufeff"
ELLIPSIS = "\u2026"
