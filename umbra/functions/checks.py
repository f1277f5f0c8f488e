"""Checksums and structure tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.functions import lexicons as L

# ---- Fixed values ----
#: Length and structure of the account part by country (n digits, a letters, c either), from the public registry.
IBAN_STRUCTURES = {
    "AD": "8n12c", "AE": "19n", "AL": "8n16c", "AT": "16n", "AZ": "4a20c", "BA": "16n", "BE": "12n", "BG": "4a6n8c", "BH": "4a14c", "BR": "23n1a1c",
    "CH": "5n12c", "CR": "18n", "CY": "8n16c", "CZ": "20n", "DE": "18n", "DK": "14n", "DO": "4c20n", "EE": "16n", "ES": "20n", "FI": "14n",
    "FO": "14n", "FR": "10n11c2n", "GB": "4a14n", "GE": "2a16n", "GI": "4a15c", "GL": "14n", "GR": "7n16c", "GT": "24c", "HR": "17n", "HU": "24n",
    "IE": "4a14n", "IL": "19n", "IS": "22n", "IT": "1a10n12c", "JO": "4a4n18c", "KW": "4a22c", "KZ": "3n13c", "LB": "4n20c", "LI": "5n12c", "LT": "16n",
    "LU": "3n13c", "LV": "4a13c", "MC": "10n11c2n", "MD": "20c", "ME": "18n", "MK": "3n10c2n", "MR": "23n", "MT": "4a5n18c", "MU": "4a19n3a", "NL": "4a10n",
    "NO": "11n", "PK": "4a16c", "PL": "24n", "PS": "4a21c", "PT": "21n", "QA": "4a21c", "RO": "4a16c", "RS": "18n", "SA": "2n18c", "SE": "20n",
    "SI": "15n", "SK": "20n", "SM": "1a10n12c", "TN": "20n", "TR": "6n16c", "UA": "6n19c", "VG": "4a16n", "XK": "16n",
}
#: ISO 3166 two-letter codes, plus Kosovo's user-assigned one.
COUNTRIES = "AD AE AF AG AI AL AM AO AQ AR AS AT AU AW AX AZ BA BB BD BE BF BG BH BI BJ BL BM BN BO BQ BR BS BT BV BW BY BZ CA CC CD CF CG CH CI CK CL CM CN CO CR CU CV CW CX CY CZ DE DJ DK DM DO DZ EC EE EG EH ER ES ET FI FJ FK FM FO FR GA GB GD GE GF GG GH GI GL GM GN GP GQ GR GS GT GU GW GY HK HM HN HR HT HU ID IE IL IM IN IO IQ IR IS IT JE JM JO JP KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MF MG MH MK ML MM MN MO MP MQ MR MS MT MU MV MW MX MY MZ NA NC NE NF NG NI NL NO NP NR NU NZ OM PA PE PF PG PH PK PL PM PN PR PS PT PW PY QA RE RO RS RU RW SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR SS ST SV SX SY SZ TC TD TF TG TH TJ TK TL TM TN TO TR TT TV TW TZ UA UG UM US UY UZ VA VC VE VG VI VN VU WF WS XK YE YT ZA ZM ZW".split()
#: ICD-10 letters whose range of main numbers is not 0 to 99; U has none.
ICD10_RANGES = {"C": (0, 97), "D": (0, 89), "E": (0, 90), "H": (0, 95), "K": (0, 93), "P": (0, 96), "T": (0, 98), "V": (1, 99), "Y": (0, 98)}
SVNR_WEIGHTS = (3, 7, 9, 0, 5, 8, 4, 2, 1, 6)


def _digits(text: Column, blank: str) -> Column:
    return F.regexp_replace(text, blank, "")


def _weighted(digits: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        if w:
            total = total + F.substring(digits, i + 1, 1).cast("int") * w
    return total


def _structure() -> str:
    kinds = {"n": "[0-9]", "a": "[A-Z]", "c": "[A-Z0-9]"}
    out = []
    for country, shape in IBAN_STRUCTURES.items():
        body, count = "", ""
        for ch in shape:
            if ch.isdigit():
                count += ch
            else:
                body, count = f"{body}{kinds[ch]}{{{count}}}", ""
        out.append(f"{country}[0-9]{{2}}{body}")
    return "^(?:" + "|".join(out) + ")$"


def iban_ok(text: Column) -> Column:
    """MOD-97 over the rearranged number and the country's structure; blanks, dashes and dots don't count."""
    bare = F.upper(_digits(text, r"(?U)[\s\-.]"))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))
    return F.when(bare.rlike(_structure()), rest == 1).otherwise(False)


def svnr_ok(text: Column) -> Column:
    """Austrian social-insurance number: ten digits, the first not 0, the fourth the weighted sum of the others mod 11."""
    bare = _digits(text, r"(?U)\s")
    return F.when(bare.rlike("^[1-9][0-9]{9}$"), _weighted(bare, SVNR_WEIGHTS) % 11 == F.substring(bare, 4, 1).cast("int")).otherwise(False)


def uid_ok(text: Column) -> Column:
    """Austrian VAT number: ATU (in any case) and eight digits, the last a check digit."""
    digits = F.regexp_replace(F.upper(_digits(text, r"(?U)[\s\-./]")), "^(?:AT)?U", "")
    total = F.lit(4)
    for i in range(7):
        d = F.substring(digits, i + 1, 1).cast("int") * (1 + i % 2)
        total = total + F.floor(d / 10) + d % 10
    return F.when(digits.rlike("^[0-9]{8}$"), (10 - total % 10) % 10 == F.substring(digits, 8, 1).cast("int")).otherwise(False)


def bic_ok(text: Column) -> Column:
    """Structure of a bank code and a known country in it."""
    bare = F.upper(_digits(text, r"(?U)[\s\-]"))
    return bare.rlike("^[A-Z]{6}[0-9A-Z]{2}(?:[0-9A-Z]{3})?$") & F.substring(bare, 5, 2).isin(COUNTRIES)


def icd10_ok(text: Column) -> Column:
    """Diagnosis code in its chapter's range; capitals only."""
    t = F.trim(text)
    main = F.substring(t, 2, 2).cast("int")
    inside = F.lit(True)
    for letter, (low, high) in ICD10_RANGES.items():
        inside = F.when(F.substring(t, 1, 1) == letter, main.between(low, high)).otherwise(inside)
    return F.when(t.rlike(r"^[A-TV-Z][0-9]{2}(?:\.[0-9]{1,2})?$"), inside).otherwise(False)


def phone_ok(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\D", "")) >= 7


def is_first_name(word: Column) -> Column:
    return F.trim(F.lower(word)).isin([n.lower() for n in L.FIRST_NAMES])


def is_last_name(word: Column) -> Column:
    return F.trim(F.lower(word)).isin([n.lower() for n in L.LAST_NAMES])


def is_blacklisted(word: Column) -> Column:
    """In the list without its blanks (entries with blanks can't be met), or shorter than three characters."""
    bare = F.replace(F.replace(F.lower(word), F.lit(" - "), F.lit("-")), F.lit(" "), F.lit(""))
    return bare.isin(list(L.BLACKLIST)) | (F.length(word) < 3)


def is_whitelisted(word: Column, group: Column) -> Column:
    """A statute or an authority, for organisations and places only."""
    w = F.regexp_replace(word, r"(?U)^\s+|\s+$", "")
    stub = F.lit(False)
    for s in L.AUTHORITY_STUBS:
        stub = stub | F.lower(w).startswith(s)
    return group.isin(list(L.WHITELISTABLE)) & (w.isin(list(L.LEGAL_CODES)) | F.lower(w).isin([a.lower() for a in L.AUTHORITIES]) | stub)


def is_legal_paragraph(text: Column) -> Column:
    """A citation of a paragraph or an article and nothing else."""
    pattern = r"(?iuUd)^(?:§+\s*\d+[a-z]?(?:\s*Abs\.?\s*\d+)?(?:\s*Z(?:iffer|iff\.?)?\s*\d+)?|Art(?:ikel|\.)\s*\d+[a-z]?(?:\s*Abs\.?\s*\d+)?)$"
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "").rlike(pattern)
