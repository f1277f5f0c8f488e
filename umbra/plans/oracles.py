"""Oracle SQL (DuckDB) for the registered queries, written apart from the plans: windows where they fold, and rules by arithmetic."""

from __future__ import annotations

from umbra.functions import checks
from umbra.functions import lexicons as L
from umbra.plans.queries import NOW


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _pick(words, n: str) -> str:
    return f"({_list(words)})[(({n}) % {len(words)} + 1)::INTEGER]"


def _person(k: str) -> str:
    return f"{_pick(L.FIRST_NAMES, k)} || ' ' || {_pick(L.LAST_NAMES, f'{k} * 5 + 3')}"


_CORPUS = f"""
num AS (SELECT c_custkey AS k, (c_custkey * 13 % 899 + 100)::INTEGER AS s0,
  lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || lpad((c_custkey * 7 % 100)::VARCHAR, 2, '0') AS born FROM customer),
dig AS (SELECT *, (substr(born,1,1)::INT*5 + substr(born,2,1)::INT*8 + substr(born,3,1)::INT*4 + substr(born,4,1)::INT*2 + substr(born,5,1)::INT*1 + substr(born,6,1)::INT*6) AS b FROM num),
ser AS (SELECT *, CASE WHEN ((s0 // 100) * 3 + (s0 // 10 % 10) * 7 + (s0 % 10) * 9 + b) % 11 = 10 THEN s0 + 1 ELSE s0 END AS s FROM dig),
ib AS (SELECT *, 1200000000000000 + k * 7919 AS acc FROM ser),
val AS (SELECT k, {_person('k')} AS per, 'GZ BMI-' || (k % 30 + 1995) || '/' || lpad((k * 3 % 10000)::VARCHAR, 4, '0') AS gz, 'k' || k || '@example.at' AS mail,
  s::VARCHAR || (((s // 100) * 3 + (s // 10 % 10) * 7 + (s % 10) * 9 + b) % 11)::VARCHAR || ' ' || born AS svn,
  'AT' || lpad((98 - ((acc % 97) * 1000000 + 102900) % 97)::VARCHAR, 2, '0') || ' ' || substr(acc::VARCHAR,1,4) || ' ' || substr(acc::VARCHAR,5,4) || ' ' || substr(acc::VARCHAR,9,4) || ' ' || substr(acc::VARCHAR,13,4) AS iban,
  {_pick(('W', 'GU', 'LL', 'SB'), 'k')} || '-' || (k % 89999 + 10000) || 'A' AS kfz, (k % 28 + 1) || '.' || (k % 12 + 1) || '.' || (k % 60 + 1940) AS born FROM ib),
corpus AS (SELECT k AS doc_id, per, gz, mail, svn, iban, kfz, born, CASE k % 4
  WHEN 0 THEN 'Sehr geehrte Frau ' || per || ', Ihre Anfrage zu ' || gz || ' ist eingelangt. Kontakt: ' || mail || '.'
  WHEN 1 THEN 'Herr ' || per || ' gab die SVNR ' || svn || ' und den IBAN ' || iban || ' bekannt.'
  WHEN 2 THEN 'Das Fahrzeug ' || kfz || ' ist auf Frau ' || per || ' zugelassen, geboren am ' || born || '.'
  ELSE 'Bescheid vom ' || born || ': ' || gz || ', zugestellt an ' || mail || ' und Herrn ' || per || '.' END AS text FROM val)
"""


def _spans(source: str, pattern: str, keep: str = "true", group: str = "\\0", key: str = "doc_id", cols: str = "doc_id, start, \"end\", word") -> str:
    """Matches with offsets: marks around them, split at the marks, lengths added up."""
    a, z = "chr(57344)", "chr(57345)"
    # The mark's back-reference is the whole match, or one group with what stands before it kept.
    with_marks = f"{a} || '\\0' || {z}" if group == "\\0" else f"'\\1' || {a} || '\\2' || {z}"
    return f"""
cut AS (SELECT {key} AS doc_id, string_split_regex(regexp_replace(text, '{pattern}', {with_marks}, 'g'), '[' || {a} || {z} || ']') AS parts FROM {source}),
each AS (SELECT doc_id, parts, unnest(range(2, len(parts) + 1, 2)) AS i FROM cut),
span AS (SELECT doc_id, coalesce(list_sum(list_transform(parts[1:(i - 1)::INT], lambda x: length(x))), 0)::INTEGER AS start, parts[i::INT] AS word FROM each),
found AS (SELECT doc_id, start, (start + length(word))::INTEGER AS "end", word FROM span WHERE {keep})
SELECT {cols} FROM found"""


_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_PHONE = r"(?:\+43|0043)\s?[-./]?\s?(?:\(?\d{1,4}\)?\s?[-./]?\s?)?\d{3,4}\s?[-./]?\s?\d{2,6}|0(?:650|660|664|67[06]|68[018]|699)\s?[-./]?\s?\d{3,4}\s?[-./]?\s?\d{2,6}|0[1-9]\d{0,3}\s?[-./]?\s?\d{3,8}"


def _value_spans(column: str, turns: str) -> str:
    """Where a value stands in the corpus' text, found by its place alone."""
    return f"""WITH {_CORPUS} SELECT doc_id, (instr(text, {column}) - 1)::INTEGER AS start, (instr(text, {column}) - 1 + length({column}))::INTEGER AS "end", {column} AS word FROM corpus WHERE doc_id % 4 IN ({turns})"""


_ODD = ["‰", "÷", "—", "…", "“", " ", "​", "­", "‮", "а", "о", "С", "ο"]


def _noisy(expression: str) -> str:
    a, b = _pick(_ODD, "c_custkey"), _pick(_ODD, "c_custkey * 5")
    return f"""WITH n AS (SELECT c_custkey AS doc_id, 'Fr' || {a} || 'u  ' || chr(9) || ' ' || {_person('c_custkey')} || {b} || '-' || chr(10) || 'Ende  ' || {a} || ' Mü-  ' || chr(10) || 'ller' AS text FROM customer)
SELECT doc_id, {expression} AS text FROM n"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_VOWELS, _AFTER_C1, _AFTER_C = "AEIJOUY", "AHKLOQRUX", "AHKOQUX"
_COLOGNE = f"""
WITH w AS (
  SELECT c_custkey AS doc_id, {_pick(L.FIRST_NAMES, 'c_custkey')} AS word FROM customer UNION ALL SELECT c_custkey, {_pick(L.LAST_NAMES, 'c_custkey * 5 + 3')} FROM customer
  UNION ALL SELECT * FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM documents) WHERE word <> ''),
d AS (SELECT DISTINCT word, regexp_replace(translate(upper(replace(word, 'ß', 'ss')), 'ÄÖÜ', 'AOU'), '[^A-Z]', '', 'g') AS s FROM w),
c AS (SELECT word, s, unnest(range(1, length(s) + 1)) AS i FROM d),
n AS (SELECT word, i, substr(s, i, 1) AS c, CASE WHEN i > 1 THEN substr(s, i - 1, 1) ELSE '' END AS p, substr(s, i + 1, 1) AS x FROM c),
code AS (SELECT word, i, CASE
  WHEN instr('{_VOWELS}', c) > 0 THEN '0' WHEN c = 'B' THEN '1' WHEN c = 'P' THEN CASE WHEN x = 'H' THEN '3' ELSE '1' END
  WHEN c IN ('D', 'T') THEN CASE WHEN x IN ('C', 'S', 'Z') THEN '8' ELSE '2' END WHEN c IN ('F', 'V', 'W') THEN '3' WHEN c IN ('G', 'K', 'Q') THEN '4'
  WHEN c = 'C' AND i = 1 THEN CASE WHEN x <> '' AND instr('{_AFTER_C1}', x) > 0 THEN '4' ELSE '8' END
  WHEN c = 'C' THEN CASE WHEN p IN ('S', 'Z') THEN '8' WHEN x <> '' AND instr('{_AFTER_C}', x) > 0 THEN '4' ELSE '8' END
  WHEN c = 'X' THEN CASE WHEN p IN ('C', 'K', 'Q') THEN '8' ELSE '48' END WHEN c = 'L' THEN '5' WHEN c IN ('M', 'N') THEN '6' WHEN c = 'R' THEN '7'
  WHEN c IN ('S', 'Z') THEN '8' ELSE '' END AS code FROM n),
joined AS (SELECT word, string_agg(code, '' ORDER BY i) AS digits FROM code GROUP BY word),
single AS (SELECT word, digits, list_filter(range(1, length(digits) + 1), lambda i: i = 1 OR substr(digits, i, 1) <> substr(digits, i - 1, 1)) AS keep FROM joined),
short AS (SELECT word, list_transform(list_filter(keep, lambda i: i = 1 OR substr(digits, i, 1) <> '0'), lambda i: substr(digits, i, 1)) AS parts FROM single)
SELECT w.doc_id, w.word, coalesce(array_to_string(parts, ''), '') AS code FROM w LEFT JOIN short USING (word)
"""

_GROUPS = "['LOC', 'EMAIL', 'KFZ', 'PER']"
_SOURCES = "['regex', 'pii', 'presidio_compat']"
_WORDS = "['Wien', 'WIEN', 'wien ', 'Graz', 'Linz', 'graz-umgebung', 'Steyr']"
_LINES = f"""
l AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
sp AS (SELECT doc_id, ord, (p % 40)::INTEGER AS st, (p % 40 + 1 + s % 12)::INTEGER AS en, (p * 7 + ord) % 70 / 100.0::DOUBLE + 0.3::DOUBLE AS score,
  ({_GROUPS})[(p % 4 + 1)::INT] AS g, ({_SOURCES})[(s % 3 + 1)::INT] AS source, ({_WORDS})[((p * 3 + s) % 7 + 1)::INT] AS word FROM l)
"""
_ISLANDS = f"""{_LINES},
b AS (SELECT *, max(en) OVER (PARTITION BY doc_id ORDER BY st, st - en, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sp),
isl AS (SELECT *, (sum(CASE WHEN st < before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY st, st - en, ord ROWS UNBOUNDED PRECEDING))::INTEGER AS island FROM b)
"""
_NOISY_OR = f"""WITH {_ISLANDS},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY score DESC, st, st - en, ord) AS n FROM isl),
g AS (SELECT doc_id, island, min(st) AS start, max(en) AS "end", CASE WHEN count(*) = 1 THEN max(score) ELSE 1 - product(1 - score) END AS score, max(CASE WHEN n = 1 THEN g END) AS entity_group, count(DISTINCT source)::INTEGER AS n_sources FROM r GROUP BY 1, 2)
SELECT doc_id, start, "end", round(round(score, 12), 5) AS score, entity_group, n_sources, n_sources > 1 AS several FROM g"""

_LABELS = "CASE g WHEN 'LOC' THEN 'ORT' WHEN 'PER' THEN 'PERSON' ELSE g END"
_NUMBERED = f"""{_LINES},
k AS (SELECT *, {_LABELS} AS type, trim(word) AS w, lower(trim(word)) AS key FROM sp),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st, ord) AS nth FROM k WHERE score >= 0.5),
f AS (SELECT doc_id, type, key, min(nth) AS first_at FROM m GROUP BY ALL),
num AS (SELECT *, '[' || type || '_' || row_number() OVER (PARTITION BY doc_id, type ORDER BY first_at) || ']' AS placeholder FROM f)
"""

_JUDGED = f"""{_LINES},
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i FROM sp),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS j FROM o WHERE i % 3 <> 0),
truth AS (SELECT doc_id, j, st + j % 3 AS ts, en + j % 3 AS te, g AS tg FROM t),
pair AS (SELECT doc_id, i, j, source, g, greatest(0, least(en, te) - greatest(st, ts))::DOUBLE / (greatest(en, te) - least(st, ts)) AS iou FROM o JOIN truth USING (doc_id) WHERE g = tg),
fit AS (SELECT * FROM pair WHERE iou >= 0.5)
"""


def _greedy(of: str = "", partition: str = "doc_id") -> str:
    """Greedy matching by recursion over candidates in order, the used ends kept in lists."""
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY iou DESC, i, j) AS r FROM fit),
walk AS (
  SELECT {partition}, 1 AS r, [i] AS ps, [j] AS gs FROM ranked WHERE r = 1
  UNION ALL
  SELECT {', '.join('w.' + c.strip() for c in partition.split(','))}, w.r + 1, CASE WHEN list_contains(ps, i) OR list_contains(gs, j) THEN ps ELSE list_append(ps, i) END, CASE WHEN list_contains(ps, i) OR list_contains(gs, j) THEN gs ELSE list_append(gs, j) END
  FROM walk w JOIN ranked x ON {' AND '.join(f'w.{c.strip()} = x.{c.strip()}' for c in partition.split(','))} AND x.r = w.r + 1),
ended AS (SELECT {partition}, arg_max(ps, r) AS ps, arg_max(gs, r) AS gs FROM walk GROUP BY {partition})"""


_SCORE = """, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""
_BY_CATEGORY = f"""WITH RECURSIVE {_JUDGED}, {_greedy()},
c AS (
  SELECT g AS category, CASE WHEN list_contains(ps, i) THEN 1 ELSE 0 END AS tp, CASE WHEN list_contains(ps, i) THEN 0 ELSE 1 END AS fp, 0 AS fn FROM (SELECT o.*, coalesce(ps, []) AS ps FROM o LEFT JOIN ended USING (doc_id))
  UNION ALL SELECT tg, 0, 0, CASE WHEN list_contains(gs, j) THEN 0 ELSE 1 END FROM (SELECT truth.*, coalesce(gs, []) AS gs FROM truth LEFT JOIN ended USING (doc_id))),
s AS (SELECT category, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY category)
"""

_LOG = """log AS (SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS ts, user_id::VARCHAR AS document_id, event_id, value, upper(event_type) AS entity_group,
  CASE WHEN event_id % 11 = 0 THEN '[REDACTED]' ELSE 'Wert ' || event_id END AS entity_word FROM events),
aged AS (SELECT *, date_diff('microsecond', ts, TIMESTAMP '""" + NOW + """') / 86400e6 AS age FROM log)"""

_UID = """WITH v AS (SELECT c_custkey AS k, 'ATU' || lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') AS value FROM customer),
d AS (SELECT k, value, list_transform(range(1, 9), lambda i: substr(value, 3 + i, 1)::INTEGER) AS d FROM v),
s AS (SELECT *, d[1] + d[3] + d[5] + d[7] + list_sum(list_transform([d[2], d[4], d[6]], lambda x: (2 * x) // 10 + (2 * x) % 10)) + 4 AS t FROM d)
SELECT k, value, (10 - t % 10) % 10 = d[8] AS ok FROM s"""
_BICS = ("GIBAATWW", "RLNWATWWXXX", "MINISTERRAT", "BKAUATWW123", "ABCDZZ22", "DEUTDEFF5", "diagnose", "OBKLAT2L")
_ICD = f"""WITH v AS (SELECT c_custkey AS k, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabc', (c_custkey % 29 + 1)::INT, 1) AS c, (c_custkey * 31 % 100)::INT AS n, CASE WHEN c_custkey % 4 = 0 THEN '.' || (c_custkey % 7) ELSE '' END AS tail FROM customer),
r(c, lo, hi) AS (VALUES {', '.join(f"('{c}', {lo}, {hi})" for c, (lo, hi) in checks.ICD10_RANGES.items())})
SELECT k, v.c || lpad(n::VARCHAR, 2, '0') || tail AS value, v.c BETWEEN 'A' AND 'Z' AND v.c <> 'U' AND n BETWEEN coalesce(lo, 0) AND coalesce(hi, 99) AS ok FROM v LEFT JOIN r USING (c)"""
_WHITE = (*L.LEGAL_CODES[:20], *(a.upper() for a in L.AUTHORITIES[:30]), "Magistrat Wien", "Magistratisch", " BMI ", "avg", "Firma Huber")
_PARAGRAPHS = ("§ 12", "§12a Abs. 3", "§ 5 Abs. 2 Z 3", "Art. 5", "Artikel 7 abs 1", "§ x", "siehe § 3", "§§ 4 Ziffer 2", "Art 9")
_MARKS = ("[PERSON_1]", "[PRÜFEN:ORT_2]", "[GESCHWÄRZT:IBAN]", "[x]", "[AUSTRIAN VAT ID_1]", "[EMAIL]", "kein Zeichen")
_TITLES = ("Dr. ", "Frau Mag. ", "", "der ", "Herr DI ")


#: (number, group, valid value, wrong value, context, score without context or NULL, score with it), worked out by hand.
_VALUES = """(0, 'SVN', '1237 010180', '1234 151587', 'SVNR', 0.85, 1.0), (1, 'IBAN', 'AT61 1904 3002 3457 3201', 'AT00 0000 0000 0000 0000', 'Konto', 0.9, 1.0),
(2, 'KFZ', 'GU-1234A', 'QQ-1234A', 'Kennzeichen', 0.85, 1.0), (3, 'FIRMENBUCH', 'FN 12345a', 'FN 1234567a', 'Firmenbuch', 0.9, 1.0), (4, 'REISEPASS', 'P1234567', 'P123456', 'Reisepass', 0.5, 0.7),
(5, 'UID', 'ATU13585627', 'ATU12345678', 'UID', 0.9, 1.0), (6, 'BIC', 'GIBAATWWXXX', 'ZZZZZZ99', 'Bankleitzahl', 0.55, 0.9), (7, 'HEALTH_DIAGNOSIS', 'F32.1', 'U07.1', 'Diagnose', NULL, 0.9),
(8, 'FUEHRERSCHEIN', '12345678', '1234567', 'Führerschein', NULL, 0.85), (9, 'ZMR', '123 456 789 012', '123 456 789 01', 'Melderegister', NULL, 0.9), (10, 'GERICHTSAKTENZAHL', '3 Ob 12/24', '3 Xy 12/24', 'Urteil', 0.9, 1.0)"""
_CODES = _COLOGNE[_COLOGNE.index("d AS (") : _COLOGNE.index("SELECT w.doc_id")]
_MORE = {
    "long_date_spans": """WITH t AS (SELECT c_custkey AS doc_id, c_custkey % 33 AS d, ['Januar', 'Februar', 'März', 'Maerz', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember', NULL][(c_custkey % 14 + 1)::INT] AS m, c_custkey * 7 % 300 + 1850 AS y FROM customer)
SELECT doc_id, 15::INTEGER AS start, (15 + length(word))::INTEGER AS "end", word FROM (SELECT doc_id, d || '. ' || m || ' ' || y AS word FROM t WHERE d BETWEEN 1 AND 31 AND m IS NOT NULL AND y BETWEEN 1900 AND 2099)""",
    "labeled_name_spans": f"""WITH t AS (SELECT c_custkey AS doc_id, (['Verfasserin: ', 'Protokollführer:  ', 'Kontakt:', NULL, NULL, 'Erstellt von: '])[(c_custkey % 6 + 1)::INT] AS lead, {_person('c_custkey')} AS word FROM customer WHERE c_custkey % 5 <> 0)
SELECT doc_id, (7 + length(lead))::INTEGER AS start, (7 + length(lead) + length(word))::INTEGER AS "end", word FROM t WHERE lead IS NOT NULL""",
    "recognizer_values": f"""WITH v(i, g, valid, wrong, about, bare, near) AS (VALUES {_VALUES}),
t AS (SELECT c_custkey AS doc_id, v.*, CASE c_custkey % 3 WHEN 0 THEN length(about) + 2 WHEN 1 THEN 6 ELSE length(about) + 62 END AS pos, CASE c_custkey % 3 WHEN 0 THEN near ELSE bare END AS score FROM customer JOIN v ON c_custkey % 11 = i WHERE c_custkey % 7 <> 0)
SELECT doc_id, g AS entity_group, pos::INTEGER AS start, (pos + length(valid))::INTEGER AS "end", valid AS word, score::DOUBLE AS score FROM t WHERE score IS NOT NULL""",
    "model_detector_rules": """WITH t AS (SELECT c_custkey AS k, c_custkey % 10 / 10 AS s, 'Kunde' || c_custkey AS w, (18 + length(c_custkey::VARCHAR))::INTEGER AS z FROM customer)
SELECT k AS doc_id, chr(9601) || w AS word, 'PER' AS entity_group, s::DOUBLE AS score, 13::INTEGER AS start, z AS "end", 'pii' AS source FROM t WHERE s >= 0.7::DOUBLE
UNION ALL SELECT k, w, 'EMAIL', 0.9, 13, z, 'pii' FROM t
UNION ALL SELECT k, 'Wien', 'LOC', 1 - s, z + 11, z + 15, 'org' FROM t WHERE 1 - s >= 0.7::DOUBLE
UNION ALL SELECT k, w, 'PER', 0.5, 13, 20, 'gliner' FROM t
UNION ALL SELECT k, 'wohnt', 'HOBBY', s, 0, 0, 'gliner' FROM t WHERE s >= 0.4::DOUBLE""",
    "mask_rank_anomaly": "SELECT c_custkey AS doc_id, ([0.0, 0.25, 1.0, 0.75, 0.5])[(c_custkey % 5 + 1)::INT]::DOUBLE AS anomaly FROM customer",
    "names_by_sound": f"""WITH spelt AS (SELECT c_custkey AS doc_id, replace(replace(translate({_pick(L.LAST_NAMES, 'c_custkey')}, 'dbgckvwf', 'tpkkcfvv'), 'ai', 'ey'), 'l', 'll') AS word FROM customer),
names AS (SELECT DISTINCT unnest({_list([n.lower() for n in L.LAST_NAMES])}) AS name),
w AS (SELECT word FROM spelt UNION ALL SELECT name FROM names), {_CODES.rstrip()},
coded AS (SELECT word, array_to_string(parts, '') AS code FROM short)
SELECT s.doc_id, s.word, n.name FROM spelt s JOIN coded a ON a.word = s.word JOIN coded b ON b.code = a.code AND b.code <> '' JOIN names n ON n.name = b.word""",
}


def oracle_sql() -> dict[str, str]:
    changed = lambda col, at: f"CASE WHEN k % 3 = 0 THEN substr({col}, 1, {at}) || ((substr({col}, {at + 1}, 1)::INT + 1) % 10)::VARCHAR ELSE {col} END"
    expected = lambda per, gz, mail, svn, iban, kfz, born: f"""CASE doc_id % 4 WHEN 0 THEN 'Sehr geehrte Frau {per}, Ihre Anfrage zu {gz} ist eingelangt. Kontakt: {mail}.' WHEN 1 THEN 'Herr {per} gab die SVNR {svn} und den IBAN {iban} bekannt.'
  WHEN 2 THEN 'Das Fahrzeug {kfz} ist auf Frau {per} zugelassen, geboren am {born}.' ELSE 'Bescheid vom {born}: {gz}, zugestellt an {mail} und Herrn {per}.' END"""  # noqa: E731
    kinds = ("PERSON", "AKTENZAHL", "EMAIL", "SVNR", "IBAN", "KFZ", "GEBURTSDATUM")
    numbered = expected(*(f"[{k}_1]" for k in kinds))
    public = expected(*(f"[GESCHWÄRZT:{k}]" for k in kinds))
    moved = "translate(text, 'oleast', '013457')"
    return {
        "at_corpus": f"""WITH {_CORPUS},
a AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN [['PER', per], ['AKTENZAHL', gz], ['EMAIL', mail]] WHEN 1 THEN [['PER', per], ['SVN', svn], ['IBAN', iban]] WHEN 2 THEN [['KFZ', kfz], ['PER', per], ['GEBURTSDATUM', born]] ELSE [['GEBURTSDATUM', born], ['AKTENZAHL', gz], ['EMAIL', mail], ['PER', per]] END AS v FROM corpus)
SELECT doc_id, text, '[' || array_to_string(list_transform(v, lambda x: '{{"start":' || (instr(text, x[2]) - 1) || ',"end":' || (instr(text, x[2]) - 1 + length(x[2])) || ',"type":"' || x[1] || '"}}'), ',') || ']' AS entities FROM a""",
        "generated_samples": "SELECT unnest(['PER', 'AKTENZAHL', 'EMAIL', 'SVN', 'IBAN', 'KFZ', 'GEBURTSDATUM']) AS type, 0::BIGINT AS bad",
        "fix_encoding": _noisy(f"replace(replace(translate(text, {_q(L.MISENCODED)}, {_q(L.MISENCODED_AS)}), '{L.MISENCODED_DROPPED}', ''), '…', '...')"),
        "strip_invisible": _noisy(f"regexp_replace(text, '[{L.INVISIBLE}]', '', 'g')"),
        "homoglyphs": _noisy(f"translate(text, '{L.HOMOGLYPHS}', '{L.HOMOGLYPHS_AS}')"),
        "collapse_ws": _noisy(r"regexp_replace(text, '[ \t]+', ' ', 'g')"),
        "rejoin_hyphenation": _noisy(r"regexp_replace(text, '([\pL\pN_])-[ \t]*\n([\pL\pN_])', '\1\2', 'g')"),
        "leetspeak": f"WITH n AS (SELECT c_custkey AS doc_id, {_person('c_custkey')} AS text FROM customer), w AS (SELECT doc_id, split_part({moved}, ' ', 1) AS a, split_part({moved}, ' ', 2) AS b FROM n) SELECT doc_id, 'Frau ' || translate(a, '013457@$', 'oleastas') || ' ' || b || ', Nr. 10345' AS text FROM w",
        "cologne_phonetic": _COLOGNE,
        "email_spans": "WITH " + _spans("documents", _EMAIL),
        "phone_spans": "WITH " + _spans("documents", _PHONE, r"length(regexp_replace(word, '\D', '', 'g')) >= 7"),
        "svnr_spans": _value_spans("svn", "1"),
        "iban_spans": _value_spans("iban", "1"),
        "date_spans": _value_spans("born", "2, 3"),
        "plate_spans": _value_spans("kfz", "2"),
        "file_number_spans": _value_spans("gz", "0, 3"),
        "titled_name_spans": _value_spans("per", "0, 1, 2, 3"),
        "corpus_email_spans": _value_spans("mail", "0, 3"),
        "address_spans": f"""WITH t AS (SELECT c_custkey AS doc_id, {_pick(('Hauptgasse', 'Ringweg', 'Am Markt', 'Kaiplatz'), 'c_custkey')} || ' ' || (c_custkey % 90 + 1) AS street, (c_custkey * 3 % 4) AS g, (c_custkey % 9000 + 1000) || ' Wien' AS town FROM customer),
x AS (SELECT *, ([', ', ',   ', ' und dann, ', ',' || chr(10)])[(g + 1)::INT] AS gap FROM t), y AS (SELECT *, 'wohnt ' || street || gap || town || '. Zuvor, 8010 Graz' AS text FROM x),
z AS (SELECT doc_id, text, CASE WHEN g = 2 THEN street ELSE street || gap || town END AS word FROM y UNION ALL SELECT doc_id, text, town FROM y WHERE g = 2 UNION ALL SELECT doc_id, text, '8010 Graz' FROM y)
SELECT doc_id, CASE WHEN word = '8010 Graz' THEN length(text) - 9 ELSE instr(text, word) - 1 END::INTEGER AS start, CASE WHEN word = '8010 Graz' THEN length(text) ELSE instr(text, word) - 1 + length(word) END::INTEGER AS "end", word FROM z""",
        "tax_spans": r"""WITH src AS (SELECT c_custkey AS doc_id, 'St.-Nr. ' || (c_custkey % 90 + 10) || CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE '/' END || (c_custkey % 900 + 100) || '/' || (c_custkey % 9000 + 1000 - CASE WHEN c_custkey % 5 = 0 THEN 950 ELSE 0 END) || ' gilt' AS text FROM customer), """ + _spans("src", r"\b\d{2,3}[-/]\d{3,4}[-/]\d{4}\b"),
        "context_numbers": """WITH n AS (SELECT c_custkey AS doc_id, c_custkey % 5 AS m, 'P' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0') AS word FROM customer),
s AS (SELECT *, CASE m WHEN 0 THEN 15 WHEN 1 THEN 15 WHEN 3 THEN 19 END AS start FROM n WHERE m IN (0, 1, 3)) SELECT doc_id, start::INTEGER AS start, (start + 8)::INTEGER AS "end", word FROM s""",
        "regex_layer": """WITH t(template, g) AS (VALUES (0, 'PER'), (0, 'AKTENZAHL'), (0, 'EMAIL'), (1, 'PER'), (1, 'SVN'), (1, 'IBAN'), (2, 'KFZ'), (2, 'PER'), (2, 'GEBURTSDATUM'), (3, 'GEBURTSDATUM'), (3, 'AKTENZAHL'), (3, 'EMAIL'), (3, 'PER'))
SELECT c_custkey % 4 AS template, g AS entity_group, count(*) AS n FROM customer JOIN t ON template = c_custkey % 4 GROUP BY 1, 2""",
        "pipeline_accuracy": """WITH t(template, category) AS (VALUES (0, 'PER'), (0, 'AKTENZAHL'), (0, 'EMAIL'), (1, 'PER'), (1, 'SVN'), (1, 'IBAN'), (2, 'KFZ'), (2, 'PER'), (2, 'GEBURTSDATUM'), (3, 'GEBURTSDATUM'), (3, 'AKTENZAHL'), (3, 'EMAIL'), (3, 'PER'))
SELECT category, count(*) AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM customer JOIN t ON template = c_custkey % 4 GROUP BY 1""",
        "name_lexicon_hits": rf"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\pL\pN_]+')) AS name FROM documents)
SELECT name, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM w WHERE list_contains({_list([n.lower() for n in (*L.FIRST_NAMES, *L.LAST_NAMES)])}, name) GROUP BY name""",
        "art9_terms": f"""WITH t AS (SELECT c_custkey AS doc_id, {_pick([t for of in L.ART9_TERMS.values() for t in of], 'c_custkey')} AS term FROM customer) SELECT doc_id, (11 + length(term))::INTEGER AS "end", 11::INTEGER + CASE WHEN term IN ('die grünen', 'die gruenen') THEN 0 ELSE 0 END AS start FROM t""",
        "svnr_check": f"WITH {_CORPUS} SELECT k, {changed('svn', 10)} AS value, k % 3 <> 0 AS ok FROM val",
        "iban_check": f"WITH {_CORPUS} SELECT k, {changed('iban', 23)} AS value, k % 3 <> 0 AS ok FROM val",
        "uid_check": _UID,
        "bic_check": f"SELECT c_custkey AS k, {_pick(_BICS, 'c_custkey')} AS value, list_contains(['GIBAATWW', 'RLNWATWWXXX', 'MINISTERRAT', 'BKAUATWW123', 'OBKLAT2L', 'diagnose'], {_pick(_BICS, 'c_custkey')}) AS ok FROM customer",
        "icd10_check": _ICD,
        "blacklist_anti": rf"""WITH w AS (SELECT unnest(regexp_split_to_array(text, '[\s.,;:!?]+')) AS word FROM conversations UNION ALL SELECT {_pick(L.BLACKLIST, 'c_custkey')} FROM customer)
SELECT word, count(*) AS n FROM w WHERE length(word) >= 3 AND NOT list_contains({_list(L.BLACKLIST)}, replace(replace(lower(word), ' - ', '-'), ' ', '')) GROUP BY word""",
        "whitelist_filter": f"""WITH w AS (SELECT c_custkey AS k, {_pick(_WHITE, 'c_custkey')} AS word, (['ORG', 'LOC', 'PER', 'ORG_DETECTED'])[(c_custkey * 7 % 4 + 1)::INT] AS entity_group FROM customer)
SELECT * FROM w WHERE entity_group = 'PER' OR NOT (list_contains({_list(L.LEGAL_CODES)}, trim(word)) OR list_contains({_list([a.lower() for a in L.AUTHORITIES])}, lower(trim(word))) OR regexp_matches(lower(trim(word)), '^(magistrat|bezirkshauptmannschaft|landesregierung|gemeindeamt|finanzamt) '))""",
        "legal_paragraphs": f"SELECT c_custkey AS k, {_pick(_PARAGRAPHS, 'c_custkey')} AS value, NOT list_contains(['§ x', 'siehe § 3', 'Art 9'], {_pick(_PARAGRAPHS, 'c_custkey')}) AS ok FROM customer",
        "span_islands": f"WITH {_ISLANDS} SELECT doc_id, ord, island FROM isl",
        "noisy_or": _NOISY_OR,
        "noisy_or_flat": _NOISY_OR,
        "span_dedup": f"""WITH RECURSIVE {_LINES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM sp),
walk AS (SELECT doc_id, r, [struct_pack(s := st, e := en, c := score)] AS kept FROM o WHERE r = 1
  UNION ALL SELECT w.doc_id, w.r + 1, CASE WHEN len(list_filter(kept, lambda x: NOT (o.en <= x.s OR o.st >= x.e))) > 0 THEN kept ELSE list_append(kept, struct_pack(s := o.st, e := o.en, c := o.score)) END FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.r = w.r + 1),
last AS (SELECT doc_id, arg_max(kept, r) AS kept FROM walk GROUP BY doc_id), u AS (SELECT doc_id, unnest(kept) AS x FROM last) SELECT doc_id, x.s AS start, x.e AS "end", round(x.c, 6) AS score FROM u""",
        "overlap_semijoin": f"WITH {_LINES} SELECT a.doc_id, count(*) AS n FROM sp a WHERE EXISTS (SELECT 1 FROM sp b WHERE a.doc_id = b.doc_id AND a.ord <> b.ord AND a.st < b.en AND b.st < a.en AND b.score >= 0.8) GROUP BY 1",
        "containment": f"WITH {_LINES} SELECT a.doc_id, (count(b.ord))::INTEGER AS n FROM sp a LEFT JOIN sp b ON a.doc_id = b.doc_id AND a.ord <> b.ord AND b.st <= a.st AND a.en <= b.en GROUP BY 1",
        "canonical_keys": f"""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN lower({_person('c_custkey')}) ELSE lower({_pick(L.LAST_NAMES, 'c_custkey')}) END AS key FROM customer
WHERE NOT list_contains(['graf'], lower({_pick(L.LAST_NAMES, 'c_custkey')})) AND NOT list_contains(['graf'], lower({_pick(L.LAST_NAMES, 'c_custkey * 5 + 3')}))
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN lower({_pick(L.LAST_NAMES, 'c_custkey * 5 + 3')}) = 'graf' THEN lower({_pick(L.FIRST_NAMES, 'c_custkey')}) ELSE lower({_person('c_custkey')}) END ELSE lower({_pick(L.LAST_NAMES, 'c_custkey')}) END FROM customer
WHERE list_contains(['graf'], lower({_pick(L.LAST_NAMES, 'c_custkey')})) OR list_contains(['graf'], lower({_pick(L.LAST_NAMES, 'c_custkey * 5 + 3')}))""",
        "placeholder_numbering": f"WITH {_NUMBERED} SELECT doc_id, placeholder, count(*) AS n FROM m JOIN num USING (doc_id, type, key) GROUP BY 1, 2",
        "mapping_longest": f"WITH {_NUMBERED}, c AS (SELECT m.doc_id, placeholder, w, row_number() OVER (PARTITION BY m.doc_id, placeholder ORDER BY length(w) DESC, nth) AS n FROM m JOIN num USING (doc_id, type, key)) SELECT doc_id, placeholder, w AS original FROM c WHERE n = 1",
        "redaction_protocol": f"WITH {_LINES} SELECT doc_id, {_LABELS} AS category, count(*)::INTEGER AS count, round(min(score), 6) AS min_confidence, round(max(score), 6) AS max_confidence FROM sp WHERE score >= 0.5 GROUP BY 1, 2",
        "kapa_actions": f"WITH {_LINES} SELECT doc_id::VARCHAR AS document_id, CASE WHEN score < 0.85 THEN 'flagged_for_review' ELSE 'anonymized' END AS action, count(*) AS n FROM sp WHERE score >= 0.5 GROUP BY 1, 2",
        "context_snippets": "WITH src AS (SELECT * FROM documents), " + _spans("src", _EMAIL, cols="found.doc_id, found.start, '...' || substr(d.text, greatest(found.start - 30, 0) + 1, found.start - greatest(found.start - 30, 0)) || '[EMAIL_1]' || substr(d.text, found.\"end\" + 1, 30) || '...' AS snippet") + " JOIN documents d USING (doc_id)",
        "govgpt_text": f"WITH {_CORPUS} SELECT doc_id, {numbered} AS output, true AS passed FROM corpus",
        "ifg_text": f"WITH {_CORPUS} SELECT doc_id, {public} AS output, true AS passed FROM corpus",
        "kapa_text": f"WITH {_CORPUS} SELECT doc_id, {numbered} AS output, true AS passed FROM corpus",
        "reidentified": f"WITH {_CORPUS} SELECT doc_id, text FROM corpus",
        "redacted_emails": rf"SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}'))::INTEGER AS n, regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', chr(57344) || '[GESCHWÄRZT:EMAIL]' || chr(57345), 'g'), '([^ \n\t(])' || chr(57344), '\1 ', 'g'), chr(57345) || '([^ \n\t.,;:!?)' || chr(57344) || '])', ' \1', 'g').replace(chr(57344), '').replace(chr(57345), '') AS output FROM documents WHERE regexp_matches(text, '{_EMAIL}')",
        "quasi_id_windows": f"""WITH t AS (SELECT c_custkey AS doc_id, (c_custkey % 5 * 30)::INT AS pad, {_pick(('Sie ist Notarin hier.', 'Jahrgang 1980 laut Akt.', 'die Patientin kam.', 'Sohn des Bauern war da.', 'nichts weiter.'), 'c_custkey * 3')} AS tail FROM customer),
s AS (SELECT doc_id, 29 + 2 * pad AS pos, tail, CASE tail WHEN 'Sie ist Notarin hier.' THEN 'profession, role' WHEN 'Jahrgang 1980 laut Akt.' THEN 'age, role' WHEN 'Sohn des Bauern war da.' THEN 'relationship, role' END AS kinds FROM t WHERE 29 + 2 * pad <= 210),
h AS (SELECT *, CASE tail WHEN 'Sie ist Notarin hier.' THEN 4 ELSE 0 END AS off, CASE tail WHEN 'Sie ist Notarin hier.' THEN 'ist Notarin' WHEN 'Jahrgang 1980 laut Akt.' THEN 'Jahrgang 1980' ELSE 'Sohn des Bauern' END AS w FROM s WHERE kinds IS NOT NULL),
v AS (SELECT * FROM h WHERE pos + off <= 10 + 200)
SELECT doc_id, 10::INTEGER AS start, 20::INTEGER AS "end", 'die Zeugin' AS word, 'Quasi-Identifikator: ' || kinds || ' in Kombination (k~4)' AS context FROM v
UNION ALL SELECT doc_id, (pos + off)::INTEGER, (pos + off + length(w))::INTEGER, w, 'Quasi-Identifikator: ' || kinds || ' in Kombination (k~4)' FROM v""",
        "placeholder_format": f"SELECT c_custkey AS k, 5::INTEGER AS position, {_pick(_MARKS, 'c_custkey')} AS snippet FROM customer WHERE list_contains(['[x]', '[AUSTRIAN VAT ID_1]', '[EMAIL]'], {_pick(_MARKS, 'c_custkey')})",
        "name_pair_leaks": f"""WITH n AS (SELECT c_custkey AS k, {_person('c_custkey')} AS full_name, {_pick(L.LAST_NAMES, 'c_custkey')} AS last FROM customer)
SELECT k, 'leak' AS type, 6::INTEGER AS position, full_name AS snippet FROM n WHERE k % 2 = 0 UNION ALL SELECT k, 'warn', 6::INTEGER, last FROM n WHERE k % 2 = 1""",
        "prf_by_category": _BY_CATEGORY + f"SELECT category, tp, fp, fn{_SCORE} FROM s",
        "prf_overall_rollup": _BY_CATEGORY + f", a AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM s) SELECT tp, fp, fn{_SCORE} FROM a",
        "prf_by_layer": f"""WITH RECURSIVE {_JUDGED}, {_greedy(partition='doc_id, source')},
h AS (SELECT source, sum(len(ps)) AS tp FROM ended GROUP BY 1), p AS (SELECT source, count(*) AS n FROM sp GROUP BY 1),
s AS (SELECT p.source AS layer, coalesce(tp, 0)::BIGINT AS tp, (n - coalesce(tp, 0))::BIGINT AS fp, ((SELECT count(*) FROM truth) - coalesce(tp, 0))::BIGINT AS fn FROM p LEFT JOIN h USING (source)) SELECT layer, tp, fp, fn{_SCORE} FROM s""",
        "retention_sweep": f"WITH {_LOG} SELECT event_id, CASE WHEN age > 90 THEN '[REDACTED]' ELSE entity_word END AS entity_word, coalesce(age > 90 AND entity_word <> '[REDACTED]', false) AS changed FROM aged WHERE NOT coalesce(age > 110, false)",
        "retention_counts": f"WITH {_LOG} SELECT count(*) FILTER (age > 90 AND age <= 110 AND entity_word <> '[REDACTED]') AS redacted, count(*) FILTER (age > 110) AS deleted FROM aged",
        "forget_document": f"WITH {_LOG} SELECT document_id, count(*) AS n FROM log WHERE document_id NOT IN (SELECT document_id FROM log WHERE event_id % 100 = 3) GROUP BY 1",
        "audit_flagged": f"WITH {_LOG} SELECT entity_group, count(*) AS n FROM log WHERE value > 5 GROUP BY 1",
        "mapping_upsert": "WITH r AS (SELECT user_id AS doc_id, hour(ts)::INTEGER AS version, '[' || upper(event_type) || '_' || (event_id % 5) || ']' AS placeholder, event_id::VARCHAR AS original FROM events) SELECT doc_id, version, placeholder, original FROM r QUALIFY version = max(version) OVER (PARTITION BY doc_id)",
        "entity_metrics_histogram": f"WITH {_LINES} SELECT 'ifg' AS channel, g AS category, source AS layer, greatest(0.1, ceil(round(score, 9) * 10) / 10)::DOUBLE AS le, count(*) AS n FROM sp GROUP BY ALL",
    } | _MORE
