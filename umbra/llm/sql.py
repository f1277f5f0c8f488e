"""Oracle SQL (DuckDB) for the queries that SQL can express."""

#: CRC-32 by half bytes, the table of the reflected polynomial 0xEDB88320 for 0 to 15.
CRC_TABLE = [0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

_HEX = "'0123456789ABCDEF'"


def _half(crc: str, nibble: str) -> str:
    return f"xor({crc} >> 4, ({CRC_TABLE}::BIGINT[])[(xor({crc}, {nibble}) & 15) + 1])"


OP6 = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
b AS (SELECT doc_id, size, list_transform(h, lambda x: ((instr({_HEX}, x[1]) - 1) * 16 + instr({_HEX}, x[2]) - 1)::BIGINT) AS bytes FROM d),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, n: {_half(f"({_half('a', 'n')})", "(n >> 4)")}), 4294967295::BIGINT) AS text_crc32 FROM b),
p AS (SELECT *, (sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING))::BIGINT AS ran, (sum(size) OVER ())::BIGINT AS total FROM c),
s AS (SELECT *, least(7, ((2 * (ran - size) + size) * 8) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM s
"""

# Pages are joined to the URLs (host, path and query) that their canonical and refresh links name; components by recursion over distinct edges.
OP8 = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, regexp_replace(html, '(?is)<!--.*?(-->|$)|<script\b.*?(</script\b|$)|<style\b.*?(</style\b|$)|<textarea\b.*?(</textarea\b|$)|<noscript\b.*?(</noscript\b|$)|<template\b.*?(</template\b|$)', ' ', 'g') AS html,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS whole FROM cut),
link AS (
  SELECT host, path, whole, replace(trim(unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^<>]*\brel\s*=\s*["'']?canonical\b[^<>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^<>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^<>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)])), '&amp;', '&') AS link
  FROM part WHERE host <> ''),
target AS (
  SELECT host || whole AS u,
    CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(link, instr(link, '://') + 3) WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ''
    WHEN starts_with(link, '//') THEN substr(link, 3) WHEN starts_with(link, '/') THEN host || link WHEN starts_with(link, '?') THEN host || path || link
    ELSE host || CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || link END AS rest
  FROM link WHERE link <> '' AND NOT starts_with(link, '#')),
edge AS (
  SELECT u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS v
  FROM target WHERE regexp_extract(rest, '^([^/?#]*)', 1) <> ''),
both_ways AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge),
reach AS (SELECT u AS a, u AS b FROM both_ways UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u),
rules(verdict, of, under) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
node_rule AS (
  SELECT b AS k, arg_max(verdict, length(of || under)) AS says
  FROM (SELECT DISTINCT b, regexp_extract(b, '^([^/?]*)', 1) AS h, regexp_extract(b, '^[^/?]*([^?]*)', 1) AS p FROM reach) n
  JOIN rules ON (h = of OR ends_with(h, '.' || of)) AND starts_with(p, under) GROUP BY b),
hit AS (SELECT DISTINCT a AS k FROM reach JOIN node_rule ON b = k WHERE says = 'block'),
page_rule AS (
  SELECT page_id, arg_max(of || under, length(of || under)) AS rule, arg_max(verdict, length(of || under)) AS says
  FROM part JOIN rules ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, under) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.says, CASE WHEN h.k IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM part p LEFT JOIN page_rule r USING (page_id) LEFT JOIN hit h ON h.k = p.host || p.whole AND p.host <> ''
"""

_WORD = r"[^\x20\x09-\x0D]+"
OP9 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '{_WORD}') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM d),
win AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: {{'i': i, 'k': words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]}})) AS x FROM w),
tri AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.k) AS n FROM win),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS at FROM tri WHERE n > 1) GROUP BY doc_id),
line AS (
  SELECT doc_id, host, t, unnest(lines) AS l FROM w),
norm AS (
  SELECT doc_id, host, t, len(regexp_extract_all(l, '{_WORD}')) AS n, ('0x' || md5(l)[1:8])::BIGINT AS digest,
         trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS k
  FROM line),
often AS (SELECT host, k FROM norm GROUP BY host, k HAVING count(DISTINCT t) > 20),
told AS (
  SELECT doc_id, coalesce(sum(n) FILTER (o.k IS NOT NULL), 0)::BIGINT AS gone, coalesce(sum(digest) FILTER (o.k IS NULL), 0)::BIGINT AS digest
  FROM norm n LEFT JOIN often o USING (host, k) GROUP BY doc_id),
stat AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_line_words_removed, coalesce(digest, 0)::BIGINT AS lines_left_digest
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN told USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_line_words_removed <= n_words AND n_words - n_line_words_removed >= 50 AS kept,
       n_line_words_removed, n_words - n_line_words_removed AS n_words_left, lines_left_digest
FROM stat
"""
