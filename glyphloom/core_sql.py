"""DuckDB SQL of the core queries that SQL can express over whole tables."""

_DELIM = r"[ \n\r\t!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~]"
_PUNCT = r"[!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~]"
_TRIM = r"regexp_replace(regexp_replace({}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
_ENC = "translate({}, 'áéíóúñüãõçâêôà', 'AEIOUNWBCDFGJL')"
_STRIP = "translate({}, 'áéíóúñüãõçâêôà', 'aeiounuaocaeoa')"


def _bounded(t: str, n: int = 64) -> str:
    """The bounded token, as in functions.chars.bounded_token."""
    kept = f"[string_split({t}, '')[i] FOR i IN range(1, length({t}) + 1) IF i <= {n} OR (i - {n}) % 2 = 0]"
    return f"CASE WHEN length({t}) > {n} THEN array_to_string(list_slice({kept}, ceil((length({t}) - {n}) / 2)::BIGINT + 1, 1000000000), '') ELSE {t} END"


_TOKENS = f"""
x AS (SELECT doc_id, lang, regexp_split_to_array(text, '{_DELIM}') AS cut FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, lang, len(cut) AS n, unnest(cut) AS raw, generate_subscripts(cut, 1) - 1 AS pos FROM x),
tokens AS (SELECT doc_id, lang, pos::INT AS pos, raw, {_bounded('raw')} AS token, pos = n - 1 AS pending FROM y WHERE NOT (pos = n - 1 AND raw = ''))
"""
_DICT = f"""
d0 AS (SELECT lang, lower(word) AS word, {_ENC.format('lower(word)')} AS word_enc, freq, entry_id FROM dictionary WHERE lang IS NOT NULL AND trim(word) <> ''),
dict AS (SELECT lang, word, word_enc, CASE WHEN coalesce(freq, 0) = 0 THEN 1 ELSE freq END AS freq FROM d0
         QUALIFY row_number() OVER (PARTITION BY lang, word_enc ORDER BY entry_id) = 1)
"""
_ERR = """
e0 AS (SELECT lang, lower(typo) AS typo, CASE WHEN source = 'user' THEN lower(correction) ELSE correction END AS correction, coalesce(source, 'static') AS source, learned_at
       FROM errors WHERE lang IS NOT NULL AND typo IS NOT NULL AND correction IS NOT NULL),
err AS (SELECT lang, typo, correction, source FROM e0 WHERE length(typo) <= 50 AND length(correction) <= 50 AND (source <> 'user' OR typo <> correction)
        QUALIFY row_number() OVER (PARTITION BY lang, typo ORDER BY source <> 'user', learned_at DESC NULLS LAST, correction, source) = 1)
"""
_TYPED = """
typed AS (SELECT DISTINCT coalesce(detected_language.code, 'en') AS lang, original AS word FROM token_result WHERE original IS NOT NULL)
"""
_EDGE = "regexp_extract({}, '(?s)^([-'']*)(.*?)([-'']*)$', {})"
_BASE = "CASE WHEN lang IS NOT NULL THEN CASE WHEN regexp_split_to_array(lang, '[-_]')[1] = '' THEN 'en' ELSE lower(regexp_split_to_array(lang, '[-_]')[1]) END END"
_STOPS = "st AS (SELECT DISTINCT lang, lower(word) AS word FROM stopwords WHERE lang IS NOT NULL AND word IS NOT NULL)"

_LANGS = ["en", "es", "pt"]
_EVIDENCE = f"""
{_DICT}, {_STOPS},
sw AS (SELECT {_ENC.format('word')} AS w, {', '.join(f"max(CASE WHEN lang = '{x}' THEN 30 ELSE 0 END)::BIGINT AS s_{x}" for x in _LANGS)} FROM st GROUP BY 1),
dw AS (SELECT word_enc AS w, {', '.join(f"max(CASE WHEN lang = '{x}' THEN 3 ELSE 0 END)::BIGINT AS d_{x}" for x in _LANGS)} FROM dict GROUP BY 1),
ev AS (SELECT coalesce(sw.w, dw.w) AS w,
              {', '.join(f"CASE WHEN sw.w IS NOT NULL THEN s_{x} * 30 // (s_en + s_es + s_pt) ELSE 0 END AS s_{x}" for x in _LANGS)},
              {', '.join(f"CASE WHEN sw.w IS NOT NULL THEN 0 ELSE d_{x} END AS d_{x}" for x in _LANGS)}
       FROM sw FULL JOIN dw ON sw.w = dw.w),
tk AS (SELECT doc_id, pos, pending, {', '.join(f"coalesce(s_{x}, 0) AS s_{x}, coalesce(d_{x}, 0) AS d_{x}" for x in _LANGS)}
       FROM tokens LEFT JOIN ev ON token <> '' AND {_ENC.format('lower(token)')} = ev.w),
"""


def _windows(rows: str) -> str:
    over = "OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    return f"""
w0 AS (SELECT doc_id, pos, count(*) {over} AS n, {', '.join(f"sum(s_{x} + d_{x}) {over} AS t_{x}, sum(s_{x}) {over} AS w_{x}" for x in _LANGS)} FROM {rows}),
w1 AS (SELECT doc_id, pos, n, {', '.join(f"CASE WHEN t_en + t_es + t_pt > 0 THEN t_{x} / (t_en + t_es + t_pt) ELSE 0 END AS p_{x}, w_{x} / (n * 30) AS c_{x}" for x in _LANGS)} FROM w0 WHERE n >= 5)
"""


_P6 = f"""
WITH e AS (SELECT error_id, lower({_TRIM.format('correction')}) AS k, learned_at FROM errors WHERE lang = 'en' AND correction IS NOT NULL),
     d AS (SELECT lower({_TRIM.format('word')}) AS k, added_at, deleted_at FROM dictionary WHERE lang = 'en' AND word IS NOT NULL),
     s AS (SELECT e.error_id, e.k, e.learned_at, count(d.k) AS n,
                  count(*) FILTER (d.added_at <= e.learned_at AND (d.deleted_at IS NULL OR d.deleted_at > e.learned_at)) AS live,
                  count(*) FILTER (d.added_at <= e.learned_at) AS come
           FROM e LEFT JOIN d ON e.k = d.k GROUP BY ALL),
     o AS (SELECT error_id, k, learned_at,
                  CASE WHEN n = 0 THEN 'missing' WHEN learned_at IS NULL OR live > 0 THEN NULL WHEN come > 0 THEN 'deleted' ELSE 'later' END AS status FROM s)
"""

_TYPED_TOKENS = f"""
WITH k AS (SELECT window_id, seq, kind, ch, regexp_replace(lower(key), '[^\\p{{L}}]', '', 'g') AS key FROM key_events WHERE window_id IS NOT NULL AND seq IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY window_id, seq ORDER BY event_id) = 1),
     m AS (SELECT window_id, seq, ch,
                  CASE WHEN kind = 'Char' AND ch IS NOT NULL THEN CASE WHEN regexp_full_match(ch, '{_DELIM}') THEN 'end' ELSE 'char' END
                       WHEN kind = 'Special' AND key IN ('enter', 'tab', 'escape') THEN 'key' WHEN kind = 'Special' AND key = 'backspace' THEN 'clear' END AS what FROM k),
     n AS (SELECT *, count(*) FILTER (what <> 'char') OVER (PARTITION BY window_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM m WHERE what IS NOT NULL),
     g AS (SELECT window_id, coalesce(string_agg(ch, '' ORDER BY seq) FILTER (what = 'char'), '') AS token, min(seq) AS first_order, max(seq) AS last_order,
                  CASE max(what) FILTER (what <> 'char') WHEN 'end' THEN max(ch) FILTER (what = 'end') ELSE ' ' END AS delimiter,
                  max(what) FILTER (what <> 'char') AS how FROM n GROUP BY window_id, t)
"""

SQL = {
    "token_explode": f"WITH {_TOKENS} SELECT doc_id, pos, token, pending FROM tokens",
    "token_class_counts": f"""SELECT lang, sum(length(regexp_replace(text, '[^ ]', '', 'g')))::BIGINT AS space, sum(length(regexp_replace(text, '[^\\n\\r]', '', 'g')))::BIGINT AS enter,
        sum(length(regexp_replace(text, '[^\\t]', '', 'g')))::BIGINT AS tab, sum(length(regexp_replace(text, '[^{_PUNCT[1:-1]}]', '', 'g')))::BIGINT AS punctuation
        FROM documents WHERE text IS NOT NULL GROUP BY lang""",
    "empty_token_rate": f"WITH {_TOKENS} SELECT doc_id, count(*) AS tokens, count(*) FILTER (token = '') AS empty_tokens FROM tokens GROUP BY doc_id",
    "paste_tokens": f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '{_DELIM}'), lambda s: s <> ''), chr(31)) AS tokens FROM documents WHERE text IS NOT NULL",
    "buffer_events": f"""WITH {_TOKENS}, b AS (SELECT doc_id, pos, raw, pending, {_bounded('raw', 12)} AS held FROM tokens)
        SELECT doc_id, pos, 'BufferTruncated' AS event, held AS token, (length(raw) - length(held))::INT AS discarded FROM b WHERE length(raw) > 12
        UNION ALL SELECT doc_id, pos, CASE WHEN pending THEN 'BufferCleared' ELSE 'TokenExtracted' END, held, 0 FROM b""",
    "word_pieces": r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}\p{M}''-]+|[^\p{L}\p{N}\p{M}''-]+') AS ps FROM documents WHERE text IS NOT NULL),
        q AS (SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INT AS pos, unnest(ps) AS piece FROM p)
        SELECT doc_id, pos, piece, regexp_full_match(piece, '[\p{L}\p{N}\p{M}''-]+') AS is_word FROM q""",
    "delimiter_classify": f"""SELECT ch, count(*) AS events, CASE WHEN ch = ' ' THEN 'Space' WHEN ch IN (chr(10), chr(13)) THEN 'Enter' WHEN ch = chr(9) THEN 'Tab'
        WHEN regexp_full_match(ch, '{_PUNCT}') THEN 'Punctuation' END AS class, regexp_full_match(ch, '{_DELIM}') AS delimiter, regexp_full_match(ch, '{_PUNCT}') AS punctuation,
        regexp_full_match(ch, '[\\p{{L}}\\p{{N}}\\p{{M}}''-]') AS word_char FROM key_events WHERE ch IS NOT NULL GROUP BY ch""",
    "last_characters": "SELECT doc_id, right(text, 8) AS tail, length(text)::INT AS characters FROM documents",
    "accent_codec": f"""WITH w AS (SELECT DISTINCT lower(word) AS word FROM dictionary WHERE word IS NOT NULL)
        SELECT word, {_ENC.format('word')} AS encoded, translate({_ENC.format('word')}, 'AEIOUNWBCDFGJL', 'áéíóúñüãõçâêôà') AS decoded, {_STRIP.format('word')} AS stripped FROM w""",
    "case_restore": r"""WITH t AS (SELECT DISTINCT original, corrected FROM token_result WHERE original IS NOT NULL AND corrected IS NOT NULL)
        SELECT original, corrected, upper(left(corrected, 1)) || substr(corrected, 2) AS titled,
               CASE WHEN regexp_matches(original, '^\p{Lu}') THEN upper(left(corrected, 1)) || lower(substr(corrected, 2)) ELSE lower(corrected) END AS recased,
               regexp_full_match(original, '\p{Lu}+') AS all_upper FROM t""",
    "edge_trim": f"""WITH t AS (SELECT DISTINCT original AS o FROM token_result WHERE original IS NOT NULL)
        SELECT o AS original, {_EDGE.format('o', 1)} AS prefix, {_EDGE.format('o', 2)} AS core, {_EDGE.format('o', 3)} AS suffix FROM t""",
    "locale_resolve": f"""WITH t AS (SELECT lang, count(*) AS documents, {_BASE} AS base FROM documents GROUP BY lang)
        SELECT lang, documents, base,
               CASE WHEN length(lang) = 2 AND lang IN ('en', 'es', 'pt') THEN lang WHEN base IN ('en', 'es', 'pt') THEN base ELSE 'en' END AS code,
               CASE WHEN length(lang) = 2 AND lang IN ('en', 'es', 'pt') THEN 'UserPreference' WHEN base IN ('en', 'es', 'pt') THEN 'SystemLocale' ELSE 'DefaultFallback' END AS source FROM t""",
    "vocab_freq": f"WITH {_TOKENS} SELECT lang, lower(token) AS word, {_ENC.format('lower(token)')} AS word_enc, count(*) AS freq FROM tokens WHERE lang IS NOT NULL AND token <> '' GROUP BY ALL",
    "dict_build": f"WITH {_DICT} SELECT * FROM dict",
    "dictionary_stats": f"WITH {_DICT} SELECT lang, count(*) AS words, (count(*) * 64 + sum(strlen(word)))::BIGINT AS bytes FROM dict GROUP BY lang",
    "top_stopwords": f"""WITH {_TOKENS}, v AS (SELECT lower(left(lang, 2)) AS lang, lower(token) AS word, count(*) AS freq FROM tokens WHERE lang IS NOT NULL AND token <> '' GROUP BY ALL)
        SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, {_ENC.format('word')})::INT AS rank FROM v QUALIFY rank <= 25""",
    "stopword_weights": f"WITH {_STOPS} SELECT word, 1.0::DOUBLE / count(*) AS weight FROM st GROUP BY word",
    "error_map": f"WITH {_ERR} SELECT * FROM err",
    "all_typos": f"WITH {_ERR} SELECT lang, typo, correction FROM err",
    "static_map": f"""WITH {_ERR}, {_DICT} SELECT lang, typo, correction, source FROM err e WHERE source = 'static'
        AND ({_STRIP.format('typo')} = {_STRIP.format('lower(correction)')} OR NOT EXISTS (SELECT 1 FROM dict d WHERE d.lang = e.lang AND d.word_enc = {_ENC.format('e.typo')}))""",
    "map_statistics": f"""WITH {_ERR}, p AS (SELECT lang, count(*) FILTER (source <> 'user') AS s, count(*) FILTER (source = 'user') AS user_errors FROM err GROUP BY lang)
        SELECT lang, (SELECT sum(s) FROM p)::BIGINT AS static_errors, user_errors FROM p""",
    "learned_map": """WITH l AS (SELECT lang, lower(typo) AS typo, lower(correction) AS correction, learned_at, correction IS NULL AS gone FROM errors WHERE source = 'user' AND typo IS NOT NULL),
        m AS (SELECT * FROM l WHERE gone OR (length(typo) <= 50 AND length(correction) <= 50 AND typo <> correction)
              QUALIFY row_number() OVER (PARTITION BY lang, typo ORDER BY learned_at DESC NULLS LAST, gone DESC, correction) = 1)
        SELECT lang, typo, correction, learned_at FROM m WHERE NOT gone""",
    "exact_lookup": f"WITH {_DICT}, {_TYPED} SELECT t.lang, t.word, d.freq FROM typed t LEFT JOIN dict d ON t.lang = d.lang AND {_ENC.format('t.word')} = d.word_enc",
    "oov_words": f"WITH {_DICT}, {_TYPED} SELECT DISTINCT lower(word) AS word FROM typed WHERE {_ENC.format('lower(word)')} NOT IN (SELECT word_enc FROM dict)",
    "valid_words": f"WITH {_DICT}, {_TYPED} SELECT DISTINCT lower(word) AS word FROM typed WHERE {_ENC.format('lower(word)')} IN (SELECT word_enc FROM dict)",
    "typo_lookup": f"WITH {_ERR}, {_TYPED} SELECT t.lang, t.word, e.correction, e.source AS error_source FROM typed t LEFT JOIN err e ON t.lang = e.lang AND lower(t.word) = e.typo",
    "known_typos": f"WITH {_ERR}, {_TYPED} SELECT t.lang, t.word FROM typed t JOIN err e ON t.lang = e.lang AND lower(t.word) = e.typo",
    "stopword_hits": f"""WITH {_TOKENS}, {_STOPS} SELECT doc_id, count(*) AS stopwords FROM tokens t JOIN st ON lower(left(t.lang, 2)) = st.lang AND lower(t.token) = st.word GROUP BY doc_id""",
    "static_corrections": f"""WITH {_ERR}, {_TYPED}, p AS (SELECT lang, word, {_EDGE.format('word', 1)} AS a, lower({_EDGE.format('word', 2)}) AS c, {_EDGE.format('word', 3)} AS z FROM typed)
        SELECT p.lang, p.word, a || e.correction || z AS corrected FROM p JOIN err e ON p.lang = e.lang AND p.c = e.typo
        WHERE length(p.word) >= 2 AND c <> '' AND {_STRIP.format('c')} <> {_STRIP.format('e.correction')}""",
    "rolling_window_words": f"""WITH {_TOKENS}, w AS (SELECT doc_id, pos, list(lower(token)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS words FROM tokens)
        SELECT doc_id, pos, array_to_string(words, chr(31)) AS words FROM w WHERE len(words) >= 5""",
    "language_priors": f"WITH {_STOPS} SELECT lang, 1.0::DOUBLE / count(*) OVER () AS prior FROM (SELECT DISTINCT lang FROM st)",
    "lang_scores": f"WITH {_TOKENS}, {_EVIDENCE} {_windows('tk')} SELECT doc_id, pos, {', '.join(f'round({k}_{x}, 6) AS {k}_{x}' for k in 'pc' for x in _LANGS)} FROM w1",
    "lang_switch_strong": f"""WITH {_TOKENS}, {_EVIDENCE} tn AS (SELECT * FROM tk WHERE NOT pending), {_windows('tn')},
        s AS (SELECT doc_id, pos, greatest(p_en, p_es, p_pt) AS confidence, CASE greatest(p_en, p_es, p_pt) WHEN p_en THEN 'en' WHEN p_es THEN 'es' ELSE 'pt' END AS language FROM w1),
        b AS (SELECT *, coalesce(lag(language) OVER (PARTITION BY doc_id ORDER BY pos), 'en') AS before FROM s WHERE confidence >= 0.87)
        SELECT doc_id, pos, language, round(confidence, 6) AS confidence FROM b WHERE language <> before""",
    "typed_tokens": _TYPED_TOKENS + f"SELECT window_id, {_bounded('token')} AS token, first_order, last_order, delimiter, how = 'end' AS applied FROM g WHERE how IN ('end', 'key')",
    "stream_tokens": _TYPED_TOKENS + f"SELECT window_id, {_bounded('token')} AS token, last_order, delimiter, how = 'end' AS applied FROM g WHERE how IN ('end', 'key')",
    "focus_sessions": """WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END AS moved FROM events
            WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, user_id, (sum(moved) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM c""",
    "p6_found": _P6 + "SELECT error_id, status FROM o WHERE status IS NOT NULL",
    "p6_counts": _P6
    + """SELECT 'errors' AS table_name, strftime(learned_at, '%Y-%m') AS month, status, count(*) AS "references", count(DISTINCT k) AS keys
         FROM o WHERE status IS NOT NULL GROUP BY ALL""",
    "p6_missing_keys": _P6 + "SELECT DISTINCT k AS key FROM e WHERE k NOT IN (SELECT k FROM d)",
}
