"""DuckDB SQL of correction, fuzzy search and detection with hysteresis.

The weighted distance is a recursive query over the rows of the distance table
(all pairs at once), detection jumps from one change of language to the next.
"""

from glyphloom.core_sql import _DELIM, _DICT, _EDGE, _ENC, _ERR, _EVIDENCE, _LANGS, _STRIP, _TOKENS, _TYPED, _bounded, _windows

# Neighbouring keys, as in functions.distance.
_KEYS = "qw we er rt ty yu ui io op as sd df fg gh hj jk kl zx xc cv vb bn nm qa ws ed rf tg yh uj ik ol az sx dc fv gb hn jm wa es rd tf yg uh ij ok pl sz dx fc gv hb jn km"


def _letters(w: str) -> str:
    return f"[substr({w}, k, 1) FOR k IN range(1, length({w}) + 1)]"


def letter_wise(fn: str, a: str, b: str) -> str:
    """DuckDB's distances count bytes: letters outside ASCII are numbered per pair before they are compared."""
    known = f"list_sort(list_distinct({_letters(f'({a} || {b})')}))"
    number = lambda w: f"array_to_string([chr(list_position({known}, c)::INT) FOR c IN {_letters(w)}], '')"
    return f"CASE WHEN strlen({a}) = length({a}) AND strlen({b}) = length({b}) THEN {fn}({a}, {b}) ELSE {fn}({number(a)}, {number(b)}) END"


def _plain(w: str) -> str:
    """Every letter outside ASCII as ``?``: distances of what is left are never larger, and cheap."""
    return f"regexp_replace({w}, '[^ -~]', '?', 'g')"


def _near(a: str, b: str, pa: str, pb: str) -> str:
    return f"CASE WHEN levenshtein({pa}, {pb}) <= 2 THEN {letter_wise('levenshtein', a, b)} <= 2 ELSE false END"


def _overlap(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    shared = f"coalesce(list_sum([least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, ''))) FOR c IN list_distinct({_letters(a)})]), 0)"
    return f"CASE WHEN {longest} = 0 THEN false WHEN {longest} <= 2 THEN {shared} > 0 ELSE 5 * {shared} >= 3 * {longest} END"


def weighted(pairs: str, out: str) -> str:
    """CTEs: ``out`` (a, b, w) with the keyboard-weighted distance, times ten, of the pairs (a, b) of ``pairs``."""
    last = "coalesce(nullif(list_position(list_reverse(la[1:i - 1]), lb[j]), 0), 0)"
    match = "coalesce(nullif(list_position(list_reverse(lb[1:j - 1]), la[i]), 0), 0)"
    near = "[" + ", ".join(f"'{k}'" for k in _KEYS.split()) + "]"
    cost = f"CASE WHEN la[i] = lb[j] THEN 0 WHEN list_contains({near}, la[i] || lb[j]) OR list_contains({near}, lb[j] || la[i]) THEN 5 ELSE 10 END"
    # letters since the other side's letter was last seen: the swap begins there
    swap = f"CASE WHEN {last} > 0 AND {match} > 0 THEN t[i - {last}][j - {match}] + ({last} + {match} - 1) * 10 ELSE 1000000 END"
    return f"""
{out}_t AS (SELECT a, b, {_letters('a')} AS la, {_letters('b')} AS lb, 1::BIGINT AS i, [[10 * j FOR j IN range(0, length(b) + 1)]] AS t FROM {pairs}
    UNION ALL
    SELECT a, b, la, lb, i + 1, list_append(t, list_prepend(10 * i, [least(10 * i + 10 * j, list_min([s[l] + 10 * (j - l) FOR l IN range(1, j + 1)])) FOR j IN range(1, len(lb) + 1)]))
    FROM (SELECT *, [least(t[i][j] + {cost}, t[i][j + 1] + 10, {swap}) FOR j IN range(1, len(lb) + 1)] AS s FROM {out}_t WHERE i <= len(la))),
{out} AS (SELECT a, b, t[len(la) + 1][len(lb) + 1] AS w FROM {out}_t WHERE i = len(la) + 1)"""


def similar(words: str, out: str, limit: int, k: int = 3) -> str:
    """CTEs: ``out`` (lang, word, rank, candidate, distance, frequency) for the distinct (lang, word) of ``words``."""
    return f"""
{out}_q AS (SELECT lang, word, {_ENC.format('word')} AS wq, {_plain(_ENC.format('word'))} AS plain FROM {words} WHERE lang IS NOT NULL AND word IS NOT NULL),
{out}_l AS (SELECT *, unnest(range(length(wq) - 2, length(wq) + 3)) AS m FROM {out}_q),
{out}_c AS (SELECT q.lang, q.word, d.word AS candidate, d.word_enc, d.freq FROM {out}_l q JOIN (SELECT *, length(word_enc) AS m, {_plain('word_enc')} AS plain FROM dict) d ON q.lang = d.lang AND q.m = d.m
    WHERE {_near('q.wq', 'd.word_enc', 'q.plain', 'd.plain')}),
{out}_o AS (SELECT * FROM {out}_c WHERE {_overlap('word', 'candidate')} AND abs(length(word) - length(candidate)) <= {limit}),
{out}_p AS (SELECT DISTINCT word AS a, candidate AS b FROM {out}_o),
{weighted(f'{out}_p', f'{out}_w')},
{out} AS (SELECT lang, word, row_number() OVER (PARTITION BY lang, word ORDER BY w, freq DESC, word_enc)::INT AS rank, candidate, w::INT AS distance, freq AS frequency
    FROM {out}_o JOIN {out}_w ON word = a AND candidate = b WHERE w <= {10 * limit} QUALIFY rank <= {k})"""


def corrected(words: str, out: str) -> str:
    """CTEs: ``out`` (lang, word, corrected, source, candidates) for the distinct (lang, word) of ``words``; needs dict and err."""
    return f"""
{out}_b AS (SELECT lang, word, {_EDGE.format('word', 1)} AS pre, {_EDGE.format('word', 2)} AS core, {_EDGE.format('word', 3)} AS suf FROM {words} WHERE word IS NOT NULL),
{out}_n AS (SELECT *, CASE WHEN length(word) >= 2 AND core <> '' THEN lower(core) END AS norm FROM {out}_b),
{out}_l AS (SELECT n.*, e.correction AS hit, n.norm IS NOT NULL AND e.correction IS NULL AND {_ENC.format('n.norm')} NOT IN (SELECT word_enc FROM dict) AS open
    FROM {out}_n n LEFT JOIN err e ON n.lang = e.lang AND n.norm = e.typo),
{out}_q AS (SELECT DISTINCT lang, norm AS word FROM {out}_l WHERE open),
{similar(f'{out}_q', f'{out}_s', 1)},
{out}_f AS (SELECT lang, word, count(*)::INT AS n, min(candidate) FILTER (rank = 1) AS best FROM {out}_s GROUP BY lang, word),
{out}_m AS (SELECT l.lang, l.word, core, hit IS NOT NULL AND {_STRIP.format('norm')} <> {_STRIP.format('hit')} AS by_map, pre || hit || suf AS mapped, pre || best || suf AS top, n
    FROM {out}_l l LEFT JOIN {out}_f f ON l.open AND l.lang = f.lang AND l.norm = f.word),
{out} AS (SELECT lang, word,
    CASE WHEN by_map THEN mapped WHEN top IS NULL THEN NULL WHEN regexp_full_match(core, '\\p{{Lu}}+') THEN upper(top) WHEN regexp_matches(core, '^\\p{{Lu}}') THEN upper(left(top, 1)) || substr(top, 2) ELSE top END AS corrected,
    CASE WHEN by_map THEN 'UserKnown' WHEN top IS NOT NULL THEN 'Dictionary' ELSE 'None' END AS source,
    CASE WHEN by_map THEN 1 ELSE coalesce(n, 0) END AS candidates FROM {out}_m)"""


def suggested(words: str, out: str) -> str:
    """CTEs: ``out`` (lang, word, rank, candidate, distance, frequency, source) for the distinct (lang, word) of ``words``."""
    return f"""
{out}_n AS (SELECT lang, word, lower(word) AS norm FROM {words} WHERE word IS NOT NULL),
{out}_r AS (SELECT n.* FROM {out}_n n ANTI JOIN dict d ON n.lang = d.lang AND {_ENC.format('n.norm')} = d.word_enc),
{out}_q AS (SELECT DISTINCT lang, norm AS word FROM {out}_r),
{similar(f'{out}_q', f'{out}_s', 1)},
{out}_a AS (SELECT n.lang, n.word, e.correction AS candidate, 0 AS distance, 1000::BIGINT AS frequency, 'UserKnown' AS source FROM {out}_n n JOIN err e ON n.lang = e.lang AND n.norm = e.typo
    UNION ALL SELECT r.lang, r.word, s.candidate, s.distance, s.frequency, 'Dictionary' FROM {out}_r r JOIN {out}_s s ON r.lang = s.lang AND r.norm = s.word),
{out} AS (SELECT lang, word, row_number() OVER (PARTITION BY lang, word ORDER BY distance, frequency DESC, source DESC, candidate)::INT AS rank, candidate, distance, frequency, source FROM {out}_a QUALIFY rank <= 3)"""


def _case(column: str) -> str:
    return "CASE " + "{} " + " ".join(f"WHEN '{x}' THEN {column.format(x)}" for x in _LANGS) + " END"


_TOP = "greatest(" + ", ".join(f"p_{x}" for x in _LANGS) + ")"
_FIRST = f"CASE {_TOP} " + " ".join(f"WHEN p_{x} THEN '{x}'" for x in _LANGS) + " END"
_MOVES = ", ".join(f"CASE WHEN p_{x} < top AND (top >= 0.9::DOUBLE OR top > c_{x} * 1.2::DOUBLE) THEN pos END AS at_{x}" for x in _LANGS)
_NEXT = ", ".join(f"min(at_{x}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n_{x}" for x in _LANGS)
#: ``det``: the rows where the language changes.  A change always goes to the first of the best languages.
_DETECTED = f"""
{_EVIDENCE} tn AS (SELECT * FROM tk WHERE NOT pending), {_windows('tn')},
h1 AS (SELECT *, {_TOP} AS top, {_FIRST} AS best FROM w1),
h2 AS (SELECT *, {_MOVES} FROM h1 WHERE top >= 0.8::DOUBLE),
h3 AS (SELECT *, {_NEXT} FROM h2),
det AS (SELECT doc_id, pos, best AS language, top AS confidence, {_case('n_{}').format('best')} AS nxt FROM h3 QUALIFY at_en IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, at_en IS NULL ORDER BY pos) = 1
    UNION ALL SELECT h.doc_id, h.pos, h.best, h.top, {_case('h.n_{}').format('h.best')} FROM det JOIN h3 h ON h.doc_id = det.doc_id AND h.pos = det.nxt)
"""


def _results(mode: str, remainder: str = "correct") -> str:
    """CTEs: ``res`` (doc_id, pos, original, corrected, source, code, confidence)."""
    lang = "coalesce(last_value(d.language IGNORE NULLS) OVER (PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'en')" if mode == "propagate_next" else "'en'"
    tail = "r"
    more = ""
    if remainder == "suggest":
        more = f", pw AS (SELECT DISTINCT lang, token AS word FROM loc WHERE pending), {suggested('pw', 'sg')}"
        tail = "(SELECT r.* REPLACE (CASE WHEN pending THEN sg.candidate ELSE r.corrected END AS corrected) FROM r LEFT JOIN sg ON sg.rank = 1 AND r.lang = sg.lang AND r.original = sg.word)"
    return f"""WITH RECURSIVE {_TOKENS}, {_DETECTED}, {_ERR},
loc AS (SELECT t.doc_id, t.pos, t.token, t.pending, d.language AS code, d.confidence, {lang} AS lang FROM tokens t LEFT JOIN det d ON t.doc_id = d.doc_id AND t.pos = d.pos),
cw AS (SELECT DISTINCT lang, token AS word FROM loc), {corrected('cw', 'cc')}{more},
r AS (SELECT l.doc_id, l.pos, l.pending, l.lang, l.token AS original, c.corrected, c.source, l.code, l.confidence FROM loc l LEFT JOIN cc c ON l.lang = c.lang AND l.token = c.word),
res AS (SELECT * FROM {tail})
"""


_JSON = "to_json({'original': original, 'corrected': corrected, 'detected_language': CASE WHEN code IS NOT NULL THEN {'code': code, 'confidence': confidence} END})::VARCHAR"
_PAIRS = "pairs AS (SELECT DISTINCT lower(original) AS a, lower(corrected) AS b FROM token_result WHERE original IS NOT NULL AND corrected IS NOT NULL)"

_FOCUS = f"""
WITH k AS (SELECT window_id % 97 AS device, event_id AS ord, window_id AS win, kind, ch, regexp_replace(lower(key), '[^\\p{{L}}]', '', 'g') AS key FROM key_events WHERE window_id IS NOT NULL),
     m AS (SELECT device, ord, ch, coalesce(lag(win) OVER w <> 0 AND lag(win) OVER w <> win, false) AS moved,
                  CASE WHEN kind = 'Char' AND ch IS NOT NULL THEN CASE WHEN regexp_full_match(ch, '{_DELIM}') THEN 'end' ELSE 'char' END
                       WHEN kind = 'Special' AND key IN ('enter', 'tab', 'escape') THEN 'key' WHEN kind = 'Special' AND key = 'backspace' THEN 'clear' END AS what FROM k WINDOW w AS (PARTITION BY device ORDER BY ord)),
     n AS (SELECT *, count(*) FILTER (moved) OVER (PARTITION BY device ORDER BY ord) AS moves, count(*) FILTER (what <> 'char') OVER (PARTITION BY device ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM m),
     g AS (SELECT device, coalesce(string_agg(ch, '' ORDER BY ord) FILTER (what = 'char'), '') AS token, max(ord) AS last_order,
                  CASE max(what) FILTER (what <> 'char') WHEN 'end' THEN max(ch) FILTER (what = 'end') ELSE ' ' END AS delimiter, max(what) FILTER (what <> 'char') AS how FROM n WHERE what IS NOT NULL GROUP BY device, moves, ended)
SELECT device, {_bounded('token')} AS token, last_order, delimiter, how = 'end' AS applied FROM g WHERE how IN ('end', 'key')
"""

SQL = {
    "typed_focus": _FOCUS,
    "stream_focus": _FOCUS,
    "edit_script": f"""WITH RECURSIVE {_DICT}, {_ERR}, o AS (SELECT DISTINCT doc_id, pos, original FROM token_result WHERE original IS NOT NULL AND doc_id IS NOT NULL AND pos IS NOT NULL),
        x AS (SELECT *, regexp_split_to_array(original, '{_DELIM}') AS cut, lead(pos // 5) OVER (PARTITION BY doc_id ORDER BY pos) <> pos // 5 AS leaves FROM o),
        y AS (SELECT doc_id, pos, original, leaves, len(cut) AS n, generate_subscripts(cut, 1) AS i, unnest(cut) AS raw, list_sum([length(z) + 1 FOR z IN cut[1:i]])::BIGINT - 1 AS spot FROM x),
        t AS (SELECT doc_id, pos::BIGINT * 100000 + spot AS last_order, {_bounded('raw')} AS token, substr(original || ' ', spot + 1, 1) AS delimiter FROM y WHERE NOT (i = n AND coalesce(leaves, false))),
        w AS (SELECT DISTINCT 'en' AS lang, token AS word FROM t), {corrected('w', 'cc')}
        SELECT doc_id, last_order, (length(token) + 1)::INT AS backspaces, corrected || delimiter AS insert_text FROM t JOIN cc ON token = word WHERE corrected IS NOT NULL""",
    "damerau_pairs": f"WITH {_PAIRS} SELECT a, b, least({letter_wise('damerau_levenshtein', 'a', 'b')}, 3)::INT AS distance FROM pairs",
    "keyboard_pairs": f"""WITH RECURSIVE {_PAIRS}, pn AS (SELECT a, b FROM pairs WHERE a <> '' AND b <> '' AND abs(length(a) - length(b)) <= 2), {weighted('pn', 'wd')}
        SELECT a, b, least(21, CASE WHEN a = '' OR b = '' THEN 10 * (length(a) + length(b)) ELSE coalesce(w, 21) END)::INT AS distance FROM pairs LEFT JOIN wd USING (a, b)""",
    "overlap_pairs": f"""WITH {_PAIRS}, s AS (SELECT a, b, coalesce(list_sum([least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))) FOR c IN list_distinct({_letters('a')})]), 0)::INT AS shared FROM pairs)
        SELECT a, b, shared, {_overlap('a', 'b')} AS enough FROM s""",
    "fuzzy_candidates": f"""WITH {_DICT}, {_TYPED},
        q AS (SELECT DISTINCT lang, {_ENC.format('lower(word)')} AS word_q FROM typed WHERE {_ENC.format('lower(word)')} NOT IN (SELECT word_enc FROM dict)),
        r AS (SELECT lang, word_q, {_plain('word_q')} AS plain, unnest(range(length(word_q) - 2, length(word_q) + 3)) AS m FROM q)
        SELECT r.lang, word_q, word_enc FROM r JOIN (SELECT *, length(word_enc) AS m, {_plain('word_enc')} AS plain FROM dict) d ON r.lang = d.lang AND r.m = d.m WHERE {_near('word_q', 'word_enc', 'r.plain', 'd.plain')}""",
    "fuzzy_topk": f"""WITH RECURSIVE {_DICT}, {_TYPED}, op AS (SELECT DISTINCT lang, lower(word) AS word FROM typed WHERE {_ENC.format('lower(word)')} NOT IN (SELECT word_enc FROM dict)),
        {similar('op', 'fz', 2)} SELECT * FROM fz""",
    "suggestions": f"WITH RECURSIVE {_DICT}, {_ERR}, {_TYPED}, {suggested('typed', 'sg')} SELECT * FROM sg",
    "correct_words": f"WITH RECURSIVE {_DICT}, {_ERR}, {_TYPED}, {corrected('typed', 'cc')} SELECT * FROM cc",
    "correct_text": rf"""WITH RECURSIVE {_DICT}, {_ERR}, p AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}''-]+|[^\p{{L}}\p{{N}}\p{{M}}''-]+') AS ps FROM documents WHERE text IS NOT NULL),
        x AS (SELECT doc_id, generate_subscripts(ps, 1) AS pos, unnest(ps) AS piece FROM p),
        w AS (SELECT DISTINCT 'en' AS lang, piece AS word FROM x WHERE regexp_full_match(piece, '[\p{{L}}\p{{N}}\p{{M}}''-]+')), {corrected('w', 'cc')},
        y AS (SELECT doc_id, pos, CASE WHEN corrected IS NULL THEN piece WHEN regexp_matches(piece, '^\p{{Lu}}') THEN upper(left(corrected, 1)) || lower(substr(corrected, 2)) ELSE lower(corrected) END AS piece
              FROM x LEFT JOIN cc ON piece = word)
        SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY pos), '') AS corrected_text FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN y USING (doc_id) GROUP BY doc_id""",
    "lang_switch_full": f"WITH RECURSIVE {_TOKENS}, {_DETECTED} SELECT doc_id, pos, language, round(confidence, 6) AS confidence FROM det",
    "pipeline_results": _results("propagate_next") + "SELECT doc_id, pos, original, corrected, source, code AS detected, round(confidence, 6) AS confidence FROM res",
    "pipeline_events": _results("fixed")
    + """SELECT doc_id, pos, 0 AS step, 'WordExtracted' AS event, original AS word, NULL::VARCHAR AS corrected, NULL::VARCHAR AS language, NULL::DOUBLE AS confidence FROM res
        UNION ALL SELECT doc_id, pos, 1, 'LanguageDetected', NULL, NULL, code, round(confidence, 6) FROM res WHERE code IS NOT NULL
        UNION ALL SELECT doc_id, pos, 2, 'WordCorrected', original, corrected, NULL, NULL FROM res WHERE corrected IS NOT NULL""",
    "pipeline_json": _results("propagate_next") + f"SELECT doc_id, pos, {_JSON} AS result FROM res",
    "web_results": _results("fixed", "suggest") + f"SELECT doc_id, pos, {_JSON} AS result FROM res",
}
