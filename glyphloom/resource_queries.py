"""Registered queries of files: dictionaries, word lists, stopwords, key events, keycode tables, SQL functions.

Each writes a table in the engine's own format into the shared folder, reads it
back by the reader under test and removes it with the session's other folders.
What has to be one file by its format is made from tables of fixed size.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from glyphloom.core_sql import _DICT, _ENC, _STOPS
from glyphloom.core_sql_correction import SQL as CORRECTION
from glyphloom.core_sql_correction import _PAIRS, letter_wise
from glyphloom.functions import distance
from glyphloom.session import read_table, working_folder
from glyphloom.sources import keyevents, resources

LANGS = ["en", "es", "pt"]


def _dictionary(spark, d):
    words = read_table(spark, d, "dictionary").where("lang is not null and trim(word) <> ''")
    return resources.build_dictionary(words, "lang", "word", "freq", ["entry_id"])


def dictionary_file(spark, d):
    """The dictionary, written as a sorted file and scanned again."""
    path = f"{working_folder(spark)}/dictionary.parquet"
    resources.write_dictionary(_dictionary(spark, d), path)
    return resources.read_dictionary(spark, path)


def _resource_folder(spark, d):
    """core_words and stopwords (of fixed size) as JSON resource files."""
    base = Path(working_folder(spark).removeprefix("file:"))
    for kind in ("dictionaries", "stopwords"):
        (base / kind).mkdir(parents=True, exist_ok=True)
    words = read_table(spark, d, "core_words").orderBy("word_id").collect()
    stops = read_table(spark, d, "stopwords").where("word is not null").collect()
    for lang in LANGS:
        named = [{"word": r["word"], "frequency": r["freq"]} for r in words if r["lang"] == lang and r["word"]]
        (base / "dictionaries" / f"{lang}.json").write_text(json.dumps({"language": lang, "words": named}, ensure_ascii=False))
        (base / "stopwords" / f"{lang}.json").write_text(json.dumps({"language": lang, "stopwords": [r["word"] for r in stops if r["lang"] == lang]}, ensure_ascii=False))
    return str(base)


def loaded_dictionary(spark, d):
    """The bundle of resource files: its dictionary."""
    return resources.Resources.load(spark, _resource_folder(spark, d), LANGS).dictionary


def loaded_stopwords(spark, d):
    """The bundle of resource files: its stopwords."""
    return resources.Resources.load(spark, _resource_folder(spark, d), LANGS).stopwords


def _lines(spark, d, line):
    path = f"{working_folder(spark)}/words.txt"
    read_table(spark, d, "core_words").where("lang = 'es'").orderBy("word_id").select(line.alias("value")).coalesce(1).write.text(path)
    return path


def frequency_list(spark, d):
    path = _lines(spark, d, F.concat_ws(" ", "word", F.col("freq").cast("string")))
    return resources.import_frequency_list(spark, path, "es").drop("pos")


def word_list(spark, d):
    return resources.import_word_list(spark, _lines(spark, d, F.col("word")), "es").drop("pos")


def expanded_words(spark, d):
    path = _lines(spark, d, F.concat(F.lit("'"), F.upper("word"), F.lit("-")))
    counts = _lines(spark, d, F.concat_ws(" ", "word", F.col("freq").cast("string")))
    return resources.import_expanded_words(spark, path, "es", counts)


def key_source(spark, d):
    """Key events through the engine's own source, per kind."""
    e = keyevents.create_source(spark, "batch", f"{d}/key_events.parquet")
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.count("ch").alias("characters"), F.max("seq").alias("last_seq"))


def keymap(spark, d):
    out = keyevents.keymap(spark, "windows")
    for p in ("linux", "macos"):
        out = out.unionByName(keyevents.keymap(spark, p))
    return out


def _pairs(spark, d):
    t = read_table(spark, d, "token_result").where("original is not null and corrected is not null")
    return t.select(F.lower("original").alias("a"), F.lower("corrected").alias("b")).distinct()


def far_pairs(spark, d):
    """Distances beyond two, by the whole table."""
    return _pairs(spark, d).select("a", "b", distance.damerau_col(F.col("a"), F.col("b"), 6).alias("distance"))


def sql_functions(spark, d):
    """The distances once more, called from SQL."""
    distance.register_sql(spark)
    _pairs(spark, d).createOrReplaceTempView("glyphloom_pairs")
    return spark.sql("SELECT a, b, damerau_distance(a, b, 2) AS slips, keyboard_distance(a, b, 2) AS distance, char_overlap_ok(a, b) AS enough FROM glyphloom_pairs")


_KEYMAP = r"""
WITH p(platform, letters, digits, row, space) AS (VALUES ('windows', 65, 48, '0123456789', 32), ('linux', 38, 10, '1234567890', 65), ('macos', 0, 29, '1234567890', 49)),
     s(platform, key, code) AS (SELECT platform, unnest(string_split('Enter Tab Backspace Delete Escape Home End PageUp PageDown ArrowUp ArrowDown ArrowLeft ArrowRight', ' ')), unnest(codes) FROM
       (VALUES ('windows', [13, 9, 8, 46, 27, 36, 35, 33, 34, 38, 40, 37, 39]), ('linux', [36, 23, 22, 119, 9, 110, 115, 112, 117, 111, 116, 113, 114]), ('macos', [36, 48, 51, 117, 53, 115, 119, 116, 121, 126, 125, 123, 124])) v(platform, codes)),
     m(shift, caps_lock) AS (VALUES (false, false), (false, true), (true, false), (true, true)),
     c AS (SELECT platform, letters + i AS code, shift, caps_lock, chr((CASE WHEN shift <> caps_lock THEN 65 ELSE 97 END + i)::INT) AS ch FROM p, m, range(26) r(i)
           UNION ALL SELECT platform, digits + i, shift, caps_lock, CASE WHEN shift THEN substr(')!@#$%^&*(', row[i + 1]::INT + 1, 1) ELSE row[i + 1] END FROM p, m, range(10) r(i)
           UNION ALL SELECT 'windows', 96 + i, shift, caps_lock, i::VARCHAR FROM m, range(10) r(i)
           UNION ALL SELECT 'windows', code, shift, caps_lock, CASE WHEN shift THEN t ELSE f END FROM m, (VALUES (189, '-', '_'), (190, '=', '+'), (219, '[', '{'), (220, '\', '|'), (221, ']', '}'), (222, '''', '"'), (191, '/', '?'), (192, '`', '~'), (186, ';', ':'), (188, ',', '<'), (187, '.', '>')) v(code, f, t)
           UNION ALL SELECT platform, space, shift, caps_lock, ' ' FROM p, m)
SELECT platform, code::INT AS code, shift, caps_lock, ch, NULL::VARCHAR AS key FROM c ANTI JOIN s USING (platform, code) GROUP BY ALL
UNION ALL SELECT platform, code, shift, caps_lock, NULL, key FROM s, m
"""

QUERIES = {f.__name__: f for f in (dictionary_file, loaded_dictionary, loaded_stopwords, frequency_list, word_list, expanded_words, key_source, keymap, far_pairs, sql_functions)}
SQL = {
    "dictionary_file": f"WITH {_DICT} SELECT * FROM dict",
    "loaded_dictionary": f"SELECT lang, lower(word) AS word, {_ENC.format('lower(word)')} AS word_enc, CASE WHEN coalesce(freq, 0) = 0 THEN 1 ELSE freq END AS freq FROM core_words WHERE lang IN ('en', 'es', 'pt') AND word <> ''",
    "loaded_stopwords": f"WITH {_STOPS} SELECT lang, word FROM st WHERE lang IN ('en', 'es', 'pt')",
    "frequency_list": r"SELECT 'es' AS lang, word, freq FROM core_words WHERE lang = 'es' AND regexp_full_match(word, '\p{L}{2,}') UNION ALL VALUES ('es', 'a', 100000000), ('es', 'I', 100000000)",
    "word_list": "SELECT 'es' AS lang, word, 1::BIGINT AS freq FROM core_words WHERE lang = 'es' AND length(word) > 1",
    "expanded_words": r"SELECT 'es' AS lang, lower(regexp_replace(word, '[^\p{L}\p{N}\p{M}_''-]', '', 'g')) AS word, freq FROM core_words WHERE lang = 'es' AND length(word) > 1",
    "key_source": "SELECT kind, count(*) AS events, count(ch) AS characters, max(seq) AS last_seq FROM key_events GROUP BY kind",
    "keymap": _KEYMAP,
    "far_pairs": f"WITH {_PAIRS} SELECT a, b, least({letter_wise('damerau_levenshtein', 'a', 'b')}, 7)::INT AS distance FROM pairs",
    "sql_functions": f"WITH k AS ({CORRECTION['keyboard_pairs']}), o AS ({CORRECTION['overlap_pairs']}), s AS ({CORRECTION['damerau_pairs']}) SELECT a, b, s.distance AS slips, k.distance, enough FROM k JOIN o USING (a, b) JOIN s USING (a, b)",
}
