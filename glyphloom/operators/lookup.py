"""Lookups that are joins: frequencies, membership, cross-language validity, known typos.

Words are reduced to distinct ones before anything is joined; the answers are
attached to tokens with ``attach_by_key`` (hot words are broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.chars import encode_accents

#: Frequency of a known typo's correction.
TYPO_FREQUENCY = 1000


def exact_frequency(words: DataFrame, dictionary: DataFrame, lang: str = "lang", word: str = "word") -> DataFrame:
    """``words`` with ``freq`` of the language's own dictionary; null if it is not in it."""
    d = dictionary.select(F.col("lang").alias("_l"), F.col("word_enc").alias("_e"), "freq")
    return words.join(d, (F.col(lang) == F.col("_l")) & (encode_accents(F.col(word)) == F.col("_e")), "left").drop("_l", "_e")


def known_words(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Rows of ``words`` that any language's dictionary has."""
    d = dictionary.select(F.col("word_enc").alias("_e")).distinct()
    return words.join(d, encode_accents(F.col(word)) == F.col("_e"), "left_semi")


def unknown_words(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Rows of ``words`` that no language's dictionary has."""
    d = dictionary.select(F.col("word_enc").alias("_e")).distinct()
    return words.join(d.hint("merge"), encode_accents(F.col(word)) == F.col("_e"), "left_anti")


def dictionary_size(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("lang").agg(F.count(F.lit(1)).alias("words"))


def dictionary_bytes(dictionary: DataFrame) -> DataFrame:
    """A rough memory estimate per language: words times (average length + 64)."""
    return dictionary.groupBy("lang").agg((F.count(F.lit(1)) * 64 + F.sum(F.octet_length("word"))).alias("bytes"))


def lookup_typo(words: DataFrame, errors: DataFrame, lang: str = "lang", word: str = "word") -> DataFrame:
    """``words`` with ``correction`` and ``error_source`` of a clean error map, else null."""
    e = errors.select(F.col("lang").alias("_l"), F.col("typo").alias("_t"), "correction", F.col("source").alias("error_source"))
    return words.join(e, (F.col(lang) == F.col("_l")) & (F.lower(F.col(word)) == F.col("_t")), "left").drop("_l", "_t")


def known_typos(words: DataFrame, errors: DataFrame, lang: str = "lang", word: str = "word") -> DataFrame:
    """Rows of ``words`` that the language's error map has."""
    e = errors.select(F.col("lang").alias("_l"), F.col("typo").alias("_t"))
    return words.join(e, (F.col(lang) == F.col("_l")) & (F.lower(F.col(word)) == F.col("_t")), "left_semi")


def is_stopword(words: DataFrame, stopwords: DataFrame, lang: str = "lang", word: str = "word") -> DataFrame:
    """Rows of ``words`` that are stopwords of their language, letter case aside."""
    s = stopwords.select(F.col("lang").alias("_l"), F.lower("word").alias("_w")).distinct()
    return words.join(s, (F.col(lang) == F.col("_l")) & (F.lower(F.col(word)) == F.col("_w")), "left_semi")


def typo_frequency() -> Column:
    return F.lit(TYPO_FREQUENCY).cast("long")
