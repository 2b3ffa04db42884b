"""Dictionaries, stopwords and error maps: readers, builders and the bundle of them.

Every builder takes and gives DataFrames; ``Resources`` carries them, immutable.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom import schemas
from glyphloom.functions.chars import encode_accents, strip_accents

#: Longest typo or correction that an error map takes, in characters.
MAX_ENTRY = 50
#: Learned entries that ``feedback.most_recent`` keeps unless told otherwise.
MAX_LEARNED = 10_000
#: Magic bytes and smallest size of a compiled dictionary blob.
MAGIC, MIN_BLOB = b"TFX1", 16


# ------------------------------------------------------------- dictionaries
def build_dictionary(words: DataFrame, lang: str, word: str, freq: str, order: Sequence[str | Column]) -> DataFrame:
    """(lang, word, word_enc, freq) sorted by (lang, word_enc), one row per key.

    Words are lower-cased and encoded first; of entries with one key the first
    by ``order`` stays; a frequency of 0 or null becomes 1; null and empty
    words are dropped.
    """
    w = words.where(F.col(word).isNotNull() & (F.col(word) != "")).select(
        F.col(lang).alias("lang"), F.lower(F.col(word)).alias("word"), F.col(freq).cast("long").alias("freq"), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]).alias("o")
    )
    w = w.withColumn("word_enc", encode_accents(F.col("word")))
    first = w.groupBy("lang", "word_enc").agg(F.min(F.struct("o", "word", "freq")).alias("m"))
    return first.select("lang", "m.word", "word_enc", F.when(F.coalesce("m.freq", F.lit(0)) == 0, 1).otherwise(F.col("m.freq")).alias("freq"))


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """Parquet sorted by language and stored word, so lookups prune row groups."""
    dictionary.repartitionByRange("lang", "word_enc").sortWithinPartitions("lang", "word_enc").write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DICTIONARY).parquet(path)


def read_dictionary_json(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """Dictionary files {language?, words: [{word, frequency?}]}, built (see ``build_dictionary``)."""
    raw = spark.read.schema(schemas.DICTIONARY_FILE).option("multiLine", True).json(path)
    code = F.lit(lang) if lang else F.coalesce("language", F.regexp_extract(F.input_file_name(), r"([A-Za-z]+)\.json$", 1))
    flat = raw.select(code.alias("lang"), F.posexplode("words").alias("pos", "w")).select("lang", "pos", "w.*")
    return build_dictionary(flat, "lang", "word", "frequency", ["pos"])


def dictionary_from_rows(spark: SparkSession, lang: str, words: dict[str, int]) -> DataFrame:
    rows = [(lang, w, int(n), i) for i, (w, n) in enumerate(words.items())]
    return build_dictionary(spark.createDataFrame(rows, "lang string, word string, freq long, pos int"), "lang", "word", "freq", ["pos"])


def wrap_blob(data: bytes) -> bytes:
    return MAGIC + data


def unwrap_blob(blob: bytes) -> bytes:
    """The payload of a compiled dictionary blob; ValueError if it is too small or of another kind."""
    if len(blob) < MIN_BLOB:
        raise ValueError("too small")
    if blob[:4] != MAGIC:
        raise ValueError("invalid magic")
    return blob[4:]


def corpus_dictionary(tokens: DataFrame, lang: str, token: str, min_freq: int = 1) -> DataFrame:
    """Word frequencies of a corpus as a dictionary: non-empty tokens, lower case."""
    t = tokens.select(F.col(lang).alias("lang"), F.lower(F.col(token)).alias("word")).where("lang is not null and word <> ''")
    counted = t.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_freq)
    return counted.select("lang", "word", encode_accents(F.col("word")).alias("word_enc"), "freq")


def import_frequency_list(spark: SparkSession, path: str, lang: str, forced: Sequence[str] = ("a", "I"), forced_freq: int = 100_000_000) -> DataFrame:
    """``word count`` lines: letters only, two or more; first of equal words (case aside) stays.

    Lines are numbered in file order; (lang, word, freq, pos).
    """
    line = F.split(F.trim("value"), " ")
    lines = _numbered_lines(spark, path).where(F.size(line) == 2).select((F.col("pos") + len(forced)).alias("pos"), line[0].alias("word"), line[1].try_cast("long").alias("freq"))
    lines = lines.where(F.col("freq").isNotNull() & F.col("word").rlike(r"^\p{L}{2,}$"))
    extra = spark.createDataFrame([(i, w, forced_freq) for i, w in enumerate(forced)], "pos long, word string, freq long")
    first = Window.partitionBy(F.lower("word")).orderBy("pos")
    return extra.unionByName(lines).withColumn("k", F.row_number().over(first)).where("k = 1").select(F.lit(lang).alias("lang"), "word", "freq", "pos")


def import_word_list(spark: SparkSession, path: str, lang: str, limit: int = 15_000, with_freq: bool = False) -> DataFrame:
    """The first ``limit`` lines as words (frequency 1, or the second column); one letter is too short."""
    parts = F.split(F.trim("value"), r"\s+")
    ok = (F.size(parts) >= 2) & parts[1].try_cast("long").isNotNull() if with_freq else F.trim("value") != ""
    lines = _numbered_lines(spark, path).where(ok).orderBy("pos").limit(limit)
    word, freq = (parts[0], parts[1].try_cast("long")) if with_freq else (F.trim("value"), F.lit(1).cast("long"))
    return lines.select(F.lit(lang).alias("lang"), word.alias("word"), freq.alias("freq"), "pos").where("length(word) > 1")


def import_expanded_words(spark: SparkSession, path: str, lang: str, freq_path: str | None = None, default_freq: int = 1) -> DataFrame:
    """An expanded word list: lower case, letters, digits, ``_ - '`` only, edges trimmed.

    Frequencies come from a ``word count`` file where it has the word.
    """
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(F.trim("value")), r"[^\p{L}\p{N}\p{M}_'-]", ""), r"^['-]+|['-]+$", "")
    words = spark.read.text(path).select(cleaned.alias("word")).where("length(word) > 1").distinct()
    if freq_path is None:
        return words.select(F.lit(lang).alias("lang"), "word", F.lit(default_freq).cast("long").alias("freq"))
    parts = F.split(F.trim("value"), r"\s+")
    counts = _numbered_lines(spark, freq_path).select(F.lower(parts[0]).alias("word"), F.get(parts, F.lit(1)).try_cast("long").alias("n"), "pos").where("n is not null")
    counts = counts.groupBy("word").agg(F.max_by("n", "pos").alias("n"))  # the last line of a word counts
    return words.join(counts, "word", "left").select(F.lit(lang).alias("lang"), "word", F.coalesce("n", F.lit(default_freq)).alias("freq"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their order: (pos, value)."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), "value")


# ---------------------------------------------------------------- stopwords
def clean_stopwords(stopwords: DataFrame) -> DataFrame:
    return stopwords.select("lang", F.lower("word").alias("word")).where("lang is not null and word is not null").distinct()


def read_stopwords_json(spark: SparkSession, path: str) -> DataFrame:
    """Files {language, stopwords: [...]}."""
    raw = spark.read.schema(schemas.STOPWORDS_FILE).option("multiLine", True).json(path)
    return clean_stopwords(raw.select(F.col("language").alias("lang"), F.explode("stopwords").alias("word")))


def stopwords_from_array(spark: SparkSession, lang: str, text: str) -> DataFrame:
    """A bare JSON array of words."""
    return clean_stopwords(spark.createDataFrame([(lang, w) for w in json.loads(text)], schemas.STOPWORDS))


def corpus_stopwords(vocabulary: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` most frequent words of each language; ties by stored word."""
    w = Window.partitionBy("lang").orderBy(F.col("freq").desc(), "word_enc")
    return vocabulary.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("lang", "word", "rank")


def stopword_weights(stopwords: DataFrame) -> DataFrame:
    """(word, weight): one over the number of languages that have it."""
    return clean_stopwords(stopwords).groupBy("word").agg((F.lit(1.0) / F.count("lang")).alias("weight"))


# --------------------------------------------------------------- error maps
def clean_errors(errors: DataFrame, at: str | None = None) -> DataFrame:
    """(lang, typo, correction, source): one correction per language and typo.

    Typos are lower-cased, learned corrections too; entries above ``MAX_ENTRY``
    characters on either side or with a null are dropped, learned self-maps as
    well; learned entries override static ones; then the latest by ``at`` wins,
    ties by the smaller correction.
    """
    user = F.col("source") == "user"
    e = errors.select(
        "lang", F.lower("typo").alias("typo"), F.when(user, F.lower("correction")).otherwise(F.col("correction")).alias("correction"), F.coalesce("source", F.lit("static")).alias("source"),
        (F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 62))) if at else F.lit(0)).alias("t"),
    ).where(f"lang is not null and typo is not null and correction is not null and length(typo) <= {MAX_ENTRY} and length(correction) <= {MAX_ENTRY}")
    e = e.where("source <> 'user' or typo <> correction")
    rank = F.struct(F.when(F.col("source") == "user", 0).otherwise(1).alias("k"), (-F.col("t")).alias("t"), "correction", "source")
    return e.groupBy("lang", "typo").agg(F.min(rank).alias("m")).select("lang", "typo", "m.correction", "m.source")


def read_errors_json(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """Files {language?, errors: {typo: correction}}; non-string values are skipped."""
    raw = spark.read.schema(schemas.ERRORS_FILE).option("multiLine", True).json(path)
    code = F.lit(lang) if lang else F.coalesce("language", F.regexp_extract(F.input_file_name(), r"([A-Za-z]+)\.json$", 1))
    return clean_errors(raw.select(code.alias("lang"), F.explode("errors").alias("typo", "correction")).withColumn("source", F.lit("static")))


def errors_from_json(spark: SparkSession, lang: str, text: str, source: str = "static") -> DataFrame:
    """One JSON document {errors: {...}}, or a flat {typo: correction} of learned entries."""
    data = json.loads(text)
    flat = data.get("errors", {}) if source == "static" else data
    rows = [(lang, k, v, source) for k, v in flat.items() if isinstance(v, str)]
    return clean_errors(spark.createDataFrame(rows, schemas.ERRORS))


def compile_static(errors: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Static entries less those whose typo is a dictionary word of the language.

    Entries that differ from their correction by accents only stay.
    """
    known = dictionary.select("lang", F.col("word_enc").alias("enc")).distinct()
    e = errors.withColumn("enc", encode_accents(F.col("typo")))
    kept = e.join(known.withColumn("hit", F.lit(True)), ["lang", "enc"], "left")
    accents_only = strip_accents(F.col("typo")) == strip_accents(F.lower("correction"))
    return kept.where(F.col("hit").isNull() | accents_only).select("lang", "typo", "correction", "source")


def save_learned(errors: DataFrame, path: str, lang: str) -> None:
    """Learned entries of a language as one flat JSON object."""
    rows = errors.where((F.col("source") == "user") & (F.col("lang") == lang)).select("typo", "correction").orderBy("typo").collect()
    Path(path).write_text(json.dumps({r["typo"]: r["correction"] for r in rows}, indent=2, ensure_ascii=False))


def load_learned(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """Entries saved by ``save_learned``; a missing file has none."""
    text = Path(path).read_text() if Path(path).exists() else "{}"
    return errors_from_json(spark, lang, text, "user")


# ------------------------------------------------------------------ bundles
@dataclass(frozen=True)
class Resources:
    """What detection and correction look things up in; adding gives a new bundle."""

    dictionary: DataFrame
    stopwords: DataFrame
    errors: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Resources:
        return Resources(*[spark.createDataFrame([], s) for s in (schemas.DICTIONARY, schemas.STOPWORDS, schemas.ERRORS)])

    def add_dictionary(self, d: DataFrame) -> Resources:
        return replace(self, dictionary=self.dictionary.unionByName(d))

    def add_stopwords(self, s: DataFrame) -> Resources:
        return replace(self, stopwords=clean_stopwords(self.stopwords.unionByName(s)))

    def add_errors(self, e: DataFrame) -> Resources:
        return replace(self, errors=clean_errors(self.errors.unionByName(e)))

    def languages(self) -> list[str]:
        """Languages with stopwords, sorted (one per list, so few)."""
        return [r["lang"] for r in self.stopwords.select("lang").distinct().orderBy("lang").collect()]

    @staticmethod
    def load(spark: SparkSession, folder: str, langs: Sequence[str]) -> Resources:
        """``dictionaries``, ``stopwords`` and ``errors`` of the languages; missing files are skipped."""
        out, base = Resources.empty(spark), Path(folder)
        for lang in langs:
            if (base / "dictionaries" / f"{lang}.parquet").exists():
                out = out.add_dictionary(read_dictionary(spark, str(base / "dictionaries" / f"{lang}.parquet")))
            elif (base / "dictionaries" / f"{lang}.json").exists():
                out = out.add_dictionary(read_dictionary_json(spark, str(base / "dictionaries" / f"{lang}.json"), lang))
            if (base / "stopwords" / f"{lang}.json").exists():
                out = out.add_stopwords(read_stopwords_json(spark, str(base / "stopwords" / f"{lang}.json")))
            if (base / "errors" / f"{lang}.json").exists():
                out = out.add_errors(read_errors_json(spark, str(base / "errors" / f"{lang}.json"), lang))
        return out


def demo_resources(spark: SparkSession) -> Resources:
    """Two tiny languages for examples and tests."""
    r = Resources.empty(spark)
    r = r.add_dictionary(dictionary_from_rows(spark, "en", {"and": 9000, "hello": 1000, "the": 10000, "world": 800}))
    r = r.add_dictionary(dictionary_from_rows(spark, "es", {"hola": 1000, "mundo": 800, "que": 5000}))
    r = r.add_stopwords(stopwords_from_array(spark, "en", '["the","a","an","is","are","and","or","but"]'))
    r = r.add_stopwords(stopwords_from_array(spark, "es", '["el","la","de","que","es","y","en","un"]'))
    return r.add_errors(errors_from_json(spark, "en", '{"errors":{"qeu":"que","teh":"the"}}')).add_errors(errors_from_json(spark, "es", '{"errors":{"qeu":"que"}}'))
