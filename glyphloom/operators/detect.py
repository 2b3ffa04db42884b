"""Rolling-window language detection with hysteresis.

Scores are sums over the last ``window_size`` tokens of a text: a stopword
gives its weight (one over the number of languages that have it) to each of
its languages, any other word 0.1 to each language whose dictionary has it.
The sequential part (the language only changes when a better one is sure
enough) is folded over the few positions where a change is possible.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.config import DetectorConfig
from glyphloom.functions.chars import encode_accents
from glyphloom.session import cut_lineage
from glyphloom.skew import attach_known
from glyphloom.sources.resources import clean_stopwords

#: A dictionary word that is no stopword adds one tenth.
DICTIONARY_SHARE = 10


def unit(langs: list[str]) -> int:
    """What 1.0 is counted as: evidence is whole numbers, so sums and ties are exact.

    Divisible by ten and by every possible number of languages that share a word.
    """
    return math.lcm(*range(1, max(len(langs), 1) + 1), DICTIONARY_SHARE)


def word_evidence(stopwords: DataFrame, dictionary: DataFrame, langs: list[str]) -> DataFrame:
    """(word_enc, s_<lang>, d_<lang>): what each known word adds per language.

    ``s_`` is the stopword weight, ``d_`` the dictionary hit, in parts of
    ``unit``; one row per word.
    """
    one = unit(langs)
    s = clean_stopwords(stopwords).where(F.col("lang").isin(langs)).select("lang", encode_accents(F.col("word")).alias("word_enc"), F.lit(True).alias("stop"))
    d = dictionary.where(F.col("lang").isin(langs)).select("lang", "word_enc", F.lit(False).alias("stop"))
    both = s.unionByName(d)
    hits = [F.max(F.when((F.col("lang") == l) & F.col("stop"), 1).otherwise(0)).alias(f"s_{l}") for l in langs]
    in_dict = [F.max(F.when((F.col("lang") == l) & ~F.col("stop"), one // DICTIONARY_SHARE).otherwise(0)).alias(f"d_{l}") for l in langs]
    e = both.groupBy("word_enc").agg(*hits, *in_dict)
    shared = sum((F.col(f"s_{l}") for l in langs), F.lit(0))
    weight = F.when(shared > 0, (F.lit(one) / shared).cast("long")).otherwise(0)  # divides evenly
    return e.select(
        "word_enc",
        *[(F.col(f"s_{l}") * weight).cast("long").alias(f"s_{l}") for l in langs],
        *[F.when(shared > 0, 0).otherwise(F.col(f"d_{l}")).cast("long").alias(f"d_{l}") for l in langs],
    )


def used_words(tokens: DataFrame) -> DataFrame:
    """(word_enc, uses) of the non-empty tokens: what ``word_evidence`` is looked up by."""
    return tokens.where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n")).groupBy(encode_accents(F.lower("token")).alias("word_enc")).agg(F.sum("n").alias("uses"))


def score_windows(tokens: DataFrame, stopwords: DataFrame, dictionary: DataFrame, langs: list[str], config: DetectorConfig, used: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, n, p_<lang>, c_<lang>): normalised scores and the current-language scores.

    Rows from the first position at which ``min_words_before_switch`` tokens
    are in the window.  ``c_`` is the un-normalised stopword mean that a switch
    inside the hysteresis zone is compared with.  ``used``: the ``used_words`` of
    ``tokens``, where they come cheaper.  Tokens that stand by document already
    (``repartition``) are not shuffled while few known words are in use.
    """
    t = tokens.select("doc_id", "pos", F.when(F.col("token") != "", encode_accents(F.lower("token"))).alias("word_enc"))
    cols = [f"{k}_{l}" for k in "sd" for l in langs]
    used = used_words(tokens) if used is None else used
    known = cut_lineage(word_evidence(stopwords, dictionary, langs).hint("merge").join(used.hint("merge"), "word_enc"))
    t = attach_known(t, known, ["word_enc"], cols, "uses", ["doc_id", "pos"])
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-(config.window_size - 1), 0)
    summed = t.select(
        "doc_id", "pos", F.count(F.lit(1)).over(w).alias("n"),
        *[F.sum(F.coalesce(F.col(f"s_{l}"), F.lit(0)) + F.coalesce(F.col(f"d_{l}"), F.lit(0))).over(w).alias(f"t_{l}") for l in langs],
        *[F.sum(F.coalesce(F.col(f"s_{l}"), F.lit(0))).over(w).alias(f"w_{l}") for l in langs],
    ).where(F.col("n") >= config.min_words_before_switch)
    total = sum((F.col(f"t_{l}") for l in langs), F.lit(0))
    return summed.select(
        "doc_id", "pos", "n",
        *[F.when(total > 0, F.col(f"t_{l}") / total).otherwise(0.0).alias(f"p_{l}") for l in langs],
        *[(F.col(f"w_{l}") / (F.col("n") * unit(langs))).alias(f"c_{l}") for l in langs],
    )


def uniform_priors(stopwords: DataFrame) -> DataFrame:
    """(lang, prior): one over the number of languages.  Kept for completeness; scores do not use it."""
    langs = stopwords.select("lang").where("lang is not null").distinct()
    return langs.select("lang", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy())).alias("prior"))


def rolling_words(tokens: DataFrame, size: int = 5, least: int = 5) -> DataFrame:
    """(doc_id, pos, words): the last ``size`` tokens at each position, once ``least`` are there."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-(size - 1), 0)
    return tokens.select("doc_id", "pos", F.collect_list(F.lower("token")).over(w).alias("words")).where(F.size("words") >= least)


def _scores(langs: list[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(l) for l in langs]), F.array(*[F.col(f"p_{l}") for l in langs]))


def detect(
    tokens: DataFrame, stopwords: DataFrame, dictionary: DataFrame, langs: list[str], initial: str, config: DetectorConfig = DetectorConfig(), used: DataFrame | None = None
) -> DataFrame:
    """(doc_id, pos, language, confidence, all_scores): a row where the language changes.

    Ties between languages go to the current one, then alphabetically.
    """
    langs = sorted(langs)
    if not langs:
        return tokens.select("doc_id", "pos", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("map<string,double>").alias("all_scores")).where("false")
    s = score_windows(tokens, stopwords, dictionary, langs, config, used)
    top = F.greatest(*[F.col(f"p_{l}") for l in langs]) if len(langs) > 1 else F.col(f"p_{langs[0]}")
    floor = config.confidence_threshold - config.hysteresis_zone
    s = s.withColumn("top", top).where(F.col("top") >= floor)  # nothing can change elsewhere
    # after a sure step with one best language that is the current one, so the steps that repeat it change nothing
    many = sum((F.when(F.col(f"p_{l}") == F.col("top"), 1).otherwise(0) for l in langs), F.lit(0))
    only = F.when(many == 1, F.coalesce(*[F.when(F.col(f"p_{l}") == F.col("top"), F.lit(i)) for i, l in enumerate(langs)]))
    s = s.withColumn("only", only)
    settled = F.lag(F.when(F.col("top") >= config.confidence_threshold, F.col("only"))).over(Window.partitionBy("doc_id").orderBy("pos"))
    s = s.withColumn("settled", settled).where("settled is null or only is null or settled <> only")
    best = F.filter(F.array(*[F.when(F.col(f"p_{l}") == F.col("top"), F.lit(l)) for l in langs]), lambda x: x.isNotNull())
    current = F.map_from_arrays(F.array(*[F.lit(l) for l in langs]), F.array(*[F.col(f"c_{l}") for l in langs]))
    step = F.struct("pos", "top", best.alias("best"), current.alias("current"), _scores(langs).alias("scores"))
    docs = s.groupBy("doc_id").agg(F.collect_list(step).alias("steps"))
    # maps cannot be compared, so the steps are ordered by position alone
    docs = docs.withColumn("steps", F.expr("array_sort(steps, (a, b) -> cast(a.pos - b.pos as int))"))
    seen = F.struct(F.lit(initial).alias("language"), F.array().cast("array<struct<pos:int,language:string,confidence:double,all_scores:map<string,double>>>").alias("out"))

    def fold(acc, x):
        new = F.when(F.array_contains(x["best"], acc["language"]), acc["language"]).otherwise(F.element_at(x["best"], 1))
        sure = x["top"] >= config.confidence_threshold
        better = x["top"] > F.coalesce(F.try_element_at(x["current"], acc["language"]), F.lit(0.0)) * 1.2
        change = (new != acc["language"]) & (sure | better)
        row = F.struct(x["pos"].alias("pos"), new.alias("language"), x["top"].alias("confidence"), x["scores"].alias("all_scores"))
        return F.struct(F.when(change, new).otherwise(acc["language"]).alias("language"), F.when(change, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    return docs.select("doc_id", F.inline(F.aggregate("steps", seen, fold)["out"]))


def detect_strong(tokens: DataFrame, stopwords: DataFrame, dictionary: DataFrame, langs: list[str], initial: str, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Detection without hysteresis, by window functions alone: (doc_id, pos, language, confidence).

    Needs a threshold above one half, so that no two languages can tie.
    """
    langs = sorted(langs)
    s = score_windows(tokens, stopwords, dictionary, langs, config)
    top = F.greatest(*[F.col(f"p_{l}") for l in langs]) if len(langs) > 1 else F.col(f"p_{langs[0]}")
    best = F.coalesce(*[F.when(F.col(f"p_{l}") == top, F.lit(l)) for l in langs])
    sure = s.select("doc_id", "pos", top.alias("confidence"), best.alias("language")).where(F.col("confidence") >= config.confidence_threshold)
    before = F.coalesce(F.lag("language").over(Window.partitionBy("doc_id").orderBy("pos")), F.lit(initial))
    return sure.withColumn("before", before).where("language <> before").select("doc_id", "pos", "language", "confidence")


def language_at(tokens: DataFrame, initial: str, mode: str = "fixed") -> DataFrame:
    """``tokens`` (with ``detected_language``) plus ``lang``, the language that corrects each one.

    fixed: the initial language.  propagate_next: a detection at a token
    applies from the next token on.
    """
    if mode == "fixed":
        return tokens.withColumn("lang", F.lit(initial))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("lang", F.coalesce(F.last(F.col("detected_language")["code"], ignorenulls=True).over(w), F.lit(initial)))
