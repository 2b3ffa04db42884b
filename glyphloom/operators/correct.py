"""Word and text correction: error map, validity in any language, fuzzy search.

Everything is decided once per distinct (language, word); cheap lookups come
first and only what they leave over enters the similarity join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.config import CorrectionConfig
from glyphloom.functions.chars import WORD_RUN, edge_parts, encode_accents, is_all_upper, preserve_case, strip_accents, titlecase
from glyphloom.operators.lookup import TYPO_FREQUENCY
from glyphloom.operators.similarity import find_similar
from glyphloom.operators.tokenize import word_pieces
from glyphloom.session import cut_lineage
from glyphloom.skew import attach_known
from glyphloom.sources.resources import Resources

CANDIDATES = "array<struct<word:string,distance:int,frequency:bigint,source:string>>"


def _with_hits(words: DataFrame, resources: Resources, config: CorrectionConfig) -> DataFrame:
    """(lang, word, e, norm, hit): edge parts, what is looked up, and the error map's correction of it."""
    base = words.select("lang", "word").where("word is not null").withColumn("e", edge_parts(F.col("word")))
    core = F.col("e.core")
    norm = core if config.case_sensitive else F.lower(core)
    base = base.withColumn("norm", F.when((F.length("word") >= config.min_word_length) & (core != ""), norm))
    e = resources.errors.select(F.col("lang").alias("_l"), F.col("typo").alias("_t"), F.col("correction").alias("hit"))
    return base.join(e.hint("merge"), (F.col("lang") == F.col("_l")) & (F.lower("norm") == F.col("_t")), "left").drop("_l", "_t")


def _by_map(config: CorrectionConfig) -> Column:
    """The error map decides: it has the word, with more than accents to change (unless enforced)."""
    accents_only = strip_accents(F.col("norm")) == strip_accents(F.col("hit"))
    return F.col("hit").isNotNull() if config.enforce_accents else F.col("hit").isNotNull() & ~F.coalesce(accents_only, F.lit(False))


def _affixed(x: Column) -> Column:
    return F.concat(F.col("e.prefix"), x, F.col("e.suffix"))


def map_corrections(words: DataFrame, resources: Resources, config: CorrectionConfig = CorrectionConfig()) -> DataFrame:
    """(lang, word, corrected): the words that the error map alone corrects; no dictionary is read."""
    return _with_hits(words, resources, config).where(_by_map(config)).select("lang", "word", _affixed(F.col("hit")).alias("corrected"))


def correct_words(words: DataFrame, resources: Resources, config: CorrectionConfig = CorrectionConfig()) -> DataFrame:
    """(lang, word, corrected, source, candidates) for distinct (lang, word).

    Decisions, first match wins: too short or only ``-'`` -> none; in the
    error map and different by accents only (unless enforced) -> none; in the
    error map -> its correction, not re-cased; in any dictionary -> none; best
    fuzzy candidate, re-cased; else none.  ``source``: UserKnown, Dictionary, None.
    """
    looked = _with_hits(words, resources, config)
    known = resources.dictionary.select(F.col("word_enc").alias("_e")).distinct().withColumn("valid", F.lit(True))
    looked = looked.join(known.hint("merge"), encode_accents(F.col("norm")) == F.col("_e"), "left").drop("_e")
    open_ = looked.where("norm is not null and hit is null and valid is null").select("lang", F.col("norm").alias("word")).distinct()
    fuzzy = find_similar(open_, resources.dictionary, config.max_edit_distance, config.max_candidates)
    best = fuzzy.groupBy(F.col("lang").alias("_l"), F.col("word").alias("_n")).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("candidate").alias("word"), "distance", "frequency"))).alias("f")
    )
    joined = looked.join(best.hint("merge"), (F.col("lang") == F.col("_l")) & (F.col("norm") == F.col("_n")) & F.col("hit").isNull() & F.col("valid").isNull(), "left")
    affix, by_map, core = _affixed, _by_map(config), F.col("e.core")
    by_dict = F.col("hit").isNull() & F.col("f").isNotNull()
    top = affix(F.get("f", F.lit(0))["word"])
    recased = F.when(is_all_upper(core), F.upper(top)).when(core.rlike(r"^\p{Lu}"), titlecase(top)).otherwise(top)
    one = F.array(F.struct(affix(F.col("hit")).alias("word"), F.lit(0).alias("distance"), F.lit(TYPO_FREQUENCY).cast("long").alias("frequency"), F.lit("UserKnown").alias("source")))
    many = F.transform("f", lambda x: F.struct(x["word"].alias("word"), x["distance"].alias("distance"), x["frequency"].alias("frequency"), F.lit("Dictionary").alias("source")))
    return joined.select(
        "lang", "word",
        F.when(by_map, affix(F.col("hit"))).when(by_dict, recased).alias("corrected"),
        F.when(by_map, "UserKnown").when(by_dict, "Dictionary").otherwise("None").alias("source"),
        F.when(by_map, one).when(by_dict, many).otherwise(F.array().cast(CANDIDATES)).cast(CANDIDATES).alias("candidates"),
    )


def distinct_words(tokens: DataFrame, *more: Column) -> DataFrame:
    """(lang, word, uses, and what ``more`` aggregates) of ``tokens``, lineage cut."""
    return cut_lineage(tokens.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("uses"), *more))


def found_corrections(words: DataFrame, resources: Resources, config: CorrectionConfig) -> DataFrame:
    """``correct_words`` of ``distinct_words``, with ``uses``: only the words that are corrected; lineage cut."""
    found = correct_words(words.select("lang", "word"), resources, config).where("source <> 'None'")
    return cut_lineage(found.join(words.select("lang", "word", "uses").hint("merge"), ["lang", "word"]))  # the fuzzy search is the dear part


def correct_tokens(
    tokens: DataFrame, resources: Resources, config: CorrectionConfig = CorrectionConfig(), spread: tuple[str, ...] = ("doc_id", "pos"), words: DataFrame | None = None
) -> DataFrame:
    """``tokens`` (with ``lang`` and ``token``) plus corrected, source and candidates.

    One decision per distinct word (``words``: their ``distinct_words``, if they
    are there already), attached to all tokens, which are not shuffled while
    few words have a correction.
    """
    t = tokens.withColumn("_lang", F.coalesce("lang", F.lit("")))
    found = found_corrections(distinct_words(tokens) if words is None else words, resources, config)
    found = found.withColumnsRenamed({"lang": "_lang", "word": "token"})
    payload = ["corrected", "source", "candidates"]
    done = attach_known(t, found, ["_lang", "token"], payload, "uses", list(spread)).drop("_lang")
    none = {"source": F.lit("None"), "candidates": F.array().cast(CANDIDATES)}
    return done.withColumns({c: F.when(F.col("token").isNotNull(), F.coalesce(c, x)) for c, x in none.items()})


def suggestions(words: DataFrame, resources: Resources, config: CorrectionConfig = CorrectionConfig()) -> DataFrame:
    """(lang, word, rank, candidate, distance, frequency, source): what may be meant.

    The error map's correction (distance 0) and the fuzzy candidates of the
    lower-cased word, if it is not in the language's dictionary; no trimming,
    no check of other languages.
    """
    if config.max_candidates == 0:
        return find_similar(words.select("lang", "word").where("false"), resources.dictionary).withColumn("source", F.lit(""))
    w = words.select("lang", "word").distinct().where("word is not null").withColumn("norm", F.lower("word"))
    e = resources.errors.select("lang", F.col("typo").alias("norm"), F.col("correction").alias("candidate"))
    mapped = w.join(e.hint("merge"), ["lang", "norm"]).select("lang", "word", "candidate", F.lit(0).alias("distance"), F.lit(TYPO_FREQUENCY).cast("long").alias("frequency"), F.lit("UserKnown").alias("source"))
    own = resources.dictionary.select(F.col("lang").alias("_l"), F.col("word_enc").alias("_e"))
    rest = w.join(own.hint("merge"), (F.col("lang") == F.col("_l")) & (encode_accents(F.col("norm")) == F.col("_e")), "left_anti")
    near = find_similar(rest.select("lang", F.col("norm").alias("word")).distinct(), resources.dictionary, config.max_edit_distance, config.max_candidates)
    fuzzy = near.withColumnRenamed("word", "norm").join(rest.hint("merge"), ["lang", "norm"]).select("lang", "word", "candidate", "distance", "frequency", F.lit("Dictionary").alias("source"))
    rank = F.row_number().over(Window.partitionBy("lang", "word").orderBy("distance", F.col("frequency").desc(), F.col("source").desc(), "candidate"))
    return mapped.unionByName(fuzzy).withColumn("rank", rank).where(F.col("rank") <= config.max_candidates).select("lang", "word", "rank", "candidate", "distance", "frequency", "source")


def correct_text(docs: DataFrame, resources: Resources, lang: str, id_col: str, text: str, config: CorrectionConfig = CorrectionConfig()) -> DataFrame:
    """(doc_id, corrected_text): words corrected and re-cased like the original, all else as it was.

    Documents are moved once, by id; of their words only the ones that change
    meet them again, once per document.
    """
    d = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    own = F.array_distinct(F.filter(word_pieces(F.col("text")), lambda x: x.rlike(f"^{WORD_RUN}$")))
    t = d.select("doc_id", F.explode(own).alias("token")).withColumn("lang", F.lit(lang))
    done = correct_tokens(t, resources, config, ("doc_id",)).where("corrected is not null")
    change = F.struct(F.col("token"), preserve_case(F.col("token"), F.col("corrected")).alias("new"))
    per_doc = done.groupBy(F.col("doc_id").alias("_doc")).agg(F.map_from_entries(F.collect_set(change)).alias("_changes"))
    # texts of one id, if ever there are several, are put together piece by piece
    texts = d.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    joined = texts.join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    new = lambda x: F.coalesce(F.try_element_at("_changes", x), x)
    numbered = F.flatten(F.transform("texts", lambda t: F.transform(word_pieces(t), lambda x, i: F.struct(i.alias("pos"), new(x).alias("piece")))))
    one = F.array_join(F.transform(word_pieces(F.get("texts", F.lit(0))), new), "")
    out = F.when(F.size("texts") == 1, one).otherwise(F.array_join(F.transform(F.array_sort(numbered), lambda x: x["piece"]), ""))
    return joined.select("doc_id", out.alias("corrected_text"))
