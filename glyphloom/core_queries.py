"""Registered queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphloom import core_sql, core_sql_correction, resource_queries
from glyphloom.config import Config, CorrectionConfig, DetectorConfig, PipelineConfig
from glyphloom.functions import chars, distance, locale
from glyphloom.operators import correct, detect, feedback, lookup, similarity, tokenize
from glyphloom.operators.orphans import fold_key, orphan_keys, orphan_references, orphan_report
from glyphloom.plans import keystrokes, pipeline
from glyphloom.session import read_table, working_folder
from glyphloom.sources import resources
from glyphloom.streaming import keystrokes as streaming

LANGS = ["en", "es", "pt"]
DETECTOR = DetectorConfig()


# ------------------------------------------------------------ shared inputs
def _documents(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text", "lang")


def _tokens(spark, d):
    return tokenize.tokenize(_documents(spark, d), "doc_id", "text")


def _labelled(spark, d, label=None):
    """Tokens with their document's label, carried along."""
    docs = _documents(spark, d)
    return tokenize.tokenize(docs if label is None else docs.withColumn("lang", label), "doc_id", "text", keep=["lang"])


def _dictionary(spark, d):
    words = read_table(spark, d, "dictionary").where("lang is not null and trim(word) <> ''")
    return resources.build_dictionary(words, "lang", "word", "freq", ["entry_id"])


def _errors(spark, d):
    return resources.clean_errors(read_table(spark, d, "errors"), "learned_at")


def _stopwords(spark, d):
    return resources.clean_stopwords(read_table(spark, d, "stopwords"))


def _resources(spark, d):
    return resources.Resources(_dictionary(spark, d), _stopwords(spark, d), _errors(spark, d))


def _typed(spark, d):
    """Distinct (lang, word) as typed; unknown languages count as en."""
    t = read_table(spark, d, "token_result").where("original is not null")
    return t.select(F.coalesce("detected_language.code", F.lit("en")).alias("lang"), F.col("original").alias("word")).distinct()


def _pairs(spark, d):
    """Pairs of words: as typed and as corrected, lower case."""
    t = read_table(spark, d, "token_result").where("original is not null and corrected is not null")
    return t.select(F.lower("original").alias("a"), F.lower("corrected").alias("b")).distinct()


# ---------------------------------------------------------------- tokenizer
def token_explode(spark, d):
    return _tokens(spark, d)


def token_class_counts(spark, d):
    return tokenize.delimiter_counts(_documents(spark, d), "text", ["lang"])


def empty_token_rate(spark, d):
    t = _tokens(spark, d)
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum((F.col("token") == "").cast("long")).alias("empty_tokens"))


def paste_tokens(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", F.array_join(tokenize.paste_tokens(F.col("text")), "\x1f").alias("tokens"))


def buffer_events(spark, d):
    return tokenize.buffer_events(_documents(spark, d), "doc_id", "text", 12)


def word_pieces(spark, d):
    return tokenize.explode_pieces(_documents(spark, d), "doc_id", "text")


def delimiter_classify(spark, d):
    c = F.col("ch")
    e = read_table(spark, d, "key_events").where("ch is not null").groupBy("ch").agg(F.count(F.lit(1)).alias("events"))
    return e.select("ch", "events", chars.classify_delimiter(c).alias("class"), chars.is_delimiter(c).alias("delimiter"), chars.is_punctuation(c).alias("punctuation"), chars.is_word_char(c).alias("word_char"))


def last_characters(spark, d):
    return _documents(spark, d).select("doc_id", chars.last_chars(F.col("text"), 8).alias("tail"), F.length("text").alias("characters"))


# ------------------------------------------------------------------ scalars
def accent_codec(spark, d):
    w = read_table(spark, d, "dictionary").where("word is not null").select(F.lower("word").alias("word")).distinct()
    e = chars.encode_accents(F.col("word"))
    return w.select("word", e.alias("encoded"), chars.decode_accents(e).alias("decoded"), chars.strip_accents(F.col("word")).alias("stripped"))


def case_restore(spark, d):
    t = read_table(spark, d, "token_result").where("original is not null and corrected is not null").select("original", "corrected").distinct()
    o, c = F.col("original"), F.col("corrected")
    return t.select("original", "corrected", chars.titlecase(c).alias("titled"), chars.preserve_case(o, c).alias("recased"), chars.is_all_upper(o).alias("all_upper"))


def edge_trim(spark, d):
    t = read_table(spark, d, "token_result").where("original is not null").select("original").distinct()
    return t.select("original", chars.edge_parts(F.col("original")).alias("e")).select("original", "e.prefix", "e.core", "e.suffix")


def locale_resolve(spark, d):
    t = read_table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))
    supported = F.array(*[F.lit(x) for x in LANGS])
    r = locale.resolve_language(F.when(F.length("lang") == 2, F.col("lang")), F.col("lang"), supported, F.lit("en"))
    return t.select("lang", "documents", r.alias("r")).select("lang", "documents", "r.code", "r.source", locale.base_language(F.col("lang")).alias("base"))


def damerau_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", distance.damerau_col(F.col("a"), F.col("b"), 2).alias("distance"))


def keyboard_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", distance.keyboard_distance_col(F.col("a"), F.col("b"), 2).alias("distance"))


def overlap_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", distance.shared_characters(F.col("a"), F.col("b")).alias("shared"), distance.overlap_ok_col(F.col("a"), F.col("b")).alias("enough"))


# ---------------------------------------------------------------- resources
def vocab_freq(spark, d):
    return resources.corpus_dictionary(_labelled(spark, d), "lang", "token")


def dict_build(spark, d):
    return _dictionary(spark, d)


def dictionary_stats(spark, d):
    x = _dictionary(spark, d)
    return lookup.dictionary_size(x).join(lookup.dictionary_bytes(x), "lang")


def top_stopwords(spark, d):
    t = _labelled(spark, d, F.lower(F.substring("lang", 1, 2)))
    return resources.corpus_stopwords(resources.corpus_dictionary(t, "lang", "token"), 25)


def stopword_weights(spark, d):
    return resources.stopword_weights(read_table(spark, d, "stopwords"))


def error_map(spark, d):
    return _errors(spark, d)


def all_typos(spark, d):
    return feedback.all_typos(_errors(spark, d))


def static_map(spark, d):
    return resources.compile_static(_errors(spark, d).where("source = 'static'"), _dictionary(spark, d))


def map_statistics(spark, d):
    return feedback.map_statistics(_errors(spark, d))


def learned_map(spark, d):
    log = read_table(spark, d, "errors").where("source = 'user'").select("lang", "typo", "correction", F.col("learned_at").alias("at"), F.when(F.col("correction").isNull(), "unlearn").otherwise("learn").alias("action"))
    return feedback.learned_map(log)


# ------------------------------------------------------------------ lookups
def exact_lookup(spark, d):
    return lookup.exact_frequency(_typed(spark, d), _dictionary(spark, d))


def oov_words(spark, d):
    return lookup.unknown_words(_typed(spark, d).select(F.lower("word").alias("word")).distinct(), _dictionary(spark, d))


def valid_words(spark, d):
    return lookup.known_words(_typed(spark, d).select(F.lower("word").alias("word")).distinct(), _dictionary(spark, d))


def typo_lookup(spark, d):
    return lookup.lookup_typo(_typed(spark, d), _errors(spark, d))


def known_typos(spark, d):
    return lookup.known_typos(_typed(spark, d), _errors(spark, d))


def stopword_hits(spark, d):
    t = _labelled(spark, d, F.lower(F.substring("lang", 1, 2)))
    hits = lookup.is_stopword(t.select("doc_id", "lang", F.col("token").alias("word")), read_table(spark, d, "stopwords"))
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("stopwords"))


# -------------------------------------------------------------- fuzzy search
def _open_words(spark, d):
    return lookup.unknown_words(_typed(spark, d).select("lang", F.lower("word").alias("word")).distinct(), _dictionary(spark, d))


def fuzzy_candidates(spark, d):
    q = _open_words(spark, d).select("lang", chars.encode_accents(F.col("word")).alias("word_q")).distinct()
    return similarity.candidates(q, _dictionary(spark, d))


def fuzzy_topk(spark, d):
    return similarity.find_similar(_open_words(spark, d), _dictionary(spark, d), 2, 3)


def suggestions(spark, d):
    return correct.suggestions(_typed(spark, d), _resources(spark, d), CorrectionConfig(max_edit_distance=1))


def correct_words(spark, d):
    return correct.correct_words(_typed(spark, d), _resources(spark, d)).select("lang", "word", "corrected", "source", F.size("candidates").alias("candidates"))


def static_corrections(spark, d):
    """What the error map alone corrects; the fuzzy search is not run."""
    return correct.map_corrections(_typed(spark, d), _resources(spark, d))


def correct_text(spark, d):
    return correct.correct_text(_documents(spark, d), _resources(spark, d), "en", "doc_id", "text")


# --------------------------------------------------------- language detection
def rolling_window_words(spark, d):
    w = detect.rolling_words(_tokens(spark, d))
    return w.select("doc_id", "pos", F.array_join("words", "\x1f").alias("words"))


def language_priors(spark, d):
    return detect.uniform_priors(_stopwords(spark, d))


def lang_scores(spark, d):
    s = detect.score_windows(_tokens(spark, d), _stopwords(spark, d), _dictionary(spark, d), LANGS, DETECTOR)
    return s.select("doc_id", "pos", *[F.round(f"{k}_{l}", 6).alias(f"{k}_{l}") for k in "pc" for l in LANGS])


def lang_switch_strong(spark, d):
    s = detect.detect_strong(_tokens(spark, d).where("not pending"), _stopwords(spark, d), _dictionary(spark, d), LANGS, "en", DetectorConfig(confidence_threshold=0.87))
    return s.select("doc_id", "pos", "language", F.round("confidence", 6).alias("confidence"))


def lang_switch_full(spark, d):
    s = detect.detect(_tokens(spark, d).where("not pending"), _stopwords(spark, d), _dictionary(spark, d), LANGS, "en", DETECTOR)
    return s.select("doc_id", "pos", "language", F.round("confidence", 6).alias("confidence"))


# ----------------------------------------------------------------- pipelines
def _results(spark, d, mode="propagate_next"):
    return pipeline.process_texts(_documents(spark, d), _resources(spark, d), "en", config=Config(pipeline=PipelineConfig(language_mode=mode)))


def pipeline_results(spark, d):
    found = F.col("detected_language")
    return _results(spark, d).select("doc_id", "pos", "original", "corrected", "source", found["code"].alias("detected"), F.round(found["confidence"], 6).alias("confidence"))


def pipeline_events(spark, d):
    return pipeline.pipeline_events(_results(spark, d, "fixed")).withColumn("confidence", F.round("confidence", 6))


def pipeline_json(spark, d):
    return _results(spark, d).select("doc_id", "pos", pipeline.result_json().alias("result"))


# ---------------------------------------------------------------- keystrokes
def _events(spark, d):
    return read_table(spark, d, "key_events")


def typed_tokens(spark, d):
    return keystrokes.typed_tokens(_events(spark, d)).drop("token_no")


def web_results(spark, d):
    """Results as JSON where a pending last word takes its first suggestion."""
    r = pipeline.process_texts(_documents(spark, d), _resources(spark, d), "en", remainder="suggest")
    return r.select("doc_id", "pos", pipeline.result_json().alias("result"))


def _typing(spark, d):
    """Key events of the words of token_result typed into their documents, in a new window after every five words."""
    t = read_table(spark, d, "token_result").where("original is not null and doc_id is not null and pos is not null").select("doc_id", "pos", "original").distinct()
    e = t.select("doc_id", "pos", F.posexplode(F.split(F.concat("original", F.lit(" ")), "")).alias("i", "ch")).where("ch <> ''")
    order = F.col("pos").cast("long") * 100_000 + F.col("i")
    return e.select("doc_id", order.alias("seq"), (F.expr("pos div 5") + 1).alias("window"), F.lit("Char").alias("kind"), "ch", F.lit(None).cast("string").alias("key"))


def edit_script(spark, d):
    tokens = keystrokes.typed_tokens(_typing(spark, d), "doc_id", window="window")
    return keystrokes.edit_script(tokens, _resources(spark, d), "en", "doc_id").drop("token_no")


def _shared_devices(spark, d):
    """Key events as of devices that hold many windows each, in order of arrival."""
    return _events(spark, d).where("window_id is not null").withColumn("device", F.pmod("window_id", F.lit(97)))


def typed_focus(spark, d):
    """Typed tokens where moving to another window empties a device's buffer."""
    t = keystrokes.typed_tokens(_shared_devices(spark, d), "device", "event_id", window="window_id")
    return t.select("device", "token", "last_order", "delimiter", "applied")


def focus_sessions(spark, d):
    e = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return keystrokes.focus_sessions(e, "user_id", "event_type", "ts", "event_id").select("event_id", "user_id", "session")


def _stream(spark, d, res, device="window_id", order="seq"):
    schema = _events(spark, d).schema
    folder = working_folder(spark)
    events = spark.readStream.schema(schema).parquet(f"{d}/key_events.parquet*").where("window_id is not null").withColumn("device", F.pmod("window_id", F.lit(97)))
    tokens = streaming.stream_tokens(events, device, res, "en", order)
    q = tokens.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumnsRenamed({"device": device, "ord": "last_order"})


def stream_focus(spark, d):
    """``typed_focus`` by the stateful streaming operator."""
    return _stream(spark, d, None, "device", "event_id").select("device", "token", "last_order", "delimiter", "applied")


def stream_tokens(spark, d):
    """The typed tokens once more, by the stateful streaming operator over the same files."""
    return _stream(spark, d, None).select("window_id", "last_order", "token", "delimiter", "applied")


def stream_languages(spark, d):
    """The streamed tokens with the language each is to be corrected in, and what is detected at it."""
    return _stream(spark, d, _resources(spark, d)).select("window_id", "last_order", "token", "delimiter", "applied", "lang", "detected", "confidence")


# ---------------------------------------------------------------- problem 6
def _orphans(spark, d):
    errors = read_table(spark, d, "errors").where("lang = 'en'").select("error_id", "correction", "learned_at")
    words = read_table(spark, d, "dictionary").where("lang = 'en'").select("word", "added_at", "deleted_at")
    return orphan_references(errors, words, "error_id", fold_key(F.col("correction")), "learned_at", fold_key(F.col("word")), "added_at", "deleted_at")


def p6_found(spark, d):
    return _orphans(spark, d).select(F.col("child_id").alias("error_id"), "status")


def p6_counts(spark, d):
    return orphan_report(_orphans(spark, d), "errors").select("table_name", F.date_format("period", "yyyy-MM").alias("month"), "status", "references", "keys")


def p6_missing_keys(spark, d):
    errors = read_table(spark, d, "errors").where("lang = 'en'").select(fold_key(F.col("correction")).alias("k"))
    words = read_table(spark, d, "dictionary").where("lang = 'en'").select(fold_key(F.col("word")).alias("k"))
    return orphan_keys(errors, words, "k", "k")


QUERIES = {
    f.__name__: f
    for f in (
        token_explode, token_class_counts, empty_token_rate, paste_tokens, buffer_events, word_pieces, delimiter_classify, last_characters,
        accent_codec, case_restore, edge_trim, locale_resolve, damerau_pairs, keyboard_pairs, overlap_pairs,
        vocab_freq, dict_build, dictionary_stats, top_stopwords, stopword_weights, error_map, all_typos, static_map, map_statistics, learned_map,
        exact_lookup, oov_words, valid_words, typo_lookup, known_typos, stopword_hits,
        fuzzy_candidates, fuzzy_topk, suggestions, correct_words, static_corrections, correct_text,
        rolling_window_words, language_priors, lang_scores, lang_switch_strong, lang_switch_full,
        pipeline_results, pipeline_events, pipeline_json, web_results,
        typed_tokens, typed_focus, edit_script, focus_sessions, stream_tokens, stream_focus, stream_languages,
        p6_found, p6_counts, p6_missing_keys,
    )
} | resource_queries.QUERIES

SQL = core_sql.SQL | core_sql_correction.SQL | resource_queries.SQL
