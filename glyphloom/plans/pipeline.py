"""Batch pipeline: texts in, token results and events out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.config import Config
from glyphloom.operators.correct import correct_tokens, distinct_words, suggestions
from glyphloom.operators.detect import detect, used_words
from glyphloom.operators.tokenize import tokenize, tokenize_in_segments
from glyphloom.session import cut_lineage
from glyphloom.skew import attach_known
from glyphloom.sources.resources import Resources


def process_texts(docs: DataFrame, resources: Resources, initial: str, id_col: str = "doc_id", text: str = "text", config: Config = Config(), remainder: str = "correct") -> DataFrame:
    """Token results (doc_id, pos, original, corrected, source, detected_language).

    Every token ended by a delimiter is detected and corrected; what is pending
    at the end of a text is corrected only.  ``remainder="suggest"`` takes the
    first suggestion for it instead.  Texts do not influence each other.
    """
    p = config.pipeline
    if p.detect_language:
        ended = lambda d: tokenize(d.select(id_col, text), id_col, text, p.max_token_chars).where(~F.col("pending"))
        # texts are moved, not their tokens; the number of parts is given, else they are merged by the size of the texts
        by_doc = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
        found = detect(ended(by_doc), resources.stopwords, resources.dictionary, resources.languages(), initial, config.detector, used_words(ended(docs)))
        change = F.struct("pos", F.col("language").alias("code"), "confidence")
        per_doc = found.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_list(change)).alias("_changes"))
        per_doc = cut_lineage(per_doc)  # few rows, read by several jobs; tokens are cheaper to cut again than to keep
        docs = docs.join(per_doc.hint("merge"), F.col(id_col) == F.col("_doc"), "left")
    else:
        docs = docs.withColumn("_changes", F.lit(None).cast("array<struct<pos:int,code:string,confidence:double>>"))
    located = tokenize_in_segments(docs, id_col, text, "_changes", initial, p.language_mode == "fixed", p.max_token_chars)
    words = distinct_words(located, F.max("pending").alias("pending"), F.sum(F.col("pending").cast("long")).alias("ends"))
    done = correct_tokens(located, resources, config.correction, words=words)
    if remainder == "suggest":
        last = words.where("pending").select("lang", "word", "ends")
        first = suggestions(last, resources, config.correction).where("rank = 1").join(last.hint("merge"), ["lang", "word"])
        first = cut_lineage(first.select("lang", F.col("word").alias("_last"), F.col("candidate").alias("_s"), "ends"))
        done = attach_known(done.withColumn("_last", F.when(F.col("pending"), F.col("token"))), first, ["lang", "_last"], ["_s"], "ends", ["doc_id", "pos"])
        done = done.withColumn("corrected", F.when(F.col("pending"), F.col("_s")).otherwise(F.col("corrected")))
    if not p.auto_correct:
        keep = F.col("pending") if p.strict_remainder else F.lit(False)
        done = done.withColumn("corrected", F.when(keep, F.col("corrected"))).withColumn("source", F.when(keep, F.col("source")).otherwise("None"))
    return done.select("doc_id", "pos", F.col("token").alias("original"), "corrected", "source", "detected_language")


def pipeline_events(results: DataFrame) -> DataFrame:
    """(doc_id, pos, step, event, word, corrected, language, confidence), in order of (pos, step)."""
    none = F.lit(None).cast("string")
    row = lambda step, event, word=none, corrected=none, language=none, confidence=F.lit(None).cast("double"): F.struct(
        F.lit(step).alias("step"), F.lit(event).alias("event"), word.alias("word"), corrected.alias("corrected"), language.alias("language"), confidence.alias("confidence")
    )
    d = F.col("detected_language")
    events = F.array(
        row(0, "WordExtracted", word=F.col("original")),
        F.when(d.isNotNull(), row(1, "LanguageDetected", language=d["code"], confidence=d["confidence"])),
        F.when(F.col("corrected").isNotNull(), row(2, "WordCorrected", word=F.col("original"), corrected=F.col("corrected"))),
    )
    return results.select("doc_id", "pos", F.inline(F.filter(events, lambda e: e.isNotNull())))


def result_json() -> Column:
    """A token result as JSON: original, corrected, detected_language {code, confidence}."""
    return F.to_json(F.struct("original", "corrected", "detected_language"), {"ignoreNullFields": "false"})
