"""Learning from the user: a log of marks folded into an error map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.sources.resources import MAX_ENTRY, MAX_LEARNED


def learned_map(log: DataFrame, lang: str = "lang", typo: str = "typo", correction: str = "correction", at: str = "at", action: str = "action") -> DataFrame:
    """(lang, typo, correction, learned_at) in force after a log of learn, unlearn and clear marks.

    The last mark per language and typo counts, ties by the smaller correction;
    ``unlearn`` removes, ``clear`` removes all that the language had learned
    until then.  Both sides are lower-cased; self-maps and entries above 50
    characters are ignored.
    """
    m = log.select(F.col(lang).alias("lang"), F.lower(F.col(typo)).alias("typo"), F.lower(F.col(correction)).alias("correction"), F.col(at).alias("learned_at"), F.col(action).alias("action"))
    cleared = m.where("action = 'clear'").groupBy("lang").agg(F.max("learned_at").alias("cleared_at"))
    ok = (F.col("action") == "unlearn") | (F.col("correction").isNotNull() & (F.length("typo") <= MAX_ENTRY) & (F.length("correction") <= MAX_ENTRY) & (F.col("typo") != F.col("correction")))
    marks = m.where(F.col("action").isin("learn", "unlearn") & F.col("typo").isNotNull() & ok)
    last = Window.partitionBy("lang", "typo").orderBy(F.col("learned_at").desc_nulls_last(), F.col("action").desc(), "correction")
    final = marks.withColumn("k", F.row_number().over(last)).where("k = 1 and action = 'learn'")
    kept = final.join(F.broadcast(cleared), "lang", "left").where("cleared_at is null or learned_at > cleared_at")  # one row per language
    return kept.select("lang", "typo", "correction", "learned_at")


def most_recent(learned: DataFrame, limit: int = MAX_LEARNED) -> DataFrame:
    """At most ``limit`` entries per language, the latest; ties by typo."""
    w = Window.partitionBy("lang").orderBy(F.col("learned_at").desc_nulls_last(), "typo")
    return learned.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).drop("k")


def all_typos(errors: DataFrame) -> DataFrame:
    """(lang, typo, correction) of a clean map, by correction descending, then typo."""
    return errors.select("lang", "typo", "correction").orderBy("lang", F.col("correction").desc(), "typo")


def map_statistics(errors: DataFrame) -> DataFrame:
    """(lang, static_errors, user_errors): entries of all languages' static maps, and the language's own learned ones."""
    all_static = F.sum("static").over(Window.partitionBy())
    per = errors.groupBy("lang").agg(F.sum(F.when(F.col("source") == "user", 0).otherwise(1)).alias("static"), F.sum(F.when(F.col("source") == "user", 1).otherwise(0)).alias("user_errors"))
    return per.select("lang", all_static.alias("static_errors"), "user_errors")
