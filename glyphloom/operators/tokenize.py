"""Tokenizers: the stream's (delimiters) and the text corrector's (word runs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.chars import DELIMITER, SEPARATOR_RUN, WORD_RUN, bounded_token, classify_delimiter


def _cut(text: Column) -> Column:
    """ARRAY<STRUCT<token, pending>>: every piece, without an empty last one.

    One expression per text (the split is bound to a lambda variable), so the
    text is cut once and not once per token.
    """
    piece = lambda x, pending: F.struct(x.alias("token"), F.lit(pending).alias("pending"))

    def of(cut: Column) -> Column:
        ended = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda x: piece(x, False))
        rest = F.element_at(cut, -1)
        return F.concat(ended, F.filter(F.array(piece(rest, True)), lambda x: x["token"] != ""))

    return F.flatten(F.transform(F.array(F.split(text, DELIMITER, -1)), of))


def pieces(text: Column) -> Column:
    """Text cut at every delimiter; a final empty piece (nothing pending) is dropped."""
    return F.transform(_cut(text), lambda x: x["token"])


def tokenize(docs: DataFrame, id_col: str, text: str, limit: int | None = 64, keep_empty: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(id, kept columns, pos, token, pending): one row per token, in order from 0.

    Two delimiters in a row give an empty token unless ``keep_empty`` is off.
    ``pending`` marks what is left after the last delimiter.  No shuffle.
    """
    t = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), *keep, F.posexplode(_cut(F.col(text))).alias("pos", "t"))
    t = t.select("doc_id", *keep, "pos", "t.token", "t.pending")
    if not keep_empty:
        t = t.where("token <> ''")
    return t.withColumn("token", bounded_token(F.col("token"), limit)) if limit else t


def tokenize_in_segments(docs: DataFrame, id_col: str, text: str, changes: str, initial: str, fixed: bool, limit: int = 64) -> DataFrame:
    """``tokenize`` plus ``lang`` and ``detected_language``, by the changes of language that each row carries.

    ``changes``: ARRAY<STRUCT<pos, code, confidence>> in order of pos, or null.
    A change at a token is that token's detection and counts from the next one
    on (never if ``fixed``).  Tokens are cut segment by segment, so nothing is
    looked up per token and nothing is shuffled.
    """
    none = F.lit(None).cast("struct<code:string,confidence:double>")
    start = F.col("_start")
    at = F.coalesce(F.col(changes), F.array().cast("array<struct<pos:int,code:string,confidence:double>>"))
    begun = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit(initial).alias("code"), F.lit(None).cast("double").alias("confidence"))), at)
    d = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), begun.alias("_at"), _cut(F.col(text)).alias("_cut"))
    end = lambda i: F.coalesce(F.get(F.col("_at"), i + 1)["pos"] + 1, F.size("_cut"))
    segment = lambda x, i: F.struct(
        (x["pos"] + 1).alias("_start"), (F.lit(initial) if fixed else x["code"]).alias("lang"), F.get(F.col("_at"), i + 1).alias("_next"), F.slice("_cut", x["pos"] + 2, F.greatest(end(i) - x["pos"] - 1, F.lit(0))).alias("_tokens")
    )
    t = d.select("doc_id", F.inline(F.transform("_at", segment))).select("doc_id", "lang", "_start", "_next", F.posexplode("_tokens").alias("_i", "t"))
    pos = start + F.col("_i")
    found = F.when(pos == F.col("_next.pos"), F.struct(F.col("_next.code").alias("code"), F.col("_next.confidence").alias("confidence"))).otherwise(none)
    return t.select("doc_id", pos.alias("pos"), bounded_token(F.col("t.token"), limit).alias("token"), F.col("t.pending").alias("pending"), "lang", found.alias("detected_language"))


def paste_tokens(text: Column) -> Column:
    """All non-empty tokens of a pasted text, the remainder included."""
    return F.filter(F.split(text, DELIMITER, -1), lambda x: x != "")


def delimiter_counts(docs: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Delimiters per class: one row per ``by`` group; counted inside each row, then summed."""
    chars = F.filter(F.split(F.col(text), ""), lambda c: c.rlike(f"^{DELIMITER}$"))
    named = F.transform(chars, classify_delimiter)
    count = lambda k: F.sum(F.size(F.filter(named, lambda x: x == k))).alias(k.lower())
    return docs.where(F.col(text).isNotNull()).groupBy(*by).agg(*[count(k) for k in ("Space", "Enter", "Tab", "Punctuation")])


def word_pieces(text: Column) -> Column:
    """Alternating runs of word characters and separators; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(f"({WORD_RUN}|{SEPARATOR_RUN})"), 1)


def explode_pieces(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pos, piece, is_word) of ``word_pieces``."""
    p = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(word_pieces(F.col(text))).alias("pos", "piece"))
    return p.withColumn("is_word", F.col("piece").rlike(f"^{WORD_RUN}$"))


def buffer_events(docs: DataFrame, id_col: str, text: str, limit: int = 64) -> DataFrame:
    """What the bounded buffer reports: (id, pos, event, token, discarded).

    TokenExtracted at every delimiter; BufferTruncated where a token lost
    characters; BufferCleared for what is pending at the end.
    """
    raw = tokenize(docs, id_col, text, None)
    held = bounded_token(F.col("token"), limit)
    over = F.length("token") > limit
    e = F.explode(
        F.filter(
            F.array(
                F.when(over, F.struct(F.lit(0).alias("k"), F.lit("BufferTruncated").alias("event"), held.alias("token"), (F.length("token") - F.length(held)).alias("discarded"))),
                F.struct(F.lit(1).alias("k"), F.when(F.col("pending"), "BufferCleared").otherwise("TokenExtracted").alias("event"), held.alias("token"), F.lit(0).alias("discarded")),
            ),
            lambda x: x.isNotNull(),
        )
    ).alias("e")
    return raw.select("doc_id", "pos", e).select("doc_id", "pos", "e.event", "e.token", "e.discarded")
