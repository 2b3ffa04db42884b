"""Duplicates hidden by formatting differences.

Records arrive as text in JSON (any field order, spacing, key spelling) or in a
looser ``name = value`` notation.  Two records are the same when their
canonical forms agree; copies are found by a 128-bit hash of the canonical
form, aggregated with map-side combining.  A third, independent 64-bit hash is
part of the grouping key as a collision check, so two records that collide on
all 128 bits still stay apart; ``collision_report`` compares the canonical
texts themselves.

Defined results
---------------
* A null or broken payload, or one without a word (something other than
  punctuation and white space) and a whole-number frequency, is no record: it
  is in no group and never reported.
* Marks and blanks in a frequency only group digits; leading zeros do not count.
* A key given twice in one record: the first counts.
* Ties: the smallest id is the original; every other id is one copy.
* A null ``part`` (for example language) is a value of its own.
* A row repeated under one id is one more copy.  Rows without an id are left out.
* Very long payloads are handled whole.  Empty tables give empty results.
* Extra columns and clashing names are harmless: only named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.folding import compose_accents
from glyphloom.session import cut_lineage
from glyphloom.skew import attach_by_key

#: Unicode punctuation and white space: what the comparison of words disregards.
IGNORED = r"[\p{P}\p{IsWhite_Space}]+"
#: Anything else, without which a word is empty.
SIGNIFICANT = r"[^\p{P}\p{IsWhite_Space}]"


def canonical_text(c: Column) -> Column:
    """Punctuation and white space taken out of lower-case text; accents stay, however they are written."""
    return F.regexp_replace(compose_accents(c), IGNORED, "")


def canonical_whole(c: Column) -> Column:
    """A whole number's digits; null when anything but digits, marks and blanks is there.

    A sign or grouping mark is a mark; letters make it no number.
    """
    digits = F.regexp_replace(c, r"[^0-9]", "")
    plain = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    return F.when(c.rlike(r"[0-9]") & ~c.rlike(r"[\p{L}]"), plain)


#: Fields that loose notation may name.
FIELDS = ("word", "frequency")


def record_fields(rows: DataFrame, payload: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """``rows`` with a column per field: its value in a JSON object or in loose ``name = value`` notation.

    Keys are compared without regard to letter case and outer white space.
    Loose fields end at a line break, ``;`` or ``|`` that is followed by another
    of ``fields`` (or at the end), so marks inside a value stay in it.
    """
    p = F.col(payload)
    others = "|".join(fields)
    value = lambda entries, name: F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"].alias(name)
    named = lambda e: F.struct(F.lower(F.regexp_replace(e["key"], r"[\p{IsWhite_Space}]+", "")).alias("key"), e["value"].alias("value"))
    # runs of blanks are shortened first, so that no pattern has to try them again and again;
    # repeated groups are avoided, as Java's recurse once per repetition
    short = F.regexp_replace(F.regexp_replace(p, r"[^\S\n]{2,}", " "), r"\n[\n ]+", "\n")
    loose = lambda name: F.regexp_extract(short, rf"(?isu)(?:^|[\n;|])\s*{name}\s*[=:](.*?)(?:$|[\n;|](?=\s*(?:{others})\s*[=:]))", 1)
    loose_entries = F.array(*[F.struct(F.lit(n).alias("key"), F.nullif(loose(n), F.lit("")).alias("value")) for n in fields])
    parsed = F.when(p.rlike(r"^\s*\{"), F.transform(F.map_entries(F.from_json(p, "map<string,string>")), named)).otherwise(loose_entries)
    # a generator, so that filters on the fields do not make Spark parse a payload again
    return rows.select(*rows.columns, F.inline(F.transform(F.array(parsed), lambda entries: F.struct(*[value(entries, n) for n in fields]))))


def canonical_hashes(parts: Sequence[Column]) -> list[Column]:
    """128 bits (two 64-bit hashes) and a 64-bit check of the canonical parts, in order."""
    return [
        F.xxhash64(*parts).alias("h1"),
        F.xxhash64(F.lit("second"), *parts).alias("h2"),
        F.xxhash64(F.lit("check"), *parts, F.length(F.concat_ws("\x1f", *parts))).alias("h3"),
    ]


def canonical_records(raw: DataFrame, id_col: str, payload: str, part: str, with_text: bool = False) -> DataFrame:
    """(id, h1, h2, h3) of the rows that are records, and their canonical text if wanted."""
    rows = raw.where(F.col(payload).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(part)), F.lit("")).alias("part"), F.col(payload).alias("payload"))
    fields = record_fields(rows, "payload").where(F.col("word").rlike(SIGNIFICANT) & canonical_whole(F.col("frequency")).isNotNull())
    fields = fields.select("id", "part", F.lower("word").alias("word"), "frequency")
    words = fields.select("id", "part", canonical_text(F.col("word")).alias("word"), canonical_whole(F.col("frequency")).alias("frequency"))
    parts = [F.col("part"), F.col("word"), F.col("frequency")]
    return words.select("id", *canonical_hashes(parts), *([F.concat_ws("\x1f", *parts).alias("canonical")] if with_text else []))


def count_copies(records: DataFrame) -> DataFrame:
    """One row per canonical record: smallest id, number of rows.  Combines map-side."""
    return records.groupBy("h1", "h2", "h3").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def collisions(groups: DataFrame) -> DataFrame:
    """128-bit hashes shared by different canonical forms (kept apart by the check)."""
    return groups.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1")


def collision_report(records: DataFrame) -> DataFrame:
    """(records, forms, colliding): rows, distinct canonical forms, and 128-bit hashes that different canonical texts share.

    ``records`` carry their canonical text; per hash only the first and last text are kept.
    """
    per = records.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("canonical").alias("lo"), F.max("canonical").alias("hi"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("forms"), F.count(F.when(F.col("lo") != F.col("hi"), 1)).alias("colliding"))


def copies_of_first(records: DataFrame) -> DataFrame:
    """(first_id, copy_id): each copy beside the smallest id of its record.

    Rows of the heaviest records take the broadcast way of ``attach_by_key``,
    so a record that a third of all rows copy is spread over all tasks.
    """
    records = cut_lineage(records)  # four numbers a row: cheaper to keep than to parse again
    groups = count_copies(records).where("copies > 1")
    found = attach_by_key(records, groups, ["h1", "h2", "h3"], ["first_id"], "copies", ["id"])
    return found.where("first_id is not null and id <> first_id").select("first_id", F.col("id").alias("copy_id"))
