"""Delimiters, word characters, accents and letter case as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The delimiters of the stream tokenizer.  Apostrophe and hyphen
# are no delimiters, nor is any punctuation outside ASCII.
WHITESPACE = " \n\r\t"
PUNCTUATION = "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~"

#: Character class of one delimiter, for Java regular expressions.
DELIMITER = r"[ \n\r\t!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~]"
PUNCTUATION_CLASS = r"[!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~]"
#: A run of word characters of the text corrector, and a run of separators.
WORD_RUN = r"[\p{L}\p{N}\p{M}'-]+"
SEPARATOR_RUN = r"[^\p{L}\p{N}\p{M}'-]+"

# Accented letters, their stored form, and their plain letter.
ACCENTED = "áéíóúñüãõçâêôà"
ENCODED = "AEIOUNWBCDFGJL"
STRIPPED = "aeiounuaocaeoa"


def is_delimiter(c: Column) -> Column:
    return c.rlike(f"^{DELIMITER}$")


def is_punctuation(c: Column) -> Column:
    return c.rlike(f"^{PUNCTUATION_CLASS}$")


def classify_delimiter(c: Column) -> Column:
    """Space, Enter, Tab or Punctuation; null for any other character."""
    return F.when(c == " ", "Space").when(c.isin("\n", "\r"), "Enter").when(c == "\t", "Tab").when(is_punctuation(c), "Punctuation")


def is_word_char(c: Column) -> Column:
    """Letters, digits, apostrophe and hyphen: the text corrector's own idea of a word."""
    return c.rlike(r"^[\p{L}\p{N}\p{M}'-]$")


def encode_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, ENCODED)


def decode_accents(c: Column) -> Column:
    """Inverse of ``encode_accents``; upper-case letters of the code become accented."""
    return F.translate(c, ENCODED, ACCENTED)


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, STRIPPED)


def titlecase(c: Column) -> Column:
    """First character upper case, the rest unchanged."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def preserve_case(original: Column, corrected: Column) -> Column:
    """Upper first and lower rest if the original starts upper; else all lower."""
    rest = F.lower(F.substring(corrected, 2, 1 << 30))
    return F.when(original.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(corrected, 1, 1)), rest)).otherwise(F.lower(corrected))


def is_all_upper(c: Column) -> Column:
    """Every character is an upper-case letter (false for digits, hyphens, empty)."""
    return c.rlike(r"^\p{Lu}+$")


def edge_parts(c: Column) -> Column:
    """STRUCT<prefix, core, suffix>: hyphens and apostrophes trimmed from both ends.

    A word of nothing else has an empty core.
    """
    prefix = F.regexp_extract(c, "^[-']*", 0)
    left = F.substring(c, F.length(prefix) + 1, F.length(c))
    suffix = F.regexp_extract(left, "(?<![-'])[-']+$", 0)
    return F.struct(prefix.alias("prefix"), F.substring(left, F.lit(1), F.length(left) - F.length(suffix)).alias("core"), suffix.alias("suffix"))


def last_chars(c: Column, n: int) -> Column:
    """The last ``n`` code points."""
    return F.substring(c, -n, n) if n > 0 else F.lit("")


def bounded_token(token: Column, limit: int = 64) -> Column:
    """What the bounded buffer holds after a token's characters came one by one.

    At the bound a further character is dropped and the oldest one leaves, so
    beyond it only every second character gets in.  Closed form for k = n - limit
    excess characters: the first ``limit`` characters, then every second one of
    the rest, less the first ceil(k / 2) of them all.
    """
    chars = F.split(token, "")
    kept = F.filter(chars, lambda _, i: (i < limit) | ((i - limit) % 2 == 1))
    excess = F.length(token) - limit
    short = F.array_join(F.slice(kept, F.expr("1") + F.ceil(excess / 2).cast("int"), F.size(kept)), "")
    return F.when(F.length(token) > limit, short).otherwise(token)
