"""Fuzzy dictionary search: an edit-distance similarity join, reranked, top k.

Candidates within plain Levenshtein distance 2 come from equi-joins only.
Words up to ``SHORT`` characters meet over their deletion neighbourhood (two
words within two edits share a string that each reaches by at most two
deletions).  Longer words meet over thirds: of three pieces of the dictionary
word one is untouched by two edits and stands in the query word at most two
places off.  Both are complete; built-in ``levenshtein`` with a threshold
verifies, and only survivors reach the Arrow UDF of the weighted distance.
Larger distances are searched over more pieces in the same way.

A weighted distance of one edit is less than plain distance 2: one edit, one
swap of neighbours, or two letters replaced by neighbouring keys.  These meet
over single deletions and over words spelt in groups of neighbouring keys,
about a quarter of the keys.

Every word gives many keys, which size estimates do not know of (they take an
explode for one row), so these joins always sort and merge: a side that looks
small enough to broadcast may not fit the driver.  The dictionary is merged as
well: just below the broadcast threshold its hash table takes ten times its
file in the driver, and a query joins it several times at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions.chars import encode_accents
from glyphloom.functions.distance import keyboard_distance_col, overlap_ok_col

#: Longest word whose deletion neighbourhood is formed.
SHORT = 24
#: Keyboard columns.  Neighbouring keys stand in one column or in two next to each other.
COLUMNS = ["qaz", "wsx", "edc", "rfv", "tgb", "yhn", "ujm", "ik", "ol", "p"]


def explode_deletions(words: DataFrame, word: str, out: str) -> DataFrame:
    """``words`` once for every string that ``word`` reaches by at most two deletions, itself included.

    Positions are exploded, not arrays of strings, so all of it is generated
    code.  A string that is reached in two ways comes twice.
    """
    w, n = F.col(word), F.length(word)
    one = words.withColumn("_i", F.explode(F.sequence(F.lit(0), n)))  # 0: no deletion
    two = one.withColumn("_j", F.explode(F.sequence(F.when(F.col("_i") == 0, 0).otherwise(F.col("_i") + 1), F.when(F.col("_i") < n, n).otherwise(F.col("_i") + 1))))
    two = two.where((F.col("_j") <= n))
    i, j = F.col("_i"), F.col("_j")
    cut = F.when(j == 0, w).when(i == 0, F.concat(w.substr(F.lit(1), j - 1), w.substr(j + 1, n))).otherwise(
        F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, j - i - 1), w.substr(j + 1, n))
    )
    return two.withColumn(out, cut).drop("_i", "_j")


def _meet(q: DataFrame, d: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of words that share a key, without a broadcast."""
    return q.hint("merge").join(d.hint("merge"), keys).select("lang", "word_q", "word_enc")


def _by_deletions(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    v = lambda df, enc: explode_deletions(df, enc, "v").select("lang", enc, F.xxhash64("lang", "v").alias("v"))
    q = v(words.where(F.length("word_q") <= SHORT).select("lang", "word_q"), "word_q")
    d = v(dictionary.where(F.length("word_enc") <= SHORT + 2).select("lang", "word_enc"), "word_enc")
    return _meet(q, d, ["lang", "v"])


def _by_thirds(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    q = words.where(F.length("word_q") > SHORT).select("lang", "word_q", F.length("word_q").alias("n"))
    d = dictionary.where(F.length("word_enc") > SHORT - 2).select("lang", "word_enc", F.length("word_enc").alias("m"))
    cuts = lambda m: [F.lit(0), F.floor(m / 3).cast("int"), F.floor(2 * m / 3).cast("int"), m]
    c = cuts(F.col("m"))
    d = d.select("lang", "word_enc", "m", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("word_enc").substr(c[k] + 1, c[k + 1] - c[k]).alias("piece")) for k in range(3)])).alias("p"))
    d = d.select("lang", "word_enc", "m", "p.*")
    q = q.select("lang", "word_q", F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2)).alias("m"))
    c = cuts(F.col("m"))
    spots = F.array(*[F.struct(F.lit(k).alias("k"), (c[k] + 1 + F.lit(s)).alias("at"), (c[k + 1] - c[k]).alias("len")) for k in range(3) for s in range(-2, 3)])
    q = q.select("lang", "word_q", "m", F.explode(F.filter(spots, lambda x: x["at"] >= 1)).alias("p"))
    q = q.select("lang", "word_q", "m", "p.k", F.col("word_q").substr(F.col("p.at"), F.col("p.len")).alias("piece"))
    return _meet(q, d, ["lang", "m", "k", "piece"])


def _by_pieces(words: DataFrame, dictionary: DataFrame, threshold: int) -> DataFrame:
    """Candidates for any threshold: of ``threshold + 1`` pieces of the dictionary word one is untouched.

    A piece that stands s places off, in words whose lengths differ by l, takes
    at least |s| edits before it and |l - s| behind it, so only few places are
    tried.  Words shorter than the number of pieces have empty ones, which meet
    every word of a fitting length: such words are few.
    """
    k = threshold + 1
    cut = lambda m, i: F.floor(m * i / k).cast("int")
    pieces = F.array(*[F.struct(F.lit(i).alias("k"), F.col("word_enc").substr(cut(F.col("m"), i) + 1, cut(F.col("m"), i + 1) - cut(F.col("m"), i)).alias("piece")) for i in range(k)])
    d = dictionary.select("lang", "word_enc", F.length("word_enc").alias("m")).select("lang", "word_enc", "m", F.inline(pieces))
    q = words.select("lang", "word_q", F.length("word_q").alias("n"), F.explode(F.sequence(F.length("word_q") - threshold, F.length("word_q") + threshold)).alias("m")).where("m >= 0")
    m, off = F.col("m"), F.col("n") - F.col("m")
    places = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(s).alias("s"), (cut(m, i) + 1 + F.lit(s)).alias("at"), (cut(m, i + 1) - cut(m, i)).alias("len")) for i in range(k) for s in range(-threshold, threshold + 1)])
    q = q.select("lang", "word_q", "m", F.explode(F.filter(places, lambda x: (x["at"] >= 1) & (F.abs(x["s"]) + F.abs(off - x["s"]) <= threshold))).alias("p"))
    q = q.select("lang", "word_q", "m", "p.k", F.col("word_q").substr(F.col("p.at"), F.col("p.len")).alias("piece"))
    return _meet(q, d, ["lang", "m", "k", "piece"])


def candidates(words: DataFrame, dictionary: DataFrame, threshold: int = 2) -> DataFrame:
    """(lang, word_q, word_enc) with Levenshtein distance at most ``threshold``.

    ``words``: (lang, word_q) distinct, accents encoded.
    """
    d = dictionary.select("lang", "word_enc").distinct()
    pairs = _by_deletions(words, d).unionByName(_by_thirds(words, d)) if threshold <= 2 else _by_pieces(words, d, threshold)
    near = (F.abs(F.length("word_q") - F.length("word_enc")) <= threshold) & (F.levenshtein("word_q", "word_enc", threshold) >= 0)
    return pairs.where(near).distinct()


def candidates_by_length(words: DataFrame, dictionary: DataFrame, threshold: int = 2) -> DataFrame:
    """The same pairs by joining on neighbouring lengths: for small inputs and tests."""
    d = dictionary.select("lang", "word_enc", F.length("word_enc").alias("m")).distinct()
    q = words.select("lang", "word_q", F.explode(F.sequence(F.length("word_q") - threshold, F.length("word_q") + threshold)).alias("m"))
    return q.join(d, ["lang", "m"]).where(F.levenshtein("word_q", "word_enc", threshold) >= 0).select("lang", "word_q", "word_enc")


def _grouped(c: Column, shift: int) -> Column:
    """Letters as groups of two keyboard columns; of the two shifts one has any two neighbouring keys in one group."""
    group = {x: str((i + shift) // 2) for i, keys in enumerate(COLUMNS) for x in keys}
    letters = "".join(group)
    return F.translate(c, letters + letters.upper(), "".join(group.values()) * 2)


def _by_one_edit(words: DataFrame, word: str) -> DataFrame:
    """(lang, word, v): words at most one deletion each apart share a ``v``."""
    n, j = F.length(word), F.col("_j")
    one = words.select("lang", word, F.explode(F.sequence(F.lit(0), n)).alias("_j"))
    v = F.when(j == 0, F.col(word)).otherwise(F.concat(F.col(word).substr(F.lit(1), j - 1), F.col(word).substr(j + 1, n)))
    return one.select("lang", word, F.xxhash64("lang", v).alias("v"))


def _by_near_keys(words: DataFrame, word: str) -> DataFrame:
    """(lang, word, v): words that differ in two letters, each replaced by a neighbouring key, share a ``v``.

    Either one grouping has both letters' keys together, or each has its own;
    then some bit tells the two places apart, and one grouping is taken where
    it is 0 and the other where it is 1.
    """
    n, b = F.length(word), F.col("_b")
    bits = F.length(F.bin(n.cast("long") - 1))
    # -1: one grouping for the whole word
    w = words.where(n > 1).select("lang", word, F.explode(F.sequence(F.lit(-1), bits - 1)).alias("_b"))
    w = w.select("lang", word, "_b", *[_grouped(F.col(word), s).alias(f"_g{s}") for s in (0, 1)])
    # of the characters where the bit is 0 and where it is 1, in each grouping
    pick = lambda g, bit: F.array_join(F.filter(F.split(F.col(g), ""), lambda x, i: (x != "") & (F.call_function("getbit", i, b) == bit)), "")
    key = lambda at0, at1: F.xxhash64("lang", n, b, F.lit(at0), F.when(b < 0, F.col(f"_g{at0}")).otherwise(F.concat_ws("\x1f", pick(f"_g{at0}", 0), pick(f"_g{at1}", 1))))
    return w.select("lang", word, F.explode(F.array(key(0, 1), key(1, 0))).alias("v"))


def close_pairs(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(lang, word, candidate): all pairs of weighted distance at most one edit, and others, within plain distance 2.

    ``words``: (lang, word); ``dictionary``: (lang, candidate).
    """
    keys = lambda df, w: _by_one_edit(df, w).unionByName(_by_near_keys(df, w))
    near = (F.abs(F.length("word") - F.length("candidate")) <= 1) & (F.levenshtein("word", "candidate", 2) >= 0)
    return keys(words, "word").hint("merge").join(keys(dictionary, "candidate").hint("merge"), ["lang", "v"]).where(near).select("lang", "word", "candidate").distinct()


def find_similar(words: DataFrame, dictionary: DataFrame, max_distance: int = 1, k: int = 3) -> DataFrame:
    """(lang, word, rank, candidate, distance, frequency): the ``k`` nearest dictionary words.

    ``words``: (lang, word) distinct.  Distance is keyboard-weighted (times
    ten), at most ``10 * max_distance``; candidates share 60 % of characters.
    Order: distance, frequency descending, stored word.  ``k`` = 0: all.
    """
    q = words.select("lang", "word", encode_accents(F.col("word")).alias("word_q")).where("lang is not null and word is not null")
    d = dictionary.select("lang", "word", "word_enc", "freq")
    named_d = d.select("lang", "word_enc", F.col("word").alias("candidate"), F.col("freq").alias("frequency"))
    if max_distance <= 1:
        pairs = close_pairs(q.select("lang", "word"), named_d.select("lang", "candidate").distinct())
        named = pairs.join(named_d.hint("merge"), ["lang", "candidate"]).where(F.levenshtein(encode_accents(F.col("word")), "word_enc", 2) >= 0)
    else:
        pairs = candidates(q.select("lang", "word_q").distinct(), d, max_distance)
        named = pairs.join(q.hint("merge"), ["lang", "word_q"]).join(named_d.hint("merge"), ["lang", "word_enc"])
    named = named.where(overlap_ok_col(F.col("word"), F.col("candidate")))
    scored = named.withColumn("distance", keyboard_distance_col(F.col("word"), F.col("candidate"), max_distance)).where(F.col("distance") <= 10 * max_distance)
    rank = F.row_number().over(Window.partitionBy("lang", "word").orderBy("distance", F.col("frequency").desc(), "word_enc"))
    out = scored.withColumn("rank", rank)
    return (out.where(F.col("rank") <= k) if k > 0 else out).select("lang", "word", "rank", "candidate", "distance", "frequency")
