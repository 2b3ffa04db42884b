"""Mapping freely entered values to a canonical list.

Values are made distinct and normalised first.  An inverted index of character
bigrams over the list gives the candidates, weighted cosine over the bigrams
(one idf for the whole list) accepts those above their entry's threshold, and
an exact check, which only rejects, follows: what stands for an entry is at
most ``slips`` slips away (unrestricted Damerau distance), or has one letter
repeated, or is the entry's first ``min_prefix`` or more letters closed by a
full stop.  Of several entries the one with the fewest slips is taken if it
leads by ``margin`` slips or by ``lead`` in cosine; else the value is ambiguous.

Nothing is capped, and retrieval and threshold are complete by proof:

* One slip takes at most three bigrams away and adds at most three.  So of any
  ``3 * slips + 1`` bigrams of a value one is in the entry: the rarest ones are
  looked up (the prefix filter), and the value needs no others.
* The same count bounds the cosine that ``slips`` slips can leave from below,
  entry by entry; that bound is the entry's threshold.
* Entries of less than ``3 * slips`` letters, which slips can strip of all
  their bigrams, are met over gapped n-grams: what is left of a word when up to
  ``slips`` letters are taken out.

A list of at most ``MAX_INDEXED`` entries is broadcast.  Longer lists take the
same steps as joins on grams; the results are equal.

Defined results
---------------
* A value written exactly as an entry is ``exact`` and not a mapping.
* Null values, and values without a letter or digit, stand for nothing.
* Repeated values are mapped once; repeated or clashing entries (equal after
  normalising) are a tie, which goes to the smaller id only if they are the
  same text, else it is ``ambiguous``.
* Very long values are compared whole.  An empty list, or a value that shares
  nothing with the list: ``unmatched``.
* Extra columns and clashing names are harmless: only named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.distance import damerau
from glyphloom.functions.folding import fold_word
from glyphloom.session import cut_lineage

#: Entries in a broadcast index: bounds what is broadcast, and a worker's memory.
MAX_INDEXED = 100_000
#: Postings looked at in one go.
CELLS = 2_000_000
#: Bigrams that one slip can take away, or add.
PER_SLIP = 3
#: What rounding may cost a cosine.
EPSILON = 1e-9

_RUN = re.compile(r"(.)\1+")
_RUNS = re.compile(r"(.)\1*")


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct whole numbers in order; by sorting, as numpy's own way hashes them one by one."""
    keys = np.sort(keys, kind="stable")
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two sentinels, and the word each is of."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return codes, np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bigram) of the distinct bigrams of every word, sorted."""
    codes, owner = _codes(words)
    if not len(codes):
        return owner, codes
    inside = owner[:-1] == owner[1:]
    key = _distinct((owner[:-1][inside] << 42) | (codes[:-1][inside] << 21) | codes[1:][inside])
    return key >> 42, key & ((1 << 42) - 1)


def _bags(words: list[str]) -> np.ndarray:
    """Counts of characters by a small hash, cut at 100: half their difference bounds the distance from below."""
    codes, owner = _codes(words)
    return np.minimum(np.bincount(owner * 64 + (codes & 63), minlength=64 * len(words)), 100).astype(np.int8).reshape(len(words), 64)


def variants(word: str, slips: int) -> set[str]:
    """Gapped n-grams: what is left of a word when up to ``slips`` letters are taken out."""
    n = len(word)
    return {"".join(word[i] for i in range(n) if i not in out) for k in range(min(slips, n) + 1) for out in combinations(range(n), k)}


def _signs(words: list[str]) -> np.ndarray:
    """Which characters a word has, by a small hash: one bit each."""
    codes, owner = _codes(words)
    out = np.zeros(len(words), np.uint64)
    if len(codes):  # every word has its sentinels, so every word has a segment
        out[:] = np.bitwise_or.reduceat(np.uint64(1) << (codes.astype(np.uint64) & np.uint64(63)), np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))
    return out


class GramIndex:
    """Inverted index of the entries' bigrams, with idf weights and each entry's threshold."""

    def __init__(self, entries: list[tuple[int, str, str]], slips: int = 2, min_prefix: int = 6):
        """entries: (id, text, normalised text)."""
        self.slips, self.min_prefix = slips, min_prefix
        self.ids = [e[0] for e in entries]
        self.texts = [e[1] for e in entries]
        self.exact = set(self.texts)
        self.words = [e[2] for e in entries]
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        self.bag, self.sign = _bags(self.words), _signs(self.words)
        squeezed = [_RUN.sub(r"\1", w) for w in self.words]
        self.squeezed_id = {w: k for k, w in enumerate(dict.fromkeys(squeezed))}
        self.squeezed = np.array([self.squeezed_id[w] for w in squeezed], dtype=np.int64)
        self.begins: dict[str, list[int]] = {}
        for e, w in enumerate(self.words):
            for k in range(min_prefix, len(w)):
                self.begins.setdefault(w[:k], []).append(e)
        self.short: dict[str, list[int]] = {}
        for k, w in enumerate(self.words):
            if len(w) < PER_SLIP * slips:
                for x in variants(w, slips):
                    self.short.setdefault(x, []).append(k)
        n = len(entries)
        self.owner, gram = _grams(self.words)
        order = np.argsort(gram, kind="stable")
        self.grams, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.post = self.owner[order]
        self.weight = np.log(1 + n / np.maximum(self.count, 1)) ** 2
        self.rare = float(np.log(1 + n)) ** 2  # a gram that no entry has
        self.gram = np.searchsorted(self.grams, gram)
        self.start = np.searchsorted(self.owner, np.arange(n + 1))
        self.norm = np.bincount(self.owner, weights=self.weight[self.gram], minlength=n)
        self.floor = self._floors()

    def _floors(self) -> np.ndarray:
        """The least cosine of a value that stands for the entry."""
        n, own = len(self.words), self.weight[self.gram]
        if not n:
            return np.zeros(0)
        heavy = np.lexsort((-own, self.owner))
        place = np.arange(len(own)) - self.start[self.owner]
        lost = np.bincount(self.owner, weights=np.where(place < PER_SLIP * self.slips, own[heavy], 0), minlength=n)
        left = np.maximum(self.norm - lost, 0)
        floor = left / np.sqrt(self.norm * (left + PER_SLIP * self.slips * self.rare))
        floor = np.minimum(floor, np.sqrt(self.norm / (self.norm + self.rare)))  # one letter repeated
        owner, gram = _grams([w[: self.min_prefix] for w in self.words])
        inside = gram & ((1 << 21) - 1) != 3  # not the end
        begin = np.bincount(owner[inside], weights=self.weight[np.searchsorted(self.grams, gram[inside])], minlength=n)
        closed = begin / np.sqrt(self.norm * (begin + self.rare))
        return np.where(self.length > self.min_prefix, np.minimum(floor, closed), floor) - EPSILON

    def candidates(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(value number, entry number) of all entries that a value may stand for, by postings."""
        m = len(self.words)
        none = np.zeros(0, np.int64)
        if not m or not values:
            return none, none
        owner, at, known = self._look(values)
        size = np.where(known, self.count[at], 0)
        rarest = np.lexsort((size, owner))
        owner, at, size = owner[rarest], at[rarest], size[rarest]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        use = (place <= PER_SLIP * self.slips) & (size > 0)
        owner, at, size = owner[use], at[use], size[use]
        keys = [none]
        ends = np.cumsum(size)
        lo = 0
        while lo < len(owner):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, side="right")))
            s = size[lo:hi]
            spot = np.arange(s.sum()) + np.repeat(self.first[at[lo:hi]] - (np.cumsum(s) - s), s)
            keys.append(_distinct(np.repeat(owner[lo:hi] * m, s) + self.post[spot]))
            lo = hi
        if self.short:
            least = PER_SLIP * self.slips + self.slips
            more = [k * m + e for k, v in enumerate(values) if len(v) < least for x in variants(v, self.slips) for e in self.short.get(x, ())]
            keys.append(np.array(more, dtype=np.int64))
        key = np.concatenate(keys)
        if len(keys) > 2:
            key = _distinct(key)
        return key // m, key % m

    def _look(self, values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the values' bigrams: the value, the place in the index, and whether the index has it."""
        owner, gram = _grams(values)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        return owner, at, self.grams[at] == gram

    def cosines(self, values: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Cosine of value i and entry j of each pair."""
        if not len(i):
            return np.zeros(0)
        owner, at, known = self._look(values)
        norm = np.bincount(owner, weights=np.where(known, self.weight[at], self.rare), minlength=len(values))
        owner, at = owner[known], at[known]
        start = np.searchsorted(owner, np.arange(len(values) + 1))
        width = len(self.grams)

        def of(begin: np.ndarray, end: np.ndarray, what: np.ndarray) -> np.ndarray:
            size = end - begin
            spot = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            return np.repeat(np.arange(len(size)), size) * width + what[spot]

        ours = of(start[i], start[i + 1], at)
        theirs = of(self.start[j], self.start[j + 1], self.gram)
        both = np.sort(np.concatenate([ours, theirs]), kind="stable")
        both = both[:-1][both[:-1] == both[1:]]
        dot = np.bincount(both // width, weights=self.weight[both % width], minlength=len(i))
        return dot / np.sqrt(np.maximum(self.norm[j] * norm[i], 1e-300))


def _one_letter_repeated(value: str, word: str) -> bool:
    """``value`` is ``word`` with one of its letter runs made longer."""
    if value[:1] != word[:1] or len(value) <= len(word):
        return False
    a = [m.group() for m in _RUNS.finditer(value)]
    b = [m.group() for m in _RUNS.finditer(word)]
    if len(a) != len(b):
        return False
    longer = 0
    for x, y in zip(a, b):
        if x[0] != y[0] or len(x) < len(y):
            return False
        longer += len(x) > len(y)
    return longer == 1


def _closed(raw: str, folded: str, min_prefix: int) -> bool:
    return len(folded) >= min_prefix and raw.rstrip().endswith(".")


def exact_slips(raw: str, folded: str, word: str, slips: int, min_prefix: int) -> int | None:
    """The exact check: how many slips make ``word`` this value; null if it does not stand for it."""
    d = damerau(folded, word, slips)
    if d <= slips:
        return d
    if _one_letter_repeated(folded, word) or (len(folded) < len(word) and _closed(raw, folded, min_prefix) and word.startswith(folded)):
        return 1
    return None


def look_up(index: GramIndex, raw: list[str], folded: list[str]) -> list[tuple]:
    """(value, id, text, slips, cosine) of every entry that a value stands for."""
    slips, min_prefix = index.slips, index.min_prefix
    i, j = index.candidates(folded)
    if not len(i):
        return []
    # pairs that the exact check would reject anyhow, in whole arrays
    m = len(index.words)
    length, sign = np.array([len(v) for v in folded]), _signs(folded)
    squeezed = np.array([index.squeezed_id.get(_RUN.sub(r"\1", v), -1) for v in folded])
    closed = np.array([k * m + e for k, (r, f) in enumerate(zip(raw, folded)) if _closed(r, f, min_prefix) for e in index.begins.get(f, ())], dtype=np.int64)
    look = (squeezed[i] == index.squeezed[j]) & (length[i] > index.length[j])
    if len(closed):
        look |= np.isin(i * m + j, closed)
    near = np.abs(length[i] - index.length[j]) <= slips
    a, b = sign[i], index.sign[j]
    near &= (np.bitwise_count(a & ~b) <= slips) & (np.bitwise_count(b & ~a) <= slips)
    near = np.flatnonzero(near)
    gap = _bags(folded)[i[near]] - index.bag[j[near]]
    more = gap.sum(1, dtype=np.int64)
    apart = np.abs(gap).sum(1, dtype=np.int64)
    look[near[(apart + np.abs(more)) // 2 <= slips]] = True  # the larger of what is too much and what is missing
    i, j = i[look], j[look]
    cos = index.cosines(folded, i, j)
    good = cos >= index.floor[j]
    out = []
    for a, b, c in zip(i[good].tolist(), j[good].tolist(), cos[good].tolist()):
        d = exact_slips(raw[a], folded[a], index.words[b], slips, min_prefix)
        if d is not None:
            out.append((raw[a], index.ids[b], index.texts[b], d, c))
    return out


_HITS = "value string, ref_id long, ref string, slips int, cosine double"
_COLUMNS = ["value", "ref_id", "ref", "slips", "cosine"]


def _bigrams(word: Column) -> Column:
    """Distinct bigrams of a word between its two sentinels."""
    w = F.concat(F.lit("\x02"), word, F.lit("\x03"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda k: F.substr(w, k, F.lit(2))))


def _hits_by_joins(asked: DataFrame, entries: DataFrame, size: int, slips: int, min_prefix: int) -> DataFrame:
    """The index as a table: grams of values and entries meet in equi-joins."""
    most = PER_SLIP * slips
    rare = F.pow(F.log(F.lit(1.0) + F.lit(size)), F.lit(2.0))
    posts = cut_lineage(entries.select("ref", F.explode(_bigrams(F.col("word"))).alias("gram")))
    grams = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).withColumn("u", F.pow(F.log(F.lit(1.0) + F.lit(size) / F.col("c")), F.lit(2.0)))
    begins = F.transform(F.sequence(F.lit(0), F.lit(min_prefix - 1)), lambda k: F.substr(F.concat(F.lit("\x02"), F.col("word")), k + 1, F.lit(2)))
    e = posts.join(grams, "gram").groupBy("ref").agg(F.map_from_entries(F.collect_list(F.struct("gram", "u"))).alias("us"), F.sum("u").alias("norm"), F.sort_array(F.collect_list("u"), asc=False).alias("heavy"))
    e = e.join(entries, "ref").withColumn("begin", F.array_distinct(begins))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    left = F.greatest(F.col("norm") - total(F.slice("heavy", 1, most)), F.lit(0.0))
    begun = total(F.transform("begin", lambda g: F.coalesce(F.try_element_at("us", g), F.lit(0.0))))
    floor = F.least(left / F.sqrt(F.col("norm") * (left + most * rare)), F.sqrt(F.col("norm") / (F.col("norm") + rare)))
    floor = F.when(F.length("word") > min_prefix, F.least(floor, begun / F.sqrt(F.col("norm") * (begun + rare)))).otherwise(floor) - EPSILON
    e = e.select("ref", "ref_id", "word", "us", F.col("norm").alias("e_norm"), floor.alias("floor"))
    v = asked.select("value", "folded", F.explode(_bigrams(F.col("folded"))).alias("gram")).join(grams, "gram", "left")
    v = v.groupBy("value", "folded").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram"))).alias("gs"), F.sum(F.coalesce("u", rare)).alias("v_norm"))
    v = cut_lineage(v)
    probe = v.select("value", F.explode(F.slice("gs", 1, most + 1)).alias("g")).where("g.c > 0").select("value", "g.gram")
    found = probe.join(posts, "gram").select("value", "ref")

    @F.pandas_udf("array<string>")
    def gapped(s: pd.Series) -> pd.Series:
        return pd.Series([sorted(variants(w, slips)) for w in s], dtype=object)

    tiny = lambda df, key, word, below: df.where(F.length(word) < below).select(key, F.explode(gapped(F.col(word))).alias("x"))
    short = tiny(asked, "value", "folded", most + slips).join(tiny(entries, "ref", "word", most), "x").select("value", "ref")
    pairs = found.unionByName(short).distinct().join(v, "value").join(e, "ref")
    shared = total(F.transform("gs", lambda g: F.coalesce(F.try_element_at("us", g["gram"]), F.lit(0.0))))
    pairs = pairs.withColumn("cosine", shared / F.sqrt(F.col("v_norm") * F.col("e_norm"))).where("cosine >= floor")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = [exact_slips(r, f, w, slips, min_prefix) for r, f, w in zip(pdf["value"], pdf["folded"], pdf["word"])]
            pdf = pdf.assign(slips=pd.Series(d, index=pdf.index, dtype="Int64"))
            yield pdf[pdf["slips"].notna()][_COLUMNS]

    return pairs.select("value", "folded", "ref_id", "ref", "word", "cosine").mapInPandas(check, _HITS)


def map_values(
    values: DataFrame,
    value: str,
    refs: DataFrame,
    ref_id: str,
    ref: str,
    slips: int = 2,
    min_prefix: int = 6,
    margin: int = 1,
    lead: float = 0.3,
) -> DataFrame:
    """One row per distinct value: (value, uses, ref_id, ref, slips, cosine, status).

    ``status``: exact, mapped, ambiguous or unmatched.
    """
    spark = values.sparkSession
    v = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("uses")).withColumn("folded", fold_word(F.col("value")))
    e = refs.where(F.col(ref).isNotNull() & F.col(ref_id).isNotNull()).groupBy(F.col(ref).alias("ref")).agg(F.min(F.col(ref_id).cast("long")).alias("ref_id"))
    e = e.withColumn("word", fold_word(F.col("ref"))).where("word <> ''")
    size = e.count()
    asked = v.where("folded <> ''").select("value", "folded")
    if size <= MAX_INDEXED:
        shared = spark.sparkContext.broadcast([(r["ref_id"], r["ref"], r["word"]) for r in e.collect()])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = GramIndex(shared.value, slips, min_prefix)
            for pdf in batches:
                pdf = pdf[~pdf["value"].isin(index.exact)]
                yield pd.DataFrame(look_up(index, pdf["value"].tolist(), pdf["folded"].tolist()), columns=_COLUMNS)

        hits = asked.mapInPandas(search, _HITS)
    else:
        known = e.select(F.col("ref").alias("value"))
        hits = _hits_by_joins(asked.join(known, "value", "left_anti"), e, size, slips, min_prefix)
    hits = hits.groupBy("value").agg(F.collect_list(F.struct("slips", (-F.col("cosine")).alias("c"), "ref_id", "ref")).alias("all"))
    best = hits.withColumn("b", F.array_min("all"))
    rivals = F.size(F.filter("all", lambda x: (x["slips"] < F.col("b.slips") + margin) & (x["c"] < F.col("b.c") + lead)))
    best = best.select("value", "b.ref_id", "b.ref", "b.slips", (-F.col("b.c")).alias("cosine"), (rivals > 1).alias("close"))
    known = e.select(F.col("ref").alias("value"), F.col("ref_id").alias("own"))
    out = v.join(best, "value", "left").join(known, "value", "left")
    status = F.when(F.col("own").isNotNull(), "exact").when(F.col("ref_id").isNull(), "unmatched").when(F.col("close"), "ambiguous").otherwise("mapped")
    return out.withColumn("status", status).select("value", "uses", F.coalesce("own", "ref_id").alias("ref_id"), F.when(F.col("own").isNotNull(), F.col("value")).otherwise(F.col("ref")).alias("ref"), "slips", "cosine", "status")
