"""Missing or wrong language labels: a language for each text and each passage.

Bit-sliced Bloom filters: one filter per language, stored as bits of the same
byte array, so the hash positions of a character n-gram give at once the mask
of all languages that have the n-gram.  Per sentence and language the hits are
counted, corrected for the filter's false positives, and the best language is
taken if it covers enough of the n-grams and leads the next by enough.
Neighbouring sentences of one language form a passage.

The filters are fitted on a sample of labelled documents of at most
``TRAIN_DOCS`` and ``TRAIN_CHARS`` per language (whole texts, chosen by a hash of
the id); wrong labels in it are outvoted, since an n-gram belongs to a language only if it is
about as frequent there as where it is most frequent.

Defined results
---------------
* Sentences end at ``. ! ?`` (and closing quotes) or an empty line.  Asides in
  brackets (of any length, within a paragraph), stars or dashes, and sentences
  below ``MIN_WORDS`` words, are not full sentences.
* A text without any decided sentence is taken whole, as one passage of 0
  sentences, for the language with most of its n-grams; its confidence is
  lowered by the share of n-grams that the language does not have.
* A text that is null, empty or of no known n-gram has language null.
* Languages and the names of their labels are a parameter, up to 64 languages.
* Ties between languages leave a sentence undecided.
* A text's language is the one with most n-grams in decided sentences (ties:
  alphabetically first); confidence is best / (best + second) of the corrected
  counts, between 0.5 and 1.
* Repeated rows are labelled one by one.  Without any usable label nothing can
  be fitted: every language is null.  Very long texts are handled whole, in
  slices of bounded memory.  Extra columns and clashing names are harmless.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Usual notations of a language label: code, then names.
LABELS = {
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "castilian"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
}
LANGS = list(LABELS)

#: Most labelled documents per language that the filters are fitted on, and their most characters.
TRAIN_DOCS, TRAIN_CHARS = 1500, 30_000_000
#: Length of n-grams, slots of the filters (a power of two), hash functions.
GRAM, SLOTS, HASHES = 4, 1 << 22, 3
#: An n-gram belongs to a language if its rate there is this share of its highest rate.
RATE_SHARE, MIN_COUNT = 0.2, 3
#: A sentence is decided if the best language covers so much of it and leads by so much.
COVER, LEAD, MIN_WORDS = 0.4, 0.08, 5
#: Characters whose n-grams are counted at a time.
SLICE = 500_000

_INSIDE = r"[^{0}\n]*(?:\n(?!\s*\n)[^{0}\n]*)*"
_ASIDE = re.compile(rf"\({_INSIDE.format('()')}\)|\[{_INSIDE.format('[' + chr(92) + ']')}\]|\*[^*\n]+\*|[–—]\s[^–—:\n]+:[^–—\n]*\s[–—]")
_END = re.compile(r"(?<![.!?…])[.!?…]++[»”\"’')\]]*+(?=\s)|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]+")


def label_language(label: Column, labels: dict[str, list[str]] = LABELS) -> Column:
    """The one language that a label names, else null.

    Codes may be followed by a script, a region (``en-GB``, ``es_419``) and up to
    three variants; names stand alone.
    """
    l = F.lower(F.regexp_replace(label, r"^\p{IsWhite_Space}+|(?<!\p{IsWhite_Space})\p{IsWhite_Space}+$", ""))
    variant = r"(?:[-_](?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))?"  # no repeated group: Java's recurse once per repetition
    code = F.regexp_extract(l, rf"^([a-z]{{2,3}})(?:[-_][a-z]{{4}})?(?:[-_](?:[a-z]{{2}}|[0-9]{{3}}))?{variant * 3}$", 1)
    table = lambda short: F.create_map(*[F.lit(x) for lang, names in labels.items() for n in names if (len(n) <= 3) == short for x in (n, lang)])
    return F.coalesce(F.try_element_at(table(True), code), F.try_element_at(table(False), l))


def sentences(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, str]]:
    """(start, end, words in lower case joined by blanks) of the full sentences."""
    clean = text
    if any(c in text for c in "([*–—"):
        clean = _ASIDE.sub(lambda m: " " * len(m.group()), clean)
    broken = "-\n" in clean
    if broken:  # words at line ends
        clean = re.sub(r"(?<=[^\W\d_])-\n(?=[^\W\d_])", "\x00\x00", clean)
    out, at = [], 0
    for end in [*(m.end() for m in _END.finditer(clean)), len(clean)]:
        part = clean[at:end].lower()
        words = _WORD.findall(part.replace("\x00", "") if broken else part)
        if len(words) >= min_words:
            out.append((at, end, " ".join(words)))
        at = end
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all lines (padded with blanks), and the line each is of."""
    codes = np.frombuffer("\n".join(f" {x} " for x in lines).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    breaks = codes == 10
    line = np.cumsum(breaks)[:n]
    h = np.zeros(n, np.uint64)
    bad = np.zeros(n, bool)
    for k in range(GRAM):
        h = h * np.uint64(0x100000001B3) + codes[k : k + n]
        bad |= breaks[k : k + n]
    good = ~bad
    return _mix(h[good]), line[good]


def mask_type(langs: int) -> type:
    """The narrowest whole number with a bit per language."""
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        if langs <= np.iinfo(kind).bits:
            return kind
    raise ValueError("a mask holds at most 64 languages")


class LanguageFilter:
    """Bloom filters of all languages, sliced by bit."""

    def __init__(self, hashes: np.ndarray, masks: np.ndarray, langs: list[str] | None = None):
        self.langs = list(langs or LANGS)
        self.kind = mask_type(len(self.langs))
        masks = masks.astype(self.kind)
        self.slots = np.zeros(SLOTS, self.kind)
        for p in self._places(hashes):
            np.bitwise_or.at(self.slots, p, masks)
        full = [float(np.count_nonzero(self.slots & self.kind(1 << k))) / SLOTS for k in range(len(self.langs))]
        self.false = np.array([f**HASHES for f in full])

    @staticmethod
    def _places(h: np.ndarray) -> list[np.ndarray]:
        a, b = h & np.uint64(SLOTS - 1), (h >> np.uint64(32)) | np.uint64(1)
        return [((a + np.uint64(k) * b) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), np.iinfo(self.kind).max, self.kind)
        for p in self._places(h):
            out &= self.slots[p]
        return out

    def counts(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams per line, and per line and language the hits corrected for false positives."""
        h, line = gram_hashes(lines)
        m = self.masks(h)
        total = np.bincount(line, minlength=len(lines)).astype(float)
        hits = np.stack([np.bincount(line, weights=(m >> self.kind(k)) & self.kind(1), minlength=len(lines)) for k in range(len(self.langs))], axis=1)
        return total, np.maximum(0.0, (hits - total[:, None] * self.false) / (1 - self.false))


def training_sample(docs: DataFrame, id_col: str, text: str, label: str, per_lang: int = TRAIN_DOCS, chars: int = TRAIN_CHARS, labels: dict[str, list[str]] = LABELS) -> DataFrame:
    """(lang, text): at most ``per_lang`` labelled documents of each language, of at most ``chars`` characters in all."""
    named = docs.select(label_language(F.col(label), labels).alias("lang")).where("lang is not null")  # reads no text
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    d = docs.where(F.col(text).isNotNull()).select(label_language(F.col(label), labels).alias("lang"), F.xxhash64(F.col(id_col), F.lit("train")).alias("h"), F.col(text).alias("text")).where("lang is not null")
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.1 * per_lang / n)).otherwise(share)
    thin = d.where((F.col("h").cast("double") / float(1 << 63) + 1) / 2 <= share)  # about the bound, without moving texts
    w = Window.partitionBy("lang").orderBy("h", "text")
    ranked = thin.withColumn("rank", F.row_number().over(w)).withColumn("sum", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("rank") <= per_lang) & (F.col("sum") <= chars)).select("lang", "text")


def fit(docs: DataFrame, id_col: str, text: str, label: str, labels: dict[str, list[str]] = LABELS) -> LanguageFilter:
    langs = list(labels)
    kind = mask_type(len(langs))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                lines: list[str] = []
                size = 0
                for t in [*part["text"], None]:
                    if t is not None:
                        for _, _, s in sentences(t):
                            lines.append(s)
                            size += len(s)
                    if lines and (t is None or size > SLICE):
                        h, n = np.unique(gram_hashes(lines)[0], return_counts=True)
                        yield pd.DataFrame({"h": h.view(np.int64), "lang": lang, "n": n})
                        lines, size = [], 0

    grams = training_sample(docs, id_col, text, label, labels=labels).repartition(32).mapInPandas(count, "h long, lang string, n long")
    wide = grams.groupBy("h").agg(*[F.sum(F.when(F.col("lang") == l, F.col("n")).otherwise(0)).alias(f"n{i}") for i, l in enumerate(langs)])
    cols = [f"n{i}" for i in range(len(langs))]
    pdf = wide.where(" or ".join(f"{c} >= {MIN_COUNT}" for c in cols)).toPandas()  # bounded by the sample
    n = pdf[cols].to_numpy(dtype=float)
    rate = n / np.maximum(n.sum(0), 1)
    member = (n >= MIN_COUNT) & (rate >= RATE_SHARE * rate.max(1, keepdims=True)) if len(pdf) else n.astype(bool)
    masks = np.zeros(len(pdf), kind)
    for k in range(len(langs)):
        masks |= np.where(member[:, k], kind(1 << k), kind(0)).astype(kind)
    return LanguageFilter(pdf["h"].to_numpy(dtype=np.int64).view(np.uint64), masks, langs)


def _best(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best language of each row, its hits, and those of the second."""
    order = np.argsort(-hits, axis=1, kind="stable")
    rows = np.arange(len(hits))
    second = hits[rows, order[:, 1]] if hits.shape[1] > 1 else np.zeros(len(hits))
    return order[:, 0], hits[rows, order[:, 0]], second


def _decide(langs: list[str], total: np.ndarray, hits: np.ndarray) -> list[tuple[str | None, float, float]]:
    first, best, second = _best(hits)
    sure = (best >= COVER * total) & (best - second >= LEAD * total) & (best > second)
    return [(langs[o] if ok else None, b, s) for o, ok, b, s in zip(first.tolist(), sure.tolist(), best.tolist(), second.tolist())]


def _guess(langs: list[str], total: np.ndarray, hits: np.ndarray) -> list[tuple[str, float] | None]:
    """The language with most n-grams of each whole text (alphabetically first of equals), with a low confidence."""
    names = np.argsort(np.array(langs), kind="stable")
    first, best, second = _best(hits[:, names])
    return [(langs[names[o]], b / (b + s) * min(1.0, b / t)) if b > 0 else None for o, b, s, t in zip(first.tolist(), best.tolist(), second.tolist(), total.tolist())]


def _in_slices(lines: list[str], work) -> list:
    """``work`` over lines of about ``SLICE`` characters at a time, in order."""
    out: list = []
    part: list[str] = []
    room = 0
    for s in [*lines, None]:
        if s is not None:
            part.append(s)
            room += len(s)
        if part and (s is None or room > SLICE):
            out += work(part)
            part, room = [], 0
    return out


PASSAGES = "passage int, start long, end long, lang string, confidence double, sentences int, first_of_lang boolean, text_lang string, text_confidence double, text_langs int"


def label_passages(docs: DataFrame, model: LanguageFilter, id_col: str, text: str, label: str, labels: dict[str, list[str]] = LABELS) -> DataFrame:
    """One row per passage: (id, label_lang, passage, start, end, lang, ..., text_lang, ...).

    Texts of no known n-gram give one row with null language.
    Offsets count characters from 0; ``first_of_lang`` marks each language's
    first passage of a text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).alias("id"), label_language(F.col(label), labels).alias("label_lang"), F.col(text).alias("text"))
    kind = dict(d.dtypes)["id"]
    names = ["id", "label_lang", *[x.split()[0] for x in PASSAGES.split(", ")]]

    def rows_of(doc_id, label_lang, size, found, guess):
        by: dict[str, list[float]] = {}
        passages: list[list] = []
        for (start, end, _), (lang, best, second) in found:
            if lang is None:
                continue
            t = by.setdefault(lang, [0.0, 0.0])
            t[0] += best
            t[1] += second
            if passages and passages[-1][2] == lang:
                p = passages[-1]
                p[1], p[3], p[4], p[5] = end, p[3] + best, p[4] + second, p[5] + 1
            else:
                passages.append([start, end, lang, best, second, 1])
        if not passages and guess is not None:
            return [(doc_id, label_lang, 0, 0, size, guess[0], guess[1], 0, True, guess[0], guess[1], 1)]
        if not passages:
            return [(doc_id, label_lang, None, None, None, None, None, None, None, None, None, 0)]
        main = min(by, key=lambda x: (-by[x][0], x))
        conf = lambda b, s: b / (b + s)
        out, seen = [], set()
        for i, (start, end, lang, b, s, k) in enumerate(passages):
            out.append((doc_id, label_lang, i, start, end, lang, conf(b, s), k, lang not in seen, main, conf(*by[main]), len(by)))
            seen.add(lang)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            out: list[tuple] = []
            todo: list[tuple] = []  # (id, label, text, sentences)
            size = 0

            def flush():
                decided = _in_slices([s[2] for d in todo for s in d[3]], lambda part: _decide(model.langs, *model.counts(part)))
                found, whole, at = [], [], 0
                for _, _, t, ss in todo:
                    found.append(list(zip(ss, decided[at : at + len(ss)])))
                    at += len(ss)
                    if isinstance(t, str) and not any(x[1][0] for x in found[-1]):
                        words = _WORD.findall(_ASIDE.sub(" ", t).lower()) or _WORD.findall(t.lower())
                        whole.append((len(found) - 1, " ".join(words)))
                guess = dict(zip([k for k, _ in whole], _in_slices([w for _, w in whole], lambda part: _guess(model.langs, *model.counts(part)))))
                for k, (doc_id, label_lang, t, _) in enumerate(todo):
                    out.extend(rows_of(doc_id, label_lang, len(t) if isinstance(t, str) else 0, found[k], guess.get(k)))

            for doc_id, label_lang, t in zip(pdf["id"], pdf["label_lang"], pdf["text"]):
                ss = sentences(t) if isinstance(t, str) else []
                todo.append((doc_id, label_lang, t, ss))
                size += len(t) if isinstance(t, str) else 0
                if size > SLICE:
                    flush()
                    todo, size = [], 0
            flush()
            frame = pd.DataFrame(out, columns=names)
            for c in ("passage", "start", "end", "sentences", "text_langs"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return d.mapInPandas(run, f"id {kind}, label_lang string, {PASSAGES}")


def mislabelled(passages: DataFrame) -> DataFrame:
    """(id, lang): one row per language of each text whose label needs mending.

    The label is missing or names none of the languages, names another than the
    text's, or the text has full sentences in several languages.
    """
    wrong = F.col("label_lang").isNull() | (F.col("text_langs") > 1) | (F.col("label_lang") != F.col("text_lang"))
    return passages.where(F.col("first_of_lang") & wrong).select("id", "lang")
