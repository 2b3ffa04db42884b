"""Visually identical text with different characters, brought to one form.

Look-alike relations between strings and code points come from compatibility
decompositions (width, ligatures, letter-like numerals), general categories
(blanks; marks one cannot see) and a table of letters of other scripts: a short
list, or the public confusables table (``read_confusables``).  Union-find makes them transitive; each class is represented by its
most frequent member in the corpus at hand, and text is rewritten greedily,
longest match first, with a multi-pattern automaton.  Accents are compared in
decomposed form and composed again, so ``e`` + U+0301 and ``é`` agree.

Letter case and accents are part of the look and stay.

Defined results
---------------
* Null stays null.  Blanks at the ends are taken off, runs of blanks become
  one; text of nothing but blanks and unseen marks becomes empty.
* Representatives go by corpus frequency; ties, and members that the corpus
  does not have, by shortness and code point, so the form is deterministic.
* Very long texts are rewritten whole, in linear time.
* ``look_alike_pairs`` and ``look_alike_classes``: exact copies are no pair, and
  a class has at least two different texts; null or blank texts, and rows
  whose scope is null, are left out;
  equal ids never pair; every pair once, smaller id first.  Repeated rows under
  one id count once.  Texts are compared by 128-bit hashes of form and of text.
* Empty tables give no rows.  Extra columns and clashing names are harmless.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.session import cut_lineage
from glyphloom.skew import attach_by_key

#: Letters of other scripts that look like a Latin letter: the letter, then its look-alikes.
LETTERS = """
a ɑ α а
c ϲ с ᴄ
d ԁ
e е ҽ
g ɡ ց
h һ հ
i ı ɩ ι і
j ϳ ј
l ӏ
n ո
o ο σ о օ ᴏ
p ρ р
q ԛ գ
s ѕ ꜱ
u υ ս ᴜ
v ν ѵ ᴠ
w ա ѡ ԝ ᴡ
x х
y γ у ү
z ᴢ
A Α А Ꭺ
B Β В Ᏼ
C Ϲ С Ꮯ
D Ꭰ
E Ε Е Ꭼ
F Ϝ
G Ԍ Ꮐ
H Η Н Ꮋ
I Ι І Ӏ
J Ϳ Ј Ꭻ
K Κ К Ꮶ
L Ꮮ
M Μ М Ꮇ
N Ν
O Ο О Օ
P Ρ Р Ꮲ
Q Ԛ
R Ꭱ
S Ѕ Տ Ꮪ
T Τ Т Ꭲ
U Ս
V Ѵ Ꮩ
W Ԝ Ꮃ
X Χ Х
Y Υ Ү
Z Ζ Ꮓ
- ‐ ‑ ⁃ −
"""

#: Compatibility decompositions that only change width, font or encoding.
_SAME_LOOK = re.compile(r"<(wide|narrow|font|compat|noBreak)> ")
#: Characters outside category Cf that show nothing.
_UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}


def listed_letters() -> list[tuple[str, str]]:
    """The short list as pairs."""
    return [(o, letter) for line in LETTERS.split("\n") if line for letter, *others in [line.split()] for o in others]


def read_confusables(path: str, latin_only: bool = True) -> list[tuple[str, str]]:
    """Pairs of a table in the format of Unicode's confusables file: ``source ; target ; kind # ...``, code points in hex.

    ``latin_only`` leaves out what would make two printable ASCII strings equal
    (``l`` and ``1``, ``rn`` and ``m``), which differ visibly in most fonts.
    """
    plain = lambda x: x.isascii() and x.isprintable()
    out = []
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = line.split("#")[0].split(";")
            if len(parts) >= 2:
                a, b = ["".join(chr(int(x, 16)) for x in p.split()) for p in parts[:2]]
                if a and b and not (latin_only and plain(a) and plain(b)):
                    out.append((a, b))
    return out


def relations(chars: Iterable[str], table: Iterable[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """Look-alike pairs (string, string) that concern the given characters; ``table`` replaces the short list."""
    chars = set(chars)
    out = listed_letters() if table is None else list(table)
    for c in sorted(chars):
        kind = unicodedata.category(c)
        if kind == "Cf" or ord(c) in _UNSEEN:
            out.append((c, ""))
        elif c.isspace() or kind in ("Zs", "Zl", "Zp"):
            out.append((c, " "))
        elif _SAME_LOOK.match(unicodedata.decomposition(c)):
            flat = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c))
            if flat != c:
                out.append((c, flat))
    return out


def classes(pairs: Iterable[tuple[str, str]]) -> list[set[str]]:
    """Transitive classes of the pairs, by union-find."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups: dict[str, set[str]] = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return list(groups.values())


def representatives(counts: dict[str, int], table: Iterable[tuple[str, str]] | None = None) -> dict[str, str]:
    """member -> most frequent member of its class, for members that differ from it.

    ``counts``: frequency of each character.  A string of several characters
    is taken to be as frequent as its rarest one.  Unseen marks and blanks
    belong to the fixed forms "" and " ".
    """
    decomposed: dict[str, int] = {}
    for c, n in counts.items():
        for part in unicodedata.normalize("NFD", c):
            decomposed[part] = decomposed.get(part, 0) + n
    freq = lambda s: min((decomposed.get(x, 0) for x in s), default=0)
    out = {}
    for group in classes(relations(decomposed, table)):
        fixed = [x for x in ("", " ") if x in group]
        best = fixed[0] if fixed else min(group, key=lambda x: (-freq(x), len(x), x))
        out |= {m: best for m in group if m and m != best}
    return out


class Rewriter:
    """Greedy longest-match rewriting with one automaton over all members."""

    def __init__(self, to: dict[str, str]):
        import ahocorasick

        self.to = to
        self.ascii_fixed = not any(m.isascii() and m.isprintable() for m in to)  # printable ASCII stays as it is
        self.automaton = ahocorasick.Automaton()
        for m in to:
            self.automaton.add_word(m, m)
        if to:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        if not (self.ascii_fixed and text.isascii() and text.isprintable()):
            text = unicodedata.normalize("NFD", text)
            if self.to:
                parts, at = [], 0
                for end, m in self.automaton.iter_long(text):
                    start = end + 1 - len(m)
                    parts += [text[at:start], self.to[m]]
                    at = end + 1
                text = "".join([*parts, text[at:]])
            text = unicodedata.normalize("NFC", text)
        return re.sub(" +", " ", text).strip(" ") if " " in text else text


def character_counts(texts: DataFrame, *cols: str) -> dict[str, int]:
    """Frequency of every character of the columns, over all rows.

    Counted per Arrow batch, then summed; what comes to the driver is one row
    per distinct character, at most the size of Unicode.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter[str] = Counter()
            for c in pdf.columns:
                n.update("".join(pdf[c].dropna()))
            yield pd.DataFrame({"c": list(n), "n": list(n.values())})

    chars = texts.select(*[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(cols)]).mapInPandas(count, "c string, n long")
    return {r["c"]: r["n"] for r in chars.groupBy("c").agg(F.sum("n").alias("n")).collect()}


def unifier(counts: dict[str, int], table: Iterable[tuple[str, str]] | None = None) -> Callable[[Column], Column]:
    """A column function that brings text to its one form."""
    to = representatives(counts, table)

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = Rewriter(to)  # one automaton per task
        for s in batches:
            yield s.map(rewrite, na_action="ignore")

    # so marked, a filter on the form is not pushed below it, which would rewrite every text once more
    return form.asNondeterministic()


def _alike(rows: DataFrame, id_col: str, scope: list[str], key: str, raw: str) -> DataFrame:
    """(scope..., k1, k2, r1, r2, id): the rows whose form several different texts of one scope have.

    Texts are hashed before anything is kept or moved.  Rows of the heaviest
    forms take the broadcast way of ``attach_by_key``.
    """
    h = lambda k, c: [F.xxhash64(*scope, c).alias(f"{k}1"), F.xxhash64(F.lit("second"), *scope, c).alias(f"{k}2")]
    r = rows.where(F.col(key).isNotNull() & F.col(raw).isNotNull() & F.col(id_col).isNotNull())
    for c in scope:
        r = r.where(F.col(c).isNotNull())
    r = r.select(*scope, *h("k", F.col(key)), *h("r", F.col(raw)), F.col(id_col).alias("id"))
    r = cut_lineage(r)  # the forms come from Python: made once
    text = F.struct("r1", "r2")
    several = r.groupBy("k1", "k2").agg(F.min(text).alias("lo"), F.max(text).alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("k1", "k2", "n", F.lit(True).alias("several"))
    return attach_by_key(r, several, ["k1", "k2"], ["several"], "n", ["id"]).where("several").drop("several").distinct()


def look_alike_pairs(rows: DataFrame, id_col: str, scope: list[str], key: str, raw: str) -> DataFrame:
    """(scope..., id_a, id_b): rows of one scope whose ``key`` agrees and ``raw`` differs.

    Distinct texts of a key are paired first and the rows attached to each side
    after that, so exact copies, however many, are never compared.
    """
    on = ["k1", "k2"]
    r = cut_lineage(_alike(rows, id_col, scope, key, raw))  # few; all that follows is about these rows only
    side = lambda df, x: df.withColumnsRenamed({"r1": f"{x}1", "r2": f"{x}2", "id": x})
    v = r.select(*on, "r1", "r2").distinct()
    vv = side(v, "a").join(side(v, "b"), on).where(F.struct("a1", "a2") < F.struct("b1", "b2"))
    a, b = side(r.select(*on, "r1", "r2", "id"), "a"), side(r.select(*scope, *on, "r1", "r2", "id"), "b")
    out = vv.join(a, [*on, "a1", "a2"]).join(b, [*on, "b1", "b2"]).where("a <> b")
    return out.select(*scope, F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def look_alike_classes(rows: DataFrame, id_col: str, scope: list[str], key: str, raw: str) -> DataFrame:
    """(scope..., id, class_id, texts, members): each row that looks like a different text, with its class.

    ``class_id`` is the smallest id of the class, ``texts`` the number of its
    different texts and ``members`` of its rows; the class of a hot form is
    counted map-side, and nothing is paired.
    """
    r = cut_lineage(_alike(rows, id_col, scope, key, raw))
    text = r.groupBy("k1", "k2", "r1", "r2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    c = text.groupBy("k1", "k2").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("members"))
    return attach_by_key(r, c, ["k1", "k2"], ["class_id", "texts", "members"], "members", ["id"]).select(*scope, "id", "class_id", "texts", "members")
