"""Registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphloom.llm import canonmap, formatdup, langid, lookalike, mixing, packing, runs, tokens, topn
from glyphloom.llm.sql import SQL  # noqa: F401
from glyphloom.session import cut_lineage, read_table
from glyphloom.skew import attach_by_key


# ---------------------------------------------------------------- problem 1
def _records(spark, d):
    return formatdup.canonical_records(read_table(spark, d, "dict_raw"), "raw_id", "payload", "lang")


def p1_found(spark, d):
    return formatdup.copies_of_first(_records(spark, d))


def p1_records(spark, d):
    return formatdup.count_copies(_records(spark, d)).select("first_id", "copies")


def p1_collisions(spark, d):
    return formatdup.collision_report(formatdup.canonical_records(read_table(spark, d, "dict_raw"), "raw_id", "payload", "lang", True))


# ---------------------------------------------------------------- problem 2
def _key():
    return F.regexp_replace(F.lower("key"), r"[^\p{L}]", "")


def _has():
    return F.col("ch").isNotNull() | F.col("key").isNotNull()


def _strict_runs(spark, d):
    strict = 3.0  # above twice the penalty: runs are uniform in it
    features = {"kind": (F.col("kind"), strict), "ch": (F.lower("ch"), strict), "key": (_key(), strict)}
    return runs.collapse_runs(read_table(spark, d, "key_events"), "window_id", "seq", "ts", "event_id", features, _has(), 1000, 1.0, 2)


def p2_found(spark, d):
    return _strict_runs(spark, d).select("window_id", F.col("first_order").alias("first_seq"), F.col("last_order").alias("last_seq"))


def p2_runs(spark, d):
    return _strict_runs(spark, d).select("window_id", F.col("first_order").alias("first_seq"), F.col("count").alias("events"), F.col("duration_ms").cast("long").alias("duration_ms"))


def p2_near_runs(spark, d):
    """Near-identical events: letter case and modifiers may differ now and then."""
    strict = 3.0
    features = {
        "kind": (F.col("kind"), strict),
        "key": (_key(), strict),
        "letter": (F.lower("ch"), strict),
        "case": (F.col("ch"), 0.6),
        "shift": (F.col("modifiers.shift"), 0.4),
        "caps": (F.col("modifiers.caps_lock"), 0.4),
    }
    out = runs.collapse_runs(read_table(spark, d, "key_events"), "window_id", "seq", "ts", "event_id", features, _has(), 2000, 1.0, 2)
    return out.select("window_id", F.col("first_order").alias("first_seq"), F.col("last_order").alias("last_seq"), F.col("count").alias("events"), F.col("duration_ms").cast("long").alias("duration_ms"))


# ---------------------------------------------------------------- problem 3
def _typed(spark, d):
    t = read_table(spark, d, "token_result")
    both = F.explode(F.array(F.struct(F.lit("original").alias("field"), F.col("original").alias("value")), F.struct(F.lit("corrected").alias("field"), F.col("corrected").alias("value")))).alias("f")
    return t.select("doc_id", "pos", both).select("doc_id", "pos", "f.*").where("value is not null")


def _mapped(spark, d):
    return canonmap.map_values(_typed(spark, d), "value", read_table(spark, d, "core_words"), "word_id", "word")


def p3_found(spark, d):
    mapped = cut_lineage(_mapped(spark, d).where("status = 'mapped'").select("value", "uses", F.col("ref_id").alias("word_id")))  # read twice below
    found = attach_by_key(_typed(spark, d), mapped, ["value"], ["word_id"], "uses", ["doc_id", "pos", "field"])
    return found.where("word_id is not null").select("doc_id", "pos", "field", "word_id").distinct()


def p3_values(spark, d):
    """What becomes of every distinct value, the unmatched included."""
    return _mapped(spark, d).select("value", "uses", F.col("ref_id").alias("word_id"), "slips", "status")


# ---------------------------------------------------------------- problem 4
_LEAST = (1 << 63) - 1  # stands for a null frequency: after every other


def _top_candidates(spark, d):
    score = [F.col("distance").cast("long"), F.coalesce(-F.col("frequency"), F.lit(_LEAST))]
    coarse = F.col("s0") * 66 + topn.log2_bin(F.when(F.col("s1") != _LEAST, -F.col("s1")))
    return topn.top_n(read_table(spark, d, "candidate"), "original", "word", score, coarse, 3)


def p4_found(spark, d):
    return _top_candidates(spark, d).select("original", "word")


def p4_top3(spark, d):
    frequency = F.when(F.col("s1") != _LEAST, -F.col("s1"))
    return _top_candidates(spark, d).select("original", "word", "rank", F.col("s0").alias("distance"), frequency.alias("frequency"))


# ---------------------------------------------------------------- problem 5
def _texts(spark, d):
    """Every text of the problem: tab, lang, id and up to two texts."""
    words = read_table(spark, d, "dictionary").select(F.lit("dictionary").alias("tab"), "lang", F.col("entry_id").alias("id"), F.col("word").alias("x"), F.lit(None).cast("string").alias("y"))
    errors = read_table(spark, d, "errors").where("lang in ('es', 'pt')")
    return words.unionByName(errors.select(F.lit("errors").alias("tab"), "lang", F.col("error_id").alias("id"), F.col("typo").alias("x"), F.col("correction").alias("y")))


def _forms(spark, d):
    t = _texts(spark, d)
    counts = lookalike.character_counts(t, "x", "y")
    form = lookalike.unifier(counts)
    return t.withColumn("fx", form("x")).withColumn("fy", form("y"))


def _entries(spark, d):
    f = _forms(spark, d).where("fx <> '' and (tab = 'dictionary' or fy <> '')")
    return f.select("tab", "lang", "id", F.concat_ws("\x1f", "fx", "fy").alias("key"), F.concat_ws("\x1f", "x", "y").alias("raw"))


def p5_found(spark, d):
    return lookalike.look_alike_pairs(_entries(spark, d), "id", ["tab", "lang"], "key", "raw").select("tab", "id_a", "id_b")


def p5_classes(spark, d):
    """One row per entry that looks like another text, with its class and the class's size."""
    return lookalike.look_alike_classes(_entries(spark, d), "id", ["tab", "lang"], "key", "raw").select("tab", "id", "class_id", "texts", "members")


def p5_forms(spark, d):
    """The one form of every text that is not yet written in it."""
    f = _forms(spark, d)
    one = lambda field, raw, form: f.select("tab", "id", F.lit(field).alias("field"), F.col(form).alias("form"), F.col(raw).alias("raw"))
    return one("first", "x", "fx").unionByName(one("second", "y", "fy")).where("form <> raw").drop("raw")


# ---------------------------------------------------------------- problem 7
def _capacities(spark, d):
    return [(r["pack_id"], r["capacity_tokens"]) for r in read_table(spark, d, "pack_sizes").collect()]


def _packed(spark, d):
    sizes = tokens.document_sizes(read_table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, _capacities(spark, d))


def p7_packed(spark, d):
    return _packed(spark, d).select("pack_id", "container", F.col("id").alias("doc_id"), "copy", "piece", "first_token", "tokens", "start")


def p7_fill(spark, d):
    return packing.fill_report(_packed(spark, d), _capacities(spark, d))


def p7_checked(spark, d):
    """What must hold of the containers of each capacity: nothing lost or doubled, nothing too full, nothing split that fits."""
    caps = _capacities(spark, d)
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id")
    packed = _packed(spark, d)
    cap = F.coalesce(*[F.when(F.col("pack_id") == p, F.lit(c).cast("long")) for p, c in caps])
    per = packed.groupBy("pack_id", "id", "copy").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("t"), F.sum("first_token").alias("firsts"))
    whole = F.greatest(F.ceil(F.col("t") / cap), F.lit(1))
    # n pieces of the capacity begin at 0, cap, 2 cap, ...
    texts = per.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("texts"), F.count_distinct("id").alias("ids"),
        F.count(F.when((F.col("pieces") != whole) | (F.col("firsts") * 2 != F.col("pieces") * (F.col("pieces") - 1) * cap), 1)).alias("wrongly_split"),
    )
    bins = packed.groupBy("pack_id", "container").agg(F.sum("tokens").alias("t"), F.max(F.col("start") + F.col("tokens")).alias("end"))
    bins = bins.groupBy("pack_id").agg(F.count(F.when((F.col("t") > cap) | (F.col("end") != F.col("t")), 1)).alias("overfull"))
    total = docs.agg(F.count(F.lit(1)).alias("documents"))
    out = texts.join(bins, "pack_id").join(F.broadcast(total))  # one row
    return out.select("pack_id", cap.alias("capacity"), "texts", "ids", (F.col("documents") - F.col("texts")).alias("lost"), "wrongly_split", "overfull")


# ---------------------------------------------------------------- problem 8
def _mixed(spark, d):
    sizes = tokens.document_sizes(read_table(spark, d, "documents"), "doc_id", "text", ["source"])
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in read_table(spark, d, "mix_targets").collect()]
    return mixing.mix(sizes, targets)


def p8_mixed(spark, d):
    return _mixed(spark, d)[0].select(F.col("id").alias("doc_id"), "source", "tokens", "repeats")


def p8_shares(spark, d):
    return _mixed(spark, d)[1]


def p8_checked(spark, d):
    """What must hold of the mixture: no document beyond its source's most repetitions, shares as targeted unless a source is used up."""
    chosen, shares = _mixed(spark, d)
    most = F.broadcast(shares.select("source", "max_repeats"))  # one row per target
    over = chosen.join(most, "source").groupBy("source").agg(F.count(F.when(F.col("repeats") > F.col("max_repeats"), 1)).alias("too_often"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))
    # a clamped source gives all it can; the others keep their proportions
    full = F.col("mixed_tokens") >= F.col("source_tokens") * F.col("max_repeats")
    open_ = F.sum(F.when(~full, F.col("target_share"))).over(Window.partitionBy())
    got = F.sum(F.when(~full, F.col("mixed_tokens"))).over(Window.partitionBy())
    right = full | (F.abs(F.col("mixed_tokens") / got - F.col("target_share") / open_) < 0.01)
    return shares.withColumn("as_targeted", right).join(over, "source", "left").select("source", "max_repeats", F.coalesce("too_often", F.lit(0)).alias("too_often"), "as_targeted", (F.coalesce("n", F.lit(0)) - F.coalesce("ids", F.lit(0))).alias("doubled"))


# ---------------------------------------------------------------- problem 9
def _passages(spark, d):
    docs = read_table(spark, d, "documents")
    return langid.label_passages(docs, langid.fit(docs, "doc_id", "text", "lang"), "doc_id", "text", "lang")


def p9_found(spark, d):
    return langid.mislabelled(_passages(spark, d)).select(F.col("id").alias("doc_id"), "lang")


def p9_passages(spark, d):
    return _passages(spark, d).where("lang is not null").select(F.col("id").alias("doc_id"), "passage", "start", "end", "lang", F.round("confidence", 4).alias("confidence"))


def p9_texts(spark, d):
    p = _passages(spark, d).where("passage is null or passage = 0")
    return p.select(F.col("id").alias("doc_id"), "label_lang", F.col("text_lang").alias("lang"), F.round("text_confidence", 4).alias("confidence"), F.col("text_langs").alias("languages"))


QUERIES = {
    "p1_found": p1_found,
    "p1_records": p1_records,
    "p1_collisions": p1_collisions,
    "p2_found": p2_found,
    "p2_runs": p2_runs,
    "p2_near_runs": p2_near_runs,
    "p3_found": p3_found,
    "p3_values": p3_values,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_forms": p5_forms,
    "p5_classes": p5_classes,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p7_checked": p7_checked,
    "p8_mixed": p8_mixed,
    "p8_shares": p8_shares,
    "p8_checked": p8_checked,
    "p9_found": p9_found,
    "p9_passages": p9_passages,
    "p9_texts": p9_texts,
    "p4_top3": p4_top3,
}
