"""Keystrokes in batch: sessions, tokens as typed, and the edits that correct them.

A device has one buffer.  It is emptied when the focus moves to another window
or Backspace is pressed; a delimiter character, Enter, Tab or Escape ends a
token.  All of it is running counts over each device's events.  The counts are
formed within pieces of the order and stitched through one row per piece, so
no task holds a whole device.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.config import CorrectionConfig
from glyphloom.functions.chars import DELIMITER
from glyphloom.operators.correct import correct_tokens
from glyphloom.session import cut_lineage
from glyphloom.skew import attach_by_key
from glyphloom.sources.resources import Resources

#: Keys that end a token without an edit.
ENDING_KEYS = ["enter", "tab", "escape"]
PIECE = 1 << 14


def _key_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}]", "")


def _running(events: DataFrame, device: str, order: list[str], piece: Column, marks: dict[str, Column]) -> DataFrame:
    """``events`` with running sums of ``marks`` up to and including each row, per device."""
    e = events.withColumn("_piece", piece)
    w = Window.partitionBy(device, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = e.select("*", *[F.sum(c.cast("long")).over(w).alias(f"_l_{n}") for n, c in marks.items()])
    totals = e.groupBy(device, "_piece").agg(*[F.sum(c.cast("long")).alias(n) for n, c in marks.items()])
    before = Window.partitionBy(device).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col(device).alias("_d"), F.col("_piece").alias("_p"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_c_{n}") for n in marks])
    joined = local.join(carry.hint("merge"), (F.col(device) == F.col("_d")) & (F.col("_piece") == F.col("_p")))
    return joined.select(*events.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in marks])


def focus_sessions(events: DataFrame, device: str, window: str, at: str, tie: str, piece_us: int = 86_400_000_000) -> DataFrame:
    """``events`` with ``session``: 0, 1, ... per device, a new one at every change of window.

    Returning to a window starts a new session.  Rows without device, window
    or time are left out.
    """
    e = events.where(f"{device} is not null and {window} is not null and {at} is not null")
    us = F.unix_micros(F.col(at).cast("timestamp"))
    piece = F.floor(us / F.lit(piece_us)).cast("long")
    e = e.withColumn("_us", us).withColumn("_piece", piece)
    w = Window.partitionBy(device, "_piece").orderBy("_us", tie)
    inner = e.withColumn("_before", F.lag(window).over(w))
    # a piece's first event is compared with the last of the piece before it
    ends = e.groupBy(device, "_piece").agg(F.min(F.struct("_us", tie, window))[window].alias("_first"), F.max(F.struct("_us", tie, window))[window].alias("_last"))
    wd = Window.partitionBy(device).orderBy("_piece")
    heads = ends.select(F.col(device).alias("_d"), F.col("_piece").alias("_p"), (F.lag("_last").over(wd) != F.col("_first")).alias("_moved"))
    inner = inner.join(heads.hint("merge"), (F.col(device) == F.col("_d")) & (F.col("_piece") == F.col("_p"))).drop("_d", "_p")
    changed = F.coalesce(F.when(F.col("_before").isNull(), F.col("_moved")).otherwise(F.col("_before") != F.col(window)), F.lit(False))
    flagged = inner.withColumn("_changed", changed).drop("_piece", "_before", "_moved")
    out = _running(flagged, device, ["_us", tie], piece, {"session": F.col("_changed").cast("int")})
    return out.select(*events.columns, "session")


def _with_moves(e: DataFrame, piece: int) -> DataFrame:
    """``e`` (device, ord, win, ...) with ``moved`` (the window is another than before) and ``before`` (the order number before).

    Window 0 is none: leaving it is no move.
    """
    e = e.withColumn("_piece", F.expr(f"ord div {int(piece)}"))
    w = Window.partitionBy("device", "_piece").orderBy("ord")
    ends = e.groupBy("device", "_piece").agg(F.max(F.struct("ord", "win")).alias("last"))
    wd = Window.partitionBy("device").orderBy("_piece")
    heads = ends.select(F.col("device").alias("_d"), F.col("_piece").alias("_p"), F.lag("last").over(wd).alias("_last"))
    inner = e.withColumn("_lag", F.lag(F.struct("ord", "win")).over(w)).join(heads.hint("merge"), (F.col("device") == F.col("_d")) & (F.col("_piece") == F.col("_p")))
    prior = F.coalesce("_lag", "_last")
    moved = F.coalesce((prior["win"] != 0) & (prior["win"] != F.col("win")), F.lit(False))
    return inner.select(*[c for c in e.columns if c != "_piece"], moved.alias("moved"), prior["ord"].alias("before"))


def typed_tokens(
    events: DataFrame, device: str = "window_id", order: str = "seq", kind: str = "kind", ch: str = "ch", key: str = "key", limit: int = 64, piece: int = PIECE, window: str | None = None
) -> DataFrame:
    """(device, token_no, token, first_order, last_order, delimiter, applied[, left]): tokens as they were typed.

    ``token_no`` counts all breaks of the buffer; only those that emit give a
    row.  ``delimiter`` is the character that ended the token (a blank for
    Enter, Tab, Escape, which emit but never lead to an edit: ``applied``
    false).  Rows without device or order are left out; of rows with one
    device and order one counts.  Two delimiters in a row give an empty token.

    With ``window``, an event of any kind in another window than the device's
    last one empties the buffer, and ``left`` says that the event after the
    token is in another window.  A null window is none (0).
    """
    name = _key_name(F.col(key))
    mark = lambda c, ends, clears, applied: F.struct(c.alias("c"), ends.alias("ends"), F.lit(clears).alias("clears"), F.lit(applied).alias("applied"))
    e = events.where(F.col(device).isNotNull() & F.col(order).isNotNull()).select(
        F.col(device).alias("device"),
        F.col(order).cast("long").alias("ord"),
        (F.coalesce(F.col(window).cast("long"), F.lit(0)) if window else F.lit(0).cast("long")).alias("win"),
        F.when((F.col(kind) == "Char") & F.col(ch).isNotNull(), mark(F.col(ch), F.col(ch).rlike(f"^{DELIMITER}$"), False, True))
        .when((F.col(kind) == "Special") & name.isin(ENDING_KEYS), mark(F.lit(" "), F.lit(True), False, False))
        .when((F.col(kind) == "Special") & (name == "backspace"), mark(F.lit(""), F.lit(False), True, False))
        .alias("k"),
    )
    if window:
        e = e.groupBy("device", "ord").agg(F.min(F.struct("win", "k")).alias("m")).select("device", "ord", "m.*")
        e = _with_moves(e, piece)
        # what is kept of an event without effect is its move
        nothing = F.struct(F.lit("").alias("c"), F.lit(False).alias("ends"), F.lit(False).alias("clears"), F.lit(False).alias("applied"))
        e = e.where("k is not null or moved").withColumn("idle", F.col("k").isNull()).withColumn("k", F.coalesce("k", nothing))
        e = cut_lineage(e.select("device", "ord", "k.*", "moved", "idle", "before"))  # read for the counts and for what is left
    else:
        e = e.where("k is not null").groupBy("device", "ord").agg(F.min("k").alias("k")).select("device", "ord", "k.*", F.lit(False).alias("moved"), F.lit(False).alias("idle"))
    cut = F.col("ends") | F.col("clears")
    char = ~cut & ~F.col("idle")
    n = _running(e.drop("before"), "device", ["ord"], F.expr(f"ord div {int(piece)}"), {"breaks": cut.cast("int") + F.col("moved").cast("int"), "chars": char.cast("int")})
    n = n.withColumn("token_no", F.col("breaks") - cut.cast("long")).where("not idle")
    # of a token beyond the bound only the characters that stay are gathered (see bounded_token)
    size = n.where(~cut).groupBy("device", "token_no").agg(F.count(F.lit(1)).alias("n"), F.min("chars").alias("start")).where(F.col("n") > limit)
    n = attach_by_key(n, size, ["device", "token_no"], ["n", "start"], "n", ["device", "ord"])
    i = F.col("chars") - F.col("start")
    place = F.when(i < limit, i).otherwise(limit + F.floor((i - limit - 1) / 2))
    stays = F.col("n").isNull() | (((i < limit) | ((i - limit) % 2 == 1)) & (place >= F.ceil((F.col("n") - limit) / 2)))
    # the order number travels with each character, so a group can be put in order
    g = n.groupBy("device", "token_no").agg(
        F.array_sort(F.collect_list(F.when(~F.col("ends") & ~F.col("clears") & stays, F.struct("ord", "c")))).alias("cs"),
        F.min("ord").alias("first_order"), F.max("ord").alias("last_order"),
        F.max("ends").alias("ends"), F.max(F.when(F.col("ends"), F.struct("c", "applied"))).alias("by"),
    )
    token = F.array_join(F.transform("cs", lambda x: x["c"]), "")
    out = g.where("ends").select("device", "token_no", token.alias("token"), "first_order", "last_order", F.col("by.c").alias("delimiter"), F.col("by.applied").alias("applied"))
    if window:
        left = e.where("moved").select("device", F.col("before").alias("last_order"), F.lit(True).alias("left"))  # one row per device and order
        out = out.join(left.hint("merge"), ["device", "last_order"], "left").withColumn("left", F.coalesce("left", F.lit(False)))
        return out.select(F.col("device").alias(device), *[c for c in out.columns if c not in ("device", "last_order", "left")][:3], "last_order", "delimiter", "applied", "left")
    return out.withColumnRenamed("device", device)


def edit_script(tokens: DataFrame, resources: Resources, lang: str, device: str = "window_id", config: CorrectionConfig = CorrectionConfig()) -> DataFrame:
    """(device, token_no, last_order, backspaces, insert_text): what a corrector would type.

    Backspaces cover the token and its delimiter.  Tokens ended by Enter, Tab
    or Escape are looked up but not edited.  Edits are suppressed where the
    token's window is left with the next event (``left``), as they would go to
    another window.
    """
    if "left" in tokens.columns:
        tokens = tokens.where("not left")
    done = correct_tokens(tokens.withColumn("lang", F.lit(lang)), resources, config, (device, "token_no"))
    out = done.where(F.col("corrected").isNotNull() & F.col("applied"))
    return out.select(device, "token_no", "last_order", (F.length("token") + 1).alias("backspaces"), F.concat("corrected", "delimiter").alias("insert_text"))
