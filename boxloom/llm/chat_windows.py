"""Chat formatting in windows of a token budget, in DataFrame functions only.

Turns of a conversation are laid end to end by prefix sums of their tokens.  The line of tokens is cut into
cells of the body budget: turns inside a cell form a span, and the turn that lies across a cell border joins
the span before it when both fit the budget, else stands alone.  So every span is turn-aligned, keeps the
budget (a single turn above the budget is a span of its own) and is found without a sequential pass; a
conversation with millions of turns is spread over slots of its turns.

Each window repeats the system turn and, from the second window on, the latest earlier turns that fit the
history budget.  Only assistant turns that are new in a window carry loss, so each target counts once.

Defined cases: null text and null role are empty; null turns come first; equal turns are ordered by role and
text, so repeated rows stay repeated turns; a null conversation id is a conversation of its own; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Control strings of the template; the escape removes the first character of each from texts.
TURN, BODY, END = "<s>", "[TXT]", "</s>"
SLOT_TURNS = 256


def word_tokens(text: Column) -> Column:
    """Default token count: one for each word or sign, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")))


def escape(text: Column) -> Column:
    """Reversible: afterwards no ``<`` and no ``[`` is left, so no control string either."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lb;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lb;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _numbered(turns: DataFrame) -> DataFrame:
    """Dense turn numbers and token prefix sums per conversation.

    Rows are dealt by (conversation, slot of turns), so that no conversation is sorted in one task; offsets of the
    slots come from their pre-aggregated counts and sums.
    """
    slot = F.coalesce(F.floor(F.col("turn") / SLOT_TURNS), F.lit(-(2**62)))
    rows = turns.withColumn("slot", slot)
    per_slot = rows.groupBy("conv_id", "slot").agg(F.count("*").alias("slot_rows"), F.sum("tokens").alias("slot_tokens"))
    before = W.partitionBy("conv_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_slot.select(
        F.col("conv_id").alias("o_conv"), F.col("slot").alias("o_slot"),
        F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("slot_tokens").over(before), F.lit(0)).alias("tokens_before"),
    )
    inside = W.partitionBy("conv_id", "slot").orderBy("turn", "role", "text")
    numbered = rows.select("*", (F.row_number().over(inside) - 1).alias("row_in"), F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("sum_in"))
    joined = numbered.join(offsets, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("slot") == F.col("o_slot")))
    return joined.select(
        "conv_id", "role", "text", "tokens", (F.col("rows_before") + F.col("row_in")).alias("no"), (F.col("tokens_before") + F.col("sum_in")).alias("upto"))


def chat_windows(conversations: DataFrame, budget: int = 2048, history: int = 256, count_tokens=word_tokens) -> DataFrame:
    """Windows of formatted turns.

    Returns one row per window: ``conv_id``, ``first_turn`` (number of its first new turn), ``n_context`` (repeated
    turns in front), ``n_turns`` (new turns), ``formatted`` and ``loss_spans`` (start and length in code points of
    ``formatted``, one for each new assistant turn, of the escaped text).  ``budget`` bounds the tokens of new turns and
    history together; the system turn comes on top and is repeated whole.
    """
    body = max(1, budget - history)
    turns = conversations.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = _numbered(turns.withColumn("tokens", count_tokens(F.col("text")).cast("long")))
    start = F.col("upto") - F.col("tokens")
    cell, last = F.floor(start / body), F.floor((F.col("upto") - 1) / body)
    turns = turns.select("*", cell.alias("cell"), (cell != last).alias("across"))
    # a cell's own span and the one turn that lies across its right border
    spans = turns.groupBy("conv_id", "cell").agg(F.sum(F.when(~F.col("across"), F.col("tokens"))).alias("own"), F.max(F.when(F.col("across"), F.col("tokens"))).alias("crossing"))
    joins = spans.select(F.col("conv_id").alias("j_conv"), F.col("cell").alias("j_cell"), (F.coalesce(F.col("own") + F.col("crossing") <= body, F.lit(False))).alias("fits"))
    turns = turns.join(joins, F.col("conv_id").eqNullSafe(F.col("j_conv")) & (F.col("cell") == F.col("j_cell")))
    turns = turns.withColumn("span", F.struct(F.col("cell").alias("cell"), (F.col("across") & ~F.col("fits")).cast("int").alias("alone")))
    piece = F.struct(
        F.col("no"), F.col("role"), F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)).alias("head"), escape(F.col("text")).alias("escaped"))
    new = turns.select("conv_id", "span", "no", "upto", "tokens", piece.alias("piece"))
    ranges = new.groupBy("conv_id", "span").agg(
        F.min("no").alias("first_turn"), F.count("*").alias("n_turns"), F.min(F.col("upto") - F.col("tokens")).alias("from_token"), F.array_sort(F.collect_list("piece")).alias("new"))
    # history: turns that end at or before the span's first token and begin within the history budget before it; by cell, so that only a cell and the next one meet
    reach = -(-history // body) + 1
    edges = ranges.select(F.col("conv_id").alias("e_conv"), F.col("first_turn").alias("e_first"), F.col("from_token").alias("e_from"),
                          F.explode(F.sequence(F.col("span.cell") - reach, F.col("span.cell"))).alias("e_cell"))
    context = new.join(
        edges, F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("span.cell") == F.col("e_cell")) & (F.col("upto") <= F.col("e_from")) & (F.col("upto") - F.col("tokens") >= F.col("e_from") - history)
    ).where((F.col("no") > 0) | (F.col("piece.role") != "system"))
    context = context.groupBy("e_conv", "e_first").agg(F.array_sort(F.collect_list("piece")).alias("history"))
    system = new.where((F.col("no") == 0) & (F.col("piece.role") == "system")).select(F.col("conv_id").alias("s_conv"), F.array("piece").alias("system"))
    full = (
        ranges.join(context, F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("first_turn") == F.col("e_first")), "left")
        .join(system, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left")
    )
    empty = F.slice("new", 1, 0)
    lead = F.concat(F.when(F.col("first_turn") > 0, F.coalesce(F.col("system"), empty)).otherwise(empty), F.coalesce(F.col("history"), empty))
    shown = full.select("conv_id", "first_turn", "n_turns", F.size(lead).alias("n_context"), F.concat(lead, F.col("new")).alias("shown"))
    turn_text = lambda p: F.concat(p["head"], p["escaped"], F.lit(END))
    # running position of each turn: a fold over the turns of one window, which the budget bounds
    placed = F.aggregate(
        "shown", F.struct(F.lit(1).alias("at"), F.lit(0).alias("k"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["head"]) + F.char_length(p["escaped"]) + len(END)).alias("at"), (s["k"] + 1).alias("k"),
            F.when((s["k"] >= F.col("n_context")) & (p["role"] == "assistant"),
                   F.concat(s["spans"], F.array(F.struct((s["at"] + F.char_length(p["head"])).alias("start"), F.char_length(p["escaped"]).alias("length")))))
            .otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    return shown.select("conv_id", "first_turn", "n_turns", "n_context", F.concat_ws("", F.transform("shown", turn_text)).alias("formatted"), placed.alias("loss_spans"))


def parse_window(windows: DataFrame) -> DataFrame:
    """New turns of each window read back from the formatted text: ``conv_id``, ``no``, ``role``, ``text``."""
    parts = F.slice(F.split("formatted", TURN), F.col("n_context") + 2, F.greatest(F.col("n_turns").cast("int"), F.lit(1)))
    exploded = windows.select("conv_id", "first_turn", F.posexplode(parts).alias("k", "part"))
    cut = F.split(F.expr(f"substr(part, 1, char_length(part) - {len(END)})"), r"\[TXT\]")
    return exploded.select("conv_id", (F.col("first_turn") + F.col("k")).alias("no"), unescape(cut[0]).alias("role"), unescape(cut[1]).alias("text"))


def loss_texts(windows: DataFrame) -> DataFrame:
    """Text under the loss mask, unescaped, in order, and the window's length: ``conv_id``, ``first_turn``, ``loss``, ``chars``."""
    masked = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"], s["length"])))
    return windows.select("conv_id", "first_turn", F.concat_ws("", masked).alias("loss"), F.char_length("formatted").alias("chars"))


def _in_order(key: str, text: Column) -> Column:
    """Texts of a group joined in the order of ``key``; the whole of it is one value, as a digest of it needs."""
    return F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), text.alias("x")))), lambda s: s["x"]))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation: what can be read back from its windows."""
    turns = parse_window(windows).groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.sha2(_in_order("no", F.concat("role", F.lit("\n"), "text", F.lit("\n"))), 256).alias("turns_sha256"))
    loss = loss_texts(windows).groupBy(F.col("conv_id").alias("l_conv")).agg(_in_order("first_turn", F.col("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    return turns.join(loss, F.col("conv_id").eqNullSafe(F.col("l_conv"))).select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
