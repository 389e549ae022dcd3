"""Chat formatting in budgeted windows, in built-in expressions.

A conversation within the budget is one window. Turns of others are cut where prefix sums of their tokens cross multiples of what a
window has room for beside one more turn, so windows are turn-aligned and no row needs the one before it. Each window retains the system turn, repeats the last turns before it as
far as the history budget goes, and trains only on assistant turns that are new in it: repeated ones are masked.
One shuffle by conversation serves the sums, the history and the windows; only a window's turns are ever held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The template's control strings: <s> and </s> around a turn, [INST] and [/INST] around its role.
OPEN, ROLE, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(~*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])~(~*)(/?(?:s>|INST\]))"
TURN_TOKENS, BYTES_PER_TOKEN = 8, 4


def escape(text: Column) -> Column:
    """Puts a ``~`` into every control string (and one more where there are some), so that the template's own stay the only ones."""
    return F.regexp_replace(text, _CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def tokens(text: Column) -> Column:
    """The budget's estimate: UTF-8 bytes by four, and what a turn's marks take."""
    return (F.ceil(F.octet_length(text) / BYTES_PER_TOKEN) + TURN_TOKENS).cast("bigint")


def windows(conversations: DataFrame, *, budget: int = 2048, history: int = 512) -> DataFrame:
    """A row for each window: ``conv_id``, ``window`` (from 0), ``formatted``, ``n_repeated`` and ``n_new`` turns, ``loss_spans``
    (start and length in code points of ``formatted``), ``n_tokens`` and ``over_budget``.

    Turns go by ``turn``; of equal ones by role and text, nulls first. Null roles and texts are empty. The first turn is the system turn if
    its role is ``system``. A window keeps to the budget (the system turn and history included) unless a single turn is longer than
    three quarters of what these leave; then it may exceed it and is marked. A null ``conv_id`` is a conversation. An empty table gives no rows.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("n", tokens(F.col("text")))
    before = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.first(F.struct("role", F.when(F.col("role") == "system", F.col("text")).alias("text"), "n")).over(before)
    turns = turns.withColumn("at", F.row_number().over(by_turn)).withColumn("_upto", F.sum("n").over(before)).withColumn("_head", head)
    system = F.when(F.col("_head.role") == "system", F.col("_head.n")).otherwise(F.lit(0))
    left, whole = budget - history - system, Window.partitionBy("conv_id")
    longest = F.max("n").over(whole)  # a span may reach over its end by one turn
    room = F.greatest(F.lit(1), F.floor(left / 4), left - longest).cast("bigint")
    turns = turns.withColumn("_from", F.col("_upto") - F.col("n")).withColumn("room", room).withColumn(
        "span", F.when(F.sum("n").over(whole) <= budget, F.lit(0)).otherwise(
            F.greatest(F.lit(0), F.floor((F.col("_from") - history - system) / F.col("room")))))  # the first repeats nothing and so holds more
    in_span = Window.partitionBy("conv_id", "span")
    turns = turns.withColumn("_end", F.max("_upto").over(in_span)).withColumn("_last", F.lead("span").over(by_turn))
    turns = turns.withColumn("_next", F.max("_last").over(in_span))  # the following window's span, if there is one
    repeated = (F.col("_next") > F.col("span")) & (F.col("_end") - F.col("_from") <= history) & ~((F.col("at") == 1) & (F.col("role") == "system"))
    part = lambda span, fresh: F.struct(span.alias("span"), F.lit(fresh).alias("fresh"))
    placed = turns.withColumn("_to", F.explode(F.when(repeated, F.array(part(F.col("span"), True), part(F.col("_next"), False))).otherwise(
        F.array(part(F.col("span"), True)))))
    one = F.struct("at", F.col("_to.fresh").alias("fresh"), "role", "text", "n")
    grouped = placed.groupBy("conv_id", F.col("_to.span").alias("span")).agg(
        F.array_sort(F.collect_list(one)).alias("turns"), F.first("_head").alias("_head"))
    system_turn = F.struct(F.lit(1).alias("at"), F.lit(False).alias("fresh"), F.col("_head.role").alias("role"), F.col("_head.text").alias("text"), F.col("_head.n").alias("n"))
    retained = (F.col("_head.role") == "system") & (F.element_at("turns", 1)["at"] > 1)
    whole = grouped.withColumn("turns", F.when(retained, F.concat(F.array(system_turn), F.col("turns"))).otherwise(F.col("turns")))
    mark = lambda t: F.concat(F.lit(OPEN + ROLE), escape(t["role"]), F.lit(TEXT))
    whole = whole.withColumn("_parts", F.transform("turns", lambda t: F.struct(
        mark(t).alias("mark"), escape(t["text"]).alias("body"), (t["fresh"] & (t["role"] == "assistant")).alias("target"))))
    end = len(CLOSE)
    spans = F.aggregate(
        "_parts", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["mark"]) + F.length(p["body"]) + end).alias("at"),
            F.when(p["target"], F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(p["mark"])).alias("start"), F.length(p["body"]).cast("bigint").alias("length"))))).otherwise(a["spans"]).alias("spans")))
    total = F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + t["n"])
    return whole.select(
        "conv_id", F.col("span").alias("window"),
        F.array_join(F.transform("_parts", lambda p: F.concat(p["mark"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: ~t["fresh"])).alias("n_repeated"), F.size(F.filter("turns", lambda t: t["fresh"])).alias("n_new"),
        spans["spans"].alias("loss_spans"), total.alias("n_tokens"), (total > budget).alias("over_budget"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The conversations as the windows hold them: ``conv_id``, ``turns`` (role and text of all new turns in order), ``targets`` (the texts under
    the loss mask in order) and ``formatted_chars``. A conversation is one row here, so it must fit into one."""
    pieces = F.slice(F.split("formatted", CLOSE, -1), 1, F.col("n_repeated") + F.col("n_new"))
    fresh = F.slice(pieces, F.col("n_repeated") + 1, F.col("n_new"))
    start = len(OPEN + ROLE) + 1
    targets = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    parts = formatted.select("conv_id", "window", F.transform(fresh, lambda p: _turn(p, start)).alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten("w.turns").alias("turns"), F.flatten("w.targets").alias("targets"), "formatted_chars")


def _turn(piece: Column, start: int) -> Column:
    role = F.substring_index(F.substr(piece, F.lit(start)), TEXT, 1)
    text = F.substr(piece, F.length(role) + start + len(TEXT))
    return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """Number and SHA-256 of the turns, and length and SHA-256 of the loss text, from what ``read_back`` gives."""
    loss = F.array_join("targets", "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"))
