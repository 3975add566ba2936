"""Chat formatting in budgeted windows (operator 4, DataFrame functions only).

Each conversation is cut into windows at turn boundaries. Prefix sums of the
turns' tokens give the cut: a turn belongs to the window in which its prefix
sum falls, windows being half as wide as the budget left for new turns, so
that a window with its last turn stays in the budget; a turn longer than that
width stands alone. Every window begins with the system turn, then repeats the
last turns of the window before as history, within their own budget. Only new
assistant texts are under the loss mask, so each is a target exactly once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside texts and
roles ``<|`` is written ``<||``, so no control string occurs in them; a line
feed in a role is written ``<|n|>``.

Results for odd input: null roles and texts are empty; turns are ordered by
(turn, role, text), so ties and repeated rows have a place; null conv_ids are
one conversation; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens (words, and FRAME for a turn's frame) in a window, for history in it, and turns of history.
BUDGET, HISTORY_BUDGET, HISTORY_TURNS, FRAME = 1024, 192, 2, 4
START, END = "<|im_start|>", "<|im_end|>\n"


def _escaped(x) -> F.Column:
    return F.replace(x, F.lit("<|"), F.lit("<||"))


def _plain(x) -> F.Column:
    return F.replace(x, F.lit("<||"), F.lit("<|"))


def format_chats(conversations: DataFrame, budget: int = BUDGET, history_budget: int = HISTORY_BUDGET, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """A row per window: conv_id, window_id, text, n_repeated (leading turns seen before) and loss (start and length of each target, in characters)."""
    empty = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + FRAME)
    conv = Window.partitionBy("conv_id")
    ordered = conv.orderBy("turn", "role", "text")
    to_here = ordered.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ord", F.row_number().over(ordered) - 1)
    rows = rows.withColumn("system", (F.col("ord") == 0) & (F.col("role") == "system"))
    rows = rows.withColumn("lead", F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(conv))
    width = F.greatest(F.lit(64), ((budget - history_budget - F.least("lead", F.lit(budget // 4))) / 2).cast("int"))
    rows = rows.withColumn("width", width).withColumn("own", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    rows = rows.withColumn("long", F.col("own") > F.col("width"))
    rows = rows.withColumn("cut", (F.col("long") | F.coalesce(F.lag("long").over(ordered), F.lit(False))).cast("int"))
    rows = rows.withColumn("part", F.sum("cut").over(to_here)).withColumn("before", F.sum("own").over(to_here) - F.col("own"))
    rows = rows.withColumn("step", F.floor((F.col("before") - F.min("before").over(Window.partitionBy("conv_id", "part"))) / F.col("width")))
    rows = rows.withColumn("step", F.when(F.col("system"), 0).otherwise(F.col("step")))
    rows = rows.withColumn("win", F.dense_rank().over(conv.orderBy("part", "step")) - 1)
    rows = rows.withColumn("wins", F.max("win").over(conv) + 1)
    back = Window.partitionBy("conv_id", "win").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("again", ~F.col("system") & (F.count(F.lit(1)).over(back) <= history_turns) & (F.sum("own").over(back) <= history_budget) & (F.col("win") + 1 < F.col("wins")))

    place = lambda w, old: F.struct(w.cast("int").alias("win"), old.alias("old"))
    first = place(F.col("win"), F.lit(False))
    places = (
        F.when(F.col("system"), F.transform(F.sequence(F.lit(0), F.col("wins") - 1), lambda i: place(i, i > 0)))
        .when(F.col("again"), F.array(first, place(F.col("win") + 1, F.lit(True))))
        .otherwise(F.array(first))
    )
    head = F.concat(F.lit(START), F.replace(_escaped("role"), F.lit("\n"), F.lit("<|n|>")), F.lit("\n"))
    body = _escaped("text")
    out = rows.select("conv_id", "ord", "role", head.alias("head"), body.alias("body"), F.explode(places).alias("at"))
    out = out.select("conv_id", "at.win", "at.old", "ord", "role", F.concat("head", "body", F.lit(END)).alias("piece"), F.char_length("head").alias("h"), F.char_length("body").alias("b"))
    inside = Window.partitionBy("conv_id", "win").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("from", F.sum(F.char_length("piece")).over(inside) - F.char_length("piece"))
    target = F.when((F.col("role") == "assistant") & ~F.col("old"), F.struct((F.col("from") + F.col("h")).cast("long").alias("start"), F.col("b").cast("long").alias("length")))
    out = out.select("conv_id", "win", "old", F.struct("ord", "piece").alias("p"), target.alias("target"))
    grouped = out.groupBy("conv_id", "win").agg(F.sort_array(F.collect_list("p")).alias("ps"), F.sort_array(F.collect_list("target")).alias("loss"), F.sum(F.col("old").cast("int")).cast("int").alias("n_repeated"))
    return grouped.select("conv_id", F.col("win").alias("window_id"), F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("text"), "n_repeated", "loss")


def read_back(windows: DataFrame) -> DataFrame:
    """What formatted windows hold, from their text and loss spans alone: a row per window with its new turns and its targets."""
    pieces = F.split("text", r"<\|im_start\|>", -1)
    new = F.slice(pieces, F.col("n_repeated") + 2, F.size(pieces))

    def turn(p):
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.char_length(role) + 2, F.char_length(p) - F.char_length(role) - 1 - len(END))
        return F.struct(_plain(F.replace(role, F.lit("<|n|>"), F.lit("\n"))).alias("role"), _plain(body).alias("text"))

    targets = F.transform("loss", lambda s: _plain(F.substring(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return windows.select("conv_id", "window_id", F.transform(new, turn).alias("turns"), targets.alias("targets"), F.char_length("text").alias("chars"))


def chat_report(conversations: DataFrame) -> DataFrame:
    """Per conversation, the digests of what can be read back from its windows."""
    back = read_back(format_chats(conversations))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    row = F.struct("window_id", said.alias("said"), F.array_join("targets", "").alias("loss"))
    per = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("w"), F.sum(F.size("turns")).cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    turns = F.array_join(F.transform("w", lambda x: x["said"]), "")
    return per.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
