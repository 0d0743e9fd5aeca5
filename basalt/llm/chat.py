"""Chat formatting by quotation linking: replies find what they quote, and keep only their own words.

A line's quote level is the number of leading '>' marks (blanks between them allowed). Quoted lines are normalised
(marks off, blanks folded, lower case), hashed, and joined to the message of the same conversation that first wrote
that line itself at an earlier turn. A message answers the message that most of its level-1 lines come from (the
latest of equals); if nothing it quotes is found at level 1, the best of its deeper levels; else the message before
it. So a parent's turn is never later than its reply's, and turn order is reply order.

Nulls: a null text is empty; rows with a null conversation form one; null turns sort last and quote nothing. Messages
with equal turns are ordered by role and text. Long conversations are ranked by blocks of TURNS turns, not in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MARKS = "^((?:[ \\t]*>)+)"
TURNS = 1024


def quoted_lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, level, line (normalised): the lines that say something."""
    lines = messages.select("conv_id", "turn", "role", "text", F.explode(F.split("text", "\n")).alias("raw"))
    level = F.length(F.translate(F.regexp_extract("raw", MARKS, 1), " \t", ""))
    said = F.lower(F.trim(F.regexp_replace(F.regexp_replace("raw", MARKS, ""), "[ \\t]+", " ")))
    return lines.select("conv_id", "turn", "role", "text", level.alias("level"), said.alias("line")).where("line <> ''")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_quoted, n_linked, answers: for messages that quote."""
    lines = quoted_lines(messages)
    quotes = lines.where((F.col("level") > 0)).withColumn("h", F.xxhash64("line"))
    # only conversations with quotes are searched, each line once: where it was first written
    own = lines.where((F.col("level") == 0) & F.col("turn").isNotNull()).withColumn("h", F.xxhash64("line"))
    wanted = quotes.select("conv_id", "h").distinct()
    first = own.alias("o").join(wanted.alias("w"), F.col("o.conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("o.h") == F.col("w.h")), "left_semi")
    first = first.groupBy("conv_id", "line").agg(F.min("turn").alias("source"))
    found = quotes.alias("q").join(first.alias("f"), F.col("q.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("q.line") == F.col("f.line")) & (F.col("f.source") < F.col("q.turn")), "left")
    by_source = found.groupBy("q.conv_id", "q.turn", "q.role", "q.text", "level", "source").agg(F.count("*").alias("n"))
    best = F.max_by("source", F.when(F.col("source").isNotNull(), F.struct(-F.col("level"), F.col("n"), F.col("source"))))
    return by_source.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("source").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"), best.alias("answers"))


def build_conversations(messages: DataFrame) -> DataFrame:
    """messages: conv_id, turn, role, text. Returns conv_id, turn, role, body, n_quoted, n_linked, parent_turn, position."""
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    marked = rows.where(F.col("text").rlike("(?m)^[ \\t]*>"))
    talks = marked.select("conv_id").distinct()
    talking = rows.alias("r").join(talks.alias("t"), F.col("r.conv_id").eqNullSafe(F.col("t.conv_id")), "left_semi")
    linked = link_quotes(talking)
    block = F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(1 << 60))
    order = [F.asc_nulls_last("turn"), F.asc_nulls_first("role"), F.asc("text")]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    ranked = rows.withColumn("block", block).withColumn("rn", F.row_number().over(inside)).withColumn("prev", F.lag("turn").over(inside))
    blocks = rows.withColumn("block", block).groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    before = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"), F.lag("last").over(before).alias("last_before"))
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    placed = ranked.alias("a").join(blocks.alias("b"), same & (F.col("a.block") == F.col("b.block"))).select("a.conv_id", "a.turn", "a.role", "a.text", (F.col("rn") + F.col("earlier")).cast("long").alias("position"), F.when(F.col("rn") == 1, F.col("last_before")).otherwise(F.col("prev")).alias("before"))
    match = [F.col(f"p.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ("conv_id", "turn", "role", "text")]
    out = placed.alias("p").join(linked.alias("l"), match, "left")
    body = F.array_join(F.filter(F.split("p.text", "\n"), lambda x: ~x.rlike("^[ \\t]*>")), "\n")
    return out.select("p.conv_id", "p.turn", "p.role", body.alias("body"), F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("answers", "before").alias("parent_turn"), "position")
