"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered with that speaker as the
assistant and the others as named users, with the character spans that training may learn from
(the assistant's texts).  DataFrame functions only.

A dialogue's rendering stands in rows of at most ``part_turns`` turns: ``part`` numbers them,
``start`` is where a row's text begins in the whole, and spans count from the beginning of the
whole, so the texts of a view put together in order are the dialogue and nothing is cut.  Turns
are numbered by ranges of the sorted table, not by conversation, so neither a conversation that
holds a third of all rows nor turns that repeat a number make a task hold more than a range of
rows or a group hold more than ``part_turns``.

Roles in ``STANDING`` (system) take no perspective and are rendered as they are.  Rows are
ordered by turn (null first), role and text; repeated rows stay.  Null texts are empty, a null
role is the participant ``unknown``; null conversation ids form one conversation.  A
conversation without participants gives no rows, an empty table none.  The marks of the
template are broken up where texts hold them.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import stored

STANDING = ("system",)
PART_TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, role, text and k: the place of each row in its conversation."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("unknown" if c == role_col else "")), r"<\|", "< |")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["turn", "role", "text", "row"]
    # the ranges are drawn from a sample, so they must not be drawn twice
    ranges = stored(rows.repartitionByRange("conv", *order).withColumn("range", F.spark_partition_id()), "turns")
    before = ranges.groupBy(F.col("conv").alias("of"), F.col("range").alias("in")).agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("of").orderBy("in").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(W.partitionBy("range", "conv").orderBy(*order)) - 1
    placed = ranges.withColumn("place", place).join(before, F.col("conv").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    return placed.select("conv", "role", "text", (F.col("before") + F.col("place")).alias("k"))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation, participant and part: conv, part, perspective, start, n_turns, n_target_turns, n_target_chars, text, spans array<struct<start, end>>."""
    rows = numbered_turns(turns, conv_col, turn_col, role_col, text_col).withColumn("part", F.floor(F.col("k") / part_turns))
    people = rows.where(~F.col("role").isin(*STANDING)).select(F.col("conv").alias("of"), F.col("role").alias("perspective")).distinct()
    parts = rows.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("k", "role", "text"))).alias("turns"))
    # how long a part is: as a bystander sees it, and what changes where a message is the perspective's own
    user = F.when(F.col("role").isin(*STANDING), F.col("role")).otherwise(F.concat(F.lit("user name="), F.col("role")))
    frame = len(OPEN) + len(CLOSE) + 2
    sizes = rows.groupBy(F.col("conv").alias("c"), F.col("part").alias("p")).agg(F.sum(F.length(user) + F.length("text") + frame).alias("size"))
    own = rows.groupBy(F.col("conv").alias("oc"), F.col("part").alias("op"), F.col("role").alias("orole")).agg(F.count("*").alias("own"))
    grid = sizes.join(people, F.col("c").eqNullSafe(F.col("of"))).join(own, F.col("c").eqNullSafe(F.col("oc")) & (F.col("p") == F.col("op")) & (F.col("perspective") == F.col("orole")), "left")
    length = F.col("size") + F.coalesce("own", F.lit(0)) * (len("assistant") - len("user name=") - F.length("perspective"))
    earlier = W.partitionBy("c", "perspective").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    grid = grid.select("c", "p", "perspective", F.coalesce(F.sum(length).over(earlier), F.lit(0)).alias("start"))
    views = parts.join(grid, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")

    standing = ", ".join(f"'{s}'" for s in STANDING)
    head = f"case when t.role = perspective then 'assistant' when t.role in ({standing}) then t.role else concat('user name=', t.role) end"
    # messages first; their lengths then give the spans
    views = views.withColumn("messages", F.expr(f"transform(turns, t -> named_struct('head', concat('{OPEN}', {head}, '\\n'), 'text', t.text, 'mine', t.role = perspective))"))
    step = f"""named_struct('at', a.at + length(m.head) + length(m.text) + {len(CLOSE) + 1},
        'spans', if(m.mine, concat(a.spans, array(named_struct('start', a.at + length(m.head), 'end', a.at + length(m.head) + length(m.text)))), a.spans))"""
    spans = f"aggregate(messages, named_struct('at', start, 'spans', cast(array() as array<struct<start: bigint, end: bigint>>)), (a, m) -> {step}).spans"
    return views.select(
        "conv", "part", "perspective", "start", F.size("turns").cast("long").alias("n_turns"),
        F.expr("cast(size(filter(messages, m -> m.mine)) as bigint)").alias("n_target_turns"),
        F.expr("aggregate(messages, 0L, (a, m) -> a + if(m.mine, length(m.text), 0))").alias("n_target_chars"),
        F.expr(f"array_join(transform(messages, m -> concat(m.head, m.text, '{CLOSE}\\n')), '')").alias("text"), F.expr(spans).alias("spans"),
    ).withColumnRenamed("conv", conv_col)
