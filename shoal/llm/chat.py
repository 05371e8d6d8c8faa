r"""Conversations as training text, with Spark expressions only.

Template: a block of adjacent turns of one role is ``<turn role>`` then its texts, parted by
``<next>``, then ``</turn>`` and a line feed. Inside roles and texts ``\`` is written ``\b``,
``<`` is ``\l`` and ``>`` is ``\g``, so a control string never stands in a text and reading back is
exact. The loss mask covers the texts of the trained role, not the control strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT, END = "<turn ", ">", "<next>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: (conv_id, formatted, loss_spans, n_blocks).

    Rows are ordered by turn, then role, then text; a null turn comes first, a null role or text is empty,
    repeated rows are turns of their own, rows with null conv_id are one conversation. Adjacent turns of
    one role share a block. ``loss_spans`` holds (start, end) in code points of each text of ``trained_role``, in order.
    """
    struct = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(struct)).alias("turns"))
    # Per turn: what stands before its text, the text, what stands after it.
    n = F.size("turns")

    def piece(t: Column, i: Column) -> Column:
        begins = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        ends = (i == n - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        return F.struct(F.when(begins, F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE))).otherwise(F.lit(NEXT)).alias("before"),
                        escape(t["text"]).alias("text"), F.when(ends, F.lit(END)).otherwise(F.lit("")).alias("after"),
                        (t["role"] == F.lit(trained_role)).alias("trained"), begins.alias("begins"))

    pieces = sorted_turns.withColumn("pieces", F.transform("turns", piece))
    joined = pieces.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), ""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def span(acc: Column, p: Column) -> Column:
        first = acc["at"] + F.length(p["before"])
        last = first + F.length(p["text"])
        return F.struct((last + F.length(p["after"])).alias("at"),
                        F.when(p["trained"], F.concat(acc["spans"], F.array(F.struct(first.alias("start"), last.alias("end")))))
                        .otherwise(acc["spans"]).alias("spans"))

    return joined.select("conv_id", "formatted", F.aggregate("pieces", start, span)["spans"].alias("loss_spans"),
                         F.size(F.filter("pieces", lambda p: p["begins"])).cast("long").alias("n_blocks"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars, n_blocks) read from ``formatted`` and ``loss_spans``; turns are structs (role, text) as they were given."""
    blocks = F.filter(F.split("formatted", END), lambda b: b != "")

    def read(block: Column) -> Column:
        role = F.substring(F.substring_index(block, CLOSE, 1), len(OPEN) + 1, 1 << 30)
        body = F.substring(block, F.length(F.substring_index(block, CLOSE, 1)) + len(CLOSE) + 1, F.lit(1 << 30))
        return F.transform(F.split(body, NEXT), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", F.flatten(F.transform(blocks, read)).alias("turns"), F.array_join(loss, "").alias("loss_text"),
                            F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks")
