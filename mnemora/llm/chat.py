"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted by (turn, role, text), runs of one role
are merged into one block, and the blocks become one string:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

Inside texts and roles every "<", backslashes, "|" gets one more backslash, so no text can hold a
control string, and taking one backslash away restores it. A newline inside a role is written
<|im_nl|>. `loss_spans` holds the code-point offset and length of each assistant text.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own; equal turns
are ordered by role, then text, and each repeated row is a turn; no rows give no conversations; other
columns, whatever their names, are ignored; texts of any length are taken whole, and the time grows as n log n with the
turns of a conversation. One conversation becomes one string, so it has to fit in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|im_nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def format_chat(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation of (conv_id, turn, role, text)."""
    blank = F.lit("")
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), blank).alias("role"),
            F.coalesce(F.col("text"), blank).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    starts = sorted_turns.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(1), F.size("ts")),
            lambda i: (i == 1) | (F.element_at("ts", i)["role"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["role"]),
        ),
    )
    after = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("ts") + 1))
    blocks = starts.withColumn(
        "blocks",
        F.zip_with(
            "starts",
            after,
            lambda a, b: F.struct(
                F.element_at("ts", a)["role"].alias("role"),
                F.transform(F.slice("ts", a, b - a), lambda t: escape(t["text"])).alias("texts"),
            ),
        ),
    )
    head = lambda b: F.concat(F.lit(START), F.replace(escape(b["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    written = blocks.withColumn("parts", F.transform("blocks", lambda b: F.struct(head(b).alias("head"), b["texts"].alias("texts"), (b["role"] == train_role).alias("loss"))))
    # of each text: the characters from the end of the one before to its start, its own, and whether it counts
    pieces = F.flatten(
        F.transform(
            "parts",
            lambda p, k: F.transform(
                p["texts"],
                lambda t, i: F.struct(
                    F.when(i > 0, len(SEP)).otherwise(F.length(p["head"]) + F.when(k > 0, len(END)).otherwise(0)).alias("gap"), F.length(t).alias("length"), p["loss"].alias("loss")
                ),
            ),
        )
    )
    body = written.withColumn("pieces", pieces).withColumn("ends", running(F.transform("pieces", lambda p: p["gap"] + p["length"])))
    spans = F.transform(
        F.filter(F.arrays_zip("pieces", "ends"), lambda x: x["pieces"]["loss"]),
        lambda x: F.struct((x["ends"] - x["pieces"]["length"]).alias("start"), x["pieces"]["length"].alias("length")),
    )
    return body.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], F.array_join(p["texts"], SEP), F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def running(numbers: Column) -> Column:
    """Running sums of an array: each step adds to every element the one 1, 2, 4, ... places before it, so n elements
    take some n log n additions."""
    shifted = lambda a, k: F.concat(F.array_repeat(F.lit(0), k), F.slice(a, F.lit(1), F.size(a) - k))
    step = lambda a, k: F.when(F.size(a) > k, F.zip_with(a, shifted(a, k), lambda x, y: x + y)).otherwise(a)
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(30)]), numbers, step)


def read_turns(formatted: Column) -> Column:
    """array<struct<role, texts>> parsed back from a formatted string."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")
    role = lambda b: F.substring_index(b, "\n", 1)
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.replace(F.substring(role(b), len(START) + 1, 2**31 - 1), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            F.transform(
                F.split(F.substring(b, F.length(role(b)) + 2, F.lit(2**31 - 1)), r"<\|im_sep\|>", -1), unescape
            ).alias("texts"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The original texts under the loss mask, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
