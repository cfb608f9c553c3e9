"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into one message, whose
texts stay apart by a separator mark; messages are concatenated:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

Control strings inside texts and roles are escaped reversibly: \\ becomes \\\\, <| becomes <\\|, and a line feed in a role <\\N|. No
escaped text holds <|, so every mark in the output is one of the template's, and reading back gives the turns as they were.

The loss mask comes with the output as runs (length, in_loss) of code points that cover it in order; only the texts of the loss
role are inside. read_back takes both apart again.

Turns go by turn, then role, then text, nulls first; rows that repeat are turns that repeat. Null texts and roles are empty. Null
conversation ids are one conversation. Other columns are not read. A conversation is one row of the output, so its turns meet in
one task; partial aggregation joins what each task has of it before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\N|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\N|"), F.lit("\n")))


def _messages(turns: Column) -> Column:
    """Sorted turns as messages (role, parts): a message starts where the role changes and holds the slice up to the next start.

    Neighbours meet through zip_with: an array named inside a lambda function would be computed anew for every element.
    """
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: t["role"]))
    changes = F.zip_with(turns, before, lambda t, role: F.coalesce(t["role"] != role, F.lit(True)))
    starts = F.filter(F.transform(changes, lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
    stops = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns)))

    def message(start: Column, stop: Column) -> Column:
        parts = F.slice(turns, start + 1, stop - start)
        return F.struct(F.get(parts, F.lit(0))["role"].alias("role"), F.transform(parts, lambda t: t["text"]).alias("parts"))

    return F.zip_with(starts, stops, message)


def format_conversations(rows: DataFrame, loss_role: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_runs, n_messages), one row for each conversation."""
    entry = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(entry)).alias("turns"))
    merged = turns.select("conv_id", _messages(F.col("turns")).alias("messages"))

    def header(m: Column) -> Column:
        return F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"))

    def run(length: Column, inside: Column) -> Column:
        return F.struct(length.cast("long").alias("length"), inside.alias("in_loss"))

    def runs(m: Column) -> Column:
        last = F.size(m["parts"]) - 1
        body = F.transform(m["parts"], lambda p, i: F.array(run(F.length(escape(p)), m["role"] == loss_role), run(F.when(i == last, len(END)).otherwise(len(SEP)), F.lit(False))))
        return F.concat(F.array(run(F.length(header(m)), F.lit(False))), F.flatten(body))

    body = F.transform("messages", lambda m: F.concat(header(m), F.array_join(F.transform(m["parts"], escape), SEP), F.lit(END)))
    return merged.select("conv_id", F.array_join(body, "").alias("formatted"), F.flatten(F.transform("messages", runs)).alias("loss_runs"), F.size("messages").cast("long").alias("n_messages"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns, an array of (role, text), and loss_text, what the mask covers; both parsed from the output."""
    blocks = F.split("formatted", "<\\|im_end\\|>\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def block(b: Column) -> Column:
        cut = F.locate("\n", b)
        return F.struct(F.substr(b, F.lit(1), cut).alias("header"), F.split(F.substr(b, cut + 1), "<\\|im_sep\\|>", -1).alias("parts"))

    parsed = formatted.withColumn("blocks", F.transform(blocks, block))

    def turns(b: Column) -> Column:
        role = unescape_role(F.substr(b["header"], F.lit(len(START) + 1), F.length(b["header"]) - len(START) - 1))
        return F.transform(b["parts"], lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    def pieces(b: Column) -> Column:
        last = F.size(b["parts"]) - 1
        return F.concat(F.array(b["header"]), F.flatten(F.transform(b["parts"], lambda p, i: F.array(p, F.when(i == last, END).otherwise(SEP)))))

    parsed = parsed.withColumns({"turns": F.flatten(F.transform("blocks", turns)), "pieces": F.flatten(F.transform("blocks", pieces))}).drop("blocks")

    def masked(p: Column, run: Column) -> Column:
        fits = F.coalesce(run["length"] == F.length(p), F.lit(False))
        return F.when(~fits, F.raise_error(F.lit("the loss mask does not fit the text"))).when(run["in_loss"], unescape(p)).otherwise("")

    return parsed.withColumn("loss_text", F.array_join(F.zip_with("pieces", "loss_runs", masked), "")).drop("pieces")
