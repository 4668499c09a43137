"""Conversations as training texts, in Spark expressions only.

The rows of a conversation are collected as structs and sorted by (turn, role, text),
null turns first. Adjacent turns of one role become one block with several texts:

  <|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>

In roles and texts a backslash is doubled, and a backslash goes in after the first
character of every control string (these marks and those of other common templates),
so no text can forge a mark and the texts come back exactly. `loss_spans` has the code
points [start, end) of each text of the roles to learn.

Null roles and texts count as empty. Equal rows are turns of their own. A null conv_id
is a conversation like any other. A conversation is one value, so it has to fit into a
row (2 GB). No rows give no conversations. Extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    separator: str = "<|im_sep|>"
    next: str = "<|im_next|>"
    end: str = "<|im_end|>"
    #: None may hold a backslash after its first character, or be a single one.
    controls: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: tuple[str, ...] = ("assistant",)


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.controls:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, formatted, loss_spans per conversation."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.struct(
        F.col("turn").alias("turn"), role.alias("role"), text.alias("text"),
        escape(role, template).alias("safe_role"), escape(text, template).alias("safe_text"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def begins(x: Column, i: Column) -> Column:
        return (i == 0) | (F.get("turns", i - 1)["role"] != x["role"])

    starts = F.filter(
        F.transform("turns", lambda x, i: F.when(begins(x, i), i + 1)), lambda p: p.isNotNull()
    )
    with_starts = sorted_turns.withColumn("starts", starts)
    block = F.transform("starts", lambda p, k: F.struct(
        F.get("turns", p - 1)["role"].alias("role"),
        F.get("turns", p - 1)["safe_role"].alias("safe_role"),
        F.transform(
            F.slice("turns", p, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - p), lambda x: x["safe_text"]
        ).alias("texts"),
    ))
    blocks = with_starts.select("conv_id", block.alias("blocks"))
    head = lambda b: F.concat(F.lit(template.start), b["safe_role"], F.lit(template.separator))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(
        head(b), F.array_join(b["texts"], template.next), F.lit(template.end)
    )), "")
    # Per text: the marks before it, its length, whether it is learned.
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, i: F.struct(
        F.when(i == 0, F.length(head(b))).otherwise(F.lit(len(template.next))).cast("long").alias("before"),
        F.length(t).cast("long").alias("length"),
        F.when(i == F.size(b["texts"]) - 1, F.lit(len(template.end))).otherwise(F.lit(0)).cast("long").alias("after"),
        b["role"].isin(*template.learned).alias("learned"),
    ))))
    empty = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>))")

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + p["before"]
        span = F.array(F.struct(begin.alias("start"), (begin + p["length"]).alias("end")))
        return F.struct(
            (begin + p["length"] + p["after"]).alias("at"),
            F.when(p["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    spans = F.aggregate(pieces, empty, step, lambda state: state["spans"])
    return blocks.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def parse_conversations(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, turns (role, text) and the learned text, from the formatted text alone."""
    cut = lambda text, mark: F.split(text, re.escape(mark), -1)
    blocks = F.filter(cut(F.col("formatted"), template.end), lambda b: b != "")

    def block_turns(b: Column) -> Column:
        parts = cut(b, template.separator)
        role = unescape(F.substr(parts[0], F.lit(len(template.start) + 1)))
        return F.transform(cut(parts[1], template.next), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    learned = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    )), "")
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, block_turns)).alias("turns"), learned.alias("learned"))


def digests(parsed: DataFrame) -> DataFrame:
    """Counts and checksums of what was read back."""
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
