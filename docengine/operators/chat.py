"""Conversations as message rows ``(conv_id, turn, role, text)``.

A conversation may be very long, so ordered collections are built in two
steps: blocks of consecutive turns first, which spread a long conversation over
tasks, then one row per block is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.text import json_string
from docengine.schemas import TOOL_CALL, TOOL_RESULT

BLOCK = 256

# Fixed formats of rendered and recorded tool messages.
CALL_TAG = "tool_call"
RESULT_TAG = "tool_call_result"
RECORDED_CALL = r"(?s)<uc_function_call>(.*?)</uc_function_call>"
RECORDED_RESULT = r"(?s)<uc_function_result>(.*?)</uc_function_result>"


def prepend_system(messages: DataFrame, prompt: str) -> DataFrame:
    """Every conversation starts with ``prompt`` as a system message, also one that has
    a system message of its own: it is added before the first turn."""
    first = messages.groupBy("conv_id").agg(F.min("turn").alias("first"))
    added = first.select(
        "conv_id",
        (F.least("first", F.lit(0)) - 1).cast("bigint").alias("turn"),
        F.lit("system").alias("role"),
        F.lit(prompt).alias("text"),
    )
    return messages.select("conv_id", "turn", "role", "text").unionByName(added)


def prepend_system_message(messages: Column, prompt: str) -> Column:
    """The same for a column ``array<struct<role, content>>``."""
    system = F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content"))
    return F.array_prepend(messages, system)


def _object(**fields: Column) -> Column:
    """A JSON object in two-space indentation."""
    parts: list[Column] = []
    for i, (name, value) in enumerate(fields.items()):
        parts += [F.lit(("{\n" if i == 0 else ",\n") + f'  "{name}": '), value]
    return F.concat(*parts, F.lit("\n}"))


def rendered_call(call_id: Column, name: Column, arguments: Column) -> Column:
    """A tool call as tagged JSON; the arguments are JSON text inside it."""
    body = _object(
        id=json_string(call_id), name=json_string(name), arguments=json_string(arguments)
    )
    return F.concat(F.lit(f"<{CALL_TAG}>"), body, F.lit(f"</{CALL_TAG}>"))


def rendered_result(call_id: Column, content: Column) -> Column:
    body = _object(id=json_string(call_id), content=json_string(content))
    return F.concat(F.lit(f"<{RESULT_TAG}>"), body, F.lit(f"</{RESULT_TAG}>"))


def arguments_json(arguments: Column) -> Column:
    """A map of arguments as JSON text, ``{}`` when there are none."""
    return F.coalesce(F.to_json(arguments), F.lit("{}"))


def rendered_message(
    kind: str = "kind",
    text: str = "text",
    call_id: str = "call_id",
    tool_calls: str = "tool_calls",
) -> Column:
    """One message as text: a tool result, its tool calls, or its content.

    ``tool_calls`` is ``array<struct<id, name, arguments: map<string,string>>>``.
    """
    calls = F.array_join(
        F.transform(
            F.col(tool_calls),
            lambda call: rendered_call(
                call["id"], call["name"], arguments_json(call["arguments"])
            ),
        ),
        "",
    )
    return (
        F.when(F.col(kind) == "tool", rendered_result(F.col(call_id), F.col(text)))
        .when(F.size(F.coalesce(F.col(tool_calls), F.array())) > 0, calls)
        .otherwise(F.coalesce(F.col(text), F.lit("")))
    )


def _in_order(value: Column) -> Column:
    """Collected ``struct<turn, ...>`` in turn order."""
    return F.array_sort(F.collect_list(value))


def transcript(messages: DataFrame, rendered: Column) -> DataFrame:
    """One text per conversation: rendered messages, a blank line after each."""
    blocks = (
        messages.select(
            "conv_id",
            F.floor(F.col("turn") / BLOCK).alias("block"),
            F.struct(F.col("turn"), F.concat(rendered, F.lit("\n\n")).alias("text")).alias("m"),
        )
        .groupBy("conv_id", "block")
        .agg(F.array_join(F.transform(_in_order(F.col("m")), lambda m: m["text"]), "").alias("text"))
    )
    return blocks.groupBy("conv_id").agg(
        F.array_join(
            F.transform(_in_order(F.struct("block", "text")), lambda b: b["text"]), ""
        ).alias("transcript")
    )


def finished(messages: DataFrame) -> DataFrame:
    """Whether a conversation ended: its last message calls no tool."""
    calls = F.size(F.coalesce(F.col("tool_calls"), F.array()))
    return messages.groupBy("conv_id").agg(
        (F.max_by(calls, F.col("turn")) == 0).alias("finished")
    )


def chat_history(messages: DataFrame) -> DataFrame:
    """``messages``: all messages of the conversation up to and with each turn.

    The prefixes within a block of turns come from a window over the block. What
    precedes a block is put together once per block, from copies of the earlier blocks
    sent there: the work of a long conversation is spread over (conversation, block),
    and only block numbers are ordered by conversation.
    """
    said = F.struct("turn", "role", F.col("text").alias("content"))
    placed = messages.select(
        "conv_id", "turn", F.floor(F.col("turn") / BLOCK).alias("block"), said.alias("said")
    )
    block = Window.partitionBy("conv_id", "block").orderBy("turn")
    inside = placed.select(
        "conv_id",
        "turn",
        "block",
        F.collect_list("said").over(block.rowsBetween(Window.unboundedPreceding, 0)).alias("here"),
    )
    conversation = Window.partitionBy("conv_id")
    numbered = placed.select("conv_id", "block").distinct().select(
        "conv_id",
        "block",
        F.row_number().over(conversation.orderBy("block")).alias("number"),
        F.count(F.lit(1)).over(conversation).cast("int").alias("last"),
    )
    sent = (
        placed.groupBy("conv_id", "block")
        .agg(_in_order(F.col("said")).alias("all_said"))
        .join(numbered.filter("number < last"), ["conv_id", "block"])
        .select(
            "conv_id",
            F.struct("block", "all_said").alias("part"),
            F.explode(F.sequence(F.col("number") + 1, F.col("last"))).alias("number"),
        )
    )
    blocks = (
        sent.groupBy("conv_id", "number")
        .agg(
            F.flatten(F.transform(_in_order(F.col("part")), lambda part: part["all_said"])).alias(
                "earlier"
            )
        )
        .join(numbered.drop("last"), ["conv_id", "number"])
        .drop("number")
    )
    history = F.concat(
        F.coalesce(F.col("earlier"), F.array().cast("array<struct<turn:bigint,role:string,content:string>>")),
        F.col("here"),
    )
    return inside.join(blocks, ["conv_id", "block"], "left").select(
        "conv_id",
        "turn",
        F.transform(history, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias(
            "messages"
        ),
    )


def tool_calls(messages: DataFrame, text: str = "text") -> DataFrame:
    """Tool calls recorded in message texts, each with its result if there is one."""

    def recorded(pattern: str, schema: str, *fields: Column) -> DataFrame:
        blocks = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
        return (
            messages.filter(F.col(text).contains("<uc_function_"))
            .select("conv_id", "turn", F.explode(blocks).alias("block"))
            .select("conv_id", "turn", F.from_json("block", schema).alias("tool"))
            .filter(F.col("tool.id").isNotNull())
            .select("conv_id", *fields)
        )

    calls = recorded(
        RECORDED_CALL, TOOL_CALL, F.col("turn"), F.col("tool.id").alias("call_id"),
        F.col("tool.name").alias("name"), F.col("tool.arguments").alias("arguments"),
    )
    results = recorded(
        RECORDED_RESULT, TOOL_RESULT, F.col("tool.id").alias("call_id"),
        F.col("tool.content").alias("result"),
    )
    return calls.join(results, ["conv_id", "call_id"], "left")
