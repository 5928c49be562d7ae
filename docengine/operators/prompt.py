"""Prompts around retrieved passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import fill_template

# Fixed value: how one passage is written into the context.
PASSAGE = "Passage: {chunk_text}\n"

PROMPT = (
    "Answer from the passages only.\n"
    "Conversation so far: {chat_history}\n"
    "Context: {context}\n"
    "Question: {question}"
)


def context_of(
    results: DataFrame,
    question: str = "question_id",
    content: str = "content",
    template: str = PASSAGE,
) -> DataFrame:
    """One context string per question: its k passages in rank order."""
    passages = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("rank"), fill_template(template, chunk_text=F.col(content)).alias("passage")
            )
        )
    )
    return results.groupBy(question).agg(
        F.array_join(F.transform(passages, lambda each: each["passage"]), "").alias("context")
    )


def with_prompt(
    questions: DataFrame,
    template: str = PROMPT,
    context: str = "context",
    chat_history: str | Column = "chat_history",
    question: str = "question",
) -> DataFrame:
    """Add ``prompt``: the template with context, history and question put in."""
    history = F.col(chat_history) if isinstance(chat_history, str) else chat_history
    empty = F.lit("")
    return questions.withColumn(
        "prompt",
        fill_template(
            template,
            context=F.coalesce(F.col(context), empty),
            chat_history=F.coalesce(history, empty),
            question=F.coalesce(F.col(question), empty),
        ),
    )
