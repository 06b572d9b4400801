"""From passages to a cited answer: history, prompts, refusal, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import CITATION

SYSTEM_PROMPT = "Answer from the numbered passages alone. Put the number of each passage you use in square brackets after the statement. Say so if the passages do not hold the answer. Use the language of the question."
CONDENSE_PROMPT = "Rewrite the last question as one question that can be read without the conversation. Give the question only."
NO_CONTEXT_ANSWER = "The documents hold nothing that answers this question."
HISTORY_TURNS, HISTORY_CHARS = 3, 400


def history_window(turns: DataFrame, exchanges: int = HISTORY_TURNS, chars: int = HISTORY_CHARS) -> DataFrame:
    """(conv_id, position, question, answer): the last exchanges in order, answers cut to `chars`.

    An exchange is a user turn and the assistant turn after it. None are kept for `exchanges` 0.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.withColumn("answer", F.lead("text").over(order)).withColumn("_next", F.lead("role").over(order))
    pairs = after.filter((F.col("role") == "user") & (F.col("_next") == "assistant")).select("conv_id", "turn", F.col("text").alias("question"), F.left("answer", F.lit(chars)).alias("answer"))
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return pairs.withColumn("_back", back).filter(F.col("_back") <= exchanges).select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("position"), "question", "answer")


def condense_prompt(history: DataFrame, followups: DataFrame) -> DataFrame:
    """(conv_id, prompt): the kept exchanges and the question that follows them."""
    line = F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), "answer")
    told = history.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("told"))
    return followups.join(told, "conv_id").select("conv_id", F.concat(F.lit(CONDENSE_PROMPT + "\n\n"), "told", F.lit("\nLast question: "), "question").alias("prompt"))


def standalone(turns: DataFrame, followups: DataFrame, complete: Callable[[Column, Column], Column]) -> DataFrame:
    """(conv_id, question, text): questions and what they are searched by, which needs no conversation.

    A question with exchanges before it is rewritten by the model, of whose answer the first line counts; one without,
    or for which the model gives nothing, stays as it is. `followups` (conv_id, question) has one row a conversation.
    """
    asked = condense_prompt(history_window(turns), followups)
    rewritten = asked.select("conv_id", complete(F.lit(CONDENSE_PROMPT), F.col("prompt")).alias("_rewritten"))
    return followups.join(rewritten, "conv_id", "left").select("conv_id", "question", condensed(F.col("question"), F.col("_rewritten")).alias("text"))


def condensed(question: Column, rewritten: Column) -> Column:
    """The first line of a rewritten question; the question itself where a model gave nothing."""
    first = F.trim(F.element_at(F.split(F.trim(rewritten), "\n", 2), 1))
    return F.coalesce(F.nullif(first, F.lit("")), question)


def context_block(passages: DataFrame) -> DataFrame:
    """(query_id, context, passages): `[n] (location)` and the text of each passage in rank order.

    `passages` (query_id, rank, location, text) are selected ones: at most top_k a query.
    """
    entry = F.struct("rank", "location", "text")
    held = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    block = F.array_join(F.transform("_p", lambda p, i: F.concat(F.lit("["), i + 1, F.lit("] ("), p["location"], F.lit(")\n"), p["text"])), "\n\n")
    return held.select("query_id", block.alias("context"), F.size("_p").alias("passages"))


def prompts(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, system, prompt, passages); without passages the prompt is null."""
    asked = queries.join(context_block(passages), "query_id", "left")
    prompt = F.concat("context", F.lit("\n\nQuestion: "), F.col("text"))
    return asked.select("query_id", F.lit(SYSTEM_PROMPT).alias("system"), prompt.alias("prompt"), F.coalesce("passages", F.lit(0)).alias("passages"))


MESSAGE = "array<struct<role:string,content:string>>"


def messages(asked: DataFrame, history: DataFrame) -> DataFrame:
    """`asked` (query_id, system, prompt, passages) with `messages`: the system's, the kept exchanges in order, the prompt.

    `history` (conv_id, position, question, answer) is of `history_window`; its conv_id is the query's id. Without passages there are none.
    """
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    pair = F.struct("position", F.array(say("user", F.col("question")), say("assistant", F.col("answer"))).alias("said"))
    told = history.groupBy(F.col("conv_id").alias("query_id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["said"])).alias("_told"))
    whole = F.concat(F.array(say("system", F.col("system"))), F.coalesce("_told", F.array().cast(MESSAGE)), F.array(say("user", F.col("prompt"))))
    return asked.join(told, "query_id", "left").withColumn("messages", F.when(F.col("prompt").isNotNull(), whole)).drop("_told")


def answers(asked: DataFrame, complete: Callable[[Column, Column], Column]) -> DataFrame:
    """(query_id, text, refused). Questions without passages are a branch of their own: the model is never called for them.

    `complete` takes (system, prompt), or where `asked` has `messages`, those.
    """
    said = complete(F.col("messages")) if "messages" in asked.columns else complete(F.col("system"), F.col("prompt"))
    kept = asked.filter("passages > 0").select("query_id", said.alias("text"), F.lit(False).alias("refused"))
    return kept.unionByName(asked.filter("passages = 0").select("query_id", F.lit(NO_CONTEXT_ANSWER).alias("text"), F.lit(True).alias("refused")))


def first_sentence(system: Column, prompt: Column) -> Column:
    """The stand-in for a model: the beginning of passage 1, cited."""
    body = F.regexp_extract(prompt, r"^\[1\] \([^\n]*\)\n([^\n]{0,200})", 1)
    return F.concat(F.regexp_replace(body, r"\s+", " "), F.lit(" [1]"))


def cited_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda n: n.cast("int"))


def citations(text: Column, passages: Column) -> tuple[Column, Column]:
    """Distinct valid numbers ascending, and distinct others in order of appearance. Three digits are no citation."""
    found = F.array_distinct(cited_numbers(text))
    return F.array_sort(F.filter(found, lambda n: n.between(1, passages))), F.filter(found, lambda n: ~n.between(1, passages))


def verify_citations(answered: DataFrame, passages: DataFrame) -> DataFrame:
    """A row for each distinct number that an answer cites: answer_id, number, valid, source, location."""
    cited = answered.select("answer_id", F.explode(F.array_distinct(cited_numbers(F.col("text")))).alias("number"))
    known = passages.select("answer_id", F.col("rank").alias("number"), "source", "location")
    out = cited.join(known, ["answer_id", "number"], "left")
    return out.select("answer_id", "number", F.col("source").isNotNull().alias("valid"), "source", "location")


def grounded(valid: Column) -> Column:
    return F.size(valid) > 0
