"""Tables an assistant answers from: intents, memory, context, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed
from emberlog.functions import severity, text
from emberlog.operators.report import top_anomalies

TURN_BLOCK = 100_000

HINTS = {
    "trend": "Look at how the anomalies change over time.",
    "security": "Look for intrusion attempts and forbidden access.",
    "error": "Look at failures and what set them off.",
    "summary": "Give a short overview of all anomalies.",
}


def questions(conversations: DataFrame) -> DataFrame:
    """The user's turns, with intent and small-talk flag."""
    return conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", "text",
        severity.intent(F.col("text")).alias("intent"),
        severity.is_small_talk(F.col("text")).alias("small_talk"),
    )


def last_n_memory(turns: DataFrame, n: int = fixed.MEMORY_TURNS, block: int = TURN_BLOCK) -> DataFrame:
    """Add ``memory``: the up to ``n`` earlier texts of the same conversation.

    A conversation is worked on in blocks of turns, so that even a very long
    one is spread out. What a block needs from before it are the last ``n``
    texts of earlier blocks, found from the blocks' own last ``n``. Equal turns
    are in order of their text; rows without a turn come first, those without a
    conversation belong together.
    """
    rows = turns.withColumn("_block", F.floor(F.col("turn") / block))
    in_block = W.partitionBy("conv_id", "_block")
    latest = [F.col("turn").desc_nulls_last(), F.col("text").desc_nulls_last()]
    tails = rows.withColumn("_rank", F.row_number().over(in_block.orderBy(*latest))).filter(F.col("_rank") <= n)
    before = W.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(-n, -1)
    size = F.count("*").over(in_block)
    carried = (
        tails.withColumn("_carry", F.collect_list("text").over(before))
        .withColumn("_size", size)
        .filter(F.col("_rank") == F.col("_size"))
        .select(F.struct("conv_id", "_block").alias("_place"), "_carry")
    )
    local = F.collect_list("text").over(in_block.orderBy("turn", "text").rowsBetween(-n, -1))
    # As one struct, which is never null itself, so that nulls meet.
    rows = rows.withColumn("_local", local).withColumn("_place", F.struct("conv_id", "_block"))
    joined = rows.join(carried, "_place", "left")
    both = F.concat(F.coalesce("_carry", F.array().cast("array<string>")), "_local")
    memory = F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), n)
    return joined.select(*turns.columns, memory.alias("memory"))


def render(df: DataFrame) -> DataFrame:
    """One text line per anomaly: time, severity, message."""
    return df.withColumn("line", F.concat_ws(" | ", "timestamp", "severity", "message"))


def _numbered(scored: DataFrame, k: int, tie_break: tuple[str, ...]) -> DataFrame:
    """The top k as one row holding an array of messages (k is small)."""
    order = F.struct(-F.col("anomaly_score_norm"), *tie_break)
    top = top_anomalies(scored, k, tie_break).select(F.struct(order.alias("o"), "message").alias("m"))
    return top.agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["message"]).alias("messages"))


def direct_logs(scored: DataFrame, k: int = 5, tie_break: tuple[str, ...] = ("@timestamp", "message")) -> DataFrame:
    """The numbered list shown when someone just asks for logs."""
    listed = _numbered(scored, k, tie_break).select(F.posexplode("messages").alias("i", "message"))
    line = F.concat((F.col("i") + 1).cast("string"), F.lit(". "), text.shorten(F.col("message"), 150))
    return listed.select((F.col("i") + 1).alias("ord"), line.alias("line"))


def retrieval_prompts(asked: DataFrame, retrieved: DataFrame, listed: DataFrame) -> DataFrame:
    """A prompt per question from what was retrieved for it.

    ``asked`` has ``qid``; ``retrieved`` has ``qid, rank, line``. The prompt
    holds those lines, the last three questions and the intent's hint. Who asks
    for logs needs no model: ``answer`` is the list itself, and there is no
    prompt.
    """
    lines = retrieved.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("found"))  # ten at most
    context = F.coalesce(F.array_join(F.transform("found", lambda x: x["line"]), "\n"), F.lit(""))
    entry = F.struct("ord", "line")
    answer = listed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["line"]), "\n")).scalar()
    memory = F.when(F.size("memory") == 0, "None").otherwise(F.array_join("memory", "\n"))
    prompt = F.concat_ws(
        "\n", F.lit("Earlier questions:"), memory, F.lit("Logs:"), context, F.lit("Question:"), F.col("text"),
        F.nullif(text.lookup(F.col("intent"), HINTS, ""), F.lit("")))
    wants_logs = F.col("intent") == "logs"
    return last_n_memory(asked).join(lines, "qid", "left").select(
        "qid", "intent", F.when(wants_logs, answer).alias("answer"), F.when(~wants_logs, prompt).alias("prompt"))


def prompt_table(
    conversations: DataFrame, scored: DataFrame, k: int = 5, tie_break: tuple[str, ...] = ("@timestamp", "message")
) -> DataFrame:
    """Question, intent, hint, memory and context, ready for a model."""
    context = _numbered(scored, k, tie_break).select(F.array_join("messages", "\n")).scalar()
    asked = last_n_memory(questions(conversations))
    hint = text.lookup(F.col("intent"), HINTS, "")
    memory = F.when(F.size("memory") == 0, "None").otherwise(F.array_join("memory", "\n"))
    prompt = F.concat_ws(
        "\n",
        F.lit("Earlier questions:"), F.col("memory"),
        F.lit("Logs:"), F.col("context"),
        F.lit("Question:"), F.col("text"),
        F.nullif(F.col("hint"), F.lit("")),
    )
    return (
        asked.withColumn("hint", hint)
        .withColumn("memory", memory)
        .withColumn("context", context)
        .withColumn("prompt", prompt)
    )
