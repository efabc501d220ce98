"""Windows of conversations: last messages, age, token budgets, summaries, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quern.config import MemoryConfig, MemoryError_
from quern.functions.prompts import role_name
from quern.functions.text import token_count
from quern.operators.running import running_total

CONVERSATION, TURN = "conv_id", "turn"
#: Turns that are sorted together where a total runs along a conversation.
BLOCK = 4096


def _whole() -> WindowSpec:
    return Window.partitionBy(CONVERSATION)


def _back() -> WindowSpec:
    return _whole().orderBy(F.desc(TURN))


def last_messages(messages: DataFrame, c: MemoryConfig = MemoryConfig()) -> DataFrame:
    return messages.withColumn("_r", F.row_number().over(_back())).filter(F.col("_r") <= c.max_messages).drop("_r")


def token_buffer(messages: DataFrame, c: MemoryConfig = MemoryConfig(), text: str = "text") -> DataFrame:
    """The longest end of each conversation within the budget; too long a last message leaves nothing."""
    block = F.floor(F.col(TURN) / BLOCK)
    used = running_total(messages, CONVERSATION, block, [F.desc(TURN)], token_count(F.col(text)), "_t", descending=True)
    return used.filter(F.col("_t") <= c.max_tokens).drop("_t")


def drop_aged(messages: DataFrame, c: MemoryConfig, now: str, ts: str = "ts") -> DataFrame:
    """Drops the oldest messages of a group until the first that is not older than the limit at time ``now``.

    Later messages are younger, so that each row tells by itself whether it goes. Those without a time go.
    """
    age = F.floor(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(ts)))
    return messages.filter(age <= c.max_age_seconds)


def summaries(messages: DataFrame, c: MemoryConfig = MemoryConfig()) -> DataFrame:
    """(conv_id, n_messages, n_recent, summary): each full run of messages becomes the summary and is cleared."""
    n = messages.groupBy(CONVERSATION).agg(F.count("*").alias("n_messages"))
    text = F.format_string(f"Conversation summary with {c.summary_every} messages.")
    return n.withColumn("n_recent", F.col("n_messages") % c.summary_every).withColumn("summary", F.when(F.col("n_messages") >= c.summary_every, text).otherwise(""))


def recent(messages: DataFrame, c: MemoryConfig = MemoryConfig()) -> DataFrame:
    """The messages since the last summary."""
    left = F.count("*").over(_whole()) % c.summary_every
    return messages.withColumns({"_n": left, "_r": F.row_number().over(_back())}).filter("_r <= _n").drop("_n", "_r")


def lines(role: Column, text: Column) -> Column:
    return F.concat(F.lit("["), role_name(role), F.lit("]: "), text, F.lit("\n"))


def lines_at(role: Column, text: Column, ts: Column) -> Column:
    """Lines with the time of each message in the form of C's ctime, in the session's time zone."""
    day = F.lpad(F.dayofmonth(ts).cast("string"), 2, " ")
    at = F.concat(F.date_format(ts, "EEE MMM "), day, F.date_format(ts, " HH:mm:ss yyyy"))
    return F.concat(F.lit("["), role_name(role), F.lit("]: "), text, F.lit(" (at "), at, F.lit(")\n"))


def context(messages: DataFrame, role: str = "role", text: str = "text", ts: str | None = None) -> DataFrame:
    """(conv_id, context): a line for each message in order, with its time if a column for it is named.

    A context is one value, so that a conversation must fit into a row (2 GB); a window before it keeps that so.
    """
    line = lines(F.col(role), F.col(text)) if ts is None else lines_at(F.col(role), F.col(text), F.col(ts))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(TURN).alias("t"), line.alias("l"))))
    return messages.groupBy(CONVERSATION).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "").alias("context"))


def summary_context(messages: DataFrame, c: MemoryConfig = MemoryConfig()) -> DataFrame:
    """(conv_id, context): the summary, then the recent messages, each under its title if there is any."""
    parts = summaries(messages, c).join(context(recent(messages, c)), CONVERSATION, "left")
    head = F.when(F.col("summary") != "", F.concat(F.lit("Previous conversation summary:\n"), "summary", F.lit("\n\n"))).otherwise("")
    tail = F.when(F.col("context").isNotNull(), F.concat(F.lit("Recent messages:\n"), "context")).otherwise("")
    return parts.select(CONVERSATION, F.concat(head, tail).alias("context"))


def basic_summaries(messages: DataFrame) -> DataFrame:
    """(conv_id, summary): how many messages a conversation has."""
    return messages.groupBy(CONVERSATION).agg(F.format_string("Summary of %d messages.", F.count("*")).alias("summary"))


#: The windows by the name of a memory, as functions of (messages, settings).
MEMORIES = {"buffer": last_messages, "token_buffer": token_buffer, "summary": recent}


def remembered(kind: str, messages: DataFrame, c: MemoryConfig = MemoryConfig()) -> DataFrame:
    """The messages that a memory of this kind holds."""
    if kind not in MEMORIES:
        raise MemoryError_(f"no memory is called {kind!r}")
    return MEMORIES[kind](messages, c.validate())


def save(messages: DataFrame, path: str) -> None:
    messages.write.mode("overwrite").parquet(path)


def load(spark, path: str, conversation: object = None) -> DataFrame:
    """Saved messages, of one conversation or of all."""
    rows = spark.read.parquet(path)
    return rows if conversation is None else rows.filter(F.col(CONVERSATION) == F.lit(conversation))


def stats(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.groupBy(CONVERSATION).agg(F.count("*").alias("message_count"), F.sum(token_count(F.col(text))).alias("total_tokens"), F.sum(F.octet_length(text)).alias("total_bytes"))


def chat_tokens(messages: DataFrame, text: str = "text") -> DataFrame:
    """Tokens of a conversation as a model counts it: four more for each message."""
    return messages.groupBy(CONVERSATION).agg(F.sum(token_count(F.col(text)) + 4).alias("chat_tokens"))
