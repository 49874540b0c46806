"""Conversations: from rows (conv_id, turn, role, text) to records, checks and training formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as tx


def collected(turns: DataFrame) -> DataFrame:
    """One row a conversation with its turns in order: (conv_id, turns array<struct<turn, role, text>>)."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def dialogue(turns: Column) -> Column:
    """Turns without a leading system turn."""
    return F.when(F.get(turns, F.lit(0))["role"] == "system", F.slice(turns, F.lit(2), F.size(turns))).otherwise(turns)


def alternates(turns: Column, first: str = "user", second: str = "assistant") -> Column:
    """Roles alternate, beginning with ``first``; no turns don't."""
    want = lambda i: F.when(i % 2 == 0, first).otherwise(second)
    return (F.size(turns) > 0) & F.forall(F.transform(turns, lambda t, i: t["role"] == want(i)), lambda ok: F.coalesce(ok, F.lit(False)))


def without_trailing(turns: Column, role: str = "user") -> Column:
    return F.when(F.element_at(turns, -1)["role"] == role, F.slice(turns, F.lit(1), F.size(turns) - 1)).otherwise(turns)


def sft_records(turns: DataFrame) -> DataFrame:
    """Valid conversations ready for fine-tuning: (conv_id, turns), alternating, ending with the assistant."""
    rows = collected(turns).select("conv_id", dialogue(F.col("turns")).alias("turns"))
    rows = rows.where(alternates(F.col("turns"))).select("conv_id", without_trailing(F.col("turns")).alias("turns"))
    return rows.where(F.size("turns") > 0)


def map_roles(turns: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename roles; a role that has no name is an error."""
    names = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    unknown = F.raise_error(F.concat(F.lit("unknown role "), F.coalesce("role", F.lit("null"))))
    return turns.withColumn("role", F.coalesce(F.try_element_at(names, F.coalesce("role", F.lit(""))), unknown.cast("string")))


def appended(history: Column, role: Column, content: Column, tool_calls: Column | None = None, tool_call_id: Column | None = None) -> Column:
    """``history`` (role, content, tool_calls, tool_call_id) with one more message; what it lacks is null."""
    none = F.lit(None).cast("string")
    fields = {"role": role, "content": content, "tool_calls": none if tool_calls is None else tool_calls, "tool_call_id": none if tool_call_id is None else tool_call_id}
    return F.array_append(history, F.struct(*(c.alias(k) for k, c in fields.items())))


#: Who speaks in a turn of a role, and to whom; an agent that calls a tool speaks to the execution.
SPEAKERS = {"user": "user", "assistant": "agent", "tool": "execution"}


def routed(turns: DataFrame, most: int, phrase: str = "finish conversation", call: str = "<tool_call>") -> DataFrame:
    """(conv_id, turn, sender, recipient) as far as each turn is spoken by the last recipient, the user first.

    A conversation ends after ``most`` turns, with the user's ``phrase``, or before a turn out of order. Turns of other
    roles are passed over.
    """
    names = F.create_map(*(F.lit(x) for kv in SPEAKERS.items() for x in kv))
    rows = turns.withColumn("sender", F.try_element_at(names, F.coalesce("role", F.lit("")))).where(F.col("sender").isNotNull())
    recipient = F.when(F.col("sender") != "agent", "agent").when(F.contains("text", F.lit(call)), "execution").otherwise("user")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("recipient", recipient)
    over = (F.lag("sender").over(w) == "user") & F.contains(F.lower(F.lag("text").over(w)), F.lit(phrase))
    wrong = F.col("sender") != F.coalesce(F.lag("recipient").over(w), F.lit("user"))
    rows = rows.withColumn("stop", (wrong | F.coalesce(over, F.lit(False)) | (F.row_number().over(w) > most)).cast("int"))
    return rows.withColumn("stopped", F.max("stop").over(w)).where(F.col("stopped") == 0).select("conv_id", "turn", "sender", "recipient")


def neighbours(turns: DataFrame) -> DataFrame:
    """Question and answer pairs: each assistant turn with the user turn just before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("*", F.lag("role").over(w).alias("before"), F.lag("text").over(w).alias("question"))
    return rows.where((F.col("role") == "assistant") & (F.col("before") == "user")).select("conv_id", "turn", "question", F.col("text").alias("answer"))


def multimodal_valid(conv: Column, one_tag_needed: Column | bool = False) -> Column:
    """A (from, value) conversation fit for one image: even, human and gpt in turn, tags only where they may be.

    The first human turn has at most one image tag (exactly one if needed) and no video tag; later human turns have no
    media tag; gpt turns have neither media nor thought tags.
    """
    needed = F.lit(one_tag_needed) if isinstance(one_tag_needed, bool) else one_tag_needed
    tags = tx.count_of(F.get(conv, F.lit(0))["value"], "<image>")

    def ok(c, i):
        human, value = i % 2 == 0, c["value"]
        role = c["from"] == F.when(human, "human").otherwise("gpt")
        clean = F.when(i == 0, ~tx.has_video_tag(value)).when(human, ~tx.has_media_tag(value)).otherwise(~tx.has_media_tag(value) & ~tx.has_think_tag(value))
        return F.coalesce(role & clean, F.lit(False))

    flags = F.transform(conv, ok)
    return (F.size(conv) > 0) & (F.size(conv) % 2 == 0) & F.forall(flags, lambda x: x) & F.when(needed, tags == 1).otherwise(tags <= 1)


def with_image_prefix(conv: Column) -> Column:
    """The conversation with an image tag before its first value if it has none."""
    bare = tx.count_of(F.get(conv, F.lit(0))["value"], "<image>") == 0
    return F.transform(conv, lambda c, i: F.when((i == 0) & bare, F.struct(c["from"].alias("from"), F.concat(F.lit("<image>\n"), c["value"]).alias("value"))).otherwise(c))


def history_to_messages(pairs: Column) -> Column:
    """[(question, answer)] to alternating messages."""
    return F.flatten(F.transform(pairs, lambda p: F.array(F.struct(F.lit("user").alias("role"), p["question"].alias("content")), F.struct(F.lit("assistant").alias("role"), p["answer"].alias("content")))))


def messages_to_history(messages: Column) -> Column:
    """Alternating messages to [(question, answer)]."""
    half = lambda k: F.transform(F.filter(messages, lambda m, i: i % 2 == k), lambda m: m["content"])
    return F.transform(F.arrays_zip(half(0).alias("q"), half(1).alias("a")), lambda z: F.struct(z["q"].alias("question"), z["a"].alias("answer")))


def history_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")


def first_of_role(turns: Column, role: str = "user") -> Column:
    """Text of the first turn of a role, '' if there is none."""
    return F.coalesce(F.get(F.filter(turns, lambda t: t["role"] == role), F.lit(0))["text"], F.lit(""))


def ready_for_judge(turns: Column, end: str = "finish conversation") -> Column:
    """Both sides speak, the user last, and the last text says that the talk is over."""
    has = lambda role: F.exists(turns, lambda t: t["role"] == role)
    last = F.element_at(turns, -1)
    return has("user") & has("assistant") & (last["role"] == "user") & F.contains(F.lower(last["text"]), F.lit(end))


def training_format(turns: Column) -> Column:
    """user to human, assistant to gpt, execution to observation; a trailing user turn goes."""
    to = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").when(r == "execution", "observation")
    return F.filter(F.transform(without_trailing(turns), lambda t: F.struct(to(t["role"]).alias("from"), t["text"].alias("value"))), lambda c: c["from"].isNotNull())


def session_end(turns: DataFrame, most: int, phrase: str) -> DataFrame:
    """The first turn that ends each session: its ``most``-th or one that holds ``phrase``; null while it is open."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    at = turns.withColumn("i", F.row_number().over(w) - 1)
    ends = (F.col("i") + 1 >= most) | F.contains(F.lower("text"), F.lit(phrase))
    return at.groupBy("conv_id").agg(F.min(F.when(ends, F.col("turn"))).alias("end_turn"), F.count("*").alias("n_turns"))
