"""Turn loops with keyed state and timers, and streams joined in time; batch forms give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: States of a session: turns are missing, all is said, nothing came for too long.
PENDING, COMPLETED, EXPIRED = "PENDING", "COMPLETED", "EXPIRED"
RESULT = "conv_id long, turns long, roles string, state string, ended timestamp"


class _Session(StatefulProcessor):
    """One session: its texts as a list, turns by role as a map, when it was last heard and what it has become.

    Turns are taken in their order within a batch; a session is COMPLETED by its ``most``-th turn or the phrase and takes
    no more. A timer of event time is set ``silence`` after the last turn; when it rings, the session is EXPIRED. Its list
    and map are cleared when it ends; a second timer, ``keep`` later, lets go of what it has become, so state doesn't grow
    with sessions that are over.
    """

    def __init__(self, most: int, phrase: str, silence_ms: int, keep_ms: int):
        self.most, self.phrase, self.silence, self.keep = most, phrase, silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.texts = handle.getListState("texts", T.StructType([T.StructField("turn", T.LongType()), T.StructField("text", T.StringType())]))
        self.roles = handle.getMapState("roles", "role string", "n long")
        self.last = handle.getValueState("last", "at long")
        self.over = handle.getValueState("over", "state string")

    def _ring(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _row(self, key, state: str, at: int) -> pd.DataFrame:
        roles = {k[0]: int(v[0]) for k, v in self.roles.iterator()}
        turns = sum(1 for _ in self.texts.get()) if self.texts.exists() else 0
        return pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "roles": [",".join(f"{r}:{roles[r]}" for r in sorted(roles))], "state": [state], "ended": [pd.Timestamp(at, unit="ms")]})

    def _end(self, state: str, at: int) -> None:
        self.over.update((state,))
        self._ring(at + self.keep)
        for held in (self.texts, self.roles, self.last):
            held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.over.exists():
            return
        turns = pd.concat(list(rows)).sort_values("turn", kind="stable")
        last = int(self.last.get()[0]) if self.last.exists() else None
        n = sum(1 for _ in self.texts.get()) if self.texts.exists() else 0
        for turn, role, text, ts in zip(turns["turn"], turns["role"], turns["text"], turns["ts"], strict=True):
            at = int(pd.Timestamp(ts).value // 1_000_000)
            if last is not None and at > last + self.silence:  # the timer has not rung yet, but would have
                yield self._row(key, EXPIRED, last)
                self._end(EXPIRED, last + self.silence)
                return
            last = at if last is None else max(last, at)
            self.texts.appendValue((int(turn), text))
            role = role or ""
            self.roles.updateValue((role,), (int(self.roles.getValue((role,))[0]) + 1 if self.roles.containsKey((role,)) else 1,))
            n += 1
            if n >= self.most or self.phrase in (text or "").lower():
                yield self._row(key, COMPLETED, last)
                self._end(COMPLETED, last)
                return
        self.last.update((last,))
        self._ring(last + self.silence)
        yield self._row(key, PENDING, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            at = int(self.last.get()[0])
            yield self._row(key, EXPIRED, at)
            self._end(EXPIRED, at + self.silence)
        else:
            self.over.clear()

    def close(self) -> None:
        pass


def _state_store(spark) -> None:
    """Processors with state of their own need the store that can hold several columns."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(spark, length: str) -> int:
    """Milliseconds of an interval such as '2 hours'."""
    return int(spark.sql(f"SELECT CAST(unix_millis(timestamp'1970-01-01 00:00:00' + INTERVAL {length}) - unix_millis(timestamp'1970-01-01 00:00:00') AS BIGINT)").first()[0])


def turn_loop(turns: DataFrame, most: int, phrase: str, silence: str = "1 day", late: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """(conv_id, turns, roles, state, ended) of sessions of (conv_id, turn, role, text, ts).

    A session is COMPLETED at its ``most``-th turn or one whose text has ``phrase`` in lower case; what follows is left out.
    It is EXPIRED if the next turn comes more than ``silence`` after the last one, or if that long passes without one by the
    watermark, which runs ``late`` behind the latest turn of all; what follows is left out. Else it is PENDING. A stream goes through transformWithState (it needs the RocksDB state store) and has a row for each
    change; the last one a session has is what a batch gives. Rows without ``ts`` are left out, as no watermark can place
    them; null texts have no phrase, null roles count as ''. Turns of one batch are taken in the order of ``turn``.
    """
    turns = turns.select("conv_id", "turn", "role", "text", F.col("ts").cast("timestamp").alias("ts")).where("ts is not null")
    if turns.isStreaming:
        spark = turns.sparkSession
        _state_store(spark)
        of = turns.withWatermark("ts", late).groupBy("conv_id")
        return of.transformWithStateInPandas(_Session(most, phrase, _ms(spark, silence), _ms(spark, keep)), RESULT, "Update", "EventTime")
    end = turns.agg(F.max("ts").alias("end")).select((F.col("end") - F.expr(f"INTERVAL {late}")).alias("mark"))
    said = F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(phrase))
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), said.alias("said"), "ts")
    of = turns.groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list(row)), 1, most).alias("all"))
    first = lambda when: F.array_min(F.filter(F.transform("all", lambda x, i: F.when(when(x, i), i + 1)), lambda n: n.isNotNull()))
    gap = F.expr(f"INTERVAL {silence}")
    of = of.withColumn("stop", first(lambda x, i: x["said"] | (i + 1 >= most)))
    of = of.withColumn("gap", first(lambda x, i: (i > 0) & (x["ts"] > F.array_max(F.slice("all.ts", F.lit(1), F.greatest(i, F.lit(1)))) + gap)) - 1)
    of = of.withColumn("done", F.col("stop").isNotNull() & F.coalesce(F.col("stop") <= F.col("gap"), F.lit(True)))
    of = of.withColumn("heard", F.slice("all", F.lit(1), F.when(F.col("done"), F.col("stop")).otherwise(F.coalesce("gap", F.size("all")))))
    names = F.array_sort(F.array_distinct("heard.role"))
    roles = F.array_join(F.transform(names, lambda r: F.concat(r, F.lit(":"), F.size(F.filter("heard", lambda x: x["role"] == r)).cast("string"))), ",")
    of = of.select("conv_id", F.size("heard").cast("long").alias("turns"), roles.alias("roles"), "done", "gap", F.array_max("heard.ts").alias("ended"))
    expired = F.col("gap").isNotNull() | (F.col("ended") + gap <= F.col("mark"))
    state = F.when(F.col("done"), COMPLETED).when(expired, EXPIRED).otherwise(PENDING)
    return of.join(F.broadcast(end)).select("conv_id", "turns", "roles", state.alias("state"), "ended")


def latest_change(changes: DataFrame) -> DataFrame:
    """The last state of each session among the rows of a stream: one that ended, else the one with most turns."""
    ended = F.struct((F.col("state") != PENDING).alias("over"), "turns", "ended")
    return changes.groupBy("conv_id").agg(F.max_by(F.struct("turns", "roles", "state", "ended"), ended).alias("r")).select("conv_id", "r.*")


def paired_in_time(references: DataFrame, hypotheses: DataFrame, within: str, late: str, how: str = "inner") -> DataFrame:
    """(id, ref_ts, ref, hyp_ts, hyp): references and hypotheses of one id whose times are at most ``within`` apart.

    Both sides are (id, ts, text), each a stream with a watermark of ``late`` or a batch. A stream keeps a row until the other
    side's watermark says that no partner can come; rows later than that are dropped by Spark, a batch drops none. ``how`` is
    inner, or leftOuter, where a reference without a partner has null hyp and is given once it can have none. Null ids and
    times match nothing. Several partners in time are several rows.
    """
    side = lambda d, name: d.select(F.col("id").alias(f"{name}_id"), F.col("ts").cast("timestamp").alias(f"{name}_ts"), F.col("text").alias(name))
    left, right = side(references, "ref"), side(hypotheses, "hyp")
    if references.isStreaming or hypotheses.isStreaming:
        left, right = left.withWatermark("ref_ts", late), right.withWatermark("hyp_ts", late)
    span = F.expr(f"INTERVAL {within}")
    near = (F.col("ref_id") == F.col("hyp_id")) & (F.col("hyp_ts") >= F.col("ref_ts") - span) & (F.col("hyp_ts") <= F.col("ref_ts") + span)
    return left.join(right, near, how).select(F.col("ref_id").alias("id"), "ref_ts", "ref", "hyp_ts", "hyp")
