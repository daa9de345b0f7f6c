"""Chat histories as keyed state that expires: a stream and its batch twin.

A session's messages are a list state, the last ``cap`` of them. A timer of event time clears a session
``ttl`` after its last message, as the watermark passes it; a message that comes later than that after
the one before begins the history anew, whether the timer has fired or not (ST1, ST3)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .sessions import HISTORY_CAP, HISTORY_TTL_S

#: The state store that list states and timers need; a session's setting, read when a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "session string, messages long, context string, updated_at timestamp, expired boolean"


def following(lines: list[tuple[int, str]], new: list[tuple[int, str]], ttl_us: int, cap: int) -> list[tuple[int, str]]:
    """The history after new messages, in their order: those within the TTL of the one before."""
    for at, line in sorted(new):
        if lines and at - lines[-1][0] > ttl_us:
            lines = []
        lines = [*lines, (at, line)][-cap:]
    return lines


class _History(StatefulProcessor):
    def __init__(self, ttl_s: int, cap: int):
        self.ttl_us, self.cap = ttl_s * 1_000_000, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "at long, line string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(at), line) for p in rows for at, line in zip(p["at"], p["line"], strict=True)]
        held = [(int(at), line) for at, line in self.lines.get()] if self.lines.exists() else []
        held = following(held, new, self.ttl_us, self.cap)
        self.lines.put(held)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # a timer fires once the watermark has reached it: the last message is older than the TTL then
        self.handle.registerTimer((held[-1][0] + self.ttl_us) // 1000 + 1)
        yield _row(key[0], held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.lines.clear()
        yield _row(key[0], [], True)

    def close(self) -> None:
        pass


def _row(session: str, lines: list[tuple[int, str]], expired: bool) -> pd.DataFrame:
    last = pd.Timestamp(lines[-1][0], unit="us") if lines else pd.NaT
    return pd.DataFrame({"session": [session], "messages": [len(lines)], "context": ["\n".join(x for _, x in lines)], "updated_at": pd.Series([last], dtype="datetime64[us]"), "expired": [expired]})


def _lines(messages: DataFrame, session: str, at: str, role: str, text: str) -> list[Column]:
    line = F.concat(F.coalesce(F.col(role), F.lit("")), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    return [F.col(session).cast("string").alias("session"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), line.alias("line")]


def history_stream(messages: DataFrame, session: str, at: str, role: str, text: str, ttl_s: int = HISTORY_TTL_S, cap: int = HISTORY_CAP, late: str = "1 hour") -> DataFrame:
    """(session, messages, context, updated_at, expired) whenever a session changes or expires. Output
    mode "update"; the session needs :data:`STATE_STORE`. Messages without session or time are left out."""
    rows = messages.where(F.col(session).isNotNull() & F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    keyed = rows.select(*_lines(rows, session, at, role, text), F.col(at).alias("event_time")).groupBy("session")
    return keyed.transformWithStateInPandas(_History(ttl_s, cap), _OUT, "Update", "EventTime")


def histories(messages: DataFrame, session: str, at: str, role: str, text: str, now: Column | None = None, ttl_s: int = HISTORY_TTL_S, cap: int = HISTORY_CAP) -> DataFrame:
    """(session, messages, context, updated_at) of the sessions alive at ``now`` (all, if null)."""
    rows = messages.where(F.col(session).isNotNull() & F.col(at).isNotNull()).select(*_lines(messages, session, at, role, text))
    order = Window.partitionBy("session").orderBy("at", "line")
    gap = F.col("at") - F.lag("at").over(order) > ttl_s * 1_000_000
    part = rows.withColumn("turn", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order))
    back = part.withColumn("back", F.row_number().over(Window.partitionBy("session").orderBy(F.col("turn").desc(), F.col("at").desc(), F.col("line").desc())))
    back = back.withColumn("last_turn", F.max("turn").over(Window.partitionBy("session"))).where((F.col("turn") == F.col("last_turn")) & (F.col("back") <= cap))
    made = back.groupBy("session").agg(F.count("*").alias("messages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("context"), F.timestamp_micros(F.max("at")).alias("updated_at"))
    return made if now is None else made.where(F.unix_micros("updated_at") + ttl_s * 1_000_000 >= F.unix_micros(now.cast("timestamp")))


