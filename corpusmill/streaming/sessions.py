"""Sessions, rate limits and windows: streaming operators with their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY_TTL_S = 30 * 24 * 3600
HISTORY_CAP = 100


def history_tail(messages: DataFrame, session: str, order: str, n: int) -> DataFrame:
    """The last ``n`` messages of each session (WN9)."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc())
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def history_context(messages: DataFrame, session: str, order: str, role: str, text: str, n: int) -> DataFrame:
    """(session, context): the tail as "role: text" lines in order (SF48)."""
    tail = history_tail(messages, session, order, n)
    line = F.struct(F.col(order), F.concat(F.col(role), F.lit(": "), F.col(text)).alias("line"))
    return tail.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("context"))


def live_sessions(messages: DataFrame, session: str, at: str, now: Column, ttl_seconds: int = HISTORY_TTL_S) -> DataFrame:
    """Sessions whose last message is not older than the TTL (ST3)."""
    last = messages.groupBy(session).agg(F.max(at).alias("updated_at"), F.count("*").alias("messages"))
    return last.where(F.unix_micros(F.col("updated_at").cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - ttl_seconds * 1_000_000)


def trailing_count(events: DataFrame, key: str, at: Column, seconds: int) -> DataFrame:
    """How many of a key's events lie in the ``seconds`` up to each (WN8)."""
    w = Window.partitionBy(key).orderBy("__s").rangeBetween(-(seconds - 1), 0)
    return events.withColumn("__s", at.cast("long")).withColumn("in_window", F.count("*").over(w)).drop("__s")


def _judge(times: list[float], accepted: list[float], limit: int, window: float) -> Iterator[tuple[bool, int]]:
    """Allow an event if fewer than ``limit`` were accepted in the window before it; else say when."""
    for t in times:
        while accepted and accepted[0] <= t - window:
            accepted.pop(0)
        ok = limit <= 0 or len(accepted) < limit
        if ok:
            accepted.append(t)
            yield True, 0
        else:
            yield False, max(1, int(accepted[0] + window - t))


def rate_limit(events: DataFrame, key: str, event_id: str, at: str, limit: int, window: float = 60.0) -> DataFrame:
    """(key, event id, allowed, retry_after) by a sliding log of accepted events (ST2), a key at a
    time: batch twin of :func:`rate_limit_stream`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"])
        got = list(_judge(pdf["t"].tolist(), [], limit, window))
        return pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "allowed": [g[0] for g in got], "retry_after": [g[1] for g in got]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("long").alias("event_id"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"))
    return rows.groupBy("key").applyInPandas(run, "key string, event_id long, allowed boolean, retry_after int")


def rate_limit_stream(events: DataFrame, key: str, event_id: str, at: str, limit: int, window: float = 60.0) -> DataFrame:
    """The same on a stream: a key's state is the log of accepted events in the window."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["t", "event_id"])
        got = list(_judge(pdf["t"].tolist(), accepted, limit, window))
        state.update((accepted,))
        yield pd.DataFrame({"key": name[0], "event_id": pdf["event_id"], "allowed": [g[0] for g in got], "retry_after": [g[1] for g in got]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("long").alias("event_id"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, event_id long, allowed boolean, retry_after int", "log array<double>", "append", GroupStateTimeout.NoTimeout)


def session_stream(messages: DataFrame, session: str, at: str, role: str, text: str, cap: int = HISTORY_CAP) -> DataFrame:
    """(session, messages, context) after each batch: the capped history as keyed state (ST1)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("o")
        lines = (lines + [f"{r}: {t}" for r, t in zip(pdf["r"], pdf["t"], strict=True)])[-cap:]
        state.update((lines,))
        yield pd.DataFrame({"session": [name[0]], "messages": [len(lines)], "context": ["\n".join(lines)]})

    rows = messages.select(F.col(session).cast("string").alias("session"), F.col(at).cast("long").alias("o"), F.col(role).alias("r"), F.col(text).alias("t"))
    return rows.groupBy("session").applyInPandasWithState(run, "session string, messages long, context string", "lines array<string>", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, at: str, size: str, slide: str | None, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums by tumbling or sliding window; with ``late`` a stream drops rows behind the
    watermark."""
    if late:
        events = events.withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, key: str) -> DataFrame:
    """Sessions by gaps of activity."""
    return events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def incremental_index(stream: DataFrame, path: str, hash_col: str, checkpoint: str, digits: int = 2):
    """Insert only unseen contents of a stream into the hash-partitioned store at ``path`` (ST5). A batch
    reads the partitions of its own hashes; one that runs again finds its rows there and adds none."""
    from ..sources.store import HashStore

    def add(batch: DataFrame, _: int) -> None:
        HashStore(batch.sparkSession, path, key=hash_col, digits=digits).insert_new(batch, hash_col)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
