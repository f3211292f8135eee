"""Conversation memory, session expiry and rate limits, for batches and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from textloom.config import DEFAULT


def last_messages(turns: DataFrame, key: str, order: str, n: int = DEFAULT.history_messages) -> DataFrame:
    """The last n messages of each session."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def sessions(events: DataFrame, key: str, ts: str, hours: int = DEFAULT.session_hours) -> DataFrame:
    """(key, started, ended, n): writes less than `hours` apart are one session. Works on streams with a watermark.

    Spark merges sessions that touch, so the gap is a microsecond shorter: exactly `hours` apart is expired.
    """
    g = events.groupBy(key, F.session_window(ts, f"{hours * 3_600_000_000 - 1} microseconds")).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return g.select(key, F.col("session_window.start").alias("started"), F.col("last").alias("ended"), "n")


def session_stream(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """sessions() of a stream; a session is emitted once the watermark has passed its end."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return sessions(timed, key, ts)


def requests_over(events: DataFrame, key: str, ts: str, window: str, limit: int = DEFAULT.requests_per_minute) -> DataFrame:
    """(key, opened, n, rejected): tumbling windows in which a client made more than `limit` requests."""
    g = events.groupBy(key, F.window(ts, window)).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return g.select(key, F.col("window.start").alias("opened"), "n", (F.col("n") - limit).alias("rejected"))


def admit(hits: list[float], opened: float | None, used: int, limit: int, seconds: float) -> tuple[list[bool], float | None, int]:
    """Fixed windows that the first hit opens: which hits pass, and the window after them."""
    out = []
    for t in hits:
        if opened is None or t >= opened + seconds:
            opened, used = t, 0
        out.append(used < limit)
        used += 1
    return out, opened, used


def rate_limit_stream(requests: DataFrame, key: str, ts: str, limit: int = DEFAULT.requests_per_minute, seconds: float = 60.0) -> DataFrame:
    """(key, ts, admitted) of every request of a stream; state is dropped a minute after a client's window ends."""
    kind = dict(requests.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        ok, opened, used = admit((rows["ts"].astype("int64") / 1e9).tolist() if str(rows["ts"].dtype).endswith("ns]") else [t.timestamp() for t in rows["ts"]], opened, used, limit, seconds)
        state.update((opened, used))
        state.setTimeoutDuration(int(seconds * 2000))
        yield pd.DataFrame({"key": k[0], "ts": rows["ts"], "admitted": ok})

    src = requests.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    return src.groupBy("key").applyInPandasWithState(step, f"key {kind}, ts timestamp, admitted boolean", "opened double, used int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def flush(state: DataFrame, prefix: str) -> tuple[DataFrame, int]:
    """What is left of (key, ...) without the keys of a prefix, and how many went."""
    gone = state.where(F.startswith("key", F.lit(prefix)))
    return state.where(~F.startswith("key", F.lit(prefix))), gone.count()


def memory_stream(turns: DataFrame, key: str, ts: str, most: int = DEFAULT.history_messages, hours: int = DEFAULT.session_hours) -> DataFrame:
    """(key, epoch, n, history) of a stream of (key, ts, role, text, epoch): what a session remembers after each batch of its turns.

    The state is the last `most` messages in the order of ts. It expires `hours` after its last turn, and a
    turn of another content epoch finds it empty, so a new index batch flushes every session at no cost.
    """
    kind = dict(turns.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        epoch, last, held = state.get if state.exists else (None, None, [])
        held = [tuple(x) for x in held]
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for t, role, text, e in zip(rows["ts"], rows["role"], rows["text"], rows["epoch"], strict=True):
            now = t.timestamp()
            if e != epoch or (last is not None and now - last >= hours * 3600):
                held = []
            epoch, last, held = e, now, [*held, (role, text)][-most:]
        state.update((epoch, last, held))
        state.setTimeoutDuration(hours * 3_600_000)
        yield pd.DataFrame({"key": [k[0]], "epoch": [epoch], "n": [len(held)], "history": ["\n".join(f"{r}: {x}" for r, x in held)]})

    src = turns.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), "role", "text", "epoch")
    return src.groupBy("key").applyInPandasWithState(step, f"key {kind}, epoch string, n int, history string", "epoch string, last double, held array<struct<role:string,text:string>>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def refresh(source: DataFrame, publish, checkpoint: str) -> None:
    """One periodic run: publish(batch, batch_id) sees what has come since the last run, once, and the call returns when all of it is done."""
    source.writeStream.foreachBatch(lambda df, n: publish(df, str(n)) if not df.isEmpty() else None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def formatted_history(turns: DataFrame, key: str, order: str, n: int = DEFAULT.history_messages) -> DataFrame:
    """(key, history): the last n messages of each session as "role: text" lines, oldest first."""
    rows = last_messages(turns, key, order, n)
    listed = F.array_sort(F.collect_list(F.struct(order, "role", "text")))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n").alias("history"))


def validated(requests: DataFrame, text: str, session: str, most_text: int = 1000, most_session: int = 128) -> tuple[DataFrame, DataFrame]:
    """Requests whose text and session id have 1 to so many characters, and those that are rejected (nulls among them)."""
    ok = F.coalesce(F.length(text).between(1, most_text) & F.length(session).between(1, most_session), F.lit(False))
    return requests.where(ok), requests.where(~ok)
