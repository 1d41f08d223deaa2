"""Windows, sessions, debouncing and rate limits over events `(event_id, ts, user_id, event_type, value)`; most run on batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """`(start, event_type, n, total)` per window; on a stream, `late` is the watermark."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str | None = None) -> DataFrame:
    """`(start, n)` of overlapping windows."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """`(user_id, start, n)`: runs of a user's events with less than `gap` between them."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def debounced(events: DataFrame, seconds: float) -> DataFrame:
    """Events that no other of the same user follows within `seconds`."""
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    wait = F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return events.withColumn("wait", wait).where(F.col("wait").isNull() | (F.col("wait") >= int(seconds * 1e6))).drop("wait")


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event per key by `order`: one aggregation with map-side combining."""
    return events.groupBy(key).agg(F.max(F.struct(*order, *[c for c in events.columns if c not in (key, *order)])).alias("e")).select(key, "e.*")


def hits_in_range(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """`(event_id, hits, over)`: all of a user's events in the `seconds` up to each, and whether they are more than `most`."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.select("event_id", F.count("*").over(w).alias("hits")).withColumn("over", F.col("hits") > most)


def rate_limited(stream: DataFrame, seconds: int = 60, most: int = 30) -> DataFrame:
    """Streaming rate limit: `(event_id, user_id, accepted)`. Only accepted hits count; the state holds at most `most` times per user.

    A trigger's events of a user are taken in time order: their ids and times (16 bytes each) are held while it runs, so the source's
    limit per trigger (`maxFilesPerTrigger`) bounds the memory, however hot the user.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        events, out = pd.concat(list(batches)).sort_values(["us", "event_id"]), []
        for i, at in zip(events["event_id"], events["us"]):
            times = [x for x in times if x > at - seconds * 1_000_000]
            ok = len(times) < most
            if ok:
                times.append(int(at))
            out.append((i, key[0], ok))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "accepted"])
        state.update((times,))

    rows = stream.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, accepted boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def journal(events: DataFrame, key: str, most: int) -> DataFrame:
    """The last `most` events per key with `rank`, newest first (the feature's limit)."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
