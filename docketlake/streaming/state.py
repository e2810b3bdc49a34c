"""What clients show of their requests, kept in the state store of a stream.

The state of a query id holds the frames since its last new query. A request is loading until its terminal message, or until nothing has come for
``patience`` of event time, which ends it; some time after its end it is forgotten. Frames may come late and in any order; they are put in
their places by ``seq``. The state lies in the checkpoint: a stream that is started again goes on with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .trace import TERMINAL

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "query_id string, seq long, steps array<string>, loading boolean, expired boolean"
_STATE = "begun long, at long, seqs array<long>, steps array<string>, types array<string>, expired boolean"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, set to the state store that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class ClientState(StatefulProcessor):
    """The state of one query id: ``patience`` and ``retention`` are in milliseconds of event time."""

    def __init__(self, patience: int, retention: int):
        self.patience, self.retention = patience, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("client", _STATE)

    def _due(self, at: int, loading: bool) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at + (self.patience if loading else self.retention))

    def _shown(self, key: tuple, frames: dict, expired: bool) -> pd.DataFrame:
        last = max(frames) if frames else None
        loading = last is not None and frames[last][1] not in TERMINAL and not expired
        steps = [frames[s][0] for s in sorted(frames)]
        return pd.DataFrame({"query_id": [key[0]], "seq": [last if last is not None else -1], "steps": [steps], "loading": [loading], "expired": [expired]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun, at, frames = -1, 0, {}
        if self.held.exists():
            begun, at, seqs, steps, types, _ = self.held.get()
            frames = {int(s): (a, b) for s, a, b in zip(seqs, steps, types, strict=True)}
        for part in rows:
            for seq, step, kind, ms in zip(part["seq"], part["step"], part["type"], part["ts"].astype("datetime64[ms]").astype("int64"), strict=True):
                at = max(at, int(ms))
                if kind == "query":
                    begun = max(begun, int(seq))
                else:
                    frames[int(seq)] = (step, kind)
        frames = {s: f for s, f in frames.items() if s > begun}
        shown = self._shown(key, frames, False)
        self.held.update((begun, at, sorted(frames), [frames[s][0] for s in sorted(frames)], [frames[s][1] for s in sorted(frames)], False))
        self._due(at, bool(shown["loading"][0]))
        yield shown

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        begun, at, seqs, steps, types, expired = self.held.get()
        frames = {int(s): (a, b) for s, a, b in zip(seqs, steps, types, strict=True)}
        loading = bool(self._shown(key, frames, expired)["loading"][0])
        if loading:
            self.held.update((begun, at, list(seqs), list(steps), list(types), True))
            self._due(expiredTimerInfo.getExpiryTimeInMs(), False)
            yield self._shown(key, frames, True)
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def client_states(frames: DataFrame, patience: str = "'10' MINUTE", retention: str = "'1' DAY", late: str = "10 minutes") -> DataFrame:
    """query_id, seq (the last frame), steps, loading, expired: each change of what a client shows of a query id, on a stream in update mode.

    frames: query_id, seq, step, type, ts; a frame of type ``query`` starts anew. Ids are strings, and frames of one id have different
    seq. ``loading`` over the same frames as a batch gives the same, but for requests that have expired.
    """
    spark = with_state_store(frames.sparkSession)
    ms = lambda d: int(spark.sql(f"SELECT CAST(INTERVAL {d} AS INTERVAL SECOND) AS d").first().d.total_seconds() * 1000)
    slim = frames.select(F.col("query_id").cast("string").alias("query_id"), F.col("seq").cast("long").alias("seq"), "step", "type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return slim.groupBy("query_id").transformWithStateInPandas(ClientState(ms(patience), ms(retention)), OUT, "Update", "EventTime")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each query id among those that a stream has written: that of the last batch, and in a batch that has expired."""
    best = F.max_by(F.struct("seq", "steps", "loading", "expired"), F.struct("batch", "expired"))
    return changes.groupBy("query_id").agg(best.alias("s")).select("query_id", "s.*")


def run_to(changes: DataFrame, path: str, checkpoint: str):
    """A stream that appends changes to a table with the number of their batch; a batch that is tried again writes its part anew."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update")
