"""Job state from a stream of status events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from segmentlab.functions import fixed

if TYPE_CHECKING:
    import pandas as pd

#: A state store outside the heap.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
STATES = "job_id {job}, status string, error string, started_at timestamp, updated_at timestamp, events long, is_open boolean"
#: Open spells of a job, a list per field: times in microseconds.
SPELLS = "first array<long>, last array<long>, seq array<long>, status array<string>, events array<long>"


def current_job_state(events: DataFrame) -> DataFrame:
    """Latest status per job (``job_id, seq, status, updated_at``); on a stream use update mode.
    A built-in aggregation: it combines within each micro-batch before the shuffle."""
    order = F.struct("updated_at", "seq")
    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"), F.max("updated_at").alias("updated_at"))


class _Sessions:
    """The spells of activity of one job, usually one, and a timeout at the end of the first.

    Events are folded piece by piece as they come, in any order, so a job with any share of a batch is never held as a whole.
    State and rows of many jobs reach a worker together: asking a store job by job costs far more than the folding.
    """

    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def _pieces(self, rows: pd.DataFrame) -> list[list]:
        """Spells within one piece of the input, in order of time."""
        import numpy as np

        at = rows["updated_at"].to_numpy().astype("datetime64[us]").astype("int64")
        seq = rows["seq"].to_numpy()
        order = np.lexsort((seq, at))
        at, seq = at[order], seq[order]
        opens = np.flatnonzero(np.diff(at) > self.silence * 1000) + 1
        firsts, finals = np.concatenate(([0], opens)), np.concatenate((opens, [len(at)])) - 1
        status = rows["status"].to_numpy()[order[finals]]
        return [list(s) for s in zip(at[firsts].tolist(), at[finals].tolist(), seq[finals].tolist(), status.tolist(), (finals - firsts + 1).tolist())]

    def _merged(self, spells: list[list]) -> list[list]:
        out: list[list] = []
        for spell in sorted(spells, key=lambda s: s[0]):
            if out and spell[0] - out[-1][1] <= self.silence * 1000:
                held = out[-1]
                if (spell[1], spell[2]) > (held[1], held[2]):
                    held[1:4] = spell[1:4]
                held[4] += spell[4]
            else:
                out.append(list(spell))
        return out

    def _rows(self, key, spells: list[list], is_open: list[bool]) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        final = [s[3] if o else "FAILED" if s[3] in fixed.RUNNING_STATUSES else "CANCELLED" if s[3] == "CANCELLING" else s[3] for s, o in zip(spells, is_open)]
        error = [None if o or s[3] not in fixed.RUNNING_STATUSES else fixed.TIMEOUT_ERROR for s, o in zip(spells, is_open)]
        return pd.DataFrame({
            "job_id": [key[0]] * len(spells), "status": final, "error": error,
            "started_at": np.array([s[0] for s in spells], "datetime64[us]"), "updated_at": np.array([s[1] for s in spells], "datetime64[us]"),
            "events": [s[4] for s in spells], "is_open": is_open})

    def _due(self, spell: list) -> int:
        """The watermark (in ms) that ends the spell."""
        return -(-spell[1] // 1000) + self.silence

    def __call__(self, key, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        spells = [list(s) for s in zip(*state.get)] if state.exists else []
        rows, is_open = [], []
        if not state.hasTimedOut:
            for piece in pieces:
                spells = self._merged([*spells, *self._pieces(piece)])
            # Only the last spell is the job's present state; earlier ones wait for their end.
            rows, is_open = spells[-1:], [True] * len(spells[-1:])
        ended = [s for s in spells if self._due(s) <= now]
        left = [s for s in spells if self._due(s) > now]
        if left:
            state.update(tuple(list(column) for column in zip(*left)))
            state.setTimeoutTimestamp(self._due(left[0]))
        elif state.exists:
            state.remove()
        if rows or ended:
            yield self._rows(key, [*rows, *ended], [*is_open, *[False] * len(ended)])


def job_state_stream(events: DataFrame, hours: int = 2, lateness: str = "10 minutes") -> DataFrame:
    """The state of every job from its events (``job_id, seq, status, updated_at``), as a stream in update mode.

    A job with events in a batch gives a row with its present status (``is_open``). After ``hours`` without an event
    its timer gives one more row: a job left running has timed out, one left cancelling is cancelled, any other
    status is final as it is; then nothing of it is kept. Events that come later begin a new spell.
    Events more than ``lateness`` behind are dropped by the watermark and counted in the query's progress; nearer ones may
    come in any order. Events without job_id or time belong to no job.
    """
    states = STATES.format(job=events.schema["job_id"].dataType.simpleString())
    timed = events.where("job_id IS NOT NULL AND updated_at IS NOT NULL").select(
        "job_id", F.coalesce(F.col("seq").cast("long"), F.lit(0).cast("long")).alias("seq"), "status", "updated_at").withWatermark("updated_at", lateness)
    return timed.groupBy("job_id").applyInPandasWithState(
        _Sessions(hours * 3_600_000).__call__, states, SPELLS, "update", GroupStateTimeout.EventTimeTimeout)


def write_job_states(states: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes each batch of :func:`job_state_stream` to its own folder, so a repeated batch changes nothing."""
    for key, value in STORE.items():
        states.sparkSession.conf.set(key, value)
    return states.writeStream.outputMode("update").foreachBatch(
        lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")
    ).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def job_states(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every job: running, timed out or finished, at one time. The end of a spell follows its last event."""
    order = F.struct("updated_at", (~F.col("is_open")).alias("ended"), "batch")
    versions = spark.read.parquet(path)
    kept = [c for c in versions.columns if c not in ("job_id", "batch")]
    return versions.groupBy("job_id").agg(F.max_by(F.struct(*kept), order).alias("_s")).select("job_id", "_s.*")


def ended_spells(spark: SparkSession, path: str) -> DataFrame:
    """Every spell that has ended, once."""
    return spark.read.parquet(path).where("NOT is_open").drop("batch", "is_open")
