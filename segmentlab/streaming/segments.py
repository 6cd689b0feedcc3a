"""Merging transcript lines while they arrive.

Each job has its state in the state store: the lines that are held back for reordering, its open run, and how far
it has come. A batch reads and writes the state of the jobs that it has lines of and of no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from segmentlab.functions import fixed
from segmentlab.streaming.job_state import STORE

if TYPE_CHECKING:
    import pandas as pd

_LINE = "seq long, start_time double, end_time double, original_text string, translated_text string, speaker string"
_FIELDS = [f.split()[0] for f in _LINE.split(", ")]
_RUN = _LINE + ", n_lines long"
#: ``kind``: a closed run, the open run as it is now, or a late line.
_OUT = "job_id {job}, kind string, " + _RUN
_COLUMNS = ["seq", "start_time", "end_time", "original_text", "translated_text", "speaker", "n_lines"]


class _Runs(StatefulProcessor):
    """Merges the lines of one job. Lines go into the run in order of ``seq``, each once ``reorder`` later ones are held."""

    def __init__(self, max_gap: float, reorder: int, forget_ms: int):
        self.max_gap, self.reorder, self.forget = max_gap, reorder, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _LINE)
        self.run = handle.getValueState("run", _RUN)
        self.last = handle.getValueState("last", "seq long")
        # An ended job is remembered until its timer, to know its late lines.
        self.ended = handle.getValueState("ended", "seq long")

    def _extend(self, run: list | None, line: tuple) -> tuple[list, list | None]:
        """The run after a line, and the run that the line has closed. Parts of the texts are joined at the end."""
        seq, start, end, original, translated, speaker = line
        if run is not None and run[5] == speaker and start is not None and run[2] is not None and start - run[2] <= self.max_gap:
            run[2] = end
            run[3].append(original)
            run[4].append(translated)
            run[6] += 1
            return run, None
        return [seq, start, end, [original], [translated], speaker, 1], run

    @staticmethod
    def _joined(run: list) -> tuple:
        """The run with its parts of text as one, absent parts left out."""
        texts = []
        for parts in run[3:5]:
            given = [p for p in parts if p is not None]
            texts.append(" ".join(given) if given else None)
        return (*run[:3], *texts, *run[5:])

    @staticmethod
    def _plain(value):
        return None if value is None or value != value else value.item() if hasattr(value, "item") else value

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        import pandas as pd

        lines, marked, arrived = [], False, 0
        for piece in rows:
            arrived = max(arrived, int(piece["arrived"].max().timestamp() * 1000))
            lines += [tuple(self._plain(x) for x in line) for line in piece.loc[~piece["bare"], [*_FIELDS, "is_last"]].itertuples(index=False)]
            marked = marked or bool(piece["bare"].any())
        known = self.ended.get() if self.ended.exists() else self.last.get() if self.last.exists() else None
        over = self.ended.exists()
        passed = None if known is None else known[0]
        late = [line for line in lines if over or passed is not None and line[0] <= passed]
        on_time = [line for line in lines if not (over or passed is not None and line[0] <= passed)]
        waiting = sorted([*([tuple(h) for h in self.held.get()] if self.held.exists() else []), *(line[:-1] for line in on_time)], key=lambda line: line[0])
        ends = any(line[-1] for line in on_time) or marked and not over
        ready = waiting if ends else waiting[:max(len(waiting) - self.reorder, 0)]
        run = None
        if self.run.exists():
            own = list(self.run.get())
            run = [*own[:3], [own[3]], [own[4]], *own[5:]]
        closed = []
        for line in ready:
            run, done = self._extend(run, line)
            if done is not None:
                closed.append(self._joined(done))
        if ready:
            self.last.update((ready[-1][0],))
        if ends:
            if run is not None:
                closed.append(self._joined(run))
            self.ended.update((ready[-1][0] if ready else passed,))
            self.handle.registerTimer(arrived + self.forget)
            for state in (self.run, self.held, self.last):
                state.clear()
        elif on_time:
            if run is not None:
                self.run.update(self._joined(run))
            self.held.put(waiting[len(ready):]) if len(waiting) > len(ready) else self.held.clear()
        found = [("run", *r) for r in closed]
        if run is not None and not ends:
            found.append(("open", *self._joined(run)))
        elif ends:
            found.append(("end", None, None, None, None, None, None, 0))
        found += [("late", *line[:-1], 1) for line in late]
        if found:
            yield pd.DataFrame([(key[0], *f) for f in found], columns=["job_id", "kind", *_COLUMNS]).astype({"seq": "Int64", "n_lines": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ended.clear()
        return iter([])

    def close(self) -> None:
        pass


def merged_stream(lines: DataFrame, max_gap: float = fixed.MAX_GAP, reorder: int = 0, forget_hours: float = 72) -> DataFrame:
    """Lines of many jobs -> rows of ``kind`` run (closed), open (the job's run as it is now), end, and late.

    A run is closed once a line breaks it or ``is_last`` ends the job. ``reorder`` lines of a job are held back, so that a line may
    be overtaken by as many. A line at or before the last one that went into a run, or of a job that ended within ``forget_hours``, is late.
    The lines that one batch has of a job are in the memory of one task: limit the files per batch at the source for a large backlog.
    Lines without job_id or ``seq`` belong to no job; but a row of a job without ``seq`` whose ``is_last`` is set ends the job
    after the lines of its batch, even one that has had no line.
    """
    job_type = lines.schema["job_id"].dataType.simpleString()
    # Rows without ``seq`` get one, as pandas would turn the others' into floats; ``bare`` tells them apart.
    fields = (F.col(c).cast(t).alias(c) for c, t in (f.split() for f in _LINE.split(", ")))
    given = lines.where("job_id IS NOT NULL AND (seq IS NOT NULL OR is_last)").select(
        "job_id", *fields, F.coalesce("is_last", F.lit(False)).alias("is_last"), F.col("seq").isNull().alias("bare"), F.current_timestamp().alias("arrived"))
    given = given.withColumn("seq", F.coalesce("seq", F.lit(0).cast("long")))
    # The time of arrival is the clock of the timers; a batch's own is always ahead of the watermark.
    given = given.withWatermark("arrived", "1 hour")
    return given.groupBy("job_id").transformWithStateInPandas(
        _Runs(max_gap, reorder, int(forget_hours * 3_600_000)), _OUT.format(job=job_type), "Update", "EventTime")


def segment_stream(lines: DataFrame, out: str, checkpoint: str, max_gap: float = fixed.MAX_GAP, reorder: int = 0,
                   trigger: dict | None = None, forget_hours: float = 72) -> StreamingQuery:
    """Merged segments under ``out``, one folder per batch, so a repeated batch changes nothing. Read them with :func:`merged_segments`."""
    for key, value in STORE.items():
        lines.sparkSession.conf.set(key, value)
    merged = merged_stream(lines, max_gap, reorder, forget_hours)
    return merged.writeStream.outputMode("update").foreachBatch(
        lambda df, n: df.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/batch={n}")
    ).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _written(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def merged_segments(spark: SparkSession, out: str) -> DataFrame:
    """The closed runs of all batches."""
    return _written(spark, out).where("kind = 'run'").drop("kind", "batch")


def late_lines(spark: SparkSession, out: str) -> DataFrame:
    return _written(spark, out).where("kind = 'late'").drop("kind", "batch", "n_lines")


def open_segments(spark: SparkSession, out: str) -> DataFrame:
    """The run of every job that is still open, as of the last batch with lines of the job."""
    found = _written(spark, out).where("kind IN ('open', 'end')")
    newest = found.groupBy("job_id").agg(F.max("batch").alias("batch"))
    return found.join(newest, ["job_id", "batch"], "left_semi").where("kind = 'open'").drop("kind", "batch")
