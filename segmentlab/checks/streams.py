"""Queries that run as streams until everything given has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from segmentlab.checks.jobs import _EDITS, EDITED
from segmentlab.checks.registry import query
from segmentlab.checks.views import with_views
from segmentlab.session import shared_dir
from segmentlab.sources.transcripts import read_segments, write_segments
from segmentlab.streaming import edits as e
from segmentlab.streaming import segments as s
from segmentlab.streaming.job_state import current_job_state, ended_spells, job_state_stream, job_states, write_job_states


def _folder(v, name: str) -> str:
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


def _events(v):
    """The event table as a stream of status events."""
    stream = v.spark.readStream.schema(v.table("events").schema).parquet(f"{v.sf_dir}/event[s].parquet")
    status = F.expr("""CASE event_type WHEN 'click' THEN 'PROCESSING' WHEN 'signup' THEN 'CANCELLING' WHEN 'view' THEN 'AWAITING_REVIEW'
                       WHEN 'error' THEN 'PROCESSING_PHASE2' ELSE 'COMPLETED' END""")
    return stream.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"),
                         F.col("ts").cast("timestamp").alias("updated_at"))


def _run(stream, out: str, checkpoint: str, mode: str = "append"):
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(
        mode).trigger(availableNow=True).start()
    running.awaitTermination()


_STATES = """states AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'click' THEN 'PROCESSING' WHEN 'signup' THEN 'CANCELLING'
    WHEN 'view' THEN 'AWAITING_REVIEW' WHEN 'error' THEN 'PROCESSING_PHASE2' ELSE 'COMPLETED' END AS status FROM events)"""


_SPELLS = f"""{_STATES},
opened AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts, seq) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM states),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY job_id ORDER BY ts, seq) AS n FROM opened),
sessions AS (SELECT job_id, last(status ORDER BY ts, seq) AS last_status, max(ts) AS ts, count(*) AS events FROM numbered GROUP BY job_id, n),
judged AS (SELECT *, ts + INTERVAL 2 HOUR > (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AS is_open FROM sessions),
named AS (SELECT job_id, CASE WHEN is_open THEN last_status WHEN last_status LIKE 'PROCESSING%' THEN 'FAILED' WHEN last_status = 'CANCELLING' THEN 'CANCELLED' ELSE last_status END AS status,
       CASE WHEN last_status LIKE 'PROCESSING%' AND NOT is_open THEN 'Job timed out' END AS error, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at, events, is_open, ts FROM judged)"""


def _spell_stream(v) -> str:
    out = _folder(v, "sessions")
    write_job_states(job_state_stream(_events(v)), out, _folder(v, "checkpoint")).awaitTermination()
    return out


@query("job_state_stream", f"WITH {_SPELLS} SELECT job_id, status, error, updated_at, events FROM named WHERE NOT is_open")
def _(v):
    done = ended_spells(v.spark, _spell_stream(v)).drop("started_at")
    return done.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


# The same stream: running and timed-out jobs at one time.
@query("job_states", f"""WITH {_SPELLS}
SELECT job_id, status, error, updated_at, events, is_open FROM named QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC) = 1""")
def _(v):
    now = job_states(v.spark, _spell_stream(v)).drop("started_at")
    return now.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("current_job_state", f"""WITH {_STATES}
SELECT job_id, last(status ORDER BY ts, seq) AS status, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM states GROUP BY job_id""")
def _(v):
    out = _folder(v, "state")
    # Each batch writes the jobs it changed; the last version of a job is its state.
    running = current_job_state(_events(v)).writeStream.outputMode("update").foreachBatch(
        lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    ).option("checkpointLocation", _folder(v, "checkpoint")).trigger(availableNow=True).start()
    running.awaitTermination()
    versions = v.spark.read.parquet(out)
    last = versions.groupBy("job_id").agg(F.max_by(F.struct("status", "updated_at"), "batch").alias("_s"))
    return last.select("job_id", "_s.status", F.date_format("_s.updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


# The lines arrive in three parts; each is one run of the same stream.
@query("segment_stream", with_views("lines") + """,
flagged AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND start_time - lag(end_time) OVER w <= 0.8::DOUBLE THEN 0 ELSE 1 END AS opens
  FROM lines WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY job_id ORDER BY seq) AS run FROM flagged)
SELECT job_id, min(seq) AS seq, min(start_time) AS start_time, arg_max(end_time, seq) AS end_time, string_agg(original_text, ' ' ORDER BY seq) AS original_text,
       string_agg(translated_text, ' ' ORDER BY seq) AS translated_text, max(speaker) AS speaker, count(*) AS n_lines
FROM numbered GROUP BY job_id, run""")
def _(v):
    inbox, out, checkpoint = (_folder(v, n) for n in ("inbox", "out", "checkpoint"))
    lines = v.lines.withColumn("is_last", F.lit(False))
    top = lines.agg(F.max("seq")).first()[0]
    for part in range(3):
        low, high = top * part // 3 - (part == 0), top * (part + 1) // 3
        lines.filter((F.col("seq") > low) & (F.col("seq") <= high)).write.mode("append").parquet(inbox)
        stream = v.spark.readStream.schema(lines.schema).parquet(inbox)
        s.segment_stream(stream, out, checkpoint).awaitTermination()
    return s.merged_segments(v.spark, out).unionByName(s.open_segments(v.spark, out))


# The same in two parts, where odd jobs end with the first one; the lines of their second half come after the end and are late. Even jobs go on.
@query("segment_stream_late", with_views("lines") + """, half AS (SELECT max(seq) // 2 AS cut FROM lines),
taken AS (SELECT * FROM lines, half WHERE job_id % 2 = 0 OR seq <= cut),
flagged AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND start_time - lag(end_time) OVER w <= 0.8::DOUBLE THEN 0 ELSE 1 END AS opens
  FROM taken WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY job_id ORDER BY seq) AS run FROM flagged)
SELECT job_id, min(seq) AS seq, string_agg(original_text, ' ' ORDER BY seq) AS original_text, count(*) AS n_lines, false AS is_late FROM numbered GROUP BY job_id, run
UNION ALL SELECT job_id, seq, original_text, 1, true FROM lines, half WHERE job_id % 2 = 1 AND seq > cut""")
def _(v):
    inbox, out, checkpoint = (_folder(v, n) for n in ("inbox", "out", "checkpoint"))
    half = F.floor(v.lines.agg(F.max("seq")).first()[0] / F.lit(2))
    last = v.lines.filter(F.col("seq") <= half).groupBy("job_id").agg(F.max("seq").alias("last"))
    marked = v.lines.join(last, "job_id", "left").withColumn("is_last", F.coalesce((F.col("job_id") % 2 == 1) & (F.col("seq") == F.col("last")), F.lit(False))).drop("last")
    # An odd job without a line in the first part ends with it all the same.
    bare = v.lines.filter("job_id % 2 = 1").select("job_id").distinct().join(last, "job_id", "left_anti").withColumn("is_last", F.lit(True))
    for part in (marked.filter(F.col("seq") <= half).unionByName(bare, allowMissingColumns=True), marked.filter(F.col("seq") > half)):
        part.write.mode("append").parquet(inbox)
        stream = v.spark.readStream.schema(marked.schema).parquet(inbox)
        s.segment_stream(stream, out, checkpoint).awaitTermination()
    runs = s.merged_segments(v.spark, out).unionByName(s.open_segments(v.spark, out)).select("job_id", "seq", "original_text", "n_lines", F.lit(False).alias("is_late"))
    return runs.unionByName(s.late_lines(v.spark, out).select("job_id", "seq", "original_text", F.lit(1).cast("long").alias("n_lines"), F.lit(True).alias("is_late")))


@query("edit_stream", EDITED + """
SELECT s.job_id, s.id, CASE WHEN e.id IS NULL THEN s.translated_text ELSE e.translated_text END AS translated_text, e.id IS NOT NULL AS is_edited
FROM segments s LEFT JOIN last_edits e ON e.job_id = s.job_id AND e.id = s.id""")
def _(v):
    inbox, log, checkpoint, table = (_folder(v, n) for n in ("inbox", "log", "checkpoint", "table"))
    edits = v.sql(_EDITS)
    write_segments(v.segments, table)
    segments = read_segments(v.spark, table, with_bucket=True)
    for turn in ("seq = 0", "seq > 0"):
        edits.filter(turn).write.mode("append").parquet(inbox)
        stream = v.spark.readStream.schema(edits.schema).parquet(inbox)
        e.edit_stream(stream, segments, log, checkpoint).awaitTermination()
    return e.edited_segments(v.spark, segments, log).select("job_id", "id", "translated_text", "is_edited")
