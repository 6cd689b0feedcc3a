"""Queries on job rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from segmentlab.checks.registry import query
from segmentlab.checks.views import with_views
from segmentlab.functions import fixed
from segmentlab.operators import jobs as j
from segmentlab.operators.capacity import capacity_report, capacity_sweep, oversized_requests
from segmentlab.session import shared_dir
from segmentlab.sources.jobs import read_jobs

STAMP = "yyyy-MM-dd HH:mm:ss"


def _stamped(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.date_format(c, STAMP))
    return df


def stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S') AS {col}"


JOBS = with_views("jobs")
_WRITTEN = "2030-01-02 03:04:05"

# Rows that come in: known jobs again, new ones, and some twice.
_INCOMING = """SELECT CASE WHEN event_id % 2 = 0 THEN user_id ELSE -user_id END AS job_id, concat('clip_', cast(user_id AS string), '.mp4') AS filename,
    'QUEUED' AS status, cast(ts AS timestamp) AS updated_at FROM events"""


@query("upsert_jobs", JOBS + f""", incoming AS ({_INCOMING}),
fresh AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC) = 1)
SELECT job_id, filename, status, {stamp('updated_at')}, {stamp('created_at')}, results FROM jobs WHERE job_id NOT IN (SELECT job_id FROM fresh)
UNION ALL SELECT job_id, filename, status, {stamp('updated_at')}, '2030-01-02 03:04:05', NULL FROM fresh""")
def _(v):
    upserted = j.upsert_jobs(v.jobs, v.sql(_INCOMING), now=F.lit(_WRITTEN))
    return _stamped(upserted.select("job_id", "filename", "status", "updated_at", "created_at", "results"), "updated_at", "created_at")


# A job that is put in again is the latest of its file.
@query("latest_after_upsert", JOBS + f""", incoming AS ({_INCOMING}), fresh AS (SELECT DISTINCT job_id, filename FROM incoming),
both_ AS (SELECT job_id, filename, created_at FROM jobs WHERE job_id NOT IN (SELECT job_id FROM fresh)
  UNION ALL SELECT job_id, filename, TIMESTAMP '2030-01-02 03:04:05' FROM fresh)
SELECT filename, job_id FROM both_ QUALIFY row_number() OVER (PARTITION BY filename ORDER BY created_at DESC, job_id DESC) = 1""")
def _(v):
    return j.latest_job(j.upsert_jobs(v.jobs, v.sql(_INCOMING), now=F.lit(_WRITTEN))).select("filename", "job_id")


@query("apply_status_updates", with_views("jobs", "updates") + f""",
folded AS (SELECT job_id, last(status ORDER BY seq) AS status, last(updated_at ORDER BY seq) AS updated_at,
    last(results ORDER BY seq) FILTER (results IS NOT NULL) AS results,
    last(error ORDER BY seq) FILTER (results IS NULL AND error IS NOT NULL) AS error FROM updates GROUP BY job_id)
SELECT j.job_id, coalesce(f.status, j.status) AS status, strftime(coalesce(f.updated_at, j.updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at,
       coalesce(f.results, j.results) AS results, coalesce(f.error, j.error) AS error
FROM jobs j LEFT JOIN folded f ON f.job_id = j.job_id""")
def _(v):
    changed = j.apply_status_updates(v.jobs, v.updates)
    return _stamped(changed.select("job_id", "status", "updated_at", "results", "error"), "updated_at")


LATEST = """latest AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY filename ORDER BY created_at DESC, job_id DESC) = 1)"""


@query("latest_job", with_views("jobs", "files") + f", {LATEST} SELECT filename, job_id, status, {stamp('created_at')} FROM latest WHERE filename IN (SELECT filename FROM files)")
def _(v):
    return _stamped(j.latest_job(v.jobs, v.files).select("filename", "job_id", "status", "created_at"), "created_at")


@query("jobs_by_id", with_views("jobs", "updates") + "SELECT job_id, filename, status FROM jobs WHERE job_id IN (SELECT job_id FROM updates)")
def _(v):
    return j.jobs_by_id(v.jobs, v.updates).select("job_id", "filename", "status")


@query("jobs_by_status", JOBS + "SELECT job_id, filename, status FROM jobs WHERE status IN ('PROCESSING', 'AWAITING_REVIEW', 'PROCESSING_PHASE2')")
def _(v):
    return j.jobs_by_status(v.jobs, fixed.ACTIVE_STATUSES).select("job_id", "filename", "status")


_NOW = "1998-06-01 12:34:56.789"


@query("expire_stale", JOBS + f""",
marked AS (SELECT *, status IN ('PROCESSING', 'PROCESSING_PHASE2') AND updated_at < TIMESTAMP '1998-06-01 10:34:56' AS stale, status = 'CANCELLING' AS cancelling FROM jobs)
SELECT job_id, CASE WHEN stale THEN 'FAILED' WHEN cancelling THEN 'CANCELLED' ELSE status END AS status,
       CASE WHEN stale THEN 'Job timed out' ELSE error END AS error, stale OR cancelling AS is_changed,
       strftime(CASE WHEN stale OR cancelling THEN TIMESTAMP '{_NOW}' ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM marked""")
def _(v):
    expired = j.expire_stale(v.jobs, F.lit(_NOW).cast("timestamp"))
    return _stamped(expired.select("job_id", "status", "error", "is_changed", "updated_at"), "updated_at")


KNOWN = with_views("jobs", "files", "outputs") + f""", {LATEST},
known AS (SELECT f.filename, l.status, l.job_id, o.base_name IS NOT NULL AS has_output FROM files f LEFT JOIN latest l ON l.filename = f.filename
  LEFT JOIN outputs o ON o.base_name = regexp_replace(f.filename, '\\.[^.]*$', ''))
"""


@query("library_status", KNOWN + "SELECT filename, coalesce(status, CASE WHEN has_output THEN 'COMPLETED' ELSE 'PENDING' END) AS status, has_output, job_id FROM known")
def _(v):
    return j.library_status(v.files, v.jobs, v.outputs)


@query("status_lookup", KNOWN + "SELECT filename, coalesce(status, CASE WHEN has_output THEN 'COMPLETED' ELSE 'NOT_FOUND' END) AS status, job_id FROM known")
def _(v):
    return j.status_lookup(v.files, v.jobs, v.outputs)


# Results of both phases read by path, phase 2 first.
STAGES = JOBS + f""",
names AS (SELECT unnest({['audio_separate', 'video_ocr', 'transcribe', 'translate', 'synthesize', 'lip_sync', 'mux']}) AS stage,
                 unnest(range(7)) AS step),
staged AS (SELECT j.job_id, status, auto_resume, enable_lipsync, stage, step,
    json_extract(results, '$.phase2.' || stage) AS p2, coalesce(json_extract(results, '$.phase2.' || stage), json_extract(results, '$.phase1.' || stage)) AS r,
    json_extract(results, '$.phase2') IS NOT NULL AS has_p2 FROM jobs j, names),
read AS (SELECT *, cast(json_extract(r, '$.success') AS BOOLEAN) AS success, cast(json_extract(r, '$.duration') AS DOUBLE) AS duration,
    json_extract_string(r, '$.error') AS error FROM staged)
"""


@query("stage_results", STAGES + "SELECT job_id, stage, success, duration, error FROM read WHERE r IS NOT NULL")
def _(v):
    return j.stage_results(v.jobs.repartition("job_id"))


@query("phase_gate", STAGES + """,
gates AS (SELECT job_id, any_value(auto_resume) AS auto_resume, any_value(has_p2) AS has_p2,
    coalesce(bool_and(success) FILTER (r IS NOT NULL AND stage IN ('audio_separate', 'transcribe', 'translate')), true) AS phase1_ok,
    count(*) FILTER (r IS NOT NULL AND stage IN ('audio_separate', 'transcribe', 'translate')) AS n_required,
    bool_and(cast(json_extract(p2, '$.success') AS BOOLEAN)) FILTER (p2 IS NOT NULL AND stage <> 'lip_sync') AS p2_ok
  FROM read GROUP BY job_id)
SELECT job_id, phase1_ok, CASE WHEN has_p2 THEN coalesce(p2_ok, true) END AS phase2_ok, n_required,
       CASE WHEN has_p2 THEN CASE WHEN coalesce(p2_ok, true) THEN 'COMPLETED' ELSE 'FAILED' END WHEN NOT phase1_ok THEN 'FAILED'
            WHEN auto_resume THEN 'PROCESSING_PHASE2' ELSE 'AWAITING_REVIEW' END AS next_status FROM gates""")
def _(v):
    return j.phase_gate(v.jobs.repartition("job_id"))


@query("progress", STAGES + """,
stepped AS (SELECT *, stage = 'lip_sync' AND NOT coalesce(enable_lipsync, false) AS off, status IN ('PROCESSING', 'PROCESSING_PHASE2') AS busy FROM read),
marks AS (SELECT job_id, min(step) FILTER (busy AND r IS NULL AND NOT off) AS next_step, max(step) FILTER (success) AS passed_step FROM stepped GROUP BY job_id)
SELECT s.job_id, step, stage, CASE WHEN off THEN 'disabled' WHEN success THEN 'completed' WHEN r IS NOT NULL THEN 'failed' WHEN step = next_step THEN 'active' ELSE 'pending' END AS state,
       CASE WHEN status = 'COMPLETED' THEN 6 ELSE coalesce(next_step, passed_step, 0) END AS active_step,
       CASE WHEN status = 'COMPLETED' THEN 6 ELSE coalesce(next_step, passed_step, 0) END / 6 * 100 AS percent
FROM stepped s JOIN marks m ON m.job_id = s.job_id""")
def _(v):
    return j.progress(v.jobs.repartition("job_id"))


@query("stage_timings", STAGES + """
SELECT stage, count(*) AS runs, count(*) FILTER (success) AS passed, avg(duration) AS avg_seconds, max(duration) AS max_seconds
FROM read WHERE r IS NOT NULL GROUP BY stage""")
def _(v):
    return j.stage_timings(v.jobs.repartition("job_id"))


# Edits of real lines, of lines under a wrong job, and repeated ones.
_EDITS = """SELECT CASE WHEN (conv_id + turn) % 4 = 3 THEN -1 - conv_id ELSE conv_id END AS job_id, conv_id * 1000003 + turn AS id, k AS seq,
    concat('edit ', cast(k AS string)) AS translated_text
  FROM conversations, (SELECT DISTINCT event_id % 3 AS k FROM events) s WHERE (conv_id * 7 + turn) % 3 <> 0 AND k <= turn % 3"""
EDITED = with_views("segments") + f""", edits AS ({_EDITS}),
last_edits AS (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY job_id, id ORDER BY seq DESC) = 1)
"""


@query("apply_edits", EDITED + """
SELECT s.job_id, s.id, CASE WHEN e.id IS NULL THEN s.translated_text ELSE e.translated_text END AS translated_text, e.id IS NOT NULL AS is_edited
FROM segments s LEFT JOIN last_edits e ON e.job_id = s.job_id AND e.id = s.id""")
def _(v):
    return j.apply_edits(v.segments, v.sql(_EDITS)).select("job_id", "id", "translated_text", "is_edited")


@query("rejected_edits", EDITED + "SELECT * FROM edits e WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.job_id = e.job_id AND s.id = e.id)")
def _(v):
    return j.rejected_edits(v.segments, v.sql(_EDITS)).select("job_id", "id", "seq", "translated_text")


_FLAGS = """SELECT o_orderkey AS job_id, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS enable_lipsync,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS enable_ocr, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS ocr_mode,
    CASE WHEN o_orderkey % 2 = 0 THEN 'single' ELSE NULL END AS voice_mode, CASE WHEN o_orderkey % 7 = 0 THEN 'v1' ELSE NULL END AS voice_preset FROM orders"""


@query("job_settings", f"""SELECT job_id, coalesce(enable_lipsync, false) AS enable_lipsync, coalesce(enable_ocr, true) AS enable_ocr,
    coalesce(ocr_mode, 'blur') AS ocr_mode, coalesce(voice_mode, 'multi') AS voice_mode, coalesce(voice_preset, '') AS voice_preset FROM ({_FLAGS}) f""")
def _(v):
    return j.job_settings(v.sql(_FLAGS))


_DIRS = """SELECT concat('clip_', cast(o_custkey AS string)) AS name, max(cast(o_orderdate AS timestamp)) AS modified_at FROM orders GROUP BY o_custkey
    UNION ALL SELECT concat('other_', cast(c_custkey AS string)) AS name, cast('1998-01-01 00:00:00' AS timestamp) AS modified_at FROM customer"""


@query("stale_paths", JOBS + f""", dirs AS ({_DIRS})
SELECT name, {stamp('modified_at')} FROM dirs WHERE modified_at < TIMESTAMP '1999-05-31 12:34:56.789' AND name NOT IN (
  SELECT regexp_replace(filename, '\\.[^.]*$', '') FROM jobs WHERE status IN ('PROCESSING', 'AWAITING_REVIEW', 'PROCESSING_PHASE2'))""")
def _(v):
    return _stamped(j.stale_paths(v.sql(_DIRS), v.jobs, F.lit("1999-06-01 12:34:56.789").cast("timestamp")), "modified_at")


LEVELS = with_views("reservations") + """,
moves AS (SELECT pool, acquired_us AS at_us, gb::DECIMAL(18,6) AS delta FROM reservations WHERE gb <= 16
  UNION ALL SELECT pool, released_us, -gb::DECIMAL(18,6) FROM reservations WHERE gb <= 16 AND released_us IS NOT NULL),
levels AS (SELECT DISTINCT pool, at_us, (sum(delta) OVER (PARTITION BY pool ORDER BY at_us))::DOUBLE AS in_use FROM moves)
"""


@query("capacity_sweep", LEVELS + "SELECT pool, at_us, in_use, in_use > 16 AS is_over FROM levels")
def _(v):
    return capacity_sweep(v.reservations, 16.0)


@query("capacity_report", LEVELS + "SELECT pool, max(in_use) AS peak, count(*) FILTER (in_use > 16) AS over, count(*) AS instants FROM levels GROUP BY pool")
def _(v):
    return capacity_report(capacity_sweep(v.reservations, 16.0))


@query("oversized_requests", with_views("reservations") + "SELECT pool, service, gb, acquired_us FROM reservations WHERE gb > 24")
def _(v):
    return oversized_requests(v.reservations, 24.0).select("pool", "service", "gb", "acquired_us")


# Three ages of the job table: before styles and flags, with flags as numbers, and of today.
@query("jobs_over_versions", JOBS + """
SELECT job_id, filename, CASE WHEN job_id % 3 = 2 AND job_id % 5 > 0 THEN 'style' ELSE 'Tiêu chuẩn' END AS target_style,
    CASE WHEN job_id % 3 = 0 THEN false ELSE coalesce(enable_lipsync, false) END AS enable_lipsync, CASE WHEN job_id % 3 = 2 THEN job_id % 4 = 1 ELSE true END AS enable_ocr,
    'blur' AS ocr_mode, CASE WHEN job_id % 3 = 2 THEN auto_resume ELSE false END AS auto_resume, 'multi' AS voice_mode,
    CASE WHEN job_id % 3 = 2 THEN 'preset' ELSE '' END AS voice_preset FROM jobs""")
def _(v):
    root = f"{shared_dir(v.spark)}/jobs-{uuid.uuid4().hex}"
    slim = v.jobs.select("job_id", "filename", "status", "enable_lipsync", "auto_resume")
    oldest = slim.filter("job_id % 3 = 0").select("job_id", "filename", "status")
    older = slim.filter("job_id % 3 = 1").select("job_id", "filename", "status", F.col("enable_lipsync").cast("int").alias("enable_lipsync"))
    today = slim.filter("job_id % 3 = 2").withColumn("enable_ocr", F.col("job_id") % 4 == 1).withColumn("voice_preset", F.lit("preset")).withColumn(
        "target_style", F.when(F.col("job_id") % 5 > 0, F.lit("style")))
    oldest.write.parquet(f"{root}/now")
    today.write.mode("append").parquet(f"{root}/now")
    older.write.parquet(f"{root}/numbers")
    return read_jobs(v.spark, f"{root}/now", f"{root}/numbers").select("job_id", "filename", *fixed.JOB_DEFAULTS)
