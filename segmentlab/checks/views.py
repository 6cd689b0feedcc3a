"""Operator inputs as views over the given tables.

The same text runs in Spark SQL and in DuckDB. Every view is row by row or a
grouping that combines early, so its cost grows with the tables and no view
needs a whole conversation, user or video in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


# White space as SQL patterns spell it.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)

TABLES = ["events", "orders", "documents", "conversations", "pages", "customer"]

# Time of day of turn t: a slot of 8 s shifted by up to 6 s, and a pause of 0 to 1.6 s before the next.
_SLOT = "({t} * 8000 + ({j} * 7 + {t} * {t} * 5 + {t} * 3) % 16 * 400)"


def _times(job: str, turn: str) -> str:
    start = _SLOT.format(j=job, t=turn)
    end = _SLOT.format(j=job, t=f"({turn} + 1)") + f" - ({job} + {turn} * 7) % 5 * 400"
    return start, end


_START, _END = _times("conv_id", "turn")

VIEWS = {
    "segments": ([], f"""
        SELECT conv_id AS job_id, turn AS seq, conv_id * 1000003 + turn AS id,
               cast({_START} AS double) / 1000 AS start_time, cast({_END} AS double) / 1000 AS end_time,
               text AS original_text,
               CASE WHEN (conv_id * 3 + turn) % 5 = 0 THEN NULL
                    WHEN (conv_id * 3 + turn) % 5 = 1 THEN text
                    WHEN (conv_id * 3 + turn) % 5 = 2 AND conv_id % 3 = 0 THEN ''
                    WHEN (conv_id + turn) % 7 = 0 THEN concat('vi ', text, ' 你好 ,ok')
                    ELSE concat('vi ', text) END AS translated_text,
               CASE WHEN role = 'system' THEN NULL
                    ELSE concat('SPEAKER_0', cast(cast(floor(turn / 2) AS bigint) % 2 AS string)) END AS speaker
        FROM conversations"""),
    # The same lines as a dozen long transcripts.
    "lines": ([], f"""
        SELECT conv_id % 12 AS job_id, conv_id * 100 + turn AS seq,
               cast(conv_id * 800000 + {_START} AS double) / 1000 AS start_time,
               cast(conv_id * 800000 + {_END} AS double) / 1000 AS end_time,
               text AS original_text, concat('vi ', text) AS translated_text,
               CASE WHEN role = 'system' THEN NULL
                    ELSE concat('SPEAKER_0', cast(cast(floor(turn / 2) AS bigint) % 2 AS string)) END AS speaker
        FROM conversations"""),
    "tracks": (["segments"], """
        SELECT job_id, CASE WHEN job_id % 2 = 0 THEN 22050 ELSE 16000 END AS sample_rate,
               cast(max(end_time) * 0.5e0 * 16000 AS bigint) AS total_frames
        FROM segments WHERE job_id % 9 <> 4 GROUP BY job_id"""),
    "jobs": ([], """
        SELECT o_orderkey AS job_id,
               concat('clip_', cast(o_custkey AS string), CASE WHEN o_custkey % 2 = 0 THEN '.MP4' ELSE '.mp4' END) AS filename,
               CASE o_orderkey % 7 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'AWAITING_REVIEW'
                    WHEN 3 THEN 'PROCESSING_PHASE2' WHEN 4 THEN 'COMPLETED' WHEN 5 THEN 'FAILED' ELSE 'CANCELLING' END AS status,
               cast(o_orderdate AS timestamp) AS created_at, cast(o_orderdate AS timestamp) AS updated_at,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat(
                 '{"phase1":{"audio_separate":{"success":', CASE WHEN o_orderkey % 13 = 0 THEN 'false' ELSE 'true' END,
                 ',"duration":', cast(o_orderkey % 50 AS string), ',"error":null}',
                 ',"video_ocr":{"success":', CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE 'true' END, ',"duration":2,"error":null}',
                 CASE WHEN o_orderkey % 4 <> 0 THEN concat(',"transcribe":{"success":',
                    CASE WHEN o_orderkey % 11 = 0 THEN 'false' ELSE 'true' END, ',"duration":3.5,"error":null}') ELSE '' END,
                 CASE WHEN o_orderkey % 4 > 1 THEN ',"translate":{"success":true,"duration":4,"error":null}' ELSE '' END, '}',
                 CASE WHEN o_orderkey % 5 = 3 THEN concat(',"phase2":{"synthesize":{"success":',
                    CASE WHEN o_orderkey % 17 = 0 THEN 'false' ELSE 'true' END, ',"duration":6,"error":null}',
                    ',"lip_sync":{"success":false,"duration":1,"error":"no face"}',
                    CASE WHEN o_orderkey % 2 = 0 THEN ',"video_ocr":{"success":true,"duration":9,"error":null}' ELSE '' END,
                    ',"mux":{"success":true,"duration":1.5,"error":null}}') ELSE '' END, '}') END AS results,
               CASE WHEN o_orderkey % 19 = 0 THEN 'old error' ELSE NULL END AS error,
               o_orderkey % 3 = 0 AS auto_resume,
               CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE o_orderkey % 2 = 0 END AS enable_lipsync
        FROM orders"""),
    "outputs": ([], "SELECT concat('clip_', cast(c_custkey AS string)) AS base_name FROM customer WHERE c_custkey % 4 = 0"),
    "files": ([], """
        SELECT concat('clip_', cast(c_custkey * 2 AS string), CASE c_custkey % 5 WHEN 0 THEN '.MP4' WHEN 1 THEN '.txt'
                      WHEN 2 THEN '.MKV' ELSE CASE WHEN c_custkey % 2 = 1 THEN '.mp4' ELSE '.MP4' END END) AS filename,
               c_custkey AS n
        FROM customer"""),
    "updates": ([], """
        SELECT user_id * 7 AS job_id, event_id AS seq,
               CASE event_type WHEN 'click' THEN 'PROCESSING' WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'AWAITING_REVIEW'
                    WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
               CASE WHEN event_id % 4 = 0 THEN concat('{"phase1":{"mux":{"success":true,"duration":', cast(event_id % 10 AS string), '}}}')
                    ELSE NULL END AS results,
               CASE WHEN event_id % 6 = 0 THEN concat('e', cast(event_id AS string)) ELSE NULL END AS error,
               cast(ts AS timestamp) AS updated_at
        FROM events"""),
    # Eight videos of 1920 x 1080, 30 frames a second, one scanned frame in 15.
    "det0": ([], """
        SELECT event_id % 8 AS video_id, cast(floor(floor(event_id / 8) / 4) AS bigint) AS s,
               cast(floor(event_id / 8) AS bigint) % 4 AS box_pos, event_id, user_id, value, event_type
        FROM events"""),
    "frames": (["det0"], "SELECT DISTINCT video_id, s * 15 AS frame_idx FROM det0"),
    # A logo (0), a subtitle line (1) and scene text (2, 3); every 11th scanned frame has no text.
    "detections": (["det0"], """
        SELECT video_id, s * 15 AS frame_idx, box_pos,
               CASE box_pos WHEN 0 THEN 40 WHEN 1 THEN 300 + user_id % 7 * 20 ELSE event_id * 37 % 1700 END AS x,
               CASE box_pos WHEN 0 THEN 40 WHEN 1 THEN 960 ELSE event_id * 53 % 1000 END AS y,
               CASE box_pos WHEN 0 THEN 200 WHEN 1 THEN 900 ELSE 40 + cast(floor(value) AS bigint) % 200 END AS w,
               CASE box_pos WHEN 0 THEN 60 WHEN 1 THEN 60 ELSE 20 + user_id % 60 END AS h
        FROM det0 WHERE s % 11 <> 0 AND (box_pos <> 3 OR event_type <> 'view')"""),
    "videos": (["frames"], """
        SELECT video_id, cast(1920 AS bigint) AS width, cast(1080 AS bigint) AS height, cast(30 AS double) AS fps,
               max(frame_idx) + 15 AS total_frames, cast(15 AS bigint) AS frame_skip
        FROM frames GROUP BY video_id"""),
    # At most one box per cell and video, some of them large.
    "cell_boxes": ([], """
        SELECT video_id, gx, gy, gx * 20 + least(min(event_id % 19), 7) AS x, gy * 20 + min(event_id % 17) AS y,
               30 + max(event_id * 31 % 900) AS w, 15 + max(event_id * 17 % 700) AS h
        FROM (SELECT event_id % 40 AS video_id, event_id * 7 % 90 AS gx, event_id * 11 % 50 AS gy, event_id
              FROM events) e GROUP BY video_id, gx, gy"""),
    "cell_videos": ([], """
        SELECT DISTINCT event_id % 40 AS video_id, cast(1920 AS bigint) AS width, cast(1080 AS bigint) AS height FROM events"""),
    # The first frames of each video with the bands of text in them.
    "band_rows": (["detections"], """
        SELECT DISTINCT video_id, cast(floor(y / 42) AS bigint) AS row_id, frame_idx FROM detections WHERE box_pos > 0"""),
    "reservations": ([], """
        SELECT concat('pool_', cast(user_id % 3 AS string)) AS pool, event_type AS service, cast(value * 0.25e0 AS double) AS gb,
               (event_id * 97 % 100000) * 1000000 AS acquired_us,
               CASE WHEN event_id % 50 = 0 THEN NULL ELSE (event_id * 97 % 100000 + 1 + user_id % 40) * 1000000 END AS released_us
        FROM events"""),
    "series": ([], """
        SELECT user_id AS asset, event_id AS idx, CASE WHEN user_id % 10 = 0 THEN value / 1000000 ELSE value / 100 END AS value
        FROM events"""),
    "docs": ([], "SELECT doc_id, text, lang FROM documents"),
    # Every text with a tail that holds all constructs the rules look for.
    "rich": ([], """
        SELECT doc_id, lang, concat(text, ' tel 09', cast(10000000 + doc_id AS string), ' +84 ', cast(100000000 + doc_id * 37 AS string),
               ' AI va NASA x', cast(doc_id AS string), 'km ', cast(doc_id * 7 AS string), '-', cast(doc_id * 7 + 5 AS string),
               ' $', cast(doc_id AS string), '.50 ', cast(doc_id AS string), '% ', cast(doc_id * 1001 AS string), 'đ, ',
               cast(doc_id AS string), ' vnd & ', cast(doc_id % 10 AS string), ' + 2 = ', cast(doc_id % 10 + 2 AS string),
               ' 1.234.', cast(100 + doc_id % 900 AS string), ' ', cast(doc_id AS string), ',25 00', cast(doc_id AS string),
               CASE WHEN doc_id % 3 = 0 THEN ' ngày ngày 你好 , xin' ELSE ' tháng  tháng năm' END) AS text
        FROM documents"""),
}


def with_views(*names: str) -> str:
    """A WITH clause (without SELECT) that defines the named views and what they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)


class Views:
    """The views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # One small file is one split; the text rules are heavy per row.
        return table.repartition("doc_id") if name == "documents" else table

    def sql(self, text: str, *names: str) -> DataFrame:
        whole = f"{with_views(*names)} {text}" if names else text
        for name in TABLES:
            if re.search(rf"\b{name}\b", whole):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(whole)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}", name)
