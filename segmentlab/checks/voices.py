"""Queries on voice references and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from segmentlab.checks.registry import query
from segmentlab.checks.texts import TRIM
from segmentlab.checks.views import with_views
from segmentlab.checks.views import SPACE
from segmentlab.operators import voices as o
from segmentlab.sources.voices import usable_presets

REFERENCES = with_views("segments", "tracks") + f""",
words AS (SELECT *, end_time - start_time AS dur, regexp_replace(original_text, {TRIM}) AS said FROM segments),
spans AS (
  SELECT w.*, sample_rate IS NOT NULL AS has_audio,
         greatest(0, trunc(start_time * sample_rate)::BIGINT) AS ref_start,
         least(total_frames, trunc(least(end_time, start_time + 10) * sample_rate)::BIGINT) AS ref_end,
         CASE WHEN dur > 10 THEN array_to_string(regexp_split_to_array(said, '{SPACE}+')[1:greatest(1,
              round_even(len(regexp_split_to_array(said, '{SPACE}+')) * 10::DOUBLE / dur, 0)::BIGINT)], ' ') ELSE said END AS ref_text
  FROM words w LEFT JOIN tracks t ON t.job_id = w.job_id),
by_speaker AS (
  SELECT job_id, speaker, seq, ref_start, ref_end, ref_text FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, speaker ORDER BY dur DESC, seq) AS r FROM spans WHERE coalesce(speaker, '') <> '') x
  WHERE r = 1 AND has_audio AND ref_end > ref_start),
by_job AS (
  SELECT job_id, seq, ref_start, ref_end, ref_text FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY dur DESC, seq) AS r FROM spans) x
  WHERE r = 1 AND has_audio AND ref_end > ref_start)
"""


@query("speaker_reference", REFERENCES + "SELECT * FROM by_speaker")
def _(v):
    return o.speaker_reference(v.segments, v.tracks)


@query("global_reference", REFERENCES + "SELECT * FROM by_job")
def _(v):
    return o.global_reference(v.segments, v.tracks)


_SETTINGS = """SELECT DISTINCT job_id, CASE WHEN job_id % 3 = 0 THEN 'single' ELSE 'multi' END AS voice_mode,
    CASE job_id % 6 WHEN 0 THEN 'v1' WHEN 3 THEN 'v3' ELSE '' END AS voice_preset FROM segments"""
# Presets named after the languages of the corpus; the file of v3 is missing.
_PRESETS = """SELECT DISTINCT CASE lang WHEN 'en' THEN 'v1' WHEN 'fr' THEN 'v2' WHEN 'de' THEN 'v3' ELSE 'v4' END AS id,
    concat('voice ', lang) AS ref_text, concat(lang, '.wav') AS file FROM docs"""


@query("assign_reference", REFERENCES + f""", settings AS ({_SETTINGS}),
docs AS (SELECT lang FROM documents), presets AS ({_PRESETS}),
picked AS (
  SELECT s.job_id, s.seq, p.id AS preset, p.ref_text AS p_text, s.ref_start AS o_start, s.ref_end AS o_end, s.ref_text AS o_text,
         b.ref_start AS s_start, b.ref_end AS s_end, b.ref_text AS s_text, g.ref_start AS g_start, g.ref_end AS g_end, g.ref_text AS g_text,
         CASE WHEN voice_mode = 'single' THEN CASE WHEN p.id IS NOT NULL THEN 'preset' WHEN g.job_id IS NOT NULL THEN 'global' END
              WHEN dur >= 1.5 AND has_audio AND s.ref_end > s.ref_start THEN 'own'
              WHEN b.job_id IS NOT NULL THEN 'speaker' WHEN g.job_id IS NOT NULL THEN 'global' END AS kind
  FROM spans s JOIN settings c ON c.job_id = s.job_id
  LEFT JOIN presets p ON p.id = voice_preset AND p.file <> 'de.wav'
  LEFT JOIN by_speaker b ON b.job_id = s.job_id AND b.speaker = s.speaker
  LEFT JOIN by_job g ON g.job_id = s.job_id
  WHERE coalesce(translated_text, '') <> '' AND dur > 0)
SELECT job_id, seq, kind AS ref_kind, CASE kind WHEN 'preset' THEN preset END AS ref_voice,
       CASE kind WHEN 'own' THEN o_start WHEN 'speaker' THEN s_start WHEN 'global' THEN g_start END AS ref_start,
       CASE kind WHEN 'own' THEN o_end WHEN 'speaker' THEN s_end WHEN 'global' THEN g_end END AS ref_end,
       CASE kind WHEN 'preset' THEN p_text WHEN 'own' THEN o_text WHEN 'speaker' THEN s_text WHEN 'global' THEN g_text END AS ref_text
FROM picked""")
def _(v):
    catalogue = v.sql(_PRESETS, "docs")
    listing = catalogue.filter("file <> 'de.wav'").select(F.col("file").alias("filename"))
    return o.assign_reference(
        v.segments, v.tracks, o.speaker_reference(v.segments, v.tracks), o.global_reference(v.segments, v.tracks),
        usable_presets(catalogue, listing), v.sql(_SETTINGS, "segments"))


_CLIPS = """SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_id % 31 = 0 THEN 0 ELSE value END AS current_duration,
    CASE WHEN event_id % 37 = 0 THEN 0 ELSE cast(1 + event_id % 20 AS double) END AS target_duration FROM events"""
PLAN = f"""WITH clips AS ({_CLIPS}),
raw AS (SELECT *, CASE WHEN target_duration > 0 AND current_duration > 0 THEN current_duration / target_duration END AS r FROM clips),
plan AS (SELECT job_id, seq, current_duration, target_duration, CASE WHEN r IS NULL THEN NULL ELSE least(2.5::DOUBLE, greatest(0.4::DOUBLE, r)) END AS rate,
  CASE WHEN target_duration <= 0 THEN 'error' WHEN current_duration <= 0 THEN 'passthrough' WHEN r > 2.5 THEN 'clamped_high'
       WHEN r < 0.4::DOUBLE THEN 'clamped_low' ELSE 'ok' END AS state FROM raw)
"""


def _plan(v):
    return o.stretch_plan(v.sql(_CLIPS))


# A target of zero makes no rate in either engine; a NULL rate stays NULL through least/greatest in the plan.
@query("stretch_plan", PLAN + "SELECT * FROM plan")
def _(v):
    return _plan(v)


@query("stretch_distribution", PLAN + """
SELECT job_id, count(rate) AS n, min(rate) AS min_rate, max(rate) AS max_rate,
       round(quantile_cont(rate, 0.5), 6) AS median_rate, round(quantile_cont(rate, 0.9), 6) AS p90_rate,
       count(*) FILTER (state LIKE 'clamped%') AS clamped, count(*) FILTER (state = 'error') AS errors
FROM plan GROUP BY job_id""")
def _(v):
    spread = o.stretch_distribution(_plan(v))
    return spread.withColumn("median_rate", F.round("median_rate", 6)).withColumn("p90_rate", F.round("p90_rate", 6))


# Clips of 200 tracks; some start together, some rates are off.
_PLACED = """SELECT user_id % 200 AS job_id, event_id AS seq, cast((event_id * 7919 % 400000) * 0.25e0 AS double) AS start_time,
    cast(floor(value * 3000) AS bigint) AS n_samples,
    cast(CASE WHEN event_id % 10 = 0 THEN 16000 WHEN event_id % 3 = 0 AND user_id % 2 = 0 THEN 44100 ELSE 24000 END AS bigint) AS sample_rate FROM events"""
PLACED = f"""WITH clips AS ({_PLACED}),
counted AS (SELECT job_id, sample_rate, count(*) AS n FROM clips GROUP BY job_id, sample_rate),
rates AS (SELECT job_id, sample_rate AS out_rate FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, sample_rate) AS r FROM counted) x WHERE r = 1),
starts AS (SELECT c.job_id, seq, out_rate, trunc(start_time * out_rate)::BIGINT AS start_sample,
                  ceil(n_samples * out_rate / sample_rate)::BIGINT AS length FROM clips c JOIN rates r ON r.job_id = c.job_id),
placed AS (SELECT *, least(length, lead(start_sample) OVER (PARTITION BY job_id ORDER BY start_sample, seq) - start_sample) AS kept_length FROM starts)
"""


def _placed(v):
    return o.timeline_placement(v.sql(_PLACED))


@query("timeline_placement", PLACED + "SELECT * FROM placed")
def _(v):
    return _placed(v)


@query("timeline_length", PLACED + """
SELECT job_id, max(out_rate) AS out_rate, count(*) AS n_clips, max(start_sample + kept_length) AS total_samples FROM placed GROUP BY job_id""")
def _(v):
    return o.timeline_length(_placed(v))


@query("overlap_report", PLACED + """
SELECT job_id, count(*) AS n_clips, count(*) FILTER (length > kept_length) AS n_trimmed,
       sum(length - kept_length)::BIGINT / max(out_rate) AS trimmed_seconds FROM placed GROUP BY job_id""")
def _(v):
    return o.overlap_report(_placed(v))


_SERIES = """SELECT user_id % 20 AS job_id, event_id % 16 AS seq, cast(floor(event_id / 16) AS bigint) AS idx,
    CASE WHEN user_id % 2 = 0 THEN value / 100 ELSE value / 100000 END AS value FROM events"""
# Every clip loses its last two samples.
_OFFSETS = """SELECT user_id % 20 AS job_id, event_id % 16 AS seq, (event_id % 16) * 5 AS start_sample,
    max(cast(floor(event_id / 16) AS bigint)) - 1 AS kept_length FROM events GROUP BY user_id % 20, event_id % 16"""


@query("mixdown_series", f"""WITH series AS ({_SERIES}), offsets AS ({_OFFSETS}),
mixed AS (SELECT s.job_id, start_sample + idx AS idx, sum(value) AS value FROM series s JOIN offsets o
          ON o.job_id = s.job_id AND o.seq = s.seq WHERE idx < kept_length GROUP BY 1, 2),
peaks AS (SELECT job_id, max(abs(value)) AS peak FROM mixed GROUP BY job_id)
SELECT m.job_id, idx, round(CASE WHEN peak > 1 THEN value / peak ELSE value END, 9) AS value FROM mixed m JOIN peaks p ON p.job_id = m.job_id""")
def _(v):
    return o.mixdown_series(v.sql(_SERIES), v.sql(_OFFSETS)).withColumn("value", F.round("value", 9))
