"""Small cases by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from segmentlab.functions import fixed
from segmentlab.operators import capacity, ingest, jobs, quality, voices
from segmentlab.operators import detections as d
from segmentlab.operators import transcripts as t

SEGMENT = "job_id int, seq int, start_time double, end_time double, original_text string, translated_text string, speaker string"


def test_lines_a_second_apart_stay(spark):
    rows = [(1, 0, 0.0, 2.0, "Hello world", None, None), (1, 1, 3.0, 5.0, "Good morning", None, None)]
    assert t.merge_segments(spark.createDataFrame(rows, SEGMENT)).count() == 2


def test_one_speaker_becomes_one_line(spark):
    rows = [(1, 0, 0.0, 2.0, "a", None, "SPEAKER_00"), (1, 1, 2.0, 4.5, "b", None, "SPEAKER_00"), (1, 2, 4.5, 6.0, "c", None, "SPEAKER_00")]
    row = t.merge_segments(spark.createDataFrame(rows, SEGMENT)).first()
    assert (row.start_time, row.end_time, row.original_text, row.n_lines) == (0.0, 6.0, "a b c", 3)


def test_word_budget_rounds_half_to_even(spark):
    rows = [(1, i, 0.0, e, "a", None, None) for i, e in enumerate([0.0, 1.0, 3.0, 5.0])]
    got = t.with_word_budget(spark.createDataFrame(rows, SEGMENT)).orderBy("seq").collect()
    assert [r.max_words for r in got] == [2, 6, 16, 28]  # 5.5 -> 6, 16.5 -> 16, 27.5 -> 28


@pytest.mark.parametrize("answer,expected", [
    ('[{"id": 0, "translated": "xin"}]', {0: "xin"}),
    ('["xin chào"]', {}),
    ('Here you are:\n[{"id": "1", "translated": "a"},\n {"id": 1.9, "translated": "b"}] bye', {1: "b"}),
    ('{"id": 2, "translated": "alone"}', {2: "alone"}),
    ('[{"id": "2.7", "translated": "a"}, {"id": true, "translated": "b"}, {"id": null, "translated": "c"}]', {1: "b"}),
    ('[{"id": 3, "translated": ""}, {"translated": "x"}, "s", 5, {"id": 4, "translated": "y"}]', {4: "y"}),
    ('[{"id": 5}] and [{"id": 6, "translated": "z"}]', {}),
    ("no json", {}), (None, {}),
])
def test_parse_responses(spark, answer, expected):
    df = spark.createDataFrame([(1, 0, answer)], "job_id int, chunk int, response string")
    assert {r.id: r.translated for r in t.parse_responses(df).collect()} == expected


def test_missing_answer_takes_the_source(spark):
    rows = [(1, 0, 0.0, 2.0, "Hello world", None, None)]
    chunks = t.chunk_segments(spark.createDataFrame(rows, SEGMENT))
    answers = spark.createDataFrame([(1, 0, '["xin chào"]')], "job_id int, chunk int, response string")
    row = t.align_translations(chunks, t.parse_responses(answers)).first()
    assert row.translated_text == "Hello world" and row.is_missing


def test_infer_falls_back_to_single_items(spark):
    rows = [(1, i, 2.0 * i, 2.0 * i + 1, f"line {i}", None, "A") for i in range(5)]
    requests = t.build_requests(t.chunk_segments(spark.createDataFrame(rows, SEGMENT)), "vi", "plain")

    def fn(request):
        items = json.loads(request["items"])
        if len(items) > 1 or items[0]["text"] == "line 3":
            raise RuntimeError
        return json.dumps({"id": 0, "translated": items[0]["text"].upper()})

    got = t.parse_responses(t.batch_infer(requests, fn, concurrency=2)).collect()
    assert {r.id: r.translated for r in got} == {i: f"LINE {i}" for i in (0, 1, 2, 4)}


@pytest.mark.parametrize("lang,variant", [("Tiếng Việt (miền Nam)", "vi"), ("VI", "vi"), ("vietnamese", "vi"), ("English", "other")])
def test_prompt_variant(spark, lang, variant):
    assert spark.range(1).select(t.prompt_variant(F.lit(lang)).alias("v")).first().v == variant


def test_cache_key(spark):
    df = spark.createDataFrame([("Tiếng Việt", "Hài hước & châm biếm, thật dí dỏm"), ("English (US)", None)], "target_lang string, target_style string")
    got = [(r.lang_key, r.style_key) for r in t.with_cache_key(df).collect()]
    assert got == [("tiếng_việt", "hài_hước___châm_biếm__th"), ("english__us_", "")]


def test_parse_boxes(spark):
    polygon = [[10, 20], [110, 20], [110, 60], [10, 60]]
    items = [polygon, [polygon, ["text", 0.9]], "bad", [[1]], [], [[100, 5], [100, 5]], None]
    df = spark.createDataFrame([(1, 0, 320, 240, 640, 720, json.dumps(items)), (1, 1, 320, 240, 640, 720, None)],
                               "video_id int, frame_idx int, small_w long, small_h long, width long, height long, items string")
    got = sorted(tuple(r)[2:] for r in d.parse_boxes(df).collect())
    # x0 = 0, y0 = 10, x1 = 120, y1 = 70 in the small frame; doubled in x, tripled in y.
    assert got == [(0, 0, 30, 240, 180), (1, 0, 30, 240, 180), (5, 180, 0, 40, 45)]


def test_clamp_even(spark):
    videos = spark.createDataFrame([(0, 641, 361)], "video_id int, width long, height long")
    boxes = spark.createDataFrame([(0, 0, 0, 10, 10), (0, 101, 51, 30, 21), (0, 630, 350, 50, 50), (0, 640, 360, 1, 1)],
                                  "video_id int, x long, y long, w long, h long")
    got = {tuple(r)[1:] for r in d.clamp_even(boxes, videos).select("video_id", "x", "y", "w", "h", "radius").collect()}
    assert got == {(0, 0, 16, 16, 3), (94, 44, 42, 34, 7), (624, 344, 16, 16, 3)}


def test_frame_index_keys(spark):
    videos = spark.createDataFrame([(0, 10.0, 30)], "video_id int, fps double, total_frames int")
    samples = spark.createDataFrame([(0, i) for i in range(4)], "video_id int, sample int")
    got = d.frame_index_map(videos, samples, ocr_fps=1.0).collect()
    assert {r.frame_idx for r in got} == {0, 10, 20, 29}


def test_two_boxes_of_a_frame_in_a_cell_count_twice(spark):
    frames = spark.createDataFrame([(0, f) for f in range(4)], "video_id int, frame_idx int")
    boxes = spark.createDataFrame([(0, 0, 0, 5, 5, 10, 10), (0, 1, 0, 6, 6, 11, 11), (0, 0, 1, 41, 1, 9, 9)],
                                  "video_id int, frame_idx int, box_pos int, x int, y int, w int, h int")
    got = [tuple(r) for r in d.static_boxes(boxes, frames).collect()]
    assert got == [(0, 0, 0, 2, 6, 6, 11, 11)]  # int(4 * 0.7) = 2 hits needed


def test_median_needs_three_frames(spark):
    rows = [(v, f, p, 100 + f) for v, n in ((0, 2), (1, 4)) for f in range(n) for p in range(3)]
    got = d.median_baseline(spark.createDataFrame(rows, "video_id int, frame_idx int, pos int, value int")).collect()
    assert {tuple(r) for r in got} == {(1, p, 101) for p in range(3)}


JOB = "job_id string, filename string, status string, created_at timestamp, updated_at timestamp, results string, error string"


def _job(spark, *rows):
    return spark.createDataFrame([r + (None,) * (7 - len(r)) for r in rows], JOB)


def test_active_jobs_keep_their_folder(spark):
    at = dt.datetime(2024, 1, 1)
    df = _job(spark, ("j1", "MOVIE.MP4", "AWAITING_REVIEW", at, at), ("j2", "b.mp4", "COMPLETED", at, at))
    assert [r.job_id for r in jobs.jobs_by_status(df, fixed.ACTIVE_STATUSES).collect()] == ["j1"]
    assert jobs.jobs_by_status(df, []).count() == 0
    dirs = spark.createDataFrame([("MOVIE", at), ("b", at), ("new", at + dt.timedelta(days=9))], "name string, modified_at timestamp")
    stale = jobs.stale_paths(dirs, df, F.lit(dt.datetime(2024, 1, 9)))
    assert [r.name for r in stale.collect()] == ["b"]


@pytest.mark.parametrize("name,base", [("a.mp4", "a"), ("clip.v2.mkv", "clip.v2"), (".mp4", ".mp4"), ("a..mp4", "a."), ("..a", "..a"), ("x", "x")])
def test_base_name_is_splitext(spark, name, base):
    import os

    assert os.path.splitext(name)[0] == base
    assert spark.range(1).select(jobs.base_name(F.lit(name)).alias("b")).first().b == base


def test_stale_cutoff_is_at_whole_seconds(spark):
    now = dt.datetime(2024, 1, 1, 12, 0, 0, 900_000)
    edge = dt.datetime(2024, 1, 1, 10, 0, 0)
    df = _job(spark, ("a", "f", "PROCESSING", edge, edge), ("b", "f", "PROCESSING", edge, edge - dt.timedelta(microseconds=1)),
              ("c", "f", "CANCELLING", edge, now), ("d", "f", "COMPLETED", edge, edge - dt.timedelta(days=1)))
    got = {r.job_id: (r.status, r.error, r.is_changed) for r in jobs.expire_stale(df, F.lit(now)).collect()}
    assert got == {"a": ("PROCESSING", None, False), "b": ("FAILED", "Job timed out", True),
                   "c": ("CANCELLED", None, True), "d": ("COMPLETED", None, False)}


def test_updates_never_clear(spark):
    at = dt.datetime(2024, 1, 1)
    df = _job(spark, ("a", "f", "QUEUED", at, at, None, None))
    updates = spark.createDataFrame(
        [("a", 1, "PROCESSING", None, "first", at), ("a", 2, "PROCESSING", "{}", "ignored", at), ("a", 3, "COMPLETED", None, None, at),
         ("zz", 1, "FAILED", None, None, at)], "job_id string, seq int, status string, results string, error string, updated_at timestamp")
    rows = jobs.apply_status_updates(df, updates).collect()
    assert [(r.status, r.results, r.error) for r in rows] == [("COMPLETED", "{}", "first")]


def test_upsert_replaces_whole_rows(spark):
    at = dt.datetime(2024, 1, 1)
    df = _job(spark, ("a", "f", "FAILED", at, at, "{}", "bad"), ("b", "g", "QUEUED", at, at))
    incoming = spark.createDataFrame([("a", "f", "QUEUED", at)], "job_id string, filename string, status string, updated_at timestamp")
    now = dt.datetime(2024, 2, 2)
    got = {r.job_id: r for r in jobs.upsert_jobs(df, incoming, now=F.lit(now)).collect()}
    assert got["a"].status == "QUEUED" and got["a"].error is None and got["a"].results is None and got["a"].created_at == now
    assert got["b"].status == "QUEUED" and got["b"].created_at == at


def test_a_job_put_in_again_is_the_latest(spark):
    at = dt.datetime(2024, 1, 1)
    df = _job(spark, ("a", "f", "FAILED", at, at), ("b", "f", "FAILED", at + dt.timedelta(1), at))
    incoming = spark.createDataFrame([("a", "f", "QUEUED", at, "plain")], "job_id string, filename string, status string, updated_at timestamp, style string")
    after = jobs.upsert_jobs(df, incoming)
    assert after.columns == [*df.columns, "style"]
    assert [(r.job_id, r.status, r.style) for r in jobs.latest_job(after).collect()] == [("a", "QUEUED", "plain")]


def _results(**phases):
    return json.dumps({p: {s: {"success": ok, "duration": 1, "error": None} for s, ok in stages.items()} for p, stages in phases.items()})


@pytest.mark.parametrize("results,auto,expected", [
    (_results(phase1={"audio_separate": True, "video_ocr": False, "transcribe": True, "translate": True}), False, "AWAITING_REVIEW"),
    (_results(phase1={"audio_separate": True, "transcribe": True}), True, "PROCESSING_PHASE2"),
    (_results(phase1={"audio_separate": False}), True, "FAILED"),
    (_results(phase1={"audio_separate": True}, phase2={"synthesize": True, "lip_sync": False, "mux": True}), False, "COMPLETED"),
    (_results(phase1={"audio_separate": True}, phase2={"synthesize": True, "mux": False}), False, "FAILED"),
    (None, False, "AWAITING_REVIEW"),
])
def test_phase_gate(spark, results, auto, expected):
    df = spark.createDataFrame([("a", results, auto)], "job_id string, results string, auto_resume boolean")
    assert jobs.phase_gate(df).first().next_status == expected


def test_edits_are_scoped_to_their_job(spark):
    segments = spark.createDataFrame([("j1", 1, "old"), ("j1", 2, "old")], "job_id string, id int, translated_text string")
    edits = spark.createDataFrame([("j2", 1, 1, "x"), ("j1", 2, 1, "y"), ("j1", 2, 2, "z")], "job_id string, id int, seq int, translated_text string")
    got = {r.id: (r.translated_text, r.is_edited) for r in jobs.apply_edits(segments, edits).collect()}
    assert got == {1: ("old", False), 2: ("z", True)}
    assert [r.job_id for r in jobs.rejected_edits(segments, edits).collect()] == ["j2"]


def test_capacity(spark):
    rows = [("p", 5.0, 0, 10), ("p", 11.0, 5, 20), ("p", 1.0, 10, None), ("p", 20.0, 1, 2), ("p", 8.0, 15, 16)]
    df = spark.createDataFrame(rows, "pool string, gb double, acquired_us long, released_us long")
    got = {r.at_us: (r.in_use, r.is_over) for r in capacity.capacity_sweep(df, 16.0).collect()}
    assert got == {0: (5.0, False), 5: (16.0, False), 10: (12.0, False), 15: (20.0, True), 16: (12.0, False), 20: (1.0, False)}
    assert capacity.oversized_requests(df, 16.0).count() == 1


def test_watch(spark):
    now = dt.datetime(2024, 1, 1, 12)
    old, fresh = now - dt.timedelta(minutes=5), now - dt.timedelta(seconds=4)
    files = spark.createDataFrame([("new.MP4", old), ("busy.mp4", fresh), ("done.mp4", old), ("again.mp4", old), ("failed.mp4", old), ("a.txt", old)],
                                  "filename string, modified_at timestamp")
    job_rows = _job(spark, ("1", "done.mp4", "COMPLETED", old, old), ("2", "again.mp4", "FAILED", old, old), ("3", "failed.mp4", "FAILED", old, old),
                    ("0", "again.mp4", "COMPLETED", old - dt.timedelta(days=1), old))
    copies = spark.createDataFrame([("again.mp4", old - dt.timedelta(seconds=1)), ("failed.mp4", old)], "filename string, modified_at timestamp")
    got = {r.filename: r.decision for r in ingest.watch_eligible(files, job_rows, copies, F.lit(now)).collect()}
    assert got == {"new.MP4": "import", "busy.mp4": "defer", "done.mp4": "skip_job", "again.mp4": "import", "failed.mp4": "skip_copy", "a.txt": "ignore"}


def test_quality(spark):
    assets = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p3")], "asset string, path string")
    listing = spark.createDataFrame([("p1", 10), ("p2", 0)], "path string, length long")
    valid = quality.file_valid(assets, listing)
    assert {r.asset: r.file_reason for r in valid.collect()} == {"a": "ok", "b": "file empty", "c": "file not found"}
    loud = quality.not_silent(spark.createDataFrame([("a", 0.5), ("a", -0.5), ("b", 0.0001)], "asset string, value double"))
    ratio = quality.stretch_within(spark.createDataFrame([("a", 3.0, 2.0), ("b", 3.1, 2.0), ("c", 1.0, 0.0)],
                                                         "asset string, original_duration double, new_duration double"))
    report = quality.gate_report((valid, "file_valid"), (loud, "not_silent"), (ratio, "stretch_ok"))
    assert {r.asset: r.verdict for r in report.collect()} == {"a": "PASS", "b": "FAIL", "c": "FAIL"}


def test_timeline_of_clips_with_one_start(spark):
    rows = [(1, 0, 0.0, 100, 100), (1, 1, 0.0, 300, 100), (1, 2, 2.0, 50, 200), (1, 3, 2.0, 70, 100)]
    df = spark.createDataFrame(rows, "job_id int, seq int, start_time double, n_samples long, sample_rate long")
    got = sorted((r.seq, r.start_sample, r.length, r.kept_length) for r in voices.timeline_placement(df).collect())
    assert got == [(0, 0, 100, 0), (1, 0, 300, 200), (2, 200, 25, 0), (3, 200, 70, 70)]


def test_latest_job_reads_wide_rows_once_and_never_sorts_them(spark):
    rows = [("f", i, f"j{i:03}", "x" * 50) for i in range(300)] + [("f", 299, "j9", "tie"), (None, None, "n1", "a"), (None, None, "n2", "b"), ("g", None, None, "c")]
    table = spark.createDataFrame(rows, "filename string, created_at long, job_id string, results string").repartition(7)
    latest = jobs.latest_job(table)
    assert sorted((r.filename or "", r.job_id, r.results) for r in latest.collect()) == [("", "n2", "b"), ("f", "j9", "tie"), ("g", None, "c")]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "max_by" not in plan
    assert "HashAggregate" in plan and "WindowGroupLimit" in plan
    asked = spark.createDataFrame([("g",), ("none",), ("g",)], "filename string")
    assert [r.results for r in jobs.latest_job(table, asked).collect()] == ["c"]
    assert jobs.latest_job(table.limit(0)).collect() == []
