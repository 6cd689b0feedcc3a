"""Sources, sinks and streams on temporary folders."""

import datetime
import json
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from segmentlab.operators import transcripts as t
from segmentlab.sources import media, transcripts, voices
from segmentlab.streaming import segments as s
from segmentlab.streaming import job_state
from segmentlab.streaming.edits import judged_edits
from segmentlab.streaming.watch import compact_log, job_log, watch_batch, watch_stream

SEGMENT = "job_id string, seq long, start_time double, end_time double, original_text string, translated_text string, speaker string"


def test_media(spark, tmp_path):
    files = {"a b.mp4": b"\0\0\0\x20ftypisom", "c.MKV": b"\x1a\x45\xdf\xa3" + b"\0" * 20, "d.avi": b"RIFF\0\0\0\0AVI LIST",
             "e.mp4": b"short", "f.mov": b"\xff\xd8\xff\xe0" + b"\0" * 20, "g.txt": b"\0\0\0\x20ftypisom", "ü+%.webm": b"\x1a\x45\xdf\xa3" + b"\0" * 20}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.MKV").write_bytes(b"")
    listed = media.scan_media(spark, str(tmp_path))
    assert {r.filename for r in listed.collect()} == set(files) - {"g.txt"}
    assert "content" not in str(listed._jdf.queryExecution().executedPlan())
    checked = media.validate_media(media.with_header(listed))
    assert {r.filename: r.reject_reason for r in checked.collect()} == {
        "a b.mp4": None, "c.MKV": None, "d.avi": None, "e.mp4": "not a known container", "f.mov": "not a known container", "ü+%.webm": None}
    gone = spark.createDataFrame([(f"file:{tmp_path}/gone.mp4", "gone.mp4", 10), ("nowhere://x/y.mp4", "y.mp4", 10)], "path string, filename string, length long")
    assert {r.reject_reason for r in media.validate_media(media.with_header(gone)).collect()} == {"not readable"}


def test_read_transcripts(spark, tmp_path):
    for job, document in {
        "j1": {"segments": [{"start": 0, "end": 1.5, "text": " one ", "speaker": "A"}, {"text": "  "}, {"text": "two"}]},
        "j+ 2": [{"start": 1, "end": 2, "text": "x", "speaker": None, "translated": "y"}], "j3": {"other": 1}, "j4": "broken",
    }.items():
        (tmp_path / job).mkdir()
        (tmp_path / job / "transcribe.json").write_text(json.dumps(document) if document != "broken" else "{", encoding="utf-8")
    got = sorted(tuple(r) for r in transcripts.read_transcripts(spark, str(tmp_path)).collect())
    assert got == [("j+ 2", 0, 1.0, 2.0, "x", "y", None), ("j1", 0, 0.0, 1.5, "one", None, "A"), ("j1", 1, 0.0, 0.0, "two", None, None)]
    rejects = {(r.job_id, r.reject_reason) for r in transcripts.read_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {("j3", "no segments"), ("j4", "not readable as JSON")}


def test_a_large_document_is_read_whole(spark):
    from pyspark.sql import functions as F

    lines = F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.struct(i.cast("double").alias("start"), F.repeat(F.lit("long line "), 80).alias("text")))
    documents = spark.range(1).select(F.col("id").alias("job_id"), F.to_json(F.struct(lines.alias("segments"))).alias("document"))
    assert transcripts.parse_transcripts(documents).count() == 200_000
    assert transcripts.transcript_rejects(documents).count() == 0


def stored(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_write_replaces_only_the_written_jobs(spark, tmp_path):
    path = str(tmp_path / "segments")
    first = spark.createDataFrame([(f"j{j}", i, 0.0, 1.0, "old", None, None) for j in range(6) for i in range(3)], SEGMENT)
    transcripts.write_segments(first, path, buckets=4)
    second = spark.createDataFrame([("j1", 0, 0.0, 1.0, "new", None, None), ("j9", 0, 0.0, 1.0, "new", None, None)], SEGMENT)
    transcripts.write_segments(second, path, buckets=4)
    got = {}
    for r in transcripts.read_segments(spark, path).collect():
        got.setdefault(r.job_id, []).append(r.original_text)
    assert got == {**{f"j{j}": ["old"] * 3 for j in (0, 2, 3, 4, 5)}, "j1": ["new"], "j9": ["new"]}
    assert transcripts.read_segments(spark, path, ["j2", "j9"], buckets=4).count() == 4
    emptied = spark.createDataFrame([("j2",), ("j3",), ("j4",), ("j5",), ("j0",)], "job_id string")
    transcripts.write_segments(first.limit(0), path, buckets=4, jobs=emptied)
    assert {r.job_id for r in transcripts.read_segments(spark, path).collect()} == {"j1", "j9"}
    transcripts.compact_segments(spark, path, str(tmp_path / "slim"), buckets=4)
    slim = transcripts.read_segments(spark, str(tmp_path / "slim"))
    assert sorted(r.job_id for r in slim.collect()) == ["j1", "j9"]
    assert stored(tmp_path / "slim") < stored(path)


def test_a_write_costs_what_it_writes(spark, tmp_path):
    """The bytes of replacing one job do not depend on the other jobs in the table, nor does a repeated write add any."""
    sizes = []
    for others in (20, 400):
        path = str(tmp_path / f"t{others}")
        rows = [(f"j{j}", i, 0.0, 1.0, f"text {j} {i}", None, None) for j in range(others) for i in range(5)]
        transcripts.write_segments(spark.createDataFrame(rows, SEGMENT), path, buckets=8)
        before = stored(path)
        one = spark.createDataFrame([("j3", 0, 0.0, 1.0, "new", None, None)], SEGMENT).coalesce(1)
        version = transcripts.write_segments(one, path, buckets=8)
        sizes.append(stored(path) - before)
        transcripts.write_segments(one, path, buckets=8, version=version)
        assert stored(path) - before == sizes[-1]
        assert transcripts.read_segments(spark, path).count() == (others - 1) * 5 + 1
    assert sizes[0] == sizes[1]


def test_a_write_that_broke_off_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 0, 0.0, 1.0, "old", None, None)], SEGMENT)
    transcripts.write_segments(rows, path, buckets=2, version=1)
    transcripts.write_segments(rows.withColumn("original_text", F.lit("new")), path, buckets=2, version=2)
    import shutil

    shutil.rmtree(f"{path}/jobs/write_version=2")
    assert [r.original_text for r in transcripts.read_segments(spark, path).collect()] == ["old"]


def test_edits_read_only_the_buckets_of_their_jobs(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"j{j}", i, 0.0, 1.0, "x", None, None) for j in range(60) for i in range(3)]
    segments = spark.createDataFrame(rows, SEGMENT).withColumn("id", F.xxhash64("job_id", "seq"))
    transcripts.write_segments(segments, path, buckets=32)
    table = transcripts.read_segments(spark, path, with_bucket=True)
    batch = segments.filter("job_id = 'j7' AND seq < 2").select("job_id", "id", "seq", F.lit("edit").alias("translated_text"))
    judged = judged_edits(batch, table, buckets=32)
    assert [r._known for r in judged.collect()] == [True, True]
    bucket = spark.range(1).select(transcripts.job_bucket(F.lit("j7"), 32)).first()[0]
    plan = judged._jdf.queryExecution().executedPlan().toString()
    filters = [f for f in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if "job_bucket" in f]
    assert filters and all(f"= {bucket})" in f for f in filters)


def test_export_and_read_back(spark, tmp_path):
    rows = [("j", i, float(i), i + 0.5, f"line {i}", None if i % 2 else "dịch", "A") for i in range(5)] + [("k", 0, 1.0, 2.0, 'a "b"\nc', None, None)]
    df = spark.createDataFrame(rows, SEGMENT)
    transcripts.export_transcripts(df, str(tmp_path / "out"), buckets=4)
    back = transcripts.read_export(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    arrays = transcripts.transcript_arrays(df)
    assert sorted((r.job_id, r.n_lines) for r in arrays.collect()) == [("j", 5), ("k", 1)]
    again = transcripts.parse_transcripts(arrays)
    assert sorted(r.original_text for r in again.collect()) == ['a "b"\nc', *(f"line {i}" for i in range(5))]


def test_voices(spark, tmp_path):
    (tmp_path / "voices.json").write_text(json.dumps({"voices": [
        {"id": "v1", "name": "N", "country": "C", "flag": "F", "lang": "vi", "gender": "f", "file": "v1.wav", "ref_text": "hi", "source": "s"},
        {"id": "v2", "name": "M", "lang": "en", "file": "v2.wav"}]}), encoding="utf-8")
    path = str(tmp_path / "voices.json")
    assert voices.read_voices(spark, path).columns == ["id", "name", "country", "flag", "lang", "gender"]
    listing = spark.createDataFrame([("v1.wav",)], "filename string")
    assert [r.id for r in voices.usable_presets(voices.read_catalogue(spark, path), listing).collect()] == ["v1"]


LINE = SEGMENT + ", is_last boolean"


def run_batches(spark, tmp_path, batches, **options):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for rows in batches:
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(inbox)
        s.segment_stream(spark.readStream.schema(LINE).parquet(inbox), out, checkpoint, **options).awaitTermination()
    return out


def test_segment_stream_with_ends_and_late_lines(spark, tmp_path):
    out = run_batches(spark, tmp_path, [
        [("a", 0, 0.0, 1.0, "a0", None, "X", False), ("a", 1, 1.0, 2.0, "a1", None, "X", False), ("b", 0, 0.0, 1.0, "b0", None, None, False)],
        [("a", 2, 2.5, 3.0, "a2", None, "X", False), ("a", 3, 9.0, 9.5, "a3", None, "X", None), ("a", 1, 1.0, 2.0, "late", None, "X", False)],
        [("b", 1, 1.2, 2.0, "b1", None, None, True), (None, 1, 1.2, 2.0, "no job", None, None, True)],
        [("b", 2, 2.2, 3.0, "b2", None, None, False)],
    ])
    assert sorted(r.original_text for r in s.merged_segments(spark, out).collect()) == ["a0 a1 a2", "b0 b1"]
    assert [r.original_text for r in s.open_segments(spark, out).collect()] == ["a3"]
    assert sorted((r.job_id, r.seq) for r in s.late_lines(spark, out).collect()) == [("a", 1), ("b", 2)]


def test_segment_stream_ends_a_job_without_a_line(spark, tmp_path):
    """A row without ``seq`` ends its job: c has had no line, d closes its run; lines that follow are late."""
    big = 10
    out = run_batches(spark, tmp_path, [
        [("d", big + 1, 0.0, 1.0, "d1", None, "X", False), ("d", big + 3, 1.2, 2.0, "d3", None, "X", False), ("d", None, None, None, None, None, None, True),
         ("c", None, None, None, None, None, None, True), ("e", None, 0.0, 1.0, "no place", None, "X", False)],
        [("c", 5, 0.0, 1.0, "c5", None, "X", False), ("d", big + 5, 2.2, 3.0, "d5", None, "X", False), ("d", None, None, None, None, None, None, True)],
    ])
    assert [(r.job_id, r.seq, r.original_text, r.n_lines) for r in s.merged_segments(spark, out).collect()] == [("d", big + 1, "d1 d3", 2)]
    assert sorted((r.job_id, r.seq) for r in s.late_lines(spark, out).collect()) == [("c", 5), ("d", big + 5)]
    assert s.open_segments(spark, out).count() == 0


def test_segment_stream_puts_overtaken_lines_in_order(spark, tmp_path):
    line = lambda i: ("a", i, float(i), i + 0.9, f"w{i}", None, None, i == 5)
    out = run_batches(spark, tmp_path, [[line(1), line(0)], [line(3)], [line(2)], [line(5), line(4)]], reorder=2)
    assert [r.original_text for r in s.merged_segments(spark, out).collect()] == ["w0 w1 w2 w3 w4 w5"]
    assert s.late_lines(spark, out).count() == 0 and s.open_segments(spark, out).count() == 0


def test_a_batch_of_lines_costs_what_it_holds(spark, tmp_path):
    """What a batch writes does not depend on the number of jobs that wait."""
    sizes = []
    for idle in (5, 200):
        lines = [(f"j{j}", 0, 0.0, 1.0, "waits", None, None, False) for j in range(idle)]
        out = run_batches(spark, tmp_path / str(idle), [lines, [("j1", 1, 1.0, 2.0, "goes on", None, None, False)]])
        newest = max(int(f.split("=")[1]) for f in os.listdir(out) if f.startswith("batch=") and stored(f"{out}/{f}"))
        sizes.append(stored(f"{out}/batch={newest}"))
        assert s.open_segments(spark, out).count() == idle
    assert sizes[0] == sizes[1]


def test_job_states_run_and_time_out(spark, tmp_path):
    schema = "job_id string, seq long, status string, updated_at timestamp"
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)

    def batch(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = job_state.job_state_stream(spark.readStream.schema(schema).parquet(inbox))
        query = job_state.write_job_states(stream, out, checkpoint)
        query.awaitTermination()
        return {r.job_id: (r.status, r.error, r.is_open, r.events) for r in job_state.job_states(spark, out).collect()}, query

    states, _ = batch(("a", 1, "PROCESSING", at(1)), ("b", 2, "CANCELLING", at(1)), ("c", 3, "COMPLETED", at(1)), ("d", 5, "AWAITING_REVIEW", at(1, 5)), ("d", 4, "PROCESSING", at(1)))
    assert states == {"a": ("PROCESSING", None, True, 1), "b": ("CANCELLING", None, True, 1), "c": ("COMPLETED", None, True, 1), "d": ("AWAITING_REVIEW", None, True, 2)}
    states, _ = batch(("d", 6, "PROCESSING_PHASE2", at(2)), ("e", 7, "QUEUED", at(3, 15)))
    assert states["a"] == ("FAILED", "Job timed out", False, 1) and states["b"] == ("CANCELLED", None, False, 1) and states["c"] == ("COMPLETED", None, False, 1)
    assert states["d"] == ("PROCESSING_PHASE2", None, True, 3) and states["e"] == ("QUEUED", None, True, 1)
    # An event of a job that has timed out opens a new spell; one far behind is dropped and counted.
    states, query = batch(("a", 8, "PROCESSING", at(3, 20)), ("d", 9, "COMPLETED", at(1, 30)))
    assert states["a"] == ("PROCESSING", None, True, 1) and states["d"][0] == "PROCESSING_PHASE2"
    assert sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) == 1
    assert sorted((r.job_id, r.status) for r in job_state.ended_spells(spark, out).collect()) == [("a", "FAILED"), ("b", "CANCELLED"), ("c", "COMPLETED")]


def test_watch_stream(spark, tmp_path):
    folder, taken, jobs_path = tmp_path / "watch", tmp_path / "input", str(tmp_path / "jobs")
    folder.mkdir()
    taken.mkdir()
    for name in ("a.mp4", "b.txt", "c.mkv"):
        (folder / name).write_bytes(b"x")
        os.utime(folder / name, (time.time() - 60,) * 2)
    watch_stream(spark, str(folder), str(taken), jobs_path, str(tmp_path / "cp"), once=True, settings={"enable_ocr": True, "target_lang": "English"}).awaitTermination()
    rows = job_log(spark, jobs_path).collect()
    assert sorted(r.filename for r in rows) == ["a.mp4", "c.mkv"]
    assert {(r.status, r.target_lang, r.enable_ocr, r.ocr_mode, r.auto_resume) for r in rows} == {("QUEUED", "English", True, "blur", True)}
    (folder / "d.mov").write_bytes(b"x")
    watch_batch(spark, str(folder), str(taken), jobs_path, 1)  # too fresh
    assert job_log(spark, jobs_path).count() == 2
    os.utime(folder / "d.mov", (time.time() - 60,) * 2)
    for _ in range(2):  # a repeated batch changes nothing
        watch_batch(spark, str(folder), str(taken), jobs_path, 2)
        assert job_log(spark, jobs_path).count() == 3
    with pytest.raises(ValueError):
        watch_batch(spark, str(folder), str(taken), jobs_path, 3, settings={"unknown": 1})
    compact_log(spark, jobs_path, str(tmp_path / "slim"))
    assert job_log(spark, str(tmp_path / "slim")).count() == 3


def test_long_white_space_before_a_document(spark):
    from segmentlab.sources.transcripts import parse_transcripts, transcript_rejects

    lines = '[{"start": 1, "end": 2, "text": "hello"}]'
    rows = [("a", " " * 100 + lines), ("b", "\n\t " * 500 + '{"segments": ' + lines + "}"), ("c", " " * 300), ("d", " " * 300 + "x")]
    docs = spark.createDataFrame(rows, "job_id string, document string")
    assert sorted((r.job_id, r.original_text) for r in parse_transcripts(docs).collect()) == [("a", "hello"), ("b", "hello")]
    assert sorted((r.job_id, r.reject_reason) for r in transcript_rejects(docs).collect()) == [("c", "empty"), ("d", "not readable as JSON")]


def test_list_folder_is_no_driver_listing(spark, tmp_path, monkeypatch):
    """Many small files are few tasks, the driver holds no file index, and names, times and sizes are those of Spark's own listing."""
    monkeypatch.setattr(media, "LISTED", 7)
    for i in range(500):
        (tmp_path / f"clip %{i} ü.mp4").write_bytes(b"x" * (i % 5))
    for name in ("_hidden.mp4", ".hidden.mp4", "a._COPYING_"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.mp4").write_bytes(b"x")
    listed = media.list_folder(spark, str(tmp_path))
    assert "FileScan" not in listed._jdf.queryExecution().executedPlan().toString()
    assert listed.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    theirs = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "modificationTime", "length")
    # Spark's file source leaves out empty files.
    seen = listed.filter("length > 0").select("path", "modified_at", "length")
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, theirs.collect()))
    assert listed.count() == 500
    with pytest.raises(FileNotFoundError):
        media.list_folder(spark, str(tmp_path / "none"))


def test_a_look_writes_few_files(spark, tmp_path):
    """One file per bucket of names, however many tasks decide."""
    folder, copies, log = tmp_path / "watch", tmp_path / "copies", str(tmp_path / "jobs")
    folder.mkdir(), copies.mkdir()
    for i in range(300):
        (folder / f"c{i}.mp4").write_bytes(b"x")
    later = F.current_timestamp() + F.expr("INTERVAL 1 HOUR")
    watch_batch(spark, str(folder), str(copies), log, 0, now=later)
    watch_batch(spark, str(folder), str(copies), log, 1, now=later)
    assert job_log(spark, log).count() == 300
    assert len(list((tmp_path / "jobs").rglob("*.parquet"))) == len(list((tmp_path / "jobs" / "batch=0").glob("name_bucket=*"))) <= 64


def test_job_states_ask_no_store_key_by_key(spark):
    """State comes and goes with the rows of many jobs, not by calls of each job."""
    events = spark.readStream.format("rate").load().selectExpr("value AS job_id", "value AS seq", "'QUEUED' AS status", "timestamp AS updated_at")
    plan = job_state.job_state_stream(events)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan
