"""Block-wise ordered work against plain loops, on random input."""

import random

import pytest
from pyspark.sql import functions as F

from segmentlab.operators import blocks
from segmentlab.operators import detections as d
from segmentlab.operators import transcripts as t


@pytest.fixture(params=[2, 5, 1000])
def block_rows(request, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", request.param)


SEGMENT = ("job_id int, seq int, start_time double, end_time double, original_text string, translated_text string, speaker string")


def _lines(seed):
    rng = random.Random(seed)
    rows = []
    for job in range(4):
        at = 0.0
        seqs = sorted(rng.sample(range(90), 40))
        for seq in seqs:
            start = round(at + rng.choice([0, 0.4, 0.8, 0.9, 2]), 1)
            at = round(start + rng.choice([0.4, 1, 3]), 1)
            rows.append((job, seq, start, at, f"w{seq}", rng.choice([None, "", f"t{seq}", f"t{seq}"]),
                         rng.choice([None, "A", "A", "A", "B"])))
    return rows


def _fold(rows):
    merged = []
    for job, seq, start, end, said, translated, speaker in rows:
        last = merged[-1] if merged and merged[-1][0] == job else None
        if last and last[6] == speaker and start - last[3] <= 0.8:
            last[3] = end
            last[4] += " " + said
            if last[5] and translated:
                last[5] += " " + translated
        else:
            merged.append([job, seq, start, end, said, translated, speaker])
    return {tuple(m) for m in merged}


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_segments(spark, block_rows, seed):
    rows = _lines(seed)
    merged = t.merge_segments(spark.createDataFrame(rows, SEGMENT)).drop("n_lines")
    assert {tuple(r) for r in merged.collect()} == _fold(rows)


def test_chunks_and_context(spark, block_rows):
    rows = _lines(3)
    chunks = t.chunk_segments(spark.createDataFrame(rows, SEGMENT), 6).collect()
    for job in range(4):
        mine = sorted((r for r in chunks if r.job_id == job), key=lambda r: r.seq)
        assert [(r.chunk, r.id) for r in mine] == [(i // 6, i % 6) for i in range(40)]
    context = t.chunk_context(t.chunk_segments(spark.createDataFrame(rows, SEGMENT), 6), 5, 6).collect()
    for r in context:
        mine = sorted((x for x in chunks if x.job_id == r.job_id), key=lambda x: x.seq)
        before = mine[max(0, r.chunk * 6 - 5):r.chunk * 6]
        assert r.context == "\n".join(f"[{x.speaker or 'UNKNOWN'}] {x.original_text}" for x in before)
    assert len(context) == 4 * 7


def test_running_and_following(spark):
    rows = [(k, o, o * 7 % 11 - 4) for k in range(3) for o in random.Random(k).sample(range(60), 25)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    block = blocks.block_of(F.col("o"), 4)
    sums = {(r.k, r.o): r.s for r in blocks.running(df, ["k"], ["o"], F.col("v"), "sum", "s", block).collect()}
    tops = {(r.k, r.o): r.m for r in blocks.running(df, ["k"], ["o"], F.col("v"), "max", "m", block).collect()}
    nexts = {(r.k, r.o): r.n for r in blocks.following(df, ["k"], "o", "n", block).collect()}
    for k in range(3):
        mine = sorted((o, v) for kk, o, v in rows if kk == k)
        for i, (o, _) in enumerate(mine):
            assert sums[k, o] == sum(v for _, v in mine[:i + 1])
            assert tops[k, o] == max(v for _, v in mine[:i + 1])
            assert nexts[k, o] == (mine[i + 1][0] if i + 1 < len(mine) else None)


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_lookup_is_a_plain_join(spark, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    rows = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(100)], "k int, i int")
    per_key = spark.createDataFrame([(0, "a"), (1, "b")], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        expected = sorted(map(str, rows.join(per_key, ["k"], how).collect()))
        assert sorted(map(str, blocks.lookup(rows, per_key, ["k"], "i", how).collect())) == expected
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


VIDEO = "video_id int, width long, height long, fps double, total_frames long, frame_skip long"


def test_time_windows(spark, block_rows):
    rng = random.Random(5)
    active = [(0, f"r{r}", f) for r in range(3) for f in rng.sample(range(0, 300, 5), 30)]
    videos = spark.createDataFrame([(0, 1920, 1080, 25.0, 290, 5)], VIDEO)
    got = d.time_windows(spark.createDataFrame(active, "video_id int, region_id string, frame_idx int"), videos)
    expected = set()
    for region in ("r0", "r1", "r2"):
        spans = []
        for f in sorted(f for _, r, f in active if r == region):
            start, stop = f / 25, min(290 / 25, (f + 5) / 25)
            if spans and start <= spans[-1][1] + 0.1:
                spans[-1][1] = max(spans[-1][1], stop)
            else:
                spans.append([start, stop])
        expected |= {(0, region, round(a, 2), round(b, 2)) for a, b in spans}
    assert {tuple(r) for r in got.collect()} == expected


@pytest.mark.parametrize("tied", [False, True])
def test_instant_budget(spark, tied):
    rng = random.Random(11)
    size = {r: rng.randint(50_000, 500_000) for r in range(20)}
    spread = {r: (r % 3 if tied else r) / 20 for r in range(20)}
    rows = [(0, r, f, spread[r], 10 + r % 2, size[r]) for f in range(40) for r in rng.sample(range(20), rng.randint(1, 8))]
    df = spark.createDataFrame(rows, "video_id int, row_id int, frame_idx int, spread double, n_frames int, area long")
    videos = spark.createDataFrame([(0, 1920, 1080, 25.0, 290, 5)], VIDEO)
    logo = spark.createDataFrame([(0, 100, 1000)], "video_id int, w int, h int")
    kept = {(r.frame_idx, r.row_id) for r in d.instant_budget(df, logo, videos).collect()}
    budget = 0.45 * 1920 * 1080
    for f in range(40):
        on = {r for _, r, ff, *_ in rows if ff == f}
        total = 100_000 + sum(size[r] for r in on)
        for r in sorted(on, key=lambda r: (spread[r], 10 + r % 2, size[r], r)):
            if total <= budget:
                break
            on.discard(r)
            total -= size[r]
        assert {r for ff, r in kept if ff == f} == on
        assert 100_000 + sum(size[r] for ff, r in kept if ff == f) <= budget


def test_ffill_resets_on_a_frame_without_text(spark, block_rows):
    timeline = spark.createDataFrame([(0, f) for f in range(40)], "video_id int, frame_idx long")
    scanned = spark.createDataFrame([(0, 3), (0, 10), (0, 12)], "video_id int, frame_idx long")
    boxes = spark.createDataFrame([(0, 3, 0, 1, 1, 1, 1), (0, 3, 1, 2, 2, 2, 2), (0, 12, 0, 9, 9, 9, 9)],
                                  "video_id int, frame_idx long, box_pos int, x int, y int, w int, h int")
    got = d.ffill_boxes(timeline, scanned, boxes).collect()
    assert sorted((r.frame_idx, r.box_pos, r.x) for r in got) == sorted(
        [(f, p, p + 1) for f in range(3, 10) for p in (0, 1)] + [(f, 0, 9) for f in range(12, 40)])


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_a_hot_group_is_cut_even_after_a_join(spark, limit):
    """Rows joined by video must not stay together for the ordered work that follows."""
    videos = spark.range(4).selectExpr("id AS video_id", "30.0D AS fps", "100 AS total_frames", "5 AS frame_skip")
    active = spark.range(100).selectExpr("id % 4 AS video_id", "concat('r', id % 3) AS region_id", "id AS frame_idx")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        plan = d.time_windows(active, videos)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    import re

    bare = re.sub(r"#\d+L?", "", plan)
    assert "hashpartitioning(video_id, region_id, _block" in bare
    assert "hashpartitioning(video_id, 4)" not in bare


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_a_job_with_a_third_of_the_lines_is_spread(spark, monkeypatch, limit):
    monkeypatch.setattr(blocks, "ROWS", 64)
    lines = spark.range(6000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 300 + 1 END AS job_id", "id AS seq", "cast(id AS double) AS start_time",
        "id + 0.5D AS end_time", "concat('w', id) AS original_text", "concat('t', id) AS translated_text", "'A' AS speaker")
    tracks = spark.range(301).selectExpr("id AS job_id", "16000 AS sample_rate")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        by_job = lines.repartition("job_id")
        for df in (t.merge_segments(lines), t.chunk_segments(lines), blocks.lookup(lines, tracks, ["job_id"], "seq"),
                   t.merge_segments(by_job), t.chunk_segments(by_job)):
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(sizes) == 6000 and max(sizes) < 6000 / 5
    finally:
        for key in ("adaptive.coalescePartitions.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{key}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_lookup_many_broadcasts_no_side(spark, monkeypatch):
    """Lists of samples look small to Spark, however many they hold; a hot key is dealt out."""
    monkeypatch.setattr(blocks, "ROWS", 50)
    videos = spark.range(30).selectExpr("id AS video_id", "30e0 AS fps", "100000 AS total_frames")
    samples = videos.selectExpr("video_id", "explode(sequence(0L, IF(video_id = 7, 999L, video_id))) AS sample")
    placed = blocks.lookup_many(samples, videos, ["video_id"], "sample")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [video_id") == 1 and "_share" in plan.split("SortMergeJoin [video_id")[1][:60]
    got = sorted((r.video_id, r.sample) for r in placed.collect())
    assert got == sorted((v, i) for v in range(30) for i in range(1000 if v == 7 else v + 1))
    mapped = d.frame_index_map(videos, samples)
    plan = mapped._jdf.queryExecution().executedPlan().toString()
    # What is broadcast holds counted keys only, twice.
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1
    assert mapped.count() == len(got)
