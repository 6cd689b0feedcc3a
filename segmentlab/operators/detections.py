"""Text boxes per video frame: parsing, static boxes, row bands, budgets, windows.

Tables: ``videos`` (video_id, width, height, fps, total_frames, frame_skip),
``frames`` (video_id, frame_idx) of all scanned frames, empty ones included, and
``detections`` (video_id, frame_idx, box_pos, x, y, w, h). One video may hold any
share of the rows: everything that grows with its length is keyed by frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentlab.functions import fixed
from segmentlab.functions.text import half_even
from segmentlab.operators import blocks

BUCKET_SECONDS = 10.0


def cell(value: Column, grid: int = fixed.GRID) -> Column:
    return F.floor(value / grid).cast("bigint")


def parse_boxes(raw: DataFrame, pad: int = fixed.BOX_PAD, col: str = "items") -> DataFrame:
    """Detector answers -> boxes in original-frame pixels.

    ``items`` is a JSON list per frame; an entry is a polygon or a pair of polygon
    and reading. Corners are padded and clamped in the scaled-down frame
    (``small_w, small_h``), then scaled to ``width, height`` per axis. Entries that
    are no polygon and boxes without area are dropped.
    """
    polygon = "array<array<double>>"
    entries = raw.withColumn("_v", F.try_parse_json(F.col(col))).selectExpr(
        "video_id", "frame_idx", "small_w", "small_h", "width", "height",
        "posexplode_outer(try_variant_get(_v, '$', 'array<variant>')) AS (box_pos, _entry)").filter("box_pos IS NOT NULL")
    points = entries.withColumn("_points", F.expr(
        f"CASE WHEN try_variant_get(_entry, '$[0][0]', 'array<double>') IS NOT NULL "
        f"THEN try_variant_get(_entry, '$[0]', '{polygon}') ELSE try_variant_get(_entry, '$', '{polygon}') END"))
    good = points.filter(
        F.col("_points").isNotNull() & (F.size("_points") > 0)
        & F.forall("_points", lambda p: F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull()))

    def edges(axis: int, limit: str) -> tuple[Column, Column]:
        values = F.transform("_points", lambda p: F.get(p, axis))
        return (F.greatest(F.lit(0.0), F.array_min(values) - pad),
                F.least(F.col(limit).cast("double"), F.array_max(values) + pad))

    (x0, x1), (y0, y1) = edges(0, "small_w"), edges(1, "small_h")
    sx = F.when(F.col("small_w") != 0, F.col("width") / F.col("small_w")).otherwise(1.0)
    sy = F.when(F.col("small_h") != 0, F.col("height") / F.col("small_h")).otherwise(1.0)
    corners = good.select("video_id", "frame_idx", F.col("box_pos").cast("bigint").alias("box_pos"),
                          x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"), sx.alias("sx"), sy.alias("sy"))

    def scaled(value: Column, scale: str) -> Column:
        return half_even(value * F.col(scale)).cast("bigint")

    return corners.select(
        "video_id", "frame_idx", "box_pos", scaled(F.col("x0"), "sx").alias("x"), scaled(F.col("y0"), "sy").alias("y"),
        scaled(F.col("x1") - F.col("x0"), "sx").alias("w"), scaled(F.col("y1") - F.col("y0"), "sy").alias("h"),
    ).filter("w > 0 AND h > 0")


def sample_frames(videos: DataFrame, kind: str) -> DataFrame:
    """Evenly spaced frame numbers per video for the ``static``, ``dynamic`` or ``median`` scan."""
    total = F.col("total_frames")
    wanted = {
        "static": F.when(total > 1, F.least(F.lit(fixed.STATIC_SAMPLES), F.greatest(F.lit(3), total))),
        "dynamic": F.when(total >= fixed.DYNAMIC_SAMPLES, F.lit(fixed.DYNAMIC_SAMPLES)),
        "median": F.when(total >= 3, F.least(F.lit(fixed.MEDIAN_SAMPLES), total)),
    }[kind].cast("bigint")
    counted = videos.withColumn("_n", wanted).filter("_n IS NOT NULL")
    numbered = counted.select("video_id", "total_frames", "_n",
                              F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("sample"))
    index = F.floor(F.col("sample") * (total - 1) / (F.col("_n") - 1)).cast("bigint")
    return numbered.select("video_id", "sample", index.alias("frame_idx"))


def frame_skip(fps: Column, ocr_fps: float = 2.0) -> Column:
    return F.greatest(F.lit(1), half_even(fps / ocr_fps).cast("bigint"))


def frame_index_map(videos: DataFrame, samples: DataFrame, ocr_fps: float = 2.0) -> DataFrame:
    """Frame number of the i-th sample; samples past the end share the last frame, where the last one wins."""
    skip = frame_skip(F.col("fps"), ocr_fps)
    index = F.least(F.col("sample") * skip, F.greatest(F.lit(0), F.col("total_frames") - 1))
    placed = blocks.lookup_many(samples, videos.select("video_id", "fps", "total_frames"), ["video_id"], "sample").withColumn(
        "frame_idx", index)
    return placed.groupBy("video_id", "frame_idx").agg(F.max("sample").alias("sample"))


def static_boxes(detections: DataFrame, frames: DataFrame, grid: int = fixed.GRID,
                 share: float = fixed.STATIC_SHARE) -> DataFrame:
    """Boxes whose corner cell is hit in enough of the scanned frames; the box last seen stands for the cell.

    Boxes are counted, not frames: two boxes of one frame in one cell count twice.
    """
    seen = detections.groupBy("video_id", cell(F.col("x"), grid).alias("gx"), cell(F.col("y"), grid).alias("gy")).agg(
        F.count("*").alias("hits"),
        F.max_by(F.struct("x", "y", "w", "h"), F.struct("frame_idx", "box_pos")).alias("_box"))
    scanned = frames.groupBy("video_id").agg(F.count("*").alias("scanned"))
    needed = F.greatest(F.lit(1), F.floor(F.col("scanned") * share).cast("bigint"))
    return seen.join(scanned, "video_id").filter(F.col("hits") >= needed).select(
        "video_id", "gx", "gy", "hits", "_box.*")


def grid_cover(boxes: DataFrame, grid: int = fixed.GRID) -> DataFrame:
    """Distinct cells covered by the boxes of each video."""
    columns = F.sequence(cell(F.col("x"), grid), cell(F.col("x") + F.col("w"), grid))
    rows = F.sequence(cell(F.col("y"), grid), cell(F.col("y") + F.col("h"), grid))
    return (
        boxes.withColumn("gx", F.explode(columns)).withColumn("gy", F.explode(rows))
        .select("video_id", "gx", "gy").distinct()
    )


def outside_cover(detections: DataFrame, cover: DataFrame, grid: int = fixed.GRID) -> DataFrame:
    """Boxes whose corner cell is not covered."""
    keyed = detections.withColumn("gx", cell(F.col("x"), grid)).withColumn("gy", cell(F.col("y"), grid))
    return blocks.lookup(keyed, cover, ["video_id", "gx", "gy"], ["frame_idx", "box_pos"], "left_anti").drop("gx", "gy")


def dynamic_text_exists(videos: DataFrame, sampled: DataFrame, static: DataFrame) -> DataFrame:
    """Per video: is there text outside the static boxes in the ``sampled`` detections?
    Clips shorter than the sample count always need the full scan."""
    moving = outside_cover(sampled, grid_cover(static)).select("video_id").distinct().withColumn("_found", F.lit(True))
    total = F.col("total_frames")
    short = (total > 0) & (total < fixed.DYNAMIC_SAMPLES)
    found = F.coalesce("_found", F.lit(False)) & (total >= fixed.DYNAMIC_SAMPLES)
    return videos.select("video_id", "total_frames").join(moving, "video_id", "left").select(
        "video_id", (short | found).alias("has_dynamic"))


def ffill_boxes(timeline: DataFrame, scanned: DataFrame, detections: DataFrame) -> DataFrame:
    """Boxes in force at every frame of ``timeline``: those of the last scanned frame.

    A scanned frame without text clears them. Only the frame number is carried
    forward; boxes are joined to it afterwards.
    """
    marks = timeline.select("video_id", "frame_idx", F.lit(True).alias("_wanted"), F.lit(None).cast("bigint").alias("_at"))
    marks = marks.unionByName(scanned.select(
        "video_id", "frame_idx", F.lit(False).alias("_wanted"), F.col("frame_idx").alias("_at")))
    per_frame = marks.groupBy("video_id", "frame_idx").agg(F.max("_wanted").alias("_wanted"), F.max("_at").alias("_at"))
    carried = blocks.running(per_frame, ["video_id"], ["frame_idx"], F.col("_at"), "max", "source_frame",
                             blocks.block_of(F.col("frame_idx")))
    wanted = carried.filter("_wanted AND source_frame IS NOT NULL").select("video_id", "frame_idx", "source_frame")
    # A source frame may stay in force for any number of frames: it is joined in stretches.
    stretch = blocks.block_of(F.col("frame_idx") - F.col("source_frame"))
    ends = wanted.groupBy("video_id", "source_frame").agg(F.max(stretch).alias("_last"))
    boxes = detections.withColumnRenamed("frame_idx", "source_frame").join(ends, ["video_id", "source_frame"])
    boxes = boxes.withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last")))).drop("_last")
    return wanted.withColumn("_stretch", stretch).join(boxes, ["video_id", "source_frame", "_stretch"]).drop("_stretch")


def row_height(height: Column, div: int = fixed.ROW_DIVISIONS) -> Column:
    return F.greatest(F.lit(fixed.MIN_ROW_HEIGHT), half_even(height / div).cast("bigint"))


def row_frames(videos: DataFrame, moving: DataFrame, div: int = fixed.ROW_DIVISIONS) -> DataFrame:
    """One row per video, horizontal band and frame with text in it, with the x extent.

    Boxes of a frame are combined before the shuffle."""
    sized = videos.select("video_id", "height", row_height(F.col("height"), div).alias("row_h"))
    rows = F.floor((F.col("height") + F.col("row_h") - 1) / F.col("row_h")).cast("bigint")
    first = F.greatest(F.lit(0), F.floor(F.col("y") / F.col("row_h")).cast("bigint"))
    last = F.least(rows - 1, F.floor((F.col("y") + F.col("h")) / F.col("row_h")).cast("bigint"))
    spans = blocks.lookup(moving, sized, ["video_id"], "frame_idx").withColumn("_first", first).withColumn("_last", last)
    touched = spans.filter("_first <= _last").withColumn("row_id", F.explode(F.sequence("_first", "_last")))
    return touched.groupBy("video_id", "row_id", "frame_idx").agg(
        F.min("x").alias("x_min"), F.max(F.col("x") + F.col("w")).alias("x_max"))


def row_bands(videos: DataFrame, moving: DataFrame, div: int = fixed.ROW_DIVISIONS,
              share: float = fixed.PERSIST_SHARE, floor: int = fixed.PERSIST_FRAMES,
              per_row: DataFrame | None = None) -> DataFrame:
    """Bands with text in enough frames. ``moving``: boxes outside the static cover."""
    per_row = row_frames(videos, moving, div) if per_row is None else per_row
    bands = per_row.groupBy("video_id", "row_id").agg(
        F.count("*").alias("n_frames"), F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"),
        F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))
    text_frames = moving.select("video_id", "frame_idx").distinct().groupBy("video_id").agg(
        F.count("*").alias("n_text"), F.max("frame_idx").alias("last_text"))
    needed = F.greatest(F.lit(floor), F.floor(F.col("n_text") * share).cast("bigint"))
    return bands.join(text_frames, "video_id").filter(F.col("n_frames") >= needed)


def fill_single_gaps(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """Adds frame ``f + skip`` where ``f`` and ``f + 2 skip`` are there and it is not.

    Every frame votes for its two neighbours; one aggregation by frame finds the
    gaps with a vote from both sides. ``rows``: video_id, row_id, frame_idx.
    """
    skip = videos.select("video_id", "frame_skip")
    votes = blocks.lookup(rows, skip, ["video_id"], "frame_idx").select("video_id", "row_id", F.explode(F.array(
        F.struct(F.col("frame_idx").alias("frame_idx"), F.lit(1).alias("here"), F.lit(0).alias("left"), F.lit(0).alias("right")),
        F.struct((F.col("frame_idx") + F.col("frame_skip")).alias("frame_idx"), F.lit(0).alias("here"),
                 (F.col("frame_skip") > 0).cast("int").alias("left"), F.lit(0).alias("right")),
        F.struct((F.col("frame_idx") - F.col("frame_skip")).alias("frame_idx"), F.lit(0).alias("here"),
                 F.lit(0).alias("left"), (F.col("frame_skip") > 0).cast("int").alias("right")),
    )).alias("_vote")).select("video_id", "row_id", "_vote.*")
    counted = votes.groupBy("video_id", "row_id", "frame_idx").agg(
        F.max("here").alias("here"), F.max("left").alias("left"), F.max("right").alias("right"))
    return counted.filter("here = 1 OR (left = 1 AND right = 1)").select(
        "video_id", "row_id", "frame_idx", (F.col("here") == 0).alias("is_filled"))


def temporal_spread(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """Per band: frames and the share of the video between its first and last frame."""
    ends = rows.groupBy("video_id", "row_id").agg(
        F.count("*").alias("n_frames"), F.min("frame_idx").alias("_first"), F.max("frame_idx").alias("_last"))
    last_text = ends.groupBy("video_id").agg(F.max("_last").alias("_last_text"))
    total = videos.select("video_id", "total_frames")
    whole = F.when(F.col("total_frames") > 0, F.col("total_frames")).otherwise(F.col("_last_text") + 1)
    return ends.join(last_text.join(total, "video_id", "left"), "video_id").select(
        "video_id", "row_id", "n_frames", ((F.col("_last") - F.col("_first")) / whole).alias("spread"))


def median_baseline(samples: DataFrame, min_frames: int = 3) -> DataFrame:
    """Median value per position over the sampled frames, cut to a whole number.

    Videos with fewer sampled frames have none. A position has one value per
    sampled frame and values are bytes, so the median's count table is bounded.
    ``samples``: video_id, frame_idx, pos, value.
    """
    enough = samples.select("video_id", "frame_idx").distinct().groupBy("video_id").agg(
        F.count("*").alias("_n")).filter(F.col("_n") >= min_frames).select("video_id")
    return blocks.lookup(samples, enough, ["video_id"], "pos", "left_semi").groupBy("video_id", "pos").agg(
        F.median("value").cast("bigint").alias("baseline"))


def apply_baseline(values: DataFrame, baseline: DataFrame, masked: Column) -> DataFrame:
    """Replace masked positions by the baseline where there is one."""
    return values.withColumn("_masked", masked).join(baseline, ["video_id", "pos"], "left").withColumn(
        "value", F.when(F.col("_masked"), F.coalesce("baseline", "value")).otherwise(F.col("value"))).drop(
        "baseline", "_masked")


def oversize_filter(boxes: DataFrame, videos: DataFrame, share: float = fixed.MAX_BOX_SHARE) -> DataFrame:
    """Boxes that cover at most ``share`` of the frame."""
    area = videos.select("video_id", (F.col("width") * F.col("height")).cast("double").alias("_frame"))
    return boxes.join(area.filter("_frame > 0"), "video_id").filter(
        F.col("w") * F.col("h") / F.col("_frame") <= share).drop("_frame")


def clamp_even(boxes: DataFrame, videos: DataFrame, pad: int = fixed.EVEN_PAD) -> DataFrame:
    """Pad, clamp to the frame and snap to even numbers; adds the blur ``radius``; too small boxes are dropped."""
    def even(value: Column) -> Column:
        return value - F.pmod(value, F.lit(2))

    padded = boxes.join(videos.select("video_id", "width", "height"), "video_id")
    for low, size, limit in (("x", "w", "width"), ("y", "h", "height")):
        start = even(F.greatest(F.lit(0), F.col(low) - pad))
        stop = F.least(F.col(limit), F.col(low) + F.col(size) + pad)
        padded = padded.withColumn("_start", start).withColumn("_stop", stop).withColumn(
            size, even(F.col("_stop") - F.col("_start"))).withColumn(low, F.col("_start")).withColumn(
            size, F.when(F.col(low) + F.col(size) > F.col(limit), even(F.col(limit) - F.col(low))).otherwise(F.col(size)))
    side = F.floor(F.least("w", "h") / 4).cast("bigint")
    radius = F.greatest(F.lit(1), F.least(F.lit(fixed.MAX_RADIUS), side - 1)).cast("bigint")
    return padded.filter((F.col("w") >= fixed.MIN_SIDE) & (F.col("h") >= fixed.MIN_SIDE)).withColumn(
        "radius", radius).drop("width", "height", "_start", "_stop")


def static_budget(boxes: DataFrame, videos: DataFrame, share: float = fixed.MAX_AREA_SHARE) -> DataFrame:
    """Drop the largest static boxes until the rest fits the area budget.

    A video has at most one static box per grid cell, so its window is bounded by
    the frame size, not by its length.
    """
    budget = videos.select("video_id", (F.col("width") * F.col("height") * F.lit(share)).alias("_budget"))
    area = F.col("w") * F.col("h")
    by_size = Window.partitionBy("video_id").orderBy(area.desc(), "gx", "gy")
    larger = F.coalesce(F.sum(area).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(area).over(Window.partitionBy("video_id")) - larger
    return boxes.withColumn("_left", left).join(budget, "video_id").filter("_left <= _budget").drop("_left", "_budget")


def instant_budget(rows: DataFrame, static: DataFrame, videos: DataFrame,
                   share: float = fixed.MAX_AREA_SHARE) -> DataFrame:
    """At frames where static and active area exceed the budget, drop bands of
    least spread, frames and area until they fit; a band keeps its other frames.

    ``rows``: video_id, row_id, frame_idx, spread, n_frames, area. The window holds
    the bands of one frame.
    """
    always = static.groupBy("video_id").agg(F.sum(F.col("w") * F.col("h")).alias("_static"))
    limits = videos.select("video_id", (F.col("width") * F.col("height") * F.lit(share)).alias("_budget")).join(
        always, "video_id", "left").select("video_id", "_budget", F.coalesce("_static", F.lit(0)).alias("_static"))
    frame = Window.partitionBy("video_id", "frame_idx")
    weakest = frame.orderBy("spread", "n_frames", "area", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("area").over(frame) - F.coalesce(F.sum("area").over(weakest), F.lit(0))
    return blocks.lookup(rows.withColumn("_left", left), limits, ["video_id"], "frame_idx").filter(
        F.col("_static") + F.col("_left") <= F.col("_budget")).drop("_left", "_budget", "_static")


def time_windows(active: DataFrame, videos: DataFrame, merge_gap: float = fixed.WINDOW_GAP) -> DataFrame:
    """Active frames (video_id, region_id, frame_idx) -> windows ``t0, t1`` in seconds, gaps up to ``merge_gap`` fused."""
    clock = videos.filter("fps > 0").select("video_id", "fps", "total_frames", "frame_skip")
    distinct = active.select("video_id", "region_id", "frame_idx").distinct()
    spans = blocks.lookup(distinct, clock, ["video_id"], "frame_idx").select(
        "video_id", "region_id", "frame_idx",
        F.greatest(F.lit(0.0), F.col("frame_idx") / F.col("fps")).alias("t0"),
        F.least(F.col("total_frames") / F.col("fps"),
                (F.col("frame_idx") + F.col("frame_skip")) / F.col("fps")).alias("t1"))

    def starts_new(window):
        return F.col("t0") > F.lag("t1").over(window) + merge_gap

    def merge(group):
        return group.agg(F.min("frame_idx").alias("frame_idx"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))

    merged = blocks.merge_runs(spans, ["video_id", "region_id"], "frame_idx", starts_new, merge,
                               blocks.block_of(F.col("frame_idx")))
    return merged.select("video_id", "region_id", F.bround("t0", 2).alias("t0"), F.bround("t1", 2).alias("t1"))


def active_regions(frames: DataFrame, windows: DataFrame, bucket: float = BUCKET_SECONDS) -> DataFrame:
    """Regions in force at each frame time ``t``, both ends of a window included.

    Windows are put into every time bucket they touch and joined by video and
    bucket, so a long video is many small joins and not one product.
    """
    slots = F.sequence(F.floor(F.col("t0") / bucket).cast("bigint"), F.floor(F.col("t1") / bucket).cast("bigint"))
    spread = windows.withColumn("_bucket", F.explode(slots))
    timed = frames.withColumn("_bucket", F.floor(F.col("t") / bucket).cast("bigint"))
    return timed.join(spread, ["video_id", "_bucket"]).filter("t >= t0 AND t <= t1").drop("_bucket", "t0", "t1")


def top_regions(regions: DataFrame, k: int = fixed.MAX_REGIONS) -> DataFrame:
    """The ``k`` most persistent regions per video, always-on ones first.

    A video has a bounded number of regions (static cells and bands), and Spark
    keeps only ``k`` per partition before the shuffle.
    """
    rank = Window.partitionBy("video_id").orderBy(F.col("always").desc(), F.col("n_frames").desc(), "region_id")
    return regions.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= k).drop("_rank")


def confidence_filter(detections: DataFrame, min_score: float = fixed.MIN_SCORE) -> DataFrame:
    return detections.filter(F.col("score") >= min_score)
