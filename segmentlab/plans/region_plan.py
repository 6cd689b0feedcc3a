"""Which regions of each video to cover, and when."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentlab.operators import detections as d
from segmentlab.operators.blocks import lookup
from segmentlab.session import written


class RegionPlan(NamedTuple):
    """The chosen regions, the frames each banded one is on, and these frames as windows ``t0, t1`` in seconds."""

    regions: DataFrame
    active: DataFrame
    windows: DataFrame


def region_plan(videos: DataFrame, frames: DataFrame, detections: DataFrame) -> RegionPlan:
    """Regions, active frames and time windows of every video, from one run.

    Static boxes are always on. Text elsewhere becomes horizontal bands that are
    on only at their frames, and at no frame is more than the budget covered.

    Runs Spark jobs: five results are read by several later steps and are written to the shared
    folder: the static boxes and the bands (few per video), the rows with text per
    frame, and the frames of the bands before and after the budget. The detections are read three times in all.
    ``videos`` is read by most steps and should be a stored table.
    """
    found = written(d.oversize_filter(d.static_boxes(detections, frames), videos), "static")
    # The cover uses the boxes as found, of those that survive the clamp.
    clamped = d.clamp_even(found.select("video_id", "gx", "gy", "x", "y", "w", "h"), videos)
    survivors = found.join(clamped.select("video_id", "gx", "gy"), ["video_id", "gx", "gy"], "left_semi")
    moving = d.outside_cover(detections, d.grid_cover(survivors))
    statics = d.static_budget(clamped, videos)

    per_row = written(d.row_frames(videos, moving), "rows")
    kept = d.row_bands(videos, moving, per_row=per_row)
    heights = videos.select("video_id", "height", d.row_height(F.col("height")).alias("row_h"))
    boxes = kept.join(heights, "video_id").select(
        "video_id", "row_id", F.col("x_min").alias("x"), (F.col("row_id") * F.col("row_h")).alias("y"),
        (F.col("x_max") - F.col("x_min")).alias("w"),
        F.least(F.col("row_h"), F.col("height") - F.col("row_id") * F.col("row_h")).alias("h"))
    bands = written(d.clamp_even(boxes, videos), "bands")
    on = lookup(per_row, bands.select("video_id", "row_id"), ["video_id", "row_id"], "frame_idx", "left_semi").select(
        "video_id", "row_id", "frame_idx")
    on = written(d.fill_single_gaps(on, videos), "on")
    spread = d.temporal_spread(on, videos)
    sized = bands.join(spread, ["video_id", "row_id"])
    weighed = lookup(on, sized.select(
        "video_id", "row_id", "spread", "n_frames", (F.col("w") * F.col("h")).alias("area")), ["video_id", "row_id"], "frame_idx")
    allowed = written(d.instant_budget(weighed, statics, videos).select("video_id", "row_id", "frame_idx"), "allowed")
    active = allowed.select("video_id", F.concat(F.lit("row_"), F.col("row_id").cast("string")).alias("region_id"), "frame_idx")
    left = allowed.groupBy("video_id", "row_id").agg(F.count("*").alias("left_frames"))

    shape = ["x", "y", "w", "h", "radius"]
    always_on = statics.select(
        "video_id", F.concat_ws("_", F.lit("static"), "gx", "gy").alias("region_id"), *shape,
        F.lit(True).alias("always"), F.lit(1.0).alias("spread"), F.lit(10**9).cast("bigint").alias("n_frames"))
    banded = sized.join(left, ["video_id", "row_id"]).select(
        "video_id", F.concat(F.lit("row_"), F.col("row_id").cast("string")).alias("region_id"), *shape,
        F.lit(False).alias("always"), "spread", F.col("left_frames").alias("n_frames"))
    regions = d.top_regions(always_on.unionByName(banded))
    active = lookup(active, regions.select("video_id", "region_id"), ["video_id", "region_id"], "frame_idx", "left_semi")
    return RegionPlan(regions, active, d.time_windows(active, videos))
