"""Queries on text boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from segmentlab.checks.registry import query
from segmentlab.checks.views import with_views
from segmentlab.operators import detections as d
from segmentlab.plans.region_plan import region_plan
from segmentlab.session import written

# Detector answers of each scanned frame as JSON, in both shapes, with bad entries among them.
_ITEM = """SELECT video_id, frame_idx, box_pos, x, y, w, h, cast(854 AS bigint) AS small_w, cast(480 AS bigint) AS small_h,
    cast(1920 AS bigint) AS width, cast(1080 AS bigint) AS height FROM detections"""


def _raw(v):
    corner = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    x0, y0 = F.col("x") / 4.0, F.col("y") / 2.5
    x1, y1 = (F.col("x") + F.col("w")) / 4.0, (F.col("y") + F.col("h")) / 2.5
    polygon = F.concat(F.lit("["), F.concat_ws(",", corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)), F.lit("]"))
    item = F.when(F.col("box_pos") == 2, F.concat(F.lit("["), polygon, F.lit(',["text",0.9]]'))).otherwise(polygon)
    item = F.when((F.col("box_pos") == 3) & (F.col("x") % 3 == 0), F.lit('"bad"')).otherwise(item)
    frames = v.sql(_ITEM, "detections").withColumn("item", item)
    # The position in the list is the position of the box, so the lists are kept complete.
    grouped = frames.groupBy("video_id", "frame_idx", "small_w", "small_h", "width", "height").agg(
        F.map_from_entries(F.collect_list(F.struct("box_pos", "item"))).alias("_m"))
    slots = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint")), lambda i: F.coalesce(F.col("_m")[i], F.lit("[]")))
    return grouped.withColumn("items", F.concat(F.lit("["), F.array_join(slots, ","), F.lit("]"))).drop("_m")


@query("parse_boxes", with_views("detections") + f""", boxes AS ({_ITEM}),
edges AS (SELECT *, greatest(0, x / 4.0::DOUBLE - 10) AS x0, least(small_w, (x + w) / 4.0::DOUBLE + 10) AS x1,
    greatest(0, y / 2.5::DOUBLE - 10) AS y0, least(small_h, (y + h) / 2.5::DOUBLE + 10) AS y1,
    width / small_w AS sx, height / small_h AS sy FROM boxes WHERE NOT (box_pos = 3 AND x % 3 = 0)),
scaled AS (SELECT video_id, frame_idx, box_pos, round_even(x0 * sx, 0)::BIGINT AS x, round_even(y0 * sy, 0)::BIGINT AS y,
    round_even((x1 - x0) * sx, 0)::BIGINT AS w, round_even((y1 - y0) * sy, 0)::BIGINT AS h FROM edges)
SELECT * FROM scaled WHERE w > 0 AND h > 0""")
def _(v):
    return d.parse_boxes(_raw(v))


_CLIPS = "SELECT c_custkey AS video_id, c_custkey % 700 AS total_frames FROM customer"


@query("sample_frames", f"""WITH videos AS ({_CLIPS}),
counts AS (SELECT video_id, total_frames, 'static' AS kind, least(30, greatest(3, total_frames)) AS n FROM videos WHERE total_frames > 1
  UNION ALL SELECT video_id, total_frames, 'dynamic', 8 FROM videos WHERE total_frames >= 8
  UNION ALL SELECT video_id, total_frames, 'median', least(20, total_frames) FROM videos WHERE total_frames >= 3)
SELECT video_id, kind, i AS sample, floor(i * (total_frames - 1) / (n - 1))::BIGINT AS frame_idx FROM counts, range(30) r(i) WHERE i < n""")
def _(v):
    clips = v.sql(_CLIPS)
    parts = [d.sample_frames(clips, kind).withColumn("kind", F.lit(kind)) for kind in ("static", "dynamic", "median")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_RATED = "SELECT c_custkey AS video_id, 10 + (c_custkey % 51) * 0.98e0 AS fps, 1 + c_custkey % 300 AS total_frames FROM customer"
_TAKEN = "SELECT c_custkey AS video_id, i AS sample FROM customer, range(40) r(i) WHERE i <= c_custkey % 41"


@query("frame_index_map", f"""WITH videos AS ({_RATED}), samples AS ({_TAKEN})
SELECT s.video_id, least(sample * greatest(1, round_even(fps / 2, 0)::BIGINT), greatest(0, total_frames - 1)) AS frame_idx, max(sample) AS sample
FROM samples s JOIN videos v ON v.video_id = s.video_id GROUP BY 1, 2""")
def _(v):
    taken = "SELECT c_custkey AS video_id, explode(sequence(cast(0 AS bigint), least(c_custkey % 41, cast(39 AS bigint)))) AS sample FROM customer"
    return d.frame_index_map(v.sql(_RATED), v.sql(taken))


STATIC = with_views("detections", "frames", "videos") + """,
hits AS (SELECT video_id, x // 20 AS gx, y // 20 AS gy, count(*) AS hits,
    arg_max({'x': x, 'y': y, 'w': w, 'h': h}, frame_idx * 1000 + box_pos) AS b FROM detections GROUP BY 1, 2, 3),
scanned AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id),
static AS (SELECT h.video_id, gx, gy, hits, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM hits h JOIN scanned s ON s.video_id = h.video_id
    WHERE hits >= greatest(1, floor(n * 0.7::DOUBLE)))
"""


def _static(v):
    return d.static_boxes(v.detections, v.frames)


@query("static_boxes", STATIC + "SELECT * FROM static")
def _(v):
    return _static(v)


COVER = """
columns AS (SELECT DISTINCT video_id, x, y, w, h, unnest(range(x // 20, (x + w) // 20 + 1)) AS gx FROM {source}),
cover AS (SELECT DISTINCT video_id, gx, unnest(range(y // 20, (y + h) // 20 + 1)) AS gy FROM columns)
"""


@query("grid_cover", with_views("cell_boxes") + "," + COVER.format(source="cell_boxes") + "SELECT video_id, gx, gy FROM cover")
def _(v):
    return d.grid_cover(v.cell_boxes)


# Every box of the whole table is kept apart from the static ones.
MOVING = STATIC + "," + COVER.format(source="static") + """,
moving AS (SELECT * FROM detections t WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.video_id = t.video_id AND c.gx = t.x // 20 AND c.gy = t.y // 20))
"""


def _moving(v):
    return d.outside_cover(v.detections, d.grid_cover(_static(v)))


@query("outside_cover", MOVING + "SELECT * FROM moving")
def _(v):
    return _moving(v)


# Many short clips: the users' events as sampled frames, static where every value is low.
_SHORT = "SELECT user_id AS video_id, user_id % 20 AS total_frames FROM (SELECT DISTINCT user_id FROM events) u"
_SEEN = """SELECT user_id AS video_id, event_id AS frame_idx, cast(0 AS bigint) AS box_pos, cast(floor(value) AS bigint) % 120 + user_id AS x,
    event_id % 40 AS y, cast(50 AS bigint) AS w, cast(20 AS bigint) AS h FROM events WHERE user_id % 3 > 0 OR event_id % 2 = 0"""


@query("dynamic_text_exists", f"""WITH videos AS ({_SHORT}), seen AS ({_SEEN}),
static AS (SELECT video_id, min(x) AS x, cast(0 AS bigint) AS y, 60 + video_id % 3 * 60 AS w, cast(45 AS bigint) AS h FROM seen GROUP BY video_id),
{COVER.format(source="static")},
moving AS (SELECT DISTINCT video_id FROM seen t WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.video_id = t.video_id AND c.gx = t.x // 20 AND c.gy = t.y // 20))
SELECT v.video_id, CASE WHEN total_frames = 0 THEN false WHEN total_frames < 8 THEN true ELSE m.video_id IS NOT NULL END AS has_dynamic
FROM videos v LEFT JOIN moving m ON m.video_id = v.video_id""")
def _(v):
    seen = v.sql(_SEEN)
    static = seen.groupBy("video_id").agg(F.min("x").alias("x")).selectExpr(
        "video_id", "x", "cast(0 AS bigint) AS y", "60 + video_id % 3 * 60 AS w", "cast(45 AS bigint) AS h")
    return d.dynamic_text_exists(v.sql(_SHORT), seen, static)


_TIMELINE = "SELECT video_id, frame_idx + k AS frame_idx FROM frames, (VALUES (0), (5), (10)) s(k)"


# Every second scanned frame is detected; all frames in between take over its boxes.
@query("ffill_boxes", with_views("detections", "frames") + f""", timeline AS ({_TIMELINE}),
detected AS (SELECT * FROM frames WHERE frame_idx % 30 = 0),
carried AS (SELECT t.video_id, t.frame_idx, s.frame_idx AS source_frame FROM timeline t ASOF JOIN detected s
            ON s.video_id = t.video_id AND t.frame_idx >= s.frame_idx)
SELECT c.video_id, c.frame_idx, source_frame, box_pos, x, y, w, h FROM carried c
JOIN detections b ON b.video_id = c.video_id AND b.frame_idx = c.source_frame""")
def _(v):
    return d.ffill_boxes(v.sql("SELECT video_id, explode(array(frame_idx, frame_idx + 5, frame_idx + 10)) AS frame_idx FROM frames", "frames"), v.frames.filter("frame_idx % 30 = 0"), v.detections)


ROWS = MOVING + """,
touched AS (SELECT video_id, frame_idx, x, w, unnest(range(greatest(0, y // 42), least(25, (y + h) // 42) + 1)) AS row_id FROM moving),
per_row AS (SELECT video_id, row_id, frame_idx, min(x) AS x_min, max(x + w) AS x_max FROM touched GROUP BY 1, 2, 3),
text_frames AS (SELECT video_id, count(DISTINCT frame_idx) AS n_text, max(frame_idx) AS last_text FROM moving GROUP BY 1),
bands AS (SELECT video_id, row_id, count(*) AS n_frames, min(x_min) AS x_min, max(x_max) AS x_max, min(frame_idx) AS first_frame,
    max(frame_idx) AS last_frame FROM per_row GROUP BY 1, 2),
kept AS (SELECT b.*, n_text, last_text FROM bands b JOIN text_frames t ON t.video_id = b.video_id
    WHERE n_frames >= greatest(3, floor(n_text * 0.12::DOUBLE)))
"""


@query("row_bands", ROWS + "SELECT * FROM kept")
def _(v):
    return d.row_bands(v.videos, _moving(v))


FILLED = """
filled AS (
  SELECT video_id, row_id, frame_idx, false AS is_filled FROM band_rows
  UNION ALL
  SELECT DISTINCT a.video_id, a.row_id, a.frame_idx + 15, true FROM band_rows a
  JOIN band_rows c ON c.video_id = a.video_id AND c.row_id = a.row_id AND c.frame_idx = a.frame_idx + 30
  WHERE NOT EXISTS (SELECT 1 FROM band_rows b WHERE b.video_id = a.video_id AND b.row_id = a.row_id AND b.frame_idx = a.frame_idx + 15))
"""


@query("fill_single_gaps", with_views("band_rows") + "," + FILLED + "SELECT * FROM filled")
def _(v):
    return d.fill_single_gaps(v.band_rows, v.videos)


@query("temporal_spread", with_views("band_rows", "videos") + """
SELECT r.video_id, row_id, count(*) AS n_frames, (max(frame_idx) - min(frame_idx)) / any_value(total_frames) AS spread
FROM band_rows r JOIN videos v ON v.video_id = r.video_id GROUP BY 1, 2""")
def _(v):
    return d.temporal_spread(v.band_rows, v.videos)


# Byte values of 20 sampled frames per video at every position the table has.
_SAMPLES = """SELECT DISTINCT user_id AS video_id, frame_idx, pos, cast(max(cast(floor(value * 7) AS bigint) % 256) AS bigint) AS value
    FROM (SELECT user_id, event_id % 20 AS frame_idx, cast(floor(event_id / 2000) AS bigint) AS pos, value FROM events) e
    WHERE user_id % 30 > 0 OR frame_idx < 2 GROUP BY user_id, frame_idx, pos"""
BASELINE = f"""WITH samples AS ({_SAMPLES}),
enough AS (SELECT video_id FROM samples GROUP BY video_id HAVING count(DISTINCT frame_idx) >= 3),
baseline AS (SELECT video_id, pos, trunc(quantile_cont(value, 0.5))::BIGINT AS baseline FROM samples
    WHERE video_id IN (SELECT video_id FROM enough) GROUP BY video_id, pos)
"""


@query("median_baseline", BASELINE + "SELECT * FROM baseline")
def _(v):
    return d.median_baseline(v.sql(_SAMPLES))


@query("apply_baseline", BASELINE + """
SELECT s.video_id, frame_idx, s.pos, CASE WHEN (s.pos + frame_idx) % 3 = 0 THEN coalesce(baseline, value) ELSE value END AS value
FROM samples s LEFT JOIN baseline b ON b.video_id = s.video_id AND b.pos = s.pos""")
def _(v):
    samples = v.sql(_SAMPLES)
    return d.apply_baseline(samples, d.median_baseline(samples), (F.col("pos") + F.col("frame_idx")) % 3 == 0).select(
        "video_id", "frame_idx", "pos", "value")


CELLS = with_views("cell_boxes", "cell_videos")


@query("oversize_filter", CELLS + "SELECT * FROM cell_boxes WHERE w * h / (1920 * 1080)::DOUBLE <= 0.35::DOUBLE")
def _(v):
    return d.oversize_filter(v.cell_boxes, v.cell_videos)


CLAMPED = CELLS + """,
padded AS (SELECT video_id, gx, gy, greatest(0, x - 6) - greatest(0, x - 6) % 2 AS x, greatest(0, y - 6) - greatest(0, y - 6) % 2 AS y,
    least(1920, x + w + 6) AS x1, least(1080, y + h + 6) AS y1 FROM cell_boxes),
even AS (SELECT video_id, gx, gy, x, y, (x1 - x) // 2 * 2 AS w, (y1 - y) // 2 * 2 AS h FROM padded),
clamped AS (SELECT *, greatest(1, least(22, least(w, h) // 4 - 1))::BIGINT AS radius FROM even WHERE w >= 8 AND h >= 8)
"""


@query("clamp_even", CLAMPED + "SELECT * FROM clamped")
def _(v):
    return d.clamp_even(v.cell_boxes, v.cell_videos)


@query("static_budget", CLAMPED + """
, ranked AS (SELECT *, sum(w * h) OVER (PARTITION BY video_id ORDER BY w * h, gx DESC, gy DESC) AS smaller FROM clamped)
SELECT video_id, gx, gy, x, y, w, h, radius FROM ranked WHERE smaller <= 1920 * 1080 * 0.45::DOUBLE""")
def _(v):
    return d.static_budget(d.clamp_even(v.cell_boxes, v.cell_videos), v.cell_videos)


_WEIGHED = """SELECT video_id, row_id, frame_idx, cast(row_id * 37 % 11 AS double) / 10 AS spread, 10 + row_id * 13 % 5 AS n_frames,
    (300 + row_id * 71 % 1500) * 250 AS area FROM band_rows"""


@query("instant_budget", with_views("band_rows", "videos") + f""", weighed AS ({_WEIGHED}),
logo AS (SELECT DISTINCT video_id, (200 + video_id * 50) * 400 AS area FROM videos),
ranked AS (SELECT w.*, l.area + sum(w.area) OVER (PARTITION BY w.video_id, frame_idx ORDER BY spread DESC, n_frames DESC, w.area DESC, row_id DESC) AS held
           FROM weighed w JOIN logo l ON l.video_id = w.video_id)
SELECT video_id, row_id, frame_idx, spread, n_frames, area FROM ranked WHERE held <= 1920 * 1080 * 0.45::DOUBLE""")
def _(v):
    logo = v.videos.select("video_id", (200 + F.col("video_id") * 50).alias("w"), F.lit(400).alias("h"))
    return d.instant_budget(v.sql(_WEIGHED, "band_rows"), logo, v.videos)


WINDOWS = """
spans AS (SELECT r.video_id, cast(row_id AS VARCHAR) AS region_id, frame_idx, frame_idx / fps AS t0, least(total_frames / fps, (frame_idx + frame_skip) / fps) AS t1
          FROM band_rows r JOIN videos v ON v.video_id = r.video_id),
opened AS (SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY video_id, region_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.1::DOUBLE
           THEN 0 ELSE 1 END AS opens FROM spans),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY video_id, region_id ORDER BY frame_idx) AS run FROM opened),
windows AS (SELECT video_id, region_id, round_even(min(t0), 2) AS t0, round_even(max(t1), 2) AS t1 FROM runs GROUP BY video_id, region_id, run)
"""


def _windows(v):
    active = v.band_rows.select("video_id", F.col("row_id").cast("string").alias("region_id"), "frame_idx")
    return d.time_windows(active, v.videos)


@query("time_windows", with_views("band_rows", "videos") + "," + WINDOWS + "SELECT * FROM windows")
def _(v):
    return _windows(v)


@query("active_regions", with_views("band_rows", "videos") + "," + WINDOWS + """,
clock AS (SELECT video_id, frame_idx, frame_idx / 30::DOUBLE AS t FROM frames)
SELECT c.video_id, frame_idx, t, region_id FROM clock c JOIN windows w ON w.video_id = c.video_id AND t BETWEEN t0 AND t1""")
def _(v):
    clock = v.frames.withColumn("t", F.col("frame_idx") / 30.0)
    return d.active_regions(clock, _windows(v))


_REGIONS = """SELECT video_id, concat(cast(gx AS string), '_', cast(gy AS string)) AS region_id, (gx + gy) % 17 = 0 AS always,
    w % 23 AS n_frames FROM cell_boxes"""


@query("top_regions", with_views("cell_boxes") + f""", regions AS ({_REGIONS})
SELECT video_id, region_id, always, n_frames FROM regions
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY always DESC, n_frames DESC, region_id) <= 40""")
def _(v):
    return d.top_regions(v.sql(_REGIONS, "cell_boxes"))


PLAN = ROWS + """,
clamped_s AS (SELECT video_id, gx, gy, x - 6 - (x - 6) % 2 AS x, y - 6 - (y - 6) % 2 AS y, w, h FROM static),
statics AS (SELECT video_id, 'static_' || gx || '_' || gy AS region_id, x, y, w + 12 AS w, h + 12 AS h FROM clamped_s),
bands_c AS (SELECT video_id, row_id, n_text, greatest(0, x_min - 6) - greatest(0, x_min - 6) % 2 AS x,
    greatest(0, row_id * 42 - 6) - greatest(0, row_id * 42 - 6) % 2 AS y, least(1920, x_max + 6) AS x1,
    least(1080, row_id * 42 + least(42, 1080 - row_id * 42) + 6) AS y1 FROM kept),
bands_e AS (SELECT video_id, row_id, x, y, (x1 - x) // 2 * 2 AS w, (y1 - y) // 2 * 2 AS h FROM bands_c),
bands_k AS (SELECT * FROM bands_e WHERE w >= 8 AND h >= 8),
band_rows AS (SELECT p.video_id, p.row_id, frame_idx FROM per_row p JOIN bands_k b ON b.video_id = p.video_id AND b.row_id = p.row_id),
""" + FILLED + """,
spreads AS (SELECT f.video_id, row_id, count(*) AS n_frames, (max(frame_idx) - min(frame_idx)) / any_value(total_frames) AS spread
    FROM filled f JOIN videos v ON v.video_id = f.video_id GROUP BY 1, 2),
logo AS (SELECT video_id, sum(w * h) AS area FROM statics GROUP BY video_id),
ranked AS (SELECT f.video_id, f.row_id, frame_idx, coalesce(l.area, 0) + sum(w * h) OVER (PARTITION BY f.video_id, frame_idx
        ORDER BY spread DESC, n_frames DESC, w * h DESC, f.row_id DESC) AS held
    FROM filled f JOIN bands_k b ON b.video_id = f.video_id AND b.row_id = f.row_id
    JOIN spreads s ON s.video_id = f.video_id AND s.row_id = f.row_id LEFT JOIN logo l ON l.video_id = f.video_id),
allowed AS (SELECT * FROM ranked WHERE held <= 1920 * 1080 * 0.45::DOUBLE),
regions AS (
  SELECT video_id, region_id, x, y, w, h, true AS always, 1::DOUBLE AS spread, 1000000000 AS n_frames FROM statics
  UNION ALL
  SELECT b.video_id, 'row_' || b.row_id, x, y, w, h, false, spread, count(*) FROM bands_k b
  JOIN spreads s ON s.video_id = b.video_id AND s.row_id = b.row_id JOIN allowed a ON a.video_id = b.video_id AND a.row_id = b.row_id
  GROUP BY ALL),
best AS (SELECT * FROM regions QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY always DESC, n_frames DESC, region_id) <= 40)
"""


def _plan(v):
    return region_plan(written(v.videos, "videos"), v.frames, v.detections)


@query("region_plan", PLAN + """
SELECT video_id, region_id, x, y, w, h, greatest(1, least(22, least(w, h) // 4 - 1))::BIGINT AS radius, always, spread, n_frames::BIGINT AS n_frames FROM best""")
def _(v):
    return _plan(v).regions


@query("region_plan_active", PLAN + """
SELECT a.video_id, 'row_' || row_id AS region_id, frame_idx FROM allowed a JOIN best b ON b.video_id = a.video_id AND b.region_id = 'row_' || row_id""")
def _(v):
    return _plan(v).active


@query("region_plan_windows", PLAN + ", band_rows_on AS (SELECT a.video_id, a.row_id, frame_idx FROM allowed a "
       "JOIN best b ON b.video_id = a.video_id AND b.region_id = 'row_' || a.row_id)," + WINDOWS.replace("band_rows r", "band_rows_on r").replace(
           "cast(row_id AS VARCHAR)", "'row_' || row_id") + "SELECT * FROM windows")
def _(v):
    return _plan(v).windows


_SCORED = "SELECT event_id AS box_id, value, (event_id * 31 % 1000) / 1000e0 AS score FROM events"


@query("confidence_filter", f"SELECT * FROM ({_SCORED}) s WHERE score >= 0.7::DOUBLE")
def _(v):
    return d.confidence_filter(v.sql(_SCORED))
