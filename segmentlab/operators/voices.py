"""Reference passages for voices and the layout of spoken clips on a timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentlab.functions import fixed, text
from segmentlab.operators import blocks
from segmentlab.operators.normalize import capped_text
from segmentlab.operators.transcripts import duration

BLOCK_SAMPLES = 1 << 20


def _span(cap: float) -> tuple[Column, Column]:
    """First and one-past-last sample of a clip of at most ``cap`` seconds."""
    rate = F.col("sample_rate")
    stop = F.least(F.col("end_time"), F.col("start_time") + cap)
    first = F.greatest(F.lit(0), (F.col("start_time") * rate).cast("bigint"))
    last = F.least(F.col("total_frames"), (stop * rate).cast("bigint"))
    return first, last


def _clip(longest: DataFrame, tracks: DataFrame, keys: list[str], cap: float) -> DataFrame:
    first, last = _span(cap)
    return (
        blocks.lookup(longest, tracks.select("job_id", "sample_rate", "total_frames"), ["job_id"], "seq")
        .withColumn("ref_start", first).withColumn("ref_end", last)
        .filter(F.col("ref_end") > F.col("ref_start"))
        .select(*keys, "seq", "ref_start", "ref_end",
                capped_text(F.col("original_text"), duration(), cap).alias("ref_text"))
    )


def _longest(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Longest segment per key; of equally long ones the first. An arg-max
    combines before the shuffle, so a key may have any number of segments."""
    row = F.struct("seq", "start_time", "end_time", "original_text")
    best = segments.groupBy(*keys).agg(F.max_by(row, F.struct(duration(), -F.col("seq"))).alias("_row"))
    return best.select(*keys, "_row.*")


def speaker_reference(segments: DataFrame, tracks: DataFrame, cap: float = fixed.REFERENCE_CAP) -> DataFrame:
    """Clip of the longest segment per job and named speaker; none if it is empty."""
    named = segments.filter(~text.is_blank(F.col("speaker")))
    return _clip(_longest(named, ["job_id", "speaker"]), tracks, ["job_id", "speaker"], cap)


def global_reference(segments: DataFrame, tracks: DataFrame, cap: float = fixed.REFERENCE_CAP) -> DataFrame:
    """Clip of the longest segment per job."""
    return _clip(_longest(segments, ["job_id"]), tracks, ["job_id"], cap)


def assign_reference(segments: DataFrame, tracks: DataFrame, speaker_refs: DataFrame, global_refs: DataFrame,
                     voices: DataFrame, settings: DataFrame, min_own: float = fixed.MIN_OWN_REFERENCE,
                     cap: float = fixed.REFERENCE_CAP) -> DataFrame:
    """The passage each spoken line is cloned from.

    ``settings`` has ``voice_mode`` and ``voice_preset`` per job, ``voices`` the
    presets whose file is there. Mode ``single`` takes the preset, else the
    job's longest passage; any other mode takes the line itself if long enough,
    else its speaker's passage, else the job's. A passage without text is dropped.
    Lines without translation or duration are left out.
    """
    preset = voices.select(F.col("id").alias("voice_preset"), F.col("ref_text").alias("preset_text"),
                           F.lit(True).alias("has_preset"))
    whole = global_refs.select("job_id", F.col("ref_start").alias("g_start"), F.col("ref_end").alias("g_end"),
                               F.col("ref_text").alias("g_text"))
    per_job = (
        blocks.lookup(settings.select("job_id", "voice_mode", "voice_preset"), preset, ["voice_preset"], "job_id", "left")
        .join(tracks.select("job_id", "sample_rate", "total_frames"), "job_id", "left")
        .join(whole, "job_id", "left")
    )
    own_speaker = speaker_refs.select("job_id", "speaker", F.col("ref_start").alias("s_start"),
                                      F.col("ref_end").alias("s_end"), F.col("ref_text").alias("s_text"))
    spoken = segments.filter(~text.is_blank(F.col("translated_text")) & (duration() > 0))
    rows = blocks.lookup(spoken, per_job, ["job_id"], "seq", "left")
    rows = blocks.lookup(rows, own_speaker, ["job_id", "speaker"], "seq", "left")

    first, last = _span(cap)
    rows = rows.withColumn("o_start", first).withColumn("o_end", last).withColumn(
        "o_text", capped_text(F.col("original_text"), duration(), cap))
    single = F.coalesce(F.col("voice_mode"), F.lit("multi")) == "single"
    own = ~single & (duration() >= min_own) & F.coalesce(F.col("o_end") > F.col("o_start"), F.lit(False))
    kind = (
        F.when(single & F.coalesce("has_preset", F.lit(False)), "preset")
        .when(own, "own")
        .when(~single & F.col("s_start").isNotNull(), "speaker")
        .when(F.col("g_start").isNotNull(), "global")
    )
    rows = rows.withColumn("_kind", kind)

    def pick(own_col: str, speaker_col: str, global_col: str) -> Column:
        return (F.when(F.col("_kind") == "own", F.col(own_col)).when(F.col("_kind") == "speaker", F.col(speaker_col))
                .when(F.col("_kind") == "global", F.col(global_col)))

    said = F.when(F.col("_kind") == "preset", F.col("preset_text")).otherwise(pick("o_text", "s_text", "g_text"))
    usable = ~text.is_blank(said)
    return rows.select(
        "job_id", "seq", F.when(usable, F.col("_kind")).alias("ref_kind"),
        F.when(usable & (F.col("_kind") == "preset"), F.col("voice_preset")).alias("ref_voice"),
        F.when(usable, pick("o_start", "s_start", "g_start")).alias("ref_start"),
        F.when(usable, pick("o_end", "s_end", "g_end")).alias("ref_end"),
        F.when(usable, said).alias("ref_text"),
    )


def stretch_plan(clips: DataFrame, lo: float = fixed.MIN_RATE, hi: float = fixed.MAX_RATE) -> DataFrame:
    """Adds the stretch ``rate`` of ``current_duration`` to ``target_duration`` and its ``state``."""
    current, target = F.col("current_duration"), F.col("target_duration")
    raw = F.when((target > 0) & (current > 0), current / target)
    state = (
        F.when(target <= 0, "error").when(current <= 0, "passthrough")
        .when(raw > hi, "clamped_high").when(raw < lo, "clamped_low").otherwise("ok")
    )
    clamped = F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(lo)), F.lit(hi)))
    return clips.withColumn("rate", clamped).withColumn("state", state)


def stretch_distribution(plan: DataFrame, per_block: int = 1000) -> DataFrame:
    """Spread of the rates per job, with exact percentiles of any number of rates.

    Equal rates are counted first. The counts are summed up in order of the rate by blocks of
    ``1 / per_block``, and a percentile lies between the two rates around its place.
    """
    totals = plan.groupBy("job_id").agg(
        F.count("rate").alias("n"), F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"),
        F.count_if(F.col("state").startswith("clamped")).alias("clamped"),
        F.count_if(F.col("state") == "error").alias("errors"))
    counts = plan.filter("rate IS NOT NULL").groupBy("job_id", "rate").agg(F.count("*").alias("_rows"))
    upto = blocks.running(counts, ["job_id"], ["rate"], F.col("_rows"), "sum", "_upto", F.floor(F.col("rate") * per_block).cast("bigint"))
    places = upto.join(totals.select("job_id", "n"), "job_id")

    def around(share: float) -> tuple[Column, Column]:
        place = (F.col("n") - 1) * share
        return tuple(F.min(F.when(F.col("_upto") > at, F.col("rate"))) for at in (F.floor(place), F.ceil(place)))

    found = places.groupBy("job_id").agg(*(c.alias(f"_{name}{i}") for name, share in (("median", 0.5), ("p90", 0.9)) for i, c in enumerate(around(share))))

    def between(name: str, share: float) -> Column:
        place = (F.col("n") - 1) * share
        low, high = F.col(f"_{name}0"), F.col(f"_{name}1")
        return (low + (high - low) * (place - F.floor(place))).alias(f"{name}_rate")

    return totals.join(found, "job_id", "left").select(
        "job_id", "n", "min_rate", "max_rate", between("median", 0.5), between("p90", 0.9), "clamped", "errors")


def output_rates(clips: DataFrame) -> DataFrame:
    """The most frequent sample rate per job, the lowest of equally frequent ones."""
    counts = clips.groupBy("job_id", "sample_rate").agg(F.count("*").alias("n"))
    return counts.groupBy("job_id").agg(
        F.max_by("sample_rate", F.struct("n", -F.col("sample_rate"))).alias("out_rate"))


def timeline_placement(clips: DataFrame) -> DataFrame:
    """Where each clip starts and how much of it is kept.

    ``clips``: ``job_id, seq, start_time, n_samples, sample_rate``. A clip is cut
    at the start of the next one; of clips with one start only the last stays.
    """
    placed = blocks.lookup(clips, output_rates(clips), ["job_id"], "seq").select(
        "job_id", "seq", "out_rate",
        (F.col("start_time") * F.col("out_rate")).cast("bigint").alias("start_sample"),
        F.ceil(F.col("n_samples") * F.col("out_rate") / F.col("sample_rate")).cast("bigint").alias("length"),
    )
    starts = placed.groupBy("job_id", "start_sample").agg(F.max("seq").alias("seq"))
    starts = blocks.following(starts, ["job_id"], "start_sample", "_next",
                              blocks.block_of(F.col("start_sample"), BLOCK_SAMPLES))
    # Only the last clip of a start finds its row here, so no key is hot.
    joined = placed.join(starts.withColumn("_stays", F.lit(True)), ["job_id", "start_sample", "seq"], "left")
    room = F.when(F.col("_stays"), F.col("_next") - F.col("start_sample")).otherwise(F.lit(0))
    return joined.select(
        "job_id", "seq", "out_rate", "start_sample", "length", F.least("length", room).alias("kept_length"))


def timeline_length(placements: DataFrame) -> DataFrame:
    return placements.groupBy("job_id").agg(
        F.max("out_rate").alias("out_rate"), F.count("*").alias("n_clips"),
        F.max(F.col("start_sample") + F.col("kept_length")).alias("total_samples"))


def overlap_report(placements: DataFrame) -> DataFrame:
    """Per job: clips that ran into the next one and the seconds cut off."""
    cut = F.col("length") - F.col("kept_length")
    return placements.groupBy("job_id").agg(
        F.count("*").alias("n_clips"), F.count_if(cut > 0).alias("n_trimmed"),
        (F.sum(cut) / F.max("out_rate")).alias("trimmed_seconds"))


def mixdown_series(series: DataFrame, placements: DataFrame) -> DataFrame:
    """Sum placed series (``job_id, seq, idx, value``) on one index; scale by the peak if it exceeds 1."""
    offsets = placements.select("job_id", "seq", "start_sample", "kept_length")
    mixed = (
        blocks.lookup(series, offsets, ["job_id", "seq"], "idx").filter(F.col("idx") < F.col("kept_length"))
        .groupBy("job_id", (F.col("start_sample") + F.col("idx")).alias("idx")).agg(F.sum("value").alias("value"))
    )
    peaks = mixed.groupBy("job_id").agg(F.max(F.abs("value")).alias("_peak"))
    return blocks.lookup(mixed, peaks, ["job_id"], "idx").select(
        "job_id", "idx", F.when(F.col("_peak") > 1, F.col("value") / F.col("_peak")).otherwise(F.col("value")).alias("value"))
