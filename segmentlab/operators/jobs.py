"""Job rows: upsert, status folding, latest per file, timeouts, stages, progress, edits.

"Latest" is always an arg-max aggregation: it combines before the shuffle, so a
file name or job with any number of rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentlab.functions import fixed
from segmentlab.operators import blocks

RESULTS_TYPE = "map<string,map<string,struct<success:boolean,duration:double,error:string>>>"


def _last_row(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def upsert_jobs(jobs: DataFrame, incoming: DataFrame, order: str = "updated_at", now: Column | None = None) -> DataFrame:
    """Insert or replace whole rows by ``job_id``; of repeated incoming rows the last by ``order``.

    A written row counts as created ``now``. Other columns that it lacks become NULL, they are not taken from the old
    row; columns that only the incoming rows have are added to the table.
    """
    created = (F.current_timestamp() if now is None else now).cast(jobs.schema["created_at"].dataType)
    fresh = _last_row(incoming, ["job_id"], F.col(order)).withColumn("created_at", created)
    kept = jobs.join(fresh.select("job_id"), "job_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def apply_status_updates(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Fold ordered updates (``job_id, seq, status, results, error, updated_at``) into the jobs.

    Each update sets the status; it sets ``results`` if given, else ``error`` if
    given. Neither is ever cleared. Updates of unknown jobs change nothing.
    """
    with_results = F.col("results").isNotNull()
    with_error = ~with_results & F.col("error").isNotNull()
    folded = updates.groupBy("job_id").agg(
        F.max_by(F.struct("status", "updated_at"), "seq").alias("_now"),
        F.max_by("results", F.when(with_results, F.col("seq"))).alias("_results"),
        F.max_by("error", F.when(with_error, F.col("seq"))).alias("_error"))
    changed = jobs.join(folded, "job_id", "left")
    for column, value in (("status", "_now.status"), ("updated_at", "_now.updated_at"),
                          ("results", "_results"), ("error", "_error")):
        changed = changed.withColumn(column, F.coalesce(F.col(value), F.col(column)))
    return changed.select(*jobs.columns)


def latest_job(jobs: DataFrame, filenames: DataFrame | None = None) -> DataFrame:
    """Latest job per file name (``created_at``, then ``job_id``), of all or of the given names; ``job_id`` is the key of ``jobs``.

    Chosen from names, times and ids alone: a hash aggregate finds the newest time of a name, ties are cut to one row
    before and after the shuffle; the wide rows are then read by their key and never sorted or aggregated.
    """
    asked = jobs
    if filenames is not None:
        asked = blocks.lookup(jobs, filenames.select("filename").distinct(), ["filename"], "job_id", "left_semi")
    newest = asked.groupBy("filename").agg(F.max("created_at").alias("_newest"))
    at_newest = F.col("filename").eqNullSafe(F.col("_name")) & F.col("created_at").eqNullSafe(F.col("_newest"))
    tied = jobs.select("filename", "created_at", "job_id").join(newest.withColumnRenamed("filename", "_name"), at_newest, "left_semi")
    first = Window.partitionBy("filename").orderBy(F.col("job_id").desc())
    chosen = tied.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select(
        F.col("job_id").alias("_id"), F.col("created_at").alias("_at"), F.col("filename").alias("_name"))
    same = F.col("job_id").eqNullSafe(F.col("_id")) & F.col("created_at").eqNullSafe(F.col("_at")) & F.col("filename").eqNullSafe(F.col("_name"))
    return jobs.join(chosen, same, "left_semi")


def jobs_by_id(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids.select("job_id"), "job_id", "left_semi")


def jobs_by_status(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """Jobs in one of ``statuses``; an empty list gives no rows."""
    return jobs.filter(F.col("status").isin(*statuses)) if statuses else jobs.limit(0)


def expire_stale(jobs: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """Running jobs without an update for ``hours`` fail, cancelling ones become cancelled.

    Adds ``is_changed``; its count is the number of rows changed. The cutoff is
    taken at whole seconds.
    """
    cutoff = F.date_trunc("second", now) - F.make_interval(hours=F.lit(hours))
    stale = F.col("status").isin(*fixed.RUNNING_STATUSES) & (F.col("updated_at") < cutoff)
    cancelling = F.col("status") == "CANCELLING"
    return (
        jobs.withColumn("_stale", F.coalesce(stale, F.lit(False))).withColumn("_cancelling", cancelling)
        .withColumn("is_changed", F.col("_stale") | F.col("_cancelling"))
        .withColumn("status", F.when(F.col("_stale"), "FAILED").when(F.col("_cancelling"), "CANCELLED")
                    .otherwise(F.col("status")))
        .withColumn("error", F.when(F.col("_stale"), fixed.TIMEOUT_ERROR).otherwise(F.col("error")))
        .withColumn("updated_at", F.when(F.col("is_changed"), now).otherwise(F.col("updated_at")))
        .drop("_stale", "_cancelling")
    )


def base_name(filename: Column) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(filename, r"(?s)^(.*[^.].*)\.[^.]*$", "$1")


def _with_job_and_output(names: DataFrame, jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    latest = latest_job(jobs, names.select("filename").distinct()).select(
        "filename", "job_id", F.col("status").alias("_status"))
    made = outputs.select("base_name").distinct().withColumn("_made", F.lit(True))
    return (
        names.select("filename").withColumn("base_name", base_name(F.col("filename")))
        .join(latest, "filename", "left").join(made, "base_name", "left")
        .withColumn("has_output", F.coalesce("_made", F.lit(False)))
    )


def library_status(files: DataFrame, jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each file with the status of its latest job, else COMPLETED if its output exists, else PENDING."""
    status = F.coalesce("_status", F.when(F.col("has_output"), "COMPLETED").otherwise("PENDING"))
    return _with_job_and_output(files, jobs, outputs).select("filename", status.alias("status"), "has_output", "job_id")


def status_lookup(requests: DataFrame, jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """As :func:`library_status` for asked names; NOT_FOUND where nothing is known."""
    status = F.coalesce("_status", F.when(F.col("has_output"), "COMPLETED").otherwise("NOT_FOUND"))
    return _with_job_and_output(requests, jobs, outputs).select("filename", status.alias("status"), "job_id")


def with_stages(jobs: DataFrame) -> DataFrame:
    """Adds ``stages``, one map of stage to result, and ``second``, that of phase 2 alone
    (NULL if it never ran); in ``stages`` phase 2 overrides phase 1.

    The text is parsed once and everything about stages is read inside the row.
    """
    parsed = jobs.withColumn("_phases", F.from_json("results", RESULTS_TYPE))
    nothing = F.expr("map()").cast(RESULTS_TYPE[len("map<string,"):-1])
    split = parsed.withColumn("_first", F.coalesce(F.col("_phases")["phase1"], nothing)).withColumn(
        "second", F.col("_phases")["phase2"])
    not_redone = F.map_filter("_first", lambda stage, _: ~F.coalesce(F.map_contains_key("second", stage), F.lit(False)))
    return split.withColumn("stages", F.map_concat(not_redone, F.coalesce("second", nothing))).drop("_phases", "_first")


def stage_results(jobs: DataFrame) -> DataFrame:
    """One row per job and stage."""
    # An outer explode: a plain one makes Spark test the size first and parse every text twice.
    rows = with_stages(jobs).select("job_id", F.explode_outer("stages").alias("stage", "_r")).filter("stage IS NOT NULL")
    return rows.select("job_id", "stage", "_r.success", "_r.duration", "_r.error")


def _all_passed(keep) -> Column:
    relevant = F.map_filter("stages", lambda stage, _: keep(stage))
    return F.forall(F.map_values(relevant), lambda r: F.coalesce(r["success"], F.lit(False)))


def phase_gate(jobs: DataFrame) -> DataFrame:
    """Next status per job from its stage results.

    Only stages that are present count, so a job whose transcript came out empty
    passes; ``n_required`` tells how many required stages were there.
    """
    staged = with_stages(jobs)
    required = F.map_filter("stages", lambda s, _: s.isin(*fixed.PHASE1_REQUIRED))
    gated = (
        staged.withColumn("phase1_ok", _all_passed(lambda s: s.isin(*fixed.PHASE1_REQUIRED)))
        .withColumn("n_required", F.size(required).cast("bigint"))
    )
    second_ok = F.forall(F.map_values(F.map_filter("second", lambda s, _: ~s.isin(*fixed.OPTIONAL_PHASE2))),
                         lambda r: F.coalesce(r["success"], F.lit(False)))
    gated = gated.withColumn("phase2_ok", second_ok)
    status = (
        F.when(F.col("phase2_ok"), "COMPLETED").when(~F.col("phase2_ok"), "FAILED")
        .when(~F.col("phase1_ok"), "FAILED")
        .when(F.coalesce("auto_resume", F.lit(False)), "PROCESSING_PHASE2").otherwise("AWAITING_REVIEW")
    )
    return gated.select("job_id", "phase1_ok", "phase2_ok", "n_required", status.alias("next_status"))


def progress(jobs: DataFrame) -> DataFrame:
    """One row per job and stage with its state, the active step and the percentage done."""
    staged = with_stages(jobs).withColumn("_busy", F.col("status").isin(*fixed.RUNNING_STATUSES))
    lip_sync = F.coalesce(F.col("enable_lipsync"), F.lit(False))
    steps = F.transform(F.array(*[F.lit(s) for s in fixed.STAGES]), lambda stage, i: F.struct(
        i.alias("step"), stage.alias("stage"),
        ((stage == "lip_sync") & ~lip_sync).alias("off"),
        F.col("stages")[stage].isNotNull().alias("known"),
        F.coalesce(F.col("stages")[stage]["success"], F.lit(False)).alias("passed"),
    ))
    listed = staged.withColumn("_steps", steps)
    waiting = F.filter("_steps", lambda s: ~s["known"] & ~s["off"])
    passed = F.filter("_steps", lambda s: s["passed"])
    listed = listed.withColumn("_next", F.when(F.col("_busy") & (F.size(waiting) > 0), F.get(waiting, 0)["step"]))
    last = len(fixed.STAGES) - 1
    active = (
        F.when(F.col("status") == "COMPLETED", last)
        .otherwise(F.coalesce("_next", F.when(F.size(passed) > 0, F.try_element_at(passed, F.lit(-1))["step"]), F.lit(0)))
    )
    shown = listed.select("job_id", "status", "_next", active.cast("bigint").alias("active_step"),
                          F.explode_outer("_steps").alias("_s"))
    state = (
        F.when(F.col("_s.off"), "disabled").when(F.col("_s.passed"), "completed").when(F.col("_s.known"), "failed")
        .when(F.col("_s.step") == F.col("_next"), "active").otherwise("pending")
    )
    return shown.select(
        "job_id", F.col("_s.step").cast("bigint").alias("step"), F.col("_s.stage").alias("stage"),
        state.alias("state"), "active_step", (F.col("active_step") / last * 100).alias("percent"))


def stage_timings(jobs: DataFrame) -> DataFrame:
    """Per stage over all jobs: runs, passes, mean and longest seconds."""
    return stage_results(jobs).groupBy("stage").agg(
        F.count("*").alias("runs"), F.count_if("success").alias("passed"),
        F.avg("duration").alias("avg_seconds"), F.max("duration").alias("max_seconds"))


def last_edits(edits: DataFrame) -> DataFrame:
    """The last edit per segment and job; ``seq`` orders them."""
    return edits.groupBy("job_id", "id").agg(
        F.max_by("translated_text", "seq").alias("translated_text"), F.max("seq").alias("seq"))


def apply_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments with the last edit of each; an edit counts only for its own job.
    ``is_edited`` marks the rows updated."""
    last = last_edits(edits).select("job_id", "id", F.col("translated_text").alias("_text"), F.lit(True).alias("_hit"))
    edited = segments.join(last, ["job_id", "id"], "left").withColumn("is_edited", F.coalesce("_hit", F.lit(False)))
    return edited.withColumn(
        "translated_text", F.when(F.col("is_edited"), F.col("_text")).otherwise(F.col("translated_text"))
    ).drop("_text", "_hit")


def rejected_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits for which the job has no such segment."""
    return edits.join(segments.select("job_id", "id"), ["job_id", "id"], "left_anti")


def job_settings(jobs: DataFrame, base: dict[str, object] | None = None) -> DataFrame:
    """Per-job settings: the job's own flags, else the defaults."""
    defaults = {"enable_lipsync": False, "enable_ocr": True, "ocr_mode": "blur", "voice_mode": "multi",
                "voice_preset": "", **(base or {})}
    return jobs.select("job_id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def stale_paths(dirs: DataFrame, jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Folders older than ``hours`` that belong to no active job. A report; nothing is deleted."""
    active = jobs_by_status(jobs, fixed.ACTIVE_STATUSES).select(base_name(F.col("filename")).alias("name")).distinct()
    old = dirs.filter(F.col("modified_at") < now - F.make_interval(hours=F.lit(hours)))
    return old.join(active, "name", "left_anti")
