"""States of jobs and of page windows as tables: what runs, what is left to do, what came of each attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Windows of pages, minutes a page, seconds, retention.
WINDOW, WHOLE_UP_TO = 80, 100
BACKGROUND_ABOVE = 15
MINUTES_DIGITAL, MINUTES_SCANNED = 0.4, 1.5
SECONDS_A_SCANNED_PAGE = 90
KEPT_DAYS, KEPT_JOBS = 30, 500
LEAST_CHARS, LAYER_CHARS = 50, 200
LIVE = ("queued", "running")


def job_states(events: DataFrame, process_started: Column | None = None) -> DataFrame:
    """One row for each job: its latest delivery; a job still open from before the process began has failed with it."""
    latest = F.max_by(F.struct(*(c for c in events.columns if c != "job_id")), F.struct(F.coalesce("finished_at", "started_at", "created_at"), "status"))
    jobs = events.where("job_id is not null").groupBy("job_id").agg(latest.alias("j")).select("job_id", "j.*")
    if process_started is None:
        return jobs
    lost = F.col("status").isin(*LIVE) & (F.coalesce("started_at", "created_at") < process_started)
    return jobs.withColumn("error", F.when(lost, "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def job_status(jobs: DataFrame, preview: int = 2000) -> DataFrame:
    """What a caller is told of a job: state, stage, seconds so far or in all, and the start of its result."""
    seconds = F.round(F.col("finished_at") - F.col("started_at"), 1)
    return jobs.select("job_id", "kind", "status", "stage", seconds.alias("seconds"), F.substring(F.coalesce("error", "params"), 1, preview).alias("preview"))


def retained(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that retention keeps: live ones always, others for 30 days, at most the 500 newest of these (a bound that is the feature)."""
    live = jobs.where(F.col("status").isin(*LIVE))
    recent = jobs.where(~F.col("status").isin(*LIVE) & (F.col("created_at") >= now - KEPT_DAYS * 86400))
    return live.unionByName(recent.orderBy(F.desc("created_at"), "job_id").limit(KEPT_JOBS))


def runs_in_background(pages: Column, mode: Column) -> Column:
    return (F.coalesce(mode, F.lit("auto")) == "async") | ((F.coalesce(mode, F.lit("auto")) == "auto") & (F.coalesce(pages, F.lit(0)) > BACKGROUND_ABOVE))


def minutes_needed(pages: Column, scanned: Column) -> Column:
    return F.round(F.coalesce(pages, F.lit(0)) * F.when(scanned, MINUTES_SCANNED).otherwise(MINUTES_DIGITAL), 1)


def seconds_allowed(seconds: Column, pages: Column, scanned: Column) -> Column:
    """A document's time: the given one, for a scan at least 90 seconds a page."""
    return F.when(scanned, F.greatest(seconds, F.coalesce(pages, F.lit(0)) * SECONDS_A_SCANNED_PAGE)).otherwise(seconds)


def page_windows(documents: DataFrame, key: str, pages: str = "page_count") -> DataFrame:
    """(key, window_no, first, last): pages 0 to n - 1 in one window up to 100 pages, else in windows of 80."""
    n = F.greatest(F.coalesce(pages, F.lit(0)), F.lit(1))
    last = F.when(n <= WHOLE_UP_TO, 0).otherwise(F.floor((n - 1) / WINDOW)).cast("int")
    df = documents.select(key, n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    first = (F.col("window_no") * WINDOW).cast("int")
    end = F.when(F.col("n") <= WHOLE_UP_TO, F.col("n") - 1).otherwise(F.least(first + WINDOW, F.col("n")) - 1)
    return df.select(key, "window_no", first.alias("first"), end.cast("int").alias("last"))


def halves(windows: DataFrame, key: str) -> DataFrame:
    """(key, window_no, half, first, last): both halves of each window; a window of one page has one."""
    middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("half"), F.col("first"), middle.alias("last")), F.struct(F.lit(1).alias("half"), (middle + 1).alias("first"), F.col("last")))
    return windows.select(key, "window_no", F.explode(both).alias("h")).select(key, "window_no", "h.half", "h.first", "h.last").where("first <= last")


def to_do(windows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Windows without a finished checkpoint of the same parameters (key, window_no, params_hash)."""
    return windows.join(done.select(key, "window_no", "params_hash").distinct(), [key, "window_no", "params_hash"], "left_anti")


def settle(attempts: DataFrame, key: str) -> DataFrame:
    """(key, window_no, status, text): what came of each window's attempts.

    ``attempts`` has key, window_no, first, last, step (1 and 2 the engine, 3 the fallback on a text
    layer, 4 a half window), ok, text and layer_chars (characters a page of the text layer). The first
    success of the engine counts. Where there is a text layer, the fallback counts as degraded, or as
    missing with under 50 characters a page. Without one the halves that worked are put together with
    a visible note for those that did not.
    """
    w = [key, "window_no"]
    best = F.min_by("text", F.when(F.col("ok") & (F.col("step") <= 2), F.col("step")))
    fallback = F.max(F.when(F.col("ok") & (F.col("step") == 3), F.col("text")))
    note = F.concat(F.lit("[pages "), (F.col("first") + 1).cast("string"), F.lit("-"), (F.col("last") + 1).cast("string"), F.lit(" are missing]"))
    half = F.when(F.col("step") == 4, F.struct("first", F.col("ok").alias("ok"), F.when(F.col("ok"), F.col("text")).otherwise(note).alias("text")))
    df = attempts.groupBy(*w).agg(
        F.max(F.col("ok") & (F.col("step") <= 2)).alias("engine"), best.alias("engine_text"), fallback.alias("fallback"), F.max("layer_chars").alias("layer"),
        F.sort_array(F.collect_list(half)).alias("halves"), F.min(F.when(F.col("step") < 4, F.col("first"))).alias("first"), F.max(F.when(F.col("step") < 4, F.col("last"))).alias("last"),
    )
    missing = F.concat(F.lit("[pages "), (F.col("first") + 1).cast("string"), F.lit("-"), (F.col("last") + 1).cast("string"), F.lit(" are missing]"))
    enough = F.length(F.trim(F.coalesce("fallback", F.lit("")))) >= LEAST_CHARS * (F.col("last") - F.col("first") + 1)
    has_layer = F.coalesce("layer", F.lit(0)) >= LAYER_CHARS
    whole = F.array_join(F.transform("halves", lambda h: h["text"]), "\n\n")
    all_halves = (F.size("halves") > 0) & F.forall("halves", lambda h: h["ok"])
    status = F.when(F.col("engine"), "ok").when(has_layer & enough, "degraded").when(~has_layer & all_halves, "ok").otherwise("missing")
    text = F.when(F.col("engine"), F.col("engine_text")).when(has_layer & enough, F.col("fallback")).when(~has_layer & (F.size("halves") > 0), whole).otherwise(missing)
    return df.select(*w, status.alias("status"), text.alias("text"))


def batch_report(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row: how many of each outcome, and all."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == s).alias(s) for s in ("ok", "degraded", "missing")))


