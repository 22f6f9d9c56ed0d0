"""Scheduled crawls as set-wise state: which jobs are due, who may start, and what follows a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.functions.times import backoff_seconds, next_run, schedule_kind
from noticeforge.operators import store

BUSY = ("crawling", "indexing")


def sync_jobs(jobs: DataFrame, schools: DataFrame, now: Column) -> DataFrame:
    """jobs (school_id, schedule, next_run, run_count, error_count) as the schools want them.

    Schools whose schedule is off or invalid have no job; a job whose schedule is the same keeps its next run and counts, a new or
    a changed one is due now.
    """
    wanted = schools.filter(schedule_kind(F.col("crawl_schedule")).isin("interval", "cron")).select("school_id", F.col("crawl_schedule").alias("schedule"))
    old = jobs.select("school_id", F.col("schedule").alias("__old"), "next_run", "run_count", "error_count")
    same = F.col("__old").eqNullSafe(F.col("schedule")) & F.col("next_run").isNotNull()
    return wanted.join(old, "school_id", "left").select(
        "school_id", "schedule", F.when(same, F.col("next_run")).otherwise(now).alias("next_run"), F.coalesce("run_count", F.lit(0)).alias("run_count"), F.coalesce("error_count", F.lit(0)).alias("error_count")
    )


def due_jobs(jobs: DataFrame, schools: DataFrame, now: Column) -> DataFrame:
    """school_id, action of the jobs whose time has come: start, or skip where the school is busy."""
    state = schools.select("school_id", "status")
    due = jobs.filter(F.col("next_run") <= now).join(state, "school_id")
    return due.select("school_id", F.when(F.col("status").isin(*BUSY), "skip").otherwise("start").alias("action"))


def start(schools: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """schools with those of ids (school_id) that are not busy set to crawling, stamped with now. One writer must apply it."""
    asked = ids.select("school_id").distinct().withColumn("__asked", F.lit(True))
    won = F.coalesce("__asked", F.lit(False)) & ~F.coalesce(F.col("status").isin(*BUSY), F.lit(False))
    out = schools.join(asked, "school_id", "left").withColumn("__won", won)
    return out.withColumns({"status": F.when(F.col("__won"), "crawling").otherwise(F.col("status")), "crawl_started_at": F.when(F.col("__won"), now).otherwise(F.col("crawl_started_at"))}).select(*schools.columns)


def finish(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """jobs after runs (school_id, ok): a good run clears the errors and waits for its schedule, a bad one backs off."""
    out = jobs.join(results.groupBy("school_id").agg(F.bool_and("ok").alias("__ok")), "school_id", "left")
    errors = F.when(F.col("__ok").isNull(), F.col("error_count")).when(F.col("__ok"), 0).otherwise(F.col("error_count") + 1)
    later = F.when(F.col("__ok"), next_run(now, F.col("schedule"))).otherwise(F.timestamp_seconds(F.unix_timestamp(now) + backoff_seconds(F.col("error_count") + 1)))
    ran = F.col("__ok").isNotNull()
    return out.withColumns({"next_run": F.when(ran, later).otherwise(F.col("next_run")), "run_count": F.col("run_count") + ran.cast("int"), "error_count": errors}).drop("__ok").select(*jobs.columns)


def skip(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """jobs with the next run of those ids (school_id) moved on; nothing else counts for a run that was skipped."""
    hit = ids.select("school_id").distinct().withColumn("__hit", F.lit(True))
    later = F.when(F.col("__hit"), next_run(now, F.col("schedule"))).otherwise(F.col("next_run"))
    return jobs.join(hit, "school_id", "left").withColumn("next_run", later).drop("__hit").select(*jobs.columns)


def reset_status(schools: DataFrame, ids: DataFrame, status: str, only: tuple[str, ...] = BUSY) -> DataFrame:
    """schools with the status of those ids set where they are in one of `only`: a reset to idle, or to ready by force, of stuck crawls."""
    hit = ids.select("school_id").distinct().withColumn("__hit", F.lit(True))
    now = F.when(F.col("__hit") & F.col("status").isin(*only), status).otherwise(F.col("status"))
    return schools.join(hit, "school_id", "left").withColumn("status", now).select(*schools.columns)


def maintain(jobs: DataFrame, schools: DataFrame, docs: DataFrame, running: DataFrame, now: Column, misses: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, actions, docs) of one turn: jobs are synchronised with schools, due ones are started or skipped, missed documents expire.

    Schools in `running` (school_id) are being crawled by this service already: they are neither started nor skipped. A skipped
    job waits for its next time; a started one keeps its time until its result comes in (finish).
    """
    synced = sync_jobs(jobs, schools, now)
    actions = due_jobs(synced, schools, now).join(running.select("school_id").distinct(), "school_id", "left_anti")
    return skip(synced, actions.filter("action = 'skip'"), now), actions, store.expire(docs, now, misses)
