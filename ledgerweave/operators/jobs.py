"""Jobs, batches and tasks: logs, states, results and counters.

States are folds whose outcome does not depend on the order of their entries wherever that is possible, so they
are plain aggregations that combine before the shuffle; a null status counts as no entry.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours that an ended batch is kept, by status.
BATCH_HOURS = {"completed": 0.5, "failed": 2.0, "cancelled": 10 / 60}
ENDED_JOBS = ("success", "failed", "cancelled")
#: Allowed moves of a file's status; any move from a status that is not listed is allowed.
MOVES = {
    "uploading": ("splitting", "ready", "parsing"),
    "splitting": ("ready", "parsing", "error", "cancelled"),
    "ready": ("parsing", "error"),
    "parsing": ("parsed", "error", "cancelled"),
    "parsed": (),
    "error": ("parsing",),
}


def job_store(log: DataFrame) -> DataFrame:
    """Jobs left by a log (id, pos, op put or del, job): the last entry of an id counts, a deleted id is absent."""
    last = log.groupBy("id").agg(F.max_by(F.struct("op", "job"), "pos").alias("e"))
    return last.where("e.op = 'put'").select("id", "e.job")


def task_state(updates: DataFrame) -> DataFrame:
    """task, status: cancelled wins over failed, failed over completed, whatever came first; running without an end."""
    has = lambda s: F.coalesce(F.max(F.col("status") == s), F.lit(False))
    state = F.when(has("cancelled"), "cancelled").when(has("failed"), "failed").when(has("completed"), "completed").otherwise("running")
    return updates.groupBy("task").agg(state.alias("status"))


def batch_state(jobs: DataFrame) -> DataFrame:
    """batch_id, status: running while a job has not ended, failed if all failed, else completed."""
    ended = F.min(F.coalesce(F.col("status").isin(*ENDED_JOBS), F.lit(False)))
    failed = F.min(F.coalesce(F.col("status") == "failed", F.lit(False)))
    return jobs.groupBy("batch_id").agg(F.when(~ended, "running").when(failed, "failed").otherwise("completed").alias("status"))


def batch_expired(status: Column, age_hours: Column) -> Column:
    limit = F.lit(None).cast("double")
    for name, hours in BATCH_HOURS.items():
        limit = F.when(status == name, hours).otherwise(limit)
    return F.coalesce(age_hours > limit, F.lit(False))


def job_expired(status: Column, age_hours: Column, hours: float = 24.0) -> Column:
    return F.coalesce(status.isin(*ENDED_JOBS) & (age_hours > hours), F.lit(False))


def batch_results(members: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Results of the successful jobs (job_id, status, ...) of ``members`` (batch_id, job_id); jobs without a result are left out."""
    return members.join(jobs.where("status = 'success'"), "job_id").join(results, "job_id")


def hydrated(rows: DataFrame, results: DataFrame, key: str = "client_key") -> DataFrame:
    """``rows`` with the columns of the result of the same key, null without one."""
    return rows.join(results, key, "left")


def parser_stats(calls: DataFrame) -> DataFrame:
    """Per parser (parser, ok, elapsed_ms): total_calls, success_calls, avg_elapsed_ms, success_rate."""
    out = calls.groupBy("parser").agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.sum(F.coalesce(F.col("ok"), F.lit(False)).cast("long")).alias("success_calls"),
        F.coalesce(F.sum("elapsed_ms"), F.lit(0)).cast("double").alias("elapsed"),
    )
    rate = lambda x: F.coalesce(F.try_divide(x, F.col("total_calls")), F.lit(0.0))
    return out.select("parser", "total_calls", "success_calls", rate(F.col("elapsed")).alias("avg_elapsed_ms"), rate(F.col("success_calls")).alias("success_rate"))


def percent_done(current: Column, total: Column) -> Column:
    """Half-even percentage, at most 100, 0 without a total."""
    return F.when(total > 0, F.least(F.lit(100), F.bround(current / total * 100).cast("int"))).otherwise(0)


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def printable_sheets(pages: Column, per_sheet: int) -> Column:
    return F.ceil(pages / per_sheet)


def moved(status: Column, to: Column) -> Column:
    """The new status where the move is allowed, else the old one."""
    out = to
    for name, allowed in MOVES.items():
        out = F.when((status == name) & ~to.isin(*allowed), status).otherwise(out) if allowed else F.when(status == name, status).otherwise(out)
    return F.coalesce(out, status)


def file_states(updates: DataFrame, first: str = "uploading") -> DataFrame:
    """file, status after all updates (file, pos, status) in order; a null status changes nothing.

    One fold over the sorted updates of a file, whose state is its status alone; a file with very many updates costs time but no memory.
    """

    def run(batches):
        now, status, any_ = None, first, False
        for batch in batches:
            done = []
            files = batch["file"].astype(object).where(batch["file"].notna(), None)
            for file, to in zip(files, batch["status"]):
                if any_ and file != now:
                    done.append((now, status))
                if not any_ or file != now:
                    now, status, any_ = file, first, True
                if to is not None and to in MOVES.get(status, (to,)):
                    status = to
            yield pd.DataFrame(done, columns=["file", "status"])
        if any_:
            yield pd.DataFrame([(now, status)], columns=["file", "status"])

    kind = updates.schema["file"].dataType.simpleString()
    rows = updates.select("file", "pos", "status").repartition("file").sortWithinPartitions("file", "pos").select("file", "status")
    return rows.mapInPandas(run, f"file {kind}, status string")


def pending_items(items: DataFrame) -> DataFrame:
    """Waiting items (key, pos, urgent, state) with their place in line as columns turn and place, both ascending.

    Urgent ones come first, the latest of them at the head; the others in order of arrival. A key that is urgent leaves the common line; what is
    processing or completed does not wait.
    """
    waits = items.where(~F.coalesce(F.col("state").isin("processing", "completed"), F.lit(False)))
    urgent = F.coalesce(F.col("urgent"), F.lit(False))
    rushed = waits.where(urgent).select("key").distinct().withColumn("_rushed", F.lit(True))
    rows = waits.join(rushed, "key", "left").where(urgent | F.col("_rushed").isNull()).drop("_rushed")
    return rows.withColumns({"turn": F.when(urgent, 0).otherwise(1), "place": F.when(urgent, -F.col("pos")).otherwise(F.col("pos"))})


def latest_jobs(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of jobs, newest first; Spark keeps the top rows of each task only."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).offset(max(offset, 0)).limit(max(limit, 0))
