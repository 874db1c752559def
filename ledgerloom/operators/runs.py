"""Run and page state as tables: upserts, resume sets, status rollups, version slots, manifests.

State transitions are DataFrame to DataFrame; ``replace_partitions`` is the one writer. Plain Parquet has
no transactions: a partition is replaced whole, which is idempotent when a lost job runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import present


def latest_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key by order (M3); the order must be unique inside a key for a defined result.

    An aggregate of whole rows with map-side combining, so a key with very many versions does not gather in one task.
    """
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*key, *[F.col("_r")[c].alias(c) for c in rest]).select(*rows.columns)


def upsert(base: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """base with rows of updates in place of those with their key, and new keys added (M3); updates hold a key once."""
    return base.join(updates.select(*key), key, "left_anti").unionByName(updates)


def insert_absent(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """base with those rows whose key it lacks (M4)."""
    return base.unionByName(rows.join(base.select(*key), key, "left_anti"), allowMissingColumns=True)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write rows, replacing exactly the partitions they fall into."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def resume_pages(pages: DataFrame) -> DataFrame:
    """Pages still to be processed (M5): pending, running and failed, not those waiting for review."""
    return pages.where(F.col("status").isin("pending", "running", "failed"))


def requeue_review(pages: DataFrame) -> DataFrame:
    """Pages with those waiting for review back to pending and their error cleared (M6)."""
    waiting = F.col("status") == "needs_review"
    return pages.withColumn("error", F.when(waiting, F.lit(None).cast("string")).otherwise(F.col("error"))).withColumn("status", F.when(waiting, "pending").otherwise(F.col("status")))


def confirm_templates(temporary: DataFrame, pages: DataFrame, run: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(confirmed, faults, pages) of confirming the temporary templates of some runs.

    A template with faults is not confirmed. The waiting pages of a run with a confirmed one are queued again.
    """
    from ledgerloom.sources.assets import template_faults

    faults = template_faults(temporary)
    confirmed = temporary.join(faults.select("template_id"), "template_id", "left_anti")
    runs = confirmed.select(*run).distinct()
    return confirmed, faults, requeue_review(pages.join(runs, run, "left_semi")).unionByName(pages.join(runs, run, "left_anti"))


def page_state(kind: Column, parser_status: Column, report_status: Column) -> Column:
    """State of a processed page."""
    review = parser_status.isin("failed", "page_review") | F.coalesce(report_status.isin("review", "page_review"), F.lit(False))
    return F.when(kind == "page_error", "failed").when(F.coalesce(review, F.lit(False)), "needs_review").otherwise("completed")


def run_status(pages: DataFrame, run: list[str]) -> DataFrame:
    """Status of each run from its pages (A14): failed if any is, else needs_review if any, else completed if all are, else running."""
    is_ = lambda s: F.col("status") == s
    status = F.when(F.bool_or(is_("failed")), "failed").when(F.bool_or(is_("needs_review")), "needs_review").when(F.bool_and(is_("completed")), "completed").otherwise("running")
    return pages.groupBy(*run).agg(status.alias("status"), F.count(F.lit(1)).alias("pages"))


def refresh_pages(pages: DataFrame, reports: DataFrame, page: list[str], promote_only: bool = False) -> DataFrame:
    """Page states after validation (J15, M12): a finished page needs review if it has an error, an open issue or a review status, else it is completed.

    reports hold status and open_issues per page. With ``promote_only`` a waiting page without findings is
    completed and nothing else changes.
    """
    df = pages.join(reports.select(*page, F.col("status").alias("_report"), "open_issues"), page, "left")
    found = F.coalesce(F.col("open_issues") > 0, F.lit(False)) | F.coalesce(F.col("_report").isin("review", "page_review"), F.lit(False))
    if promote_only:
        done = (F.col("status") == "needs_review") & ~found
        status = F.when(done, "completed").otherwise(F.col("status"))
    else:
        needs = present(F.col("error")).isNotNull() | found
        fixed = F.col("status").isin("failed", "pending", "running")
        done = ~fixed & ~needs
        status = F.when(fixed, F.col("status")).when(needs, "needs_review").otherwise("completed")
    return df.select(*[F.when(done, F.lit(None)).otherwise(F.col(c)).alias(c) if c == "error" else status.alias(c) if c == "status" else F.col(c) for c in pages.columns])


def finalize_runs(pages: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports, page states and run states after validating whole documents (M8, E9): (reports, pages, runs).

    Pages without candidates have no new report (Q16). pages hold statement_id, page_index, status and error.
    """
    from ledgerloom.operators import ledger

    page = [ledger.DOC, "page_index"]
    issues = ledger.validation_issues(candidates)
    reports = ledger.page_reports(candidates, issues)
    found = issues.groupBy(*page).agg(F.count_if(~F.col("rule_state").isin("pass", "not_applicable")).alias("open_issues"))
    fresh = refresh_pages(pages, reports.join(found, page, "left").fillna(0, ["open_issues"]), page)
    return reports, fresh, run_status(fresh, [ledger.DOC])


def manifest_diff(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Files that are missing, unlisted or changed (J20, J23): key, verdict. Empty means equal."""
    a, b = expected.select(key, F.col(value).alias("_e"), F.lit(True).alias("_x")), actual.select(key, F.col(value).alias("_a"), F.lit(True).alias("_y"))
    df = a.join(b, key, "full_outer")
    verdict = F.when(F.col("_y").isNull(), "missing").when(F.col("_x").isNull(), "unlisted").when(~F.col("_e").eqNullSafe(F.col("_a")), "changed")
    return df.select(key, verdict.alias("verdict")).where("verdict is not null")


def same_run(expected: DataFrame, actual: DataFrame) -> bool:
    """Whether two run manifests, name and value, are equal: the guard before a run is resumed (M7)."""
    return manifest_diff(expected, actual, "name", "value").isEmpty()


def version_slots(log: DataFrame, slot: str = "slot", order: str = "ord") -> DataFrame:
    """Current and previous version of each slot after its log of activate and rollback.

    Activating another version moves the current one to previous; rollback swaps the two and needs both.
    """
    events = F.array_sort(F.collect_list(F.struct(order, "action", "version")))
    start = F.struct(F.lit(None).cast("string").alias("current"), F.lit(None).cast("string").alias("previous"))

    def step(s: Column, e: Column) -> Column:
        other = s["current"].isNotNull() & (F.lower(s["current"]) != F.lower(e["version"]))
        activated = F.struct(e["version"].alias("current"), F.when(other, s["current"]).otherwise(s["previous"]).alias("previous"))
        swapped = F.struct(s["previous"].alias("current"), s["current"].alias("previous"))
        can = s["current"].isNotNull() & s["previous"].isNotNull()
        return F.when(e["action"] == "activate", activated).when((e["action"] == "rollback") & can, swapped).otherwise(s)

    return log.groupBy(slot).agg(F.aggregate(events, start, step).alias("s")).select(slot, "s.current", "s.previous")


# What an action makes of a task in a state; other pairs change nothing.
TASK_STEPS = {
    ("queued", "start"): "running", ("running", "complete"): "completed", ("running", "fail"): "failed", ("queued", "pause"): "paused", ("running", "pause"): "paused",
    ("paused", "resume"): "queued", ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancelled", ("paused", "cancel"): "cancelled",
    ("completed", "restart"): "queued", ("failed", "restart"): "queued", ("cancelled", "restart"): "queued",
}


#: Events of a task that are folded as one; a task with more is folded chunk by chunk.
LOG_CHUNK = 1_000


def task_states(events: DataFrame, task: str = "task_id", order: str = "ord") -> DataFrame:
    """State and attempt of each task after its events (M15, W9); a restart begins a new attempt.

    A chunk of a task's events is folded to what it makes of every state, and these few states of each chunk
    are folded in turn, so no row holds the whole log of a task.
    """
    steps = F.create_map(*[F.lit(x) for (s, a), t in TASK_STEPS.items() for x in (f"{s}:{a}", t)])
    names = list(dict.fromkeys(s for pair in TASK_STEPS.items() for s in (pair[0][0], pair[1])))
    states = F.array(*[F.lit(s) for s in names])
    at = lambda state, restarts: F.struct(state.alias("state"), restarts.alias("restarts"))

    def step(s: Column, e: Column) -> Column:
        to = F.try_element_at(steps, F.concat_ws(":", s["state"], e["action"]))
        again = to.isNotNull() & (e["action"] == "restart")
        return at(F.coalesce(to, s["state"]), s["restarts"] + F.when(again, 1).otherwise(0))

    def follow(s: Column, chunk: Column) -> Column:
        end = F.get(chunk["ends"], (F.array_position(states, s["state"]) - 1).cast("int"))
        return at(end["state"], s["restarts"] + end["restarts"])

    place = F.row_number().over(Window.partitionBy(task).orderBy(order))
    rows = events.select(task, order, "action", F.floor((place - 1) / LOG_CHUNK).alias("_chunk"))
    chunks = rows.groupBy(task, "_chunk").agg(F.array_sort(F.collect_list(F.struct(order, "action"))).alias("log"))
    ends = chunks.select(task, F.struct("_chunk", F.transform(states, lambda s: F.aggregate("log", at(s, F.lit(0)), step)).alias("ends")).alias("c"))
    done = ends.groupBy(task).agg(F.aggregate(F.array_sort(F.collect_list("c")), at(F.lit("queued"), F.lit(0)), follow).alias("s"))
    return done.select(task, "s.state", (F.col("s.restarts") + 1).alias("attempt"))


def queue_order(tasks: DataFrame, queue: str = "queue") -> DataFrame:
    """Queued tasks in the order they will run in their queue (O8): first in, first out; paused and cancelled ones are passed over."""
    return tasks.where("state = 'queued'").withColumn("position", F.row_number().over(Window.partitionBy(queue).orderBy("ord")))


def batch_counts(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Finished tasks of each batch (A27): completed, and not completed, which is failed or cancelled."""
    return tasks.groupBy(*by).agg(F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state").isin("failed", "cancelled")).alias("not_completed"))


def needs_review_counts(pages: DataFrame, reports: DataFrame, run: list[str]) -> DataFrame:
    """Pages of each run that wait for review (A26): by their stored state, and by the status of their report."""
    stored = pages.groupBy(*run).agg(F.count_if(F.col("status") == "needs_review").alias("by_state"))
    reported = reports.groupBy(*run).agg(F.count_if(F.col("status").isin("review", "page_review")).alias("by_report"))
    return stored.join(reported, run, "full_outer").fillna(0, ["by_state", "by_report"])


def project_runs(projects: DataFrame, runs: DataFrame, project: str | list[str] = "project_id") -> DataFrame:
    """Runs with the columns of their project (J14); runs of no project and projects without runs have no row."""
    return runs.join(projects, project)


def delete_project(projects: DataFrame, runs: DataFrame, gone: DataFrame, project: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """(projects, runs) without some projects and all that belongs to them."""
    return projects.join(gone.select(project), project, "left_anti"), runs.join(gone.select(project), project, "left_anti")
