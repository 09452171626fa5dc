"""Hiring snapshots: history, aggregation over boards, and what a sequence of listing pages shows.

is_hiring is true or null: not finding a job proves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import filled
from gleanery.operators.dedup import first_wins

SUCCESS = ("hiring", "no_public_jobs_found")


def with_history(rows: DataFrame, keys: list[str], order: list[str], status: Column, success: Column, value: Column) -> DataFrame:
    """Each row with the status before it and the last value that came with a success before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"previous_status": F.lag(status).over(w), "last_success": F.last(F.when(success, value), ignorenulls=True).over(before)})


def refusal_latch(requests: DataFrame, keys: list[str], order: str, refused: Column) -> DataFrame:
    """Requests with stopped: whether one before them was refused."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("stopped", F.coalesce(F.max(refused).over(before), F.lit(False)))


def merged_boards(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Per slug and board: the snapshot that counts now, and the last successful one that it doesn't show.

    Both sides have slug, board, status, is_hiring, jobs, checked_at, stop_reason; one row a board.
    """
    p, c = previous.alias("p"), current.alias("c")
    fields = ["status", "is_hiring", "jobs", "checked_at", "stop_reason"]
    fresh = F.col("c.slug").isNotNull()
    old = F.col("p.status").isin(*SUCCESS) & (~fresh | (F.col("c.status") == "unknown"))
    history = F.when(F.coalesce(old, F.lit(False)), F.struct(*[F.col(f"p.{x}").alias(x) for x in fields]))
    if "history" in previous.columns:
        history = F.coalesce(history, F.col("p.history"))
    joined = p.join(c, (F.col("p.slug") == F.col("c.slug")) & (F.col("p.board") == F.col("c.board")), "full_outer")
    out = [F.when(fresh, F.col(f"c.{x}")).otherwise(F.col(f"p.{x}")).alias(x) for x in fields]
    return joined.select(F.coalesce("c.slug", "p.slug").alias("slug"), F.coalesce("c.board", "p.board").alias("board"), fresh.alias("checked"), *out, history.alias("history"))


def carried_details(jobs: DataFrame, previous: DataFrame) -> DataFrame:
    """Jobs (slug, board, job_id, description, ...) with the last description known where they have none now."""
    old = previous.select("slug", "board", "job_id", F.coalesce(filled("description"), F.col("last_successful_description") if "last_successful_description" in previous.columns else F.lit(None).cast("string")).alias("_old")).where("_old is not null")
    old = old.dropDuplicates(["slug", "board", "job_id"])
    return jobs.join(old, ["slug", "board", "job_id"], "left").withColumn("last_successful_description", F.when(filled("description").isNull(), F.col("_old"))).drop("_old")


def unique_jobs(jobs: DataFrame, ord_: str = "ord") -> DataFrame:
    """One row for each board and job; the same job on two boards stays two."""
    key = F.coalesce(filled("job_id"), filled("url"))
    return first_wins(jobs, ["slug", "board", key], [ord_]).withColumn("source_job_key", F.concat("board", F.lit(":"), key))


def aggregated(boards: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per slug the state over the boards checked now."""
    checked = boards.where("checked")
    counts = jobs.groupBy("slug").agg(F.count("*").alias("observed_job_count"))
    state = checked.groupBy("slug").agg(
        F.max("is_hiring").alias("is_hiring"),
        F.every(F.col("status") == "no_public_jobs_found").alias("_none"),
        F.array_sort(F.collect_set("board")).alias("checked_sources"),
        F.concat_ws("; ", F.array_sort(F.collect_list(F.concat("board", F.lit(":"), F.coalesce("stop_reason", F.lit("unknown")))))).alias("stop_reason"),
    )
    yes = F.col("is_hiring") == F.lit(True)
    status = F.when(yes, "hiring").when(F.col("_none"), "no_public_jobs_found").otherwise("unknown")
    return state.join(counts, "slug", "left").select("slug", status.alias("status"), F.when(yes, True).alias("is_hiring"), F.coalesce("observed_job_count", F.lit(0)).alias("observed_job_count"), "checked_sources", "stop_reason")


def listing_walk(pages: DataFrame, most_jobs: int = 50, most_pages: int = 3) -> DataFrame:
    """Per slug and board, from landed listing pages (seq, status, jobs, next_url): the jobs seen first, and why the walk ends.

    A page counts until the first that failed or repeats only known jobs; then caps apply.
    """
    w = Window.partitionBy("slug", "board").orderBy("seq")
    bad = F.col("status") != "ok"
    upto = pages.withColumn("_bad", F.sum(bad.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))).where("coalesce(_bad, 0) = 0")
    upto = upto.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most_pages)
    seen = upto.where("status = 'ok'").select("slug", "board", "seq", F.posexplode("jobs").alias("pos", "job"))
    firsts = first_wins(seen.withColumn("job_id", F.col("job.job_id")), ["slug", "board", "job_id"], ["seq", "pos"])
    capped = firsts.withColumn("_k", F.row_number().over(Window.partitionBy("slug", "board").orderBy("seq", "pos"))).where(F.col("_k") <= most_jobs)
    jobs = capped.groupBy("slug", "board").agg(F.array_sort(F.collect_list(F.struct("_k", "job"))).alias("_j")).select("slug", "board", F.transform("_j", lambda x: x["job"]).alias("jobs"))
    last = upto.groupBy("slug", "board").agg(F.max_by(F.struct("status", "next_url", "_n"), "seq").alias("l"))
    out = last.join(jobs, ["slug", "board"], "left")
    n = F.coalesce(F.size("jobs"), F.lit(0))
    reason = F.when(F.col("l.status") != "ok", F.col("l.status")).when(n >= most_jobs, "max_jobs").when(filled("l.next_url").isNull(), "exhausted").when(F.col("l._n") >= most_pages, "max_pages").otherwise("exhausted")
    status = F.when(n > 0, "hiring").when(F.col("l.status") == "ok", "no_public_jobs_found").otherwise("unknown")
    return out.select("slug", "board", F.coalesce("jobs", F.array()).alias("jobs"), n.alias("observed_job_count"), status.alias("status"), F.when(n > 0, True).alias("is_hiring"), reason.alias("stop_reason"))


def unknown_hiring(reason: Column) -> Column:
    """The typed "we can't tell"."""
    return F.struct(F.lit("unknown").alias("status"), F.lit(None).cast("boolean").alias("is_hiring"), F.lit(0).alias("observed_job_count"), reason.alias("stop_reason"))


def detail_attempts(attempts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per job the outcome of several attempts: the first with a description, else the last; parts known before stay."""
    w = F.struct(F.when(filled("description").isNotNull(), 1).otherwise(0), F.when(filled("description").isNotNull(), -F.col(order)).otherwise(F.col(order)))
    rest = [c for c in attempts.columns if c not in {*keys, order}]
    best = F.max_by(F.struct(*rest), w).alias("b")
    some = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in rest]
    return attempts.groupBy(*keys).agg(best, *some, F.count("*").alias("attempts")).select(*keys, *[F.coalesce(F.col(f"b.{c}"), F.col(f"_{c}")).alias(c) for c in rest], "attempts")
