"""Batches, runs and their items: deduplication, eligibility, transitions, roll-ups, upserts and resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BACKOFF_SECONDS = (2, 4, 8)
MAX_ATTEMPTS = 3
STALE_SECONDS = 1800
# What marks an error as temporary.
RETRYABLE = (
    "timeout|timed out|connecterror|connect error|connection refused|winerror 10013|连接|connection|temporarily|rate limit|too many requests|"
    "http 429|http 500|http 502|http 503|http 504|operationalerror|server error"
)


def create_batch(files: DataFrame, done: DataFrame, path: str = "path", digest: str = "file_hash", done_id: str = "file_id") -> DataFrame:
    """Items of a batch: pending, or skipped with the done file to reuse or the first item of the same content.

    ``done`` has the digest and the id of files that were processed before.
    """
    before = done.groupBy(digest).agg(F.min(done_id).alias("reuse_file_id"))
    w = Window.partitionBy(digest).orderBy(F.lower(F.col(path)), path)
    items = files.join(before, digest, "left").withColumn("__first", F.first(path).over(w))
    items = items.withColumn("duplicate_of", F.when(F.col("reuse_file_id").isNull() & (F.col("__first") != F.col(path)), F.col("__first")))
    return items.withColumn("status", F.when(F.col("reuse_file_id").isNotNull() | F.col("duplicate_of").isNotNull(), "skipped").otherwise("pending")).drop("__first")


def eligible(now: Column, resume: bool = False, max_attempts: int = MAX_ATTEMPTS, stale: int = STALE_SECONDS) -> Column:
    """Whether an item may be taken: pending, due for retry, running without a heartbeat, or failed once more allowed."""
    status = F.col("status")
    due = (status == "retry_wait") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    lost = (status == "running") & (F.col("heartbeat_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at") > stale))
    again = (status == "failed") & (F.col("error_kind") == "transient") & (F.col("attempt_count") < max_attempts) if resume else F.lit(False)
    return F.coalesce((status == "pending") | due | lost | again, F.lit(False))


def after_attempt(items: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Items after an attempt with the outcome columns ok and error: succeeded, waiting for a retry, or failed."""
    n = F.coalesce("attempt_count", F.lit(0)) + 1
    transient = F.coalesce(F.lower("error").rlike(RETRYABLE), F.lit(False))
    retry = ~F.col("ok") & transient & (n < max_attempts)
    wait = F.element_at(F.array(*[F.lit(s) for s in BACKOFF_SECONDS]), F.least(n, F.lit(len(BACKOFF_SECONDS))).cast("int"))
    return items.select(
        "*", F.when(F.col("ok"), "succeeded").when(retry, "retry_wait").otherwise("failed").alias("new_status"), n.alias("new_attempt_count"),
        F.when(~F.col("ok"), F.when(transient, "transient").otherwise("permanent")).alias("new_error_kind"), F.when(retry, F.timestamp_seconds(F.unix_timestamp(now) + wait)).alias("new_retry_at"),
    )


def batch_summary(items: DataFrame, batch: str = "batch_id", status: str = "status", kind: str = "error_kind") -> DataFrame:
    """Four counts and the status of each batch: by its failures once all items ended, else running, pending or waiting."""
    s, k = F.col(status), F.coalesce(F.col(kind), F.lit(""))
    g = items.groupBy(batch).agg(
        F.count_if(s == "succeeded").alias("succeeded_count"), F.count_if(s == "skipped").alias("skipped_count"), F.count_if((s == "retry_wait") | ((s == "failed") & (k == "transient"))).alias("retryable_failed_count"),
        F.count_if((s == "failed") & (k == "permanent")).alias("permanent_failed_count"), F.bool_and(s.isin("succeeded", "skipped", "failed")).alias("__ended"), F.bool_or(s == "failed").alias("__failed"),
        F.bool_or(s == "running").alias("__running"), F.bool_or(s == "pending").alias("__pending"), F.bool_or(s == "retry_wait").alias("__waiting"),
    )
    ended = F.when(~F.col("__failed"), "succeeded").when(F.col("succeeded_count") + F.col("skipped_count") > 0, "partial_failed").otherwise("failed")
    state = F.when(F.col("__ended"), ended).when(F.col("__running"), "running").when(F.col("__pending"), "pending").when(F.col("__waiting"), "retry_wait").otherwise("pending")
    return g.withColumn("status", state).drop("__ended", "__failed", "__running", "__pending", "__waiting")


def run_summary(items: DataFrame, run: str = "run_id", status: str = "status") -> DataFrame:
    """Counts and status of runs: running while anything is unfinished, else by failures."""
    s = F.col(status)
    g = items.groupBy(run).agg(F.count("*").alias("total"), F.count_if(s == "succeeded").alias("succeeded"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "needs_review").alias("needs_review"))
    done = F.col("succeeded") + F.col("failed") + F.col("needs_review") == F.col("total")
    return g.withColumn("status", F.when(~done, "running").when(F.col("failed") > 0, "partial_failed").otherwise("succeeded"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old and new rows with the latest version of each key; among equal versions the new row wins.

    One shuffle on the keys; max_by keeps it an aggregation that combines before the shuffle.
    """
    names = old.columns
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*names).withColumn("__new", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(version, "__new")).alias("r"))
    return last.select("r.*")


def upsert_guarded(old: DataFrame, new: DataFrame, key: str, status: str = "review_status", free: str = "pending") -> DataFrame:
    """Upsert that leaves rows alone once they were reviewed."""
    n = new.select(F.col(key), F.struct(*new.columns).alias("__n"))
    o = old.select(F.col(key), F.struct(*old.columns).alias("__o"))
    row = F.when(F.col("__o").isNull() | (F.col("__n").isNotNull() & (F.col(f"__o.{status}") == free)), F.col("__n")).otherwise(F.col("__o"))
    return o.join(n, key, "full").select(row.alias("r")).select("r.*")


def update_where(df: DataFrame, values: dict[str, Column], where: Column) -> DataFrame:
    """Copy-on-write update: the rows that meet ``where`` get the values, all others stay."""
    return df.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def replace_machine_rows(old: DataFrame, new: DataFrame, human: tuple[str, ...], status: str = "status") -> DataFrame:
    """Rows that people decided stay, all others give way to the new ones."""
    return old.filter(F.col(status).isin(*human)).unionByName(new)


def make_current(runs: DataFrame, run: str, run_id: Column, batch: str = "batch_id") -> DataFrame:
    """Exactly one current run in the batch of ``run_id``."""
    mine = F.max(F.when(F.col(run) == run_id, True)).over(Window.partitionBy(batch))
    return runs.withColumn("is_current", F.when(mine, F.col(run) == run_id).otherwise(F.col("is_current")))


def reset(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table, with the name of its key column, without the rows whose key is in ``gone``."""
    ids = gone.select(F.col(key).alias("__gone")).distinct()
    return {n: t.join(ids, t[c] == F.col("__gone"), "left_anti") for n, (t, c) in tables.items()}


def empty_runs(runs: DataFrame, items: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs without an item, which a reset removes."""
    return runs.join(items.select(run).distinct(), run, "left_anti")


def folder_plan(selected: DataFrame, batches: DataFrame, now: Column, file: str = "file_id", batch: str = "batch_id", stale: int = STALE_SECONDS) -> DataFrame:
    """file_id and plan of the selected files: busy (recent work), stale (old work), shared (other batches too) or free.

    ``batches`` has file_id, batch_id, status and heartbeat_at of all items; ``selected`` has file_id and batch_id.
    """
    mine = selected.select(F.col(file), F.col(batch).alias("__mine"))
    old = F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at") > stale
    g = mine.join(batches, file, "left").groupBy(file).agg(
        F.bool_or((F.col("status") == "running") & ~old).alias("busy"), F.bool_or((F.col("status") == "running") & old).alias("stale"), F.bool_or(F.col(batch) != F.col("__mine")).alias("shared"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return g.select(file, F.when(yes("busy"), "busy").when(yes("stale"), "stale").when(yes("shared"), "shared").otherwise("free").alias("plan"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def progress(items: DataFrame, run: str, finished: Column, started_at: Column, ended_at: Column) -> DataFrame:
    """run, done, total, average_seconds and remaining_seconds of runs.

    The average is over the items that are done: from the run's first start to its last end, by their number.
    """
    seconds = lambda c: F.unix_timestamp(c).cast("double")
    g = items.groupBy(run).agg(F.count_if(finished).alias("done"), F.count("*").alias("total"), F.min(seconds(started_at)).alias("first"), F.max(F.when(finished, seconds(ended_at))).alias("last"))
    average = F.coalesce((F.col("last") - F.col("first")) / F.greatest("done", F.lit(1)), F.lit(0.0))
    g = g.withColumn("average_seconds", average)
    return g.select(run, "done", "total", F.round("average_seconds", 1).alias("average_seconds"), F.bround((F.col("total") - F.col("done")) * F.col("average_seconds"), 0).cast("long").alias("remaining_seconds"))
