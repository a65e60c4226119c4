"""Events of runs: state of each task, pairs of calls, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(at: str) -> Column:
    """Microseconds of a time column, with or without a time zone."""
    return F.unix_micros(F.col(at).cast("timestamp"))


def latest_state(events: DataFrame, keys: list[str], seq: str, cols: list[str]) -> DataFrame:
    """The last known values of each key by `seq`, not by arrival, and the number of events."""
    last = F.max_by(F.struct(*cols), F.col(seq)).alias("s")
    return events.groupBy(*keys).agg(last, F.count("*").alias("n_events")).select(*keys, "n_events", *[f"s.{c}" for c in cols])


def rollup(events: DataFrame, key: str, status: str, value: str) -> DataFrame:
    """Events, distinct statuses, totals of a run; final figures may override them."""
    return events.groupBy(key).agg(F.count("*").alias("n_events"), F.countDistinct(status).alias("n_statuses"), F.sum(value).alias("total"), F.max(value).alias("largest"))


def call_pairs(events: DataFrame, keys: list[str], at: str, status: str, opens: str, closes: list[str]) -> DataFrame:
    """Each opening event with the next closing one of its keys, and the seconds between."""
    w = Window.partitionBy(*keys).orderBy(at, "event_id")
    nxt = events.filter(F.col(status).isin(opens, *closes)).withColumn("end_at", F.lead(at).over(w)).withColumn("end_status", F.lead(status).over(w))
    return nxt.filter((F.col(status) == opens) & F.col("end_status").isin(*closes)).withColumn("seconds", (micros("end_at") - micros(at)) / 1e6)


# What tells an error's class, by precedence.
ERRORS = [("billing", r"(?i)\b402\b|insufficient balance|payment required|billing"), ("key", r"(?i)\b401\b|authentication fails|invalid api key|unauthorized"), ("rate", r"(?i)\b429\b|rate limit|too many requests|quota")]


# A status code at the beginning of a message, and the codes that tell a class.
LEADING_CODE, CODES = r"(?i)^\W*(?:(?:https?|error|status|code)\W+)*[1-5]\d\d\b", r"\b(?:401|402|429)\b"


def error_class(message: Column) -> Column:
    """Whether the balance, the key or the rate was refused, or something else went wrong.

    In a message that begins with its status code, later numbers are no codes (but ids and the like).
    """
    lead = F.regexp_extract(message, LEADING_CODE, 0)
    x = F.when(lead != "", F.concat(lead, F.regexp_replace(F.substring(message, F.length(lead) + 1, F.length(message)), CODES, ""))).otherwise(message)
    return F.coalesce(*[F.when(x.rlike(p), kind) for kind, p in ERRORS], F.lit("other"))


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """Runs of events of a key with no longer gap (an extra, over Spark's own windows)."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    new = F.coalesce(micros(at) - F.lag(micros(at)).over(w) > gap_seconds * 1_000_000, F.lit(True)).cast("int")
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("n_events"), F.min(at).alias("start_at"), F.max(at).alias("end_at"))


# ------------------------------------------------------------------ runs as they go


def task_progress(events: DataFrame, run: str = "run_id") -> DataFrame:
    """run, task_id, status, attempts, retries, memory_hits of events (run, seq, task, react, memory): the last of each, and most rounds of reflection.

    task: struct<id, status, attempts>; react: struct<taskId, round, phase>; memory: struct<taskId, recalledItems>.
    """
    e = events.withColumn("task_id", F.coalesce("task.id", "react.taskId", "memory.taskId")).filter("task_id is not null")
    last = lambda c, when: F.max_by(F.when(when, c), F.when(when, F.col("seq")))
    reflected = F.when(F.col("react.phase") == "reflection", F.greatest(F.lit(1), F.coalesce("react.round", F.lit(1))))
    return e.groupBy(run, "task_id").agg(
        F.coalesce(last(F.col("task.status"), F.col("task.status").isNotNull()), F.lit("pending")).alias("status"),
        F.coalesce(last(F.col("task.attempts"), F.col("task.attempts").isNotNull()), F.lit(0)).alias("attempts"),
        F.coalesce(F.max(reflected), F.lit(0)).alias("retries"),
        F.coalesce(last(F.col("memory.recalledItems"), F.col("memory.taskId").isNotNull()), F.lit(0)).alias("memory_hits"),
    )


def tool_progress(events: DataFrame, run: str = "run_id") -> DataFrame:
    """run, call_id, name, status, started_at, duration_ms, tokens, estimated of each call, whose events share its id.

    tool: struct<callId, name, status, durationMs, totalTokens, tokenEstimate>; what a later event doesn't say, an earlier one does.
    """
    e = events.filter("tool.callId is not null").select(run, "seq", "at_ms", "tool.*")
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq")))
    at = lambda done: F.min(F.when((F.col("status") == "running") != F.lit(done), F.col("at_ms")))
    made = e.groupBy(run, F.col("callId").alias("call_id")).agg(last("name").alias("name"), last("status").alias("status"), at(False).alias("started_at"), F.greatest(F.lit(0), F.coalesce(last("durationMs"), at(True) - at(False), F.lit(0))).alias("duration_ms"), F.coalesce(last("totalTokens"), F.lit(0)).alias("tokens"), F.coalesce(last("tokenEstimate"), F.lit(False)).alias("estimated"))
    return made


def run_summary(events: DataFrame, finals: DataFrame | None = None, run: str = "run_id") -> DataFrame:
    """One row a run: its stage, tasks by status, retries, memory hits, calls, tokens and time; final figures override what was seen.

    finals: (run, retries, tool_calls, total_tokens, token_estimate, duration_ms, cost), any of them null.
    """
    count = lambda cond: F.count(F.when(cond, 1))
    runs = events.groupBy(run).agg(F.max_by("stage", F.when(F.col("stage").isNotNull(), F.col("seq"))).alias("stage"), F.coalesce(F.max("at_ms"), F.lit(0)).alias("_elapsed"))
    t = task_progress(events, run).groupBy(run).agg(count(F.col("status") == "completed").alias("completed"), count(F.col("status").isin("failed", "insufficient")).alias("failed"), F.count("*").alias("tasks"), F.sum(F.greatest("retries", F.col("attempts") - 1)).alias("_retries"), F.sum("memory_hits").alias("memory_hits"))
    done = F.col("status") != "running"
    u = tool_progress(events, run).groupBy(run).agg(count(done).alias("_calls"), F.sum(F.when(done, F.col("tokens")).otherwise(0)).alias("_tokens"), F.bool_or(done & F.col("estimated")).alias("_estimated"))
    both = runs.join(t, run, "left").join(u, run, "left").fillna(0, ["completed", "failed", "tasks", "_retries", "memory_hits", "_calls", "_tokens"]).fillna(False, ["_estimated"])
    given = {"retries": "_retries", "tool_calls": "_calls", "total_tokens": "_tokens", "token_estimate": "_estimated", "duration_ms": "_elapsed"}
    if finals is None:
        return both.withColumnsRenamed({v: k for k, v in given.items()}).withColumn("cost", F.lit(None).cast("double"))
    both = both.join(finals, run, "left")
    return both.withColumns({k: F.coalesce(k, v) for k, v in given.items()}).drop(*given.values())
