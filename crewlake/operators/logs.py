"""Conversation, usage and job logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlake.functions.ordered import latest, neighbour
from crewlake.functions.phrases import any_of, relative_range
from crewlake.functions.scalars import AsOf, day, text

# --- fixed values ---------------------------------------------------------------------------
CORRECTIONS = ["wrong", "incorrect", "not what i", "i meant", "that's not", "no,", "不对", "不是这个", "我是说", "错了"]
ERROR_STARTS = ["Tool error", "LLM error", "Internal routing error"]
DATE_ARGUMENTS = ["date_from", "date_to", "month", "period", "days"]
CATEGORIES = ["semantic_gap", "time_parse_error", "entity_resolution_error", "tool_routing_error",
              "business_definition_gap", "data_quality_issue", "answer_quality_issue"]
EXECUTED_RESULTS = ["resolved", "failed", "partial"]
OPEN_STATES = ["rejected", "approved", "pending_approval", "manual", "snoozed", "risk_accepted"]
NUDGE_DAYS = 3
# ----------------------------------------------------------------------------------------------


def merge_feedback(traces: DataFrame, feedback: DataFrame) -> DataFrame:
    """L1: traces with the last feedback given on each."""
    last = latest(feedback.select("trace_id", "user_feedback", "correction_flag", "ts"), ["trace_id"], ["ts"]).drop("ts")
    return traces.join(last, "trace_id", "left").withColumn(
        "correction_flag", F.coalesce("correction_flag", F.lit(False)))


def conversations(traces: DataFrame, limit: int | None = None, exclude_test: bool = True, user: str | None = None) -> DataFrame:
    """L2: conversations, newest first, with their first question as title."""
    rows = traces.filter("conversation_id IS NOT NULL")
    if exclude_test:
        rows = rows.filter(~F.lower(F.col("conversation_id").cast("string")).contains("test"))
    if user:
        rows = rows.filter(F.col("user") == user)
    out = rows.groupBy("conversation_id").agg(
        F.min_by("question", F.struct("ts", "turn")).alias("title"),
        F.count("*").alias("turns"), F.max("ts").alias("last_ts")).orderBy(
        F.desc("last_ts"), F.desc("conversation_id"))
    return out if limit is None else out.limit(int(limit))


def conversation_turns(traces: DataFrame, conversation_id=None) -> DataFrame:
    """L3: turns in order, ready to resume or replay.

    Rows come sorted over the cluster instead of packed into one list per conversation, so
    the length of a conversation does not matter.
    """
    rows = traces if conversation_id is None else traces.filter(F.col("conversation_id") == conversation_id)
    mark = F.when(F.col("correction_flag"), "down").when(F.col("user_feedback").isNotNull(), "up")
    return rows.select("conversation_id", F.coalesce("turn", F.lit(0)).alias("turn"), "ts", "question", "answer",
                       F.concat_ws(".", "tool", "function").alias("step"), mark.alias("feedback")).orderBy(
        "conversation_id", "turn", "ts")


def bug_category(as_of: AsOf) -> Column:
    """L4: the first rule that makes a trace worth a look; NULL for a healthy one.

    Works on correction_flag, needs_clarification, answer, validator_errors (count),
    question, args (JSON text), engine, entity, resolved_terms, selected_tool, result_rows,
    confidence.
    """
    timed = relative_range("question", as_of, relative_only=True)["phrase"].isNotNull()
    args, terms = F.coalesce("args", F.lit("")), F.coalesce("resolved_terms", F.lit(""))
    dated = any_of(args, DATE_ARGUMENTS)
    fixed = F.col("engine") == "deterministic"
    entity = F.lower("entity")
    unused = F.col("entity").isNotNull() & fixed & ~F.lower(args).contains(entity) & ~F.lower(terms).contains(entity)
    failed = reduce(lambda a, b: a | b, [F.col("answer").startswith(s) for s in ERROR_STARTS])
    routed = F.coalesce("selected_tool", F.lit("")) != ""
    rules = [
        (F.col("correction_flag"), "tool_routing_error"),
        (F.col("needs_clarification"), "semantic_gap"),
        (failed | (F.col("validator_errors") > 0), "answer_quality_issue"),
        (timed & ~dated, "time_parse_error"),
        (unused, "entity_resolution_error"),
        ((F.coalesce("result_rows", F.lit(0)) == 0) & routed, "data_quality_issue"),
        (F.col("confidence") == "Low", "answer_quality_issue"),
        (fixed & (terms == "") & ~routed, "business_definition_gap"),
    ]
    case = None
    for hit, label in rules:
        case = F.when(hit, label) if case is None else case.when(hit, label)
    return case


def bug_inbox(traces: DataFrame, as_of: AsOf) -> DataFrame:
    """L4: flagged traces with their category."""
    return traces.withColumn("category", bug_category(as_of)).filter("category IS NOT NULL")


def bug_counts(inbox: DataFrame) -> DataFrame:
    """L4: traces per category and one line for all of them."""
    return inbox.rollup("category").agg(F.count("*").alias("traces")).withColumn(
        "category", F.coalesce("category", F.lit("(all)")))


def usage_report(calls: DataFrame, last_n: int | None = 100) -> DataFrame:
    """Success, empty, follow-up, correction and confidence rates per function over the newest calls."""
    window = calls if last_n is None else calls.orderBy(F.desc("ts"), F.desc("call_id")).limit(int(last_n))
    key = F.when(F.col("tool").isNotNull(), F.concat_ws(".", "tool", "function")).otherwise("(clarification)")

    def rate(c: Column, name: str) -> Column:
        return F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 2).alias(name)

    return window.groupBy(key.alias("tool_function")).agg(
        F.count("*").alias("uses"), rate(F.col("ok"), "success_rate"),
        rate(F.col("ok") & (F.col("row_count") == 0), "zero_row_rate"), rate(F.col("followed_up"), "followup_rate"),
        rate(F.col("corrected"), "correction_rate"), rate(F.col("confidence") == "High", "high_confidence_rate")).orderBy(
        F.desc("uses"), "tool_function")


def retro_signals(calls: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """What the next question says about a call: a correction, or a follow-up with the same tool."""
    near = neighbour(calls, keys, order, bucket, ["question", "tool"], after=True, into="next")
    corrected = F.coalesce(any_of(F.lower("next.question"), CORRECTIONS), F.lit(False))
    again = F.coalesce(F.col("next.tool") == F.col("tool"), F.lit(False))
    return near.withColumn("corrected", corrected).withColumn("followed_up", ~corrected & again).drop("next")


def action_status(events: DataFrame) -> DataFrame:
    """Repair state per issue from its event history; only trial runs so far means previewed."""
    state = (F.when((F.col("status") == "executed") & F.col("result").isin(EXECUTED_RESULTS), F.col("result"))
             .when((F.col("status") == "executed") | F.col("status").isin(OPEN_STATES), F.col("status")))
    when = F.when(state.isNotNull(), F.struct("ts", "event_id"))
    return events.groupBy("issue_id").agg(F.coalesce(F.max_by(state, when), F.lit("previewed")).alias("status"),
                                          F.count("*").alias("events"))


def failure_streaks(runs: DataFrame) -> DataFrame:
    """Failures per job since its last run that did not fail.

    Equivalent to the newest island of failures, but found by two aggregations and a join
    with one row per job instead of a window over each job's history.
    """
    failed = F.col("status") == "Failed"
    # of runs that began together the one with the highest id counts as the last
    last = F.struct(*[c for c in ("started", "run_id", "status") if c in runs.columns])
    per_job = runs.groupBy("job").agg(F.max(F.when(~failed, F.col("started"))).alias("last_good"),
                                      F.max_by("status", last).alias("latest_status"), F.count("*").alias("runs"))
    after = (runs.filter(failed).select("job", "started").join(per_job.select("job", "last_good"), "job")
             .filter(F.col("last_good").isNull() | (F.col("started") > F.col("last_good")))
             .groupBy("job").agg(F.count("*").alias("streak")))
    return per_job.join(after, "job", "left").select("job", "runs", "latest_status",
                                                     F.coalesce("streak", F.lit(0)).cast("bigint").alias("streak"))


def expected_vs_actual(cases: DataFrame, logged: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per field in which a logged routing differs from its expected case."""
    want = cases.select(key, *[F.col(f).cast("string").alias(f"want_{f}") for f in fields])
    got = logged.select(key, *[F.col(f).cast("string").alias(f"got_{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"want_{f}").alias("expected"), F.col(f"got_{f}").alias("actual"))
                      for f in fields])
    rows = want.join(got, key, "left").select(key, F.inline(pairs))
    return rows.filter(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("actual")))


def nudges(items: DataFrame, log: DataFrame, as_of: AsOf, days: int = NUDGE_DAYS) -> DataFrame:
    """Creators of new items without a status who were not reminded lately and can be reached."""
    edge = F.date_sub(day(as_of), int(days)).cast("timestamp_ntz")
    recent = log.filter(F.col("ts") > edge).select("key").distinct()
    blank = items.filter(text("status").isNull() & (F.col("created") >= edge) & F.col("email").isNotNull())
    return blank.withColumn("key", F.concat_ws(":", "table", "item_id")).join(recent, "key", "left_anti").select(
        "key", "table", "item_id", "title", "creator", "email")


def user_focus(questions: DataFrame) -> DataFrame:
    """How often each user asks about each domain."""
    domain = F.lower(F.trim(F.substring_index(F.coalesce("domain", F.lit("")), "/", 1)))
    return questions.filter("domain IS NOT NULL").groupBy("user", F.when(domain == "", "other").otherwise(domain).alias("focus")).agg(
        F.count("*").alias("questions"))


def recent_questions(questions: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` questions of each user."""
    w = Window.partitionBy("user").orderBy(F.desc("ts"), F.desc("question_id"))
    return questions.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= int(keep)).select("user", "n", "question")
