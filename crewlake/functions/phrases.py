"""Time phrases and intents in short texts (E15-E17), as ordered CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crewlake.functions.scalars import AsOf, as_col, day

# --- fixed values: phrases recognised in questions ----------------------------
LAST_WEEK = ["last week", "上个礼拜", "上礼拜", "上周", "上星期", "上個禮拜", "上週"]
THIS_WEEK = ["this week", "这周", "本周", "这个礼拜", "这星期", "本週"]
NEXT_WEEK = ["next week", "下周", "下个礼拜", "下星期", "下週"]
YESTERDAY = ["yesterday", "昨天"]
TOMORROW = ["tomorrow", "明天"]
TODAY = ["today", "今天", "今日"]
LAST_MONTH = ["last month", "上个月", "上月"]
THIS_MONTH = ["this month", "这个月", "本月"]
ROSTER_WORDS = ["roster", "rostered", "schedule", "排班", "时间表", "班表", "上班安排"]
TIMESHEET_WORDS = ["timesheet", "工时表", "考勤", "实际工时"]
TOPIC_WORDS = [
    ("Shutdown", ["shutdown", "turnaround", "检修", "停产", "大修"]),
    ("Compliance", ["compliant", "compliance", "certificate", "cert", "ticket", "expir",
                    "证", "合规", "过期", "到期"]),
    ("Billing", ["invoice", "bill", "receivable", "overdue", "xero", "revenue",
                 "发票", "工时", "billing", "应收"]),
    ("Data Health", ["stale", "sync", "data quality", "freshness", "broken", "missing file",
                     "数据", "新鲜", "坏了", "陈旧"]),
    ("Workforce", ["available", "bench", "idle", "deploy", "roster", "who can",
                   "可以派", "板凳", "排班", "能去", "可派"]),
    ("Project", ["project", "job", "status", "项目", "进度"]),
    ("Document", ["document", "folder", "file", "文件", "文档"]),
]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august",
               "september", "october", "november", "december"]
EXPLICIT_RANGE = r"\b(20\d\d-\d\d-\d\d)\s*(?:to|至|到|-|~)\s*(20\d\d-\d\d-\d\d)\b"
EXPLICIT_MONTH = r"\b(20\d\d)-(\d\d)\b"
EXPLICIT_YEAR = r"\b(20\d\d)\b"
# -------------------------------------------------------------------------------

NAMED_MONTH = r"(?i)in (" + "|".join(MONTH_NAMES) + r")\s+(20\d\d)"


def any_of(lowered: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def first_topic(lowered: Column, topics: list[tuple[str, list[str]]], otherwise) -> Column:
    """Label of the first word list that has a hit."""
    out = None
    for label, words in topics:
        hit = any_of(lowered, words)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def schedule_intent(c: Column | str) -> Column:
    """``timesheet`` is tested before ``roster``; NULL when neither is meant."""
    q = F.lower(as_col(c))
    return first_topic(q, [("timesheet", TIMESHEET_WORDS), ("roster", ROSTER_WORDS)], None)


def topic_intent(c: Column | str, domain: Column | str | None = None) -> Column:
    """Business topic of a question, falling back to the routed domain."""
    topic = first_topic(F.lower(as_col(c)), TOPIC_WORDS, None)
    if domain is None:
        return F.coalesce(topic, F.lit("General"))
    d = F.lower(as_col(domain))
    fallback = (
        F.when(d.contains("complian") | d.contains("cert"), F.lit("Compliance"))
        .when(d.contains("finance") | d.contains("invoice"), F.lit("Billing"))
        .otherwise(F.lit("General"))
    )
    return F.coalesce(topic, fallback)


def _monday(as_of: AsOf, weeks: int) -> Column:
    return F.date_add(F.trunc(day(as_of), "week"), 7 * weeks)


def relative_windows(as_of: AsOf) -> list[tuple[str, list[str], Column, Column]]:
    """(label, phrases, first day, last day) in the order they are tried."""
    today = day(as_of)

    def week(n: int) -> tuple[Column, Column]:
        return _monday(as_of, n), F.date_add(_monday(as_of, n), 6)

    return [
        ("last_week", LAST_WEEK, *week(-1)),
        ("this_week", THIS_WEEK, *week(0)),
        ("next_week", NEXT_WEEK, *week(1)),
        ("yesterday", YESTERDAY, F.date_sub(today, 1), F.date_sub(today, 1)),
        ("tomorrow", TOMORROW, F.date_add(today, 1), F.date_add(today, 1)),
        ("today", TODAY, today, today),
    ]


def _months(as_of: AsOf) -> list[tuple[str, list[str], Column]]:
    return [
        ("last_month", LAST_MONTH, F.date_format(F.add_months(day(as_of), -1), "yyyy-MM")),
        ("this_month", THIS_MONTH, F.date_format(day(as_of), "yyyy-MM")),
    ]


def relative_range(c: Column | str, as_of: AsOf, relative_only: bool = False) -> Column:
    """struct<phrase, date_from, date_to, month, period, year>; the first rule that hits fills it.

    ``phrase`` is the rule's label; NULL means the text names no time.
    """
    raw = as_col(c)
    q = F.lower(raw)
    none = F.lit(None).cast("string")

    def out(phrase, date_from=none, date_to=none, month=none, period=none, year=none) -> Column:
        return F.struct(
            (F.lit(phrase) if isinstance(phrase, str) else phrase).alias("phrase"),
            date_from.cast("string").alias("date_from"),
            date_to.cast("string").alias("date_to"),
            month.alias("month"),
            period.alias("period"),
            year.alias("year"),
        )

    rules: list[tuple[Column, Column]] = []
    for label, words, start, end in relative_windows(as_of):
        rules.append((any_of(q, words), out(label, start, end)))
    for label, words, value in _months(as_of):
        rules.append((any_of(q, words), out(label, month=value)))
    if not relative_only:
        number = F.array_position(F.array(*map(F.lit, MONTH_NAMES)), F.lower(F.regexp_extract(raw, NAMED_MONTH, 1)))
        rules += [
            (raw.rlike(EXPLICIT_RANGE),
             out("range", F.regexp_extract(raw, EXPLICIT_RANGE, 1), F.regexp_extract(raw, EXPLICIT_RANGE, 2))),
            (raw.rlike(NAMED_MONTH),
             out("period", period=F.concat(F.regexp_extract(raw, NAMED_MONTH, 2), F.lit("-"),
                                           F.lpad(number.cast("string"), 2, "0")))),
            (raw.rlike(EXPLICIT_MONTH), out("month", month=F.regexp_extract(raw, EXPLICIT_MONTH, 0))),
            (raw.rlike(EXPLICIT_YEAR), out("year", year=F.regexp_extract(raw, EXPLICIT_YEAR, 1))),
        ]
    case = None
    for hit, value in rules:
        case = F.when(hit, value) if case is None else case.when(hit, value)
    return case.otherwise(out(none))


def range_label(date_from: Column | str, date_to: Column | str, month: Column | str, as_of: AsOf) -> Column:
    """The relative name of a range, NULL when it has none."""
    a, b, m = as_col(date_from).cast("date"), as_col(date_to).cast("date"), as_col(month)
    case = None
    # a one-day range that is also a week boundary never collides: weeks span seven days
    for label, _, start, end in relative_windows(as_of):
        hit = (a == start) & (b == end)
        case = F.when(hit, F.lit(label)) if case is None else case.when(hit, F.lit(label))
    for label, _, value in _months(as_of):
        case = case.when(m == value, F.lit(label))
    return case
