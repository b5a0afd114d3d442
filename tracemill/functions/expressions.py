"""Column expressions shared by the models. All stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions import rules


def ladder(value: Column, steps: list[tuple[str, int]], last: str, inclusive: bool = True) -> Column:
    """First label whose bound the value does not pass; a null value takes `last`."""
    out = None
    for label, bound in steps:
        hit = value <= bound if inclusive else value < bound
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(last))


def day_of_week(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def time_of_day(hour: Column) -> Column:
    return (
        F.when(hour.between(6, 11), "morning")
        .when(hour.between(12, 17), "afternoon")
        .when(hour.between(18, 21), "evening")
        .otherwise("night")
    )


def is_weekend(dow: Column) -> Column:
    return dow.isin(0, 6)


def day_type(dow: Column) -> Column:
    return F.when(is_weekend(dow), "weekend").otherwise("weekday")


def day_name(dow: Column) -> Column:
    return F.element_at(F.expr(f"array({sql_list(rules.DAY_NAMES)})"), dow + 1)


def sql_list(values) -> str:
    """Values as SQL literals. Rule tables go into the plan as text: one call to the JVM
    instead of several per rule."""
    escaped = [v.replace("\\", "\\\\").replace("'", "\\'") for v in values]
    return ", ".join(f"'{v}'" for v in escaped)


def task_category(folded: str) -> Column:
    """Ordered keyword rules on a column of case-folded text. Plain LIKE terms turn into
    substring searches in the plan, which LIKE ANY does not."""
    whens = []
    for category, patterns in rules.TASK_PATTERNS.items():
        hit = " OR ".join(f"{folded} LIKE {sql_list([p])}" for p in patterns)
        whens.append(f"WHEN {hit} THEN '{category}'")
    return F.expr(f"CASE {' '.join(whens)} ELSE 'other' END")


def task_category_by_word(folded: str) -> Column:
    """The same idea with whole-word rules; one regular expression per category."""
    whens = [
        f"WHEN {folded} RLIKE {sql_list(['|'.join(patterns)])} THEN '{category}'"
        for category, patterns in rules.TASK_WORD_PATTERNS.items()
    ]
    return F.expr(f"CASE {' '.join(whens)} ELSE 'other' END")


def file_path(tool: Column, text: Column) -> Column:
    return F.when(
        tool.isin(rules.PATH_TOOLS) & text.contains("/"),
        F.regexp_extract(text, rules.PATH_REGEX, 1),
    )


def file_extension(tool: Column, text: Column) -> Column:
    return F.when(
        tool.isin(rules.PATH_TOOLS) & text.contains("."),
        F.regexp_extract(text, rules.EXTENSION_REGEX, 1),
    )


def file_type(column: str) -> Column:
    whens = [f"WHEN {column} IN ({sql_list(e)}) THEN '{name}'" for name, e in rules.FILE_TYPES.items()]
    return F.expr(f"CASE {' '.join(whens)} ELSE 'other' END")


def operation_type(tool: Column) -> Column:
    return (
        F.when(tool == "Read", "read")
        .when(tool.isin("Write", "NotebookEdit"), "write")
        .when(tool == "Edit", "edit")
        .when(tool == "MultiEdit", "multi_edit")
        .otherwise("other")
    )


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def seconds_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(1e6)


def to_micros(seconds: Column) -> Column:
    """Whole microseconds of a seconds value. Sums of these do not depend on row order."""
    return F.round(seconds * F.lit(1e6)).cast("bigint")


def mean_seconds(micros: Column) -> Column:
    """Mean in seconds of a microsecond column, summed exactly; null when there is none."""
    return F.sum(micros) / F.count(micros) / F.lit(1e6)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null when bottom is zero or null."""
    return F.when(bottom != 0, top.cast("double") / bottom)


def percent(top: Column, bottom: Column) -> Column:
    return F.round(ratio(top, bottom) * 100, 2)


def fixed(value: Column, digits: int) -> Column:
    """Through decimal(18,3), then rounded."""
    return F.round(value.cast("decimal(18,3)"), digits)


def count_where(flag: Column) -> Column:
    """Rows where the flag is true, as a sum over 0 and 1."""
    return F.sum(F.when(flag, 1).otherwise(0))


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def null_safe_key(value: Column) -> Column:
    """A never-null text that keeps null apart from every real value.

    Joins and windows on it need no null-safe comparison, so both sides keep one
    plain hash partitioning.
    """
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value))


def parse_timestamp(text: Column) -> Column:
    """ISO date or date-time with optional offset; anything else gives null."""
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?$")
    # The cast wants seconds in front of an offset and a point in front of fractions.
    full = F.regexp_replace(text, r"^([^T ]+[T ]\d{2})(Z|[+-].*)?$", "$1:00$2")
    full = F.regexp_replace(full, r"^([^T ]+[T ]\d{2}:\d{2})(Z|[+-].*)?$", "$1:00$2")
    full = F.regexp_replace(full, ",", ".")
    return F.when(iso, F.coalesce(text.try_cast("timestamp"), full.try_cast("timestamp")))


# The text format of a period per granularity.
PERIOD_FORMATS = {"hour": "yyyy-MM-dd'T'HH:00", "day": "yyyy-MM-dd"}


def period(ts: Column, granularity: str) -> Column:
    """Tumbling period of a timestamp as sortable text; weeks are ISO weeks."""
    if granularity == "week":
        return F.concat(
            F.extract(F.lit("yearofweek"), ts).cast("string"),
            F.lit("-W"),
            F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
        )
    return F.date_format(ts, PERIOD_FORMATS[granularity])


def period_label(period_start: Column, granularity: str) -> Column:
    if granularity == "week":
        return period_start
    if granularity == "hour":
        ts = F.to_timestamp(period_start, "yyyy-MM-dd'T'HH:mm")
        return F.date_format(ts, "MMM d HH:mm")
    return F.date_format(F.to_date(period_start), "MMM d")


def period_bounds(period_start: Column, granularity: str) -> tuple[Column, Column]:
    """First and last day of a period."""
    if granularity == "week":
        year = F.substring(period_start, 1, 4).cast("int")
        week = F.substring(period_start, 7, 2).cast("int")
        # 4 January is always in ISO week 1.
        monday = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
        first = F.date_add(monday, (week - 1) * 7)
        return first, F.date_add(first, 6)
    day = F.to_date(F.substring(period_start, 1, 10))
    return day, day
