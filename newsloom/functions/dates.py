"""Dates of feed entries.

Both columns are ``timestamp_ntz``: the sender's wall clock (labels and days) and the same
instant in UTC (sorting). Neither depends on the session time zone.
"""

from pyspark.sql import functions as F

from newsloom.functions.once import computed_once
from newsloom.schemas import MISSING

# ---- fixed values: month names, zone names (RFC 2822) -------------------------
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_FULL_MONTHS = (
    "january february march april may june july august september october november december"
).split()
_ZONES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "AST": -400, "ADT": -300, "EST": -500, "EDT": -400, "CST": -600, "CDT": -500,
    "MST": -700, "MDT": -600, "PST": -800, "PDT": -700,
}
# -------------------------------------------------------------------------------

# [weekday,] day month year hour:minute[:second] [zone]; day and month may be swapped, the
# clock may have dots, and a clock with colons may stand before the year.
_WEEKDAY = r"(?:[^\s,]*,\s*|(?:mon|tue|wed|thu|fri|sat|sun)\s+)?"
_CLOCK = r"(\d{1,2})([:.])(\d{1,2})(?:\5(\d{1,2}))?,?(?:\s*([+-]\d+)|\s+(\S+))?(?:\s.*)?"
_YEAR_LAST = (
    r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?,?\s+"
    r"(?:([^\d\s]\S*)\s+(\d{1,4}),?|(\d{1,4}),?(?:\s*([+-]\d+)|\s+(\S+))?)(?:\s.*)?"
)
_DAY_FIRST = rf"(?is)^\s*{_WEEKDAY}(\d{{1,2}})[\s-]+([a-z]+)[\s-]+(\d{{1,4}}),?\s+{_CLOCK}$"
_MONTH_FIRST = rf"(?is)^\s*{_WEEKDAY}([a-z]+)\s+(\d{{1,2}}),?\s+(\d{{1,4}}),?\s+{_CLOCK}$"
_DAY_FIRST_YEAR_LAST = rf"(?is)^\s*{_WEEKDAY}(\d{{1,2}})[\s-]+([a-z]+),?\s+{_YEAR_LAST}$"
_MONTH_FIRST_YEAR_LAST = rf"(?is)^\s*{_WEEKDAY}([a-z]+)\s+(\d{{1,2}}),?\s+{_YEAR_LAST}$"
_MARK = "\x01"


def _with_fields(df, text):
    """Add the parts of a date text as an array - null when it does not look like a date.

    They are day, month, year, hour, minute, second, numeric zone, named zone.
    """

    def marked(pattern, order):
        return F.regexp_replace(text, pattern, _MARK.join(order.split()))

    # each step reads the result of the one before, and few texts need the later patterns
    found = F.col("_marked")
    df = computed_once(df, _marked=marked(_DAY_FIRST, "$1 $2 $3 $4 $6 $7 $8 $9"))
    for pattern, order in (
        (_MONTH_FIRST, "$2 $1 $3 $4 $6 $7 $8 $9"),
        (_DAY_FIRST_YEAR_LAST, "$1 $2 $7$8 $3 $4 $5 $9 $6$10"),
        (_MONTH_FIRST_YEAR_LAST, "$2 $1 $7$8 $3 $4 $5 $9 $6$10"),
    ):
        df = computed_once(df, _marked=F.when(found.contains(_MARK), found).otherwise(marked(pattern, order)))
    is_date = found.contains(_MARK) & ~F.col(text).contains(_MARK)
    return computed_once(df, _fields=F.when(is_date, F.split(found, _MARK))).drop("_marked")


def _lookup(names, key):
    pairs = ", ".join(f"'{name}', {value}" for name, value in names.items())
    return f"map({pairs})[{key}]"


def _number(i):
    # a failed cast of an empty text is slow
    return f"try_cast(nullif(_fields[{i}], '') as int)"


# "may" is its own full name, and a map keeps one entry per key
_MONTH = _lookup(
    {name: i for names in (_MONTHS, _FULL_MONTHS) for i, name in enumerate(names, 1)}, "lower(_fields[1])"
)
_YEAR = f"{_number(2)} + case when {_number(2)} > 99 then 0 when {_number(2)} > 68 then 1900 else 2000 end"
# Spark would carry second 60 into the next minute
_SECOND = f"case when _fields[5] = '' then 0 when {_number(5)} < 60 then {_number(5)} end"
_LOCAL = f"""try_make_timestamp_ntz({_YEAR}, {_MONTH}, {_number(0)}, {_number(3)}, {_number(4)},
    cast({_SECOND} as decimal(16, 6)))"""
# hours and minutes of the zone; one that is missing or unknown counts as UTC
_ZONE = f"coalesce({_number(6)}, {_lookup(_ZONES, 'upper(_fields[7])')}, {_number(7)}, 0)"


def parse_published(df, text="published"):
    """Add ``published_local`` and ``published_at``; null where the text is not a date."""
    parsed = computed_once(_with_fields(df, text), published_local=F.expr(_LOCAL), _zone=F.expr(_ZONE))
    # "div" and "%" keep the sign: -330 is three hours and thirty minutes west
    at = F.expr("timestampadd(MINUTE, -int(_zone div 100 * 60 + _zone % 100), published_local)")
    return parsed.withColumn("published_at", at).drop("_fields", "_zone")


def date_label(published, local):
    """``19 Aug 2025``; the raw text where it is not a date; a dash where it is empty."""
    return F.when(F.coalesce(published, F.lit("")) == "", F.lit(MISSING)).otherwise(
        F.coalesce(F.date_format(F.to_date(local), "dd MMM yyyy"), published)
    )


def moment_label(moment):
    return F.date_format(moment, "dd MMM yyyy, HH:mm")


def period_label(start, end):
    day = lambda d: F.date_format(d, "dd MMM yyyy")
    return F.concat(day(start), F.lit(" – "), day(end))


def duration_label(seconds):
    # rounds halves to even on the exact value; format_string would round them up
    return F.concat(F.call_function("format_number", seconds, F.lit("0.0")), F.lit("s"))


def search_date(day):
    """The ISO text a search takes as its bound."""
    return F.date_format(day, "yyyy-MM-dd")
