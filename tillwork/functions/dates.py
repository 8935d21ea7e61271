"""Dates written in several formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day texts by order of their parts; only year-first dashes and day-first slashes may carry a time.
_TIME = r"[0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2})?"
_SPACE = r"[\s\x1c-\x1f]"
_DAYS = (
    rf"(?U)^{_SPACE}*(?:"
    rf"([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(?:{_SPACE}+({_TIME}))?"
    rf"|([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})(?:{_SPACE}+({_TIME}))?"
    r"|([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})"
    rf"|([0-9]{{1,2}})-([0-9]{{1,2}})-([0-9]{{4}})"
    rf"){_SPACE}*$"
)
_AS_ISO = "$1$7$9$14-$2$6$10$13-$3$5$11$12 $4$8"
# Years 1678 to 2261.
_YEAR = "(?:167[89]|16[89][0-9]|1[7-9][0-9]{2}|2[01][0-9]{2}|22[0-5][0-9]|226[01])"
_ISO = rf"^({_YEAR}-[0-9]{{1,2}}-[0-9]{{1,2}}(?: {_TIME})?) ?$"
# Already year, month, day: read without a rewrite.
_PLAIN = rf"^{_YEAR}-[0-9]{{1,2}}-[0-9]{{1,2}}$"
_MONTH_NAME = rf"(?U)^{_SPACE}*([A-Za-z]+){_SPACE}+([0-9]{{1,2}}),{_SPACE}+({_YEAR}){_SPACE}*$"


def parse_date(c: Column) -> Column:
    """Date or date-time text to a timestamp without zone; unknown formats are NULL.

    Every known shape is rewritten to year, month, day by one replacement, so a value is parsed
    once instead of being tried against each format. Plain days take one pattern test.
    """
    iso = F.regexp_extract(F.regexp_replace(c, _DAYS, _AS_ISO), _ISO, 1).try_cast("timestamp_ntz")
    month_name = F.when(
        c.rlike(_MONTH_NAME),
        F.try_to_timestamp(F.regexp_replace(c, _MONTH_NAME, "$1 $2, $3"), F.lit("MMMM d, yyyy")).cast("timestamp_ntz"),
    )
    return F.when(c.rlike(_PLAIN), c.try_cast("timestamp_ntz")).otherwise(F.coalesce(iso, month_name))
