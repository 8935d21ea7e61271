"""Text functions: white space, missing words, names, phone numbers, file names, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwork.vocabulary import LINE_BREAK, MISSING_WORDS, SERVICE_TYPES, WHITE_SPACE


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def nullify_missing(c: Column) -> Column:
    """Cells that spell "missing" become NULL."""
    return F.when(~c.isin(MISSING_WORDS), c)


def title_case(c: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere (``d'agua-frita`` is ``D'Agua-Frita``)."""
    parts = F.split(F.lower(c), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "")


def normalise_phone(c: Column) -> Column:
    return F.coalesce(strip(F.replace(c.cast("string"), F.lit("+"), F.lit(""))), F.lit(""))


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def fields(c: Column) -> Column:
    """Comma-separated parts without surrounding white space."""
    return F.split(strip(c), r"(?U)[\s\x1c-\x1f]*,[\s\x1c-\x1f]*")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the base name; empty without one."""
    name = basename(path)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def safe_filename(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def is_service(business_type: Column) -> Column:
    return F.lower(F.coalesce(business_type, F.lit(""))).isin(SERVICE_TYPES)


def fixed(c: Column, decimals: int) -> Column:
    """Fixed decimals, ties to even, no thousands separator."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", c, F.lit(pattern))


def round_even(c: Column, decimals: int) -> Column:
    """Round the binary value half to even, which ``round`` and ``bround`` do on its decimal text."""
    return fixed(c, decimals).cast("double")


def whole(c: Column) -> Column:
    """A double without its fraction; no size is out of range."""
    # From 2^53 on a double has no fraction.
    return F.when(F.abs(c) < 2.0**53, c.cast("long").cast("double")).otherwise(c)


def money(c: Column) -> Column:
    return F.concat(F.lit("MZN "), F.format_number(c, 2))


def signed_percent(c: Column, gap: str = "") -> Column:
    """``+4.2%`` or ``-4.2%``, with ``gap`` between sign and digits."""
    sign = F.when(c >= 0, "+").otherwise("-")
    return F.concat(sign, F.lit(gap), fixed(F.abs(c), 1), F.lit("%"))


def hour_band(hour: Column) -> Column:
    return F.format_string("%02dh-%02dh", hour, hour + 1)
