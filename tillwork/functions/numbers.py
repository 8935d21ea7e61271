"""Numbers written in local formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwork.vocabulary import CURRENCY_WORDS

_SPACE = r"[\s\x1c-\x1f]"
_CURRENCY = "(?:" + "|".join(CURRENCY_WORDS) + ")"
# Already plain: neither currency, thousands mark nor comma can occur in it.
_PLAIN = r"^[0-9]+(?:\.[0-9]{1,2})?$"
# What a cast may accept. Keeps out Java spellings such as 1d, NaN and Infinity.
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_DECIMAL = rf"(?U)^{_SPACE}*({_NUMBER}){_SPACE}*$"


def _finite(text: Column) -> Column:
    """A number beyond the range of a double is NULL."""
    number = text.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def parse_decimal(c: Column) -> Column:
    """Plain decimal text to double, however long; anything else is NULL."""
    return _finite(F.regexp_extract(c, _DECIMAL, 1))


def is_decimal(c: Column) -> Column:
    """Whether text without surrounding white space is a plain decimal; a cast to double then reads it."""
    return c.rlike(rf"^{_NUMBER}$")


def parse_number(c: Column) -> Column:
    """Local number text to double: currency words, space and dot thousands, decimal comma.

    Text that is already plain takes one pattern test; only the rest goes through the replacements.
    """
    text = F.regexp_replace(c, rf"(?U){_CURRENCY}{_SPACE}*", "")
    text = F.regexp_replace(text, rf"(?U){_SPACE}*{_CURRENCY}", "")
    text = F.regexp_replace(text, r"(?U)\s(?=\d{3}(?!\d))", "")
    text = F.regexp_replace(text, r"\.(?=[0-9]{3})", "")
    local = parse_decimal(F.replace(text, F.lit(","), F.lit(".")))
    return F.when(c.rlike(_PLAIN), _finite(c)).otherwise(local)
