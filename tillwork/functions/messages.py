"""Chat text: commands, greetings, menu codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwork.functions.text import strip
from tillwork.vocabulary import (
    BUSINESS_TYPE_CODES,
    CADENCE_CODES,
    CANCEL,
    COMMANDS,
    DEFAULT_BUSINESS_TYPE,
    DEFAULT_CADENCE,
    FIRST_CONTACT_GREETINGS,
)


def _lookup(c: Column, codes: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(c == code, value) for code, value in codes.items()])


def command(text: Column) -> Column:
    """Command label of a message; ``help`` when no word list knows it."""
    word = strip(F.lower(text))
    labels = [F.when(word.isin(words), F.lit(label)) for label, words in COMMANDS.items()]
    return F.coalesce(*labels, F.lit("help"))


def is_first_contact_greeting(text: Column) -> Column:
    """Greetings and texts too short for a business name."""
    word = strip(F.lower(text))
    return word.isin(FIRST_CONTACT_GREETINGS) | (F.length(word) <= 2)


def is_cancel(text: Column) -> Column:
    return strip(F.lower(text)) == CANCEL


def business_type_answer(text: Column) -> Column:
    """Menu code, or the text itself in lower case, or the default when empty."""
    answer = strip(text)
    return F.coalesce(_lookup(answer, BUSINESS_TYPE_CODES), F.nullif(F.lower(answer), F.lit("")), F.lit(DEFAULT_BUSINESS_TYPE))


def cadence_code(text: Column) -> Column:
    """Cadence for a menu code, else NULL."""
    return _lookup(strip(text), CADENCE_CODES)


def cadence_answer(text: Column) -> Column:
    return F.coalesce(cadence_code(text), F.lit(DEFAULT_CADENCE))
