"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textbench.fixed import MISSING_STRINGS, MISSING_TEXT, SAVED_OUTPUT_CHARS, SAVED_TEXT_CHARS, WHITESPACE


def strip(text: Column) -> Column:
    """Remove whitespace of every kind at both ends, newlines included."""
    return F.btrim(text, F.lit(WHITESPACE))


def missing_to_nan(field: Column) -> Column:
    """Missing values and strings that stand for them become the text ``nan``."""
    return F.when(field.isNull() | field.isin(MISSING_STRINGS), F.lit(MISSING_TEXT)).otherwise(field)


def null_to_nan(field: Column) -> Column:
    """Missing values of a typed source become the text ``nan``."""
    return F.coalesce(field, F.lit(MISSING_TEXT))


def saved_text(text: Column) -> Column:
    return F.substring(text, 1, SAVED_TEXT_CHARS)


def saved_output(raw: Column) -> Column:
    return F.coalesce(F.substring(raw, 1, SAVED_OUTPUT_CHARS), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, in text order; a missing text is the text ``nan``.

    a-z is named first and the run is possessive only because that matches faster.
    """
    known = F.coalesce(text, F.lit(MISSING_TEXT))
    return F.regexp_extract_all(F.lower(known), F.lit(r"[a-z\p{L}]++"), F.lit(0))


def fixed_decimals(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, for values below 1000.

    ``format_number`` rounds the exact binary value, ties to even, as C's printf
    does; ``format_string('%.4f')`` rounds the shortest decimal text half up and
    now and then differs in the last digit.
    """
    return F.format_number(value, digits)
