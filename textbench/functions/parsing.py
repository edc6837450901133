"""Generated text to labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textbench.fixed import ANSWER_MARKER, FALLBACK_LABEL, LABELS
from textbench.functions.text import strip


def extract_response(raw: Column) -> Column:
    """What follows the last answer marker, stripped; without a marker the whole output, unchanged."""
    return F.when(raw.contains(ANSWER_MARKER), strip(F.substring_index(raw, ANSWER_MARKER, -1))).otherwise(raw)


def parse_output(raw: Column, labels: Sequence[str] = LABELS, fallback: str = FALLBACK_LABEL) -> Column:
    """First label, in list order, that occurs anywhere in the lower-cased output.

    Occurs means as a substring: ``enjoyable`` is joy, ``not sadness but joy`` too.
    An output that is empty, missing or names no label gets the fallback.
    """
    lowered = F.lower(raw)
    return F.coalesce(*[F.when(lowered.contains(label), F.lit(label)) for label in labels], F.lit(fallback))


def labels_found(raw: Column, labels: Sequence[str] = LABELS) -> Column:
    """How many different labels occur; 0 means the fallback decided, 2 or more that the list order did."""
    lowered = F.coalesce(F.lower(raw), F.lit(""))
    count = F.lit(0).cast("bigint")
    for label in labels:
        count = count + lowered.contains(label).cast("bigint")
    return count
