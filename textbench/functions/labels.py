"""Labels and class ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textbench.fixed import LABELS, MISSING_TEXT, UNKNOWN_CLASS


def label_array(labels: Sequence[str] = LABELS) -> Column:
    return F.array(*[F.lit(label) for label in labels])


def encode_label(label: Column, labels: Sequence[str] = LABELS, unknown: str = "first") -> Column:
    """Class id (bigint) of a label.

    ``unknown`` says what a label outside the list becomes: ``first`` gives class 0,
    the usual and silent rule; ``null`` and ``error`` are the careful ones.
    A missing label counts as the text ``nan``.
    """
    position = F.array_position(label_array(labels), F.coalesce(label, F.lit(MISSING_TEXT)))
    if unknown == "first":
        return F.when(position > 0, position - 1).otherwise(F.lit(UNKNOWN_CLASS).cast("bigint"))
    if unknown == "null":
        return F.when(position > 0, position - 1)
    if unknown == "error":
        return F.when(position > 0, position - 1).otherwise(
            F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit(MISSING_TEXT)))).cast("bigint")
        )
    raise ValueError(f"unknown: {unknown}")


def is_known_label(label: Column, labels: Sequence[str] = LABELS) -> Column:
    return F.coalesce(label, F.lit(MISSING_TEXT)).isin(list(labels))


def decode_label(label_id: Column, labels: Sequence[str] = LABELS) -> Column:
    """Label of a class id; NULL outside 0..K-1."""
    return F.get(label_array(labels), label_id.cast("int"))
