"""Prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textbench.fixed import (
    FEW_SHOT_EXAMPLES,
    LABELS,
    MISSING_TEXT,
    PROMPT_END,
    PROMPT_EXAMPLE,
    PROMPT_EXAMPLES_TITLE,
    PROMPT_INTRO,
    PROMPT_TASK,
)

MODES = ("zero-shot", "few-shot")


def prompt_frame(
    mode: str,
    labels: Sequence[str] = LABELS,
    examples: Sequence[tuple[str, str]] = FEW_SHOT_EXAMPLES,
) -> tuple[str, str]:
    """What stands before and after the text. Made once, at plan time."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    names = ", ".join(labels)
    block = ""
    if mode == "few-shot":
        block = PROMPT_EXAMPLES_TITLE + "".join(PROMPT_EXAMPLE.format(text=t, label=l) for t, l in examples)
    return PROMPT_INTRO.format(labels=names) + block + PROMPT_TASK.format(labels=names), PROMPT_END


def build_prompt(text: Column, mode: str = "few-shot", labels: Sequence[str] = LABELS, examples=FEW_SHOT_EXAMPLES) -> Column:
    before, after = prompt_frame(mode, labels, examples)
    return F.concat(F.lit(before), F.coalesce(text, F.lit(MISSING_TEXT)), F.lit(after))
