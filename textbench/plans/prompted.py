"""Prompt, generate, parse, evaluate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.fixed import FEW_SHOT_EXAMPLES, LABELS, MISSING_TEXT
from textbench.functions.labels import decode_label, encode_label
from textbench.functions.parsing import extract_response
from textbench.functions.prompts import build_prompt
from textbench.operators.generation import generate_stored
from textbench.operators.labels import resolved_label
from textbench.operators.metrics import classification_report, macro_f1
from textbench.operators.predictions import parse_outputs, truncate_output
from textbench.operators.rows import first_n
from textbench.session import materialize, work_dir


def prompted_predictions(
    df: DataFrame,
    fn: Callable[[pd.Series], pd.Series],
    model: str,
    mode: str = "few-shot",
    max_samples: int | None = None,
    labels: Sequence[str] = LABELS,
    examples=FEW_SHOT_EXAMPLES,
    prompts_per_task: int = 100,
    mapping: DataFrame | None = None,
    continuation: bool = False,
    store: str | None = None,
    tasks: int = 10_000,
) -> DataFrame:
    """(model, row_id, text, true_label, pred_label, raw_output) of the first rows of (row_id, text, label).

    ``labels`` make the prompt and parse the answers. True labels are those of
    ``mapping``, such as ``resolve_labels`` gives, or else of ``labels`` too; unknown
    ones become its class 0. Outputs repeat the prompt, so what stands behind the last
    answer marker is parsed; with ``continuation`` they do not, and are parsed whole.

    Equal prompts are asked once, about ``prompts_per_task`` by a task and at most ``tasks``
    tasks, since a model call is by far the dearest step. Outputs go to ``store``, a folder
    for this generator, and what it has already is not asked again: name one to go on after
    a failure. Without it they go to a folder of this run. The result is written once to the
    shared folder: both the saved predictions and the metrics read it.
    """
    text = F.coalesce("text", F.lit(MISSING_TEXT))
    chosen = first_n(df, max_samples)
    if mapping is None:
        chosen = chosen.withColumn("label", decode_label(encode_label(F.col("label"), labels), labels))
    else:
        chosen = resolved_label(chosen, mapping)
    rows = chosen.select("row_id", text.alias("text"), F.col("label").alias("true_label"))
    prompts = rows.withColumn("prompt", build_prompt(F.col("text"), mode, labels, examples))
    store = store or work_dir(df.sparkSession)
    outputs = generate_stored(prompts, fn, store, prompts_per_task=prompts_per_task, tasks=tasks).drop("prompt")
    if not continuation:
        outputs = outputs.withColumn("raw_output", extract_response(F.col("raw_output")))
    parsed = truncate_output(parse_outputs(outputs, labels))
    return materialize(
        parsed.select(F.lit(model).alias("model"), "row_id", "text", "true_label", "pred_label", "raw_output")
    )


def prompted_evaluation(predictions: DataFrame, labels: Sequence[str] = LABELS) -> tuple[DataFrame, DataFrame]:
    """Macro-F1 and classification report of prompted predictions."""
    return macro_f1(predictions, labels), classification_report(predictions, labels)
