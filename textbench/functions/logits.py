"""Softmax and losses over an array of class scores.

The number of classes is known when the plan is made, so every sum over the
classes is written out as plain arithmetic: it is compiled with the rest of the
stage, which array lambdas are not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scores(z: Column, k: int) -> list[Column]:
    return [z[i] for i in range(k)]


def log_sum_exp(z: Column, k: int) -> Column:
    scores = _scores(z, k)
    top = F.greatest(*scores)
    return top + F.log(reduce(add, [F.exp(s - top) for s in scores]))


def softmax(z: Column, k: int) -> Column:
    lse = log_sum_exp(z, k)
    return F.array(*[F.exp(s - lse) for s in _scores(z, k)])


def class_log_probability(z: Column, y: Column, k: int) -> Column:
    return z[y] - log_sum_exp(z, k)


def class_probability(z: Column, y: Column, k: int) -> Column:
    return F.exp(class_log_probability(z, y, k))


def predicted_class(z: Column, k: int) -> Column:
    """Class with the largest score; of equal ones the lowest id."""
    return F.array_position(z, F.greatest(*_scores(z, k))) - 1


def cross_entropy(z: Column, y: Column, k: int, smoothing: float = 0.0) -> Column:
    """-ln p_y; with smoothing e: (1-e) * -ln p_y + e/K * sum of -ln p_k."""
    nll = -class_log_probability(z, y, k)
    if not smoothing:
        return nll
    spread = F.lit(float(k)) * log_sum_exp(z, k) - reduce(add, _scores(z, k))
    return F.lit(1.0 - smoothing) * nll + F.lit(smoothing / k) * spread


def focal_loss(
    z: Column,
    y: Column,
    k: int,
    gamma: float = 2.0,
    alpha: Sequence[float] | None = None,
    smoothing: float = 0.0,
) -> Column:
    """(1 - p_y)^gamma * cross entropy, times alpha_y if given. The factor uses the unsmoothed p_y."""
    loss = F.pow(1.0 - class_probability(z, y, k), F.lit(float(gamma))) * cross_entropy(z, y, k, smoothing)
    if alpha is not None:
        loss = loss * F.array(*[F.lit(float(a)) for a in alpha])[y]
    return loss
