"""Confusion cells of two saved prediction sets of 100 rows each, (true, predicted, n), and their scores."""

ZERO_SHOT = [
    ("anger", "joy", 14), ("fear", "joy", 1), ("joy", "joy", 19), ("love", "joy", 16),
    ("neutral", "joy", 45), ("sadness", "joy", 5),
]
FEW_SHOT = [
    ("anger", "anger", 1), ("anger", "fear", 1), ("anger", "joy", 9), ("anger", "neutral", 2), ("anger", "sadness", 1),
    ("fear", "joy", 1), ("joy", "fear", 1), ("joy", "joy", 18), ("love", "joy", 14), ("love", "neutral", 2),
    ("neutral", "anger", 1), ("neutral", "fear", 2), ("neutral", "joy", 37), ("neutral", "neutral", 5),
    ("sadness", "fear", 3), ("sadness", "neutral", 2),
]
SCORES = {
    "zero": {"accuracy": 0.19, "macro_f1": 0.053221, "weighted_f1": 0.060672},
    "few": {"accuracy": 0.24, "macro_f1": 0.111820, "weighted_f1": 0.167653},
}


def pairs(cells):
    return [(t, p) for t, p, n in cells for _ in range(n)]
