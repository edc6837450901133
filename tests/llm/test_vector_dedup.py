import math

import numpy as np
import pytest

from textbench.llm import vector_dedup as V

EXTRA = "id code n weight group component side table block d v".split()
KINDS = "vec_id bigint, embedding array<double>, label int, " + ", ".join(f"`{c}` string" for c in EXTRA)


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v, k, *["x"] * len(EXTRA)) for k, (i, v) in enumerate(rows)], KINDS).repartition(3)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    if not (usable(a) and usable(b)) or len(a) != len(b):
        return 0
    a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
    return a @ b / math.sqrt((a @ a) * (b @ b))


def plain(rows, similarity=V.SIMILARITY):
    n = len(rows)
    link = [[i != j and cosine(rows[i][1], rows[j][1]) >= similarity for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        reach, new = {i}, [i]
        while new:
            new = [j for k in new for j in range(n) if link[k][j] and j not in reach]
            reach.update(new)
        ids = [rows[k][0] for k in reach if rows[k][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], sum(link[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cloud(seed, n, d=16, spread=0.09):
    """Vectors around a few centres, so near and far from the threshold."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((4, d))
    return [(i, (centres[i % 4] / np.linalg.norm(centres[i % 4]) + spread * r.standard_normal(d)).tolist()) for i in range(n)]


def test_by_brute_force(table):
    rows = cloud(1, 120)
    want = plain(rows)
    assert any(0 < r[1] < 25 for r in want)
    assert got(V.near_vectors(table(rows))) == want


def test_odd_vectors(table):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, [1e200, 1e199]), (5, [1e-200, 1e-201]),
        (6, None), (7, []), (8, [0.0, 0.0]), (9, [-0.0, 0.0]), (10, [nan, 1.0]), (11, [inf, 1.0]), (12, [None, 1.0]),
        (13, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (14, [-1.0, 0.0]), (15, [1.0]), (16, [5.0]), (17, [0.0, -1.0, -0.0]),
        (2, [0.0, 1.0]), (18, [0.0, 1.0]),
    ]
    assert got(V.near_vectors(table(rows))) == plain(rows)
    assert V.near_vectors(table(rows).limit(0)).count() == 0


def test_a_crowd_in_blocks(table, monkeypatch):
    """A group larger than a block, and fewer pairs at once than it has."""
    monkeypatch.setattr(V, "BLOCK", 20)
    monkeypatch.setattr(V, "PAIRS", 50)
    rows = cloud(2, 90, spread=0.05) + [(100 + i, v) for i, v in cloud(2, 3, spread=0.05)]
    assert got(V.near_vectors(table(rows))) == plain(rows)


def test_many_sides(table, monkeypatch):
    monkeypatch.setattr(V, "SIDE", 4)
    rows = cloud(3, 150)
    lines = V.Projections(150)
    assert lines.planes == 6
    assert got(V.near_vectors(table(rows))) == plain(rows)


def test_chance_of_a_collision():
    """Pairs at the threshold collide as often as the calibration says."""
    r = np.random.default_rng(4)
    a, b = r.standard_normal((2, 4000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = V.SIMILARITY * a + math.sqrt(1 - V.SIMILARITY**2) * b
    lines = V.Projections(4000)
    (x, p), (y, q) = lines.of(a), lines.of(b)
    met = (x == y) & (np.abs(p - q) <= lines.width)
    assert abs(met.mean() - V.chance(lines.planes)) < 0.03  # lines differ in length
    p = V.chance(lines.planes)
    missed = sum(math.comb(lines.tables, k) * p**k * (1 - p) ** (lines.tables - k) for k in range(V.COLLISIONS))
    assert missed <= V.MISSED and (met.sum(axis=1) >= V.COLLISIONS).all()


def test_projections_add_up_in_any_batch():
    r = np.random.default_rng(5)
    units = V.unit(r.standard_normal((300, 48)))
    lines = V.Projections(5000)
    whole = lines.of(units)
    for first, last in ((0, 1), (7, 150), (299, 300)):
        part = lines.of(units[first:last].copy())
        assert (part[0] == whole[0][first:last]).all() and (part[1] == whole[1][first:last]).all()


def test_forest_reaches_the_least():
    i, j = np.array([5, 4, 3, 8]), np.array([4, 3, 2, 9])
    assert V.forest(10, i, j).tolist() == [0, 1, 2, 2, 2, 2, 6, 7, 8, 8]
