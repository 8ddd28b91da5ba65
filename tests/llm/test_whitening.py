import math

import numpy as np
import pytest

from roadlens.llm.whitening import whitened_vectors

SCHEMA = "vec_id long, embedding array<double>, x string, n long, component int, block string"


def run(spark, rows, **options):
    df = whitened_vectors(spark.createDataFrame([(i, v, "x", 1, 2, "b") for i, v in rows], SCHEMA).repartition(5), **options)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return df.collect()


def whole(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def reference(rows, components=16):
    """By definition: exact sums and deviations in Python's whole numbers, eigenvectors of the covariance of the distinct vectors."""
    good = [(i, whole(v)) for i, v in rows]
    fit = sorted(set(tuple(x) for _, x in good))
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s // n for s in total])
    rest = np.array([s % n / n for s in total])
    x = (np.array(fit) - mean).astype(float) - rest
    e, vec = np.linalg.eigh(x.T @ x / n)
    e, vec = e[::-1], vec[:, ::-1]
    k = min(components, int((e > 1e-14 * e.sum()).sum()))
    out = []
    for i, row in good:
        far = (np.array(row) - mean).astype(float) - rest
        deviation = sum((n * a - s) ** 2 for a, s in zip(row, total))
        out.append((i, n, deviation, far @ vec[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()))
    return out


def same(got, want):
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == sum(len(w[4]) for w in want) and sorted(by) == sorted(w[0] for w in want)
    k = len(want[0][4])
    mine = np.array([[by[w[0]][c]["whitened"] for c in range(1, k + 1)] for w in want])
    theirs = np.array([w[3] for w in want])
    signs = np.sign((mine * theirs).sum(axis=0))
    assert np.abs(mine * signs - theirs).max() < 1e-8
    for w in want:
        for c in range(1, k + 1):
            r = by[w[0]][c]
            assert (r["n"], r["deviation"]) == (w[1], w[2]) and r["explained"] == pytest.approx(w[4][c - 1], rel=1e-9) and r["identity_error"] < 1e-8


@pytest.mark.parametrize("n, d, spread", [(400, 24, 1.0), (300, 20, 0.7), (12, 20, 1.0)])
def test_as_numpy(spark, n, d, spread):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, d)) * spread ** np.arange(d) * 3 + rng.standard_normal(d) * 50
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(n + i, rows[i % 3][1]) for i in range(n // 2)]  # copies count once in the fit
    same(run(spark, rows), reference(rows))


def test_repeated_eigenvalues_and_lost_directions(spark):
    axes = [(2 * i + s, [float((-1) ** s * 3 * (i == j)) for j in range(8)] + [0.0, 7.5]) for i in range(8) for s in (0, 1)]
    got = run(spark, axes)
    assert sorted({r["component"] for r in got}) == list(range(1, 9))
    assert {round(r["explained"], 12) for r in got} == {0.125} and max(r["identity_error"] for r in got) < 1e-9


def test_odd_rows(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [float("nan")]), (3, [None]), (4, [])]) == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    rows = [(1, [0.5, 1.0]), (2, [1.5, -1.0]), (3, [0.25, 0.5]), (3, [0.25, 0.5])]
    odd = [(4, None), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [])]
    got = run(spark, rows + odd)
    assert sorted(r["vec_id"] for r in got) == [1, 1, 2, 2, 3, 3, 3, 3]
    assert {r["n"] for r in got} == {3}
    first = run(spark, [*rows, (None, [3.0, 3.0])])
    assert sum(r["vec_id"] is None for r in first) == 2


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e4 * i, 3.0 * i * i, float(i % 5) * 1e3]) for i in range(50)]
    same(run(spark, rows), reference(rows))
    huge = run(spark, [(1, [1e300, 1.0]), (2, [-1e300, 5.0]), (3, [2.0, 1.0])])
    assert len(huge) >= 3 and all(r["deviation"] is None for r in huge if r["vec_id"] != 3)
