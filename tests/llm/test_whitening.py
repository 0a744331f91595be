"""Whitening against sums of Python integers and fractions."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from brindle.llm import whitening as w

COLUMNS = "vec_id long, embedding array<double>, label int, d int, whitened string, part long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], COLUMNS)


def exact(rows):
    """{size: (x by row, n, S, numerators of the covariance over n * n)}, in Python integers."""
    out = {}
    for d in {len(v) for _, v in rows}:
        x = [(i, [max(-(1 << 63), min((1 << 63) - 1, floor(Fraction(c) * 1024) + 100000)) for c in v]) for i, v in rows if len(v) == d]
        n, s = len(x), [sum(c) for c in zip(*(v for _, v in x))]
        out[d] = x, n, s, [[n * sum(v[i] * v[j] for _, v in x) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return out


def test_gram_of_any_long_is_exact():
    rng = np.random.default_rng(2)
    for low, high in ((-(1 << 63), (1 << 63) - 1), (-5, 5), (99_000, 101_000), (0, 1 << 45)):
        x = rng.integers(low, high, size=(300, 7))
        got = sum(m.astype(object) << (20 * k) for k, m in w.gram(x).items())
        assert (got == x.astype(object).T @ x.astype(object)).all()
        both = w.halves(np.array([low, high])) + w.halves(np.array([high, high]))
        assert w.whole(both).tolist() == [low + high, 2 * high]
    y = rng.integers(-(1 << 61), 1 << 61, size=(5, 9000))
    assert w.squares(y) == (y.astype(object) ** 2).sum(axis=1).tolist()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    low = rng.normal(size=(3, 10))
    made = [(i, (rng.normal(size=3) @ low + 0.05 * rng.normal(size=10) + 3).tolist()) for i in range(200)]
    made += [(200 + i, [float(i), 1.0, 2.0]) for i in range(7)]  # one direction only
    made += [(300, [0.5, 0.25]), (301, []), (5, made[5][1]), (None, made[6][1])]
    made += [(400 + i, [1e300 * (-1) ** i, 4e15 + i, -7e9, 1.5, 2.0**53]) for i in range(12)]
    return made


@pytest.mark.parametrize("parts", [3, 130])
def test_equals_fractions(spark, rows, parts):
    bad = [(900, None), (901, [1.0, None] * 5), (902, [float("nan")] * 10), (903, [float("inf")] * 10)]
    got = w.whiten(frame(spark, rows + bad).repartition(parts)).collect()
    assert {r["vec_id"] for r in got} == {i for i, v in rows if v}
    for d, (x, n, s, cov) in exact([r for r in rows if r[1]]).items():
        ids = {i for i, _ in x}
        mine = [r for r in got if r["vec_id"] in ids]
        assert len(mine) == len(x) * min(8, d) and {r["n"] for r in mine} == {n}
        far = {i: sum((n * c - t) ** 2 for c, t in zip(v, s)) for i, v in x}
        assert all(int(r["deviation_digits"]) == far[r["vec_id"]] and r["deviation"] == (far[r["vec_id"]] if far[r["vec_id"]] < 1 << 63 else None) for r in mine)
        if d == 10:
            v = np.array([[float(Fraction(c, n * n)) for c in row] for row in cov])
            e, u = np.linalg.eigh(v)
            centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(row, s)] for _, row in x])
            for k in range(8):
                want = centred @ u[:, -1 - k] / e[-1 - k] ** 0.5
                have = np.array(sorted(r["whitened"] for r in mine if r["component"] == k + 1))
                assert min(np.abs(have - np.sort(want)).max(), np.abs(have - np.sort(-want)).max()) < 1e-9
                assert all(abs(r["explained"] / (e[-1 - k] / np.trace(v)) - 1) < 1e-9 for r in mine if r["component"] == k + 1)
            assert {r["identity_error"] for r in mine} == {mine[0]["identity_error"]} and mine[0]["identity_error"] < 1e-9
        if d in (2, 3):  # without variance in some direction
            assert all(r["whitened"] == r["explained"] == 0 for r in mine if r["component"] > (1 if d == 3 else 0))
            assert all(abs(r["explained"] - 1) < 1e-12 for r in mine if d == 3 and r["component"] == 1)


def test_large_shared_offset_and_steep_spectrum(spark):
    """Variances that differ by ten orders beside a mean far above them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)) * [1e5, 1e4, 1e3, 1e2, 10, 1] + 1e9
    got = w.whiten(frame(spark, list(enumerate(x.tolist())))).collect()
    ((_, n, _, cov),) = exact(list(enumerate(x.tolist()))).values()
    e = np.sort(np.linalg.eigvalsh(np.array([[float(Fraction(c, n * n)) for c in row] for row in cov])))[::-1]
    for r in got:
        assert abs(r["explained"] * e.sum() / e[r["component"] - 1] - 1) < 1e-4
        assert r["identity_error"] < 1e-4


def test_empty_table(spark):
    assert w.whiten(frame(spark, [])).collect() == []
    assert w.whiten(frame(spark, [(1, None)])).collect() == []
