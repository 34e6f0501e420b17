"""Whitening against numpy, and its exact steps on matrices with known answers."""

from fractions import Fraction

import numpy as np
import pytest

from newsweft.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int, d int, component string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1, 2, "c") for i, v in vectors], SCHEMA)


def plain(vectors, k=16):
    """(n, S, x, eigenvalues, components) of the usable vectors."""
    usable = [(i, [float(np.float32(c)) for c in v]) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in usable])).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    centred = u - u.sum(axis=0) / len(u)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(u))
    return [i for i, _ in usable], x, len(u), u.sum(axis=0), values[::-1], vectors[:, ::-1]


def test_whitened_rows_equal_numpy(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(300, 20)) * np.linspace(1, 3, 20)
    vectors = [(i, v.tolist()) for i, v in enumerate(base)] + [(7, base[7].tolist()), (None, base[8].tolist())] + [(500 + i, base[9].tolist()) for i in range(150)]
    odd = [(900, None), (901, [1.0] * 19 + [None]), (902, [1.0] * 19 + [float("nan")]), (903, [1.0] * 19 + [float("inf")]), (904, []), (905, [1.0, 2.0])]
    got = whitening.whiten(table(spark, vectors + odd).repartition(4)).collect()
    names, x, n, sums, values, components = plain(vectors)
    assert len(got) == 16 * len(vectors) and {r["n"] for r in got} == {n} == {300}
    deviations = dict(zip(map(str, names), ((n * x - sums) ** 2).sum(axis=1).tolist()))
    white = (x - sums / n) @ components[:, :16] / np.sqrt(values[:16])
    order = {str(i): row for i, row in zip(names, white)}
    signs = {}
    for r in got:
        k = r["component"] - 1
        assert r["deviation"] == deviations[str(r["vec_id"])]
        assert abs(r["explained"] * values.sum() / values[k] - 1) < 1e-9 and r["identity_error"] < 1e-9
        want = order[str(r["vec_id"])][k]
        if abs(want) > 0.1:
            assert signs.setdefault(k, np.sign(want * r["whitened"])) * want == pytest.approx(r["whitened"], abs=1e-8)
    assert len(signs) == 16


def test_low_rank_single_and_empty(spark):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(6)]
    got = whitening.whiten(table(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 6 and {round(r["explained"], 12) for r in got} == {1.0}
    for vectors in ([], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        out = whitening.whiten(table(spark, vectors))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_root_and_wide_entries(spark):
    square = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0])]
    got = whitening.whiten(table(spark, square)).collect()
    assert len(got) == 8 and {round(r["explained"], 12) for r in got} == {0.5} and got[0]["identity_error"] < 1e-12
    wide = whitening.whiten(table(spark, [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [5.0, 1e6])])).collect()
    assert len(wide) == 6 and {r["deviation"] for r in wide if r["vec_id"] < 2} == {None}


def test_polynomial_and_roots_are_exact(spark):
    rnd = np.random.default_rng(2)
    for d in (1, 2, 5, 12):
        a = rnd.integers(-1000, 1000, size=(d, d)).astype(object)
        matrix = (a.T @ a).tolist()
        poly = whitening.characteristic_polynomial(spark, matrix)
        # the determinant of x I - matrix at integers, by fractions
        for x in (0, 1, -7):
            rows, det = [[Fraction((x if i == j else 0) - matrix[i][j]) for j in range(d)] for i in range(d)], Fraction(1)
            for c in range(d):
                pivot = next((r for r in range(c, d) if rows[r][c]), None)
                if pivot is None:
                    det = Fraction(0)
                    break
                if pivot != c:
                    rows[c], rows[pivot], det = rows[pivot], rows[c], -det
                det *= rows[c][c]
                for r in range(c + 1, d):
                    f = rows[r][c] / rows[c][c]
                    rows[r] = [v - f * w for v, w in zip(rows[r], rows[c])]
            assert sum(c * x**k for k, c in enumerate(poly)) == det
    # (x - 1)(x - 2)^2 (x - 10^6) x
    poly = [0, 4 * 10**6, -8 * 10**6 - 4, 5 * 10**6 + 8, -(10**6) - 5, 1]
    roots = whitening.largest_roots(poly, 4)
    assert [m for _, m in roots] == [1, 2, 1] and [round(float(r), 9) for r, _ in roots] == [1e6, 2.0, 1.0]
    assert whitening.roots_above(poly, 1) == 3 and whitening.roots_above(poly, 2) == 1


def test_products_of_wide_integers_are_exact():
    rnd = np.random.default_rng(3)
    for bits in (10, 28, 55):
        a = rnd.integers(-(1 << bits), 1 << bits, size=(50, 4))
        assert (whitening.exact_product(a, a) == a.T.astype(object) @ a.astype(object)).all()
