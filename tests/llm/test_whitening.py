"""Incremental eigendecomposition and whitening against numpy's eigh."""

import numpy as np
import pytest

from lakescribe.llm import whitening as w

RNG = np.random.default_rng(0)
TABLES = {
    "plain": np.floor(RNG.normal(size=(400, 24)) * 8),
    "few directions": np.repeat(RNG.integers(0, 3, size=(5, 8)), 20, 0).astype(float),
    "equal": np.ones((10, 4)),
    "axes": np.eye(16)[np.arange(200) % 16] * 5,
    "one direction": np.c_[RNG.integers(0, 9, size=(300, 1)), np.zeros((300, 5))].astype(float),
    "graded": RNG.normal(size=(300, 12)) * 10.0 ** -np.arange(12),
    "width one": RNG.integers(0, 2, size=(300, 1)).astype(float),
    "one row": np.arange(5.0)[None],
}


def _scatter(x):
    return (x - x.mean(0)).T @ (x - x.mean(0))


def _is_of(s, x):
    """Whether a spectrum is that of the rows."""
    c, size = _scatter(x), max(np.abs(_scatter(x)).max(), 1e-9)
    return (
        s.n == len(x)
        and np.allclose(s.mean, x.mean(0), atol=1e-9)
        and np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-11
        and np.abs(s.vectors * s.values @ s.vectors.T - c).max() < 1e-10 * size
        and (np.diff(s.values) >= 0).all()
    )


@pytest.mark.parametrize("name", TABLES)
def test_rows_and_partitions(name):
    x = TABLES[name]
    s = w.nothing(x.shape[1])
    for row in x:
        s = w.with_row(s, row)
    assert _is_of(s, x)
    parts = []
    for piece in np.array_split(x, 3):
        parts.append(w.nothing(x.shape[1]))
        for row in piece:
            parts[-1] = w.with_row(parts[-1], row)
    assert _is_of(w.combined(parts[0], w.combined(parts[1], parts[2])), x)


def test_roots_lie_between():
    for _ in range(200):
        k = int(RNG.integers(2, 30))
        d = np.sort(RNG.random(k)) * 10.0 ** RNG.integers(-3, 4)
        z2 = (RNG.normal(size=k) * 10.0 ** -RNG.integers(0, 6, size=k)) ** 2 + 1e-12
        t, gap = w.roots(d, z2, 0.7)
        want = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(np.sqrt(z2), np.sqrt(z2)))
        assert np.allclose(t, want, rtol=1e-10, atol=1e-12 * d[-1])
        assert (gap[np.arange(k), np.arange(k)] <= 0).all() and (gap[np.arange(1, k), np.arange(k - 1)] >= 0).all()


def _plain(x):
    """x: whole numbers of the rows that take part."""
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = (fit - s / n).T @ (fit - s / n) / n
    values, axes = np.linalg.eigh(v)
    return n, s, values[::-1][:16], axes[:, ::-1][:, :16], np.trace(v)


def test_table(spark):
    rows = [(int(k), (RNG.normal(size=20) * 0.3).round(3).tolist(), int(k % 3)) for k in range(500)]
    rows += [(r[0] + 1000, r[1], 7) for r in rows[:200]] + rows[:50]  # copies under other ids, and repeated rows
    odd = [(9001, None, 1), (9002, [0.1] * 19 + [None], 1), (9003, [0.1] * 19 + [float("nan")], 1), (9004, [0.1] * 19 + [float("inf")], 1), (9005, [0.1] * 7, 1), (9006, [], 1), (9007, [1e30] + [0.1] * 19, 1), (None, rows[3][1], None)]
    df = spark.createDataFrame([(*r, 1, 2.0, "c") for r in [*rows, *odd]], "vec_id long, embedding array<float>, label int, n long, whitened double, component string")
    got = w.whitened_rows(df).toPandas()
    right = [*rows, odd[-1]]
    x = np.floor(64 * np.array([r[1] for r in right], np.float32).astype(float)).astype(np.int64) + w.ORIGIN
    n, s, values, axes, trace = _plain(x)
    assert len(got) == 16 * len(right) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-10
    assert got["vec_id"].isna().sum() == 16 and not set(range(9001, 9008)) & set(got["vec_id"].dropna())
    assert np.allclose(got.groupby("component")["explained"].first(), values / trace, rtol=1e-10)
    white = (x - s / n) @ axes / np.sqrt(values)
    deviation = ((n * x - s) ** 2).sum(1)
    first = got[got["vec_id"].notna()].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    ids = [r[0] for r in right[:-1]]
    found = first.loc[ids].to_numpy()
    assert np.allclose(found * np.sign((found * white[:-1]).sum(0)), white[:-1], atol=1e-9)
    of = got[got["vec_id"].notna()].drop_duplicates("vec_id").set_index("vec_id")["deviation"]
    assert of.loc[ids].tolist() == deviation[:-1].tolist()


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert w.whitened_rows(spark.createDataFrame([], schema)).count() == 0
    assert w.whitened_rows(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert w.whitened_rows(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # no variance
    line = w.whitened_rows(spark.createDataFrame([(k, [k / 64, 2 * k / 64]) for k in range(5)], schema)).toPandas()
    assert set(line["component"]) == {1} and np.allclose(line["explained"], 1) and np.allclose(np.abs(line["whitened"]).sort_values(), sorted(np.abs(np.arange(5) - 2) / np.sqrt(2)))


def test_deviations_that_dont_fit():
    model = w.Whitening(3 * 10**9, (5, 7), np.ones(2), np.eye(2), 2.0, 0.0)
    assert w.deviations(model, np.array([[0, 0], [2, 3], [1, 0]], "<i4")) == [74, None, (3 * 10**9 - 5) ** 2 + 49]
