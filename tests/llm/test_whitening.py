"""Operator 12 against one dense eigendecomposition; the secular equation and spectra by themselves."""

import numpy as np
import pytest

from galena.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def dense(vectors, most=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    away = (n * x - sums) / n
    values, turn = np.linalg.eigh(away.T @ away / n)
    values, turn = values[::-1], turn[:, ::-1]
    return ((n * x - sums) ** 2).sum(axis=1), away @ turn[:, :most] / np.sqrt(values[:most]), values[:most] / values.sum()


def held(rows, key="vec_id"):
    """Rows as arrays [vectors, components] in the order of keys; signs are free."""
    keys = sorted({r[key] for r in rows})
    at = {k: i for i, k in enumerate(keys)}
    out = np.full((len(keys), max(r.component for r in rows)), np.nan)
    for r in rows:
        out[at[r[key]], r.component - 1] = np.nan if r.whitened is None else r.whitened
    return keys, out


def test_whitening_against_a_dense_eigendecomposition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    rows = queries.op12_whitening(spark, SF).collect()
    deviation, white, share = dense([r.embedding for r in table])
    keys, got = held(rows)
    assert keys == [r.vec_id for r in table] and len(rows) == 32 * len(table)
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-8
    exact = {r.vec_id: r.deviation for r in rows}
    assert [exact[k] for k in keys] == deviation.tolist() and {r.n for r in rows} == {len(table)}
    assert np.allclose([r.explained for r in sorted(rows, key=lambda r: r.component)[:: len(table)]], share, rtol=1e-9)
    assert {r.identity_error for r in rows} and max(r.identity_error for r in rows) < 1e-9


@pytest.mark.parametrize("case", ["random", "repeated", "axes", "few", "scales"])
def test_spectra_by_updates_and_merges(case):
    draw = np.random.default_rng(5)
    x = {
        "random": draw.integers(-40, 40, size=(200, 12)),
        "repeated": np.repeat(draw.integers(-40, 40, size=(5, 9)), [1, 70, 2, 30, 9], axis=0),
        "axes": np.repeat(np.eye(8), 3, axis=0),
        "few": draw.integers(-3, 3, size=(4, 10)),
        "scales": draw.integers(-40, 40, size=(150, 6)) * 10.0 ** np.arange(6),
    }[case].astype(float)
    parts = []
    for rows in np.array_split(x, 4):
        parts.append(whitening.Spectrum(rows[0]))
        for row in rows:
            parts[-1].take(row)
    whole = parts[0]
    for other in parts[1:]:
        whole.merge(other)
    away = x - x.mean(axis=0)
    scatter = away.T @ away
    size = max(1.0, np.abs(scatter).max())
    assert whole.n == len(x) and np.allclose(whole.mean, x.mean(axis=0))
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(x.shape[1])).max() < 1e-10
    assert np.abs(whole.vectors @ np.diag(whole.values) @ whole.vectors.T - scatter).max() < 1e-10 * size
    assert np.allclose(np.sort(whole.values), np.linalg.eigvalsh(scatter), atol=1e-10 * size)


def test_secular_roots_interlace_with_close_poles():
    d = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-7, 5.0])
    z = np.array([1.0, 1e-3, 1e-5, 1.0, 1e-6])
    roots, turn = whitening.secular(d, z, 2.0)
    assert (np.diff(roots) > 0).all() and (roots >= d).all() and (roots[:-1] <= d[1:]).all()
    assert np.abs(turn.T @ turn - np.eye(5)).max() < 1e-12
    assert np.allclose(turn @ np.diag(roots) @ turn.T, np.diag(d) + 2 * np.outer(z, z), atol=1e-12)


def test_messy_vectors(spark):
    good = [[0.5, -0.25, 1.0], [0.1, 0.2, 0.3], [-1.0, 0.5, 0.25], [0.1, 0.2, 0.3], [2.0, 2.0, -3.0], [0.0, 1.5, 0.75]]
    bad = [None, [], [1.0, 2.0], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 0.0], [0.0, float("-inf"), 1.0]]
    rows = [(i, v, "x", 3) for i, v in enumerate(good)] + [(100 + i, v, "y", 4) for i, v in enumerate(bad)] + [(None, good[0], None, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, whitened string, n int")
    got = whitening.whiten(df).collect()
    assert len(got) == 7 * 3 and {r.vec_id for r in got} == {0, 1, 2, 3, 4, 5, None}
    deviation, white, share = dense([*good, good[0]])
    keys, mine = held([r for r in got if r.vec_id is not None])
    signs = np.sign((mine * white[:6]).sum(axis=0))
    assert np.abs(mine * signs - white[:6]).max() < 1e-9
    assert {(r.vec_id, int(r.deviation)) for r in got} == {*zip([*range(6), None], deviation.tolist(), strict=True)}


def test_vectors_without_variance(spark):
    kind = "vec_id bigint, embedding array<float>"
    alike = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], kind)).collect()
    assert len(alike) == 8 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in alike)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], kind)).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in flat)
    for none in ([], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(none, kind)).collect() == []


def test_deviation_beyond_64_bits():
    fit = whitening.Fit(10**10, [5 * 10**10, -(10**10)], np.eye(2))
    x = np.array([[30, 20], [5, -1]])
    assert fit.deviation(x) == [(10**10 * 25) ** 2 + (10**10 * 21) ** 2, 0]
