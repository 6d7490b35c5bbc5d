import math

import numpy as np
import pytest

from lakekin.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, key string, x long, n long, weight long, component int"


def make(spark, vectors):
    rows = [(i, v, 1, "k", 2, 3, 4, 5) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, weights="one", most=16):
    """Whitened rows by a plain computation over Python integers."""
    usable = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in usable]
    dims = max(set(lengths), key=lambda d: (lengths.count(d), d))
    x = {}
    for i, v in usable:
        if len(v) == dims:
            x.setdefault(tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v), []).append(i)
    fit = list(x)
    w = [len(x[f]) if weights == "counts" else 1 for f in fit]
    n = sum(w)
    sums = [sum(k * f[d] for k, f in zip(w, fit)) for d in range(dims)]
    dev = {f: [n * a - s for a, s in zip(f, sums)] for f in fit}
    c = np.array([[v / n for v in dev[f]] for f in fit])
    cov = (c * np.array(w)[:, None]).T @ c / n
    e, u = np.linalg.eigh(cov)
    order = [k for k in np.argsort(e)[::-1][:most] if e[k] > 1e-12 * np.trace(cov)]
    white = c @ u[:, order] / np.sqrt(e[order])
    found = {}
    for f, row in zip(fit, white):
        for i in x[f]:
            found.setdefault(i, []).append((n, sum(v * v for v in dev[f]), np.abs(row), e[order] / np.trace(cov)))
    return found


def check(rows, expected):
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, []).append(r)
    assert set(by_id) == set(expected)
    for i, wanted in expected.items():
        k = len(wanted[0][2])
        assert len(by_id[i]) == k * len(wanted)
        for r in by_id[i]:
            n, deviation, white, explained = wanted[0]
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.whitened) == pytest.approx(white[r.component - 1], abs=1e-6)
            assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-6)
            assert r.identity_error < 1e-4


def vectors(seed, n, dims, copies=0):
    rng = np.random.default_rng(seed)
    scale = np.geomspace(1, 0.2, dims)
    found = [(i, [float(c) for c in rng.normal(size=dims) * scale]) for i in range(n)]
    return found + [(n + i, found[3][1]) for i in range(copies)]


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_brute_force(spark, weights):
    rows = vectors(1, 300, 20, copies=150)
    out = whitening.whiten(make(spark, rows).repartition(5), weights=weights)
    check(out.collect(), brute(rows, weights))


def test_fewer_dimensions_and_edges(spark):
    good = vectors(2, 60, 5)
    bad = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [1.0, 2.0])]
    rows = good + bad + [(None, good[0][1]), (70, good[0][1]), (70, good[0][1])]
    found = whitening.whiten(make(spark, rows).repartition(3)).collect()
    check(found, brute(rows))
    assert max(r.component for r in found) == 5
    assert not {r.vec_id for r in found} & {b[0] for b in bad}


def test_flat_direction(spark):
    """A direction without variance has no component."""
    rows = [(i, [float(i % 7), float(i % 5), 2.5]) for i in range(40)]
    found = whitening.whiten(make(spark, rows)).collect()
    check(found, brute(rows))
    assert {r.component for r in found} == {1, 2}


def test_large_deviations(spark):
    rows = [(1, [3e9, 0.5]), (2, [-3e9, 1.0]), (3, [1e30, 0.0]), (4, [0.0, 0.25])]
    found = whitening.whiten(make(spark, rows)).collect()
    assert {r.vec_id for r in found} == {1, 2, 3, 4}
    assert any(r.deviation is None for r in found)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_fit(spark, rows):
    out = whitening.whiten(make(spark, rows))
    assert out.collect() == []
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    check(whitening.whiten(table).collect(), brute(rows))
