"""Principal eigenvectors by power iteration against a full decomposition."""

import numpy as np
import pytest

from drawlens.operators import features


def cells(spark, m):
    rows = [(i + 1, j + 1, float(m[i, j])) for i in range(len(m)) for j in range(i, len(m)) if m[i, j]]
    return spark.createDataFrame(rows, "i int, j int, x double")


def history(spark, seed, draws):
    r = np.random.default_rng(seed)
    own = [sorted(r.choice(np.arange(1, 81), 20, replace=False).tolist()) for _ in range(draws)]
    return own, spark.createDataFrame([(rn, 100 - rn, int(x)) for rn, nums in enumerate(own) for x in nums], "rn int, issue long, num int")


@pytest.mark.parametrize("top", [2, 9, 80])
def test_principal_equals_decomposition(spark, top):
    a = np.random.default_rng(top).standard_normal((top, top))
    m = a @ a.T
    got = np.array([r["x"] for r in features.principal(cells(spark, m), top=top).orderBy("num").collect()])
    v = np.linalg.eigh(m)[1][:, -1]
    assert np.allclose(got, v * np.sign(v[np.abs(v).argmax()]), atol=1e-7)


def test_empty_matrix_gives_zeros(spark):
    rows = features.principal(spark.createDataFrame([], "i int, j int, x double")).collect()
    assert sorted(r["num"] for r in rows) == list(range(1, 81)) and all(r["x"] == 0 for r in rows)


def test_one_cell_stands_alone(spark):
    rows = {r["num"]: r["x"] for r in features.principal(spark.createDataFrame([(3, 3, 5.0)], "i int, j int, x double")).collect()}
    assert rows[3] == 1 and sum(map(abs, rows.values())) == 1


def test_loadings_equal_those_of_centred_indicators(spark):
    own, h = history(spark, 4, 90)
    m = np.array([[x + 1 in nums for x in range(80)] for nums in own], float)[:60]
    got = np.array([r["pca"] for r in features.pca_loadings(h, 60).orderBy("num").collect()])
    v = np.linalg.svd(m - m.mean(0))[2][0]
    v *= np.sign(v[np.abs(v).argmax()])
    assert np.allclose(got, (v - v.min()) / (v.max() - v.min()), atol=2e-6)
    two = [r["pca"] for r in features.pca_loadings(h, 60, components=2).collect()]
    assert len(two) == 80 and min(two) == 0 and max(two) == 1


def test_centrality_equals_decomposition(spark):
    own, h = history(spark, 6, 40)
    m = np.zeros((80, 80))
    for rn, nums in enumerate(own):
        at = np.array(nums) - 1
        m[np.ix_(at, at)] += 0.97**rn
    np.fill_diagonal(m, 0)
    v = np.abs(np.linalg.eigh(m)[1][:, -1])
    got = np.array([r["cooc"] for r in features.cooccurrence_centrality(h).orderBy("num").collect()])
    assert np.allclose(got, (v - v.min()) / (v.max() - v.min()), atol=2e-6)
