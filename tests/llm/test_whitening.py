"""Whitening against numpy in extended precision, exact sums and planted spectra."""

import math

import numpy as np
import pytest

from cellarmark.llm import whitening
from cellarmark.session import shared_folder


def direct(vectors, k=8):
    """n, deviations, whitened up to sign, explained of integer vectors."""
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    d = n * x.astype(object) - sums
    centred = d.astype(np.longdouble) / n
    v = centred.T @ centred / n
    values, columns = np.linalg.eigh(v.astype(np.float64))
    values, columns = values[::-1], columns[:, ::-1]
    return n, (d * d).sum(axis=1), centred.astype(np.float64) @ columns[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def as_table(spark, rows, name):
    path = f"{shared_folder(spark)}/{name}"
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3.0) for r in rows], "vec_id long, embedding array<float>, label int, vector string, i int, whitened double")
    frame.repartition(3).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return path


def compare(spark, path, vectors_by_id, k):
    got = whitening.op11_embedding_whitening(spark, path).toPandas()
    ids = sorted(vectors_by_id)
    n, deviation, white, explained = direct([vectors_by_id[i] for i in ids], k)
    assert (got["n"] == n).all() and len(got) == n * k
    assert got[got["component"] == 1].set_index("vec_id")["deviation"].loc[ids].tolist() == deviation.tolist()
    own = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(own * np.sign((own * white).sum(axis=0)) - white).max() < 1e-9
    assert np.abs(got.groupby("component")["explained"].first().to_numpy() / explained - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(spark, sf_dir, {r["vec_id"]: r["embedding"] for r in rows}, 8)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = {i: rng.normal(size=5).astype(np.float32).tolist() for i in range(30)}
    good[31] = good[30] = good[3]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [math.nan] * 5), (103, [math.inf, 1.0, 1.0, 1.0, 1.0]), (104, []), (105, [1.0] * 4), (106, [1e30, 0.0, 0.0, 0.0, 0.0]), (None, None)]
    compare(spark, as_table(spark, [*good.items(), *bad], "odd-vectors"), good, 5)


def test_repeated_and_null_ids(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (1, [2.0, 0.0]), (None, [3.0, 1.0])]
    got = whitening.op11_embedding_whitening(spark, as_table(spark, rows, "repeated-vectors")).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), c) for i, _ in rows for c in (1, 2))


def test_no_variance_and_no_rows(spark):
    flat = whitening.op11_embedding_whitening(spark, as_table(spark, [(i, [1.0, 2.0, 3.0]) for i in range(4)], "flat-vectors")).collect()
    assert len(flat) == 12 and all(r["whitened"] == 0 and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in flat)
    line = whitening.op11_embedding_whitening(spark, as_table(spark, [(i, [float(i), 2.0]) for i in range(4)], "line-vectors")).collect()
    assert {r["component"]: r["explained"] for r in line} == {1: pytest.approx(1), 2: pytest.approx(0)} and line[0]["identity_error"] < 1e-9
    assert whitening.op11_embedding_whitening(spark, as_table(spark, [], "no-vectors")).collect() == []
    assert whitening.op11_embedding_whitening(spark, as_table(spark, [(1, None)], "null-vectors")).collect() == []


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.integers(-(2**24), 2**24, 3)]) for i in range(50)]
    vectors = whitening.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    n, sums = whitening.exact_sums(vectors, 3)
    x = [[int(v) * 1024 + 100_000 for v in vector] for _, vector in rows]
    assert n == 50 and sums == [sum(column) for column in zip(*x)]
    products = whitening.exact_products(vectors, np.array([7, -3, 0]))
    y = [[a - c for a, c in zip(row, (7, -3, 0))] for row in x]
    assert products.tolist() == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
    got = whitening.fit(vectors).transform(vectors).collect()
    assert all(r["deviation"] is None for r in got)  # over 63 bits


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 1, 1, 0.1], list(np.linspace(1, 2, 48)), [3.0] * 16, [1, 1 + 1e-6, 1 - 1e-6, 1e-3, 1e-3 + 1e-9, 0], [1e6] * 3 + [1e6 * (1 + 1e-7)] * 3 + [1.0]])
def test_clustered_eigenvalues(spectrum):
    d = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(d) - q.T @ q) / 2
    a = q @ np.diag(np.array(spectrum, np.longdouble)) @ q.T
    values, x = whitening.eigen((a + a.T) / 2)
    assert np.abs(values - sorted(spectrum, reverse=True)).max() <= 1e-15 * max(spectrum)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-14
    assert np.abs(a @ x - x * values).max() < 1e-15 * max(spectrum)
