"""Kernels and tiles against plain forms."""

import numpy as np
import pytest

from lagweave.functions import stats
from lagweave.operators import convergent, crossmap, kernels as K
from lagweave.functions.sampling import draw_libraries
from lagweave.sources import panel as P


def test_stacked_least_squares():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(30, 20, 4)), rng.normal(size=(30, 20))
    a[3, :, 2] = a[3, :, 1]  # of deficient rank
    a[4] = 0
    for x, y, got in zip(a, b, K.solve_rows(a, b)):
        assert got == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0], abs=1e-8)


def test_local_fits_in_batches(monkeypatch):
    x = np.sin(np.arange(120) ** 1.3) + np.repeat(np.arange(12) % 2, 10)
    want = K.local_linear(x, x, K.delay_matrix(x, 3, 1), 3, 1, 1, 2.0)
    monkeypatch.setattr(K, "BLOCK_CELLS", 1000)
    assert K.local_linear(x, x, K.delay_matrix(x, 3, 1), 3, 1, 1, 2.0) == pytest.approx(want)
    flat = np.ones(10)
    assert np.isnan(K.local_linear(flat, flat, K.delay_matrix(flat, 2, 1), 2, 1, 1, 1.0)).all()


def rows(df):
    return {(r["lib_sid"], r["tgt_sid"]): r["rho"] for r in df.collect()}


def test_tiles(spark, monkeypatch):
    """Every pair once, whatever the tiles; series of unequal length and without variance among them."""
    rng = np.random.default_rng(8)
    data = {f"s{k}": rng.normal(size=60).cumsum() for k in range(9)} | {"flat": np.zeros(60)}
    p = P.from_arrays(spark, data)
    dims = spark.createDataFrame([(s, 1 + k % 3) for k, s in enumerate(data)], "sid string, E int")
    whole, corr = rows(crossmap.xmap(p, dims)), rows(stats.corr_matrix(p))
    assert len(whole) == len(corr) == 100 and whole["s0", "flat"] is None and corr["s1", "flat"] is None
    plain = rows(crossmap.xmap(p, dims, strategy="relational"))
    for pair, rho in plain.items():
        assert whole[pair] == (None if rho is None else pytest.approx(rho, abs=1e-9))
    monkeypatch.setattr(crossmap, "TARGET_BYTES", 500)
    monkeypatch.setattr(crossmap, "LIB_BYTES", 300)
    monkeypatch.setattr(stats, "TILE_BYTES", 600)
    assert rows(crossmap.xmap(p, dims)) == whole
    assert rows(stats.corr_matrix(p)) == pytest.approx(corr)
    uneven = P.from_arrays(spark, {"a": np.arange(9) ** 2, "b": np.arange(20) % 7, "c": np.arange(20) % 5})
    assert rows(stats.corr_matrix(uneven)) == pytest.approx(rows(stats.corr_matrix(uneven, "relational")))


def test_tiles_do_not_multiply_the_data():
    """10,000 series of 10,000 steps: what travels to the tasks is far below a copy for each pair of series."""
    n = 10_000
    libs, per_tile = crossmap.tile_counts(n, n, 1000)
    targets = -(-n // per_tile)
    assert (n * targets + n * libs) * 4 * n < 0.1 * n * n * 8 * n


def test_ranking_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 80))
    drawn = draw_libraries(80, [10, 40], 4, 7)
    get = lambda: sorted(map(tuple, convergent.ccm_kernel(spark, x, y, drawn, 2, 1, 1).collect()))
    want = get()
    monkeypatch.setattr(K, "BLOCK_CELLS", 500)
    assert len(want) == 8 and all(a[:2] == b[:2] and a[2] == pytest.approx(b[2]) for a, b in zip(get(), want))


def test_csv(spark, tmp_path):
    """Lines in the file's order without an order column, over several splits; and lines as series."""
    lines = ["t,c1,c2,c10", *[f"{k},{k * 2},{k * 3}.5, {k * 10}" for k in range(4000)]]
    (tmp_path / "x.csv").write_text("\ufeff" + "\r\n".join(lines) + "\r\n\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = P.to_arrays(P.load_csv(spark, f"file://{tmp_path}/x.csv"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert list(got) == ["c1", "c10", "c2", "t"] and got["c10"].tolist() == [k * 10 for k in range(4000)] and got["t"].tolist() == list(range(4000))
    (tmp_path / "y.csv").write_text("\n".join(lines[:4]))
    for order in (None, "t"):
        P.csv_to_parquet(spark, f"{tmp_path}/y.csv", f"{tmp_path}/{order}", order, transpose_lines=True)
        got = P.to_arrays(P.load_parquet(spark, f"{tmp_path}/{order}"))
        assert got["row1"].tolist() == ([1, 2, 3.5, 10] if order is None else [2, 3.5, 10])
