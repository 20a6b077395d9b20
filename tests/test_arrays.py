"""The array functions: small published results, error messages, and agreement of both physical forms."""

import numpy as np
import pytest

import lagweave as lw
from lagweave.functions.sampling import draw_libraries, neighbours_needed
from lagweave.operators import neighbors
from lagweave.operators import simplex as S
from lagweave.sources import panel as P

# The skill that the method publishes for a logistic map is near 1 at the true dimension.


@pytest.fixture(scope="module")
def chaos(spark):
    x = [0.4]
    for _ in range(299):
        x.append(3.8 * x[-1] * (1 - x[-1]))
    return np.array(x)


def test_simplex_and_edim(chaos):
    assert lw.eval_simplex(chaos[:150], chaos[150:], E=2) > 0.98
    assert 1 <= lw.edim(chaos, E_max=5) <= 3
    assert len(lw.simplex(chaos[:150], chaos[150:], E=3)) == 148


def test_smap_is_least_squares_at_theta_zero(chaos):
    x = chaos[:100].astype(np.float32).astype(float)
    got = lw.smap(x, x, E=2, theta=0.0)
    a = np.column_stack([np.ones(98), x[:98], x[1:99]])
    b = np.linalg.lstsq(a, x[2:100], rcond=None)[0]
    rows = np.column_stack([np.ones(99), x[:99], x[1:100]])
    assert got == pytest.approx(rows @ b, abs=1e-6)
    assert lw.eval_smap(x, x, E=2, theta=3.0) > lw.eval_smap(x, x, E=2, theta=0.0)


def test_ccm(chaos):
    x, y = chaos[:80], np.roll(chaos, 1)[:80] + 0.01 * chaos[:80]
    full = lw.ccm(x, y, lib_sizes=[80], E=3, seed=1)[0]
    assert full == pytest.approx(lw.eval_simplex(x, x, target=y, E=3, Tp=0), abs=1e-6)
    assert lw.ccm(x, y, lib_sizes=[20, 60], sample=5, E=2, seed=3) == lw.ccm(x, y, lib_sizes=[20, 60], sample=5, E=2, seed=3)
    assert lw.ccm(x, y, lib_sizes=[20, 60], sample=5, E=2, seed=3, accuracy=0.999) == pytest.approx(lw.ccm(x, y, lib_sizes=[20, 60], sample=5, E=2, seed=3), abs=0.05)
    assert lw.ccm_naive(x, y, lib_sizes=[60], sample=20, E=2, seed=3) == pytest.approx(lw.ccm(x, y, lib_sizes=[60], sample=20, E=2, seed=3), abs=0.1)
    assert lw.ccm(x, y, lib_sizes=[]) == []


def test_xmap(chaos):
    data = np.column_stack([chaos[:90], chaos[5:95]])
    rho = lw.xmap(data, [2, 3])
    assert rho.shape == (2, 2) and rho[0, 1] == pytest.approx(lw.eval_simplex(data[:, 0], data[:, 0], target=data[:, 1], E=3, Tp=0), abs=1e-6)


def test_kernel_equals_relational_with_ties(spark):
    p = P.from_arrays(spark, {"a": np.tile([0.0, 1.0, 1.0, 2.0], 12), "b": np.arange(40) % 7, "c": np.zeros(12)})
    a, b = (neighbors.knn(p, p, 2, 1, 1, 3, s).toPandas().sort_values(["sid", "i", "rk"], ignore_index=True) for s in ("relational", "kernel"))
    assert (a[["sid", "i", "rk", "j", "idx"]] == b[["sid", "i", "rk", "j", "idx"]]).all().all() and a["dist"].to_numpy() == pytest.approx(b["dist"].to_numpy())
    w = S.weigh(neighbors.knn(p, p, 2, 1, 1, 3), ["sid", "i"]).groupBy("sid", "i").sum("w").toPandas()["sum(w)"]
    assert w.to_numpy() == pytest.approx(np.ones(len(w)))


@pytest.mark.parametrize(
    ("call", "message"),
    [
        (lambda x: lw.simplex(x, x, E=0), "E must be greater than zero"), (lambda x: lw.simplex(x, x, tau=0), "tau must be greater than zero"), (lambda x: lw.simplex(x, x, Tp=-1), "Tp must be greater or equal to zero"),
        (lambda x: lw.simplex(x[:3], x, E=5), "lib size is too small"), (lambda x: lw.simplex(x, x[:2], E=5), "pred size is too small"), (lambda x: lw.simplex(x, x[:, None]), "lib and pred must have same dimensionality"),
        (lambda x: lw.smap(x, x[:9]), "lib and target must have same number of time steps"), (lambda x: lw.ccm(x, x, lib_sizes=[0]), "All lib_sizes must be larger than zero"), (lambda x: lw.ccm(x, x, lib_sizes=[999]), "All lib_sizes must not exceed lib size"),
        (lambda x: lw.ccm(x, x, lib_sizes=[5], sample=0), "sample must be larger than zero"), (lambda x: lw.ccm(x, x, lib_sizes=[5], accuracy=2), "accuracy must be between zero and one"), (lambda x: lw.xmap(x, [1]), "Expected a 2D array"),
        (lambda x: lw.xmap(x[:, None], [1, 2]), "Number of time series must match the number of embedding dimensions"), (lambda x: lw.xmap(x[:, None], [0]), "All embedding dimensions must be larger than zero"), (lambda x: lw.edim(x, E_max=0), "E_max must be greater than zero"),
    ],
)
def test_errors(chaos, call, message):
    with pytest.raises(ValueError, match=message):
        call(chaos[:40])


def test_sampling():
    drawn = draw_libraries(30, [5, 30], 3, 42)
    assert [len(d[2]) for d in drawn] == [5] * 3 + [30] * 3 and drawn == draw_libraries(30, [5, 30], 3, 42)
    assert neighbours_needed(3, 0.25, 0.01, 239) == 37


def test_panel_checks(spark, tmp_path):
    p = P.from_arrays(spark, {"a": np.arange(5)})
    P.check_panel(p)
    with pytest.raises(ValueError, match="gaps"):
        P.check_panel(p.where("t <> 2"))
    (tmp_path / "x.csv").write_text("u,v\n1,2\n3,4.5\n")
    assert P.to_arrays(P.load_csv(spark, str(tmp_path / "x.csv")))["v"].tolist() == [2.0, 4.5]
    with pytest.raises(ValueError, match="Failed to open file"):
        P.load_csv(spark, "/nowhere.csv")


def test_cli_and_stream(spark, tmp_path, chaos):
    from lagweave.cli import main
    from lagweave.streaming.reforecast import reforecast

    P.write_panel(P.from_arrays(spark, {"a": chaos[:60], "b": chaos[60:120]}), str(tmp_path / "in"))
    main([str(tmp_path / "in"), str(tmp_path / "out"), "-e", "3", "--rho-diff"])
    assert spark.read.parquet(str(tmp_path / "out/rhodiff")).count() == 4
    q = reforecast(spark.readStream.schema(P.PANEL).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "fc"), str(tmp_path / "cp"), E=2)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "fc")).count() == 2 * 59
