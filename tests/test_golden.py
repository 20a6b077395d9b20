"""Results that must not change: published ones, through the public functions."""

import numpy as np
import pytest

import lagweave as lw
from lagweave.operators import neighbors
from lagweave.sources import panel as P
from tests import golden as G

CLOSE = {"rel": 2e-5, "abs": 1e-6}


def test_ccm_with_the_seeded_stream(spark):
    for x, y, want in ((G.ANCHOVY, G.TEMPERATURE, G.CCM_ANCHOVY), (G.TEMPERATURE, G.ANCHOVY, G.CCM_TEMPERATURE)):
        assert lw.ccm(x, y, lib_sizes=G.CCM_SIZES, sample=100, E=3, tau=1, Tp=0, seed=42) == pytest.approx(want, **CLOSE)


def test_one_to_one_cross_map(spark):
    x, y = G.ANCHOVY[:-2], G.TEMPERATURE[:-2]
    assert lw.simplex(x, x, target=y, E=3, tau=1, Tp=1) == pytest.approx(G.CROSS_MAPPED, **CLOSE)


@pytest.mark.parametrize("strategy", ["kernel", "relational"])
@pytest.mark.parametrize("E", [2, 3, 4, 5])
def test_neighbours(spark, E, strategy):
    p = P.from_arrays(spark, {"x": G.SHORT})
    got = neighbors.knn(p, p, E, 1, 0, 4, strategy).toPandas().sort_values(["i", "rk"])["dist"].to_numpy().reshape(-1, 4)
    assert got == pytest.approx(G.SHORT_NEIGHBOURS[E], **CLOSE)


def test_simplex(spark):
    lib, pred = G.TENT[:100], G.TENT[98:198]
    assert lw.simplex(lib, pred, E=3, tau=1, Tp=1) == pytest.approx(G.TENT_PREDICTED, rel=1e-2, abs=1e-4)


def test_forms_of_simplex_agree(spark):
    from lagweave.operators.simplex import lookup_targets, simplex

    rng = np.random.default_rng(1)
    p = P.from_arrays(spark, {"a": rng.normal(size=90), "b": rng.integers(0, 3, 70), "c": rng.normal(size=70)})
    a, b = (simplex(p, p, None, 2, 1, 1, strategy=s).toPandas().sort_values(["sid", "i"], ignore_index=True) for s in ("kernel", "relational"))
    assert a[["sid", "i", "t"]].equals(b[["sid", "i", "t"]]) and a["pred"].to_numpy() == pytest.approx(b["pred"].to_numpy()) and a["actual"].isna().equals(b["actual"].isna())
    lib = P.pick(p, "b")
    got = lookup_targets(lib, lib, p, 2, 1, 1).toPandas()
    own = a[a.sid == "b"].sort_values("i")["pred"].to_numpy()
    assert set(got.sid) == {"a", "b", "c"} and got[got.sid == "b"].sort_values("i")["pred"].to_numpy() == pytest.approx(own)
