"""The library's functions for arrays: they check arguments, run the panel operators and bring small results back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lagweave.functions import validate as V
from lagweave.functions.sampling import draw_libraries
from lagweave.operators import convergent, crossmap, dimension
from lagweave.operators import simplex as S
from lagweave.operators.smap import smap as smap_op
from lagweave.plans.config import session
from lagweave.sources.panel import from_arrays


def _f32(x) -> np.ndarray:
    return np.asarray(x, dtype=np.float32).astype(float)


def _panel(x: np.ndarray, sid: str = "x"):
    return from_arrays(session(), {sid: x} if x.ndim == 1 else {f"{sid}{k}": x[:, k] for k in range(x.shape[1])})


def _values(df, n: int) -> np.ndarray:
    pdf = df.select("i", "pred").toPandas().sort_values("i")
    out = np.full(n, np.nan)
    out[pdf["i"].to_numpy()] = pdf["pred"].to_numpy(dtype=float)
    return out


def edim(timeseries, E_max: int = 20, tau: int = 1, Tp: int = 1) -> int:
    """The embedding dimension up to E_max that predicts the series best."""
    x = _f32(timeseries)
    V.require(E_max > 0, "E_max must be greater than zero")
    V.embedding_args(1, tau, Tp)
    V.knn_args(len(x), len(x), E_max, tau, Tp, E_max + 1)
    return dimension.optimal_e(_panel(x), E_max, tau, Tp).first()["E"]


def simplex(lib, pred, *, target=None, E: int = 1, tau: int = 1, Tp: int = 1) -> np.ndarray:
    """Simplex projection; 2-D lib and pred are blocks of series (columns). target defaults to lib."""
    lib, pred = _f32(lib), _f32(pred)
    V.require(lib.ndim == pred.ndim, "lib and pred must have same dimensionality")
    goal = lib if target is None else _f32(target)
    V.require(target is None or goal.ndim == 1, "target must be a 1D array")
    V.require(len(lib) <= len(goal), "lib must have no more time steps than target")
    V.require(lib.ndim in (1, 2), "lib and pred must be 1D or 2D arrays")
    V.knn_args(len(lib), len(pred), E, tau, Tp, E + 1)
    n = len(pred) - (E - 1) * tau
    if lib.ndim == 1:
        return _values(S.simplex(_panel(lib), _panel(pred), _panel(goal), E, tau, Tp, strategy="kernel"), n)
    V.require(lib.shape[1] == pred.shape[1], "lib and pred must have same number of time series")
    V.require(goal.ndim == 1, "target must be a 1D array")
    return _values(S.simplex_block(_panel(lib), _panel(pred), _panel(goal), [f"x{k}" for k in range(lib.shape[1])], E, tau, Tp), n)


def _rho(got: np.ndarray, truth: np.ndarray) -> float:
    n = min(len(got), len(truth))
    pairs = session().createDataFrame([(got[:n].tolist(), truth[:n].tolist())], "p array<double>, a array<double>")
    pairs = pairs.select(F.explode(F.arrays_zip("p", "a")).alias("z")).select(F.col("z.p").alias("pred"), F.col("z.a").alias("actual"))
    rho = S.skill(pairs, []).first()["rho"]
    return float("nan") if rho is None else rho


def eval_simplex(lib, pred, *, target=None, E: int = 1, tau: int = 1, Tp: int = 1) -> float:
    """Correlation of the projection with pred, or with target if one is given."""
    V.require(np.ndim(lib) == np.ndim(pred) == 1, "lib and pred must be 1D arrays")
    return _rho(simplex(lib, pred, target=target, E=E, tau=tau, Tp=Tp), _f32(pred if target is None else target)[(E - 1) * tau + Tp :])


def smap(lib, pred, *, target=None, E: int = 1, tau: int = 1, Tp: int = 1, theta: float = 1.0) -> np.ndarray:
    """S-Map; target defaults to pred."""
    lib, pred = _f32(lib), _f32(pred)
    goal = pred if target is None else _f32(target)
    V.require(lib.ndim == pred.ndim == goal.ndim == 1, "lib and pred must be 1D arrays")
    V.require(len(lib) == len(goal), "lib and target must have same number of time steps")
    V.knn_args(len(lib), len(pred), E, tau, Tp, E + 1)
    return _values(smap_op(_panel(lib), _panel(pred), _panel(goal), E, tau, Tp, theta), len(pred) - (E - 1) * tau)


def eval_smap(lib, pred, *, target=None, E: int = 1, tau: int = 1, Tp: int = 1, theta: float = 1.0) -> float:
    """Correlation of the S-Map prediction with target (default: pred)."""
    return _rho(smap(lib, pred, target=target, E=E, tau=tau, Tp=Tp, theta=theta), _f32(pred if target is None else target)[(E - 1) * tau + Tp :])


def _ccm(lib, target, lib_sizes, sample, E, tau, Tp, seed, accuracy, naive) -> list[float]:
    lib, target, sizes = _f32(lib), _f32(target), [int(s) for s in lib_sizes]
    V.embedding_args(E, tau, Tp)
    V.ccm_args(len(lib), sizes, sample, accuracy)
    V.require(len(lib) == len(target), "lib and target must have same number of time steps")
    if not sizes:
        return []
    n_lib = len(lib) - (E - 1) * tau - Tp
    V.knn_args(len(lib), len(lib), E, tau, Tp, E + 1)
    universe = n_lib if naive else len(lib)
    V.require(not naive or max(sizes) <= n_lib, "All lib_sizes must not exceed lib size")
    keep = None if naive else convergent.candidates_kept(len(lib), n_lib, sizes, E, accuracy)
    drawn = draw_libraries(universe, sizes, sample, seed)
    trials = convergent.ccm_kernel(session(), lib, target, drawn, E, tau, Tp, keep, by_row=naive)
    found = {r["lib_size"]: r["rho"] for r in convergent.mean_skill(trials).collect()}  # a row per library size
    return [float("nan") if found[s] is None else found[s] for s in sizes]


def ccm(lib, target, *, lib_sizes=(), sample: int = 1, E: int = 1, tau: int = 1, Tp: int = 0, seed: int = 0, accuracy: float = 1.0) -> list[float]:
    """Mean skill at each library size."""
    return _ccm(lib, target, lib_sizes, sample, E, tau, Tp, seed, accuracy, False)


def ccm_naive(lib, target, *, lib_sizes=(), sample: int = 1, E: int = 1, tau: int = 1, Tp: int = 0, seed: int = 0) -> list[float]:
    """As ccm, but each sample is of library rows."""
    return _ccm(lib, target, lib_sizes, sample, E, tau, Tp, seed, 1.0, True)


def xmap(dataset, edims, tau: int = 1, Tp: int = 0) -> np.ndarray:
    """Matrix of cross-map skill: row = library, column = target."""
    data = _f32(dataset)
    V.require(data.ndim == 2, "Expected a 2D array")
    V.require(data.shape[1] == len(edims), "Number of time series must match the number of embedding dimensions")
    V.require(all(e > 0 for e in edims), "All embedding dimensions must be larger than zero")
    V.knn_args(len(data), len(data), max(edims), tau, Tp, max(edims) + 1)
    dims = session().createDataFrame([(f"x{k}", int(e)) for k, e in enumerate(edims)], "sid string, E int")
    out = np.full((data.shape[1],) * 2, np.nan)
    for r in crossmap.xmap(_panel(data), dims, tau, Tp).collect():
        out[int(r["lib_sid"][1:]), int(r["tgt_sid"][1:])] = np.nan if r["rho"] is None else r["rho"]
    return out
