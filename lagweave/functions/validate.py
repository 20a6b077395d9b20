"""Argument checks shared by every operator."""

from __future__ import annotations


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def embedding_args(E: int, tau: int, Tp: int = 0) -> None:
    require(E > 0, "E must be greater than zero")
    require(tau > 0, "tau must be greater than zero")
    require(Tp >= 0, "Tp must be greater or equal to zero")


def knn_args(n_lib: int, n_pred: int, E: int, tau: int, Tp: int, top_k: int) -> None:
    """n_lib and n_pred count time steps, not embedded rows."""
    embedding_args(E, tau, Tp)
    require(top_k > 0, "top_k must be greater than zero")
    span = (E - 1) * tau
    require(n_lib - span - Tp >= top_k, "lib size is too small")
    require(n_pred - span > 0, "pred size is too small")


def ccm_args(n: int, lib_sizes: list[int], sample: int, accuracy: float = 1.0) -> None:
    require(all(s > 0 for s in lib_sizes), "All lib_sizes must be larger than zero")
    require(all(s <= n for s in lib_sizes), "All lib_sizes must not exceed lib size")
    require(sample > 0, "sample must be larger than zero")
    require(0 <= accuracy <= 1, "accuracy must be between zero and one")
