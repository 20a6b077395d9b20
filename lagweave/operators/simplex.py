"""Simplex projection: weights, lookup, prediction, skill."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagweave.functions.stats import corr
from lagweave.functions.validate import embedding_args, require
from lagweave.operators import kernels as K
from lagweave.operators.embedding import embed_block
from lagweave.operators.kernels import MIN_WEIGHT
from lagweave.operators.neighbors import PRED_BLOCK, blocks, knn, nearest, nearest_kernel, pack, pairwise, starts
from lagweave.plans.ship import ship


def weigh(neighbours: DataFrame, on: list[str]) -> DataFrame:
    """Neighbours with w: exponential in distance over the least distance, floored, and of sum 1 for each row."""
    row = Window.partitionBy(*on)
    least = F.min("dist").over(row)
    raw = F.when(least > 0, F.exp(-F.col("dist") / least)).otherwise(F.when(F.col("dist") > 0, 0.0).otherwise(1.0))
    floored = neighbours.withColumn("_w", F.greatest(raw, F.lit(MIN_WEIGHT)))
    return floored.withColumn("w", F.col("_w") / F.sum("_w").over(row)).drop("_w")


def lookup(lut: DataFrame, target: DataFrame, on: list[str], join: list[str] | None = None) -> DataFrame:
    """(on..., pred): the weighted sum of target values at the neighbours' time steps.

    join lists columns that target shares with the table besides the time step; with a target panel of many
    series that has none, every series is predicted and `on` should hold its name.
    """
    join = join or []
    t = target.withColumnRenamed("t", "idx").withColumnRenamed("v", "_v")
    return lut.join(t, [*join, "idx"]).groupBy(*on).agg(F.sum(F.col("w") * F.col("_v")).alias("pred"))


def with_actual(pred: DataFrame, observed: DataFrame, span: int, Tp: int, join: list[str]) -> DataFrame:
    """Adds t, the step that is predicted, and actual, NULL past the end of what was observed."""
    o = observed.select(*join, F.col("t"), F.col("v").alias("actual"))
    return pred.withColumn("t", F.col("i") + span + Tp).join(o, [*join, "t"], "left")


def neighbour_weights(lib: DataFrame, pred: DataFrame, E: int = 1, tau: int = 1, Tp: int = 1, top_k: int | None = None, strategy: str = "kernel") -> DataFrame:
    """(sid, i, rk, j, idx, dist, w): the table from which every target of a series is predicted."""
    embedding_args(E, tau, Tp)
    if strategy == "kernel":
        return nearest_kernel(lib, pred, E, tau, Tp, top_k or E + 1, weighted=True)
    return weigh(knn(lib, pred, E, tau, Tp, top_k or E + 1, strategy), ["sid", "i"])


#: Bytes of the target series that one task looks up together, about.
TILE_BYTES = 32_000_000


def projected(lib: DataFrame, pred: DataFrame, targets: DataFrame, E: int, tau: int, Tp: int, tiles: int = 1) -> DataFrame:
    """(lib_sid, sid, i, pred) of every target (lib_sid, sid, ys).

    Neighbours are found and looked up in one task, and none of them becomes a row; one table of neighbours serves all
    targets of a tile. A task holds a block of prediction rows, the library and a tile of targets.
    """
    span = (E - 1) * tau
    left = blocks(pred, lib, span, PRED_BLOCK).withColumnRenamed("sid", "lib_sid").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    at = starts(pred, span, PRED_BLOCK).withColumnRenamed("sid", "lib_sid")
    right = targets.join(at, "lib_sid").select(F.col("lib_sid").alias("_s"), F.col("a").alias("_a"), F.pmod(F.xxhash64("sid"), F.lit(tiles)).cast("int").alias("_t"), F.col("sid").alias("tgt_sid"), F.col("ys").alias("goal"))

    ship(lib.sparkSession)
    def run(block: pd.DataFrame, goals: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"lib_sid": pd.Series(dtype=str), "sid": pd.Series(dtype=str), "i": pd.Series(dtype="int32"), "pred": pd.Series(dtype=float)})]
        for sid, a, ls, ps in block[["lib_sid", "a", "ls", "ps"]].itertuples(index=False):
            vectors = K.delay_matrix(np.asarray(ps, dtype=float), E, tau)
            rows = K.delay_matrix(np.asarray(ls, dtype=float), E, tau)[: max(0, len(ls) - span - Tp)]
            if not len(vectors) or not len(rows):
                continue
            dist, j = K.neighbours(vectors, rows, E + 1)
            w, idx = K.weights(dist), j + span + Tp
            for name, ys in goals[["tgt_sid", "goal"]].itertuples(index=False):
                require(len(ys) >= len(ls), "lib must have no more time steps than target")
                out.append(pd.DataFrame({"lib_sid": sid, "sid": name, "i": np.arange(a, a + len(vectors), dtype=np.int32), "pred": K.forecast(w, idx, np.asarray(ys, dtype=float))}))
        return pd.concat(out[1:] or out, ignore_index=True)

    return left.groupBy("lib_sid", "a", "_b").cogroup(right.groupBy("_s", "_a", "_t")).applyInPandas(run, "lib_sid string, sid string, i int, pred double")


def lookup_targets(lib: DataFrame, pred: DataFrame, targets: DataFrame, E: int = 1, tau: int = 1, Tp: int = 1) -> DataFrame:
    """(sid, i, pred): the neighbours of a panel of one series look up every series of targets at once."""
    embedding_args(E, tau, Tp)
    steps = targets.count()
    name = lib.select(F.col("sid").alias("lib_sid")).distinct()  # one row
    each = pack(targets, "ys").crossJoin(F.broadcast(name))
    return projected(lib, pred, each, E, tau, Tp, max(1, -(-4 * steps // TILE_BYTES))).select("sid", "i", "pred")


def simplex(lib: DataFrame, pred: DataFrame, target: DataFrame | None = None, E: int = 1, tau: int = 1, Tp: int = 1, observed: DataFrame | None = None, strategy: str = "kernel") -> DataFrame:
    """(sid, i, t, pred, actual) for every series; target (default: lib) and observed (default: pred) hold the same sids."""
    embedding_args(E, tau, Tp)
    goal = lib if target is None else target
    if strategy == "kernel":
        out = projected(lib, pred, pack(goal, "ys").withColumn("lib_sid", F.col("sid")), E, tau, Tp).select("sid", "i", "pred")
    else:
        out = lookup(neighbour_weights(lib, pred, E, tau, Tp, strategy=strategy), goal, ["sid", "i"], ["sid"])
    out = with_actual(out, pred if observed is None else observed, (E - 1) * tau, Tp, ["sid"])
    return out.select("sid", "i", "t", "pred", "actual")


def simplex_block(lib: DataFrame, pred: DataFrame, target: DataFrame, sids: list[str], E: int = 1, tau: int = 1, Tp: int = 1) -> DataFrame:
    """Multivariate form: the series `sids` of lib and pred as one block; target is a panel of one series. (i, t, pred)"""
    p, q = (embed_block(x, sids, E, tau, Tp, ahead) for x, ahead in ((pred, False), (lib, True)))
    lut = weigh(nearest(pairwise(p, q, E * len(sids)), E + 1), ["sid", "i"])
    out = lookup(lut, target.select("t", "v"), ["i"])
    return out.select("i", (F.col("i") + (E - 1) * tau + Tp).alias("t"), "pred")


def skill(prediction: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., rho) over the rows that have an observation."""
    return prediction.groupBy(*(["sid"] if by is None else by)).agg(corr("pred", "actual").alias("rho"))
