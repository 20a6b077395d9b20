"""Nearest neighbours of every prediction row among the library rows of the same series.

Two physical forms give the same rows. ``kernel``, the default, ranks in NumPy: a task takes a block of prediction rows
and the series' library, and no pair ever becomes a Spark row. ``relational`` joins on the series and ranks with
row_number, which Catalyst turns into a map-side WindowGroupLimit; all pairs of a series meet in one task, so it is for
short series and for checking the other form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagweave.functions.validate import require
from lagweave.operators import kernels as K
from lagweave.operators.embedding import embed
from lagweave.plans.ship import ship

FLT_MAX = K.FLT_MAX
#: Prediction rows that one kernel task takes at a time.
PRED_BLOCK = 2048


def mask_degenerate(d2: Column) -> Column:
    """Exact duplicates (the row itself among them) become the last resort instead of the nearest neighbour."""
    return F.when(d2 == 0, F.lit(FLT_MAX)).otherwise(d2)


def pairwise(pred: DataFrame, lib: DataFrame, dims: int, on: list[str] | None = None, mask: bool = True) -> DataFrame:
    """(on..., i, j, idx, d2) for all pairs within a series. The sum is spelled out so that code generation covers it."""
    on = ["sid"] if on is None else on
    p = pred.select(*on, F.col("j").alias("i"), F.col("emb").alias("_p"))
    q = lib.select(*on, "j", "idx", F.col("emb").alias("_q"))
    pairs = p.join(q, on)
    total = None
    for e in range(dims):
        d = F.col("_p")[e] - F.col("_q")[e]
        total = d * d if total is None else total + d * d
    return pairs.select(*on, "i", "j", "idx", (mask_degenerate(total) if mask else total).alias("d2"))


def nearest(pairs: DataFrame, k: int | None, on: list[str] | None = None) -> DataFrame:
    """(on..., i, rk, j, idx, dist): the k least by (d2, j); all of them, ranked, for k None (full sort)."""
    on = ["sid"] if on is None else on
    ranked = pairs.withColumn("rk", F.row_number().over(Window.partitionBy(*on, "i").orderBy("d2", "j")))
    ranked = ranked if k is None else ranked.where(F.col("rk") <= k)
    return ranked.select(*on, "i", "rk", "j", "idx", F.sqrt("d2").alias("dist"))


def pack(panel: DataFrame, name: str = "vs") -> DataFrame:
    """One row (sid, vs) per series, its values in the order of time, as the float32 that they are."""
    return panel.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"].cast("float")).alias(name))


def starts(panel: DataFrame, span: int, block: int) -> DataFrame:
    """(sid, a): the first prediction row of each block of each series."""
    n = F.count("*").cast("int") - span
    return panel.groupBy("sid").agg(n.alias("_n")).where("_n > 0").select("sid", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(block))).alias("a"))


def blocks(pred: DataFrame, lib: DataFrame, span: int, block: int) -> DataFrame:
    """(sid, ls, a, ps): for each block of prediction rows its stretch of the series and the whole library."""
    tasks = starts(pred, span, block).join(pack(pred, "ps"), "sid").join(pack(lib, "ls"), "sid")
    return tasks.select("sid", "ls", "a", F.slice("ps", F.col("a") + 1, F.lit(block + span)).alias("ps"))


def nearest_kernel(lib: DataFrame, pred: DataFrame, E: int, tau: int, Tp: int, k: int, weighted: bool = False) -> DataFrame:
    span = (E - 1) * tau
    tasks = blocks(pred, lib, span, PRED_BLOCK)
    tasks = tasks.repartition(tasks.sparkSession.sparkContext.defaultParallelism, "sid", "a")

    ship(tasks.sparkSession)
    def run(batches):
        for pdf in batches:
            for sid, ls, a, ps in pdf.itertuples(index=False):
                vectors = K.delay_matrix(np.asarray(ps, dtype=float), E, tau)
                rows = K.delay_matrix(np.asarray(ls, dtype=float), E, tau)[: len(ls) - span - Tp]
                if not len(vectors) or not len(rows):
                    continue
                dist, j = K.neighbours(vectors, rows, k)
                m = j.shape[1]
                out = {"sid": sid, "i": np.repeat(np.arange(a, a + len(vectors), dtype=np.int32), m), "rk": np.tile(np.arange(1, m + 1, dtype=np.int32), len(vectors)), "j": j.ravel().astype(np.int32), "idx": (j.ravel() + span + Tp).astype(np.int32), "dist": dist.ravel()}
                yield pd.DataFrame(out | ({"w": K.weights(dist).ravel()} if weighted else {}))

    return tasks.mapInPandas(run, "sid string, i int, rk int, j int, idx int, dist double" + (", w double" if weighted else ""))


#: Vectors of a tile.
TILE = 1024


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(i, rk, j, dist) from ready-made vectors (j, emb): the k least by (d2, j) of each query.

    Tiles of queries meet tiles of vectors, and a task gives out the k least of each query; the k least of these remain.
    """
    def tiles(df: DataFrame) -> int:
        return max(1, -(-df.count() // TILE))

    na, nb = tiles(queries), tiles(vectors)
    slot = lambda n: F.pmod(F.xxhash64("j"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("j").alias("i"), F.col("emb").alias("p"), slot(na).alias("_a"), every(nb).alias("_b"))
    right = vectors.select(F.col("j").alias("v"), F.col("emb").alias("q"), every(na).alias("_a2"), slot(nb).alias("_b2"))

    ship(queries.sparkSession)
    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"i": pd.Series(dtype="int32"), "j": pd.Series(dtype="int32"), "d2": pd.Series(dtype=float)})
        if len(asked) and len(known):
            known = known.sort_values("v")
            d2 = K.squared_distances(np.stack(asked["p"]), np.stack(known["q"]))
            at = K.smallest(d2, min(k, len(known)))
            out = pd.DataFrame({"i": np.repeat(asked["i"].to_numpy(), at.shape[1]), "j": known["v"].to_numpy()[at.ravel()], "d2": np.take_along_axis(d2, at, 1).ravel()})
        return out

    found = left.groupBy("_a", "_b").cogroup(right.groupBy("_a2", "_b2")).applyInPandas(run, "i int, j int, d2 double")
    ranked = found.withColumn("rk", F.row_number().over(Window.partitionBy("i").orderBy("d2", "j"))).where(F.col("rk") <= k)
    return ranked.select("i", "rk", "j", F.sqrt("d2").alias("dist"))


def knn(lib: DataFrame, pred: DataFrame, E: int, tau: int = 1, Tp: int = 0, top_k: int | None = None, strategy: str = "kernel") -> DataFrame:
    """(sid, i, rk, j, idx, dist) for every series that both panels have."""
    require(top_k is None or top_k > 0, "top_k must be greater than zero")
    k = top_k or E + 1
    if strategy == "kernel":
        return nearest_kernel(lib, pred, E, tau, Tp, k)
    return nearest(pairwise(embed(pred, E, tau, Tp, ahead=False), embed(lib, E, tau, Tp), E), k)
