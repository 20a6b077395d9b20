"""Correlation and error aggregates as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the series of a tile, about.
TILE_BYTES = 16_000_000


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation; NULL where either side has no variance (no error under ANSI)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(scale, F.lit(0.0)))


def mae(x: str, y: str) -> Column:
    return F.avg(F.abs(F.col(x) - F.col(y)))


def mse(x: str, y: str) -> Column:
    return F.avg((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)))


def corr_against(panel: DataFrame, sid: str) -> DataFrame:
    """Correlation of one series with every series: (sid, rho). The two are cut to the shorter one by the join on t."""
    one = panel.where(F.col("sid") == sid).select("t", F.col("v").alias("x"))
    return panel.join(one, "t").groupBy("sid").agg(corr("x", "v").alias("rho"))


def corr_matrix(panel: DataFrame, strategy: str = "kernel") -> DataFrame:
    """All ordered pairs of series: (lib_sid, tgt_sid, rho), a pair cut to the shorter one.

    kernel: tiles of series meet tiles of series, and series of equal length are one matrix product. relational: a join
    on the time step, which makes a row for each pair and step; for few series.
    """
    if strategy == "relational":
        a = panel.select(F.col("sid").alias("lib_sid"), "t", F.col("v").alias("x"))
        b = panel.select(F.col("sid").alias("tgt_sid"), "t", F.col("v").alias("y"))
        return a.join(b, "t").groupBy("lib_sid", "tgt_sid").agg(corr("x", "y").alias("rho"))
    from lagweave.operators import kernels as K
    from lagweave.operators.neighbors import pack
    from lagweave.plans.ship import ship

    series = pack(panel)
    n, longest = series.agg(F.count("*"), F.coalesce(F.max(F.size("vs")), F.lit(0))).first()
    tiles = max(1, -(-n * 4 * longest // TILE_BYTES))
    tile = F.pmod(F.xxhash64("sid"), F.lit(tiles)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = series.select(F.col("sid").alias("lib_sid"), F.col("vs").alias("xs"), tile.alias("_a"), other.alias("_b"))
    right = series.select(F.col("sid").alias("tgt_sid"), F.col("vs").alias("ys"), other.alias("_a2"), tile.alias("_b2"))

    ship(panel.sparkSession)
    def run(xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        rows, cols = [np.asarray(v, dtype=float) for v in xs["xs"]], [np.asarray(v, dtype=float) for v in ys["ys"]]
        rho = np.full((len(rows), len(cols)), np.nan)
        n, m = np.array([len(v) for v in rows]), np.array([len(v) for v in cols])
        for size in np.union1d(n, m):
            i, j = np.flatnonzero(n == size), np.flatnonzero(m == size)
            if size and len(i) and len(j):
                rho[np.ix_(i, j)] = np.stack([K.standardised(rows[k]) for k in i]) @ np.stack([K.standardised(cols[k]) for k in j]).T
        for i, j in zip(*np.nonzero(n[:, None] != m[None, :])):
            rho[i, j] = K.correlation(rows[i], cols[j])
        return pd.DataFrame({"lib_sid": np.repeat(xs["lib_sid"].to_numpy(dtype=object), len(ys)), "tgt_sid": np.tile(ys["tgt_sid"].to_numpy(dtype=object), len(xs)), "rho": rho.ravel()})

    found = left.groupBy("_a", "_b").cogroup(right.groupBy("_a2", "_b2")).applyInPandas(run, "lib_sid string, tgt_sid string, rho double")
    return found.withColumn("rho", F.nanvl("rho", F.lit(None).cast("double")))


def errors_between(panel: DataFrame, x: str, y: str) -> DataFrame:
    """One row (corr, mae, mse) for two series, cut to the shorter one."""
    a = panel.where(F.col("sid") == x).select("t", F.col("v").alias("x"))
    b = panel.where(F.col("sid") == y).select("t", F.col("v").alias("y"))
    return a.join(b, "t").agg(corr("x", "y").alias("corr"), mae("x", "y").alias("mae"), mse("x", "y").alias("mse"))
