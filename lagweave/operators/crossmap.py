"""All-to-all cross mapping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.functions.stats import corr
from lagweave.functions.validate import embedding_args
from lagweave.operators import kernels as K
from lagweave.operators.neighbors import nearest, pack, pairwise
from lagweave.operators.embedding import embed
from lagweave.operators.simplex import lookup, weigh
from lagweave.plans.ship import ship

#: Bytes of the series that a task holds as libraries and as targets, about.
LIB_BYTES, TARGET_BYTES = 4_000_000, 32_000_000


def tile_counts(n: int, longest: int, parallelism: int) -> tuple[int, int]:
    """(tiles of libraries, series of a tile of targets) for n series of at most so many steps.

    Every tile of libraries meets every tile of targets, so a series travels once for each tile of the other kind, not
    once for each series. Few series are cut finer, so that there is work for all tasks.
    """
    size = 4 * max(1, longest)
    per_tile = max(1, TARGET_BYTES // size)
    least = min(n, -(-2 * parallelism // max(1, -(-n // per_tile))))
    return max(-(-n * size // LIB_BYTES), least, 1), per_tile


def xmap(panel: DataFrame, dims: DataFrame, tau: int = 1, Tp: int = 0, strategy: str = "kernel") -> DataFrame:
    """(lib_sid, tgt_sid, E, rho): every series predicts every other with the embedding dimension of the target.

    dims has (sid, E). One table of neighbours serves all targets of the same E. The kernel form meets tiles of
    libraries with tiles of targets of one E; predictions are folded into the correlation and never stored.
    """
    embedding_args(1, tau, Tp)
    dims = dims.select("sid", F.col("E").cast("int").alias("E"))
    if strategy == "relational":
        es = sorted(r["E"] for r in dims.select("E").distinct().collect())  # at most E_max values
        out = None
        for E in es:
            lut = weigh(nearest(pairwise(embed(panel, E, tau, Tp, ahead=False), embed(panel, E, tau, Tp), E), E + 1), ["sid", "i"])
            targets = panel.join(dims.where(F.col("E") == E), "sid").select(F.col("sid").alias("tgt_sid"), "t", "v")
            pred = lookup(lut.withColumnRenamed("sid", "lib_sid"), targets, ["lib_sid", "tgt_sid", "i"])
            pred = pred.withColumn("t", F.col("i") + (E - 1) * tau + Tp).join(targets, ["tgt_sid", "t"])
            one = pred.groupBy("lib_sid", "tgt_sid").agg(corr("pred", "v").alias("rho")).select("lib_sid", "tgt_sid", F.lit(E).alias("E"), "rho")
            out = one if out is None else out.unionByName(one)
        return out
    series = pack(panel)
    n, longest = series.agg(F.count("*"), F.coalesce(F.max(F.size("vs")), F.lit(0))).first()
    lib_tiles, per_tile = tile_counts(n, longest, panel.sparkSession.sparkContext.defaultParallelism)
    sizes = dims.groupBy("E").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_tile)).cast("int").alias("_n"))  # at most E_max rows
    libs = series.select(F.col("sid").alias("lib_sid"), F.col("vs").alias("xs"), F.pmod(F.xxhash64("sid"), F.lit(lib_tiles)).cast("int").alias("_l"))
    libs = libs.join(F.broadcast(sizes.select(F.col("E").alias("_e"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b"))))
    targets = series.join(dims, "sid").join(F.broadcast(sizes), "E")
    targets = targets.select(F.col("sid").alias("tgt_sid"), F.col("vs").alias("ys"), F.col("E").alias("_e2"), F.pmod(F.xxhash64("sid"), F.col("_n")).cast("int").alias("_b2"), F.explode(F.sequence(F.lit(0), F.lit(lib_tiles - 1))).alias("_l2"))

    ship(panel.sparkSession)
    def run(libraries: pd.DataFrame, goals: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(libraries) and len(goals):
            E = int(goals["_e2"].iloc[0])
            span, ys = (E - 1) * tau, [np.asarray(v, dtype=float) for v in goals["ys"]]
            for sid, vs in libraries[["lib_sid", "xs"]].itertuples(index=False):
                x = np.asarray(vs, dtype=float)
                vectors = K.delay_matrix(x, E, tau)
                dist, j = K.neighbours(vectors, vectors[: max(0, len(x) - span - Tp)], E + 1)
                w, at = K.weights(dist), j + span + Tp
                out += [(sid, t, E, K.correlation(K.forecast(w, at, y), y[span + Tp :])) for t, y in zip(goals["tgt_sid"], ys)]
        return pd.DataFrame(out, columns=["lib_sid", "tgt_sid", "E", "rho"]).astype({"lib_sid": str, "tgt_sid": str, "E": "int32", "rho": float})

    mapped = libs.groupBy("_l", "_e", "_b").cogroup(targets.groupBy("_l2", "_e2", "_b2")).applyInPandas(run, "lib_sid string, tgt_sid string, E int, rho double")
    return mapped.withColumn("rho", F.nanvl("rho", F.lit(None).cast("double")))


def rho_diff(mapped: DataFrame, correlations: DataFrame) -> DataFrame:
    """(lib_sid, tgt_sid, rhodiff): cross-map skill less the absolute correlation."""
    c = correlations.select("lib_sid", "tgt_sid", F.col("rho").alias("_c"))
    return mapped.join(c, ["lib_sid", "tgt_sid"]).select("lib_sid", "tgt_sid", (F.col("rho") - F.abs("_c")).alias("rhodiff"))
