"""Search for the embedding dimension."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.functions.validate import embedding_args, require
from lagweave.operators import kernels as K
from lagweave.operators.neighbors import pack
from lagweave.operators.simplex import simplex, skill
from lagweave.plans.ship import ship


def rho_by_dimension(panel: DataFrame, E_max: int = 20, tau: int = 1, Tp: int = 1, strategy: str = "kernel") -> DataFrame:
    """(sid, E, rho) for E = 1 .. E_max, each series against itself. A kernel task is one series and one E."""
    require(E_max > 0, "E_max must be greater than zero")
    embedding_args(1, tau, Tp)
    if strategy == "relational":
        return reduce(DataFrame.unionByName, [skill(simplex(panel, panel, None, E, tau, Tp, strategy="relational")).select("sid", F.lit(E).alias("E"), "rho") for E in range(1, E_max + 1)])
    tasks = pack(panel).withColumn("E", F.explode(F.sequence(F.lit(1), F.lit(E_max))))
    tasks = tasks.select("sid", "E", "vs").repartition(tasks.sparkSession.sparkContext.defaultParallelism, "sid", "E")

    ship(tasks.sparkSession)
    def run(batches):
        for pdf in batches:
            for sid, E, vs in pdf.itertuples(index=False):
                x, span = np.asarray(vs, dtype=float), (E - 1) * tau
                require(len(x) - span - Tp >= E + 1, "lib size is too small")
                vectors = K.delay_matrix(x, E, tau)
                dist, j = K.neighbours(vectors, vectors[: len(x) - span - Tp], E + 1)
                pred = K.forecast(K.weights(dist), j + span + Tp, x)
                yield pd.DataFrame({"sid": [sid], "E": [E], "rho": [K.correlation(pred, x[span + Tp :])]}).astype({"E": "int32"})

    return tasks.mapInPandas(run, "sid string, E int, rho double").withColumn("rho", F.nanvl("rho", F.lit(None).cast("double")))


def optimal(rhos: DataFrame) -> DataFrame:
    """(sid, E, rho): the E of the highest rho, the least such E among ties; 1 if no rho is defined."""
    best = F.max_by(F.struct("E", "rho"), F.struct(F.coalesce("rho", F.lit(float("-inf"))), -F.col("E")))
    return rhos.groupBy("sid").agg(best.alias("_b")).select("sid", "_b.E", "_b.rho")


def optimal_e(panel: DataFrame, E_max: int = 20, tau: int = 1, Tp: int = 1, strategy: str = "kernel") -> DataFrame:
    return optimal(rho_by_dimension(panel, E_max, tau, Tp, strategy))
