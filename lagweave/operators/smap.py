"""S-Map: a locally weighted linear fit for every prediction row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.functions.validate import embedding_args
from lagweave.operators import kernels as K
from lagweave.operators.neighbors import pack
from lagweave.operators.simplex import with_actual
from lagweave.plans.ship import ship

#: Fits that one task makes; each needs the whole library, so a block amortises shipping it.
FIT_BLOCK = 256


def smap(lib: DataFrame, pred: DataFrame, target: DataFrame | None = None, E: int = 1, tau: int = 1, Tp: int = 1, thetas: list[float] | float = 1.0, observed: DataFrame | None = None) -> DataFrame:
    """(sid, theta, i, t, pred, actual) for every series and theta. target defaults to pred, observed to target."""
    embedding_args(E, tau, Tp)
    span = (E - 1) * tau
    thetas = [float(x) for x in (thetas if isinstance(thetas, (list, tuple)) else [thetas])]
    target = pred if target is None else target
    tasks = pack(lib, "ls").join(pack(target, "ys"), "sid").join(pack(pred, "ps"), "sid")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("ps") - span - 1, F.lit(0)), F.lit(FIT_BLOCK)))
    tasks = tasks.select("*", starts.alias("a")).withColumn("ps", F.slice("ps", F.col("a") + 1, F.lit(FIT_BLOCK + span)))
    tasks = tasks.withColumn("theta", F.explode(F.array(*[F.lit(x) for x in thetas])))
    tasks = tasks.select("sid", "theta", "a", "ls", "ys", "ps").repartition(tasks.sparkSession.sparkContext.defaultParallelism, "sid", "theta", "a")

    ship(tasks.sparkSession)
    def run(batches):
        for pdf in batches:
            for sid, theta, a, ls, ys, ps in pdf.itertuples(index=False):
                vectors = K.delay_matrix(np.asarray(ps, dtype=float), E, tau)
                if len(ls) - span - Tp < E + 1 or not len(vectors):
                    raise ValueError("lib size is too small" if len(vectors) else "pred size is too small")
                got = K.local_linear(np.asarray(ls, dtype=float), np.asarray(ys, dtype=float), vectors, E, tau, Tp, theta)
                yield pd.DataFrame({"sid": sid, "theta": theta, "i": np.arange(a, a + len(vectors), dtype=np.int32), "pred": got})

    out = tasks.mapInPandas(run, "sid string, theta double, i int, pred double").withColumn("pred", F.nanvl("pred", F.lit(None).cast("double")))
    return with_actual(out, target if observed is None else observed, span, Tp, ["sid"]).select("sid", "theta", "i", "t", "pred", "actual")
