"""Convergent cross mapping: skill as a function of the library's size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagweave.functions.sampling import neighbours_needed
from lagweave.functions.stats import corr
from lagweave.functions.validate import embedding_args
from lagweave.operators import kernels as K
from lagweave.operators.embedding import embed, sampled_library
from lagweave.operators.neighbors import nearest, pairwise
from lagweave.operators.simplex import lookup, weigh
from lagweave.plans.ship import ship

TRIAL = ["lib_size", "trial"]


def candidates_kept(n: int, n_lib: int, lib_sizes: list[int], E: int, accuracy: float) -> int | None:
    """Neighbours to rank per row so that E+1 of them are sampled with the given probability; None: all."""
    return None if accuracy >= 1 else max(E + 1, neighbours_needed(E + 1, min(lib_sizes) / n, 1 - accuracy, n_lib))


def trial_skill(chosen: DataFrame, target: DataFrame, rows: DataFrame, span: int, Tp: int, E: int) -> DataFrame:
    """(lib_size, trial, rho) from the sampled neighbours (lib_size, trial, i, rk, idx, dist).

    A row with fewer than E+1 neighbours is filled up with step 0 at the largest distance.
    """
    trials = chosen.select(*TRIAL).distinct()
    grid = trials.crossJoin(F.broadcast(rows)).withColumn("rk", F.explode(F.sequence(F.lit(1), F.lit(E + 1))))
    full = grid.join(chosen.select(*TRIAL, "i", "rk", "idx", "dist"), [*TRIAL, "i", "rk"], "left")
    full = full.withColumn("idx", F.coalesce("idx", F.lit(0))).withColumn("dist", F.coalesce("dist", F.lit(K.FLT_MAX)))
    pred = lookup(weigh(full, [*TRIAL, "i"]), target, [*TRIAL, "i"])
    both = pred.withColumn("t", F.col("i") + span + Tp).join(target.withColumnRenamed("v", "actual"), "t")
    return both.groupBy(*TRIAL).agg(corr("pred", "actual").alias("rho"))


def mean_skill(trials: DataFrame) -> DataFrame:
    """(lib_size, rho); NULL if a trial has no defined skill."""
    return trials.groupBy("lib_size").agg(F.when(F.count("rho") == F.count("*"), F.avg("rho")).alias("rho"))


def ccm_trials(lib: DataFrame, target: DataFrame, samples: DataFrame, E: int, tau: int = 1, Tp: int = 0, keep: int | None = None) -> DataFrame:
    """Relational form, for panels of one series each. Distances are ranked once (the `keep` nearest, default all);
    every trial is a column value of one job that filters the ranking by its sample (idx: time steps)."""
    embedding_args(E, tau, Tp)
    span = (E - 1) * tau
    rows = embed(lib, E, tau, Tp, ahead=False)
    ranked = nearest(pairwise(rows, embed(lib, E, tau, Tp), E), keep)
    sampled = ranked.join(samples, "idx")
    again = Window.partitionBy(*TRIAL, "i").orderBy("_rank")
    chosen = sampled.withColumnRenamed("rk", "_rank").withColumn("rk", F.row_number().over(again)).where(F.col("rk") <= E + 1)
    return trial_skill(chosen, target.select("t", "v"), rows.select(F.col("j").alias("i")), span, Tp, E)


def ccm_naive_trials(lib: DataFrame, target: DataFrame, samples: DataFrame, E: int, tau: int = 1, Tp: int = 0) -> DataFrame:
    """Distances anew for each trial; samples.idx are library rows, not time steps."""
    embedding_args(E, tau, Tp)
    span = (E - 1) * tau
    rows = embed(lib, E, tau, Tp, ahead=False)
    trials = samples.select(*TRIAL).distinct()
    preds = rows.crossJoin(F.broadcast(trials))
    near = nearest(pairwise(preds, sampled_library(embed(lib, E, tau, Tp), samples), E, TRIAL), E + 1, TRIAL)
    return trial_skill(near, target.select("t", "v"), rows.select(F.col("j").alias("i")), span, Tp, E)


def ccm_kernel(spark, lib: np.ndarray, target: np.ndarray, drawn: list[tuple[int, int, list[int]]], E: int, tau: int = 1, Tp: int = 0, keep: int | None = None, by_row: bool = False) -> DataFrame:
    """(lib_size, trial, rho): a task takes some trials and shares one ranking of distances among them, a block of rows
    at a time, so that memory does not grow with the square of the series.

    by_row: samples are library rows (the naive form) rather than time steps.
    """
    embedding_args(E, tau, Tp)
    span = (E - 1) * tau
    lib, target = (np.asarray(np.asarray(x, dtype=np.float32), dtype=float) for x in (lib, target))
    n_lib = len(lib) - span - Tp
    k = min(keep or n_lib, n_lib)
    shared = spark.sparkContext.broadcast((lib, target))
    tasks = spark.createDataFrame(drawn, "lib_size int, trial int, picked array<int>")
    tasks = tasks.repartition(min(len(drawn), spark.sparkContext.defaultParallelism) or 1)

    ship(spark)
    def run(batches):
        x, y = shared.value
        vectors = K.delay_matrix(x, E, tau)
        for pdf in batches:
            masks = np.zeros((len(pdf), len(x)), dtype=bool)
            for mask, picked in zip(masks, pdf["picked"]):
                mask[np.asarray(picked, dtype=int)] = True
            pred = np.empty((len(pdf), len(vectors)))
            step = max(1, K.BLOCK_CELLS // max(1, n_lib))
            for lo in range(0, len(vectors), step):  # a block of rows is ranked once, for all trials
                part = vectors[lo : lo + step]
                dist, rows = K.neighbours(part, vectors[:n_lib], k)
                at = rows + (0 if by_row else span + Tp)
                for mask, out in zip(masks, pred):
                    hit = mask[at]
                    place = np.where(hit, np.cumsum(hit, axis=1), 0)
                    d = np.full((len(part), E + 1), K.FLT_MAX)
                    idx = np.zeros((len(part), E + 1), dtype=int)
                    r, c = np.nonzero((place > 0) & (place <= E + 1))
                    d[r, place[r, c] - 1] = dist[r, c]
                    idx[r, place[r, c] - 1] = rows[r, c] + span + Tp
                    out[lo : lo + step] = K.forecast(K.weights(d), idx, y)
            rho = [K.correlation(p, y[span + Tp :]) for p in pred]
            yield pd.DataFrame({"lib_size": pdf["lib_size"].astype("int32"), "trial": pdf["trial"].astype("int32"), "rho": rho})

    return tasks.mapInPandas(run, "lib_size int, trial int, rho double").withColumn("rho", F.nanvl("rho", F.lit(None).cast("double")))
