"""Delay embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagweave.functions.validate import embedding_args


def embed(panel: DataFrame, E: int, tau: int = 1, Tp: int = 0, ahead: bool = True) -> DataFrame:
    """(sid, j, emb, idx): the vector of v at j, j+tau, ... and idx, the time step it predicts.

    With ahead, only rows whose idx lies within the series (library rows); without, all rows that have a
    whole vector (prediction rows). Rows are kept by count, never by filtering t before the lead.
    """
    embedding_args(E, tau, Tp)
    span = (E - 1) * tau
    by = Window.partitionBy("sid")
    over = by.orderBy("t")
    rows = panel.select("sid", F.col("t").alias("j"), F.array(*[F.lead("v", e * tau).over(over) for e in range(E)]).alias("emb"), (F.col("t") + span + Tp).alias("idx"), F.count("*").over(by).alias("_n"))
    return rows.where(F.col("j") < F.col("_n") - span - (Tp if ahead else 0)).drop("_n")


def embed_block(panel: DataFrame, sids: list[str], E: int, tau: int = 1, Tp: int = 0, ahead: bool = True, name: str = "block") -> DataFrame:
    """Several series as one block: each is embedded to E dimensions, the vectors joined end to end.

    Rows of the block are one series named `name`. Every series must be present at a row's steps.
    """
    parts = embed(panel.where(F.col("sid").isin(sids)), E, tau, Tp, ahead)
    each = parts.groupBy("j", "idx").agg(*[F.max(F.when(F.col("sid") == s, F.col("emb"))).alias(f"_e{k}") for k, s in enumerate(sids)])
    return each.dropna(subset=[f"_e{k}" for k in range(len(sids))]).select(F.lit(name).alias("sid"), "j", F.concat(*[f"_e{k}" for k in range(len(sids))]).alias("emb"), "idx")


def sampled_library(embedded: DataFrame, samples: DataFrame) -> DataFrame:
    """Library rows of each sample (by row number j = samples.idx), with the sample's columns."""
    keys = [c for c in samples.columns if c != "idx"]
    return embedded.join(samples.select(*keys, F.col("idx").alias("j")), "j")
