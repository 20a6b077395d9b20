"""Queries over the star-schema tables that exercise every operator of the engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.functions import sampling, stats
from lagweave.operators import convergent, crossmap, dimension, neighbors
from lagweave.operators import simplex as S
from lagweave.operators import smap as M
from lagweave.operators.embedding import embed, embed_block
from lagweave.plans.config import shared_folder
from lagweave.sources import panel as P

HOURS = 720
START = "2024-01-01 00:00:00"


def cents(c: str):
    """Sums of whole cents do not depend on the order of the rows."""
    return F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / 100


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """One series per event type, the hour's total value."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    return P.regularize(events, "ts", START, HOURS, 3600, cents("value"), F.col("event_type"))


def hourly_all(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "value")
    return P.regularize(events, "ts", START, HOURS, 3600, cents("value"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue by return flag and line status, from the first to the last day of the table."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_shipdate", "l_extendedprice", "l_returnflag", "l_linestatus")
    first, steps = lines.agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd 00:00:00"), F.date_diff(F.max("l_shipdate"), F.min("l_shipdate")) + 1).first()
    return P.regularize(lines, "l_shipdate", first, steps, 86400, cents("l_extendedprice"), F.concat("l_returnflag", "l_linestatus"))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Undefined values are NULL on every engine."""
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def delay_embed_e3(spark, sf):
    e = embed(hourly(spark, sf), 3, 1, 1)
    return e.select("sid", "j", "idx", *[F.col("emb")[k].alias(f"e{k}") for k in range(3)])


def digest(pairs: DataFrame) -> DataFrame:
    """What all distances of each row come to. Whole numbers are added up, so the order does not matter."""
    return pairs.groupBy("sid", "i").agg(F.count("*").alias("pairs"), F.sum(F.floor("d2")).alias("total"), F.sum(F.floor("d2") * F.col("idx")).alias("moment"), F.round(F.min("d2"), 6).alias("least"), F.round(F.max("d2"), 6).alias("most"))


def pairwise_dist(spark, sf):
    p = hourly(spark, sf)
    return digest(neighbors.pairwise(embed(p, 2, 1, 0, False), embed(p, 2, 1, 1), 2, mask=False))


def degenerate_mask(spark, sf):
    p = hourly(spark, sf)
    pairs = neighbors.pairwise(embed(p, 1, 1, 0, False), embed(p, 1, 1, 1), 1)
    return pairs.groupBy("sid").agg(F.sum((F.col("d2") > 1e38).cast("long")).alias("masked"), F.count("*").alias("pairs"))


def multivar_dist(spark, sf):
    p = P.pick(hourly(spark, sf), "click", "view")
    a, b = (embed_block(p, ["click", "view"], 2, 1, 1, ahead) for ahead in (False, True))
    return digest(neighbors.pairwise(a, b, 4, mask=False))


def knn_topk(spark, sf):
    h = hourly(spark, sf)
    return rounded(neighbors.knn(h, h, 2, 1, 1, 3), "dist")


def knn_relational(spark, sf):
    h = hourly(spark, sf)
    return rounded(neighbors.knn(h, h, 2, 1, 1, 3, "relational"), "dist")


def knn_full_sort(spark, sf):
    """All neighbours of each row in order, told by a sum that every change of the order changes."""
    p = hourly(spark, sf)
    pairs = neighbors.pairwise(embed(p, 2, 1, 1, False), embed(p, 2, 1, 1), 2)
    ranked = neighbors.nearest(pairs.where(F.col("d2") < 1e38), None)
    place = F.col("rk").cast("long") * F.col("rk") * (F.col("j") + 1)
    return ranked.groupBy("sid", "i").agg(F.count("*").alias("n"), F.sum(place).alias("places"), F.round(F.max("dist"), 6).alias("farthest"))


def embeddings_knn(spark, sf):
    """Ready-made vectors instead of delay embeddings: the 3 nearest of each, weighted."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("j"), F.col("embedding").cast("array<double>").alias("emb"))
    lut = S.weigh(neighbors.nearest_vectors(v, v, 3), ["i"])
    return lut.select("i", "rk", "j", F.round("dist", 5).alias("dist"), F.round("w", 5).alias("w"))


def lut_weights(spark, sf):
    h = hourly(spark, sf)
    return S.neighbour_weights(h, h, 3, 1, 1).select("sid", "i", "rk", "idx", F.round("w", 6).alias("w"))


def lut_relational(spark, sf):
    h = hourly(spark, sf)
    return S.neighbour_weights(h, h, 3, 1, 1, strategy="relational").select("sid", "i", "rk", "idx", F.round("w", 6).alias("w"))


def lookup_many(spark, sf):
    """One neighbour table of one library looks up every target at once."""
    h = hourly(spark, sf)
    lib = P.pick(h, "click")
    return rounded(S.lookup_targets(lib, lib, h, 2, 1, 1), "pred")


def prediction(df: DataFrame) -> DataFrame:
    return rounded(df, "pred", "actual")


def simplex_self(spark, sf):
    h = hourly(spark, sf)
    return prediction(S.simplex(h, h, None, 3, 1, 1))


def simplex_holdout(spark, sf):
    h = hourly(spark, sf)
    return prediction(S.simplex(P.slice_panel(h, 0, 360), P.slice_panel(h, 360, HOURS), None, 2, 1, 1))


def simplex_crossmap(spark, sf):
    h = hourly(spark, sf)
    target = P.pick(h, "view").withColumn("sid", F.lit("click"))
    lib = P.pick(h, "click")
    return prediction(S.simplex(lib, lib, target, 3, 1, 0, target))


def simplex_multivar(spark, sf):
    h = hourly(spark, sf)
    two = P.pick(h, "click", "view")
    return rounded(S.simplex_block(two, two, P.pick(h, "click"), ["click", "view"], 2, 1, 1), "pred")


def eval_simplex(E: int):
    def query(spark, sf):
        h = hourly_all(spark, sf)
        return rounded(S.skill(S.simplex(h, h, None, E, 1, 1)), "rho")

    return query


def edim_by_type(spark, sf):
    return rounded(dimension.optimal_e(hourly(spark, sf), 5, 1, 1), "rho")


def edim_relational(spark, sf):
    return rounded(dimension.optimal_e(hourly(spark, sf), 3, 2, 1, "relational"), "rho")


def fixed_dims(panel: DataFrame) -> DataFrame:
    """Dimensions 2 to 4 by the length of the name: tests need them known."""
    return panel.where("t = 0").select("sid", (F.length("sid") % 3 + 2).alias("E"))


def xmap_matrix(spark, sf):
    h = hourly(spark, sf)
    return rounded(crossmap.xmap(h, fixed_dims(h)), "rho")


def xmap_relational(spark, sf):
    h = hourly(spark, sf)
    return rounded(crossmap.xmap(h, fixed_dims(h), strategy="relational"), "rho")


def corr_matrix(spark, sf):
    return rounded(stats.corr_matrix(hourly(spark, sf)), "rho")


def corr_relational(spark, sf):
    return rounded(stats.corr_matrix(daily(spark, sf), "relational"), "rho")


def corr_against(spark, sf):
    return rounded(stats.corr_against(daily(spark, sf), "NO"), "rho")


def rho_diff(spark, sf):
    h = hourly(spark, sf)
    return rounded(crossmap.rho_diff(crossmap.xmap(h, fixed_dims(h)), stats.corr_matrix(h)), "rhodiff")


def mae_mse(spark, sf):
    return rounded(stats.errors_between(hourly(spark, sf), "click", "view"), "corr", "mae", "mse")


def _ccm_pair(spark, sf):
    h = hourly(spark, sf)
    return P.pick(h, "click"), P.pick(h, "view")


def ccm_full_lib(spark, sf):
    a, b = _ccm_pair(spark, sf)
    every = a.select(F.lit(HOURS).alias("lib_size"), F.lit(0).alias("trial"), F.col("t").alias("idx"))
    return rounded(convergent.mean_skill(convergent.ccm_trials(a, b, every, 3, 1, 0)), "rho")


def ccm_sampled(spark, sf):
    a, b = _ccm_pair(spark, sf)
    samples = sampling.portable_samples(a.select(F.col("t").alias("idx")), [40, 120], 3)
    return rounded(convergent.ccm_trials(a, b, samples, 2, 1, 0), "rho")


def ccm_approx(spark, sf):
    a, b = _ccm_pair(spark, sf)
    samples = sampling.portable_samples(a.select(F.col("t").alias("idx")), [60, 120], 3)
    keep = convergent.candidates_kept(HOURS, HOURS - 1, [60, 120], 2, 0.99)
    return rounded(convergent.ccm_trials(a, b, samples, 2, 1, 0, keep), "rho")


def ccm_naive(spark, sf):
    a, b = _ccm_pair(spark, sf)
    rows = embed(a, 2, 1, 1).select(F.col("j").alias("idx"))
    return rounded(convergent.ccm_naive_trials(a, b, sampling.portable_samples(rows, [40, 120], 2), 2, 1, 1), "rho")


def ccm_pcg(spark, sf):
    """Seeded samples and the kernel form; the random stream has no SQL form."""
    a, b = (P.to_arrays(x) for x in _ccm_pair(spark, sf))  # HOURS values each
    drawn = sampling.draw_libraries(HOURS, [20, 60, 180, 540], 10, 42)
    return rounded(convergent.mean_skill(convergent.ccm_kernel(spark, a["click"], b["view"], drawn, 3, 1, 0)), "rho")


def smap_query(E: int):
    def query(spark, sf):
        p = hourly(spark, sf)
        return rounded(M.smap(p, p, None, E, 1, 1, [0.0, 1.0]), "pred", "actual", digits=4)

    return query


def eval_smap(spark, sf):
    p = hourly(spark, sf)
    return rounded(S.skill(M.smap(p, p, None, 1, 1, 1, [0.0, 0.5, 1.0]), ["sid", "theta"]), "rho", digits=4)


def panel_slice(spark, sf):
    return P.slice_panel(P.pick(hourly(spark, sf), "click", "view"), 100, 300)


def panel_wide(spark, sf):
    return P.to_wide(hourly(spark, sf), ["click", "error", "purchase", "signup", "view"])


def csv_roundtrip(spark, sf):
    """Writes the hourly panel as wide CSV and reads it back."""
    path = f"{shared_folder(spark)}/panel_csv_{uuid.uuid4().hex}"
    P.write_csv(panel_wide(spark, sf), path)
    return P.load_csv(spark, path, "t")


def logistic_smap(spark, sf):
    """A synthetic chaotic series, forecast at three thetas."""
    p = P.logistic_map(spark, 300)
    return rounded(S.skill(M.smap(p, p, None, 2, 1, 1, [0.0, 1.0, 4.0]), ["theta"]), "rho")


def sawtooth_knn(spark, sf):
    p = P.sawtooth(spark, 3000)
    return rounded(neighbors.knn(p, p, 2, 1, 0, 3, "kernel"), "dist")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "panel_hourly": hourly, "panel_daily_revenue": daily, "panel_slice": panel_slice, "panel_wide": panel_wide,
    "delay_embed_e3": delay_embed_e3, "pairwise_dist": pairwise_dist, "degenerate_mask": degenerate_mask, "multivar_dist": multivar_dist,
    "knn_topk": knn_topk, "knn_relational": knn_relational, "knn_full_sort": knn_full_sort, "embeddings_knn": embeddings_knn,
    "lut_weights": lut_weights, "lut_relational": lut_relational, "lookup_many": lookup_many,
    "simplex_self": simplex_self, "simplex_holdout": simplex_holdout, "simplex_crossmap": simplex_crossmap, "simplex_multivar": simplex_multivar,
    "eval_simplex_e1": eval_simplex(1), "eval_simplex_e2": eval_simplex(2), "eval_simplex_e3": eval_simplex(3),
    "edim_by_type": edim_by_type, "edim_relational": edim_relational, "xmap_matrix": xmap_matrix, "xmap_relational": xmap_relational,
    "corr_matrix": corr_matrix, "corr_relational": corr_relational, "corr_against": corr_against, "rho_diff": rho_diff, "mae_mse": mae_mse,
    "ccm_full_lib": ccm_full_lib, "ccm_sampled": ccm_sampled, "ccm_approx": ccm_approx, "ccm_naive": ccm_naive, "ccm_pcg": ccm_pcg,
    "smap_e1": smap_query(1), "smap_e2": smap_query(2), "eval_smap": eval_smap,
    "csv_roundtrip": csv_roundtrip, "logistic_smap": logistic_smap, "sawtooth_knn": sawtooth_knn,
}
