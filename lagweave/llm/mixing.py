"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target/size times. The whole part is taken outright; the fractional parts
are rounded in pairs: mass moves at random from one document to the other until one of the two is integral, so that
expectations hold for every document and a pair's copies do not change in sum. What is left over, one document for
each block, is paired again up a reduction tree; at its root one document of each source is rounded by itself.
Documents are paired in falling order of size, so a transfer is between documents of about the same number of words
and the leftovers are small: a source's words miss their target by a fraction of its largest documents.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lagweave.llm.common import cut, hidden
from lagweave.plans.ship import ship

#: Documents of a block, about, and leftovers that meet at a node of the tree.
BLOCK = 4096
FAN_IN = 64
#: Sources up to which their targets are broadcast; beyond it they are joined, by keys that are spread, with the same rows.
BROADCAST_SOURCES = 50_000
MAX_COPIES = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = MAX_COPIES) -> DataFrame:
    """(_source, _n, _source_size, _target) from (_source, _size): all words shared out by weight, at most cap times a source's size.

    Weights go round in the order of the sources' code points, null last. A source that reaches its cap hands the
    excess to the others by weight, again and again until none is above; each turn is one small aggregate.
    """
    spark = sizes.sparkSession
    totals = cut(sizes.groupBy("_source").agg(F.count("*").alias("_n"), F.sum("_size").alias("_source_size")))
    ordered = totals.orderBy(F.col("_source").asc_nulls_last())
    kind = T.StructType([*totals.schema.fields, T.StructField("_weight", T.DoubleType())])
    weight = [float(w) for w in weights]
    ranked = cut(spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], weight[x[1] % len(weight)])), kind))
    total = float(ranked.agg(F.sum("_source_size")).first()[0] or 0)
    # A source that is full stays so, as the level only rises: it is found once no further source gets full.
    level, before = 0.0, -1
    while True:
        full = F.col("_source_size") * cap <= F.col("_weight") * level
        n, capped, free = ranked.agg(F.coalesce(F.sum(full.cast("int")), F.lit(0)), F.sum(F.when(full, F.col("_source_size") * cap).otherwise(0.0)), F.sum(F.when(~full, F.col("_weight")).otherwise(0.0))).first()
        if n == before:
            break
        before = n
        level = (total - capped) / free if free else level
    return ranked.select("_source", "_n", "_source_size", F.least(F.col("_weight") * level, F.col("_source_size") * cap).alias("_target"))


def settle(parts: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """(0, 1 or the leftover's part for each document, position of the leftover or -1). Parts lie strictly between 0 and 1."""
    out = parts.astype(float).copy()
    draws = rng.random(len(out))
    left = -1
    for k in range(len(out)):
        if left < 0:
            left = k
            continue
        p, q = out[left], out[k]
        up, down = min(1 - p, q), min(p, 1 - q)  # what can move from k to the leftover, and back
        if draws[k] * (up + down) < down:
            settled = 1 - p <= q
            p, q = (1.0, q - up) if settled else (p + up, 0.0)
        else:
            settled = p <= 1 - q
            p, q = (0.0, q + down) if settled else (p - down, 1.0)
        out[left], out[k] = p, q
        left = k if settled else left
        if out[left] < 1e-12 or out[left] > 1 - 1e-12:
            out[left] = round(out[left])
            left = -1
    return out, left


def _round(rows: DataFrame, seed: int) -> DataFrame:
    """Settles the documents of each (_source, _block). A group is sorted, so its draws do not depend on arrival."""

    ship(rows.sparkSession)
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_id", "_th"], ascending=False, kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, int(pdf["_sh"].iloc[0]) & (2**63 - 1), int(key[1]) + 1])
        part, left = settle(pdf["_part"].to_numpy(), rng)
        pdf["_part"] = part
        pdf["_open"] = np.arange(len(pdf)) == left
        return pdf

    schema = T.StructType([*rows.schema.fields, T.StructField("_open", T.BooleanType())])
    return rows.groupBy("_source", "_block").applyInPandas(run, schema)


def mix_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: int = MAX_COPIES, seed: int = 7) -> DataFrame:
    """(_id, _th, _size, _source, _source_size, _target, copies): a row for each row of df.

    size counts words; a null or empty text has none and is taken whole as often as its expectation rounds. A null
    source is a source of its own. Rows that repeat an id are rounded each for itself, and equal rows are
    interchangeable. The same rows give the same result, however they are dealt to tasks. copies is at most cap.
    """
    words = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = df.select(F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_th"), words.alias("_size"), F.col(f"`{source}`").cast("string").alias("_source"))
    sizes = cut(sizes)
    targets = cut(source_targets(sizes.select("_source", "_size"), weights, cap))
    stats = targets.agg(F.count("*"), F.max("_n")).first()
    n_sources, most = stats[0], stats[1] or 0
    if n_sources <= BROADCAST_SOURCES:
        x = sizes.join(F.broadcast(targets.withColumnRenamed("_source", "_s")), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    else:
        salts = 64  # a source may hold a third of all rows
        many = targets.withColumnRenamed("_source", "_s").withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        x = sizes.withColumn("_y", F.pmod(F.xxhash64("_id", "_th"), F.lit(salts)).cast("int")).join(many, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_y") == F.col("_z"))).drop("_s", "_y", "_z")

    expected = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    x = x.withColumn("_whole", F.floor(expected).cast("int")).withColumn("_part", expected - F.floor(expected))
    x = x.withColumn("_sh", F.xxhash64("_source")).withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_id", "_th"), F.ceil(F.col("_n") / BLOCK)).cast("long")).drop("_n")
    rounded = (F.col("_part") > 0) & (F.col("_size") > 0)
    done = [x.where(~rounded).withColumn("_open", F.lit(False)).withColumn("_part", F.round("_part"))]
    rows = x.where(rounded)
    for level in range(1 + max(0, math.ceil(math.log(max(1, math.ceil(most / BLOCK)), FAN_IN)))):
        settled = cut(_round(rows, seed + level))
        done.append(settled.where(~F.col("_open")))
        rows = settled.where("_open").drop("_open").withColumn("_block", F.floor(F.col("_block") / FAN_IN).cast("long"))
    # The root: one document of each source at most.
    last = F.pmod(F.xxhash64(F.lit(seed), F.lit("root"), "_sh"), F.lit(1 << 30)) / float(1 << 30)
    done.append(rows.withColumn("_part", (last < F.col("_part")).cast("double")).withColumn("_open", F.lit(False)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("_id", "_th", "_size", "_source", "_source_size", "_target", (F.col("_whole") + F.col("_part").cast("int")).alias("copies"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of df, each as often as the mix takes it, with df's columns, whatever their names.

    Rows equal in id and text share their copies: one of them, the first by its other columns as JSON, stands for all.
    Nulls, empty texts and empty tables are as in mix_counts.
    """
    x, name = hidden(df)
    doc_id, text, source = name[doc_id], name[text], name[source]
    counts = mix_counts(x, doc_id, text, source, **options).groupBy("_id", "_th").agg(F.sum("copies").alias("_copies"))
    x = x.withColumn("_th", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn("_i", F.coalesce(F.xxhash64(F.col(doc_id)), F.lit(0)))
    counts = counts.where("_copies > 0").select(F.coalesce(F.xxhash64("_id"), F.lit(0)).alias("_i"), "_th", "_copies", F.col("_id").alias("_same"))
    joined = x.join(counts, ["_i", "_th"]).where(F.col(doc_id).eqNullSafe(F.col("_same")))
    others = [F.col(c) for c in name.values() if c not in (doc_id, text)]
    first = F.row_number().over(Window.partitionBy("_i", "_th").orderBy("_same", F.to_json(F.struct(*others)) if others else F.lit(0))) == 1
    once = joined.withColumn("_first", first).where("_first")
    return once.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*name.values()).toDF(*df.columns)
