"""Exact duplicates by progressive refinement: length, then a hash of the first bytes, then a hash of all of it.

Each round looks only at documents that the round before could not tell apart, and what it passes on is a bitmap of
bounded size (see common.repeated_bitmap), so no round shuffles texts or depends on how many documents share a key.
Lengths and prefix hashes are read once and written, as a small table; full hashes are taken of survivors alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagweave.llm.common import bits_for, cut, hidden, maybe_repeated, repeated_bitmap

PREFIX_BYTES = 256
#: Groups that hold over 1/HEAVY of all surviving documents are at most HEAVY in number, and so can be broadcast.
HEAVY = 512
RESULTS = ("keep_id", "group_size", "kept")


def survivors(x: DataFrame, body: Column) -> DataFrame:
    """x with _len, _prefix (hash) and _maybe: whether another document may have the same text."""
    x = x.withColumn("_len", F.octet_length(body)).withColumn("_prefix", F.xxhash64(F.substring(F.encode(body, "UTF-8"), 1, PREFIX_BYTES)))
    keys = cut(x.groupBy("_len", "_prefix").agg(F.count("*").alias("n")))
    lengths = keys.groupBy("_len").agg(F.sum("n").alias("n")).where("n > 1").select("_len")
    both = F.struct("_len", "_prefix")
    again = cut(keys.where("n > 1").join(lengths, "_len", "left_semi"))
    bits = bits_for(again.count())
    return maybe_repeated(x, both, repeated_bitmap(again, both, bits), "_maybe", bits)


def mark(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with keep_id, group_size and kept, one row per row of df.

    Texts are equal if their bytes are; null counts as empty. Of a group the row with the largest id stays (a null id
    counts as least). Of rows that repeat both text and largest id the one whose other columns come first as JSON
    stays; rows that are equal in all columns are interchangeable, and one of them stays. An empty table gives an empty
    result. Columns of df of these names are replaced; any others, whatever their names, are passed on.
    """
    own = [c for c in df.columns if c.lower() not in RESULTS]
    x, name = hidden(df)
    body = F.coalesce(F.col(name[text]), F.lit(""))
    x = survivors(x.withColumn("_id", F.col(name[doc_id])), body)
    x = x.withColumn("_sha", F.when(F.col("_maybe"), F.unhex(F.sha2(F.encode(body, "UTF-8"), 256))))

    by_id = x.where("_maybe").groupBy("_len", "_sha", "_id").agg(F.count("*").alias("_n"))
    groups = by_id.groupBy("_len", "_sha").agg(F.max(F.struct("_id", "_n")).alias("_top"), F.sum("_n").alias("_size")).where("_size > 1")
    groups = cut(groups.select("_len", "_sha", F.col("_top._id").alias("_keep"), F.col("_top._n").alias("_tops"), "_size"))
    total = groups.agg(F.sum("_size").alias("_all"))
    heavy = groups.join(F.broadcast(total), F.col("_size") * HEAVY > F.col("_all")).drop("_all")

    a = x.join(F.broadcast(heavy.select("_len", "_sha", *[F.col(c).alias(f"{c}_h") for c in ("_keep", "_tops", "_size")])), ["_len", "_sha"], "left")
    done = F.col("_size_h").isNotNull() | ~F.col("_maybe")
    light = groups.join(heavy.select("_len", "_sha"), ["_len", "_sha"], "left_anti")
    b = a.where(done).withColumns({"_keep": F.col("_keep_h"), "_tops": F.col("_tops_h"), "_size": F.col("_size_h")})
    c = a.where(~done).join(light, ["_len", "_sha"], "left")
    y = b.unionByName(c.select(b.columns))

    single = F.col("_size").isNull()
    first = F.col("_id").eqNullSafe(F.col("_keep"))
    if groups.where("_tops > 1").isEmpty():
        z = y.withColumn("kept", single | first)
    else:
        plain = single | (F.col("_tops") == 1) | ~first
        others = [F.col(name[c]) for c in own if c not in (doc_id, text)]
        order = F.to_json(F.struct(*others)) if others else F.lit(0)
        ranked = F.row_number().over(Window.partitionBy("_len", "_sha", "_keep").orderBy(order))
        z = y.where(plain).withColumn("kept", single | first).unionByName(y.where(~plain).withColumn("kept", ranked == 1))
    return z.select(*[F.col(name[c]).alias(c) for c in own], F.when(single, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), "kept")


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, as in mark(). Only texts that may have copies travel."""
    x, name = hidden(df)
    return mark(x, name[doc_id], name[text]).where("kept").select(*name.values()).toDF(*df.columns)
