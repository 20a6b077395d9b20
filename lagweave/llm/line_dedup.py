"""Line dedup: windows of three consecutive lines that occur before in the corpus are cut out.

Lines without a word are no part of windows. A window's first occurrence is the one of least document id, then of
least place; every later one is removed with the blank lines between, and overlapping removals are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import SPACES, bits_for, cut, hidden, maybe_repeated, repeated_bitmap

WINDOW = 3
#: Keys that hold over 1/HEAVY of all repeated windows are at most HEAVY in number, and so can be broadcast.
HEAVY = 512
RESULTS = ("n_lines", "n_removed", "removed")


def _windows(df: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(_id, _th, _k, _a, _b, _key): a row per window; it covers lines _a to _b of its document. _th tells rows of one id apart."""
    lines = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")
    numbered = F.transform(lines, lambda line, i: F.struct(line.alias("l"), i.alias("i")))
    x = df.select(F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_th"), F.filter(numbered, lambda s: F.btrim(s["l"], F.lit(SPACES)) != "").alias("_n"))

    def window(s: Column, k: Column) -> Column:
        later = [F.get(F.col("_n"), k + j) for j in range(1, size)]
        return F.struct(s["i"].alias("a"), later[-1]["i"].alias("b"), F.unhex(F.md5(F.concat_ws("\n", s["l"], *[w["l"] for w in later]).cast("binary"))).alias("key"))

    x = x.where(F.size("_n") >= size)
    x = x.select("_id", "_th", F.posexplode(F.transform(F.slice("_n", F.lit(1), F.size("_n") - (size - 1)), window)).alias("_k", "_w"))
    return x.select("_id", "_th", "_k", F.col("_w.a").alias("_a"), F.col("_w.b").alias("_b"), F.col("_w.key").alias("_key"))


def later_windows(df: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(_id, _th, _a, _b) of all occurrences but the first.

    Windows are made once and written without their lines. Counting reduces to one row per key and task before the
    shuffle. Only windows whose key a bitmap of bounded size says may be repeated travel a second time; those of the
    heaviest keys meet the keys' first occurrence by broadcast.
    """
    w = cut(_windows(df, doc_id, text, size))
    place = F.struct("_id", "_th", "_k")
    firsts = cut(w.groupBy("_key").agg(F.count("*").alias("n"), F.min(place).alias("_first")).where("n > 1"))
    total = firsts.agg(F.sum("n").alias("_all"))
    heavy = firsts.join(F.broadcast(total), F.col("n") * HEAVY > F.col("_all")).select("_key", F.col("_first").alias("_heavy"))
    light = firsts.join(heavy, "_key", "left_anti").select("_key", "_first")

    bits = bits_for(firsts.count())
    again = maybe_repeated(w, F.col("_key"), repeated_bitmap(firsts, F.col("_key"), bits), "_maybe", bits).where("_maybe")
    again = again.join(F.broadcast(heavy), "_key", "left")
    a = again.where(F.col("_heavy").isNotNull()).withColumn("_first", F.col("_heavy"))
    b = again.where(F.col("_heavy").isNull()).join(light, "_key")
    both = a.unionByName(b.select(a.columns))
    return both.where(~place.eqNullSafe(F.col("_first"))).select("_id", "_th", "_a", "_b")


def _merged(spans: Column) -> Column:
    """Sorted (a, b) structs, of which a and b rise together, as disjoint (start, end) line numbers, end included."""
    starts = F.filter(spans, lambda s, j: F.coalesce(s["a"] > F.get(F.col("_s"), j - 1)["b"] + 1, F.lit(True)))
    ends = F.filter(spans, lambda s, j: F.coalesce(F.get(F.col("_s"), j + 1)["a"] > s["b"] + 1, F.lit(True)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s["a"].alias("start"), e["b"].alias("end")))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """df with its text cut, n_lines (before), n_removed and removed (start, end structs of lines, counted from 0).

    A null text stays null and has one empty line; a text of fewer than three lines with words stays as it is. Rows
    that repeat both id and text count as one document, so neither is cut on the other's account. A null id counts as
    least. An empty table gives an empty result. Columns of df of these names are replaced, others passed on, whatever
    their names. Texts without a removal do not travel.
    """
    own = [c for c in df.columns if c.lower() not in RESULTS]
    df, name = hidden(df)
    doc_id, text = name[doc_id], name[text]
    later = later_windows(df, doc_id, text, size)
    cuts = cut(later.groupBy("_id", "_th").agg(F.array_sort(F.collect_set(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")))).alias("_s")).withColumn("_spans", _merged(F.col("_s"))).drop("_s"))
    key = F.struct("_id", "_th")
    touched = repeated_bitmap(cuts.withColumn("n", F.lit(2)), key)

    x = df.withColumn("_id", F.col(f"`{doc_id}`")).withColumn("_th", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    x = maybe_repeated(x, key, touched, "_maybe")
    hit = x.where("_maybe").withColumnsRenamed({"_id": "_i", "_th": "_t"}).join(cuts, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left").drop("_id", "_th").withColumnsRenamed({"_i": "_id", "_t": "_th"})
    none = F.array().cast("array<struct<start:int,end:int>>")
    y = x.where(~F.col("_maybe")).withColumn("_spans", none).unionByName(hit.withColumn("_spans", F.coalesce("_spans", none)).select(*x.columns, "_spans"))

    y = y.withColumn("_lines", F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n"))
    n, spans = F.size("_lines"), F.size("_spans")
    def piece(g: Column) -> Column:  # what stands before span g, after the span before it
        lo = F.coalesce(F.get(F.col("_spans"), g - 1)["end"] + 1, F.lit(0))
        hi = F.coalesce(F.get(F.col("_spans"), g)["start"], n)
        return F.slice("_lines", lo + 1, F.greatest(hi - lo, F.lit(0)))

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), spans), piece)), "\n")
    y = y.withColumn("n_lines", n.cast("long"))
    y = y.withColumn("n_removed", F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"] + 1))
    y = y.withColumn(text, F.when(spans > 0, kept).otherwise(F.col(f"`{text}`")))
    return y.select(*[F.col(name[c]).alias(c) for c in own], "n_lines", "n_removed", F.col("_spans").alias("removed"))
