"""Sources and sinks of the series panel ``(sid string, t int, v double)``.

t is dense from 0 within each series. Values pass through float32, so that two
doubles which are one float32 count as duplicates.
"""

from __future__ import annotations

import csv

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lagweave.functions.validate import require

PANEL = T.StructType([T.StructField("sid", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("v", T.DoubleType())])


def single(v):
    """float32 precision, held as a double."""
    return v.cast("float").cast("double")


def from_wide(df: DataFrame, order_col: str, value_cols: list[str]) -> DataFrame:
    """One series per column, in the order of order_col. Without gaps in order_col its rank is the time step.

    order_col must be an integer that counts up by one; then no window over the whole table is needed.
    """
    start = df.agg(F.min(order_col).alias("_start"))
    long = df.select(F.col(order_col).alias("_o"), *[F.col(f"`{c}`").cast("double").alias(c) for c in value_cols])
    long = long.unpivot(["_o"], value_cols, "sid", "v")
    return long.crossJoin(F.broadcast(start)).select("sid", (F.col("_o") - F.col("_start")).cast("int").alias("t"), single(F.col("v")).alias("v"))


def from_arrays(spark: SparkSession, series: dict[str, np.ndarray]) -> DataFrame:
    """Panel from arrays in memory: one row per series is sent, the steps unfold in Spark."""
    rows = [(str(k), np.asarray(a, dtype=np.float32).astype(float).tolist()) for k, a in series.items()]
    packed = spark.createDataFrame(rows, "sid string, vs array<double>")
    return packed.select("sid", F.posexplode("vs").alias("t", "v"))


def to_arrays(panel: DataFrame) -> dict[str, np.ndarray]:
    """Sink for results that fit the driver."""
    pdf = panel.toPandas().sort_values(["sid", "t"])
    return {k: g["v"].to_numpy() for k, g in pdf.groupby("sid")}


def to_wide(panel: DataFrame, sids: list[str]) -> DataFrame:
    return panel.groupBy("t").pivot("sid", sids).agg(F.first("v"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(t, value) of a text file's lines that are not blank, numbered from 0 in the order of the file.

    The file is read in parallel. A line's number is its number within its split and the count of the lines of the
    splits before it; what comes to the driver is a row for each split.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        raise ValueError(f"Failed to open file {path}") from e
    lines = lines.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    lines = lines.where(F.trim("value") != "").withColumn("_k", F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_m")))
    splits = sorted(lines.groupBy("_f", "_b").agg(F.max("_k").alias("n")).collect())
    require(len({s["_f"] for s in splits}) <= 1, "the order of lines is that of one file; several files need order_col")
    before, rows = 0, []
    for s in splits:
        rows.append((s["_b"], before))
        before += s["n"]
    offsets = spark.createDataFrame(rows, "_b long, _o long")
    return lines.join(F.broadcast(offsets), "_b").select((F.col("_o") + F.col("_k") - 1).alias("t"), "value")


def load_csv(spark: SparkSession, path: str, order_col: str | None = None) -> DataFrame:
    """CSV with a header; every column is a series. Without order_col the order is that of the file's lines."""
    if order_col is None:
        lines = numbered_lines(spark, path)
        header = lines.where("t = 0").first()
        require(header is not None, f"{path} has no header")
        names = next(csv.reader([header["value"].lstrip("\ufeff")]))
        cells = F.split("value", ",")
        rows = lines.where("t > 0").select((F.col("t") - 1).cast("int").alias("t"), F.explode(F.map_from_arrays(F.array(*[F.lit(n.strip()) for n in names]), cells)).alias("sid", "v"))
        return rows.select("sid", "t", single(F.trim("v")).alias("v"))
    df = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = [c for c in df.columns if c != order_col]
    return from_wide(df.withColumn(order_col, F.col(f"`{order_col}`").cast("int")), order_col, names)


def load_parquet(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A panel written by write_panel; names keeps those series (pushed down to the scan)."""
    df = spark.read.schema(PANEL).parquet(path)
    return df.where(F.col("sid").isin(names)) if names else df


def write_panel(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").parquet(path)


def write_matrix(matrix: DataFrame, path: str, partition: str | None = None) -> None:
    """Results such as optimal_e, xmap, rho and rhodiff; one folder per library if partition names its column."""
    w = matrix.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with doubles at a fixed number of digits."""
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)


def header_of(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).columns


def transpose(panel: DataFrame, sids: list[str]) -> DataFrame:
    """The steps become the series row0, row1, ..., and the series, in the order given, their steps."""
    place = panel.sparkSession.createDataFrame([(s, k) for k, s in enumerate(sids)], "sid string, _k int")
    return panel.join(F.broadcast(place), "sid").select(F.concat(F.lit("row"), "t").alias("sid"), F.col("_k").alias("t"), "v")


def csv_to_parquet(spark: SparkSession, src: str, dst: str, order_col: str | None = None, transpose_lines: bool = False) -> None:
    """With transpose_lines the lines, not the columns, of the file are the series; their steps are in the header's order."""
    panel = load_csv(spark, src, order_col)
    if transpose_lines:
        panel = transpose(panel, [c.lstrip("\ufeff") for c in header_of(spark, src) if c != order_col])
    write_panel(panel, dst)


def regularize(events: DataFrame, ts: str, start: str, steps: int, seconds: int, value, sid=None) -> DataFrame:
    """Timestamped rows to dense series: `steps` slots of `seconds` from `start`, empty slots are 0.

    value is an aggregate Column; sid names each row's series (one series 'all' if None). The slots are a small
    generated table; the events are aggregated before anything is joined to them.
    """
    spark = events.sparkSession
    slot = F.floor((F.unix_timestamp(F.col(ts)) - F.unix_timestamp(F.lit(start).cast("timestamp"))) / seconds).cast("int")
    found = events.select("*", slot.alias("t"), (sid if sid is not None else F.lit("all")).cast("string").alias("sid"))
    found = found.where(F.col("t").between(0, steps - 1)).groupBy("sid", "t").agg(value.cast("double").alias("v"))
    names = found.select("sid").distinct()
    grid = names.crossJoin(F.broadcast(spark.range(steps).select(F.col("id").cast("int").alias("t"))))
    return grid.join(found, ["sid", "t"], "left").select("sid", "t", single(F.coalesce("v", F.lit(0.0))).alias("v"))


def slice_panel(panel: DataFrame, start: int, stop: int) -> DataFrame:
    """Time steps [start, stop), counted from 0 again."""
    return panel.where((F.col("t") >= start) & (F.col("t") < stop)).withColumn("t", F.col("t") - start)


def pick(panel: DataFrame, *sids: str) -> DataFrame:
    return panel.where(F.col("sid").isin(list(sids)))


def lengths(panel: DataFrame) -> DataFrame:
    return panel.groupBy("sid").agg(F.count("*").cast("int").alias("n"))


def check_panel(panel: DataFrame) -> None:
    """One pass: no nulls or NaN, t dense from 0 in each series."""
    per_sid = panel.groupBy("sid").agg(
        F.count("*").alias("n"), F.max("t").alias("hi"), F.min("t").alias("lo"), F.count_distinct("t").alias("d"),
        F.sum((F.col("v").isNull() | F.isnan("v")).cast("int")).alias("bad"),
    )
    x = per_sid.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum(((F.col("lo") != 0) | (F.col("hi") + 1 != F.col("n")) | (F.col("d") != F.col("n"))).cast("int")), F.lit(0)).alias("gaps")).first()
    require(x["bad"] == 0, "series values must be neither null nor NaN")
    require(x["gaps"] == 0, "time steps of each series must run from 0 without gaps")


def uniform_random(spark: SparkSession, n: int, seed: int = 1931, sid: str = "random") -> DataFrame:
    return spark.range(n).select(F.lit(sid).alias("sid"), F.col("id").cast("int").alias("t"), single(F.rand(seed)).alias("v"))


def sawtooth(spark: SparkSession, n: int, period: int = 1000, sid: str = "sawtooth") -> DataFrame:
    return spark.range(n).select(F.lit(sid).alias("sid"), F.col("id").cast("int").alias("t"), single((F.col("id") % period) / period).alias("v"))


def logistic_map(spark: SparkSession, n: int, x0: float = 0.23456, r: float = 4.0, sid: str = "logistic") -> DataFrame:
    xs = [x0]
    for _ in range(n - 1):
        xs.append(r * xs[-1] * (1 - xs[-1]))
    return from_arrays(spark, {sid: np.array(xs)})
