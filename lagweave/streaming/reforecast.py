"""Forecasts that follow a stream: each micro-batch extends the panel and is forecast anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lagweave.operators.simplex import simplex


def reforecast(stream: DataFrame, store: str, out: str, checkpoint: str, E: int = 3, tau: int = 1, Tp: int = 1) -> StreamingQuery:
    """Appends panel rows (sid, t, v) of each batch to `store` and writes forecasts of the batch's series to `out`.

    Both writes are keyed by the batch's number, so a batch that is run again after a failure replaces its own output.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("sid", "t", "v").write.mode("overwrite").parquet(f"{store}/batch={number}")
        panel = spark.read.parquet(store).where(f"batch <= {number}").drop("batch")
        touched = panel.join(batch.select("sid").distinct(), "sid", "left_semi")
        simplex(touched, touched, None, E, tau, Tp, strategy="kernel").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
