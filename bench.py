"""Times every query, and the published configurations of the method; prints one JSON line.

    python bench.py [--no-configurations]
"""

import json
import os
import sys
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.operators import kernels as K
from lagweave.operators import neighbors
from lagweave.operators.simplex import lookup_targets
from lagweave.operators.smap import smap
from lagweave.plans.queries import QUERIES
from lagweave.plans.ship import ship
from lagweave.sources import panel as P

#: Steps of the published kNN run, which took about 90 s on 10 cores, and of the other configurations.
PUBLISHED, LENGTH, TARGETS = 46_342, 10_000, 1_000


def run(df: DataFrame) -> float:
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    print(round(time.perf_counter() - t, 3), file=sys.stderr, flush=True)
    return time.perf_counter() - t


def partial_sort(spark: SparkSession, n: int, k: int) -> DataFrame:
    """The k least of each row of a random n x n matrix, made block by block in the tasks."""
    ship(spark)

    def some(batches):
        for b in batches:
            for seed in b["id"]:
                yield b.assign(least=float(K.smallest(np.random.default_rng(seed).random((100, n)), k)[:, 0].sum()))[["least"]].head(1)

    return spark.range(n // 100).repartition(spark.sparkContext.defaultParallelism).mapInPandas(some, "least double")


def configurations(spark: SparkSession) -> dict[str, float]:
    """Seconds of single runs; each makes its input first."""
    saw, noise, chaos = P.sawtooth(spark, PUBLISHED).cache(), P.uniform_random(spark, LENGTH).cache(), P.logistic_map(spark, LENGTH).cache()
    many = spark.range(TARGETS).crossJoin(spark.range(LENGTH).select(F.col("id").cast("int").alias("t"))).select(F.concat(F.lit("s"), "id").alias("sid"), "t", F.rand(7).cast("float").cast("double").alias("v")).cache()
    for x in (saw, noise, chaos, many):
        x.count()
    return {
        f"knn n={PUBLISHED} E=2 k=3": run(neighbors.knn(saw, saw, 2, 1, 0, 3)),
        f"knn n={LENGTH} E=20": run(neighbors.knn(noise, noise, 20, 1, 1)),
        f"lookup n={LENGTH} targets={TARGETS} E=20": run(lookup_targets(noise, noise, many, 20, 1, 1)),
        f"smap n={LENGTH} E=20 theta=1": run(smap(chaos, chaos, None, 20, 1, 1, 1.0)),
        f"partial sort {LENGTH}x{LENGTH} k=21": run(partial_sort(spark, LENGTH, 21)),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: round(min(run(query(spark, sf)) for _ in range(2)), 3) for name, query in QUERIES.items()}
    found = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rpartition("sf")[2]}
    if "--no-configurations" not in sys.argv:
        found["configurations"] = {k: round(v, 2) for k, v in configurations(spark).items()}
    print(json.dumps(found))
    spark.stop()


if __name__ == "__main__":
    main()
