"""Library samples for convergent cross mapping."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SAMPLES = T.StructType([T.StructField("lib_size", T.IntegerType()), T.StructField("trial", T.IntegerType()), T.StructField("idx", T.IntegerType())])

_MASK64, _MASK32 = (1 << 64) - 1, (1 << 32) - 1
# Fixed values of the public PCG32 (XSH-RR 64/32) generator.
_MULTIPLIER, _INCREMENT = 6364136223846793005, 1442695040888963407


class PCG32:
    """The public PCG XSH-RR 64/32 generator on its default stream."""

    def __init__(self, seed: int):
        self.state = ((seed + _INCREMENT) * _MULTIPLIER + _INCREMENT) & _MASK64

    def __call__(self) -> int:
        old, self.state = self.state, (self.state * _MULTIPLIER + _INCREMENT) & _MASK64
        word, turn = ((old ^ (old >> 18)) >> 27) & _MASK32, old >> 59
        return ((word >> turn) | (word << (-turn & 31))) & _MASK32

    def below(self, bound: int) -> int:
        """Uniform in [0, bound); draws below 2**32 mod bound are thrown away so that none is favoured."""
        floor = (1 << 32) % bound
        while (draw := self()) < floor:
            pass
        return draw % bound


def draw_libraries(universe: int, lib_sizes: list[int], sample: int, seed: int) -> list[tuple[int, int, list[int]]]:
    """(lib_size, trial, positions) for each trial, one random stream through all of them; seed 0 takes entropy from the system.

    Robert Floyd's sampling, with the draw for position i taken below i: position universe-1 alone is never
    drawn by a library of one, a known slight bias that published results of this method carry.
    """
    rng = PCG32(seed or int.from_bytes(__import__("os").urandom(8), "little"))
    out = []
    for size in lib_sizes:
        for trial in range(sample):
            if size >= universe:
                out.append((size, trial, list(range(universe))))
                continue
            picked: set[int] = set()
            for i in range(universe - size, universe):
                r = rng.below(i) if i else 0
                picked.add(i if r in picked else r)
            out.append((size, trial, sorted(picked)))
    return out


def samples_frame(spark: SparkSession, drawn: list[tuple[int, int, list[int]]]) -> DataFrame:
    packed = spark.createDataFrame(drawn, "lib_size int, trial int, picked array<int>")
    return packed.select("lib_size", "trial", F.explode("picked").alias("idx"))


def portable_samples(positions: DataFrame, lib_sizes: list[int], sample: int) -> DataFrame:
    """Samples that any SQL engine can draw again: positions in the order of md5('trial-idx'), the first lib_size of them.

    positions has a column idx. The trial, not the driver, is the unit of work, so the number of trials scales out.
    """
    spark = positions.sparkSession
    trials = spark.createDataFrame([(s, k) for s in lib_sizes for k in range(sample)], "lib_size int, trial int")
    order = Window.partitionBy("lib_size", "trial").orderBy(F.md5(F.concat_ws("-", "trial", "idx").cast("binary")), "idx")
    return (
        positions.select("idx").crossJoin(F.broadcast(trials))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= F.col("lib_size"))
        .select("lib_size", "trial", "idx")
    )


def neighbours_needed(successes: int, p: float, miss: float, n_lib: int) -> int:
    """Least number of trials with P(Binomial(trials, p) <= successes) <= miss, between `successes` and n_lib."""
    if p >= 1 or miss >= 1:
        return min(max(successes, 1), n_lib)

    def too_few(n: int) -> float:
        if n <= successes:
            return 1.0
        logs = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(successes + 1))
        return sum(math.exp(x) for x in logs)

    low, high = successes, n_lib
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if too_few(mid) <= miss else (mid + 1, high)
    return low
