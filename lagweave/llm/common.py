"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a set for btrim and as a regular expression.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; one of its own only in local mode, if it names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df as written to the shared checkpoint folder: computed once, and safe from lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_loop(df: DataFrame) -> DataFrame:
    """As cut, for tables that are joined with themselves again and again.

    A checkpoint keeps the optimizer's estimate of its size, and a join's is the product of both sides'. Over the steps of
    a loop that number gets exponentially many digits, which takes the driver's time and memory. Here it starts anew.
    """
    spark, kept = df.sparkSession, cut(df)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Lets the files of shuffles and checkpoints that nothing refers to any more go, and the plans that led to them.

    Spark removes them when the driver's garbage is collected, which it asks for only every half an hour. Before that the
    JVM must know what Python has dropped: Py4J tells it from a thread that sleeps for up to a second, so it is told here.
    """
    gc.collect()
    dropped = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while dropped:
        try:
            item = dropped.pop()
        except IndexError:
            break
        if not isinstance(item, tuple):  # the mark that ends the thread
            dropped.append(item)
            break
        client, target = item
        client.garbage_collect_object(target, False)
    spark.sparkContext._jvm.System.gc()


_CACHES: list = []
_OWNER: list[str] = [""]


def remembers(clear) -> None:
    """Registers how to drop what an operator's module keeps in a worker process."""
    _CACHES.append(clear)


def claim(owner: str) -> None:
    """Called in a worker when an operator starts: what other operators have left there is dropped, as workers are reused."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for clear in _CACHES:
            clear()
        gc.collect()
        trim()


_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives the system back what the allocators of a worker hold and nothing uses; of C libraries only glibc can be asked to."""
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM is not None:
        _MALLOC_TRIM(0)


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ..., so that none clashes with an operator's own, and the new name of each."""
    new = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new))


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ as an array, empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. Other letters may change as well, but never into ASCII or out of it.

    The Kelvin sign and the dotted capital I alone have ASCII in their lower case, so they go first.
    """
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue000")))


def where_computed(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose column flag is true, where flag ends a long chain of expressions.

    The optimizer would put the chain in place of the flag, with every shared step written out again, which takes it
    exponentially long; it does not move a condition below a column that depends on a row's place.
    """
    return df.withColumn("_at", F.monotonically_increasing_id()).where(F.col(flag) & (F.col("_at") >= 0)).drop("_at")


# Bitmaps of repeated keys. A bitmap of 2**bits bits is at most that many bits in size whatever the input, so it
# can be broadcast; a key that is not in it is certainly not repeated, one that is may be a chance collision.
BITMAP_BITS = 24
MOST_BITS = 28


def bits_for(keys: int) -> int:
    """Bits by which the bitmap of so many keys is at most a sixteenth full, within fixed bounds (2 to 32 MB)."""
    return min(MOST_BITS, max(BITMAP_BITS, (16 * keys).bit_length()))


def repeated_bitmap(counts: DataFrame, key: Column, bits: int = BITMAP_BITS) -> DataFrame:
    """(_bucket, _bitmap) of the keys of counts whose column n is over 1; at most 2**(bits - 15) rows of 4 kB."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1
    return counts.where("n > 1").groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bitmap"))


def maybe_repeated(df: DataFrame, key: Column, bitmap: DataFrame, flag: str, bits: int = BITMAP_BITS) -> DataFrame:
    """df with the boolean column flag: false for keys that are certainly not repeated."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_at div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2.0), F.col("_at") % 8)) % 2
    joined = df.withColumn("_bucket", F.bitmap_bucket_number(slot)).withColumn("_at", at).join(F.broadcast(bitmap), "_bucket", "left")
    return joined.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop("_bucket", "_at", "_bitmap")


#: Keys of over 1/HEAVY of all weight are at most HEAVY in number, and so can be broadcast.
HEAVY = 512


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Left outer join on one column of which right holds each value once; weight says how many rows of left have it.

    Rows of the heaviest keys meet theirs by broadcast, so that no task gets a key with a large share of all rows. right
    should be cheap to read several times.
    """
    total = right.agg(F.sum(weight).alias("_all"))
    heavy = right.join(F.broadcast(total), F.col(weight) * HEAVY > F.col("_all")).drop("_all")
    others = [c for c in right.columns if c != key]
    x = left.join(F.broadcast(heavy.select(key, F.lit(True).alias("_heavy"), *[F.col(c).alias(f"_h{c}") for c in others])), key, "left")
    found = F.coalesce(F.col("_heavy"), F.lit(False))
    a = x.where(found).withColumns({c: F.col(f"_h{c}") for c in others}).drop("_heavy", *[f"_h{c}" for c in others])
    light = right.join(F.broadcast(heavy.select(key)), key, "left_anti")
    b = x.where(~found).drop("_heavy", *[f"_h{c}" for c in others]).join(light, key, "left")
    return a.unionByName(b)
