"""Building blocks of the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Runs of characters other than ``BLANK``; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, BLANK + "+"))
    ends = F.when(t.rlike("^" + BLANK), 1).otherwise(0) + F.when(t.rlike(BLANK + r"\z"), 1).otherwise(0)
    return F.when(t == "", F.lit(0)).otherwise(parts - ends).cast("long")


def _bit(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))


def bitmap_of(keys: DataFrame, key: str, bits: int = 22) -> Column:
    """Bitmap over hashed keys, as a one-value subquery of fixed size (2**bits / 8 bytes, whatever the keys are)."""
    b = _bit(F.col(key), bits)
    words = keys.select(F.shiftright(b, 6).alias("w"), F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 as int))").alias("m"))
    words = words.groupBy("w").agg(F.bit_or("m").alias("m"))
    every = keys.sparkSession.range(0, 1 << (bits - 6), 1, 1).withColumnRenamed("id", "w")
    full = every.join(words, "w", "left").select("w", F.coalesce("m", F.lit(0)).alias("m"))
    row = full.agg(F.sort_array(F.collect_list(F.struct("w", "m"))).alias("a")).select(F.col("a.m").alias("a"))
    return row.scalar()


def maybe_in(key: Column, bitmap: Column, bits: int = 22) -> Column:
    """True for every key of the bitmap, and by chance for some others: a filter in front of an exact join."""
    h = F.xxhash64(key)
    word = F.get(bitmap, F.shiftright(h.bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int"))
    return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1
