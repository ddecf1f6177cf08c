"""Seeded generators of candidate names: every row follows from its number and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namequarry.functions.handles import valid_handle

CONSONANTS, VOWELS = "bcdfghjklmnprstvwz", "aeiou"


def _pick(pool: str, seed: int, place: Column) -> Column:
    at = F.pmod(F.xxhash64(F.col("id"), place, F.lit(seed)), F.lit(len(pool))).cast("int") + 1
    return F.substring(F.lit(pool), at, F.lit(1))


def readable(spark: SparkSession, n: int, shortest: int, longest: int, seed: int, tail: bool = False) -> DataFrame:
    """About n distinct names of alternating consonants and vowels, with two digits at the end if ``tail``."""
    size = F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit("size")), F.lit(longest - shortest + 1)) + shortest
    letters = F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), lambda i: F.when(i % 2 == 1, _pick(CONSONANTS, seed, i)).otherwise(_pick(VOWELS, seed, i))), "")
    name = F.concat(letters, F.lpad(F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit("tail")), F.lit(100)).cast("string"), 2, "0")) if tail else letters
    return spark.range(n).select(name.alias("name")).where(valid_handle(F.col("name"), shortest)).distinct()


def random_names(spark: SparkSession, n: int, shortest: int, longest: int, seed: int, pool: str = "abcdefghijklmnopqrstuvwxyz0123456789_") -> DataFrame:
    """About n distinct valid names over a pool of characters."""
    size = F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit("size")), F.lit(longest - shortest + 1)) + shortest
    name = F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), lambda i: _pick(pool, seed, i)), "")
    return spark.range(n).select(name.alias("name")).where(valid_handle(F.col("name"), shortest)).distinct()


def compounds(left: DataFrame, right: DataFrame, column: str, seed: int, each: int, longest: int = 32) -> DataFrame:
    """Every left word with ``each`` right words (all of them, if there are fewer) picked by hash: no cross join, the right words are numbered and looked up.

    The numbers 1, 2, ... follow the words' hashes: sums per bin of the hash, then within the bin, so no task orders all words.
    """
    words = right.select(F.col(column).alias("r")).distinct().withColumn("h", F.xxhash64("r", F.lit(seed))).withColumn("bin", F.pmod("h", F.lit(256)))
    bins = words.groupBy("bin").agg(F.count("*").alias("n"))
    bins = bins.select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # 256 bins
    numbered = words.withColumn("in_bin", F.row_number().over(Window.partitionBy("bin").orderBy("h", "r")) - 1).join(F.broadcast(bins), "bin").select("r", (F.col("base") + F.col("in_bin")).alias("no"))
    count = max(1, words.count())
    start = F.pmod(F.xxhash64(F.col("l"), F.lit(seed)), F.lit(count))
    step = max(1, count // max(1, each))
    wanted = left.select(F.col(column).alias("l")).distinct().withColumn("no", F.explode(F.transform(F.sequence(F.lit(0), F.lit(min(each, count) - 1)), lambda i: (start + i * step) % count)))
    return wanted.join(numbered, "no").select(F.concat("l", "r").alias("name")).where((F.length("name") <= longest) & (F.col("l") != F.col("r"))).distinct()


def with_digits(base: Column, policy: str, shortest: int, longest: int, seed: int) -> Column:
    """A base cut to ``longest``, and by policy: ``none`` as it is, ``required`` with digits at the end, ``optional`` with them for half of the bases and where it is too short.

    Digits follow from the base and the seed; they fill up to ``shortest``, one at least.
    """
    roll = F.pmod(F.xxhash64(base, F.lit(seed)), F.lit(10**9))
    short = F.greatest(shortest - F.length(base), F.lit(0))
    wanted = F.lit(True) if policy == "required" else (F.pmod(roll, F.lit(2)) == 0) | (short > 0)
    size = F.least(F.greatest(short, F.lit(1) + roll % 2), F.lit(9)).cast("int")
    tail = F.substring(F.lpad(roll.cast("string"), 9, "0"), F.lit(1), size)
    kept = F.substring(base, F.lit(1), F.greatest(F.lit(1), longest - size))
    return F.substring(base, 1, longest) if policy == "none" else F.when(wanted, F.concat(kept, tail)).otherwise(F.substring(base, 1, longest))


def with_word(spark: SparkSession, n: int, word: str, position: str, shortest: int, longest: int, seed: int) -> DataFrame:
    """About n distinct valid names that hold ``word`` at the start, middle, end or ``any`` place, beside readable filler."""
    room = longest - len(word)
    if room < 0:
        return spark.createDataFrame([], "name string")
    least = max(0, shortest - len(word))
    size = (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit("size")), F.lit(room - least + 1)) + least).cast("int")
    filler = F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.when(i % 2 == 1, _pick(CONSONANTS, seed, i)).otherwise(_pick(VOWELS, seed, i))), "")).otherwise("")
    half = F.floor(F.length(filler) / 2).cast("int")
    at = {"start": F.lit(0), "end": F.length(filler), "middle": half, "any": F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit("at")), F.length(filler) + 1)}[position].cast("int")
    rows = spark.range(n).withColumn("filler", filler).withColumn("at", at)
    name = F.concat(F.expr("substring(filler, 1, at)"), F.lit(word), F.expr("substring(filler, at + 1)"))
    return rows.select(name.alias("name")).where(valid_handle(F.col("name"), shortest)).distinct()


def dictionary_names(words: DataFrame, column: str, policy: str, shortest: int, longest: int, seed: int) -> DataFrame:
    """Valid names from the words of a table, with digits by policy."""
    base = words.select(F.lower(column).alias("w")).where(F.col("w").rlike("^[a-z][a-z0-9]*$")).distinct()
    return base.select(with_digits(F.col("w"), policy, shortest, longest, seed).alias("name")).where(valid_handle(F.col("name"), shortest)).distinct()
