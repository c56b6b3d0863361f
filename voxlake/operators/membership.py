"""Bloom filters: rows whose key is surely not wanted go inside the scan, before any shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.session import write_table

WORD_BITS = 64
# Bits a key, and places it sets: about one key in a hundred passes without being wanted.
BITS_PER_KEY = 10
PLACES = 7
# The filter travels with every task. Beyond this size, met by 26 million keys, more keys
# pass without being wanted; the exact join that follows gets more rows and no other ones.
MOST_WORDS = 2**22


def filter_words(n_keys: int, most_words: int = MOST_WORDS) -> int:
    """Words of a filter for `n_keys` keys."""
    return min(max(math.ceil(n_keys * BITS_PER_KEY / WORD_BITS), 1), most_words)


def filter_places(n_keys: int, n_words: int) -> int:
    """Bits a key sets: the best number for a filter of this size, `PLACES` at most."""
    return min(max(round(n_words * WORD_BITS / max(n_keys, 1) * math.log(2)), 1), PLACES)


def _bits(key: Column, n_words: int, n_places: int) -> list[Column]:
    """The places of a key, by one hash a place."""
    return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(n_words * WORD_BITS)) for k in range(n_places)]


def _word(bit: Column) -> Column:
    return F.shiftright(bit, 6).cast("int")


def _flag(bit: Column) -> Column:
    """The bit inside its word, as a number."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(WORD_BITS)).cast("int"))


def bloom_filter(keys: DataFrame, key: str, n_keys: int, most_words: int = MOST_WORDS) -> DataFrame:
    """(words): the filter of all keys in one row of `filter_words` numbers.

    Every task sets bits of its own keys; words of the same place are put together by
    `bit_or`, at first inside the task. Null keys set nothing.
    """
    spark = keys.sparkSession
    n_words = filter_words(n_keys, most_words)
    bits = _bits(F.col(key), n_words, filter_places(n_keys, n_words))
    held = (
        keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*bits)).alias("bit"))
        .groupBy(_word(F.col("bit")).alias("at")).agg(F.bit_or(_flag(F.col("bit"))).alias("flags"))
    )
    every = spark.range(n_words).select(F.col("id").cast("int").alias("at"))
    words = every.join(held, "at", "left").select("at", F.coalesce("flags", F.lit(0)).alias("flags"))
    # One list whose length is known beforehand.
    ordered = F.array_sort(F.collect_list(F.struct("at", "flags")))
    return words.agg(F.transform(ordered, lambda w: w["flags"]).alias("words"))


def maybe_wanted(rows: DataFrame, key: str, wanted: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """`rows` without most of those whose key is not in `wanted` (written, one column `key`).

    No row with a wanted key is lost. Rows without a key are. The filter is read by the scan
    as a value, so nothing is shuffled or joined.
    """
    n_keys = wanted.count()  # from the file footers
    if n_keys == 0:
        return rows.where(F.lit(False))
    n_words = filter_words(n_keys, most_words)
    words = write_table(bloom_filter(wanted, key, n_keys, most_words), "filter").scalar()
    passes = F.col(key).isNotNull()
    for bit in _bits(F.col(key), n_words, filter_places(n_keys, n_words)):
        passes = passes & (F.get(words, _word(bit)).bitwiseAND(_flag(bit)) != 0)
    return rows.where(passes)
