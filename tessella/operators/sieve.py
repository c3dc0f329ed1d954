"""Joins of a wide table with keys of any number, in one plan at every size.

`sift` parts the rows that surely lack a key from those that may have it, by a blocked Bloom
filter of at most 2^`MOST_BITS` words: that bounds what is broadcast whatever the number of keys.
Only rows that may match move to an exact (sort-merge) join; past the filter's capacity more rows
move, none is decided wrongly.

`join_split` joins on a key that may be hot: keys with so many rows that at most `HOT_KEYS` such
keys can exist are broadcast, and their rows stay where they are; only the rest is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import unused

#: Words of 64 bits in the filter (as a power of two), and keys a word for which it is sized.
MOST_BITS, KEYS_A_WORD = 20, 6
#: Rows from which a key is hot, at least; number of hot keys at most.
HOT_ROWS, HOT_KEYS = 100_000, 100_000


def _word(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(f"`{key}`"), 64 - bits) if bits else F.when(F.col(f"`{key}`").isNotNull(), F.lit(0).cast("long"))


def _mask(key: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int)) | shiftleft(1L, cast((`{key}` >> 6) & 63 as int)) | shiftleft(1L, cast((`{key}` >> 12) & 63 as int))")


def sift(rows: DataFrame, key: str, keys: DataFrame, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows that surely have no key of `keys` (one column of stored 64-bit hashes), and those that may; a null key has none."""
    own = keys.toDF("h").where(F.col("h").isNotNull())
    bits = min(most_bits, (own.count() // KEYS_A_WORD).bit_length())
    words = own.select(_word("h", bits).alias("w"), _mask("h").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    word, mask, set_ = unused(rows, "sieve_word", "sieve_mask", "sieve_set")
    seen = rows.withColumn(word, _word(key, bits)).withColumn(mask, _mask(key)).join(F.broadcast(words.toDF(word, set_)), word, "left")
    maybe = F.coalesce((F.col(set_).bitwiseAND(F.col(mask))) == F.col(mask), F.lit(False))
    return seen.where(~maybe).drop(word, mask, set_), seen.where(maybe).drop(word, mask, set_)


def join_split(rows: DataFrame, side: DataFrame, key: str, n: str = "n", how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """`rows` joined on `key` with stored `side`, which has one row a key and in `n` its number of rows in `rows`."""
    total = side.agg(F.sum(n)).collect()[0][0] or 0
    hot = F.col(n) >= max(hot_rows, -(-total // HOT_KEYS))
    keys = F.broadcast(side.where(hot).select(key))
    many = rows.join(keys, key, "left_semi").join(F.broadcast(side.where(hot).drop(n)), key)
    few = rows.join(keys, key, "left_anti").join(side.where(~hot).drop(n), key, how)
    return many.unionByName(few)
