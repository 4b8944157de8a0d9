"""A key filter of fixed size, so that a join with a few keys doesn't shuffle all rows.

The filter is a table of at most `words` rows of 64 bits each: a key sets BITS
bits of one row. It is built by one pre-aggregated sum over the keys and sent to
the executors, which is safe at any size because its rows are bounded. Rows
that it lets through hold all that are sought and a few others, so an exact join
follows. With very many keys it lets more through, in the end everything.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BITS = 1 << 18, 3


def _place(key: Column, words: int, hashed: bool = False) -> tuple[Column, Column]:
    """The row of a whole number, and its bits in it. A number that is a hash already is taken as it is."""
    h = key if hashed else F.xxhash64(key.cast("long"), F.lit(5))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 40 + 6 * i), F.lit(64)).cast("int")) for i in range(BITS)]
    return F.pmod(h, F.lit(words)).cast("int"), reduce(lambda a, b: a.bitwiseOR(b), bits)


def sieve(keys: DataFrame, column: str, words: int = WORDS, hashed: bool = False) -> DataFrame:
    """(sieve_word, sieve_bits) of the non-null keys of a column: `words` rows at most."""
    word, bits = _place(F.col(column), words, hashed)
    return keys.where(F.col(column).isNotNull()).select(word.alias("sieve_word"), bits.alias("b")).groupBy("sieve_word").agg(F.bit_or("b").alias("sieve_bits"))


def marked(df: DataFrame, column: str, held: DataFrame, mark: str, words: int = WORDS) -> DataFrame:
    """df with a boolean: whether its key may be among the sieve's; false for a null key. No shuffle.

    held has at most `words` rows of 12 bytes, whatever it was made from.
    """
    word, bits = _place(F.col(column), words)
    sent = F.broadcast(held.withColumnsRenamed({"sieve_word": f"{mark}_word", "sieve_bits": f"{mark}_bits"}))
    joined = df.withColumn(f"{mark}_at", F.when(F.col(column).isNotNull(), word)).join(sent, F.col(f"{mark}_at") == F.col(f"{mark}_word"), "left")
    may = F.coalesce(F.col(f"{mark}_bits").bitwiseAND(bits) == bits, F.lit(False))
    return joined.withColumn(mark, may).drop(f"{mark}_at", f"{mark}_word", f"{mark}_bits")


def passing(df: DataFrame, column: str, held: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of df whose key may be among the sieve's. No shuffle."""
    return marked(df, column, held, "_sieved", words).where("_sieved").drop("_sieved")


def bitmap(hashes: DataFrame, column: str, words: int = WORDS) -> np.ndarray:
    """The sieve of a column of 64-bit hashes, as an array of `words` numbers (a power of two) for among()."""
    out = np.zeros(words, np.uint64)
    for r in sieve(hashes, column, words, hashed=True).collect():  # `words` rows at most
        out[r["sieve_word"]] = r["sieve_bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def among(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) may be among those of the bitmap."""
    row = held[hashes & np.uint64(len(held) - 1)]
    out = np.ones(len(hashes), bool)
    for i in range(BITS):
        out &= (row >> ((hashes >> np.uint64(40 + 6 * i)) & np.uint64(63))) & np.uint64(1) == 1
    return out
