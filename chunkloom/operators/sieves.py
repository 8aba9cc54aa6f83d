"""Sets of fixed size by hash: rows that a later step surely leaves alone are told apart before anything is shuffled.

A sieve may hold more than was put in, but never lacks any of it. So it only saves work; what it lets through must still
be joined or grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a sieve, in rows of 64; at most 1 MB.
BITS = 1 << 22


def of_hashes(rows: DataFrame) -> DataFrame:
    """(at, bits): a set of the hashes h."""
    h = F.pmod("h", F.lit(BITS))
    return rows.groupBy(F.shiftright(h, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), h.cast("int") % 64)).alias("bits"))


def sieve(marks: DataFrame) -> DataFrame:
    """(at, bits): a set of the rows of marks."""
    return of_hashes(marks.select(F.xxhash64(*marks.columns).alias("h")))


def marked(rows: DataFrame, among: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    """rows with a column that tells whether the sieve may hold their columns; the sieve is broadcast."""
    s = F.broadcast(among.withColumnsRenamed({"at": f"{name}_at", "bits": f"{name}_bits"}))  # BITS / 64 rows at most
    h = F.pmod(F.xxhash64(*columns), F.lit(BITS))
    j = rows.join(s, F.shiftright(h, 6) == F.col(f"{name}_at"), "left")
    return j.withColumn(name, F.coalesce(F.getbit(f"{name}_bits", h.cast("int") % 64) == 1, F.lit(False))).drop(f"{name}_at", f"{name}_bits")


def kept(rows: DataFrame, among: DataFrame, *columns: str | Column) -> DataFrame:
    """The rows whose columns the sieve may hold."""
    return marked(rows, among, "_held", *columns).filter("_held").drop("_held")


def repeated(rows: DataFrame, column: str) -> DataFrame:
    """A sieve of the values that come more than once; of each row, only a hash is shuffled."""
    h = rows.filter(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))
    return of_hashes(h.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
