"""Columns and filters that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a sieve: at most 2**19 rows of 64 bits, whatever the number of keys.
SIEVE_BITS = 1 << 25


def unused(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores in front as it takes to clash with none of columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def sieved(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows whose key (a long) is probably among wanted's: all that are, and some that aren't. Before a join that has to
    shuffle rows of whole texts, so that few others travel. The filter is a table of ``SIEVE_BITS`` bits, so its broadcast is
    bounded by construction; with more keys than bits it only lets more rows through."""
    place, word, bits = unused(rows.columns, "sieve_place", "sieve_word", "sieve_bits")
    spot = F.pmod(wanted_key, F.lit(SIEVE_BITS))
    table = wanted.select(spot.alias(place)).groupBy(F.shiftright(F.col(place), 6).alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} % 64 as int)))").alias(bits))
    placed = rows.withColumn(place, F.pmod(key, F.lit(SIEVE_BITS)))
    joined = placed.withColumn(word, F.shiftright(F.col(place), 6)).join(F.broadcast(table), word)
    return joined.where(F.expr(f"getbit({bits}, cast({place} % 64 as int)) = 1")).select(rows.columns)
