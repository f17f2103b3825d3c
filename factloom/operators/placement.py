"""Fingerprints of where entities stand, maintained from a log of edges.

An entity's fingerprint is its number of live edges and two sums of hashes of
them.  Sums do not depend on order, and an edge that goes takes away what it
brought, so parts of a log add up: a stream keeps the sums of what it has seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODULUS = 1 << 32


def edge_sums(log: DataFrame) -> DataFrame:
    """(entity_id, n, low, high) of a part of a log (entity_id, rel_type, object, live): +1 where live turns true, -1 where it turns false."""
    sign = F.when(F.col("live"), 1).otherwise(-1)
    digest = F.md5(F.concat_ws("\u001f", "rel_type", "object"))
    half = lambda start: sign * F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
    return log.groupBy("entity_id").agg(F.sum(sign).alias("n"), F.pmod(F.sum(half(1)), F.lit(MODULUS)).alias("low"), F.pmod(F.sum(half(9)), F.lit(MODULUS)).alias("high"))


def added(*parts: DataFrame) -> DataFrame:
    """The sums of a log from those of its parts."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("entity_id").agg(F.sum("n").alias("n"), *[F.pmod(F.sum(c), F.lit(MODULUS)).alias(c) for c in ("low", "high")])


def fingerprints(sums: DataFrame) -> DataFrame:
    """(entity_id, n, fingerprint) of the entities with live edges."""
    hex8 = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return sums.where("n <> 0 or low <> 0 or high <> 0").select("entity_id", "n", F.concat(F.col("n").cast("string"), F.lit("-"), hex8("low"), hex8("high")).alias("fingerprint"))


def to_place(wanted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Entities of ``wanted`` (entity_id, fingerprint) whose last verdict (entity_id, verdict, attempts, fingerprint) does not hold any more.

    A verdict holds while the fingerprint is the same.
    """
    last = verdicts.select("entity_id", F.col("fingerprint").alias("seen"))
    return wanted.join(last, "entity_id", "left").where("seen is null or seen <> fingerprint").drop("seen")
