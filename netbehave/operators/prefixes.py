"""Threat-intelligence context by the longest matching network prefix.

A range join is turned into an equi-join: an address gives one key for each prefix length
that the indicators have (at most 33 of IPv4 and 129 of IPv6), and a prefix is its own key.
Of the prefixes found the longest counts. Only distinct addresses are looked up, so neither
frequent addresses nor wide prefixes multiply anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netbehave.functions.addresses import BITS, address_bits, masked_to, prefix_bits
from netbehave.functions.columns import ref

KEY = ["family", "n_bits", "high", "low"]


def known_prefixes(indicators: DataFrame) -> DataFrame:
    """Rows (family, n_bits, high, low, prefix, matches, confidence), one for each prefix.

    ``indicators`` has ``prefix`` (an address, with or without ``/bits``) and a numeric
    ``confidence``. Bits behind the length are cleared. Rows that cannot be read are left out.
    Of equal prefixes the count and the highest confidence are kept, and the first spelling.
    """
    parts = F.split(F.trim("prefix"), "/")
    bits = F.get(parts, F.lit(1))
    split = indicators.select(
        "prefix",
        "confidence",
        F.get(parts, F.lit(0)).alias("start"),
        bits.alias("bits"),
        F.size(parts).alias("n_parts"),
    ).where("n_parts <= 2")
    read = split.withColumn("address", address_bits(F.col("start"))).where("address IS NOT NULL")
    family = F.col("address.family")
    most = F.when(family == 4, F.lit(BITS[4])).otherwise(F.lit(BITS[6]))
    length = F.when(F.col("n_parts") == 1, most).when(
        F.col("bits").rlike("^[0-9]{1,3}$"), F.col("bits").try_cast("int")
    )
    sized = read.withColumns({"family": family, "most": most, "n_bits": length}).where("n_bits <= most")
    masked = masked_to(F.col("address.high"), F.col("address.low"), F.col("n_bits"))
    return (
        sized.withColumn("masked", masked)
        .select("family", "n_bits", "masked.high", "masked.low", "prefix", "confidence")
        .groupBy(*KEY)
        .agg(
            F.min("prefix").alias("prefix"),
            F.count("*").alias("matches"),
            F.max("confidence").alias("confidence"),
        )
    )


def longest_prefixes(addresses: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows (column, prefix, n_bits, matches, confidence) of the addresses that a prefix covers.

    ``addresses`` may repeat; each distinct one has one row at most.
    """
    # At most 162 rows, for there are no more lengths.
    lengths = [tuple(row) for row in known.select("family", "n_bits").distinct().collect()]
    if not lengths:
        lengths = [(0, 0)]  # no address is of this family
    distinct = addresses.select(ref(column).alias("given")).where("given IS NOT NULL").distinct()
    placed = distinct.withColumn("address", address_bits(F.col("given"))).where("address IS NOT NULL")
    keys = F.array(
        *[
            F.struct(
                F.lit(family).alias("of"),
                F.lit(n_bits).alias("n_bits"),
                prefix_bits(F.col("address.high"), F.col("address.low"), n_bits).alias("masked"),
            )
            for family, n_bits in sorted(lengths)
        ]
    )
    keyed = placed.select("given", F.col("address.family").alias("family"), F.explode(keys).alias("key")).select(
        "given", "family", F.col("key.of").alias("of"), F.col("key.n_bits").alias("n_bits"), "key.masked.*"
    )
    found = keyed.where("of = family").drop("of").join(known, KEY)
    best = F.max_by(F.struct("prefix", "n_bits", "matches", "confidence"), F.col("n_bits"))
    return found.groupBy("given").agg(best.alias("best")).select(F.col("given").alias(column), "best.*")


def enrich_prefixes(rows: DataFrame, indicators: DataFrame, column: str = "src_ip") -> DataFrame:
    """Fill ``cti_context`` of rows whose address lies in a known prefix.

    ``column`` names the address, a source or a target. Rows without one, with an unreadable
    one or outside every prefix keep their context. As in ``enrich`` the join back carries no
    hint, so Spark broadcasts a short list and splits skewed addresses of a long one.
    """
    best = longest_prefixes(rows, known_prefixes(indicators), column)
    found = best.select(
        F.col(column).alias("__given"),
        F.to_json(F.struct("prefix", "matches", "confidence")).alias("__found"),
    )
    joined = rows.join(found, ref(column) == F.col("__given"), "left")
    return joined.select(
        *[
            F.coalesce("__found", "cti_context").alias(name) if name == "cti_context" else ref(name)
            for name in rows.columns
        ]
    )
