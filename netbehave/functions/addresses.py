"""IP addresses and prefixes as numbers, all as built-in expressions.

An address is a struct (family, high, low): 4 with its 32 bits at the top of ``high``, or 6
with 64 bits in each. Both are signed, as Spark has no other numbers of 64 bits; only their
bits count. A prefix of n bits is the same with all further bits cleared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"{OCTET}(?:\.{OCTET}){{3}}"
GROUPS = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
BITS = {4: 32, 6: 128}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dotted_number(text: Column) -> Column:
    """The 32 bits of a dotted address as a non-negative number."""
    parts = F.split(text, r"\.")
    return sum(
        (F.get(parts, F.lit(at)).cast("bigint") * F.lit(256 ** (3 - at)) for at in range(4)),
        F.lit(0).cast("bigint"),
    )


def signed(digits: Column) -> Column:
    """Sixteen hexadecimal digits as 64 signed bits."""
    return F.conv(digits, 16, -10).cast("bigint")


def padded(part: Column) -> Column:
    """The groups between colons, each with four digits."""
    groups = F.when(part == "", no_groups()).otherwise(F.split(part, ":"))
    return F.transform(groups, lambda group: F.lpad(group, 4, "0"))


def no_groups() -> Column:
    return F.array().cast("array<string>")


def plain_groups(text: Column) -> Column:
    """``text`` in lower case; a dotted end, which stands for the last two groups, as these."""

    def read(last: Column) -> Column:
        as_groups = let(
            dotted_number(last),
            lambda bits: F.concat(
                F.substring(text, F.lit(1), F.length(text) - F.length(last)),
                F.hex(F.shiftrightunsigned(bits, 16)),
                F.lit(":"),
                F.hex(bits.bitwiseAND(F.lit(0xFFFF))),
            ),
        )
        return F.lower(F.when(last.rlike(f"^{DOTTED}$"), as_groups).otherwise(text))

    return let(F.substring_index(text, ":", -1), read)


def digits_of(halves: Column) -> Column:
    """The 32 digits of an address from its groups before and behind the two colons, or null."""
    gap = F.size(halves) == 2
    tail = F.when(gap, padded(F.get(halves, F.lit(1)))).otherwise(no_groups())

    def fill(both: Column) -> Column:
        missing = F.lit(8) - F.size(both["head"]) - F.size(both["tail"])
        filled = F.concat(both["head"], F.array_repeat(F.lit("0000"), missing), both["tail"])
        # Two colons stand for one group at least.
        fits = F.when(gap, missing >= 1).otherwise(missing == 0)
        return F.when(fits, F.array_join(filled, ""))

    return let(F.struct(padded(F.get(halves, F.lit(0))).alias("head"), tail.alias("tail")), fill)


def address_bits(text: Column) -> Column:
    """The struct (family, high, low) of an address, null for what is no address.

    Octets are decimal numbers without zeros in front. A zone (``%eth0``) is no part of an
    address. An IPv4 address inside an IPv6 one stays one of family 6. Values that are used
    several times are bound once, so that the expression does not grow with its depth.
    """
    four = F.struct(
        F.lit(4).alias("family"),
        F.shiftleft(dotted_number(text), 32).alias("high"),
        F.lit(0).cast("bigint").alias("low"),
    )

    def six(digits: Column) -> Column:
        both = F.struct(
            F.lit(6).alias("family"),
            signed(F.substring(digits, 1, 16)).alias("high"),
            signed(F.substring(digits, 17, 16)).alias("low"),
        )
        return F.when(digits.isNotNull(), both)

    formed = f"^(?:{GROUPS})?(?:::(?:{GROUPS})?)?$"

    def grouped(plain: Column) -> Column:
        is_formed = (plain != "") & plain.rlike(formed)
        return F.when(is_formed, let(let(F.split(plain, "::"), digits_of), six))

    return (
        F.when(text.rlike(f"^{DOTTED}$"), four)
        .when(F.contains(text, F.lit(":")), let(plain_groups(text), grouped))
    )


def masks(n_bits: int) -> tuple[int, int]:
    """Signed masks of the two halves that keep the first bits."""

    def one(kept: int) -> int:
        kept = min(64, max(0, kept))
        return -(1 << (64 - kept)) if kept else 0

    return one(n_bits), one(n_bits - 64)


def prefix_bits(high: Column, low: Column, n_bits: int) -> Column:
    """Struct (high, low) with all but the first bits cleared."""
    keep_high, keep_low = masks(n_bits)
    return F.struct(
        high.bitwiseAND(F.lit(keep_high).cast("bigint")).alias("high"),
        low.bitwiseAND(F.lit(keep_low).cast("bigint")).alias("low"),
    )


def masked_to(high: Column, low: Column, n_bits: Column) -> Column:
    """As ``prefix_bits`` with the number of bits in a column, 0 to 128."""

    def keep(bits: Column) -> Column:
        kept = F.least(F.greatest(bits, F.lit(0)), F.lit(64))
        # A shift by 64 bits would be one by none.
        return F.when(kept == 0, F.lit(0).cast("bigint")).otherwise(
            F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(64) - kept).cast("int"))
        )

    return F.struct(
        high.bitwiseAND(keep(n_bits)).alias("high"), low.bitwiseAND(keep(n_bits - 64)).alias("low")
    )
