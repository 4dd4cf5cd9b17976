"""Shannon entropy in bits per character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a text that are split at a time. The pattern keeps to whole characters
# and does not backtrack.
PIECE = 65_536
PIECES = rf"(?s).{{1,{PIECE}}}+"


def bits(count: Column) -> Column:
    """One character's term: its count times the logarithm of its count."""
    return count * F.log2(count.cast("double"))


def entropy(text: Column) -> Column:
    """Entropy of a text of any length, inside the row: no shuffle.

    With n characters of which one occurs c times, entropy is log2(n) - sum(c log2 c) / n.
    The distinct characters are gathered piece by piece, so the characters of a long text
    are never all in one array; each is then counted by the length that goes with it.
    A null or empty text has entropy 0.
    """
    length = F.length(text)
    none = F.array().cast("array<string>")
    characters = F.aggregate(
        F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)),
        none,
        lambda known, piece: F.array_union(known, F.array_distinct(F.split(piece, ""))),
    )
    weighted = F.aggregate(
        characters,
        F.lit(0.0),
        lambda total, char: total
        + bits(length - F.length(F.replace(text, char, F.lit("")))),
    )
    return F.when(length > 0, F.log2(length.cast("double")) - weighted / length).otherwise(
        F.lit(0.0)
    )
