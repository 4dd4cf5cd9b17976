"""Query-name features: one row per DNS row, computed inside the row without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netbehave.constants import NO_SOURCE
from netbehave.functions.columns import has, number, ref, value
from netbehave.functions.entropy import entropy
from netbehave.operators import schemas
from netbehave.operators.connections import address, empty

if TYPE_CHECKING:
    import pyarrow as pa


def three_places(column):
    """Rounded as a scaled array value is: times 1000, nearest with ties to even."""
    return F.rint(column * 1000) / 1000


def dns_features(dns: DataFrame, identity: bool = False) -> DataFrame:
    """Per row with a query: source, query, length and entropy of the query.

    ``identity`` adds the row's time and uid, as far as the log has them.
    """
    if not has(dns, "query"):
        return empty(dns, schemas.DNS)
    source = address(dns, "src") if has(dns, "src") else F.lit(NO_SOURCE)
    more = []
    if identity and has(dns, "time"):
        more.append(number(dns, "time").alias("ts"))
    if identity and "uid" in dns.columns:
        more.append(ref("uid"))
    rows = dns.where(value(dns, "query").isNotNull()).select(
        source.alias("src_ip"), address(dns, "query").alias("query"), *more
    )
    return rows.select(
        "src_ip",
        "query",
        F.length("query").alias("qlen"),
        three_places(entropy(F.col("query"))).alias("entropy"),
        *rows.columns[2:],
    )


def text_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: its key and the entropy of a whole text of any length, null or empty ones 0.

    Built-in expressions look at a text once for each of its distinct characters, which is
    good for names and URLs. Documents are counted in one look over Arrow batches, still
    inside the row and without a shuffle; a text takes four bytes a character meanwhile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        def bits(one: str | None) -> float:
            if not one:
                return 0.0
            codes = np.frombuffer(one.encode("utf-32-le", "surrogatepass"), np.uint32)
            # Few texts have characters so far up that counting by number would not pay.
            few = codes.max() < 65_536
            counts = np.bincount(codes) if few else np.unique(codes, return_counts=True)[1]
            counts = counts[counts > 0].astype(np.float64)
            return float(np.log2(len(codes)) - (counts * np.log2(counts)).sum() / len(codes))

        for batch in batches:
            # Text by text, so that Python holds one of them at a time.
            found = [bits(one.as_py()) for one in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["key", "entropy"])

    rows = df.select(ref(key).alias("key"), ref(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["key"], T.StructField("entropy", T.DoubleType())])
    found = rows.mapInArrow(run, schema)
    return found.select(F.col("key").alias(key), three_places(F.col("entropy")).alias("entropy"))
