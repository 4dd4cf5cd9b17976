"""Near-duplicate groups by b-bit MinHash, with every link confirmed on whole sets.

1. Every text becomes the set of its word shingles. Texts with equal sets form a class
   and only one of them, the representative, goes on.
2. A representative has 192 minima. Bands of six (of five at a threshold of 0.8) give
   candidate buckets; the lowest two bits of each minimum, packed, give an estimate of the
   similarity from bit counts, corrected for minima that agree in two bits by chance.
3. The least key of a bucket is its hub. All members of buckets with one hub form a group,
   which holds every pair that shares a bucket. A large group is dealt out in chunks that
   all hold the hub. In a chunk, pairs with a sufficient estimate are confirmed on the
   whole shingle sets, and each linked set of members leaves as a star. Pairs are compared
   in place and never become rows.
4. Members of a group that are not linked to its hub yet meet the other chunks in a second
   round, so no pair of different components goes uncompared.
5. Components spread over the links by label propagation, then over the classes.

A pair at the threshold shares no bucket with probability (1 - 0.85^6)^32 = 3e-7, or
(1 - 0.8^5)^38 = 3e-7, and its estimate is too low with about the same probability (5
standard deviations).

Results for odd rows: a null text, or one without words, has an empty set and is its own
component. Rows with the same ``doc_id`` are each answered; one text under two ids is
linked. An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not
read by ``near_duplicates``; ``one_of_each`` hands them through under whatever names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netbehave.llm.graph import components
from netbehave.llm.shingles import mixed, shingle_sets
from netbehave.llm.words import map_slices, stored

PERCENT = 85  # least similarity of a link
BANDS, ROWS, BITS = 32, 6, 2  # at PERCENT
MISSED = 1e-6  # bound of the chance that a pair at the threshold shares no bucket
DEVIATIONS = 5.27  # how far below the threshold an estimate may lie
CHUNK_MEMBERS, CHUNK_SHINGLES = 512, 500_000  # of a group, in one comparison
COLUMNS = 4096  # shingles per matrix product

HASHES = BANDS * ROWS
WORDS = HASHES * BITS // 64
FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
PAIR_BITS = np.uint64(0x5555555555555555)


# ---------------------------------------------------------------- signatures


def minima(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Least 32-bit hash of each set under each hash function; sets must not be empty."""
    result = np.empty((len(limits) - 1, HASHES), np.uint32)
    sizes = np.diff(limits)
    # Sets are taken in runs of about 32,000 values, which stay in the processor's cache.
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(limits, limits[start] + 32_768, "right")) - 1)
        part = values[limits[start] : limits[stop]]
        places = limits[start:stop] - limits[start]
        for at, factor in enumerate(FACTORS):
            hashed = (part * factor) >> np.uint64(32)
            result[start:stop, at] = np.minimum.reduceat(hashed, places)
        start = stop
    return result


def band_rows(percent: int) -> int:
    """Most minima to a band with which a pair at the threshold is still found."""
    rows = range(HASHES, 0, -1)
    return next((n for n in rows if (1 - (percent / 100) ** n) ** (HASHES // n) <= MISSED), 1)


def margin(percent: int) -> float:
    chance = 1 / (1 << BITS)
    agree = chance + (1 - chance) * percent / 100
    return DEVIATIONS * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)


def band_hashes(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash per band, different for equal minima in different bands."""
    bands = HASHES // rows
    parts = least[:, : bands * rows].reshape(len(least), bands, rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for row in range(rows):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, row])
    return total


def packed(least: np.ndarray) -> np.ndarray:
    """Lowest bits of the minima, 32 of them to a 64-bit word."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), WORDS, -1)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(
        axis=2, dtype=np.uint64
    )


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of each left signature with each right one.

    Two minima that differ agree in their low bits once in 2^BITS, which is taken off.
    """
    differing = np.zeros((len(left), len(right)), np.int64)
    for word in range(WORDS):
        other = left[:, word, None] ^ right[None, :, word]
        other = (other | (other >> np.uint64(1))) & PAIR_BITS
        differing += np.bitwise_count(other)
    chance = 1 / (1 << BITS)
    return (1 - differing / HASHES - chance) / (1 - chance)


def set_keys(values: np.ndarray, limits: np.ndarray) -> list[bytes | None]:
    return [
        hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None
        for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())
    ]


LONGS = pa.list_(pa.int64())
FEATURES = "doc_id long, n_shingles long, key binary, bands array<long>, bits array<long>"


def lists(rows: np.ndarray, there: np.ndarray) -> pa.Array:
    """Rows of 64-bit numbers as lists, null where ``there`` is false."""
    offsets = np.arange(len(rows) + 1) * rows.shape[1]
    flat = pa.array(rows.reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat, mask=pa.array(~there))


def features(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Size and key of each set, band hashes and packed bits; nulls for empty sets."""
    n_rows = band_rows(percent)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        values, limits = shingle_sets(part.column("text").to_pylist())
        sizes = np.diff(limits)
        there = sizes > 0
        least = np.zeros((len(sizes), HASHES), np.uint32)
        if there.any():
            least[there] = minima(values, np.append(limits[:-1][there], limits[-1]))
        arrays = [
            part.column("doc_id"),
            pa.array(sizes),
            pa.array(set_keys(values, limits), pa.binary()),
            lists(band_hashes(least, n_rows), there),
            lists(packed(least), there),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in FEATURES.split(", ")])

    return map_slices(docs.select("doc_id", "text"), work, FEATURES)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (key, values) with the shingles of the representatives in ``wanted`` (doc_id, key)."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        values, limits = shingle_sets(part.column("text").to_pylist())
        keys = set_keys(values, limits)
        same = np.array([a == b for a, b in zip(keys, part.column("key").to_pylist())], bool)
        found = pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(values.view(np.int64)))
        # An id may have several texts; the one with the key is meant.
        both = pa.RecordBatch.from_arrays([part.column("key"), found], names=["key", "values"])
        return both.filter(pa.array(same))

    texts = docs.select("doc_id", "text").join(wanted.select("doc_id", "key"), "doc_id")
    found = map_slices(texts.select("key", "text"), work, "key binary, values array<long>")
    # Repeated rows give a set twice, which costs a comparison and changes nothing.
    return found


# ---------------------------------------------------------------- comparison


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every two sets, by matrix products over shared values."""
    limits = np.concatenate([[0], np.cumsum([len(one) for one in sets])])
    owner = np.repeat(np.arange(len(sets)), np.diff(limits))
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A value of one set only is in no intersection.
    shared = np.cumsum(times > 1) - 1
    kept = times[number] > 1
    number, owner = shared[number[kept]], owner[kept]
    result = np.zeros((len(sets), len(sets)))
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        a, b = np.searchsorted(number, [low, low + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(number[-1]) + 1 - low)), np.float32)
        part[owner[a:b], number[a:b] - low] = 1
        result += part @ part.T
    return result


def linked(sets: list[np.ndarray], bits: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs are links: a sufficient estimate, then the whole sets."""
    sizes = np.array([len(one) for one in sets])
    likely = estimates(bits, bits) >= percent / 100 - margin(percent)
    likely &= 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
    np.fill_diagonal(likely, False)
    chosen = np.flatnonzero(likely.any(axis=1))
    result = np.zeros_like(likely)
    if len(chosen):
        both = shared_counts([sets[at] for at in chosen])
        union = np.add.outer(sizes[chosen], sizes[chosen]) - both
        result[np.ix_(chosen, chosen)] = 100 * both >= percent * union
    return result & likely


def least_linked(links: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Least start number among all members that links lead to."""
    label = start.copy()
    while True:
        near = np.minimum(label, np.where(links, label[None, :], len(start)).min(axis=1, initial=len(start)))
        if (near == label).all():
            return label
        label = near


def group_arrays(group: pa.Table) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    keys = group.column("key").to_pylist()
    column = group.column("values").combine_chunks()
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    base = offsets[0]
    sets = [flat[a - base : b - base] for a, b in zip(offsets[:-1], offsets[1:])]
    bits = group.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64)
    return keys, sets, bits.reshape(len(keys), WORDS)


def edges_table(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    columns = [[pair[side] for pair in pairs] for side in (0, 1)]
    return pa.table([pa.array(one, pa.binary()) for one in columns], names=["a", "b"])


def within_chunk(percent: int):
    def run(group: pa.Table) -> pa.Table:
        keys, sets, bits = group_arrays(group)
        label = least_linked(linked(sets, bits, percent), np.arange(len(keys)))
        return edges_table([(keys[at], keys[to]) for at, to in enumerate(label.tolist()) if at != to])

    return run


def across_chunks(percent: int):
    def run(group: pa.Table) -> pa.Table:
        keys, sets, bits = group_arrays(group)
        labels = group.column("label").to_pylist()
        outside = np.array(group.column("outside").to_pylist(), bool)
        found = linked(sets, bits, percent) & (outside[:, None] | outside[None, :])
        pairs = {
            (min(labels[a], labels[b]), max(labels[a], labels[b]))
            for a, b in np.argwhere(found).tolist()
            if labels[a] != labels[b]
        }
        return edges_table(sorted(pairs))

    return run


# ---------------------------------------------------------------- groups


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    rows = stored(features(docs, percent), "features")
    real = rows.where("key IS NOT NULL")
    # Bands and bits are the same for all rows of a class.
    classes = stored(
        real.groupBy("key").agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("bits").alias("bits"),
        ),
        "classes",
    )
    banded = classes.select("key", F.explode("bands").alias("band"))
    hubs = (
        banded.groupBy("band")
        .agg(F.min("key").alias("hub"), F.count("*").alias("n"))
        .where("n > 1")
        .select("band", "hub")
    )
    pairs = stored(banded.join(hubs, "band").where("key <> hub").select("hub", "key").distinct(), "pairs")

    members = pairs.select("key").union(pairs.select("hub")).distinct()
    wanted = classes.join(members, "key").select(F.col("rep").alias("doc_id"), "key")
    described = stored(
        sets_of(docs, wanted).join(classes.select("key", "bits", "n_shingles"), "key"), "sets"
    )
    sized = pairs.join(described.select("key", "n_shingles"), "key")
    groups = stored(
        sized.groupBy("hub")
        .agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
        .select(
            "hub",
            F.greatest(
                F.ceil(F.col("n") / CHUNK_MEMBERS), F.ceil(F.col("total") / CHUNK_SHINGLES), F.lit(1)
            ).cast("int").alias("chunks"),
        ),
        "groups",
    )
    dealt = pairs.join(groups, "hub").select(
        "hub", "key", "chunks", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk")
    )
    everywhere = groups.select(
        "hub",
        F.col("hub").alias("key"),
        "chunks",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
    )
    edges = (
        dealt.union(everywhere)
        .join(described, "key")
        .select("hub", "chunk", "key", "values", "bits")
        .groupBy("hub", "chunk")
        .applyInArrow(within_chunk(percent), "a binary, b binary")
    )
    first = components(edges)

    # Groups of several chunks whose members are not all linked with the hub.
    several = dealt.where("chunks > 1")
    label = F.coalesce(F.col("label"), F.col("key"))
    labelled = several.join(first.withColumnRenamed("node", "key"), "key", "left").select(
        "hub", "key", "chunks", "chunk", label.alias("label")
    )
    hub_labels = first.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    labelled = stored(
        labelled.join(hub_labels, "hub", "left").select(
            "hub", "key", "chunks", "chunk", "label",
            (F.col("label") != F.coalesce("hub_label", "hub")).alias("outside"),
        ),
        "labelled",
    )
    outside = labelled.where("outside")
    away = outside.groupBy("hub").agg(F.count("*").alias("n_outside")).select(
        "hub", F.ceil(F.col("n_outside") / CHUNK_MEMBERS).cast("int").alias("parts")
    )
    parts = labelled.join(away, "hub").withColumn(
        "part", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int")
    )
    columns = ["hub", "key", "label", "part", "chunk"]
    visiting = parts.where("outside").select(
        "hub", "key", "label", "part",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(True).alias("outside"),
    )
    resident = parts.select(
        "hub", "key", "label",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        "chunk",
        F.lit(False).alias("outside"),
    )
    more = (
        visiting.union(resident)
        .groupBy(*columns)
        .agg(F.max("outside").alias("outside"))
        .join(described, "key")
        .select(*columns, "outside", "values", "bits")
        .groupBy("hub", "part", "chunk")
        .applyInArrow(across_chunks(percent), "a binary, b binary")
    )
    second = components(more).select(F.col("node").alias("label"), F.col("label").alias("joined"))
    labels = first.join(second, "label", "left").select(
        F.col("node").alias("key"), F.coalesce("joined", "label").alias("label")
    )
    # A class without a link in the first round may have one in the second.
    alone = second.select(F.col("label").alias("key"), F.col("joined").alias("label"))
    labels = labels.union(alone.join(labels.select("key"), "key", "left_anti"))

    placed = stored(
        classes.select("key", "rep")
        .join(labels, "key", "left")
        .select("key", "rep", F.coalesce("label", "key").alias("label")),
        "placed",
    )
    least = placed.groupBy("label").agg(F.min("rep").alias("component_id"))
    answer = placed.join(least, "label").select("key", "component_id")
    found = rows.select("doc_id", "n_shingles", "key").join(answer, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` whose document is kept, one row for each ``doc_id``.

    A ``doc_id`` stays if one of its rows is kept; of several rows the least by all columns
    stays. Rows without a ``doc_id`` stay as they are.
    """
    names = docs.columns
    flags = (
        near_duplicates(docs, percent)
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows"))
        .where("__kept AND __id IS NOT NULL")
    )
    left = docs.join(flags, docs["doc_id"] == flags["__id"])
    single = left.where("__rows = 1").select(*names)
    several = left.where("__rows > 1").groupBy("__id").agg(F.min(F.struct(*names)).alias("__row"))
    return single.union(several.select("__row.*")).union(docs.where("doc_id IS NULL"))
