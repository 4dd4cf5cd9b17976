"""Benchmark passages in documents, by SimHash windows and an exact check.

Words are compared in lower case and without the signs around them; words of signs alone
are left out. An item is covered by pieces of a few fixed sizes. The fingerprint of a piece
is the 64-bit SimHash of its word pairs, and every window of such a size in every document
has one too. Fingerprints that differ in at most three of 64 bits agree in one of four
blocks of 16 bits, so looking up the blocks finds all of them. Each candidate places its
item in the document, and there the weighted similarity of five-word shingles decides:

    sum of w(s) * min(counts) / sum of w(s) * max(counts) >= 0.8

with w(s) = 1 / number of items that contain s, and 1 for shingles of no item.

The pieces are laid so that edits which leave a similarity of 0.8 leave a piece intact.
Items of under 44 words and one weight bear changes only near their ends. Others get
disjoint pieces of the largest size with which breaking every piece would cost more weight
than 0.8 allows: an edit breaks all shingles across a gap between two words of its piece,
and of those that lie in two pieces half counts for each. Where no size will do, the
heaviest shingles themselves are the pieces, with more than that weight together.

Benchmarks come in blocks of bounded size, one pass over the documents for each. Where
there are several, the items that contain a shingle are counted over all of them first, and
each block has the counts above one with it (16 bytes for each such shingle).

Results for odd rows: null and empty texts, of documents or items, match nothing; items of
fewer than five words have no shingle and match nothing. Items with the same words all
match. Repeated documents are each answered, under one row for a ``doc_id``. Columns other
than ``doc_id``, ``text`` and ``item_id``, ``text`` are not read; ``drop_leaks`` hands the
documents' columns through under whatever names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netbehave.llm.shingles import mixed, shingle_hashes
from netbehave.llm.words import bounds, map_slices, slices, utf8

LEAST = 0.8
RADIUS = 3  # bits; four blocks guarantee three
BLOCKS = 4
SIZES = (5, 6, 7, 8, 12, 16, 22, 30, 40, 56, 80, 112)  # of windows, in words
EVEN = 44  # words from which a word in the middle of an item can change
SHIFT = 2  # words by which a verified window may move or differ in length
ITEMS_PER_BLOCK, CHARS_PER_BLOCK = 20_000, 10_000_000
SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())

# Bytes of a fingerprint are counted in eight lanes of a 64-bit word; a window has at most
# 112 pairs, so no lane overflows.
ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
GATHER = np.uint64(0x0102040810204080)
SPREAD = np.array(
    [sum(((byte >> bit) & 1) << (8 * bit) for bit in range(8)) for byte in range(256)], np.uint64
)


def cleaned(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the compared words of all texts in turn, and the bounds of the texts."""
    words = [utf8(text.lower()).split() if text else [] for text in texts]
    limits = bounds([len(one) for one in words])
    flat = np.empty(limits[-1], object)
    flat[:] = [word for one in words for word in one]
    number, distinct = pd.factorize(flat)
    cores = [word.strip(SIGNS) for word in distinct]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, cores), np.uint64, len(cores))
    there = np.fromiter(map(bool, cores), bool, len(cores))
    if not len(number):
        return np.zeros(0, np.uint64), limits
    kept = there[number]
    owner = np.repeat(np.arange(len(texts)), np.diff(limits))[kept]
    return hashes[number[kept]], bounds(np.bincount(owner, minlength=len(texts)).tolist())


def pair_sums(words: np.ndarray) -> np.ndarray:
    """Running counts of set bits of the hashes of word pairs, as (8, pairs + 1) lanes."""
    with np.errstate(over="ignore"):
        pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    sums = np.zeros((8, len(pairs) + 1), np.uint64)
    for at in range(8):
        lanes = SPREAD[(pairs >> np.uint64(8 * at)) & np.uint64(255)]
        np.cumsum(lanes, out=sums[at, 1:])
    return sums


def fingerprints(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words: bits set in more than half of its pairs."""
    pairs = size - 1
    count = sums.shape[1] - pairs
    result = np.zeros(max(0, count), np.uint64)
    if count <= 0:
        return result
    more = ONES * np.uint64(127 - pairs // 2)
    with np.errstate(over="ignore"):
        for at in range(8):
            # Sums wrap around; their difference is exact, for it fits its lanes.
            high = ((sums[at, pairs:] - sums[at, :count] + more) & HIGH) >> np.uint64(7)
            result |= ((high * GATHER) >> np.uint64(56)) << np.uint64(8 * at)
    return result


def breakable(weights: np.ndarray, low: float) -> float:
    """Most weight of an item's shingles that a window with similarity ``LEAST`` can lack.

    A window has at most ``SHIFT`` words fewer, so for all but ``SHIFT`` of the shingles that
    it lacks it has others, of weight ``low`` or more.
    """
    return ((1 - LEAST) * weights.sum() + LEAST * SHIFT * low) / (1 + LEAST * low)


def least_costs(weights: np.ndarray, size: int, starts: list[int]) -> np.ndarray:
    """Least weight to be broken for each of some disjoint pieces; the sum holds for several."""
    costs = []
    for start in starts:
        mine = weights / 2
        mine[start : start + size - 4] *= 2
        sums = np.concatenate([[0.0], np.cumsum(mine)])
        gaps = np.arange(start, start + size - 1)  # each behind one word of the piece
        ends = np.minimum(gaps + 1, len(weights))
        costs.append((sums[ends] - sums[np.maximum(gaps - 3, 0)]).min())
    return np.array(costs)


def piece_places(weights: np.ndarray, low: float) -> tuple[int, list[int]]:
    """Size of the pieces of an item with these weights of its shingles, and where they start."""
    length = len(weights) + 4
    if length < EVEN and (weights == low).all() and low == 1:
        room = length - 8 if length >= 24 else length - 2
        size = max([s for s in SIZES if s <= room], default=max(s for s in SIZES if s <= length))
        count = max(3, length // size) if length > size else 1
        return size, sorted({round(at * (length - size) / max(1, count - 1)) for at in range(count)})
    limit = breakable(weights, low) + 1e-9
    for size in reversed(SIZES):
        count = length // size
        if count:
            starts = [round(at * (length - size) / max(1, count - 1)) for at in range(count)]
            if least_costs(weights, size, starts).sum() > limit:
                return size, starts
    order = np.argsort(-weights, kind="stable")
    enough = int(np.searchsorted(np.cumsum(weights[order]), limit, "right")) + 1
    return 5, sorted(order[:enough].tolist())


# ---------------------------------------------------------------- benchmark


Shared = tuple[np.ndarray, np.ndarray]  # shingles of several items, and of how many


class Items:
    """A block of items with the blocks of their pieces' fingerprints."""

    def __init__(self, ids: list[int | None], texts: list[str | None], shared: Shared | None = None):
        words, limits = cleaned(texts)
        self.ids = ids
        self.words = [words[a:b] for a, b in zip(limits[:-1], limits[1:])]
        values, ends = shingle_hashes(words, limits)
        self.shingles = [
            Counter(values[a:b].tolist()) if len(one) >= 5 else Counter()
            for one, a, b in zip(self.words, ends[:-1], ends[1:])
        ]
        holders = Counter(s for one in self.shingles for s in one)
        if shared is not None:
            # Counted over all blocks; shingles that are not listed are in one item at most.
            holders = dict.fromkeys(holders, 1) | dict(zip(*(column.tolist() for column in shared)))
        self.weights = {s: 1 / n for s, n in holders.items()}
        self.totals = [self.weight(one) for one in self.shingles]
        low = min(self.weights.values(), default=1.0)
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for at, one in enumerate(self.words):
            if len(one) >= 5:
                mine = values[ends[at] : ends[at + 1]].tolist()
                size, starts = piece_places(np.array([self.weights[s] for s in mine]), low)
                prints = fingerprints(pair_sums(one), size)
                for start in starts:
                    pieces.setdefault(size, []).append((int(prints[start]), at, start))
        self.sizes = {}
        for size, rows in pieces.items():
            prints = np.array([row[0] for row in rows], np.uint64)
            tables = []
            for block in range(BLOCKS):
                keys = block_of(prints, block)
                order = np.argsort(keys, kind="stable")
                tables.append((np.searchsorted(keys[order], np.arange(65_537)), order))
            self.sizes[size] = (prints, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), tables)

    def weight(self, shingles: Counter) -> float:
        return sum(n * self.weights.get(s, 1.0) for s, n in shingles.items())

    def similarity(self, item: int, values: np.ndarray) -> float:
        """Weighted similarity of an item with the shingles of a window."""
        mine, other = self.shingles[item], Counter(values.tolist())
        both = self.weight(mine & other)
        return both / max(self.totals[item] + self.weight(other) - both, 1e-300)


def block_of(prints: np.ndarray, block: int) -> np.ndarray:
    return ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)


def candidates(items: Items, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and pieces whose fingerprints differ in at most ``RADIUS`` bits."""
    known, _, _, tables = items.sizes[size]
    windows, pieces = [], []
    for block, (starts, order) in enumerate(tables):
        key = block_of(prints, block)
        counts = (starts[1:] - starts[:-1])[key]
        hit = np.flatnonzero(counts)
        if not len(hit):
            continue
        n = counts[hit]
        window = np.repeat(hit, n)
        place = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        piece = order[starts[key[window]] + place]
        near = np.bitwise_count(prints[window] ^ known[piece]) <= RADIUS
        windows.append(window[near])
        pieces.append(piece[near])
    if not windows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(windows), np.concatenate(pieces)


Match = tuple[int, int, int, int, float]


def matches(items: Items, texts: list[str | None]) -> list[Match]:
    """(text, item, first word, words, similarity): the best place of each item in each text."""
    words, limits = cleaned(texts)
    if len(words) < 5:
        return []
    sums = pair_sums(words)
    found: set[tuple[int, int, int]] = set()
    for size, (_, owners, offsets, _) in items.sizes.items():
        window, piece = candidates(items, size, fingerprints(sums, size))
        text = np.searchsorted(limits, window, "right") - 1
        inside = window + size <= limits[text + 1]
        # Windows run over all texts of a slice; those across two texts do not count.
        rows = np.stack([text, owners[piece], window - offsets[piece] - limits[text]])[:, inside]
        found.update(map(tuple, rows.T.tolist()))
    best: dict[tuple[int, int], Match] = {}
    if not found:
        return []
    ordered = sorted(found)
    held, values = -1, np.zeros(0, np.uint64)
    for text, item, start in ordered:
        low, high = limits[text], limits[text + 1]
        if high - low < 5:
            continue
        if text != held:
            held = text
            values, _ = shingle_hashes(words[low:high], np.array([0, high - low]))
        length = len(items.words[item])
        wide = values[max(0, start - SHIFT) : max(0, start + length + 2 * SHIFT - 4)]
        # The shingles found at all bound the similarity from above.
        if items.weight(items.shingles[item] & Counter(wide.tolist())) < LEAST * items.totals[item]:
            continue
        for first in range(max(0, start - SHIFT), start + SHIFT + 1):
            for size in range(max(5, length - SHIFT), length + SHIFT + 1):
                part = values[first : first + size - 4]
                if len(part) == size - 4:
                    similar = items.similarity(item, part)
                    if similar >= LEAST and similar > best.get((text, item), (0,) * 5)[4]:
                        best[text, item] = (text, item, first, size, similar)
    return sorted(best.values())


Block = tuple[list[int | None], list[str | None], Shared | None]


def shared_shingles(items: DataFrame) -> Shared:
    """Shingles that several items contain, counted over all items."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        words, limits = cleaned(part.column("text").to_pylist())
        values, ends = shingle_hashes(words, limits)
        found = [
            np.unique(values[a:b])
            for a, b, n in zip(ends[:-1], ends[1:], np.diff(limits))
            if n >= 5
        ]
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["shingle"])

    counted = map_slices(items.select("text"), work, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    several = counted.where("n > 1").toPandas()
    return several["shingle"].to_numpy(np.int64).view(np.uint64), several["n"].to_numpy(np.int64)


def item_blocks(benchmark: DataFrame) -> Iterator[Block]:
    """Items in blocks of bounded size, each sent to the driver by itself."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    count = 1 + int(size["n"]) // ITEMS_PER_BLOCK + int(size["chars"] or 0) // CHARS_PER_BLOCK
    shared = shared_shingles(items) if count > 1 else None
    for block in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).collect()
        if rows:
            rows.sort(key=lambda row: (row["item_id"] is not None, row["item_id"] or 0, row["text"]))
            yield [row["item_id"] for row in rows], [row["text"] for row in rows], shared


SCHEMA = "doc_id long, item_id long, first_word long, n_words long, similarity double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Items found in documents, each at its best place."""
    spark = docs.sparkSession
    result = spark.createDataFrame([], SCHEMA)
    for block in item_blocks(benchmark):
        result = result.union(leaks_of_block(docs, spark.sparkContext.broadcast(block)))
    return result


def leaks_of_block(docs: DataFrame, carried) -> DataFrame:
    held: list[Items] = []

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Items(*carried.value))
        found = matches(held[0], part.column("text").to_pylist())
        ids = part.column("doc_id").to_pylist()
        rows = [(ids[t], held[0].ids[i], first, n, s) for t, i, first, n, s in found]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = zip(*rows) if rows else [[]] * 5
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return map_slices(docs.select("doc_id", "text"), work, SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per ``doc_id``: the items found, how many, and the largest similarity."""
    found = (
        leaks(docs, benchmark)
        .groupBy(F.col("doc_id").alias("of"))
        .agg(
            F.array_sort(F.collect_set("item_id")).alias("items"),
            F.max("similarity").alias("similarity"),
        )
    )
    ids = docs.select("doc_id").distinct()
    joined = ids.join(found, ids["doc_id"].eqNullSafe(found["of"]), "left")
    return joined.select(
        "doc_id",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.col("items").isNotNull().alias("contaminated"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a benchmark item, with all their columns."""
    for block in item_blocks(benchmark):
        docs = without(docs, docs.sparkSession.sparkContext.broadcast(block))
    return docs


def without(docs: DataFrame, carried) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*carried.value)
        for part in slices(batches):
            clean = np.ones(part.num_rows, bool)
            clean[[match[0] for match in matches(items, part.column("text").to_pylist())]] = False
            yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
