"""Product quantisation of vectors with exact nearest entries by Orchard's search.

Each component x becomes the integer floor(256 * x). Vectors are cut into ``PARTS`` equal
consecutive parts, and each position has a codebook of at most ``ENTRIES`` entries, which
starts with the parts of the smallest ``vec_id`` and is moved ``ROUNDS`` times to the floored
means of the parts that are nearest to its entries.

Orchard's search has, for every entry, all entries sorted by their distance from it. From a
current entry at distance d it goes down that list and looks at entries not yet visited. One
that is nearer (or as near, with a lower index) becomes current and its list is taken up from
the start. Entries further from the current one than 2 d cannot be nearer, so the search stops
there. All distances are squared integers, so results are exact and ties go to the lower
index. The vectors of a slice are searched at once, one step of each at a time.

A round is one pass over the vectors: tasks add up their parts by entry (a few thousand
rows a task, whatever its input) and Spark adds these up. Only codebooks, of a fixed size,
reach the driver and go out with the next pass. Every row is coded; there is no sample.

Odd rows: vectors that are null or hold a null, NaN or infinite component are left out.
Vectors of another length than the one with the smallest ``vec_id``, or of a length that the
parts do not divide, keep their row with a null code and error. Of rows with one ``vec_id``
only one, the least by its components, starts an entry; a null ``vec_id`` starts none. With
fewer rows than entries a codebook has fewer. An empty table gives no rows. Integers from
2**24 on are worked out in Python integers; an error beyond 64 bits is null. Columns other
than ``vec_id``, ``embedding`` and ``label`` are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netbehave.llm.skew import attach
from netbehave.llm.words import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
SLICE_VALUES = 1_000_000  # components that are worked on at once
EXACT = 1 << 24  # four times the squared distance of 1,000 such components fits in 64 bits
LIMB = 10**20  # sums travel as two decimals

CODES = "vec_id long, label string, code string, error long"
SUMS = "part int, entry int, place int, n long, high decimal(38,0), low decimal(38,0)"


# ---------------------------------------------------------------- search


@dataclass
class Codebook:
    """Entries (entry, place) of one position, and each one's neighbours by distance."""

    entries: np.ndarray
    order: np.ndarray
    away: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Codebook:
        apart = squared(entries[:, None, :] - entries[None, :, :])
        order = np.argsort(apart, axis=1, kind="stable")
        return Codebook(entries, order, np.take_along_axis(apart, order, 1))


def squared(differences: np.ndarray) -> np.ndarray:
    return (differences * differences).sum(axis=-1)


def search(book: Codebook, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each vector, with its squared distance."""
    n, size = len(vectors), len(book.entries)
    best = np.zeros(n, np.int64)
    error = squared(vectors - book.entries[0])
    visited = np.zeros((n, size), bool)
    visited[:, 0] = True
    at = np.zeros(n, np.int64)  # place in the list of the current entry
    going = np.arange(n)
    while len(going):
        # Twice the distance is four times its square.
        going = going[at[going] < size]
        going = going[book.away[best[going], at[going]] <= 4 * error[going]]
        other = book.order[best[going], at[going]]
        at[going] += 1
        fresh = ~visited[going, other]
        seen, other = going[fresh], other[fresh]
        visited[seen, other] = True
        new = squared(vectors[seen] - book.entries[other])
        old = error[seen]
        better = (new < old) | ((new == old) & (other < best[seen]))
        moved = seen[better]
        best[moved], error[moved], at[moved] = other[better], new[better], 0
    return best, error


# ---------------------------------------------------------------- vectors of a task


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite values, as 64-bit integers where they are exact."""
    scaled = values.astype(np.float64) * SCALE
    if not len(values) or np.abs(scaled).max(initial=0.0) < EXACT:
        return np.floor(scaled).astype(np.int64)
    exact = [math.floor(x * SCALE) if abs(x) < 2**60 else int(x) * SCALE for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def finite_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows whose vector is there and holds nothing but finite components."""
    vectors = batch.column("embedding")
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    keep = vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.values.slice(vectors.offsets[0].as_py(), int(sizes.sum())) if len(vectors) else vectors.values
    good = np.isfinite(flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
    bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~good], minlength=len(sizes))
    return batch.filter(pa.array(keep & (bad == 0)))


def parts_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows with finite vectors, which rows have ``length``, and their integers."""
    for batch in batches:
        step = max(1, SLICE_VALUES // max(1, length))
        for at in range(0, batch.num_rows, step):
            rows = finite_rows(batch.slice(at, step))
            vectors = rows.column("embedding")
            fits = np.diff(vectors.offsets.to_numpy()) == length if len(vectors) else np.zeros(0, bool)
            flat = vectors.filter(pa.array(fits)).flatten().cast(pa.float64())
            values = whole(flat.to_numpy(zero_copy_only=False).reshape(int(fits.sum()), length))
            yield rows, fits, values.reshape(len(values), PARTS, length // PARTS)


def nearest(books: list[Codebook], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part of each vector."""
    found = [search(book, vectors[:, part]) for part, book in enumerate(books)]
    return np.stack([one[0] for one in found], 1), np.stack([one[1] for one in found], 1)


def books_of(entries: list[list[list[int]]]) -> list[Codebook]:
    """Codebooks from Python integers, in 64 bits if they fit."""
    flat = [value for part in entries for entry in part for value in entry]
    kind = np.int64 if all(abs(value) < EXACT for value in flat) else object
    return [Codebook.of(np.array(part, kind).reshape(len(part), -1)) for part in entries]


# ---------------------------------------------------------------- whole tables


def kept(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))


def first_entries(vectors: DataFrame) -> list[list[list[int]]]:
    """Codebooks as they start: by position, entry and place. Empty if no vector can be cut."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    size = F.size("embedding")
    length = some.groupBy().agg(F.min_by(size, F.struct("vec_id", "embedding"))).first()[0]
    if not length or length % PARTS:
        return []
    some = some.where(size == length)
    first = some.select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()
    least = some.where(F.col("vec_id") <= first[-1]["vec_id"]).groupBy("vec_id")
    least = least.agg(F.min("embedding").alias("embedding")).orderBy("vec_id").collect()
    whole_ones = [whole(np.array(row["embedding"], np.float64)).tolist() for row in least]
    step = length // PARTS
    return [[one[part * step : (part + 1) * step] for one in whole_ones] for part in range(PARTS)]


def moved(vectors: DataFrame, entries: list[list[list[int]]]) -> list[list[list[int]]]:
    """Codebooks after each entry has gone to the mean of its parts."""
    step = len(entries[0][0])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_of(entries)
        n = [[0] * len(book.entries) for book in books]
        sums = [[[0] * step for _ in book.entries] for book in books]
        for _, _, values in parts_of(batches, PARTS * step):
            codes, _ = nearest(books, values)
            for part in range(PARTS):
                # An entry's rows are added up at once; ``EXACT`` times a slice fits in 64 bits.
                for entry in np.unique(codes[:, part]).tolist():
                    own = values[codes[:, part] == entry, part]
                    n[part][entry] += len(own)
                    sums[part][entry] = [a + int(b) for a, b in zip(sums[part][entry], own.sum(axis=0))]
        rows = [
            (part, entry, place, n[part][entry], *divmod(total, LIMB))
            for part in range(PARTS)
            for entry in range(len(n[part]))
            if n[part][entry]
            for place, total in enumerate(sums[part][entry])
        ]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38), pa.decimal128(38)]
        names = [one.split()[0] for one in SUMS.split(", ")]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    added = vectors.mapInArrow(add_up, SUMS).groupBy("part", "entry", "place")
    new = [[list(entry) for entry in part] for part in entries]
    for row in added.agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        total = int(row["high"]) * LIMB + int(row["low"])
        new[row["part"]][row["entry"]][row["place"]] = total // row["n"]
    return new


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """Codebooks of integers by position, entry and place."""
    vectors = kept(vectors)
    entries = first_entries(vectors)
    for _ in range(rounds if entries else 0):
        entries = moved(vectors, entries)
    return entries


def encode(vectors: DataFrame, entries: list[list[list[int]]]) -> DataFrame:
    """Rows (vec_id, label, code, error) of every finite vector, labels as text."""
    step = len(entries[0][0]) if entries else 0

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_of(entries)
        for rows, fits, values in parts_of(batches, PARTS * step):
            codes: list = [None] * rows.num_rows
            errors: list = [None] * rows.num_rows
            if step:
                indexes, distances = nearest(books, values)
                sums = distances.sum(axis=1).tolist()
                for row, found, error in zip(np.flatnonzero(fits).tolist(), indexes.astype(np.uint8), sums):
                    codes[row] = found.tobytes().hex()
                    errors[row] = error if error < 1 << 63 else None
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id"), rows.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return kept(vectors).mapInArrow(code, CODES)


def digest(entries: list[list[list[int]]]) -> str:
    flat = (str(value) for part in entries for entry in part for value in entry)
    return hashlib.sha256(",".join(flat).encode()).hexdigest()


def coded(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256) of every finite vector.

    ``label_error`` adds up the errors of a label, null ones left out; a sum beyond 64 bits
    is null.
    """
    entries = fit(vectors, rounds)
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    rows = stored(encode(vectors, entries).withColumn("key", key).drop("label"), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    facts = stored(rows.groupBy("key").agg(F.count("*").alias("n"), total.alias("label_error")), "label-errors")
    return attach(rows, facts, "key", "n").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256")
    )
