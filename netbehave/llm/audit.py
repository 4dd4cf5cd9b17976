"""How five filters interact: what each removes in every order, kept up over a stream of files.

The filters of a text (null is empty; a word is a longest run of bytes other than blanks):

* A: under 200 words
* B: fewer than half as many distinct words as words
* C: more than 3 in 100 characters are ``A-Z``
* D: it holds one of ``#$%&*|``
* E: a smaller ``doc_id`` has the same text, removed or not

A document fails a set of filters, its mask, and everything that is asked for follows from
the number of documents with each mask. So the stream keeps only these counters, by part
(``lang``), mask and labels:

* All files are processed as available-now micro-batches. A batch reads texts once and hands
  on masks and 128-bit hashes; labels are joined to these by ``doc_id``.
* The least ``doc_id`` of each text is keyed state. Rows of a text are first brought together
  in their task: rows above the task's least are sure to fail E and go straight into the
  counters; so a text that a third of all rows have costs a row a task and not one a copy.
  When a smaller ``doc_id`` arrives, what the earlier one had added is retracted (-1) and
  added again with E in its mask.
* Each batch adds its changes up and writes them under its number, so a batch that is
  repeated after a failure replaces itself. The counters are the sum over the batches.

Results do not depend on how files fall into batches or texts into buckets. State holds an
entry of about 80 bytes for each distinct text, with checkpoints in the shared folder; a task
works on one bucket at a time. The state store is the session's: Spark's default keeps state in
the executors' memory, so set the RocksDB provider (``spark.sql.streaming.stateStore.
providerClass``), which keeps it on disk, where distinct texts are more than memory holds.

``interactions`` turns counters into one row for each part, order and step, in place: the
120 orders are a constant array.

Odd rows: a null ``lang`` is the part of the empty string. A null ``doc_id`` is neither
smaller nor greater than others: such rows never fail E, nor make others fail it. Repeated
rows with one ``doc_id`` count once each; none of them is smaller than the others. Several
labels of one ``doc_id`` are taken together: one with quality 1 (toxic 1) is enough; null
labels say nothing, and a null ``doc_id`` has none. An empty table gives no parts. Columns that are not named here are not
read.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netbehave.llm.words import shared_folder, slices, utf8

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SIGNS = b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = 1 << FILTERS.index("E")
BATCHES = 4  # micro-batches that a table is processed in, if it has so many files
BUCKET_BYTES = 64 << 20

MASKS = "doc_id long, part string, mask int, key binary"
KEYED = "key binary, least long, part string, mask int, good boolean, toxic boolean, n long"
CHANGES = "part string, mask int, good boolean, toxic boolean, n long"
KINDS = ["part", "mask", "good", "toxic"]


def mask_of(raw: bytes, n_chars: int) -> int:
    """Filters A to D that a text fails, as bits."""
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * upper > MAX_UPPER_PERCENT * n_chars,
        len(raw) != len(raw.translate(None, SIGNS)),
    )
    return sum(1 << at for at, failed in enumerate(fails) if failed)


def masks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, mask, key); ``key`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            found, keys = [], []
            for text in rows.column("text").to_pylist():
                raw = utf8(text or "")
                found.append(mask_of(raw, len(text or "")))
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("part"), pa.array(found, pa.int32()), pa.array(keys, pa.binary())],
                names=["doc_id", "part", "mask", "key"],
            )

    part = F.coalesce("lang", F.lit("")).alias("part")
    return docs.select("doc_id", "text", part).mapInArrow(run, MASKS)


def brought_together(rows: DataFrame) -> DataFrame:
    """Rows of a task by text: those of the least ``doc_id``, counted, and all others.

    The others are sure of their mask. They have no ``least`` and one key a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        held: dict[bytes, Counter] = {}
        sure: Counter = Counter()

        def copies(kinds: Counter) -> None:
            for (part, mask, good, toxic), n in kinds.items():
                sure[part, mask | COPY, good, toxic] += n

        def hand_on() -> pa.RecordBatch:
            out = [(key, least[key], *kind, n) for key, kinds in held.items() for kind, n in kinds.items()]
            own = hashlib.blake2b(repr(sorted(least.items())[:1]).encode(), digest_size=8).digest()
            out += [(own, None, *kind, n) for kind, n in sure.items()]
            for one in (least, held, sure):
                one.clear()
            columns = list(zip(*out)) if out else [()] * 7
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()]
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["key", "least", *KINDS, "n"])

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ["doc_id", "key", *KINDS]]
            for doc_id, key, *kind in zip(*columns):
                kind = tuple(kind)
                if doc_id is None:
                    sure[kind] += 1
                elif key not in least or doc_id < least[key]:
                    copies(held.get(key, Counter()))
                    least[key], held[key] = doc_id, Counter([kind])
                elif doc_id == least[key]:
                    held[key][kind] += 1
                else:
                    copies(Counter([kind]))
            if len(least) > 200_000:
                yield hand_on()
        yield hand_on()

    return rows.mapInArrow(run, KEYED)


def changes(rows: DataFrame, buckets: int) -> DataFrame:
    """Changes (part, mask, good, toxic, n) to the counters, from the keyed state of texts.

    The state of a bucket has for each text the least ``doc_id`` so far and what it has added.
    """

    def update(
        key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[int, Counter]] = {}
        if state.exists:
            for text, least, kinds in json.loads(state.get[0]):
                held[text] = least, Counter({tuple(kind): n for *kind, n in kinds})
        out: Counter = Counter()

        def add(kinds: Counter, copy: bool, sign: int = 1) -> None:
            for (part, mask, good, toxic), n in kinds.items():
                out[part, mask | COPY if copy else mask, good, toxic] += sign * n

        changed = False
        for frame in frames:
            columns = [frame[name].tolist() for name in ["key", "least", *KINDS, "n"]]
            for raw, least, part, mask, good, toxic, n in zip(*columns):
                new = Counter({(part, mask, good, toxic): n})
                if least is None:
                    add(new, False)
                    continue
                text, doc_id = raw.hex(), int(least)
                known, kinds = held.get(text, (None, Counter()))
                if known is None or doc_id < known:
                    add(kinds, False, -1)
                    add(kinds, True)
                    held[text], changed = (doc_id, new), True
                    add(new, False)
                elif doc_id == known:
                    held[text], changed = (known, kinds + new), True
                    add(new, False)
                else:
                    add(new, True)
        if changed:
            kept = [(text, least, [(*kind, n) for kind, n in kinds.items()]) for text, (least, kinds) in held.items()]
            state.update((json.dumps(kept),))
        if rows := [(*kind, n) for kind, n in out.items() if n]:
            yield pd.DataFrame(rows, columns=[*KINDS, "n"])

    # Ids travel as decimals of text: a column of floats with gaps would lose digits.
    texts = rows.withColumns(
        {"least": F.col("least").cast("string"), "bucket": F.pmod(F.xxhash64("key"), F.lit(buckets))}
    )
    return texts.groupBy("bucket").applyInPandasWithState(
        update, CHANGES, "held string", "append", GroupStateTimeout.NoTimeout
    )


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with what the labels say: good and toxic."""
    said = labels.groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("is_good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"),
    )
    return rows.join(said, "doc_id", "left").select(
        "doc_id", "key", "part", "mask",
        F.coalesce("is_good", F.lit(False)).alias("good"),
        F.coalesce("is_toxic", F.lit(False)).alias("toxic"),
    )


def counters(docs: DataFrame, labels: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Counters (part, mask, good, toxic, n) of the stream ``docs``, after all its files.

    ``folder`` keeps the state and the changes; called again with the same folder and number
    of buckets, only files that came later are read.
    """
    spark = docs.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        added = batch.groupBy(*KINDS).agg(F.sum("n").alias("n")).where("n <> 0")
        added.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    # Something to read if there is no file at all.
    spark.createDataFrame([], CHANGES).write.mode("overwrite").parquet(f"{folder}/changes/batch=-1")
    rows = changes(brought_together(labelled(masks(docs), labels)), buckets)
    stream = (
        rows.writeStream.outputMode("append").foreachBatch(add)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    added = spark.read.schema(CHANGES + ", batch long").parquet(f"{folder}/changes")
    return added.groupBy(*KINDS).agg(F.sum("n").alias("n")).where("n <> 0")


# ---------------------------------------------------------------- orders and steps


def steps() -> Column:
    """Every order and step as an array of (filter_order, step, own, earlier), filters as bits."""
    rows = []
    for order in permutations(FILTERS):
        earlier = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            rows.append(("".join(order), step, own, earlier))
            earlier |= own
    # One literal: six hundred structs of literals would take Spark seconds to analyse.
    names = ["filter_order", "step", "own", "earlier"]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return F.from_json(F.lit(text), "array<struct<filter_order string, step int, own int, earlier int>>")


def interactions(counted: DataFrame) -> DataFrame:
    """One row for each part, order and step, from counters (part, mask, good, toxic, n)."""
    n = F.sum("n")
    by_mask = counted.groupBy("part", "mask").agg(
        n.alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.inline(steps()))

    def total(which, what=lambda one: one["n"]) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate(
            "masks", zero, lambda sum_, one: sum_ + F.when(which(one["mask"]), what(one)).otherwise(zero)
        )

    def has(mask: Column, bits: str) -> Column:
        return mask.bitwiseAND(F.col(bits)) != 0

    def removed(mask: Column) -> Column:
        return has(mask, "own") & ~has(mask, "earlier")

    # Of the orders, the filter is the first of a document's failures in one of their number.
    share = [F.lit(0), *[F.lit(120 // size) for size in range(1, 6)]]
    found = {
        "kept": total(lambda mask: ~has(mask, "own") & ~has(mask, "earlier")),
        "removed": total(removed),
        "redundant": total(lambda mask: has(mask, "own") & has(mask, "earlier")),
        "unique_fails": total(lambda mask: mask == F.col("own")),
        "good_lost": total(removed, lambda one: one["good"]),
        "toxic_lost": total(removed, lambda one: one["toxic"]),
        "shapley": total(
            lambda mask: has(mask, "own"),
            lambda one: one["n"] * F.get(F.array(*share), F.bit_count(one["mask"]).cast("int")),
        ),
    }
    return rows.select("part", "filter_order", "step", *[value.alias(name) for name, value in found.items()])


# ---------------------------------------------------------------- tables of files


def file_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """The Parquet files of a table as a stream, in about so many micro-batches."""
    still = spark.read.parquet(path)
    files = max(1, -(-len(still.inputFiles()) // batches))
    # A pattern, because a stream takes a folder or a pattern but no single file.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(still.schema).option("maxFilesPerTrigger", files).parquet(pattern)


def bucket_count(spark: SparkSession, path: str) -> int:
    """Buckets of state for a table: two for each shuffle partition, more for a large one."""
    size = int(spark.read.parquet(path)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)


def audit(spark: SparkSession, docs_path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row for each part, order of the filters and step, over all files of ``docs_path``."""
    docs, buckets = file_stream(spark, docs_path, batches), bucket_count(spark, docs_path)
    return interactions(counters(docs, labels, shared_folder(spark, "audit"), buckets))
