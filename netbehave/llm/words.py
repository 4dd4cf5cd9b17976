"""Words of a text, and bounded slices of the Arrow batches that a task reads.

A word is a longest run of bytes other than the six ASCII blanks, which is what
``bytes.split()`` returns. Lower-casing means A-Z only, which is ``bytes.lower()``.
"""

from __future__ import annotations

import sys
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).split() if text else []


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_CHARS
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``size`` bytes of text.

    A row is never cut: one longer than ``size`` is a slice of its own.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def map_slices(
    docs: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    size: int = SLICE_CHARS,
) -> DataFrame:
    """Run ``work`` over slices of ``docs``, which has a column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=size):
            result = work(part)
            if result is not None and result.num_rows:
                yield result

    return docs.mapInArrow(run, schema)


def record(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Record batch from columns of numpy arrays or lists, in the order of ``types``."""
    arrays = [pa.array(columns[name], kind) for name, kind in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


class Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def bounds(counts: list[int]) -> np.ndarray:
    """Start of each group, and the end of the last, from group sizes."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def shared_folder(spark: SparkSession, name: str) -> str:
    """New folder that driver and executors share.

    It lies in ``spark.checkpoint.dir`` or, where that is unset, in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def worker_state(name: str, make: Callable[[], object]) -> object:
    """Object that lives as long as the Python worker, which runs many tasks in turn.

    For caches only: what is kept must not change a result.
    """
    module = sys.modules.setdefault("llm_worker_state", ModuleType("llm_worker_state"))
    if name not in vars(module):
        setattr(module, name, make())
    return getattr(module, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is computed once."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def folders_of(table: DataFrame) -> list[str]:
    """Folders that a stored table is read from."""
    return sorted({path.rpartition("/")[0] for path in table.inputFiles()})


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of stored tables that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_words(text: str | None) -> list[bytes]:
    return utf8(text).lower().split() if text else []


def count_words(
    docs: DataFrame,
    group: str,
    split: Callable[[str | None], list[bytes]] = lower_words,
    held: int = 400_000,
) -> DataFrame:
    """Rows (group, word, n) over every text, ``word`` in binary.

    Tasks count in a table of at most about ``held`` words before they hand it on, so a
    frequent word costs a task a row or two and not one per occurrence.
    """
    schema = docs.select(F.col(group).alias("group")).schema.add("word", "binary").add("n", "long")
    kind = pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[object, Counter] = {}

        def hand_on(to: pa.DataType) -> Iterator[pa.RecordBatch]:
            for key, counter in counts.items():
                found = list(counter)
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * len(part), to),
                            pa.array(part, kind),
                            pa.array([counter[word] for word in part], pa.int64()),
                        ],
                        names=["group", "word", "n"],
                    )
            counts.clear()

        to = pa.null()
        for part in slices(batches):
            to = part.schema.field("group").type
            pairs = zip(part.column("text").to_pylist(), part.column("group").to_pylist())
            for text, key in pairs:
                counts.setdefault(key, Counter()).update(split(text))
            if sum(map(len, counts.values())) > held:
                yield from hand_on(to)
        yield from hand_on(to)

    partial = docs.select("text", F.col(group).alias("group")).mapInArrow(run, schema)
    return partial.groupBy("group", "word").agg(F.sum("n").alias("n"))
