"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the documents of one range of ``doc_id`` in ascending order:

* data frames: ids as little-endian unsigned 32-bit integers, whole documents only, a new
  frame from ``frame_tokens`` on (a longer document is a frame of its own);
* a skippable frame with the index: ``doc_id``, frame, first id in it, number of ids;
* a skippable frame with the seek table of zstandard's seekable format: sizes of every
  frame before it and the low 32 bits of the XXH64 of its content.

Any zstandard tool decompresses a file to the bare ids. A reader takes the seek table and
the index from the end and decompresses, and checks, only the frames it needs.

Files are written under another name and renamed, and the same rows give the same bytes,
so a repeated task replaces a file by its equal.

Results for odd rows: a null or empty text is a document with the end id alone. A null
``doc_id`` comes first. Rows with one ``doc_id`` are ordered by text and all kept. An
empty table gives no file and reads back as no rows. Columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netbehave.llm.words import slices, words_of, worker_state

END_ID = 2
FRAME_TOKENS = 65_536
CACHED_WORDS = 450_000  # in each half of a worker's cache

# Fixed values of the seekable format.
INDEX_MAGIC = 0x184D2A50
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("xxh", "<u4")])
INDEX = np.dtype(
    [("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u4")]
)


class WordEncoder:
    """Ids of a text from those of its blank-separated words, each encoded once.

    The tokenizer must drop blanks, as one that splits off words and removes the rest does;
    then the ids of a text are those of its words in turn. New words are encoded together,
    as one text in which ``SEPARATOR`` stands between them as a word of its own.
    """

    SEPARATOR = "~"

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.mark = self.ids_of(self.SEPARATOR)
        if len(self.mark) != 1:
            raise ValueError("the separator must be one token")

    def ids_of(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, "<u4")

    def learn(self, new: list[bytes]) -> None:
        # Words hold no blank, so they are read as one text and parted again.
        texts = b" ".join(new).decode("utf-8", "surrogatepass").split(" ") if new else []
        apart = {at for at, text in enumerate(texts) if self.SEPARATOR in text}
        for at in apart:
            self.known[new[at]] = self.ids_of(texts[at]).tobytes()
        if apart:
            new = [word for at, word in enumerate(new) if at not in apart]
            texts = [text for at, text in enumerate(texts) if at not in apart]
        for start in range(0, len(new), 500):
            part = slice(start, start + 500)
            ids = self.ids_of(f" {self.SEPARATOR} ".join(texts[part]))
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark[0])).tolist()
            starts = [0, *[end + 4 for end in ends]]
            found = [raw[a:b] for a, b in zip(starts, [*ends, len(raw)], strict=True)]
            self.known.update(zip(new[part], found, strict=True))

    def know(self, words: set[bytes]) -> None:
        """Have the ids of these words at hand."""
        if len(self.known) > CACHED_WORDS:
            # Words in use move over from the older half, the others go with it.
            self.known, self.older = {}, self.known
        # Word by word, for a difference with the keys would walk through all that is known.
        new = [word for word in words if word not in self.known]
        self.known.update((word, self.older[word]) for word in new if word in self.older)
        self.learn([word for word in new if word not in self.older])

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        self.know(set(words))
        return [self.known[word] for word in words]

    def ids_of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in turn, and how many each has."""
        found = self.encode_words(words)
        sizes = np.array([len(one) // 4 for one in found], np.int64)
        return np.frombuffer(b"".join(found), "<u4"), sizes

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        words = [words_of(text) for text in texts]
        self.know({word for one in words for word in one})
        last = np.array([end], "<u4").tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, one)) + last for one in words]


def folder_of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class FrameWriter:
    """Writes the frames of one file; ``close`` adds index and seek table."""

    def __init__(self, out, frame_tokens: int):
        self.out, self.frame_tokens = out, frame_tokens
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.waiting: list[bytes] = []
        self.waiting_ids = 0
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if self.waiting_ids and self.waiting_ids + n > self.frame_tokens:
            self.flush()
        known = doc_id is not None
        place = (len(self.entries), self.waiting_ids, n)
        self.index.append((doc_id if known else 0, int(known), *place))
        self.waiting.append(ids)
        self.waiting_ids += n

    def flush(self) -> None:
        content = b"".join(self.waiting)
        packed = self.packer.compress(content)
        self.out.write(packed)
        check = xxhash.xxh64_intdigest(content) & 0xFFFFFFFF
        self.entries.append((len(packed), len(content), check))
        self.waiting, self.waiting_ids = [], 0

    def close(self) -> None:
        if self.waiting:
            self.flush()
        content = np.array(self.index, INDEX).tobytes()
        frame = skippable(INDEX_MAGIC, self.packer.compress(content))
        self.out.write(frame)
        # A skippable frame decompresses to nothing; its checksum here is of the index.
        check = xxhash.xxh64_intdigest(content) & 0xFFFFFFFF
        entries = np.array([*self.entries, (len(frame), 0, check)], ENTRY)
        footer = struct.pack("<IBI", len(entries), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(skippable(SEEK_TABLE_MAGIC, entries.tobytes() + footer))


class FrameReader:
    """Index and single frames of one file."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        n, flags, magic = struct.unpack("<IBI", self.read(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        self.entries = np.frombuffer(self.read(end - 9 - n * ENTRY.itemsize, n * ENTRY.itemsize), ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        packed = self.read(int(self.starts[n - 1]), int(self.entries["packed"][n - 1]))[8:]
        self.unpacker = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.checked(self.unpacker.decompress(packed), n - 1), INDEX)

    def read(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def checked(self, content: bytes, entry: int) -> bytes:
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.entries["xxh"][entry]:
            raise ValueError(f"frame {entry} is damaged")
        return content

    def frame(self, number: int) -> bytes:
        packed = self.read(int(self.starts[number]), int(self.entries["packed"][number]))
        return self.checked(self.unpacker.decompress(packed), number)

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[np.void, int, bytes]]:
        """Index entry, ids before it in the file, and ids of each (wanted) document."""
        starts = np.concatenate([[0], np.cumsum(self.index["n"].astype(np.int64))])
        places = np.arange(len(self.index))
        if wanted is not None:
            places = places[np.isin(self.index["doc_id"], wanted) & (self.index["known"] == 1)]
        held, content = -1, b""
        for at in places.tolist():
            entry = self.index[at]
            if entry["frame"] != held:
                held = int(entry["frame"])
                content = self.frame(held)
            first = 4 * int(entry["first"])
            yield entry, int(starts[at]), content[first : first + 4 * int(entry["n"])]


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_json: str,
    end_id: int = END_ID,
    frame_tokens: int = FRAME_TOKENS,
) -> None:
    """Encode every document and write the files to ``folder``, which must be shared."""
    carried = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    system, place = folder_of(folder)
    system.create_dir(place, recursive=True)

    def make() -> WordEncoder:
        return WordEncoder(carried.value)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"words {zlib.crc32(carried.value.encode())}", make)
        system, place = folder_of(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.zst"
        writer = out = None
        draft = f"{place}/.{name}-{uuid.uuid4().hex}"
        n_ids = 0
        for part in slices(batches):
            if writer is None:
                out = system.open_output_stream(draft)
                writer = FrameWriter(out, frame_tokens)
            found = encoder.encode(part.column("text").to_pylist(), end_id)
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), found):
                writer.add(doc_id, ids)
                n_ids += len(ids) // 4
        if writer is not None:
            writer.close()
            out.close()
            system.move(draft, f"{place}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "n_ids": [n_ids]})

    # A hash of the text spreads rows of one doc_id and fixes their order.
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
    )
    written = ordered.mapInArrow(run, "file string, n_ids long")
    written.write.format("noop").mode("overwrite").save()


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """File names in ``folder``; only their listing is read."""
    listed = spark.read.schema("path string, modificationTime timestamp, length long, content binary")
    names = listed.format("binaryFile").option("pathGlobFilter", "part-*.zst").load(folder)
    return names.select(F.element_at(F.split("path", "/"), -1).alias("file")).repartition("file")


READ_SCHEMA = "file string, doc_id long, start_in_file long, n_tokens long, ids binary"


def read_token_files(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """Documents of all files, or those whose ``doc_id`` is in ``wanted``."""
    chosen = None if wanted is None else np.array(sorted(wanted), np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = folder_of(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with system.open_input_file(f"{place}/{name}") as file:
                    rows, size = [], 0
                    for entry, start, ids in FrameReader(file).documents(chosen):
                        doc_id = int(entry["doc_id"]) if entry["known"] else None
                        rows.append((name, doc_id, start, int(entry["n"]), ids))
                        size += len(ids)
                        if size > 8_000_000:
                            yield as_batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield as_batch(rows)

    return token_files(spark, folder).mapInArrow(run, READ_SCHEMA)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [field.split()[0] for field in READ_SCHEMA.split(", ")]
    arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Number of ids in the files before each file, from the files' ends alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = folder_of(folder)
        for batch in batches:
            sizes = []
            for name in batch.column("file").to_pylist():
                with system.open_input_file(f"{place}/{name}") as file:
                    sizes.append(int(FrameReader(file).entries["size"].astype(np.int64).sum()) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), pa.array(sizes, pa.int64())], names=["file", "n_ids"]
            )

    # One row per file, so one task orders them.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = token_files(spark, folder).mapInArrow(run, "file string, n_ids long")
    return sizes.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))


def token_digests(docs: DataFrame, folder: str, tokenizer_json: str) -> DataFrame:
    """Write ``docs`` to ``folder`` and describe each document from what the files hold."""
    spark = docs.sparkSession
    write_token_files(docs, folder, tokenizer_json)
    read = read_token_files(spark, folder).select(
        "file", "doc_id", "start_in_file", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
    # One row per file, and a file per task that wrote: small at any size of the corpus.
    return read.join(F.broadcast(file_starts(spark, folder)), "file").select(
        "doc_id",
        (F.col("start_in_file") + F.col("before")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
