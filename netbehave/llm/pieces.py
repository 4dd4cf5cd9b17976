"""SentencePiece encoding and decoding as relations.

A text gets a blank in front, as the library puts one there, and is cut into units: between
two characters that stand next to each other in no piece of the model. No piece can lie across
such a cut, so the best paths of the units are the best path of the text. The distinct units of
the corpus are encoded once. A unit's substrings, up to the longest piece, are exploded and
joined to the piece table; the edges found are grouped by unit, and a Viterbi fold over them, in
order of their ends, gives the best path. Of equal paths the one whose last piece starts first
wins, and so on backwards. A character without a piece becomes its bytes.

A unit may be long (a text of one letter is one unit). Edges are grouped by ``CHUNK`` ends; the
fold takes one such group after the other and carries on the last ends, as many as the longest
piece has characters, so its work stays in proportion to the length. A unit is in memory with
about fifty bytes a character.

The pieces of the model at hand carry merge ranks and no probabilities, and sums of ranks
mean nothing. So a piece of rank r gets the logarithm of its share under Zipf's law; a
model with real scores can be used as it is (``zipf=False``). Scores are rounded to multiples of
``1 / GRID``, so their sums are exact: paths of the same pieces are equal in whatever order they
are added up and wherever a text is cut. Decoding needs no scores and
takes ids from any encoder.

``encoded`` returns the ids of every document, the text they decode to and sums of both. Units
that are common in a sample of rows, at most ``COMMON_UNITS``, are encoded first and looked up
where the texts are read; which these are changes no result. Only the others travel, one row
for each slice of documents and unit, to be joined with the encoded units; what a task of the
join has for a slice goes back in one row, and the rows of a slice are sorted together and put
in place. Where its units belong stays with the slice, as a number for each; common units have
the same number everywhere. Sums are those of the ids put together. ``checksum`` is the CRC-32
of a document's ids as little-endian 32-bit integers. ``round_trip`` says whether the ids of the whole document decode
to its text.

Results for odd rows: a null text is encoded as an empty one, which is a single blank. The
blank sign of the pieces is read as a blank. Repeated rows are each answered. An empty table
gives no rows. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netbehave.llm.words import bounds, count_words, folders_of, ragged, remove, shared_folder, slices, stored

BLANK = "▁"
CHUNK = 256  # ends that one fold takes; units that are longer are known by a hash
COMMON_UNITS = 250_000
SAMPLE_ROWS = 60_000  # bound of the sample that common units are looked for in
PARTITIONS_FACTOR = 4  # partitions of units, to each shuffle partition of the session
# A group is a unit with some twenty edges of eight bytes. By default Spark sorts on disk from
# 128 groups on; so many of this size fit in memory.
GROUPING = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "60000"}
# Spark writes a plan out whenever a stage ends, by default whole, for the driver to hold.
SHORT_PLANS = {"spark.sql.maxPlanStringLength": "20000"}
# What was shuffled for a table is of no use once the table is written.
SMALL_TABLES = {
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
SLICE = 500_000  # characters that are cut at once
GRID = 1 << 20  # scores are multiples of 1 / GRID
PACKED_ROWS = 100_000  # encoded units that are packed by slices at once
LONG_MARK = "\0#"
BYTE_SCORE = -10.0  # of a byte, from the worst piece on


# ---------------------------------------------------------------- pieces and units


def read_pieces(spark: SparkSession, path: str, zipf: bool = True) -> DataFrame:
    """Rows (piece, id, score, raw) of a model; ``raw`` is what a piece decodes to.

    Pieces of bytes have a null ``piece``; control pieces are left out. The table has as
    many rows as the model, which bounds every broadcast of it.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = []
    ordinary = 0
    share = sum(1 / (rank + 2.7) for rank in range(1, len(model) + 1))
    for at in range(len(model)):
        if model.is_control(at) or model.is_unknown(at):
            continue
        piece = model.id_to_piece(at)
        if model.is_byte(at):
            rows.append((None, at, 0.0, bytes([int(piece[3:5], 16)])))
            continue
        ordinary += 1
        score = -float(np.log((ordinary + 2.7) * share)) if zipf else model.get_score(at)
        score = round(score * GRID) / GRID
        text = piece.replace(BLANK, " ")
        rows.append((text, at, score, text.encode()))
    return spark.createDataFrame(rows, "piece string, id int, score double, raw binary")


def spaced(text: str | None) -> str:
    return " " + (text or "").replace(BLANK, " ")


class Cutter:
    """Cuts texts between characters that stand next to each other in no piece."""

    def __init__(self, pieces: Iterable[str]):
        pairs = {piece[at : at + 2] for piece in pieces for at in range(len(piece) - 1)}
        known = sorted({c for pair in pairs for c in pair})
        kinds = {c: at for at, c in enumerate(known, 1)}
        self.kind = np.zeros(0x110000, np.uint16)  # 0: in no pair
        self.kind[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.joins = np.zeros((len(known) + 1, len(known) + 1), bool)
        for left, right in pairs:
            self.joins[kinds[left], kinds[right]] = True

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a unit starts at each character; the first starts one."""
        kinds = self.kind[codes]
        return np.concatenate([[True], ~self.joins[kinds[:-1], kinds[1:]]])[: len(codes)]

    def units(self, text: str | None) -> list[str]:
        """Units of a text, in order; they join to a blank and the text."""
        given = spaced(text)
        at = np.flatnonzero(self.starts(codes_of(given))).tolist()
        return [given[a:b] for a, b in zip(at, [*at[1:], len(given)])]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def cutter_of(pieces: DataFrame) -> Cutter:
    return Cutter(row["piece"] for row in pieces.where("piece IS NOT NULL").select("piece").collect())


# ---------------------------------------------------------------- lattice

# An edge is one number: its end (31 bits), 255 less its length (8 bits) and a code (24 bits),
# so edges sort by their ends and then by their starts. A code is an id or, from ``CHARACTER``
# on, the number of a character without a piece. Beside it stands the edge's score.
END, LENGTH, CHARACTER = 32, 24, 1 << 23


def end_of(edge: Column) -> Column:
    return F.shiftright(edge, END).cast("int")


def length_of(edge: Column) -> Column:
    return F.lit(255) - F.shiftright(edge, LENGTH).bitwiseAND(F.lit(255)).cast("int")


def code_of(edge: Column) -> Column:
    return edge.bitwiseAND(F.lit((1 << LENGTH) - 1)).cast("int")


def lattice(units: DataFrame, pieces: DataFrame, longest: int, byte_score: float) -> DataFrame:
    """Rows (unit, chunk, edges): the edges of each ``CHUNK`` ends of a unit, in order, each
    with its score.

    ``units`` are distinct (unit, text). Dealt out by unit, they stay where they are. Every
    single character has an edge; without a piece it scores ``byte_score`` for each byte.
    """
    size = F.length("text")
    chunks = F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))
    placed = units.select("unit", "text", F.explode(chunks).alias("chunk"))
    # What lies before the chunk, as far as pieces that end in it may reach back.
    low = F.greatest(F.col("chunk") * CHUNK - (longest - 1), F.lit(0))
    high = F.least((F.col("chunk") + 1) * CHUNK, F.length("text"))
    part = F.when(size <= CHUNK, F.col("text")).otherwise(F.substring(F.col("text"), low + 1, high - low))
    placed = placed.select("unit", "chunk", low.alias("low"), high.alias("high"), part.alias("part"))
    # Two plain explodes run as generated code, unlike nested arrays of substrings.
    ends = placed.select(
        "unit", "chunk", "low", "part", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, "high")).alias("end")
    )
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.col("end") - F.col("low")))
    found = ends.select("unit", "chunk", "low", "part", "end", F.explode(sizes).alias("size")).select(
        "unit",
        "chunk",
        "end",
        "size",
        F.substring(F.col("part"), F.col("end") - F.col("size") - F.col("low") + 1, F.col("size")).alias("piece"),
    )
    # The piece table has as many rows as the model, which bounds the broadcast.
    known = pieces.where("piece IS NOT NULL").select("piece", "id", "score")
    joined = found.join(F.broadcast(known), "piece", "left").where("id IS NOT NULL OR size = 1")
    edge = (
        F.shiftleft(F.col("end").cast("bigint"), END)
        + F.shiftleft((F.lit(255) - F.col("size")).cast("bigint"), LENGTH)
        + F.coalesce("id", F.ascii("piece") + CHARACTER).cast("bigint")
    )
    score = F.coalesce("score", F.octet_length("piece") * F.lit(byte_score))
    return (
        joined.select("unit", "chunk", F.struct(edge.alias("edge"), score.alias("score")).alias("scored"))
        .groupBy("unit", "chunk")
        .agg(F.sort_array(F.collect_list("scored")).alias("edges"))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def character_bytes(number: Column) -> Column:
    """The bytes of a character, from its number."""

    def led(first: int, n_more: int) -> Column:
        lead = F.shiftright(number, 6 * n_more) + first
        more = [F.shiftright(number, 6 * at).bitwiseAND(F.lit(63)) + 128 for at in range(n_more - 1, -1, -1)]
        return F.array(lead, *more)

    return (
        F.when(number < 0x80, F.array(number))
        .when(number < 0x800, led(0xC0, 1))
        .when(number < 0x10000, led(0xE0, 2))
        .otherwise(led(0xF0, 3))
    )


def forward(edges: Column, tail: Column, base: Column) -> Column:
    """Viterbi fold: the ends in ``tail``, of which the first is end ``base``, and those of
    ``edges``, each with its score and last edge."""

    def step(best: Column, scored: Column) -> Column:
        edge = scored["edge"]
        start = end_of(edge) - length_of(edge)
        arrived = F.struct(
            (F.get(best, start - base)["score"] + scored["score"]).alias("score"),
            edge.alias("edge"),
        )
        size = F.size(best)
        return (
            F.when(size + base == end_of(edge), F.concat(best, F.array(arrived)))
            .when(
                arrived["score"] > F.element_at(best, -1)["score"],
                F.concat(F.slice(best, F.lit(1), size - 1), F.array(arrived)),
            )
            .otherwise(best)
        )

    return F.aggregate(edges, tail, step)


def backward(edges: Column, at: Column) -> Column:
    """The edges of the path that comes to end ``at``, and where it starts, from last edges in
    descending order of their ends."""
    none = F.array().cast("array<bigint>")
    start = F.struct(at.alias("at"), none.alias("path"))

    def back(state: Column, edge: Column) -> Column:
        further = F.struct(
            (end_of(edge) - length_of(edge)).alias("at"), F.concat(F.array(edge), state["path"]).alias("path")
        )
        return F.when(state["at"] == end_of(edge), further).otherwise(state)

    return F.aggregate(edges, start, back)


def first_end() -> Column:
    return F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("edge")))


def short_path(edges: Column) -> Column:
    """Score and edges of the best path of a unit of one chunk."""

    def path(best: Column) -> Column:
        last = F.reverse(F.slice(best, F.lit(2), F.size(best) - 1))["edge"]
        return F.struct(
            F.element_at(best, -1)["score"].alias("score"), backward(last, F.size(best) - 1)["path"].alias("path")
        )

    return let(forward(edges, first_end(), F.lit(0)), path)


def long_path(chunks: Column, longest: int) -> Column:
    """Score and edges of the best path of a unit, from the edges of its chunks in order."""
    none = F.array().cast("array<array<bigint>>")
    start = F.struct(first_end().alias("tail"), F.lit(0).alias("done"), none.alias("last"))

    def on(state: Column, edges: Column) -> Column:
        tail = state["tail"]
        known = F.size(tail)

        def carried(best: Column) -> Column:
            new = F.size(best) - known
            keep = F.least(F.lit(longest), F.size(best))
            return F.struct(
                F.slice(best, -keep, keep).alias("tail"),
                (state["done"] + new).alias("done"),
                F.concat(state["last"], F.array(F.slice(best, known + 1, new)["edge"])).alias("last"),
            )

        return let(forward(edges, tail, state["done"] - known + 1), carried)

    def path(ended: Column) -> Column:
        def back(state: Column, edges: Column) -> Column:
            return let(
                backward(F.reverse(edges), state["at"]),
                lambda found: F.struct(
                    found["at"].alias("at"), F.concat(F.array(found["path"]), state["paths"]).alias("paths")
                ),
            )

        start = F.struct(ended["done"].alias("at"), none.alias("paths"))
        return F.struct(
            F.element_at(ended["tail"], -1)["score"].alias("score"),
            F.flatten(F.aggregate(F.reverse(ended["last"]), start, back)["paths"]).alias("path"),
        )

    return let(F.aggregate(chunks, start, on), path)


def encoded_units(units: DataFrame, pieces: DataFrame) -> DataFrame:
    """The distinct rows of ``units`` with ids, score and number of characters without a piece.

    ``units`` are (unit) or (unit, text), where ``unit`` stands for a longer ``text``.
    """
    if "text" not in units.columns:
        units = units.select("unit", F.col("unit").alias("text"))
    real = pieces.where("piece IS NOT NULL").select("piece", "score").collect()  # as long as the model
    first_byte = pieces.where("piece IS NULL").agg(F.min("id")).first()[0]
    if first_byte is None:
        raise ValueError("the model has no pieces for bytes")
    longest = max(len(row["piece"]) for row in real)
    byte_score = min(row["score"] for row in real) + BYTE_SCORE

    def ids(edge: Column) -> Column:
        raw = F.transform(character_bytes(code_of(edge) - CHARACTER), lambda one: one + first_byte)
        return F.when(code_of(edge) < CHARACTER, F.array(code_of(edge))).otherwise(raw)

    grouped = lattice(units, pieces, longest, byte_score)
    is_long = F.startswith(F.col("unit"), F.lit(LONG_MARK)) | (F.length("unit") > CHUNK)
    short = grouped.where(~is_long).select("unit", short_path(F.col("edges")).alias("best"))
    chunks = grouped.where(is_long).groupBy("unit").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "edges"))).alias("chunks")
    )
    long = chunks.select("unit", long_path(F.col("chunks")["edges"], longest).alias("best"))
    best = short.union(long).select("unit", "best.score", "best.path")
    n_unknown = F.size(F.filter("path", lambda edge: code_of(edge) >= CHARACTER))
    counted = best.withColumn("n_unknown", n_unknown)
    plain = F.transform("path", code_of)
    with_bytes = F.flatten(F.transform("path", ids))
    return counted.select(
        "unit",
        F.when(F.col("n_unknown") == 0, plain).otherwise(with_bytes).alias("ids"),
        "score",
        "n_unknown",
    )


def decoded(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows with a column ``text`` for their ``ids``, with all blanks; rows must be distinct.

    Bytes that are no valid text become replacement characters. An empty array gives an
    empty text.
    """
    keys = [name for name in rows.columns if name != "ids"]
    parts = rows.select(*keys, F.posexplode_outer("ids").alias("at", "id"))
    named = parts.join(F.broadcast(pieces.select("id", F.hex("raw").alias("hex"))), "id", "left")
    together = named.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("hex", F.lit("")).alias("hex")))).alias("parts")
    )
    raw = F.unhex(F.array_join(F.col("parts")["hex"], ""))
    return together.select(*keys, F.decode(raw, "UTF-8").alias("text"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that are put back."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def unit_values(units: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows (unit, ids) of the distinct (unit, text), as a written table.

    The work on a unit is many times its size, so units are dealt out over all partitions
    of the session, and everything up to the values happens where they then are.
    """
    spark = units.sparkSession
    n = PARTITIONS_FACTOR * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.select("unit", "text").repartition(n, "unit").distinct()
    dealt = dealt.select("unit", F.coalesce("text", "unit").alias("text"))
    values = encoded_units(dealt, pieces).select("unit", "ids")
    with settings(spark, GROUPING | SHORT_PLANS | SMALL_TABLES):
        return stored(values, "unit-values")


class Split:
    """Short units of a text as bytes; tasks make their own tables from the pieces."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.cutter = pieces, None

    def __getstate__(self) -> list[str]:
        return self.pieces

    def __setstate__(self, pieces: list[str]) -> None:
        self.pieces, self.cutter = pieces, None

    def __call__(self, text: str | None) -> list[bytes]:
        self.cutter = self.cutter or Cutter(self.pieces)
        return [unit.encode() for unit in self.cutter.units(text) if len(unit) <= CHUNK]


def common_units(docs: DataFrame, most: int, pieces: list[str]) -> DataFrame:
    """Units that are common in a bounded sample of rows: whole classes of one count."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = docs.where(near).select("text", F.lit(0).alias("one"))
    counted = count_words(sample, "one", Split(pieces)).select(F.decode("word", "UTF-8").alias("unit"), "n")
    with settings(docs.sparkSession, SMALL_TABLES):
        counted = stored(counted, "unit-counts")
    least, total = None, 0
    for row in counted.groupBy("n").agg(F.count("*").alias("units")).orderBy(F.desc("n")).collect():
        total += row["units"]
        if total > most:
            break
        least = row["n"]
    common = counted.where(F.lit(False) if least is None else F.col("n") >= least)
    return common.select("unit", F.lit(None).cast("string").alias("text"), "n")


# ---------------------------------------------------------------- units of a slice


@dataclass
class Units:
    """The units of several texts, each a number of a distinct one."""

    names: list[str]  # distinct units
    which: np.ndarray  # the unit at each place
    limits: np.ndarray  # places at which the texts begin, and the last one ends


def units_of(texts: list[str], cutter: Cutter) -> Units:
    """Units of texts that begin with a blank.

    Equal units are found by 64-bit hashes of their characters and compared character by
    character; should two hashes ever meet, the units are numbered by their text instead.
    """
    joined = "".join(texts)
    codes = codes_of(joined)
    begins = bounds([len(text) for text in texts])
    first = cutter.starts(codes)
    first[begins[:-1]] = True
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(codes)))
    limits = np.searchsorted(starts, begins)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(codes) + 1, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
        inverse = np.cumprod(np.full(len(codes) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
        hashes = (sums[starts + sizes] - sums[starts]) * inverse[starts]
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    if not (sizes[at][which] == sizes).all() or not (codes[ragged(starts[at][which], sizes)] == codes).all():
        found: dict[str, int] = {}
        parts = [joined[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist())]
        which = np.array([found.setdefault(part, len(found)) for part in parts], np.int64)
        return Units(list(found), which, limits)
    names = [joined[a : a + n] for a, n in zip(starts[at].tolist(), sizes[at].tolist())]
    return Units(names, which, limits)


class Model:
    """What an id decodes to and scores."""

    def __init__(self, rows: list, worst: float):
        top = max(row["id"] for row in rows)
        self.kind = "<u2" if top < 65_536 else "<u4"
        raw, self.scores = [b""] * (top + 1), np.zeros(top + 1)
        self.opens = np.zeros(top + 1, bool)  # bytes that begin a character
        for row in rows:
            raw[row["id"]] = bytes(row["raw"])
            is_byte = row["piece"] is None
            self.scores[row["id"]] = worst if is_byte else row["score"]
            self.opens[row["id"]] = is_byte and not 0x80 <= raw[row["id"]][0] < 0xC0
        self.raw, self.limits = np.frombuffer(b"".join(raw), np.uint8), bounds([len(one) for one in raw])


# ---------------------------------------------------------------- whole documents

# A slice has one row without a unit, and one for each of its units that are not common. The
# latter have numbers (``at``). ``packed`` has for each place the number of its common unit, from
# 1 on by falling counts, or 0; ``others`` has the numbers of the other units in turn.
PARTS = pa.schema(
    [
        ("slice", pa.int64()), ("at", pa.int32()), ("unit", pa.string()), ("text", pa.string()),
        ("packed", pa.binary()), ("others", pa.binary()), ("docs", pa.binary()),
    ]
)
PARTS_SCHEMA = "slice long, at int, unit string, text string, packed binary, others binary, docs binary"
DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n_units", "<i8"), ("hash", "V16")])
ENCODED = pa.schema(
    [
        ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string()),
        ("n_units", pa.int64()), ("n_pieces", pa.int64()), ("n_unknown", pa.int64()),
        ("score", pa.float64()), ("checksum", pa.int64()), ("round_trip", pa.bool_()),
    ]
)
ENCODED_SCHEMA = (
    "doc_id long, ids array<int>, text string, n_units long, n_pieces long, n_unknown long, "
    "score double, checksum long, round_trip boolean"
)


def text_hash(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def of_groups(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Sums of groups of consecutive values."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[limits[1:]] - sums[limits[:-1]]


def batch_of(schema: pa.Schema, n: int, **columns: pa.Array) -> pa.RecordBatch:
    arrays = [columns.get(field.name, pa.nulls(n, field.type)).cast(field.type) for field in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 with their first bytes together, and so on, which packs better."""
    columns = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(columns.tobytes())


def unsqueezed(content: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(content)
    columns = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(columns.T).view("<u4").ravel().astype(np.int64)


def cut_slice(part: pa.RecordBatch, number: int, cutter: Cutter, known: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """A row for the slice with the numbers of its common units, and one for each of its others."""
    texts = [spaced(text) for text in part.column("text").to_pylist()]
    units = units_of(texts, cutter)
    found = np.fromiter((known.get(name, 0) for name in units.names), np.int64, len(units.names))
    others = np.flatnonzero(found == 0)
    numbers = np.zeros(len(found), np.int64)
    numbers[others] = np.arange(len(others))
    at = found[units.which]
    docs = np.zeros(len(texts), DOC)
    doc_ids = part.column("doc_id")
    docs["doc_id"] = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    docs["known"] = np.asarray(doc_ids.is_valid())
    docs["n_units"] = np.diff(units.limits)
    docs["hash"] = np.frombuffer(b"".join(map(text_hash, texts)), "V16")
    yield batch_of(
        PARTS,
        1,
        slice=pa.array([number]),
        packed=pa.array([squeezed(at)], pa.binary()),
        others=pa.array([squeezed(numbers[units.which[at == 0]])], pa.binary()),
        docs=pa.array([docs.tobytes()], pa.binary()),
    )
    if not len(others):
        return
    names = [units.names[one] for one in others.tolist()]
    keys = [
        name if len(name) <= CHUNK else LONG_MARK + hashlib.sha256(name.encode()).hexdigest() for name in names
    ]
    yield batch_of(
        PARTS,
        len(others),
        slice=pa.array(np.full(len(others), number)),
        at=pa.array(np.arange(len(others))),
        unit=pa.array(keys, pa.string()),
        text=pa.array([name if len(name) > CHUNK else None for name in names], pa.string()),
    )


def pack_by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slice, paths) from rows (slice, at, ids): what a slice has here in one."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        number, at = rows.column("slice").to_numpy(), rows.column("at").to_numpy()
        order = np.lexsort((at, number))
        number, at = number[order], at[order]
        ids = rows.column("ids").chunk(0)
        starts = ids.offsets.to_numpy()
        sizes = np.diff(starts)[order]
        flat = ids.values.to_numpy()[ragged(starts[:-1][order], sizes)]
        ends = bounds(sizes)
        opens = np.flatnonzero(np.diff(number, prepend=number[0] - 1)).tolist()
        packed = [
            squeezed(np.concatenate([[b - a], np.diff(at[a:b], prepend=0), sizes[a:b], flat[ends[a] : ends[b]]]))
            for a, b in zip(opens, [*opens[1:], len(number)])
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(number[opens]), pa.array(packed, pa.binary())], names=["slice", "paths"]
        )

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACKED_ROWS:
            yield pack(held)
            held, n = [], 0
    if held:
        yield pack(held)


def unpack_paths(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units of a slice by their numbers, and how many each has."""
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    for one in packed:
        numbers = unsqueezed(one)
        n = int(numbers[0])
        found.append((np.cumsum(numbers[1 : n + 1]), numbers[n + 1 : 2 * n + 1], numbers[2 * n + 1 :]))
    at, sizes, ids = (np.concatenate(column) for column in zip(*found))
    order = np.argsort(at)
    if not (at[order] == np.arange(len(at))).all():
        raise ValueError("a slice needs each of its units once")
    starts = np.cumsum(sizes) - sizes
    return ids[ragged(starts[order], sizes[order])], sizes[order]


def put_together(
    own: dict, packed: list[bytes], model: Model, known: tuple[np.ndarray, np.ndarray]
) -> pa.RecordBatch:
    """Whole documents of a slice from its own row and the ids of its other units; ``known`` are
    the ids of the common units and how many each has."""
    docs = np.frombuffer(own["docs"], DOC)
    at = unsqueezed(own["packed"])
    ids, sizes = unpack_paths(packed)
    # Units of the slice follow the common ones.
    which = at - 1
    which[at == 0] = len(known[1]) + unsqueezed(own["others"])
    ids, sizes = np.concatenate([known[0], ids]), np.concatenate([known[1], sizes])
    starts, sizes = (np.cumsum(sizes) - sizes)[which], sizes[which]
    whole = ids[ragged(starts, sizes)].astype(np.int32)
    n = len(docs)
    lengths = of_groups(sizes, bounds(docs["n_units"]))
    ends = bounds(lengths)
    widths = np.diff(model.limits)[whole]
    decoded_bytes = model.raw[ragged(model.limits[:-1][whole], widths)].tobytes()
    byte_ends = bounds(widths)[ends].tolist()
    texts = [decoded_bytes[a:b].decode("utf-8", "replace") for a, b in zip(byte_ends, byte_ends[1:])]
    little = whole.astype("<u4").tobytes()
    edges = (4 * ends).tolist()
    hashes = docs["hash"].tolist()
    return batch_of(
        ENCODED,
        n,
        doc_id=pa.array(docs["doc_id"], mask=docs["known"] == 0),
        ids=pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(whole)),
        text=pa.array(texts, pa.string()),
        n_units=pa.array(docs["n_units"]),
        n_pieces=pa.array(lengths),
        # Bytes stand for nothing but characters without a piece.
        n_unknown=pa.array(of_groups(model.opens[whole].astype(np.int64), ends)),
        score=pa.array(of_groups(model.scores[whole], ends)),
        checksum=pa.array([zlib.crc32(little[a:b]) for a, b in zip(edges, edges[1:])], pa.int64()),
        round_trip=pa.array([text_hash(text) == one for text, one in zip(texts, hashes)]),
    )


def encoded(docs: DataFrame, pieces: DataFrame, common: int = COMMON_UNITS) -> DataFrame:
    """For every row of ``docs`` its ids, the text they decode to (with the blank in front),
    units, pieces, characters without a piece, score, checksum and whether the text is the same."""
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = pieces.collect()
    texts = [row["piece"] for row in rows if row["piece"] is not None]
    worst = min(row["score"] for row in rows if row["piece"] is not None) + BYTE_SCORE
    model = context.broadcast((texts, Model(rows, worst)))
    del rows
    counted = common_units(docs, common, texts)
    values = unit_values(counted, pieces)
    table = values.join(counted.select("unit", "n"), "unit").select("unit", "ids", "n").toArrow()
    remove(spark, folders_of(values) + folders_of(counted))
    table = table.sort_by([("n", "descending"), ("unit", "ascending")]).combine_chunks()
    # One block of names instead of an object for each: at most ``COMMON_UNITS`` rows.
    names = context.broadcast(
        ("".join(found := table.column("unit").to_pylist()), bounds([len(name) for name in found]))
    )
    kind = model.value[1].kind
    carried = context.broadcast(
        (
            pc.list_flatten(table.column("ids")).to_numpy().astype(kind),
            pc.list_value_length(table.column("ids")).to_numpy().astype(np.int64),
        )
    )
    del table, found

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, limits = names.value
        limits = limits.tolist()
        known = {joined[a:b]: at for at, (a, b) in enumerate(zip(limits, limits[1:]), 1)}
        cutter = Cutter(model.value[0])
        first = TaskContext.get().partitionId() << 40
        for at, part in enumerate(slices(batches, size=SLICE)):
            yield from cut_slice(part, first + at, cutter, known)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packed = None, []
        # The slice's own row comes first.
        for batch in batches:
            for row in batch.to_pylist():
                if row["paths"] is not None:
                    packed.append(row["paths"])
                    continue
                if own is not None:
                    yield put_together(own, packed, model.value[1], carried.value)
                own, packed = row, []
        if own is not None:
            yield put_together(own, packed, model.value[1], carried.value)

    with settings(spark, SHORT_PLANS | SMALL_TABLES):
        # In folders of their own, for the units are of no use once their ids are known.
        folder = shared_folder(spark, "unit-parts")
        parts = docs.select("doc_id", "text").mapInArrow(cut, PARTS_SCHEMA)
        parts.withColumn("whole", F.col("unit").isNull()).write.partitionBy("whole").parquet(folder)
    parts = spark.read.schema(PARTS_SCHEMA + ", whole boolean").parquet(folder)
    rest = parts.where("NOT whole")
    values = unit_values(rest, pieces)
    joined = rest.select("slice", "at", "unit").join(values, "unit").select("slice", "at", "ids")
    with settings(spark, SHORT_PLANS | SMALL_TABLES):
        paths = stored(joined.mapInArrow(pack_by_slice, "slice long, paths binary"), "unit-paths")
    remove(spark, [f"{folder}/whole=false", *folders_of(values)])
    own = parts.where("whole").select("slice", "packed", "others", "docs")
    n = PARTITIONS_FACTOR * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(paths, allowMissingColumns=True).repartition(n, "slice")
    first = F.col("paths").isNotNull()
    return dealt.sortWithinPartitions("slice", first).mapInArrow(together, ENCODED_SCHEMA)
