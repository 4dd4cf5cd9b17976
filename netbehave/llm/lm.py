"""Scores of texts under a causal self-attention model of subword ids.

Words are counted over all training rows. The counts give the base score of a text, that of
a smoothed unigram model. They also give the counts of the subword ids, for the tokenizer
drops blanks and so the ids of a text are those of its words; the commonest ids get a
place of their own in the attention model and the others share one, by their counts. How
often an id follows another inside the words, and how words begin, is the prior that the
attention model adds to. The
model learns from every token of every training row, in one pass of ``STEPS`` steps, and then
scores every token of every text once, from the window of tokens before it.

A word's probability is that of its ids under the attention model, mixed with that of the
base (``MIX``), which knows the word as a whole. The base has one share for all words that
training has not, and so has the mixture: words of training and the class of all others
are what the probabilities are over, and together they have 1 at most. The end counts as a
word.

Every text is read and encoded once: a table holds the number of each word of a text among
the commonest (at most ``COMMON_WORDS``), which with counts and ids go to every task, and the
other words with their ids. Counts of ids, training and scores come from that table. What a
text needs of other words' counts travels: one row for each of them, joined to the counts.

Results for odd rows: a null or empty text is the end token alone. Repeated rows are scored
each. Without a training row all counts are 0, and the model keeps its starting values.
Columns other than ``doc_id`` and ``text`` are not read by ``score``, nor others than those of
the condition that says which rows are learned from.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netbehave.llm import attention
from netbehave.llm.attention import INPUTS, OUTPUTS, RARE, START
from netbehave.llm.tokenfile import WordEncoder
from netbehave.llm.words import (
    bounds,
    count_words,
    lower_words,
    ragged,
    remove,
    shared_folder,
    slices,
    stored,
    worker_state,
)

COMMON_WORDS = 400_000
MIX = 0.5  # weight of the base
STEPS = 100  # of training, each over a share of all training rows
PIECES, PIECE_TOKENS = 256, 100_000  # files of a share, at most, and tokens of one, about
SEED = 7
SLICE = 500_000

ENCODED = (
    "row long, doc_id long, learned boolean, scored boolean, draw long, "
    "numbers binary, rest binary, rest_sizes binary, rest_ids binary"
)
WORDS = ("numbers", "rest_sizes", "rest_ids")  # what ``CommonWords.tokens`` reads
MIXED = (
    "row long, doc_id long, word binary, log double, n_tokens long, n_known long, "
    "base double, score double"
)
MIXED_KINDS = (
    pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()
)


@dataclass
class Vocabulary:
    """Ids of the tokenizer, by how often they occur in the training rows."""

    inputs: np.ndarray  # row of the embedding table for each id
    classes: np.ndarray  # class for each id
    shares: np.ndarray  # natural log of each id's share of its class

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        order = np.lexsort((np.arange(len(counts)), -counts))
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        rest = rank >= OUTPUTS
        shares = np.zeros(len(counts))
        shares[rest] = np.log((counts[rest] + 1) / (counts[rest] + 1).sum())
        return cls(np.where(rank < INPUTS, rank, RARE), np.minimum(rank, OUTPUTS), shares)


def encoder_of(tokenizer: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_state(f"words {zlib.crc32(tokenizer.encode())}", lambda: WordEncoder(tokenizer))


# ---------------------------------------------------------------- corpus


class Numbers(dict):
    """Numbers of words; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class CommonWords:
    """The commonest words by their numbers, and last the end, which counts as a word.

    One block of words and one of ids instead of an object for each. The parts travel, and not the
    object, whose class tasks may not have.
    """

    raw: bytes
    cuts: np.ndarray  # where each word starts in ``raw``, and the last ends
    counts: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray  # ids of each word

    @classmethod
    def of(cls, found: pa.Table, end: int, end_count: int) -> CommonWords:
        """From rows (word, n, ids), the commonest first, since these have the shortest numbers."""
        found = found.sort_by([("n", "descending"), ("word", "ascending")])
        raw, cuts = block_of(found.column("word"))
        raw_ids, id_cuts = block_of(found.column("ids"))
        ids = np.append(np.frombuffer(raw_ids, "<u4"), np.uint32(end)).astype(kind_of(end))
        return cls(
            raw, cuts, np.append(found.column("n").to_numpy(), end_count), ids, np.append(np.diff(id_cuts) // 4, 1)
        )

    def parts(self) -> tuple:
        return self.raw, self.cuts, self.counts, self.ids, self.sizes

    def numbers(self) -> Numbers:
        cuts = self.cuts.tolist()
        return Numbers((self.raw[a:b], at) for at, (a, b) in enumerate(zip(cuts, cuts[1:])))

    def tokens(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts of a batch in turn, each with the end behind; numbers of their words
        (-1 for others), where each word's ids start and the last's end, and so for texts' words."""
        number = np.frombuffer(b"".join(raw := part.column("numbers").to_pylist()), "<i4").astype(np.int64)
        limits = bounds([len(one) // 4 for one in raw])
        rest = np.frombuffer(b"".join(part.column("rest_ids").to_pylist()), self.ids.dtype)
        other = number < 0
        # Ids of other words lie behind those of the commonest.
        sizes, starts = self.sizes[number], (np.cumsum(self.sizes) - self.sizes)[number]
        sizes[other] = np.frombuffer(b"".join(part.column("rest_sizes").to_pylist()), "<i4")
        starts[other] = len(self.ids) + np.cumsum(sizes[other]) - sizes[other]
        return np.concatenate([self.ids, rest])[ragged(starts, sizes)], number, bounds(sizes), limits


def kind_of(end: int) -> type:
    return np.uint16 if end < 65_536 else np.uint32


def binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values of what lies between ``cuts``."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )


def encoded(docs: DataFrame, common: Broadcast, carried: Broadcast) -> DataFrame:
    """Rows (doc_id, text, learned, scored) with the numbers, ids and other words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, encoder = CommonWords(*common.value), encoder_of(carried.value)
        number_of, end_number = known.numbers(), len(known.sizes) - 1
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches, size=SLICE):
            words = [lower_words(text) for text in part.column("text").to_pylist()]
            limits = bounds([len(one) for one in words])
            every = list(chain.from_iterable(words))
            number = np.fromiter(map(number_of.__getitem__, every), np.int32, len(every))
            others = np.flatnonzero(number < 0)
            rest = [every[at] for at in others.tolist()]
            ids = encoder.encode_words(rest)
            sizes = np.array([len(one) // 4 for one in ids], np.int32)
            cuts = np.searchsorted(others, limits)
            joined = [b" ".join(rest[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            n = len(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)),
                    part.column("doc_id"),
                    part.column("learned"),
                    part.column("scored"),
                    part.column("draw"),
                    binary(np.insert(number, limits[1:], end_number), limits + np.arange(n + 1)),
                    pa.array(joined, pa.binary()),
                    binary(sizes, cuts),
                    binary(np.frombuffer(b"".join(ids), "<u4").astype(known.ids.dtype), bounds(sizes)[cuts]),
                ],
                names=[field.split()[0] for field in ENCODED.split(", ")],
            )
            row += n

    drawn = docs.select("doc_id", "text", "learned", "scored", F.xxhash64("doc_id", "text").alias("draw"))
    return drawn.mapInArrow(run, ENCODED)


def with_ids(counts: DataFrame, carried) -> DataFrame:
    """Rows (word, n, ids) from rows (word, n): every distinct word encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(carried.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                found = encoder.encode_words(part.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("word"), part.column("n"), pa.array(found, pa.binary())],
                    names=["word", "n", "ids"],
                )

    return counts.select("word", "n").mapInArrow(run, "word binary, n long, ids binary")


def summed(texts: DataFrame, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None], size: int) -> np.ndarray:
    """Sum over all tasks of an array of ``size`` numbers that ``add`` adds to, from the ids of
    the words of learned texts that are not among the commonest, and their sizes.

    Only the sums that are not 0 travel, at most ``size`` rows to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            sizes = np.frombuffer(b"".join(batch.column("rest_sizes").to_pylist()), "<i4")
            raw = b"".join(batch.column("rest_ids").to_pylist())
            if len(sizes) and (n_ids := int(sizes.sum(dtype=np.int64))):
                kind = f"<u{len(raw) // n_ids}"
                add(total, np.frombuffer(raw, kind).astype(np.int64), sizes.astype(np.int64))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there.astype(np.int64)), pa.array(total[there])], names=["id", "n"]
        )

    found = texts.where("learned").select("rest_sizes", "rest_ids").mapInArrow(run, "id long, n double")
    rows = found.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    result = np.zeros(size)
    result[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return result


def id_counts(texts: DataFrame, common: CommonWords, n_ids: int) -> np.ndarray:
    """How often each id occurs in the training rows."""

    def add(total: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        total += np.bincount(ids, minlength=len(total))

    listed = np.bincount(common.ids, np.repeat(common.counts, common.sizes), n_ids)
    return summed(texts, add, n_ids) + listed


def class_prior(texts: DataFrame, common: CommonWords, vocabulary: Vocabulary, n_rows: int) -> np.ndarray:
    """Natural log of each class's share after each input, from the counts of all words.

    Inside a word its ids follow each other. Behind a word stands the first id of any
    other, or the end, by their counts; so does it behind the start.
    """
    inputs, classes = vocabulary.inputs, vocabulary.classes
    shape = (INPUTS + 2, OUTPUTS + 1)

    def add(total: np.ndarray, ids: np.ndarray, sizes: np.ndarray, n: np.ndarray | None = None) -> None:
        last = np.cumsum(sizes)[sizes > 0] - 1
        first = last + 1 - sizes[sizes > 0]
        times = np.ones(len(ids)) if n is None else np.repeat(n, sizes)
        inner = np.ones(len(ids), bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        pairs = inputs[ids[at]] * shape[1] + classes[ids[at + 1]]
        total[: -shape[0]] += np.bincount(pairs, times[at], shape[0] * shape[1])
        starts = START * shape[1] + classes[ids[first]]
        total[: -shape[0]] += np.bincount(starts, times[first], shape[0] * shape[1])
        # Behind the pairs: how often each input ends a word.
        total[-shape[0] :] += np.bincount(inputs[ids[last]], times[last], shape[0])

    total = summed(texts, add, shape[0] * shape[1] + shape[0])
    add(total, common.ids.astype(np.int64), common.sizes, common.counts)
    pairs, ends = total[: -shape[0]].reshape(shape), total[-shape[0] :]
    # Nothing stands behind an end.
    ends[inputs[common.ids[-1]]] -= n_rows
    opening = pairs[START] / max(1, pairs[START].sum())
    pairs += ends[:, None] * opening
    pairs[START] = opening * max(1, n_rows)
    common_shares = pairs.sum(0) + 1
    common_shares /= common_shares.sum()
    return np.log((pairs + 10 * common_shares) / (pairs.sum(1, keepdims=True) + 10)).astype(np.float32)


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """Words of whole classes of equal count, the commonest first, at most ``most``."""
    least, total = None, 0
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        total += row["words"]
        if total > most:
            break
        least = row["n"]
    return counts.where(F.lit(False) if least is None else F.col("n") >= least)


def token_shares(texts: DataFrame, shares: int, pieces: int) -> tuple[DataFrame, str]:
    """The learned texts of ``encoded`` dealt into shares, as a written table, and its folder.

    A hash deals the rows to shares, of which each has at most ``pieces`` files.
    """
    share = F.pmod("draw", F.lit(shares)).cast("int").alias("share")
    piece = F.pmod(F.xxhash64("draw"), F.lit(pieces)).cast("int").alias("piece")
    rows = texts.where("learned").select(share, piece, "draw", *WORDS)
    dealt = rows.repartition("share", "piece").sortWithinPartitions("share", "draw").drop("piece", "draw")
    folder = shared_folder(texts.sparkSession, "tokens")
    dealt.write.partitionBy("share").parquet(folder)
    kinds = ", ".join(f"{name} binary" for name in WORDS)
    return texts.sparkSession.read.schema(f"{kinds}, share int").parquet(folder), folder


def fit(
    training: DataFrame, carried: Broadcast, vocabulary: Vocabulary, prior: np.ndarray, end: int, n_tokens: int
) -> tuple[attention.Params, int]:
    """``learn`` from documents of which nothing is known yet."""
    nothing = pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
    common = training.sparkSession.sparkContext.broadcast(CommonWords.of(nothing, end, 0).parts())
    rows = training.select("doc_id", "text", F.lit(True).alias("learned"), F.lit(False).alias("scored"))
    return learn(encoded(rows, common, carried), common, vocabulary, prior, n_tokens)


def learn(
    texts: DataFrame, common: Broadcast, vocabulary: Vocabulary, prior: np.ndarray, n_tokens: int
) -> tuple[attention.Params, int]:
    """The model after one pass over all training rows, and how many tokens it predicted.

    The rows are dealt into ``STEPS`` shares. A step takes the gradient of all windows of
    the next share, summed by tasks; at most ``PIECES`` sums come to the driver.
    """
    spark = texts.sparkSession
    pieces = int(np.clip(-(-n_tokens // (STEPS * PIECE_TOKENS)), 1, PIECES))
    rows, folder = token_shares(texts, STEPS, pieces)
    tables = spark.sparkContext.broadcast((vocabulary.inputs, vocabulary.classes, attention.steps_of(prior)))
    adam, learned = attention.Adam(attention.initial(SEED), STEPS), 0
    shapes = {name: value.shape for name, value in adam.params.items()}

    def gradient(params: attention.Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            inputs_of, classes_of, shares = tables.value
            known = CommonWords(*common.value)
            total, sums = 0, np.zeros(sum(value.size for value in params.values()))
            for part in slices(batches, "numbers", SLICE):
                tokens, _, cuts, limits = known.tokens(part)
                n, found = attention.gradient_sums(
                    params, before(inputs_of, tokens, cuts[limits]), classes_of[tokens], cuts[limits], shares
                )
                total += n
                sums += np.concatenate([found[name].ravel() for name in params])
            yield pa.RecordBatch.from_arrays(
                [pa.array([total], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["n", "sums"]
            )

        return run

    for step in range(STEPS):
        share = rows.where(F.col("share") == step).select(*WORDS)
        parts = share.mapInArrow(gradient(adam.params), "n long, sums binary").collect()
        n = sum(part["n"] for part in parts)
        if not n:
            continue
        learned += n
        mean = sum(np.frombuffer(part["sums"]) for part in parts) / n
        ends = np.cumsum([math.prod(shape) for shape in shapes.values()])
        found = np.split(mean.astype(np.float32), ends[:-1])
        adam.move({name: one.reshape(shape) for (name, shape), one in zip(shapes.items(), found)})
    remove(spark, [folder])
    return adam.params | {"prior": prior}, learned


def before(inputs_of: np.ndarray, tokens: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The input at the place of each token: that before it, or the start."""
    inputs = np.concatenate([[START], inputs_of[tokens[:-1]]]) if len(tokens) else tokens
    inputs[limits[:-1]] = START
    return inputs


# ---------------------------------------------------------------- scoring


def block_of(column: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """Binary values in one block, and where each starts and the last ends."""
    sizes = pc.binary_length(column).to_numpy()
    parts = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if len(chunk) else b"")
    return b"".join(parts), bounds(sizes)


class Scorer:
    """Scores batches of encoded texts."""

    def __init__(self, common: CommonWords, denominator: float, vocabulary: Vocabulary, params: attention.Params):
        self.common, self.of = common, vocabulary
        self.share = (common.counts + 1) / denominator
        self.base = np.log10(self.share)
        self.predictor = attention.Predictor(params)

    def score(self, part: pa.RecordBatch):
        """Per text: tokens, and known tokens, base score and model score of the commonest words
        and the end; and the other words as (text, log10 probability of the ids)."""
        tokens, number, cuts, limits = self.common.tokens(part)
        n_texts = len(limits) - 1
        token_limits = cuts[limits]
        inputs = before(self.of.inputs, tokens, token_limits)
        scores = attention.log_scores(self.predictor, inputs, self.of.classes[tokens], token_limits)
        scores += self.of.shares[tokens]
        running = np.concatenate([[0], np.cumsum(scores / np.log(10))])
        log = running[cuts[1:]] - running[cuts[:-1]]
        owner = np.repeat(np.arange(n_texts), np.diff(limits))
        listed = number >= 0
        mine, of = owner[listed], number[listed]
        known = np.bincount(mine, self.common.counts[of] > 0, n_texts).astype(np.int64)
        base = np.bincount(mine, self.base[of], n_texts)
        mixed = np.log10(MIX * self.share[of] + (1 - MIX) * 10.0 ** log[listed])
        model = np.bincount(mine, mixed, n_texts)
        return np.diff(limits), known, base, model, (owner[~listed], log[~listed])


def score(docs: DataFrame, training: DataFrame | Column, tokenizer: str, end: int) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``training`` tells which of the rows are learned from, or holds other rows to learn from.
    """
    spark = docs.sparkSession
    text = spark.sparkContext.broadcast(tokenizer)
    if isinstance(training, Column):
        every = docs.select("doc_id", "text", training.alias("learned"), F.lit(True).alias("scored"))
        training = docs.where(training)
    else:
        every = docs.select("doc_id", "text", F.lit(False).alias("learned"), F.lit(True).alias("scored")).union(
            training.select("doc_id", "text", F.lit(True).alias("learned"), F.lit(False).alias("scored"))
        )
    counted = count_words(training.select("text", F.lit(0).alias("one")), "one")
    counts = stored(counted.select("word", "n"), "words")
    end_count = training.count()
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_tokens = int(row["n"]) + end_count
    distinct = int(row["v"]) + (end_count > 0)
    denominator = float(train_tokens + distinct + 1)

    known = CommonWords.of(with_ids(commonest(counts, COMMON_WORDS), text).toArrow(), end, end_count)
    common = spark.sparkContext.broadcast(known.parts())
    texts = stored(encoded(every, common, text), "texts")
    by_id = id_counts(texts, known, end + 1)
    vocabulary = Vocabulary.of(by_id)
    prior = class_prior(texts, known, vocabulary, end_count)
    params, _ = learn(texts, common, vocabulary, prior, int(by_id.sum()))
    carried = spark.sparkContext.broadcast((vocabulary.inputs, vocabulary.classes, vocabulary.shares, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *ids, params = carried.value
        scorer = Scorer(CommonWords(*common.value), denominator, Vocabulary(*ids), params)
        for part in slices(batches, "numbers", SLICE):
            n_tokens, n_known, base, model, (at, log) = scorer.score(part)
            unlisted = [word for one in part.column("rest").to_pylist() for word in one.split()]
            n, m = part.num_rows, len(unlisted)
            none = [None] * m
            at = pa.array(at)
            values = [
                pa.concat_arrays([part.column("row"), part.column("row").take(at)]),
                pa.concat_arrays([part.column("doc_id"), part.column("doc_id").take(at)]),
                [*[None] * n, *unlisted],
                [*[None] * n, *log.tolist()],
                [*n_tokens.tolist(), *none],
                [*n_known.tolist(), *none],
                [*base.tolist(), *none],
                [*model.tolist(), *none],
            ]
            arrays = [pa.array(value, kind) for value, kind in zip(values, MIXED_KINDS)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in MIXED.split(", ")])

    asked = texts.where("scored").select("row", "doc_id", "rest", *WORDS)
    mixed = stored(asked.mapInArrow(run, MIXED), "scores")
    sums = mixed.where("word IS NULL").select("row", "doc_id", "n_tokens", "n_known", "base", "score")
    others = mixed.where("word IS NOT NULL").select("row", "doc_id", "word", "log")
    count = F.coalesce("n", F.lit(0))
    share = (count + 1) / F.lit(denominator)
    mixed_log = F.log10(F.lit(MIX) * share + F.lit(1 - MIX) * F.pow(F.lit(10.0), F.col("log")))
    rest = others.join(counts, "word", "left").select(
        "row",
        "doc_id",
        F.lit(0).cast("long").alias("n_tokens"),
        F.when(count > 0, 1).otherwise(0).cast("long").alias("n_known"),
        F.log10(share).alias("base"),
        mixed_log.alias("score"),
    )
    return (
        sums.union(rest)
        .groupBy("row", "doc_id")
        .agg(*[F.sum(name).alias(name) for name in ("n_tokens", "n_known", "base", "score")])
        .select(
            "doc_id",
            "n_tokens",
            "n_known",
            F.lit(train_tokens).cast("long").alias("train_tokens"),
            F.col("base").alias("base_score"),
            "score",
        )
    )
