"""Language of code-switched texts, word by word, by a conditional random field.

The score of a language at a word comes from the word's affixes, its byte n-grams and
lexicons of frequent words of each language, and learned transitions tie neighbouring
words together. Forward-backward gives the probability of each language at each word; a
document gets the language with the largest sum over its words that hold a letter, and its
share of that sum as score.

The lexicons are counted over all training rows; the weights are fitted on windows of
words from at most ``SAMPLE_ROWS`` rows of each language, drawn by a hash of ``doc_id``.

Results for odd rows: a text that is null or has no letter is ``und`` with score 0. If no
row has a language to learn from, every text is ``und`` with score 0. Repeated rows give
equal results. ``predict`` reads ``doc_id`` and ``text`` alone; ``fit`` reads ``lang`` too.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netbehave.llm import crf
from netbehave.llm.words import bounds, count_words, ragged, slices, stored, worker_state, words_of

SAMPLE_ROWS = 1500  # bound of the labelled rows of each language that weights are fitted on
WINDOW = 40  # words taken from a sampled row
LEXICON_SHARE = 1e-4  # of a language's words; so a lexicon has at most 10,000 words
BUCKETS = 1 << 15
STEPS = 60
LETTER = re.compile(r"[^\W\d_]")
EDGES = bytes(c for c in range(128) if not chr(c).isalpha())
UNKNOWN = "und"


@dataclass
class Identifier:
    langs: list[str]
    lexicon: dict[bytes, list[int]]
    model: crf.Model


def core_of(word: bytes) -> bytes:
    """Word in lower case (A-Z) without the ASCII signs and digits around it."""
    return word.lower().strip(EDGES)


def features(core: bytes, lexicon: dict[bytes, list[int]]) -> list[int]:
    """Hashed n-grams and affixes, then one feature per lexicon that holds the word."""
    if not core:
        return []
    framed = b"^" + core + b"$"
    grams = [framed[at : at + 3] for at in range(len(framed) - 2)]
    grams += [b"p" + framed[:3], b"P" + framed[:4], b"s" + framed[-3:], b"S" + framed[-4:]]
    grams.append(b"w" + core)
    found = [zlib.crc32(gram) % BUCKETS for gram in grams]
    return found + [BUCKETS + lang for lang in lexicon.get(core, ())]


def crc_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, values >> 1 ^ np.uint32(0xEDB88320), values >> 1)
    return values


CRC = crc_table()


def crc_on(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The state of a CRC-32 after one more byte."""
    return CRC[(state ^ byte) & 0xFF] ^ state >> 8


def features_of(cores: list[bytes], lexicon: dict[bytes, list[int]], n_features: int) -> crf.Features:
    """The features of many words at once, the same as ``features`` gives for each."""
    real = np.flatnonzero([bool(core) for core in cores])
    framed = [b"^" + cores[at] + b"$" for at in real.tolist()]
    data = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint32)
    limits = bounds([len(one) for one in framed])
    start, end, size = limits[:-1], limits[1:], np.diff(limits)

    def hashed(first: bytes, at: np.ndarray, n: int) -> np.ndarray:
        state = np.full(len(at), zlib.crc32(first) ^ 0xFFFFFFFF, np.uint32)
        for shift in range(n):
            state = crc_on(state, data[at + shift])
        return state ^ np.uint32(0xFFFFFFFF)

    def affix(first: bytes, at: np.ndarray, n: int) -> np.ndarray:
        """Words shorter than the affix have all of their letters in it."""
        found = np.zeros(len(size), np.uint32)
        for fits, width in ((size >= n, n), (size < n, 3)):
            where = start if at is start else end - width
            found[fits] = hashed(first, where[fits], width)
        return found

    grams = size - 2
    types = [np.repeat(real, grams), real, real, real, real, real]
    found = [
        hashed(b"", ragged(start, grams), 3),
        affix(b"p", start, 3),
        affix(b"P", start, 4),
        affix(b"s", end, 3),
        affix(b"S", end, 4),
        np.array([zlib.crc32(b"w" + cores[at]) for at in real.tolist()], np.uint32),
    ]
    listed = [(at, lang) for at, core in enumerate(cores) for lang in lexicon.get(core, ())]
    known = np.array(listed, np.int64).reshape(-1, 2)
    return crf.Features(
        np.concatenate([*types, known[:, 0]]),
        np.concatenate([np.concatenate(found).astype(np.int64) % BUCKETS, BUCKETS + known[:, 1]]),
        len(cores),
        n_features,
    )


# ---------------------------------------------------------------- fitting


def lexicons(training: DataFrame, langs: list[str]) -> dict[bytes, list[int]]:
    """Words with at least ``LEXICON_SHARE`` of a language's words, over all rows."""
    counts = stored(count_words(training, "lang"), "lang-words")
    totals = {row["group"]: row["n"] for row in counts.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    least = F.lit(None)
    for lang in langs:
        share = max(1, int(totals.get(lang, 0) * LEXICON_SHARE))
        least = F.when(F.col("group") == lang, F.lit(share)).otherwise(least)
    found: dict[bytes, list[int]] = {}
    # At most 1 / LEXICON_SHARE rows of a language can pass.
    for row in counts.where(F.col("n") >= least).collect():
        numbers = found.setdefault(core_of(bytes(row["word"])), [])
        if langs.index(row["group"]) not in numbers:
            numbers.append(langs.index(row["group"]))
    return {word: sorted(numbers) for word, numbers in found.items()}


def fit(labelled: DataFrame, limit: int = SAMPLE_ROWS) -> Identifier | None:
    """Fit on rows (doc_id, text, lang); None if no row has a text and a language."""
    training = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {row["lang"]: row["count"] for row in training.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    # First a share of each language by hash, generously, then the exact number of rows.
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 3 * limit / sizes[lang]))).otherwise(share)
    near = training.withColumn("draw", draw).where(F.col("draw") < share)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            taken = []
            for text, at in zip(part.column("text").to_pylist(), part.column("draw").to_pylist()):
                words = words_of(text)
                start = int(zlib.crc32(repr(at).encode()) / 2**32 * max(1, len(words) - WINDOW // 2))
                taken.append(b" ".join(words[start : start + WINDOW]))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), part.column("draw"), pa.array(taken, pa.binary())],
                names=["lang", "draw", "window"],
            )

    drawn = near.select("lang", "draw", "text").mapInArrow(
        windows, "lang string, draw double, window binary"
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "window"))
    rows = drawn.withColumn("rank", rank).where(F.col("rank") <= limit).collect()
    lexicon = lexicons(training, langs)
    texts = [(langs.index(row["lang"]), bytes(row["window"]).split()) for row in rows]
    texts = [(lang, words) for lang, words in texts if words]
    there = np.zeros((len(texts), WINDOW), bool)
    ids = np.zeros((len(texts), WINDOW), np.int64)
    labels = np.zeros((len(texts), WINDOW), np.int64)
    cores: dict[bytes, int] = {}
    for at, (lang, words) in enumerate(texts):
        there[at, : len(words)], labels[at] = True, lang
        ids[at, : len(words)] = [cores.setdefault(core_of(word), len(cores)) for word in words]
    if not texts:
        return None
    view = crf.Features.of([features(core, lexicon) for core in cores], BUCKETS + len(langs))
    model = crf.train([ids], [view], labels, there, len(langs), steps=STEPS, penalty=0.05)
    return Identifier(langs, lexicon, model)


# ---------------------------------------------------------------- prediction


def rebuilt(
    langs: list[str],
    lexicon: dict[bytes, list[int]],
    weights: list[np.ndarray],
    transitions: np.ndarray,
) -> Identifier:
    return Identifier(langs, lexicon, crf.Model(weights, transitions))


class Scorer:
    """Scores of words, kept in a table that grows with the words met."""

    def __init__(self, identifier: Identifier):
        self.of = identifier
        self.weights = identifier.model.weights[0]
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((0, len(self.of.langs)))
        self.counts = np.zeros(0)  # 1 for words with a letter

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Sum over the words with a letter of each language's probability, as a share."""
        words = [words_of(text) for text in texts]
        limits = bounds([len(one) for one in words])
        flat = np.empty(limits[-1], object)
        flat[:] = [word for one in words for word in one]
        number, distinct = pd.factorize(flat)
        if len(self.rows) > 400_000:
            self.forget()
        new = [word for word in distinct if word not in self.rows]
        if new:
            cores = [core_of(word) for word in new]
            view = features_of(cores, self.of.lexicon, len(self.weights))
            letters = [
                bool(core and LETTER.search(core.decode("utf-8", "surrogatepass"))) for core in cores
            ]
            for word in new:
                self.rows[word] = len(self.rows)
            self.table = np.concatenate([self.table, view.scores(self.weights)])
            self.counts = np.concatenate([self.counts, np.array(letters, float)])
        rows = np.array([self.rows[word] for word in distinct], np.int64)[number]
        likely = crf.marginals(self.table[rows], self.of.model.transitions, limits)
        likely *= self.counts[rows][:, None]
        owner = np.repeat(np.arange(len(texts)), np.diff(limits))
        sums = np.stack([np.bincount(owner, one, len(texts)) for one in likely.T], axis=1)
        return sums / np.maximum(sums.sum(1, keepdims=True), 1e-300)


def predict(docs: DataFrame, identifier: Identifier | None) -> DataFrame:
    """Language of every text with its share of the words."""

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        if carried:
            # The words met stay known from task to task, for the last identifier used.
            kept = worker_state("languages", dict)
            if name not in kept:
                kept.clear()
                kept[name] = Scorer(rebuilt(*carried.value))
            scorer = kept[name]
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            known = [bool(scorer and text and LETTER.search(text)) for text in texts]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if scorer:
                shares = scorer.shares(texts)
                best = shares.argmax(1)
                for at in np.flatnonzero(known).tolist():
                    langs[at] = scorer.of.langs[best[at]]
                    scores[at] = min(1.0, float(shares[at, best[at]]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    # Plain values, which executors can read without this package.
    parts = identifier and (
        identifier.langs,
        identifier.lexicon,
        identifier.model.weights,
        identifier.model.transitions,
    )
    carried = docs.sparkSession.sparkContext.broadcast(parts) if parts else None
    schema = "doc_id long, lang_pred string, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def remainder(divisor: int) -> Column:
    """crc32 of ``doc_id`` as text, modulo ``divisor``; null for a null ``doc_id``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor
