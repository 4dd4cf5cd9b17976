"""Quality rules on repetition, from a suffix array over the words of each text.

Suffixes are sorted by prefix doubling for many documents at once; the document number
is the first part of the sort key, so suffixes of two documents never mix. Neighbouring
suffixes give the longest-common-prefix (LCP) array. Its intervals are the repeated word
sequences: an interval of LCP value l over k suffixes is a sequence of l words that
occurs k times and cannot be extended to the right. The deepest interval around a suffix
has the larger of its two neighbouring LCP values, and the spans of all outer intervals
are prefixes of that one, so the union of all spans needs one span per suffix.

Results for odd rows: a null or empty text has no words, fails the base rule (fewer than
``MIN_WORDS``) and has zeros elsewhere. Repeated rows give repeated results. Columns
other than ``doc_id`` and ``text`` are not read by ``repetition``; ``keep_quality`` hands
them through under whatever names they have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from netbehave.llm.words import bounds, map_slices, record, slices, utf8

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50  # words in repeated 3-word windows
MIN_REPEAT = 5  # words from which a repeated sequence counts as covered
MAX_COVERED_PERCENT = 40
MAX_LONGEST = 100  # words
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"

TYPES = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
    "covered_words": pa.int64(),
    "longest_repeat": pa.int64(),
}
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long"
)


def suffix_array(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of concatenated documents and LCP of each entry with the one before.

    ``word`` holds word numbers, ``doc`` ascending document numbers. The LCP across two
    documents is 0.
    """
    size = len(word)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = doc.astype(np.int64) * (int(word.max()) + 1) + word
    order = np.argsort(key)
    end = np.searchsorted(doc, doc, "right")
    rank = np.empty(size, np.int64)
    levels = []
    slots, members, key = np.arange(size), order, key[order]
    step = 1
    while True:
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[members] = slots[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        order[slots] = members
        levels.append(rank.astype(np.int32))
        alone = first & np.concatenate([first[1:], [True]])
        slots, members = slots[~alone], members[~alone]
        if not len(slots):
            break
        # Groups lie in ascending order of rank, so sorting by (rank, rank of what follows)
        # reorders inside groups only.
        after = members + step
        follow = np.where(after < end[members], rank[np.minimum(after, size - 1)] + 1, 0)
        key = rank[members] * (size + 1) + follow
        inside = np.argsort(key)
        members, key = members[inside], key[inside]
        step *= 2
    lcp = np.zeros(size, np.int64)
    # Only neighbours that share their first word can have a common prefix.
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    left, right = order[near - 1], order[near]
    found = np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + found, right + found
        inside = (a < end[left]) & (b < end[right])
        same = levels[level][np.minimum(a, size - 1)] == levels[level][np.minimum(b, size - 1)]
        found += np.where(inside & same, 1 << level, 0)
    lcp[near] = found
    return order, lcp


def longest_here(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Length of the longest repeated sequence that starts at each word."""
    result = np.empty(len(order), np.int64)
    result[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    return result


def union(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` words lie in one of the spans."""
    change = np.bincount(starts, minlength=size + 1)
    change -= np.bincount(starts + lengths, minlength=size + 1)
    return np.cumsum(change[:size]) > 0


def lcp_intervals(
    order: np.ndarray, lcp: np.ndarray, before: np.ndarray, shortest: int
) -> Iterator[tuple[int, int, int]]:
    """Maximal repeats as (length, first entry, last entry) of the suffix array.

    ``before`` numbers the word in front of each suffix. An interval whose suffixes all
    follow the same word is part of a longer repeat and is left out.
    """
    change = np.cumsum(np.concatenate([[0], before[order[1:]] != before[order[:-1]]]))
    high = np.concatenate([[0], np.where(lcp[1:] >= shortest, lcp[1:], 0), [0]])
    ends = np.concatenate([[False], high[:-1] > 0])  # a run of repeats may end here
    stack: list[tuple[int, int]] = []  # (length, first entry)
    for at in np.flatnonzero((high > 0) | ends).tolist():
        value, start = int(high[at]), at - 1
        while stack and stack[-1][0] > value:
            length, start = stack.pop()
            if change[at - 1] != change[start]:
                yield length, start, at - 1
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, start))


def word_table(texts: list[str | None]) -> tuple[list[bytes], list[list[bytes]]]:
    raw = [utf8(text) if text else b"" for text in texts]
    return raw, [text.split() for text in raw]


def numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, document numbers and document bounds of a slice."""
    limits = bounds([len(one) for one in words])
    flat = np.empty(limits[-1], object)
    flat[:] = [word for one in words for word in one]
    number, _ = pd.factorize(flat)
    return number, np.repeat(np.arange(len(words)), np.diff(limits)), limits


def duplicate_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def measures(texts: list[str | None]) -> dict[str, object]:
    raw, words = word_table(texts)
    texts_or_empty = [text or "" for text in texts]
    blanks = [len(one) - len(one.translate(None, BLANKS)) for one in raw]
    number, doc, limits = numbered(words)
    order, lcp = suffix_array(number, doc)
    here = longest_here(order, lcp)
    n_words = np.diff(limits)

    def covered(shortest: int, whole: bool) -> np.ndarray:
        starts = np.flatnonzero(here >= shortest)
        lengths = here[starts] if whole else np.full(len(starts), shortest)
        return np.bincount(doc[union(starts, lengths, len(here))], minlength=len(texts))

    repeat_words = covered(3, whole=False)
    covered_words = covered(MIN_REPEAT, whole=True)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc[here >= MIN_REPEAT], here[here >= MIN_REPEAT])
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * n_words)
    bad = (100 * covered_words > MAX_COVERED_PERCENT * n_words) | (longest > MAX_LONGEST)
    return {
        "n_words": n_words,
        "word_chars": [len(one) - n for one, n in zip(texts_or_empty, blanks)],
        "n_symbols": [len(one) - len(one.translate(None, SYMBOLS)) for one in raw],
        "n_dup_lines": [duplicate_lines(one) for one in raw],
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "kept": ~failed & ~bad,
        "covered_words": covered_words,
        "longest_repeat": longest,
    }


def repetition(docs: DataFrame) -> DataFrame:
    """Base measures, repetition measures and verdict of every text."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        result = record(measures(part.column("text").to_pylist()), TYPES)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *result.columns], names=["doc_id", *TYPES]
        )

    return map_slices(docs.select("doc_id", "text"), work, f"doc_id long, {SCHEMA}")


def maximal_repeats(docs: DataFrame, shortest: int = MIN_REPEAT) -> DataFrame:
    """One row per maximal repeat: its words, their number and the word offsets it starts at."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        _, words = word_table(part.column("text").to_pylist())
        number, doc, limits = numbered(words)
        order, lcp = suffix_array(number, doc)
        size = len(number)
        before = np.concatenate([[-1], number[:-1]]) if size else number
        starts = limits[:-1][limits[:-1] < size]
        before[starts] = -1 - np.arange(len(starts))  # the start of a text equals nothing
        ids = part.column("doc_id").to_pylist()
        rows: dict[str, list] = {"doc_id": [], "repeat": [], "n_words": [], "starts": []}
        for length, low, high in lcp_intervals(order, lcp, before, shortest):
            places = np.sort(order[low : high + 1])
            one = int(doc[places[0]])
            first = int(places[0] - limits[one])
            rows["doc_id"].append(ids[one])
            rows["repeat"].append(b" ".join(words[one][first : first + length]).decode())
            rows["n_words"].append(length)
            rows["starts"].append((places - limits[one]).tolist())
        kinds = dict(zip(rows, (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()))))
        return record(rows, kinds)

    schema = "doc_id long, repeat string, n_words long, starts array<long>"
    return map_slices(docs.select("doc_id", "text"), work, schema)


def keep_quality(docs: DataFrame) -> DataFrame:
    """Documents that pass the rules, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kept = measures(part.column("text").to_pylist())["kept"]
            yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
