"""Tokens per section of a document, from one encoding of the whole document.

The text is encoded once. The byte lengths of the tokens give their character spans, and
an interval join by binary search gives the sections each token touches. A token that
touches several sections is allocated whole, by a rule:

* ``"start"``: to the section that holds its first character;
* ``"most"``: to the section that holds most of its characters, the first of equals.

A token span takes in every character of which it holds a byte, so a character split over
two tokens belongs to both spans. Sections must be disjoint and in ascending order; other
sections raise an error. Tokens outside every section are counted in a row with a null
section, so the counts of a document always add up to its tokens.

Results for odd rows: a null or empty text has one empty section without tokens. Repeated
rows give repeated results; an empty table gives no rows. Columns other than ``doc_id``
and ``text`` are read only if named as ``sections``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netbehave.llm.words import slices, utf8

Spans = list[tuple[int, int]]

# The encoder looks back over a run of blanks and overflows its stack at about a million.
LONG_RUN = re.compile(r"\s{65536}")

SCHEMA = (
    "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, n_bytes long"
)


def line_sections(text: str) -> Spans:
    """Lines with their line ends; together they are the whole text."""
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return list(zip(starts, [*starts[1:], len(text)]))


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id of a rank file."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def encoder(tokens: list[bytes], pattern: str) -> Callable[[str], list[int]]:
    """Ids of a whole text.

    Texts with a very long run of blanks are split by the same pattern in another engine,
    and each part is encoded by itself, which is what an encoding of the whole does.
    """
    import tiktoken

    ranks = {token: rank for rank, token in enumerate(tokens)}

    def encoding(split: str) -> tiktoken.Encoding:
        return tiktoken.Encoding("given", pat_str=split, mergeable_ranks=ranks, special_tokens={})

    whole = encoding(pattern)

    @cache
    def by_parts() -> tuple[re.Pattern, tiktoken.Encoding]:
        import regex

        # The two engines differ in what a blank is unless it is named.
        named = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        return regex.compile(named), encoding("(?s).+")

    def encode(text: str) -> list[int]:
        if not LONG_RUN.search(text):
            return whole.encode_ordinary(text)
        split, single = by_parts()
        return [one for part in split.finditer(text) for one in single.encode_ordinary(part.group())]

    return encode


def token_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens that have these numbers of bytes."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.frombuffer(utf8(text), np.uint8)
    if len(raw) == len(text):
        return starts, ends
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def allocate(
    starts: np.ndarray, ends: np.ndarray, sections: Spans, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, -1 for none, and whether it touches several."""
    low = np.array([one[0] for one in sections], np.int64)
    high = np.array([one[1] for one in sections], np.int64)
    if np.any(low > high) or np.any(low[1:] < high[:-1]):
        raise ValueError("sections must be disjoint and in ascending order")
    # Empty sections hold no character, so no token can touch one.
    real = np.flatnonzero(low < high)
    if not len(real):
        return np.full(len(starts), -1), np.zeros(len(starts), bool)
    low, high = low[real], high[real]
    first = np.searchsorted(high, starts, "right")
    last = np.searchsorted(low, ends, "left") - 1
    crossing = last > first
    touched = last >= first
    if rule == "start":
        # The first character may lie before the first section that the token touches.
        inside = touched & (low[np.minimum(first, len(low) - 1)] <= starts)
        chosen = np.where(inside, first, -1)
    elif rule == "most":
        chosen = np.where(touched, first, -1)
        for at in np.flatnonzero(crossing).tolist():
            over = np.arange(first[at], last[at] + 1)
            shared = np.minimum(high[over], ends[at]) - np.maximum(low[over], starts[at])
            chosen[at] = over[np.argmax(shared)]
    else:
        raise ValueError(f"no such rule: {rule}")
    return np.where(chosen >= 0, real[np.maximum(chosen, 0)], -1), crossing


def section_counts(
    docs: DataFrame,
    tokens: list[bytes],
    pattern: str,
    sections: Callable[[str], Spans] | str = line_sections,
    rule: str = "start",
) -> DataFrame:
    """One row per section: its span, tokens, those of them that cross a boundary, and bytes.

    ``tokens`` are the byte strings of a byte-level vocabulary by rank and ``pattern`` its
    splitting pattern. ``sections`` gives the spans of a text, or names a column of
    ``docs`` that holds them as an array of structs (start, end).
    """
    named = [sections] if isinstance(sections, str) else []
    carried = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(carried.value, pattern)
        sizes = np.array([len(token) for token in carried.value], np.int64)
        for part in slices(batches):
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            texts = part.column("text").to_pylist()
            given = part.column(named[0]).to_pylist() if named else [None] * len(texts)
            for at, (text, spans) in enumerate(zip(texts, given)):
                text = text or ""
                if named:
                    spans = [tuple(one.values()) for one in spans or []]
                else:
                    spans = sections(text)
                size = sizes[np.array(encode(text), np.int64)]
                section, crossing = allocate(*token_spans(text, size), spans, rule)
                n = len(spans)
                # One more place, for the tokens outside every section, comes last.
                place = np.where(section < 0, n, section)
                counts = np.bincount(place, minlength=n + 1)
                shown = n + (counts[n] > 0)
                low, high = zip(*spans) if spans else ((), ())
                rows = (
                    np.full(shown, at),
                    np.arange(shown),
                    np.array([*low, 0][:shown]),
                    np.array([*high, 0][:shown]),
                    counts[:shown],
                    np.bincount(place, crossing, n + 1)[:shown].astype(np.int64),
                    np.bincount(place, size, n + 1)[:shown].astype(np.int64),
                )
                rows[1][n:] = -1
                for column, values in zip(columns, rows):
                    column.append(values)
            place, section, low, high, *counted = map(np.concatenate, columns)
            outside = section < 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(place)),
                    pa.array(section.astype(np.int32), mask=outside),
                    pa.array(low.astype(np.int64), mask=outside),
                    pa.array(high.astype(np.int64), mask=outside),
                    *(pa.array(one.astype(np.int64)) for one in counted),
                ],
                names=[field.split()[0] for field in SCHEMA.split(", ")],
            )

    return docs.select("doc_id", "text", *named).mapInArrow(run, SCHEMA)
