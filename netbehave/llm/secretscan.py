"""Secret scan: pattern rules, and a conditional random field for what they miss.

The field tags words as begin, inside or outside of a secret. Its features are the shape
of a word and of the words before and after it, and features of the whole file (how much
of it is digits, assignments and symbols). It is fitted on a bounded sample of windows:
around secrets that the rules find, around other words with digits, and anywhere. The
rules label those windows, so the field learns the shapes and surroundings of secrets,
and finds such words also where no pattern fits. Viterbi decoding is exact: words that are
outside on every best path are found first, and the rest is decoded between them.

All spans of the rules stay. A span of the field counts if any of it lies outside of them: a
rule stops at the first sign that it does not know, and the secret may go on behind it.

Results for odd rows: a null or empty text has no spans. If the rules find nothing in the
whole table there is nothing to learn from, and only the rules apply. Repeated rows give
equal results. Columns other than ``doc_id`` and ``text`` are not read by ``find_secrets``;
``redact_secrets`` hands them through under whatever names they have.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netbehave.llm import crf
from netbehave.llm.words import bounds, map_slices, slices, stored, utf8

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYS = (b"passw", b"secret", b"token", b"api")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

OUTSIDE, BEGIN, INSIDE = range(3)
SAMPLE_WINDOWS = 9000  # bound of the labelled sample that the field is fitted on
WINDOW = 10  # words on either side
FAVOUR = {"secret": 0.02, "digits": 0.1, "any": 1.0}  # small values come first in the sample
ANY_EVERY = 16  # one document in so many gives a window anywhere

Span = tuple[int, int, str]


def rule_spans(text: str | None) -> list[Span]:
    """Spans (start, end, kind) of the pattern rules, by start, then kind as listed."""
    if not text:
        return []
    found: list[Span] = []
    low = utf8(text).lower()
    if any(key in low for key in KEYS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda span: (span[0], KINDS.index(span[2]), span[1]))


def told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# ---------------------------------------------------------------- features

LENGTHS = (4, 8, 12, 16, 24, 32, 48)
KEY_WORDS = re.compile(
    rb"passw|passwd|secret|token|api[_-]?key|pwd|credential|bearer|private|auth|access[_-]?key", re.I
)
GROUPS = (8, 5, 5, 5, 3, 5, 4, 3, 3)  # number of values of each feature of a word
STARTS = np.concatenate([[0], np.cumsum(GROUPS)[:-1]])
N_WORD = int(sum(GROUPS))
FILE_GROUPS = (4, 3, 3)
FILE_STARTS = np.concatenate([[0], np.cumsum(FILE_GROUPS)[:-1]])
N_FILE = int(sum(FILE_GROUPS))
NO_WORD = "-"  # type of the place before the first word and after the last

Shape = tuple[int, ...]
DIGITS, LOWER, UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = bytes(
    100 if c in DIGITS else 97 if c in LOWER else 65 if c in UPPER else 46 for c in range(256)
)


def level(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= edge for edge in edges)


def letter_case(core: bytes, lower: int, upper: int) -> int:
    if not lower + upper:
        return 0
    if not upper:
        return 1
    if not lower:
        return 2
    return 3 if upper == 1 and core[:1].isupper() else 4


def shape(word: bytes) -> Shape:
    """Value of each feature of a word."""
    core = word.strip(b"\"'`.,;:!?()[]{}<>*#$%&|=")
    size = max(1, len(core))
    classes = core.translate(CLASSES)
    digits, lower, upper = classes.count(b"d"), classes.count(b"a"), classes.count(b"A")
    changes = sum(a != b for a, b in zip(classes, classes[1:])) if digits else 0
    hexadecimal = digits > 0 and not core.strip(b"0123456789abcdef")
    sign = (
        1 if word in (b"=", b":", b":=", b"=>") else
        2 if word.endswith((b"=", b":")) else
        3 if b"=" in word[1:] else
        4 if word[:1] in (b'"', b"'") else 0
    )
    key = KEY_WORDS.search(word)
    return (
        level(len(core), LENGTHS),
        level(digits / size, (0.001, 0.3, 0.7, 1)),
        level(changes, (1, 3, 6, 10)),
        letter_case(core, lower, upper),
        0 if not hexadecimal else 1 if size < 16 else 2,
        sign,
        level(len(set(core)) / size, (0.25, 0.5, 0.75)) if size > 3 else 0,
        0 if not key else 1 if key[0] != core else 2,
        level(classes.count(b".") / size, (0.001, 0.2)),
    )


def word_features(kind: Shape | str) -> list[int]:
    return [] if kind == NO_WORD else (STARTS + np.array(kind)).tolist()


def file_shape(raw: bytes, n_words: int) -> Shape:
    classes = raw.translate(CLASSES)
    size = max(1, len(raw))
    return (
        level(classes.count(b"d") / size, (0.001, 0.02, 0.1)),
        level(raw.count(b"=") / max(1, n_words), (0.0001, 0.02)),
        level(raw.count(b'"') / max(1, n_words), (0.0001, 0.02)),
    )


def file_features(kind: Shape) -> list[int]:
    return (FILE_STARTS + np.array(kind)).tolist()


# ---------------------------------------------------------------- fitting


def place_hash(*place: object) -> float:
    return zlib.crc32("/".join(map(str, place)).encode()) / 2**32


def sample_windows(doc_id: int | None, text: str) -> Iterator[tuple[str, float, str]]:
    """Labelled windows of one text: why, the number each is drawn by, and the window."""
    spans = rule_spans(text)
    anywhere = zlib.crc32(str(doc_id).encode()) % ANY_EVERY == 0
    if not spans and not anywhere and not re.search("[0-9]", text):
        return
    places = [match.span() for match in WORD.finditer(text)]
    if not places:
        return
    starts, ends = (np.array(column) for column in zip(*places))
    labels = np.zeros(len(places), np.int64)
    for start, end, _ in spans:
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end, "left")
        fresh = labels[first] == OUTSIDE
        labels[first:last] = np.where(labels[first:last] == BEGIN, BEGIN, INSIDE)
        if fresh:
            labels[first] = BEGIN
    words = [utf8(text[a:b]) for a, b in places]
    chosen = {at: "secret" for at in np.flatnonzero(labels == BEGIN).tolist()}
    for at, word in enumerate(words):
        if labels[at] == OUTSIDE and any(c in DIGITS for c in word):
            chosen.setdefault(at, "digits")
    if anywhere:
        chosen.setdefault(int(place_hash("any", doc_id) * len(words)), "any")
    raw = utf8(text)
    described = file_shape(raw, len(words))
    for at, reason in chosen.items():
        low, high = max(0, at - WINDOW), min(len(words), at + WINDOW + 1)
        around = [
            shape(words[i]) if 0 <= i < len(words) else NO_WORD for i in range(low - 1, high + 1)
        ]
        told_ = json.dumps([around, labels[low:high].tolist(), described])
        yield reason, FAVOUR[reason] * place_hash(reason, doc_id, at), told_


def draw_limit(sizes: dict[str, int], limit: int) -> float:
    """Number below which about twice ``limit`` windows are drawn, or all there are.

    Draws of a reason are spread evenly from 0 to its favour, so only about as many rows
    as are wanted leave the tasks, however large the table.
    """
    low, high = 0.0, max(FAVOUR.values())
    for _ in range(60):
        middle = (low + high) / 2
        drawn = sum(n * min(1.0, middle / FAVOUR[reason]) for reason, n in sizes.items())
        low, high = (middle, high) if drawn < 2 * limit + 100 else (low, middle)
    return high + 1e-9


def fit(docs: DataFrame, limit: int = SAMPLE_WINDOWS) -> crf.Model | None:
    """Field fitted on at most ``limit`` windows; None if they hold no secret."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            row
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
            if text
            for row in sample_windows(doc_id, text)
        ]
        kinds = (pa.string(), pa.float64(), pa.string())
        columns = zip(*rows) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["reason", "draw", "window"]
        )

    schema = "reason string, draw double, window string"
    drawn = stored(map_slices(docs.select("doc_id", "text"), work, schema), "windows")
    sizes = {row["reason"]: row["count"] for row in drawn.groupBy("reason").count().collect()}
    near = drawn.where(F.col("draw") < draw_limit(sizes, limit)).orderBy("draw", "window")
    found = [json.loads(row["window"]) for row in near.limit(limit).collect()]
    if not any(BEGIN in labels for _, labels, _ in found):
        return None
    time = 2 * WINDOW + 1
    n = len(found)
    there = np.zeros((n, time), bool)
    labels = np.zeros((n, time), np.int64)
    views = np.zeros((4, n, time), np.int64)
    kinds: dict[object, int] = {}
    files: dict[object, int] = {}
    for row, (around, tags, described) in enumerate(found):
        size = len(tags)
        numbers = [
            kinds.setdefault(one if one == NO_WORD else tuple(one), len(kinds)) for one in around
        ]
        there[row, :size], labels[row, :size] = True, tags
        for view, shift in enumerate((1, 0, 2)):  # the word, the one before, the one after
            views[view, row, :size] = numbers[shift : shift + size]
        views[3, row, :size] = files.setdefault(tuple(described), len(files))
    of_words = crf.Features.of([word_features(kind) for kind in kinds], N_WORD)
    of_files = crf.Features.of([file_features(kind) for kind in files], N_FILE)
    return crf.train(list(views), [of_words] * 3 + [of_files], labels, there, 3)


# ---------------------------------------------------------------- scanning


class Tagger:
    """Scores of the words of texts, with one row per shape met."""

    def __init__(self, model: crf.Model):
        self.model = model
        self.rows: dict[Shape | str, int] = {}
        self.words: dict[bytes, int] = {}
        self.table = np.zeros((3, 0, 3))
        self.row(NO_WORD)

    def row(self, kind: Shape | str) -> int:
        if kind not in self.rows:
            self.rows[kind] = len(self.rows)
            features = word_features(kind)
            scores = [weights[features].sum(0) for weights in self.model.weights[:3]]
            self.table = np.concatenate([self.table, np.array(scores)[:, None]], axis=1)
        return self.rows[kind]

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """Character spans of the secrets tagged in each text."""
        raw = [utf8(text) if text else b"" for text in texts]
        words = [one.split() for one in raw]
        limits = bounds([len(one) for one in words])
        if len(self.words) > 400_000:
            self.words.clear()
        for word in {word for one in words for word in one}:
            if word not in self.words:
                self.words[word] = self.row(shape(word))
        get = self.words.__getitem__
        rows = np.fromiter((get(w) for one in words for w in one), np.int64, limits[-1])
        before, after = np.roll(rows, 1), np.roll(rows, -1)
        real = np.flatnonzero(np.diff(limits))
        before[limits[real]] = 0
        after[limits[real + 1] - 1] = 0
        files = [
            self.model.weights[3][file_features(file_shape(one, len(w)))].sum(0)
            for one, w in zip(raw, words)
        ]
        scores = self.table[0][rows] + self.table[1][before] + self.table[2][after]
        scores += np.repeat(np.array(files).reshape(-1, 3), np.diff(limits), axis=0)
        tags = crf.decode(scores, self.model.transitions, limits, OUTSIDE)
        result: list[list[tuple[int, int]]] = [[] for _ in texts]
        owners = np.searchsorted(limits, np.flatnonzero(tags), "right") - 1
        for at in np.unique(owners).tolist():
            places = [match.span() for match in WORD.finditer(texts[at])]
            open_ = False
            for tag, (start, end) in zip(tags[limits[at] : limits[at + 1]].tolist(), places, strict=True):
                if tag == INSIDE and open_:
                    result[at][-1] = (result[at][-1][0], end)
                elif tag != OUTSIDE:
                    result[at].append((start, end))
                open_ = tag != OUTSIDE
        return result


def joined(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans, in order of their starts, cover."""
    starts: list[int] = []
    ends: list[int] = []
    for low, high, _ in spans:
        if ends and low <= ends[-1]:
            ends[-1] = max(ends[-1], high)
        else:
            starts.append(low)
            ends.append(high)
    return starts, ends


def covered(start: int, end: int, stretches: tuple[list[int], list[int]]) -> bool:
    """Whether one of the stretches covers all of a span."""
    at = bisect_right(stretches[0], start) - 1
    return at >= 0 and end <= stretches[1][at]


def all_spans(texts: list[str | None], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """Spans of the rules, and all spans, of each text."""
    tagged = tagger.spans(texts) if tagger else [[]] * len(texts)
    result = []
    for text, more in zip(texts, tagged):
        base = rule_spans(text)
        stretches = joined(base)
        free = [(start, end, "crf") for start, end in more if not covered(start, end, stretches)]
        result.append((base, in_order(base + free)))
    return result


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_crf long"
)


def find_secrets(docs: DataFrame, model: crf.Model | None) -> DataFrame:
    """Number of spans of each kind, digest of the spans of the rules, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model) if model else None
        for part in slices(batches):
            found = all_spans(part.column("text").to_pylist(), tagger)
            counts = {
                kind: pa.array([sum(s[2] == kind for s in spans) for _, spans in found], pa.int64())
                for kind in KINDS
            }
            digests = [hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    *(counts[kind] for kind in KINDS[:3]),
                    pa.array(digests, pa.string()),
                    pa.array([told(spans) for _, spans in found], pa.string()),
                    counts["crf"],
                ],
                names=[field.split()[0] for field in SCHEMA.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


MASK = "[secret]"


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with one mask in place of each run of overlapping spans."""
    pieces, at = [], 0
    for start, end, _ in spans:
        if start >= at or not pieces:
            pieces += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def redact_secrets(docs: DataFrame, model: crf.Model | None) -> DataFrame:
    """All documents with their columns, secrets in the text masked and lengths set anew."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model) if model else None
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            found = all_spans(texts, tagger)
            new = [masked(text, spans) if spans else text for text, (_, spans) in zip(texts, found)]
            at = names.index("text")
            yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    changed = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed
