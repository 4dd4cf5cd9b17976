import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from netbehave.llm import tokencount

TOKENS = tokencount.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
ENCODING = tiktoken.Encoding(
    "t", pat_str=PATTERN, mergeable_ranks={t: r for r, t in enumerate(TOKENS)}, special_tokens={}
)
TEXTS = ["a line\n\n\nthen another\n", "日本語 and 😀😀\nnaïve\n \n x", "", None, "one line of words", "\n\n\n\n"]


def plain_spans(text):
    """Character span of each token, by adding up its bytes."""
    spans, at = [], 0
    owner = [n for n, c in enumerate(text) for _ in c.encode()]
    for token in ENCODING.encode_ordinary(text):
        size = len(TOKENS[token])
        spans.append((owner[at], owner[at + size - 1] + 1))
        at += size
    return spans


def plain(text, sections, rule):
    counts = [[0, 0] for _ in range(len(sections) + 1)]
    for start, end in plain_spans(text or ""):
        shared = [max(0, min(end, b) - max(start, a)) for a, b in sections]
        touched = [n for n, size in enumerate(shared) if size]
        if rule == "most":
            chosen = max(touched, key=lambda n: (shared[n], -n), default=len(sections))
        else:
            chosen = next((n for n in touched if sections[n][0] <= start), len(sections))
        counts[chosen][0] += 1
        counts[chosen][1] += len(touched) > 1
    return counts


@pytest.mark.parametrize("rule", ["start", "most"])
def test_lines_equal_plain_counts(docs, rule):
    found = tokencount.section_counts(docs(TEXTS), TOKENS, PATTERN, rule=rule).collect()
    crossing = 0
    for at, text in enumerate(TEXTS):
        sections = tokencount.line_sections(text or "")
        rows = sorted((row for row in found if row["doc_id"] == at), key=lambda row: row["section"])
        assert [(row["start"], row["end"]) for row in rows] == sections
        want = plain(text, sections, rule)
        assert [[row["n_tokens"], row["n_crossing"]] for row in rows] == want[:-1]
        assert sum(row["n_tokens"] for row in rows) == len(ENCODING.encode_ordinary(text or ""))
        assert sum(row["n_bytes"] for row in rows) == len((text or "").encode())
        crossing += sum(row["n_crossing"] for row in rows)
    assert crossing


@pytest.mark.parametrize("rule", ["start", "most"])
def test_named_sections_with_gaps(spark, rule):
    text = "field one: value\nfield two: another value"
    spans = [(2, 8), (8, 8), (11, 20), (30, 33)]
    rows = [(1, text, [{"a": a, "b": b} for a, b in spans]), (2, text, []), (3, text, None)]
    schema = "doc_id long, text string, fields array<struct<a:long,b:long>>"
    frame = spark.createDataFrame(rows, schema)
    found = tokencount.section_counts(frame, TOKENS, PATTERN, "fields", rule).collect()
    want = plain(text, spans, rule)
    mine = {row["section"]: [row["n_tokens"], row["n_crossing"]] for row in found if row["doc_id"] == 1}
    assert [mine[n] for n in (*range(4), None)] == want
    for doc_id in (2, 3):
        (row,) = [row for row in found if row["doc_id"] == doc_id]
        assert row["section"] is None and row["n_tokens"] == len(ENCODING.encode_ordinary(text))


def test_overlapping_sections_are_refused():
    with pytest.raises(ValueError):
        tokencount.allocate(np.array([0]), np.array([1]), [(0, 5), (3, 8)], "start")


def test_odd_rows(odd, none):
    found = tokencount.section_counts(odd, TOKENS, PATTERN)
    total = {row["doc_id"]: row["n"] for row in found.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert total[1] == total[2] == 0 and total[4] > 30_000
    assert found.where("doc_id = 5").count() == 2
    assert tokencount.section_counts(none, TOKENS, PATTERN).collect() == []


@pytest.mark.parametrize("run", [" ", "\n", " \n", "\x1c", "\u2003", "\x85"])
def test_long_runs_of_blanks_equal_the_whole_encoding(run):
    """Beyond the limit from which parts are encoded, and under that of the encoder."""
    encode = tokencount.encoder(TOKENS, PATTERN)
    for text in (f"a{run * 70_000}b c", run * 70_000, f"it's{run * 70_000}\n", f"1 {run * 70_000}é"):
        assert encode(text) == ENCODING.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000 + "x", " \n" * 1_000_000])
def test_runs_beyond_the_encoder(docs, text):
    found = tokencount.section_counts(docs([text, "x"]), TOKENS, PATTERN, sections=lambda t: [(0, len(t))]).collect()
    assert sum(row["n_bytes"] for row in found if row["doc_id"] == 0) == len(text)
