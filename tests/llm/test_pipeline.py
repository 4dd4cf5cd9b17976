"""The pipeline against plain versions of its stages, on the smallest tables."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers

import corpus_pipeline
from netbehave.llm import decontam, pieces, queries, secretscan
from tests.llm.test_decontam import best
from tests.llm.test_neardup import plain as plain_groups
from tests.llm.test_pieces import plain_encoder

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def expected(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS FROM read_parquet('{SF_DIR}/documents.parquet')")
    good = {row[0] for row in duck.execute(f"SELECT doc_id FROM ({queries.OP1_SQL}) WHERE kept").fetchall()}
    rows = [row for row in duck.execute("SELECT doc_id, text FROM documents").fetchall() if row[0] in good]
    rows = [row for row, group in zip(rows, plain_groups(rows, percent=80)) if row[0] == group[2]]

    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    items = decontam.Items([r["item_id"] for r in benchmark], [r["text"] for r in benchmark])
    clean = []
    for doc_id, text in rows:
        words, _ = decontam.cleaned([text])
        present = set(words.tolist())
        near = [
            at for at, item in enumerate(items.words) if np.isin(item, list(present)).mean() > 0.7
        ]
        if not any(best(items, at, words) >= decontam.LEAST for at in near):
            clean.append((doc_id, text))

    frame = spark.createDataFrame(clean, "doc_id long, text string")
    model = secretscan.fit(frame)
    tagger = secretscan.Tagger(model) if model else None
    known = pieces.read_pieces(spark, public_tokenizers.path("piece_bpe_32k.model")).cache()
    encode, cutter = plain_encoder(known), pieces.cutter_of(known)
    found = {}
    for doc_id, text in clean:
        ((_, spans),) = secretscan.all_spans([text], tagger)
        masked = secretscan.masked(text, spans)
        ids = encode(" " + masked.replace("▁", " "))[0]
        found[doc_id] = (len(cutter.units(masked)), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    return found


def test_run_equals_plain_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {row["doc_id"]: (row["n_units"], row["n_pieces"], row["checksum"]) for row in rows} == expected(spark)
    assert all(row["round_trip"] for row in rows)


def test_stages_keep_columns_and_take_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.columns == odd.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
        assert last.count() == docs.count()


def test_secrets_are_masked(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    redacted = corpus_pipeline.secret_scan(spark, docs, SF_DIR)
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    for row in redacted.collect():
        assert not secretscan.rule_spans(row["text"])
        assert row["n_chars"] == len(row["text"])


def test_near_duplicates_from_four_fifths(spark):
    """Sets of 100 shingles of which 90 are shared have a similarity of 90 / 110."""
    words = [f"w{n}" for n in range(104)]
    ends = [f"x{n}" for n in range(10)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:94] + ends)), (3, " ".join(words[:91] + ends + ["y", "z", "v"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs.where("doc_id < 3"), SF_DIR).collect()
    assert [row["doc_id"] for row in kept] == [1]
    kept = corpus_pipeline.near_duplicates(spark, docs.where("doc_id <> 2"), SF_DIR).collect()
    assert sorted(row["doc_id"] for row in kept) == [1, 3]
