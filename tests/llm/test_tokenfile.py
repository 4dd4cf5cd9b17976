import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard

from netbehave.llm import tokenfile
from netbehave.llm.words import shared_folder


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def whole(tokenizer, text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_str(tokenizer).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, tokenfile.END_ID], "<u4").tobytes()


TEXTS = [
    "Hello, World! it's 12 o'clock ~ and ~tilde~",
    "ΑΣ ΣΑΣ. ́x é é İI",
    "<|endoftext|> x<|startoftext|>y",
    "no break   日本 語、\n\n\t😀😀 👩‍👩",
    "",
    None,
    "\x1c a\x1db\x85c ﻿" + "long" * 500,
]


def test_word_by_word_equals_whole(tokenizer):
    found = tokenfile.WordEncoder(tokenizer).encode(TEXTS, tokenfile.END_ID)
    assert found == [whole(tokenizer, text) for text in TEXTS]


def test_cache_keeps_words_in_use(tokenizer, monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHED_WORDS", 5)
    encoder = tokenfile.WordEncoder(tokenizer)
    for _ in range(3):
        for text in TEXTS:
            assert encoder.encode([text], 2) == [whole(tokenizer, text)]


def test_round_trip(spark, docs, tokenizer):
    rows = [(at * 7 % 50, f"word{at} " * at) for at in range(50)]
    folder = shared_folder(spark, "test")
    tokenfile.write_token_files(docs(rows), folder, tokenizer, frame_tokens=64)
    found = tokenfile.read_token_files(spark, folder).orderBy("file", "start_in_file").collect()
    assert [row["doc_id"] for row in found] == sorted(doc_id for doc_id, _ in rows)
    assert {row["doc_id"]: bytes(row["ids"]) for row in found} == {
        doc_id: whole(tokenizer, text) for doc_id, text in rows
    }
    chosen = tokenfile.read_token_files(spark, folder, wanted=[3, 40, 999]).collect()
    assert sorted(row["doc_id"] for row in chosen) == [3, 40]


def test_digests(docs, spark, tokenizer):
    rows = [(at, f"some words {at} " * (at % 9)) for at in range(40)]
    found = tokenfile.token_digests(docs(rows), shared_folder(spark, "test"), tokenizer)
    start = 0
    for row, (doc_id, text) in zip(found.orderBy("doc_id").collect(), rows, strict=True):
        ids = whole(tokenizer, text)
        assert tuple(row) == (doc_id, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def written(documents, frame_tokens=8):
    out = io.BytesIO()
    writer = tokenfile.FrameWriter(out, frame_tokens)
    for doc_id, ids in documents:
        writer.add(doc_id, np.array(ids, "<u4").tobytes())
    writer.close()
    return out.getvalue()


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_frames_are_plain_zstandard():
    documents = [(at, list(range(at))) for at in range(12)]
    raw = written(documents)
    reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    plain = np.frombuffer(reader.read(), "<u4").tolist()
    assert plain == [token for _, ids in documents for token in ids]


def test_only_needed_frames_are_read():
    raw = written([(at, [at] * 8) for at in range(20)])
    reader = tokenfile.FrameReader(File(raw))
    asked = []
    frame = reader.frame
    reader.frame = lambda number: asked.append(number) or frame(number)
    assert [entry["doc_id"] for entry, _, _ in reader.documents(np.array([4, 17]))] == [4, 17]
    assert asked == [4, 17]


def test_damage_is_noticed():
    raw = bytearray(written([(0, list(range(100)))], frame_tokens=1000))
    good = tokenfile.FrameReader(File(bytes(raw)))
    packed = zstandard.ZstdCompressor(write_checksum=False).compress(np.arange(1, 101, dtype="<u4").tobytes())
    reader = tokenfile.FrameReader(File(bytes(raw)))
    reader.read = lambda start, size: packed
    with pytest.raises(ValueError):
        reader.frame(0)
    assert len(good.frame(0)) == 400


def test_odd_rows(spark, odd, none, tokenizer):
    folder = shared_folder(spark, "test")
    found = tokenfile.token_digests(odd, folder, tokenizer).collect()
    assert len(found) == odd.count()
    ends = {row["doc_id"]: row["n_tokens"] for row in found}
    assert ends[1] == ends[2] == ends[3] == 1
    first = min(found, key=lambda row: row["start"])
    assert first["doc_id"] is None
    assert tokenfile.token_digests(none, shared_folder(spark, "test"), tokenizer).collect() == []


@pytest.mark.parametrize("n", [0, 1, 499, 500, 501, 1200])
def test_words_learned_together_equal_words_alone(tokenizer, n):
    words = [f"w{at}~{at}" if at % 7 == 3 else f"Wört-{at}" for at in range(n)] + ["~", "a~b"][: n % 2 * 2]
    raw = [word.encode("utf-8", "surrogatepass") for word in words]
    encoder, alone = tokenfile.WordEncoder(tokenizer), tokenfile.WordEncoder(tokenizer)
    assert encoder.encode_words(raw) == [alone.ids_of(word).tobytes() for word in words]
