import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from netbehave.llm import pieces
from tests.llm.conftest import by_id

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox  jumps\nover\n\n the lazy dog.",
    "naïve coöperation 日本語 😀 \x00 tab\there",
    "",
    " leading and trailing ",
    "▁sign▁of a blank",
    "x" * 300 + " " + "ab" * 100,
    "Thendation handly onblesh. Thti eronreng, ciónñas",
]


@pytest.fixture(scope="module")
def known(spark):
    return pieces.read_pieces(spark, PATH).cache()


def plain_encoder(known):
    """Best paths by a loop over the characters."""
    rows = known.collect()
    table = {row["piece"]: (row["id"], row["score"]) for row in rows if row["piece"] is not None}
    first = min(row["id"] for row in rows if row["piece"] is None)
    worst = min(score for _, score in table.values())
    longest = max(map(len, table))

    def encode(unit):
        best = [(0.0, 0, [])]
        for end in range(1, len(unit) + 1):
            found = None
            for start in range(max(0, end - longest), end):
                part = unit[start:end]
                if part in table:
                    ids, score = [table[part][0]], table[part][1]
                elif len(part) == 1:
                    raw = part.encode()
                    ids, score = [first + byte for byte in raw], len(raw) * (worst - 10.0)
                else:
                    continue
                total = best[start][0] + score
                if found is None or total > found[0]:
                    found = (total, start, ids)
            best.append(found)
        ids, at = [], len(unit)
        while at:
            ids, at = best[at][2] + ids, best[at][1]
        return ids, best[-1][0]

    return encode


@pytest.fixture(scope="module")
def plain(known):
    return plain_encoder(known)


@pytest.fixture(scope="module")
def cutter(known):
    return pieces.cutter_of(known)


def pieces_of(known, kept={}):
    if "all" not in kept:
        kept["all"] = {row["piece"] for row in known.where("piece IS NOT NULL").collect()}
    return kept["all"]


def spaced(text):
    return " " + (text or "").replace("▁", " ")


def test_units_join_to_the_text(cutter):
    for text in TEXTS:
        units = cutter.units(text)
        assert "".join(units) == spaced(text)
        assert all(" " not in unit.lstrip(" ") for unit in units)


def test_units_equal_plain_viterbi(spark, known, plain, cutter):
    """Units of one chunk and of several, among them one that ends at the edge of a chunk."""
    units = {unit for text in TEXTS for unit in cutter.units(text)}
    draw = random.Random(5)
    sizes = [pieces.CHUNK + n for n in (-1, 0, 1, 16, 17)] + [2 * pieces.CHUNK, 3 * pieces.CHUNK + 5, 2000]
    units |= {"".join(draw.choice(signs) for _ in range(n)) for n in sizes for signs in ("a", "ab", "etaoinsh 日", "日本😀é\0")}
    frame = spark.createDataFrame([(unit,) for unit in sorted(units)], "unit string")
    found = {row["unit"]: row for row in pieces.encoded_units(frame, known).collect()}
    assert set(found) == units
    for unit in units:
        ids, score = plain(unit)
        assert (found[unit]["ids"], found[unit]["score"]) == (ids, score)


def test_cuts_are_where_no_piece_lies(known, cutter):
    rows = [row["piece"] for row in known.where("piece IS NOT NULL").collect()]
    pairs = {piece[at : at + 2] for piece in rows for at in range(len(piece) - 1)}
    for piece in rows:
        assert cutter.starts(pieces.codes_of(piece)).tolist() == [True] + [False] * (len(piece) - 1)
    for text in MORE:
        units = cutter.units(text)
        assert "".join(units) == spaced(text)
        for left, right in zip(units, units[1:]):
            assert left[-1] + right[0] not in pairs


def test_units_of_a_slice_equal_those_of_each_text(cutter, monkeypatch):
    texts = [spaced(text) for text in MORE]
    for _ in range(2):
        found = pieces.units_of(texts, cutter)
        assert len(set(found.names)) == len(found.names)
        for at, text in enumerate(MORE):
            own = found.which[found.limits[at] : found.limits[at + 1]]
            assert [found.names[one] for one in own.tolist()] == cutter.units(text)
        # Once more with hashes that meet.
        original = np.unique
        monkeypatch.setattr(pieces.np, "unique", lambda h, **more: original(h % np.uint64(7), **more))


def test_settings_are_put_back(spark):
    name = next(iter(pieces.GROUPING))
    before = spark.conf.get(name, None)
    with pytest.raises(KeyError), pieces.settings(spark, pieces.GROUPING):
        raise KeyError
    assert spark.conf.get(name, None) == before


def test_decodes_ids_of_the_library(spark, known):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["The quick brown fox", "日本語 😀", "a\nb"]
    rows = spark.createDataFrame([(at, model.encode(t)) for at, t in enumerate(texts)], "doc_id long, ids array<int>")
    assert {row["doc_id"]: row["text"] for row in pieces.decoded(rows, known).collect()} == {
        at: " " + text for at, text in enumerate(texts)
    }


MORE = TEXTS + [
    "def f(x):\n    if x:\n        return  x\n" + " " * 20 + "end   ",
    "a\n b c     d\n   \n",
    "日本語の文章" * 60 + "  " + "0x7f," * 90,
    "the the the of of fox",
    None,
]


@pytest.mark.parametrize("common", [0, 12, 10_000])
def test_whole_documents_have_the_best_path(docs, known, plain, cutter, common):
    """Ids, text and sums are those of one lattice over the whole text, without any cut."""
    found = by_id(pieces.encoded(docs(MORE * 2), known, common=common))
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert len(found) == 2 * len(MORE)
    for at, text in enumerate(MORE * 2):
        row, (ids, score) = found[at], plain(spaced(text))
        assert row["ids"] == ids
        assert row["text"] == spaced(text) and row["round_trip"]
        # The library leaves out the blank in front.
        assert model.decode(row["ids"]) == spaced(text)[1:]
        assert (row["n_pieces"], row["n_units"]) == (len(ids), len(cutter.units(text)))
        assert row["n_unknown"] == sum(len(plain(c)[0]) > 1 or plain(c)[1] < -20 for c in row["text"] if c not in pieces_of(known))
        assert np.isclose(row["score"], score)
        assert row["checksum"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def long_count(known, text):
    """Pieces of the best path by a plain loop that keeps no paths."""
    rows = known.collect()
    table = {row["piece"]: row["score"] for row in rows if row["piece"] is not None}
    worst, longest = min(table.values()), max(map(len, table))
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        found = None
        for start in range(max(0, end - longest), end):
            part = text[start:end]
            if part in table:
                score, n = table[part], 1
            elif len(part) == 1:
                n = len(part.encode())
                score = n * (worst - 10.0)
            else:
                continue
            total = best[start][0] + score, best[start][1] + n
            if found is None or total[0] > found[0]:
                found = total
        best.append(found)
    return best[-1][1]


@pytest.mark.parametrize("sign", ["a", " ", "\n", "7", "日"])
def test_long_unbroken_texts(docs, known, sign):
    text = sign * 60_000
    row = pieces.encoded(docs([text, "x"]), known).where("doc_id = 0").first()
    assert row["text"] == " " + text and row["round_trip"]
    # A sign that no piece has twice has one for each.
    assert len(row["ids"]) == row["n_pieces"] == long_count(known, " " + text)


def test_runs_of_blanks_take_one_piece(docs, known):
    row = pieces.encoded(docs(["a\n    b"]), known).first()
    assert known.where("piece = repeat(' ', 4)").first()["id"] in row["ids"] or len(row["ids"]) <= 4


def test_whole_documents_of_odd_rows(odd, none, known):
    rows = pieces.encoded(odd, known).collect()
    assert len(rows) == odd.count() and all(row["round_trip"] for row in rows)
    assert pieces.encoded(none, known).collect() == []


def test_plans_are_not_written_out_with_the_scores(spark, known, monkeypatch):
    """A plan as the driver keeps it is short, while the literal of the scores is long."""
    lengths = []

    def seen(df, name):
        lengths.append(len(df._jdf.queryExecution().toString()))
        return stored(df, name)

    stored = pieces.stored
    monkeypatch.setattr(pieces, "stored", seen)
    before = spark.conf.get("spark.sql.maxPlanStringLength")
    pieces.unit_values(spark.createDataFrame([("ab", None)], "unit string, text string"), known).collect()
    assert max(lengths) < 100_000
    assert spark.conf.get("spark.sql.maxPlanStringLength") == before


def test_plans_hold_no_table_of_scores(spark, known):
    """A literal as long as the model is copied with every plan that the driver keeps."""
    units = spark.createDataFrame([("ab",)], "unit string")
    with pieces.settings(spark, {"spark.sql.maxPlanStringLength": str(1 << 30)}):
        found = pieces.encoded_units(units, known.select("*").coalesce(1))
        assert len(found._jdf.queryExecution().analyzed().toString()) < 100_000


def test_a_document_leaves_no_shuffled_units_and_no_dead_tables(spark, docs, known, tmp_path, monkeypatch):
    """Behind the whole documents lie their slices and the packed ids, nothing else."""
    monkeypatch.setattr(pieces, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr("netbehave.llm.words.shared_folder", lambda spark, name: f"file://{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    found = pieces.encoded(docs(MORE * 2), known, common=12)
    left = {str(path.relative_to(tmp_path)).split("/")[0] for path in tmp_path.rglob("*.parquet")}
    assert len(left) == 2 and any(name.startswith("unit-paths") for name in left)
    assert not list(tmp_path.rglob("whole=false/*.parquet"))
    # What is left is enough, more than once.
    assert found.count() == found.count() == 2 * len(MORE)


def test_slices_send_a_unit_once(spark, docs, known, monkeypatch):
    """Rows that travel are the distinct units of a slice, however often documents have them."""
    rows = []
    real = pieces.unit_values
    monkeypatch.setattr(pieces, "unit_values", lambda units, known: rows.append(units.count()) or real(units, known))
    found = by_id(pieces.encoded(docs(["zyx wvu"] * 50, partitions=1), known, common=0))
    assert all(row["text"] == " zyx wvu" and row["round_trip"] for row in found.values())
    assert rows[-1] == len(pieces.cutter_of(known).units("zyx wvu"))
