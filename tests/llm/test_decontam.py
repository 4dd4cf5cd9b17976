import random

import numpy as np
import pytest

from netbehave.llm import decontam
from netbehave.llm.shingles import mixed, shingle_hashes
from tests.llm.conftest import by_id

RNG = random.Random(3)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "té", "ra") for b in ("ba", "de", "fi", "go", "ñu")]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


ITEMS = [(at, text(RNG.choice([5, 7, 12, 16, 25, 40, 49, 60, 90, 150]))) for at in range(30)]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def best(items, item, words):
    """Best similarity of an item with any window of the verified lengths."""
    values, _ = shingle_hashes(words, np.array([0, len(words)]))
    length = len(items.words[item])
    return max(
        (
            items.similarity(item, values[at : at + size - 4])
            for at in range(len(values))
            for size in range(max(5, length - 2), length + 3)
            if at + size - 4 <= len(values)
        ),
        default=0,
    )


def test_fingerprint_of_every_window():
    words = np.random.default_rng(0).integers(0, 2**63, 60, dtype=np.uint64)
    sums = decontam.pair_sums(words)
    with np.errstate(over="ignore"):
        pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    for size in (5, 8, 22, 56):
        for at, found in enumerate(decontam.fingerprints(sums, size).tolist()):
            window = pairs[at : at + size - 1].tolist()
            want = sum(
                1 << bit for bit in range(64) if sum(p >> bit & 1 for p in window) > (size - 1) // 2
            )
            assert found == want


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    items = decontam.Items([0], [text(60)])
    ((size, (known, *_)),) = items.sizes.items()
    near = []
    for _ in range(300):
        flips = rng.choice(64, rng.integers(0, 6), replace=False)
        near.append(int(known[0]) ^ sum(1 << int(bit) for bit in flips))
    near = np.array(near, np.uint64)
    windows, pieces = decontam.candidates(items, size, near)
    found = set(zip(windows.tolist(), pieces.tolist()))
    want = {
        (a, b)
        for a in range(len(near))
        for b in range(len(known))
        if int(near[a] ^ known[b]).bit_count() <= decontam.RADIUS
    }
    assert found == want


def edited(words, n):
    words = list(words)
    for _ in range(n):
        place = RNG.choice([RNG.randrange(len(words)), RNG.randrange(min(3, len(words)))])
        words[place] = f"zz{RNG.random()}"
    return words


def test_equals_every_window(docs, benchmark):
    """Copies, copies in other case and signs, and copies with changed words."""
    rows = []
    for at in range(60):
        item = ITEMS[at % 30][1]
        words = edited(item.split(), RNG.choice([0, 0, 1, 1, 2]))
        if at % 3 == 0:
            words = [word.upper() + "!!" for word in words]
        start = text(RNG.randint(0, 30)).split()
        rows.append((at, " ".join(start + words + text(RNG.randint(0, 30)).split())))
    rows += [(at, text(80)) for at in range(60, 80)]
    items = decontam.Items(*zip(*ITEMS))
    found = by_id(decontam.contamination(docs(rows), benchmark))
    for doc_id, given in rows:
        words, _ = decontam.cleaned([given])
        want = [at for at in range(len(ITEMS)) if best(items, at, words) >= decontam.LEAST]
        assert found[doc_id]["items"] == want
        assert found[doc_id]["n_items"] == len(want) and found[doc_id]["contaminated"] == bool(want)
    assert sum(row["contaminated"] for row in found.values()) > 20
    kept = decontam.drop_leaks(docs(rows), benchmark).collect()
    assert {row["doc_id"] for row in kept} == {i for i, row in found.items() if not row["contaminated"]}


def test_benchmarks_in_several_blocks(docs, benchmark, monkeypatch):
    rows = [(at, f"start {ITEMS[at][1]} end") for at in range(30)]
    whole = decontam.leaks(docs(rows), benchmark).select("doc_id", "item_id")
    monkeypatch.setattr(decontam, "ITEMS_PER_BLOCK", 7)
    blocks = decontam.leaks(docs(rows), benchmark).select("doc_id", "item_id")
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.collect()))


def test_odd_rows(spark, odd, none, docs):
    items = [(1, None), (2, ""), (3, "one two three"), (4, ITEMS[9][1]), (4, ITEMS[9][1]), (None, ITEMS[9][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(odd, benchmark).collect()
    assert len(found) == odd.select("doc_id").distinct().count()
    assert not any(row["contaminated"] for row in found)
    assert sorted(decontam.drop_leaks(odd, benchmark).collect(), key=repr) == sorted(odd.collect(), key=repr)
    row = decontam.contamination(docs([f"x {ITEMS[9][1]} y"]), benchmark).first()
    assert row["items"] == [4] and row["contaminated"]
    assert decontam.contamination(none, benchmark).collect() == []
    assert decontam.contamination(docs(["a b c d e f"]), none.toDF("item_id", *none.columns[1:])).first()["items"] == []


@pytest.mark.parametrize(("length", "n"), [(45, 1), (100, 2), (150, 3), (200, 4), (300, 6), (400, 8), (500, 10)])
def test_evenly_spread_edits_leave_a_piece(length, n):
    """Long items are found up to as many changed words as leave a similarity of 0.8."""
    rng = random.Random(length)
    hits = 0
    for _ in range(25):
        item = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        items = decontam.Items([0], [" ".join(item)])
        changed = list(item)
        for at in range(n):
            changed[round((at + 0.5) * length / n)] = f"zz{rng.random()}"
        given = " ".join(["before"] * 7 + changed + ["behind"] * 5)
        words, _ = decontam.cleaned([given])
        want = best(items, 0, words) >= decontam.LEAST
        hits += want
        assert bool(decontam.matches(items, [given])) == want
    assert hits or n * 45 > length - 4


def test_cheap_shingles_do_not_hide_an_item():
    """Most words are shared with many items, so edits there cost next to nothing."""
    rng = random.Random(5)
    common = [f"c{n}" for n in range(90)]
    texts = [" ".join(common + [f"u{at}x{n}" for n in range(60)]) for at in range(40)]
    items = decontam.Items(list(range(40)), texts)
    words = texts[3].split()
    for at in range(4, 88, 6):
        words[at] = f"zz{rng.random()}"
    words = words[:145] + ["zz"] + words[146:]
    kept, _ = decontam.cleaned([" ".join(words)])
    assert (best(items, 3, kept) >= decontam.LEAST) == (3 in [match[1] for match in decontam.matches(items, [" ".join(words)])])


def breaking(pieces, size, length):
    """Least number of shingles that edits must break to leave no piece, edits being gaps."""
    shingles = [set(range(max(0, gap - 3), min(gap, length - 5) + 1)) for gap in range(length - 1)]
    gaps = [range(start, start + size - 1) for start in pieces]
    states = {frozenset(): 0}
    for one in gaps:
        after = {}
        for held, cost in states.items():
            for gap in one:
                kept = frozenset(s for s in held | shingles[gap] if s >= one[0])
                after[kept] = min(after.get(kept, length), cost + len(shingles[gap] - held))
        states = after
    return min(states.values())


@pytest.mark.parametrize("length", [44, 60, 100, 139, 150, 167, 300, 500])
def test_breaking_all_pieces_costs_too_much(length):
    weights = np.ones(length - 4)
    size, starts = decontam.piece_places(weights, 1.0)
    assert all(b - a >= size for a, b in zip(starts, starts[1:]))
    assert breaking(starts, size, length) > decontam.breakable(weights, 1.0)


def test_weights_do_not_depend_on_blocks(spark, docs, monkeypatch):
    """Items that share half of their words have the same similarities in one block and in many."""
    common = text(40)
    items = [(at, f"{common} {text(40)}") for at in range(12)] + [(12, "one two"), (13, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(at, " ".join(edited(items[at][1].split(), 2))) for at in range(12)]
    whole = sorted(map(tuple, decontam.leaks(docs(rows), benchmark).collect()))
    monkeypatch.setattr(decontam, "ITEMS_PER_BLOCK", 4)
    assert sorted(map(tuple, decontam.leaks(docs(rows), benchmark).collect())) == whole
    assert any(row[-1] < 1 for row in whole)
