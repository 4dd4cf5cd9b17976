import hashlib
import math
import random

import numpy as np
import pytest

from netbehave.llm import orchard

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, rounds=2, size=64):
    """Codes, errors and codebooks of (vec_id, vector), all distances worked out."""
    whole = [(vec_id, [math.floor(256 * x) for x in vector]) for vec_id, vector in rows]
    step = len(whole[0][1]) // 16
    cut = [(vec_id, [v[p * step : (p + 1) * step] for p in range(16)]) for vec_id, v in whole]
    first = {}
    for vec_id, parts in sorted(cut):
        first.setdefault(vec_id, parts)
    books = [[list(parts[p]) for parts in list(first.values())[:size]] for p in range(16)]

    def assign():
        out = []
        for _, parts in cut:
            out.append([])
            for p in range(16):
                distances = [sum((a - b) ** 2 for a, b in zip(parts[p], entry)) for entry in books[p]]
                out[-1].append((distances.index(min(distances)), min(distances)))
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(16):
            for entry in range(len(books[p])):
                own = [parts[p] for (_, parts), codes in zip(cut, found) if codes[p][0] == entry]
                if own:
                    books[p][entry] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    codes = ["".join(f"{e:02x}" for e, _ in row) for row in found]
    text = ",".join(str(v) for part in books for entry in part for v in entry)
    return codes, [sum(d for _, d in row) for row in found], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("size", "width", "spread"), [(1, 4, 50), (2, 1, 3), (64, 4, 300), (64, 2, 4), (40, 3, 1)])
def test_search_finds_the_nearest_with_the_lowest_index(size, width, spread):
    draw = np.random.default_rng(size * width)
    entries = draw.integers(-spread, spread + 1, (size, width))
    vectors = draw.integers(-2 * spread, 2 * spread + 1, (3000, width))
    best, error = orchard.search(orchard.Codebook.of(entries), vectors)
    distances = ((vectors[:, None, :] - entries[None]) ** 2).sum(-1)
    assert (best == distances.argmin(1)).all() and (error == distances.min(1)).all()


def test_search_visits_few_entries(monkeypatch):
    """The bound of twice the distance spares most distances."""
    draw = np.random.default_rng(1)
    entries, vectors = draw.normal(0, 1000, (64, 4)).astype(int), draw.normal(0, 1000, (5000, 4)).astype(int)
    book = orchard.Codebook.of(entries)
    worked = []
    original = orchard.squared
    monkeypatch.setattr(orchard, "squared", lambda d: worked.append(len(d)) or original(d))
    orchard.search(book, vectors)
    assert sum(worked) < 0.6 * 64 * len(vectors)


@pytest.mark.parametrize("n", [5, 300])
def test_whole_tables_equal_all_distances(spark, n):
    draw = random.Random(n)
    rows = [(at * 3, [draw.gauss(0, 0.2) for _ in range(32)], draw.choice([None, 1, 2])) for at in range(n)]
    rows += [(at * 3, [0.0] * 32, 7) for at in range(0, n, 4)]  # a second vector of the same number
    rows = [(i, np.array(v, np.float32).tolist(), label) for i, v, label in rows]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    codes, errors, digest = plain([row[:2] for row in rows])
    sums = {}
    for row, error in zip(rows, errors):
        sums[row[2]] = sums.get(row[2], 0) + error
    expected = sorted((row[0], code, error, sums[row[2]], digest) for row, code, error in zip(rows, codes, errors))
    assert sorted(map(tuple, orchard.coded(df).collect())) == expected


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    fine = [0.5] * 16
    rows = [
        (1, None, 1, "a", 1),
        (2, [0.5] * 15 + [None], 1, "a", 2),
        (3, [0.5] * 15 + [nan], 1, "a", 3),
        (4, [0.5] * 15 + [-inf], 1, "a", 4),
        (5, fine, None, "a", 5),
        (5, fine, None, "a", 5),
        (6, [0.5] * 17, None, "a", 6),
        (7, [], 2, "a", 7),
        (None, [0.25] * 16, 2, "a", 8),
    ]
    df = spark.createDataFrame(rows, VECTORS + ", code string, error int")
    found = sorted(((row["vec_id"], row["code"], row["error"], row["label_error"]) for row in orchard.coded(df).collect()), key=repr)
    zero = "00" * 16
    # The only entry moves to floor((128 + 128 + 64) / 3) = 106.
    near, far = 16 * 22**2, 16 * 42**2
    assert found == [
        (5, zero, near, 2 * near), (5, zero, near, 2 * near), (6, None, None, 2 * near),
        (7, None, None, far), (None, zero, far, far),
    ]
    assert orchard.coded(df.limit(0)).collect() == []
    assert orchard.coded(df.where("vec_id = 6")).collect()[0]["code"] is None


def test_huge_components_are_exact(spark):
    draw = random.Random(2)
    rows = [(at, [draw.choice([1e6, 3e9, 1.0, -2e9, 3e38]) * draw.random() for _ in range(16)], 1) for at in range(70)]
    rows = [(i, np.array(v, np.float32).tolist(), label) for i, v, label in rows]
    codes, errors, digest = plain([row[:2] for row in rows])
    found = sorted(orchard.coded(spark.createDataFrame(rows, VECTORS)).collect())
    assert [row["code"] for row in found] == codes
    assert [row["error"] for row in found] == [error if error < 1 << 63 else None for error in errors]
    assert {row["codebooks_sha256"] for row in found} == {digest}
