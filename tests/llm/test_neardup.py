import random
from collections import defaultdict

import numpy as np
import pytest

from netbehave.llm import graph, neardup
from tests.llm.conftest import by_id


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[at : at + 5]) for at in range(len(words) - 4))


def plain(rows, percent=85):
    """Component of every row by comparing all pairs."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(at):
        while parent[at] != at:
            at = parent[at]
        return at

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for at, (doc_id, _) in enumerate(rows):
        least[root(at)].append(doc_id)
    return [(doc_id, len(sets[at]), min(least[root(at)])) for at, (doc_id, _) in enumerate(rows)]


def near_copies(seed, n_groups=6, size=14):
    """Texts with words changed here and there, so that similarities lie around the threshold."""
    rng = random.Random(seed)
    rows = []
    for group in range(n_groups):
        base = [f"g{group}w{rng.randint(0, 400)}" for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
            rows.append(" ".join(words))
    rows += ["a b", "A  b", "a b c d e", "a b c d e f", "", None, "one"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("chunk", [512, 3])
def test_components_equal_all_pairs(docs, monkeypatch, chunk):
    """With small chunks the second round has to find links across chunks."""
    monkeypatch.setattr(neardup, "CHUNK_MEMBERS", chunk)
    rows = near_copies(5)
    found = neardup.near_duplicates(docs(rows)).collect()
    assert sorted(tuple(row)[:3] for row in found) == sorted(plain(rows))
    assert all(row["kept"] == (row["doc_id"] == row["component_id"]) for row in found)


def test_estimate_is_corrected():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.9):
        common = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        sets = [
            np.unique(np.concatenate([common, rng.integers(0, 2**63, 2000 - len(common), dtype=np.uint64)]))
            for _ in range(2)
        ]
        limits = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        bits = neardup.packed(neardup.minima(np.concatenate(sets), limits))
        real = share / (2 - share)
        assert abs(neardup.estimates(bits[:1], bits[1:])[0, 0] - real) < 0.16


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = neardup.shared_counts(sets)
    np.fill_diagonal(got, 0)
    np.fill_diagonal(np.array(want), 0)
    assert all(got[a][b] == want[a][b] for a in range(30) for b in range(30) if a != b)


def test_components_of_paths_and_stars(spark):
    edges = [(a, a + 1) for a in range(40)] + [(100, b) for b in range(101, 120)] + [(7, 7)]
    frame = spark.createDataFrame([(str(a).zfill(3), str(b).zfill(3)) for a, b in edges], "a string, b string")
    found = {row["node"]: row["label"] for row in graph.components(frame).collect()}
    assert found == {str(n).zfill(3): "000" if n < 100 else "100" for n in [*range(41), *range(100, 120)]}
    assert graph.components(frame.limit(0)).collect() == []


def test_one_of_each(docs):
    rows = near_copies(6, n_groups=3)
    kept = neardup.one_of_each(docs(rows)).collect()
    assert sorted(row["doc_id"] for row in kept) == sorted({least for *_, least in plain(rows)})


def test_odd_rows(odd, none):
    found = neardup.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    sizes = {row["doc_id"]: (row["n_shingles"], row["component_id"], row["kept"]) for row in found}
    assert sizes[1] == (0, 1, True) and sizes[2] == (0, 2, True) and sizes[5] == (1, 5, True)
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [row["doc_id"] for row in kept.collect()]
    assert sorted(ids, key=str) == [1, 2, 3, 4, 5, 6, None]
    assert neardup.near_duplicates(none).collect() == []
    assert neardup.one_of_each(none).collect() == []


def test_same_id_with_other_texts(docs):
    long = " ".join(f"w{n}" for n in range(50))
    rows = [(1, long), (2, long), (2, "x " + long), (3, "quite another text of words")]
    found = by_id(neardup.near_duplicates(docs(rows)))
    assert found[2]["component_id"] == 1 and found[3]["kept"]


@pytest.mark.parametrize("percent", [80, 85])
def test_bands_and_margin_fit_the_threshold(percent):
    rows, share = neardup.band_rows(percent), percent / 100
    assert rows == {80: 5, 85: 6}[percent]
    assert (1 - share**rows) ** (neardup.HASHES // rows) < 1e-6
    agree = 0.25 + 0.75 * share
    assert neardup.margin(percent) > 5 * (agree * (1 - agree) / neardup.HASHES) ** 0.5 / 0.75
