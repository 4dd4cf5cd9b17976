import random
from collections import defaultdict

import numpy as np

from netbehave.llm import quality
from tests.llm.conftest import by_id


def longest(words):
    """Longest repeat from each word on, by comparing all pairs."""
    result = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            result[i] = max(result[i], n)
    return result


def plain(text):
    words = (text or "").encode().split()
    here = longest(words)

    def covered(least, whole):
        return len({i + k for i, n in enumerate(here) if n >= least for k in range(n if whole else least)})

    repeat, cover = covered(3, False), covered(quality.MIN_REPEAT, True)
    most = max([n for n in here if n >= quality.MIN_REPEAT], default=0)
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return repeat, cover, most, failed, not failed and 100 * cover <= 40 * len(words) and most <= 100


def texts(seed, n):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) + str(rng.randint(0, 40)) for _ in range(120)]
        cut = rng.randint(0, 60)
        made.append(" ".join(words + words[cut : cut + rng.choice([0, 3, 5, 30, 110])]))
    return made + ["x " * 400, "a b " * 30, " ".join(map(str, range(300)))]


def test_measures_equal_all_pairs(docs):
    given = texts(1, 25)
    found = by_id(quality.repetition(docs(given)))
    for at, text in enumerate(given):
        row = found[at]
        assert (
            row["n_repeat_words"],
            row["covered_words"],
            row["longest_repeat"],
            row["base_failed"],
            row["kept"],
        ) == plain(text)


def test_maximal_repeats(docs):
    rng = random.Random(2)
    given = [" ".join(rng.choice("ab" if at % 2 else "abc") for _ in range(22)) for at in range(20)]
    want = set()
    for at, text in enumerate(given):
        words = text.split()
        places = defaultdict(list)
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                places[tuple(words[i:j])].append(i)
        for repeat, starts in places.items():
            left = {words[i - 1] if i else None for i in starts}
            ends = [i + len(repeat) for i in starts]
            right = {words[i] if i < len(words) else None for i in ends}
            if len(starts) > 1 and len(left) > 1 and len(right) > 1:
                want.add((at, " ".join(repeat), tuple(starts)))
    found = quality.maximal_repeats(docs(given), shortest=2).collect()
    assert {(row["doc_id"], row["repeat"], tuple(row["starts"])) for row in found} == want
    assert len(found) == len(want)


def test_suffixes_of_documents_never_mix():
    word = np.array([0, 1, 0, 1, 0, 1])
    _, lcp = quality.suffix_array(word, np.array([0, 0, 1, 1, 2, 2]))
    assert not lcp.any()


def test_lines_and_symbols(docs):
    row = quality.repetition(docs(["a\nb\na\n \n\n#*|\na"])).first()
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"]) == (5, 7, 3, 2)


def test_odd_rows(odd, none):
    found = quality.repetition(odd).collect()
    assert len(found) == odd.count()
    for row in found:
        if row["doc_id"] in (1, 2, 3):
            assert row["n_words"] == 0 and row["base_failed"] and not row["kept"]
    kept = quality.keep_quality(odd)
    assert kept.columns == odd.columns
    assert [row["doc_id"] for row in kept.collect()] == [4]
    assert quality.repetition(none).collect() == []
    assert quality.keep_quality(none).collect() == []
