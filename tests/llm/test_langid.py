import itertools
import random

import numpy as np
import pytest

from netbehave.llm import langid
from tests.llm.conftest import by_id

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["eau", "oir", "que", "les"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def rows(seed, n):
    rng = random.Random(seed)
    return [(at, text(lang, rng.randint(5, 60), rng), lang) for at in range(n) for lang in [rng.choice("abc") * 2]]


def frame(spark, given):
    return spark.createDataFrame(given, "doc_id long, text string, lang string").repartition(3)


def test_held_out_rows(spark):
    identifier = langid.fit(frame(spark, rows(1, 150)))
    found = by_id(langid.predict(frame(spark, rows(2, 100)), identifier))
    right = [found[doc_id]["lang_pred"] == lang for doc_id, _, lang in rows(2, 100)]
    assert sum(right) >= 99
    assert all(0 <= row["score"] <= 1 for row in found.values())


def test_code_switched_text(spark):
    rng = random.Random(3)
    identifier = langid.fit(frame(spark, rows(1, 150)))
    mixed = text("aa", 60, rng) + " " + text("bb", 20, rng)
    row = langid.predict(frame(spark, [(1, mixed, None)]), identifier).first()
    assert row["lang_pred"] == "aa" and 0.65 < row["score"] < 0.85
    alone = langid.Scorer(identifier).shares([mixed])[0]
    assert abs(alone[1] - 0.25) < 0.1


def test_lexicon_covers_all_rows(spark):
    """A word of the last rows only, which no sample of 1 row would see."""
    given = [(at, "ka to mi", "aa") for at in range(50)] + [(99, "seltsam " * 30, "aa")]
    assert b"seltsam" in langid.lexicons(frame(spark, given), ["aa"])
    assert langid.fit(frame(spark, given), limit=1).lexicon.keys() >= {b"ka", b"to", b"seltsam"}


def test_only_text_is_read(spark):
    identifier = langid.fit(frame(spark, rows(1, 100)))
    one = [(at, t, None) for at, t, _ in rows(4, 30)]
    two = [(at + 1000, t, "cc") for at, t, _ in rows(4, 30)]
    a, b = (by_id(langid.predict(frame(spark, given), identifier)) for given in (one, two))
    assert [(a[at]["lang_pred"], a[at]["score"]) for at in range(30)] == [
        (b[at + 1000]["lang_pred"], b[at + 1000]["score"]) for at in range(30)
    ]


def test_odd_rows(spark, odd, none):
    identifier = langid.fit(frame(spark, rows(1, 100)))
    found = langid.predict(odd, identifier).collect()
    assert len(found) == odd.count()
    for row in found:
        assert (row["lang_pred"] == "und") == (row["doc_id"] in (1, 2, 3))
        assert row["score"] == 0 if row["lang_pred"] == "und" else row["score"] > 0
    numbers = langid.predict(frame(spark, [(1, "12 3.4 !!", None)]), identifier).first()
    assert (numbers["lang_pred"], numbers["score"]) == ("und", 0)
    assert langid.fit(none) is None
    assert {row["lang_pred"] for row in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(none, identifier).collect() == []
    assert langid.fit(frame(spark, [(1, "", "aa"), (2, None, "bb"), (3, "x", None)])) is None


def test_features_of_many_words_equal_those_of_each():
    words = ["a", "ab", "the", "ñandú", "日本", "x" * 5000, "", "wörd-with'signs", "\x7f", "\xff"]
    cores = [word.encode() for word in words] + [b"\xff\xfe", b""]
    lexicon = {b"the": [0, 2], b"a": [1]}
    found = langid.features_of(cores, lexicon, langid.BUCKETS + 3)
    for at, core in enumerate(cores):
        assert sorted(found.features[found.types == at].tolist()) == sorted(langid.features(core, lexicon))
    none = langid.features_of([], lexicon, langid.BUCKETS + 3)
    assert none.n_types == 0 and not len(none.features)


def test_document_scores_equal_a_plain_sum(docs, spark):
    """The share of each language over the words, from the probabilities of whole chains."""
    texts = ["der hund und die katze sind hier", "the dog and the cat are here", "the hund 12 und . the katze", "a"]
    rows = [(at, text, "de" if at % 2 == 0 else "en") for at, text in enumerate(texts[:2] * 6)]
    identifier = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = {row["doc_id"]: row for row in langid.predict(docs(texts), identifier).collect()}
    weights, transitions = identifier.model.weights[0], identifier.model.transitions
    for at, text in enumerate(texts):
        words = text.encode().split()
        scores = [sum((weights[f] for f in langid.features(langid.core_of(w), identifier.lexicon)), np.zeros(2)) for w in words]
        totals, weight = np.zeros((len(words), 2)), 0.0
        for path in itertools.product(range(2), repeat=len(words)):
            score = sum(scores[n][label] for n, label in enumerate(path))
            score += sum(transitions[a, b] for a, b in zip(path, path[1:]))
            weight += np.exp(score)
            for n, label in enumerate(path):
                totals[n, label] += np.exp(score)
        lettered = [bool(langid.LETTER.search(langid.core_of(w).decode())) for w in words]
        sums = (totals / weight)[lettered].sum(0)
        best = int(sums.argmax())
        assert found[at]["lang_pred"] == identifier.langs[best]
        assert found[at]["score"] == pytest.approx(sums[best] / sums.sum(), abs=1e-6)
