import math
import pickle
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netbehave.llm import attention, lm
from netbehave.llm.queries import QUERIES
from tests.llm.conftest import by_id

END = 49_407


@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def random_windows(rng, n):
    seen = rng.integers(0, attention.INPUTS + 2, (n, 2 * attention.SPAN))
    there = np.ones(seen.shape, bool)
    there[: n // 2, : attention.SPAN] = False
    target = rng.integers(0, attention.OUTPUTS + 1, (n, attention.SPAN))
    return seen, there, target


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    seen, there, target = random_windows(rng, 4)
    counted = rng.random(target.shape) < 0.9
    prior = attention.steps_of(rng.normal(size=(attention.INPUTS + 2, attention.OUTPUTS + 1)))
    prior = tuple(part.astype(float) for part in prior)
    params = {name: value.astype(float) for name, value in attention.initial(1).items()}
    params["distance"] += rng.normal(size=2 * attention.SPAN)
    _, found = attention.gradients(params, seen, there, target, counted, prior)
    for name, value in params.items():
        place = tuple(rng.integers(0, size) for size in value.shape)
        if name == "embed":
            place = (seen[0, 20], place[1])
        losses = []
        for step in (1e-5, -2e-5):
            value[place] += step
            losses.append(attention.gradients(params, seen, there, target, counted, prior)[0])
        value[place] += 1e-5
        assert abs((losses[0] - losses[1]) / 2e-5 - found[name][place]) < 1e-5


def test_every_token_is_scored_once_from_what_stands_before():
    rng = np.random.default_rng(1)
    prior = rng.normal(size=(attention.INPUTS + 2, attention.OUTPUTS + 1)).astype(np.float32)
    predictor = attention.Predictor(attention.initial(2) | {"prior": prior})
    limits = np.array([0, 1, 1, 40, 55, 120])
    inputs = rng.integers(0, attention.INPUTS, 120)
    classes = rng.integers(0, attention.OUTPUTS, 120)
    whole = attention.log_scores(predictor, inputs, classes, limits, batch=3)
    assert np.all(whole < 0)
    for low, high in zip(limits, limits[1:]):
        alone = attention.log_scores(predictor, inputs[low:high], classes[low:high], np.array([0, high - low]))
        assert np.allclose(alone, whole[low:high], atol=1e-4)
        for cut in range(low + 1, high):
            # What comes later changes nothing.
            first = attention.log_scores(predictor, inputs[low:cut], classes[low:cut], np.array([0, cut - low]))
            assert np.allclose(first, whole[low:cut], atol=1e-4)


def test_classes_are_a_distribution():
    rng = np.random.default_rng(3)
    prior = np.zeros((attention.INPUTS + 2, attention.OUTPUTS + 1), np.float32)
    predictor = attention.Predictor(attention.initial(2) | {"prior": prior})
    seen, there, _ = random_windows(rng, 2)
    total = sum(
        np.exp(predictor.log_likely(seen, there, np.full((2, attention.SPAN), one)))
        for one in range(attention.OUTPUTS + 1)
    )
    assert np.allclose(total, 1, atol=1e-4)
    vocabulary = lm.Vocabulary.of(rng.integers(0, 50, 5000))
    rest = vocabulary.classes == attention.OUTPUTS
    assert np.isclose(np.exp(vocabulary.shares[rest]).sum(), 1) and not vocabulary.shares[~rest].any()


TEXTS = ["The cat sat on the mat.", "the DOG sat", "", None, "rare words, unseen here: xyzzy", "a " * 200]


@pytest.mark.parametrize("common", [0, 5, 10_000])
def test_base_scores(docs, tokenizer, monkeypatch, common):
    monkeypatch.setattr(lm, "COMMON_WORDS", common)
    monkeypatch.setattr(lm, "STEPS", 3)
    given = docs(TEXTS * 3)
    training = given.where("doc_id % 6 < 4")
    counts = Counter()
    for doc_id, text in enumerate(TEXTS * 3):
        if doc_id % 6 < 4:
            counts.update([*(text or "").lower().split(), "</end>"])
    total, distinct = sum(counts.values()), len(counts)
    found = by_id(lm.score(given, training, tokenizer, END))
    for doc_id, text in enumerate(TEXTS * 3):
        words = [*(text or "").lower().split(), "</end>"]
        row = found[doc_id]
        want = sum(math.log10((counts[word] + 1) / (total + distinct + 1)) for word in words)
        assert np.isclose(row["base_score"], want)
        assert row["n_tokens"] == len(words) and row["train_tokens"] == total
        assert row["n_known"] == sum(counts[word] > 0 for word in words)
        assert row["score"] < 0


def test_scores_do_not_depend_on_the_lookup(docs, tokenizer, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 3)
    given = docs(TEXTS)
    scores = []
    for common in (0, 10_000):
        monkeypatch.setattr(lm, "COMMON_WORDS", common)
        found = by_id(lm.score(given, given, tokenizer, END))
        scores.append([found[at]["score"] for at in range(len(TEXTS))])
    assert np.allclose(*scores)


def test_training_learns(docs, tokenizer, monkeypatch):
    given = docs(["one two three four five six seven eight nine ten"] * 40)
    scores = []
    for steps in (1, 60):
        monkeypatch.setattr(lm, "STEPS", steps)
        scores.append(lm.score(given, given, tokenizer, END).first()["score"])
    assert scores[1] > scores[0]


def test_every_training_token_is_learned_from(spark, docs, tokenizer, monkeypatch):
    """Long rows whole, short and repeated ones too, each once: a step is that of all windows."""
    texts = ["one two three " * 200, "four", None, "", "four", "five six seven eight " * 30]
    rng = np.random.default_rng(4)
    vocabulary = lm.Vocabulary.of(rng.integers(0, 50, END + 1))
    prior = np.log(np.full((attention.INPUTS + 2, attention.OUTPUTS + 1), 1 / 257, np.float32))
    encoder = lm.encoder_of(tokenizer)
    tokens = [np.append(encoder.ids_of_words(lm.lower_words(text))[0], END).astype(int) for text in texts]
    n_tokens = sum(map(len, tokens))
    carried = spark.sparkContext.broadcast(tokenizer)
    monkeypatch.setattr(lm, "PIECE_TOKENS", 100)
    for steps in (1, 4):
        monkeypatch.setattr(lm, "STEPS", steps)
        params, learned = lm.fit(docs(texts), carried, vocabulary, prior, END, n_tokens)
        assert learned == n_tokens
        if steps == 1:
            limits = np.cumsum([0, *map(len, tokens)])
            whole = np.concatenate(tokens)
            inputs = np.concatenate([[attention.START], vocabulary.inputs[whole[:-1]]])
            inputs[limits[:-1]] = attention.START
            adam = attention.Adam(attention.initial(lm.SEED), 1)
            n, sums = attention.gradient_sums(
                adam.params, inputs, vocabulary.classes[whole], limits, attention.steps_of(prior)
            )
            assert n == n_tokens
            adam.move({name: (g / n).astype(np.float32) for name, g in sums.items()})
            for name, value in adam.params.items():
                assert np.allclose(params[name], value, atol=2e-3), name


def test_odd_rows(odd, none, tokenizer, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 2)
    found = lm.score(odd, odd, tokenizer, END).collect()
    assert len(found) == odd.count()
    assert {row["n_tokens"] for row in found if row["doc_id"] in (1, 2, 3)} == {1}
    untrained = lm.score(odd, none, tokenizer, END).collect()
    assert {row["train_tokens"] for row in untrained} == {0}
    assert all(row["n_known"] == 0 for row in untrained)
    assert lm.score(none, odd, tokenizer, END).collect() == []


def test_words_are_mixed_with_the_base(docs, tokenizer, monkeypatch):
    """Over the words of training and the class of all others probabilities sum to 1 at most."""
    monkeypatch.setattr(lm, "STEPS", 3)
    training = docs(["one two three two", "three four two"])
    words = ["one", "two", "three", "four", "", "unheard"]
    found = by_id(lm.score(docs(words), training, tokenizer, END))
    # A text of one word is the word and the end behind it; the end has a share of its own.
    for doc_id, word in enumerate(words):
        least = found[doc_id]["base_score"] + (2 if word else 1) * math.log10(lm.MIX)
        assert found[doc_id]["score"] > least
    total = sum(10 ** found[doc_id]["score"] for doc_id in range(len(words)))
    assert total < 1


def test_held_out_texts_score_better_than_the_base(spark):
    """Over all documents of sf0.01: the mean of those not learned from, per token."""
    held = QUERIES["op9_attention_scores"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    tokens = sum(row["n_tokens"] for row in held)
    assert sum(row["score"] for row in held) / tokens > sum(row["base_score"] for row in held) / tokens + 0.05
    assert sum(row["score"] > row["base_score"] for row in held) > 0.7 * len(held)


def test_windows_that_share_rows_give_the_sums_of_windows_by_themselves():
    rng = np.random.default_rng(5)
    span = attention.SPAN
    limits = np.array([0, 1, 1, 40, 55, 120, 120 + 2 * span, 200])
    inputs, classes = rng.integers(0, attention.INPUTS, 200), rng.integers(0, attention.OUTPUTS + 1, 200)
    prior = attention.steps_of(rng.normal(size=(attention.INPUTS + 2, attention.OUTPUTS + 1)))
    prior = tuple(part.astype(np.float32) for part in prior)
    params = attention.initial(6)
    seen, there = [], []
    for low, high in zip(limits, limits[1:]):
        for first in range(low, high, span):
            places = np.arange(first - span, first + span)
            there.append((places >= low) & (places < high))
            seen.append(np.clip(places, 0, 199))
    seen, there = np.array(seen), np.array(there)
    counted = there[:, span:]
    _, mean = attention.gradients(
        params, np.where(there, inputs[seen], attention.START), there, classes[seen[:, span:]], counted, prior
    )
    for batch in (1, 3, 256):
        n, sums = attention.gradient_sums(params, inputs, classes, limits, prior, batch)
        assert n == counted.sum() == limits[-1] and set(sums) == set(params)
        for name, value in sums.items():
            assert np.allclose(value / n, mean[name], atol=1e-6), name


@pytest.mark.parametrize("common", [0, 5, 10_000])
def test_rows_that_are_learned_and_scored_are_encoded_once(docs, odd, tokenizer, monkeypatch, common):
    """A condition on the rows gives what a table of the rows it holds for does."""
    monkeypatch.setattr(lm, "COMMON_WORDS", common)
    monkeypatch.setattr(lm, "STEPS", 3)
    given = docs(TEXTS * 3)
    apart = by_id(lm.score(given, given.where("doc_id % 6 < 4"), tokenizer, END))
    once = by_id(lm.score(given, F.expr("doc_id % 6 < 4"), tokenizer, END))
    assert set(once) == set(apart)
    for doc_id, row in once.items():
        for name in ("n_tokens", "n_known", "train_tokens"):
            assert row[name] == apart[doc_id][name]
        assert np.isclose(row["base_score"], apart[doc_id]["base_score"])
        assert np.isclose(row["score"], apart[doc_id]["score"], rtol=0.01)


def test_tokens_come_back_from_numbers(spark, odd, tokenizer):
    """Whole texts, whether their words are among the commonest or not; what travels is plain."""
    encoder = lm.encoder_of(tokenizer)
    words = [b"one", b"two", b"w7"]
    found = pa.table({"word": words, "n": [3, 2, 1], "ids": encoder.encode_words(words)})
    common = lm.CommonWords.of(found, END, 5)
    assert b"netbehave" not in pickle.dumps(common.parts())
    rows = odd.select("doc_id", "text", F.lit(True).alias("learned"), F.lit(True).alias("scored"))
    context = spark.sparkContext
    texts = lm.encoded(rows, context.broadcast(common.parts()), context.broadcast(tokenizer)).toArrow()
    given = {row["doc_id"]: lm.lower_words(row["text"]) for row in odd.collect()}
    assert len(texts) == odd.count()
    for batch in texts.to_batches():
        tokens, number, cuts, limits = common.tokens(batch)
        for at, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            want = np.append(encoder.ids_of_words(given[doc_id])[0], END)
            assert np.array_equal(tokens[cuts[limits[at]] : cuts[limits[at + 1]]], want)
            rest = batch.column("rest")[at].as_py().split()
            assert rest == [word for word in given[doc_id] if word not in words]
