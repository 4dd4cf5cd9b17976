import itertools

import numpy as np

from netbehave.llm import crf


def paths(scores, transitions):
    n, labels = scores.shape
    for path in itertools.product(range(labels), repeat=n):
        total = sum(scores[t, path[t]] for t in range(n))
        yield path, total + sum(transitions[a, b] for a, b in zip(path, path[1:]))


def test_marginals_and_viterbi_equal_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(60):
        labels = int(rng.integers(2, 4))
        limits = np.concatenate([[0], np.cumsum(rng.integers(0, 7, rng.integers(1, 5)))])
        scores = rng.normal(size=(limits[-1], labels)) * 2
        transitions = rng.normal(size=(labels, labels)) * 2
        likely = crf.marginals(scores, transitions, limits, block=int(rng.integers(1, 5)))
        for low, high in zip(limits, limits[1:]):
            if low == high:
                continue
            want, best = np.zeros((high - low, labels)), []
            for path, total in paths(scores[low:high], transitions):
                best.append((total, path))
                want[np.arange(high - low), path] += np.exp(total)
            assert np.allclose(want / want.sum(1, keepdims=True), likely[low:high])
            assert crf.viterbi(scores[low:high], transitions) == list(max(best)[1])


def test_islands_equal_whole_sequences():
    rng = np.random.default_rng(1)
    for _ in range(80):
        limits = np.concatenate([[0], np.cumsum(rng.integers(0, 40, 5))])
        scores = rng.normal(size=(limits[-1], 3)) * 2
        scores[:, 0] += rng.choice([0, 5, 12], size=limits[-1])
        transitions = rng.normal(size=(3, 3))
        want = [
            label
            for low, high in zip(limits, limits[1:])
            if low < high
            for label in crf.viterbi(scores[low:high], transitions)
        ]
        assert crf.decode(scores, transitions, limits, 0).tolist() == want


def test_training_raises_likelihood_of_a_pattern():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 4, (200, 12))
    labels = (np.cumsum(ids == 3, axis=1) > 0).astype(int)  # 1 from the first 3 on
    there = np.ones(ids.shape, bool)
    view = crf.Features.of([[0], [1], [2], [3]], 4)
    model = crf.train([ids], [view], labels, there, 2, steps=200)
    scores = view.scores(model.weights[0])
    found = [crf.viterbi(scores[row], model.transitions) for row in ids]
    assert (np.array(found) == labels).mean() > 0.95
