"""Linear-chain conditional random fields in numpy.

Tokens have types, and a type has features: the score of a label at a token is the sum of
the weights of the features of its type, over one or more views (the token itself, its
neighbours, its file). ``transitions[a, b]`` is added where label ``b`` follows ``a``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Features:
    """Features of token types as pairs (type, feature)."""

    types: np.ndarray
    features: np.ndarray
    n_types: int
    n_features: int

    @classmethod
    def of(cls, rows: list[list[int]], n_features: int) -> Features:
        types = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
        return cls(types, np.array([f for row in rows for f in row], np.int64), len(rows), n_features)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Score of each label for each type."""
        columns = [
            np.bincount(self.types, column[self.features], self.n_types) for column in weights.T
        ]
        return np.stack(columns, axis=1)

    def gradient(self, by_type: np.ndarray) -> np.ndarray:
        columns = [
            np.bincount(self.features, column[self.types], self.n_features) for column in by_type.T
        ]
        return np.stack(columns, axis=1)


@dataclass
class Model:
    weights: list[np.ndarray]  # one (features, labels) table per view
    transitions: np.ndarray


def log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


def expectations(
    scores: np.ndarray, transitions: np.ndarray, there: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (n, time, labels) and expected transitions of padded sequences."""
    n, time, labels = scores.shape
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, time):
        step = log_sum(forward[:, t - 1, :, None] + transitions, 1) + scores[:, t]
        forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
    for t in range(time - 2, -1, -1):
        step = log_sum(transitions + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(there[:, t + 1, None], step, 0)
    total = log_sum(forward[:, -1], 1)
    single = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
    pairs = np.zeros((labels, labels))
    for t in range(1, time):
        joint = (
            forward[:, t - 1, :, None]
            + transitions
            + (scores[:, t] + backward[:, t])[:, None, :]
            - total[:, None, None]
        )
        pairs += np.where(there[:, t, None, None], np.exp(np.minimum(joint, 0)), 0).sum(0)
    return single, pairs


def train(
    tokens: list[np.ndarray],
    views: list[Features],
    labels: np.ndarray,
    there: np.ndarray,
    n_labels: int,
    steps: int = 120,
    rate: float = 0.15,
    penalty: float = 0.3,
) -> Model:
    """Fit by Adam on the penalised likelihood of all sequences at once.

    ``tokens`` holds the types of each view as (sequences, time), ``there`` which tokens
    are no padding.
    """
    parameters = [np.zeros((view.n_features, n_labels)) for view in views]
    parameters.append(np.zeros((n_labels, n_labels)))
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    truth = np.eye(n_labels)[labels] * there[:, :, None]
    follows = there[:, 1:]
    counted = np.zeros((n_labels, n_labels))
    np.add.at(counted, (labels[:, :-1][follows], labels[:, 1:][follows]), 1)
    size = max(1, len(labels))
    for step in range(1, steps + 1):
        scores = sum(
            view.scores(weights)[ids] for view, weights, ids in zip(views, parameters, tokens)
        )
        single, pairs = expectations(scores, parameters[-1], there)
        wrong = (single - truth)[there]
        gradients = []
        for view, ids in zip(views, tokens):
            flat = ids[there]
            by_type = np.stack([np.bincount(flat, one, view.n_types) for one in wrong.T], axis=1)
            gradients.append(view.gradient(by_type))
        gradients.append(pairs - counted)
        for p, g, m, v in zip(parameters, gradients, first, second):
            g = (g + penalty * p) / size
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(parameters[:-1], parameters[-1])


# ---------------------------------------------------------------- decoding


def viterbi(scores: np.ndarray, transitions: np.ndarray) -> list[int]:
    """Best labels of one sequence; of equal paths the one with lower labels at the end."""
    n, labels = scores.shape
    best, back = scores[0].copy(), np.zeros((n, labels), np.int64)
    for t in range(1, n):
        step = best[:, None] + transitions
        back[t] = step.argmax(0)
        best = step.max(0) + scores[t]
    path = [int(best.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return path[::-1]


def certain(scores: np.ndarray, transitions: np.ndarray, label: int) -> np.ndarray:
    """Tokens that have ``label`` on every best path, whatever their neighbours have.

    Putting ``label`` in place of another label changes the score of a path by the
    difference at the token and by two transitions. Where the difference exceeds the most
    that any two transitions can lose, no best path has the other label.
    """
    edges = np.zeros((len(transitions) + 1,) * 2)
    edges[:-1, :-1] = transitions  # the last row and column stand for the ends of a text
    result = np.ones(len(scores), bool)
    for other in range(len(transitions)):
        if other != label:
            before = (edges[:, other] - edges[:, label]).max()
            after = (edges[other] - edges[label]).max()
            result &= scores[:, label] - scores[:, other] > before + after + 1e-9
    return result


def decode(scores: np.ndarray, transitions: np.ndarray, limits: np.ndarray, label: int) -> np.ndarray:
    """Viterbi labels of many sequences, most of whose tokens have ``label``.

    ``limits`` bounds the sequences. Certain tokens split a sequence into islands, each
    decoded by itself with the fixed labels next to it.
    """
    result = np.full(len(scores), label, np.int64)
    open_ = np.flatnonzero(~certain(scores, transitions, label))
    if not len(open_):
        return result
    sequence = np.searchsorted(limits, open_, "right")
    new = np.concatenate([[True], (np.diff(open_) > 1) | (np.diff(sequence) > 0)])
    starts = np.flatnonzero(new)
    for low, high in zip(open_[starts], open_[np.append(starts[1:], len(open_)) - 1] + 1):
        within = np.searchsorted(limits, low, "right")
        island = scores[low:high].copy()
        if low > limits[within - 1]:
            island[0] += transitions[label]
        if high < limits[within]:
            island[-1] += transitions[:, label]
        result[low:high] = viterbi(island, transitions)
    return result


def marginals(
    scores: np.ndarray, transitions: np.ndarray, limits: np.ndarray, block: int = 32
) -> np.ndarray:
    """Forward-backward label probabilities of every token of many sequences.

    Sequences are cut into blocks. A block is a product of matrices, so the forward and
    backward vectors at block ends follow from one product per block, and then all blocks
    are worked at once. Nothing is approximated.
    """
    n, labels = scores.shape
    lengths = np.diff(limits)
    blocks = -(-lengths // block)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(first[-1])
    if not total:
        return np.zeros((0, labels))
    owner = np.repeat(np.arange(len(lengths)), blocks)
    begin = limits[:-1][owner] + (np.arange(total) - first[:-1][owner]) * block
    places = begin[:, None] + np.arange(block)
    there = places < limits[1:][owner][:, None]
    local = np.exp(scores - scores.max(axis=1, keepdims=True))[np.minimum(places, n - 1)]
    local[~there] = 1
    move = np.exp(transitions - transitions.max())
    opening = np.isin(np.arange(total), first[:-1][blocks > 0])

    def ahead(state: np.ndarray, t: int, extra: tuple[int, ...]) -> np.ndarray:
        """One step of rows of states; no transition into the first token of a sequence."""
        moved = state @ move
        if t == 0:
            moved = np.where(opening.reshape(-1, *extra), state, moved)
        moved = moved * local[:, t].reshape(total, *[1] * (len(extra) - 1), labels)
        scale = moved.reshape(total, -1).max(1).reshape(-1, *extra)
        return np.where(there[:, t].reshape(-1, *extra), moved / scale, state)

    product = np.broadcast_to(np.eye(labels), (total, labels, labels))
    for t in range(block):
        product = ahead(product, t, (1, 1))
    # From block to block: sequences in order of their number of blocks, longest first.
    order = np.argsort(-blocks, kind="stable")
    enter, leave = np.ones((total, labels)), np.ones((total, labels))
    for at in range(1, int(blocks.max())):
        now = first[:-1][order[: np.searchsorted(-blocks[order], -at, "left")]] + at
        step = np.einsum("ni,nij->nj", enter[now - 1], product[now - 1])
        enter[now] = step / step.max(1, keepdims=True)
    for at in range(1, int(blocks.max())):
        now = first[1:][order[: np.searchsorted(-blocks[order], -at, "left")]] - 1 - at
        step = np.einsum("nij,nj->ni", product[now + 1], leave[now + 1])
        leave[now] = step / step.max(1, keepdims=True)
    forward = np.empty((total, block, labels))
    state = enter
    for t in range(block):
        state = forward[:, t] = ahead(state, t, (1,))
    result = np.empty((n, labels))
    state = leave
    for t in range(block - 1, -1, -1):
        joint = forward[:, t] * state
        now = there[:, t]
        result[places[now, t]] = joint[now] / joint[now].sum(1, keepdims=True)
        moved = (state * local[:, t]) @ move.T
        moved = np.where(now[:, None], moved / moved.max(1, keepdims=True), state)
        state = moved
    return result
