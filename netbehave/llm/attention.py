"""A small causal self-attention model in numpy.

A window has ``2 * SPAN`` places, and its last ``SPAN`` are predicted: each from the places
up to the one before it. Windows overlap by half, so every token is predicted once and
sees at least ``SPAN`` tokens before it, or all there are. One attention layer with a learned
bias by distance and one layer of hidden units are added to a prior, the log share of each
class after the last token, and give a distribution over the commonest tokens and one class
for all others, which share it out by their counts.

The distribution has two steps, so that a prediction needs 33 exponentials and not 257:
first a group of ``GROUP`` classes of neighbouring counts, or the class of all others, then a
class of the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPAN = 16
WIDTH, HIDDEN = 16, 32
INPUTS, OUTPUTS = 1024, 256  # commonest tokens with an embedding, and with a class, of their own
GROUP = 16  # classes in a group
GROUPS = OUTPUTS // GROUP  # the class of all others counts as one more group
RARE, START = INPUTS, INPUTS + 1
DISTANCE = np.arange(SPAN)[:, None] + SPAN - np.arange(2 * SPAN)
CAUSAL = DISTANCE >= 0
BLOCKED = np.float32(-1e9)

Params = dict[str, np.ndarray]


def initial(seed: int) -> Params:
    random = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (random.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

    square = {name: normal(WIDTH, WIDTH) for name in ("query", "key", "value", "out")}
    return square | {
        "embed": random.normal(size=(INPUTS + 2, WIDTH)).astype(np.float32) * np.float32(0.3),
        "distance": np.zeros(2 * SPAN, np.float32),
        "in": normal(WIDTH, HIDDEN),
        "in_bias": np.zeros(HIDDEN, np.float32),
        "hidden": normal(HIDDEN, WIDTH),
        "group": normal(WIDTH, GROUPS + 1),
        "class": normal(WIDTH, OUTPUTS).reshape(WIDTH, GROUPS, GROUP),
    }


def steps_of(prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of groups, and of classes in their group, from log shares of classes."""
    shares = np.exp(prior.astype(np.float64))
    within = shares[:, :OUTPUTS].reshape(len(prior), GROUPS, GROUP)
    sums = within.sum(axis=2)
    groups = np.log(np.concatenate([sums, shares[:, OUTPUTS:]], axis=1))
    return groups.astype(np.float32), np.log(within / sums[:, :, None]).astype(np.float32)


def bias(params: Params) -> np.ndarray:
    """Score added at each (predicting place, seen place)."""
    return np.where(CAUSAL, params["distance"][np.maximum(DISTANCE, 0)], BLOCKED).astype(np.float32)


class Space:
    """Arrays by name that are used again: new memory costs more than the sums worked out in it."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.arrays = np.dtype(dtype), {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.arrays or self.arrays[name].size < size:
            self.arrays[name] = np.empty(size, self.dtype)
        return self.arrays[name][:size].reshape(shape)


@dataclass
class Batch:
    """Windows over rows of tokens: one starts every ``step`` rows, and has ``2 * SPAN``.

    With a step of ``SPAN`` windows share rows, which are then worked on once.
    """

    tokens: np.ndarray  # input token of each row
    step: int
    there: np.ndarray | None  # (n, 2 * SPAN), which places exist; None: all but those of ``opens``
    opens: np.ndarray  # windows without the first ``SPAN`` places

    @classmethod
    def of(cls, seen: np.ndarray, there: np.ndarray) -> Batch:
        return cls(seen.reshape(-1), 2 * SPAN, there, np.zeros(0, np.int64))

    def __len__(self) -> int:
        return (len(self.tokens) - 2 * SPAN) // self.step + 1

    def seen(self, rows: np.ndarray, first: int, width: int) -> np.ndarray:
        """(n, 2 * SPAN, width) of the rows, which lie in turn, from the column ``first`` on."""
        row, item = rows.strides
        shape, strides = (len(self), 2 * SPAN, width), (self.step * row, row, item)
        return np.ndarray(shape, rows.dtype, rows, first * item, strides)

    def last(self) -> np.ndarray:
        """Tokens that stand before the predicted ones."""
        return self.tokens[SPAN:] if self.step == SPAN else self.tokens.reshape(-1, 2 * SPAN)[:, SPAN:].ravel()

    def block(self, scores: np.ndarray) -> None:
        """Let places that do not exist have no weight in scores (n, SPAN, 2 * SPAN)."""
        if self.there is not None and not self.there.all():
            scores += np.where(self.there, np.float32(0), BLOCKED)[:, None, :]
        scores[self.opens, :, :SPAN] = BLOCKED

    def by_row(self, found: np.ndarray, result: np.ndarray) -> np.ndarray:
        """Sums over the windows of what was found at their places, by row."""
        if self.step == 2 * SPAN:
            return flat(found)
        n = len(self) * SPAN
        result[:SPAN] = 0
        result[SPAN:].reshape(-1, SPAN, found.shape[2])[:] = found[:, SPAN:]
        result[:n].reshape(-1, SPAN, found.shape[2])[:] += found[:, :SPAN]
        return result


class Tables:
    """What a token alone decides, worked out once for each: itself, its query and its value.

    Queries are taken to where keys are the embedding itself, values to where they are added.
    """

    def __init__(self, p: Params):
        scale = np.float32(1 / np.sqrt(WIDTH))
        embed = p["embed"]
        self.mix = p["query"] @ p["key"].T * scale
        self.through = p["value"] @ p["out"]
        self.rows = np.concatenate([embed, embed @ self.mix, embed @ self.through], axis=1)
        self.bias = bias(p)
        # A block of its own for each group.
        self.classes = np.ascontiguousarray(p["class"].transpose(1, 0, 2))


def exponentials(scores: np.ndarray) -> np.ndarray:
    """In place. Far from what training reaches, and within what an exponential can hold."""
    return np.exp(np.clip(scores, -80, 80, out=scores), out=scores)


def inverse_sums(powers: np.ndarray, space: Space) -> np.ndarray:
    """One column."""
    sums = np.matmul(powers, np.ones((powers.shape[1], 1), powers.dtype), out=space("sums", len(powers), 1))
    return np.divide(1, sums, out=sums)


def soft(scores: np.ndarray, space: Space) -> np.ndarray:
    """Shares of each row of scores, which are changed."""
    scores *= inverse_sums(exponentials(scores), space)
    return scores


def taken(table: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Rows of a table; all of ``at`` are there, and "clip" alone fills ``out`` directly."""
    return table.take(at, axis=0, out=out, mode="clip")


def grouped(goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Places in the order of the groups of their classes, the groups in this order, and where
    each group starts and the last ends. Behind them stand those of the class of all others."""
    group = (goal // GROUP).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS + 1))])
    return order, group[order].astype(np.int64), ends.tolist()


def group_scores(p: Params, top: np.ndarray, prior: np.ndarray, last: np.ndarray, space: Space) -> np.ndarray:
    scores = np.matmul(top, p["group"], out=space("group scores", len(top), GROUPS + 1))
    scores += taken(prior, last, space("group prior", *scores.shape))
    return scores


def class_scores(
    t: Tables, top: np.ndarray, ends: list[int], prior: np.ndarray, at: np.ndarray, space: Space
) -> np.ndarray:
    """Scores of the classes of each row's group. Rows are in the order of groups, ``prior`` has
    a row for each token and group, ``at`` tells which."""
    scores = space("class scores", len(at), GROUP)
    for one, (low, high) in enumerate(zip(ends, ends[1:-1])):
        np.matmul(top[low:high], t.classes[one], out=scores[low:high])
    scores += taken(prior.reshape(-1, GROUP), at, space("class prior", *scores.shape))
    return scores


@dataclass
class Seen:
    """Rows of ``Tables`` of a batch, by window, and what attention makes of them."""

    queries: np.ndarray  # (n, SPAN, WIDTH)
    keys: np.ndarray  # (n, 2 * SPAN, WIDTH)
    values: np.ndarray  # (n, 2 * SPAN, WIDTH)
    powers: np.ndarray  # (n, SPAN, 2 * SPAN), weights before they are divided by their sums
    inverse: np.ndarray  # (n * SPAN, 1) of the sums
    found: np.ndarray  # (n * SPAN, WIDTH)
    state: np.ndarray  # (n * SPAN, WIDTH)

    @classmethod
    def of(cls, t: Tables, batch: Batch, space: Space) -> Seen:
        n = len(batch)
        rows = taken(t.rows, batch.tokens, space("rows", len(batch.tokens), 3 * WIDTH))
        keys, queries, values = (batch.seen(rows, at * WIDTH, WIDTH) for at in range(3))
        queries = queries[:, SPAN:]
        scores = np.matmul(queries, keys.transpose(0, 2, 1), out=space("powers", n, SPAN, 2 * SPAN))
        scores += t.bias
        batch.block(scores)
        inverse = inverse_sums(exponentials(scores).reshape(-1, 2 * SPAN), space).copy()
        found = np.matmul(scores, values, out=space("found", n, SPAN, WIDTH))
        flat(found)[:] *= inverse
        state = np.add(found, keys[:, SPAN:], out=space("state", n, SPAN, WIDTH))
        return cls(queries, keys, values, scores, inverse, flat(found), flat(state))


def hidden_layer(p: Params, h: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """The hidden units and what they make of the state."""
    r = np.matmul(h, p["in"], out=space("r", len(h), HIDDEN))
    r += p["in_bias"]
    np.maximum(r, 0, out=r)
    top = np.matmul(r, p["hidden"], out=space("top", len(h), WIDTH))
    top += h
    return r, top


def missed(likely: np.ndarray, right: np.ndarray, weight: np.ndarray) -> float:
    """Loss of one step, whose shares become its gradient by the scores."""
    every, at = likely.reshape(-1), np.arange(0, likely.size, likely.shape[1]) + right
    found = every[at]
    every[at] = found - 1
    likely[~weight] = 0
    return -float(np.log(np.maximum(found, 1e-30)) @ weight)


def gradient_sum(
    p: Params, t: Tables, batch: Batch, target: np.ndarray, counted: np.ndarray,
    prior: tuple[np.ndarray, np.ndarray], space: Space, by_row: np.ndarray,
) -> tuple[float, Params]:
    """Sums over the counted targets of losses and gradients. That of ``embed`` is written to
    ``by_row``, and those of the attention are by the two products that ``Tables`` makes."""
    seen = Seen.of(t, batch, space)
    n = len(seen.state)
    g: Params = {}
    # The layers above work on tokens one by one, here in the order of their targets' groups.
    order, group, ends = grouped(target.reshape(-1))
    goal, weight, last = target.reshape(-1)[order], counted.reshape(-1)[order], batch.last()[order]
    group_prior, class_prior = prior
    h = taken(seen.state, order, space("h", n, WIDTH))
    r, top = hidden_layer(p, h, space)
    d = soft(group_scores(p, top, group_prior, last, space), space)
    loss = missed(d, group, weight)
    g["group"] = top.T @ d
    dtop = np.matmul(d, p["group"].T, out=space("dtop", n, WIDTH))
    inside = slice(ends[GROUPS])
    at = last[inside] * GROUPS + group[inside]
    d = soft(class_scores(t, top, ends, class_prior, at, space), space)
    loss += missed(d, goal[inside] % GROUP, weight[inside])
    back = space("back", len(d), WIDTH)
    by_class = np.empty_like(t.classes)
    for one, (low, high) in enumerate(zip(ends, ends[1:-1])):
        np.matmul(top[low:high].T, d[low:high], out=by_class[one])
        np.matmul(d[low:high], t.classes[one].T, out=back[low:high])
    g["class"] = by_class.transpose(1, 0, 2)
    dtop[inside] += back
    g["hidden"] = r.T @ dtop
    dr = np.matmul(dtop, p["hidden"].T, out=space("dr", n, HIDDEN))
    dr *= r > 0
    g["in"], g["in_bias"] = h.T @ dr, np.ones(n, dr.dtype) @ dr
    dtop += np.matmul(dr, p["in"].T, out=space("from hidden", n, WIDTH))
    back_to = np.empty(n, np.int64)
    back_to[order] = np.arange(n)
    dh = taken(dtop, back_to, space("dh", n, WIDTH))

    scaled = np.multiply(dh, seen.inverse, out=space("scaled", n, WIDTH))
    windows = scaled.reshape(-1, SPAN, WIDTH)
    ds = np.matmul(windows, seen.values.transpose(0, 2, 1), out=space("ds", *seen.powers.shape))
    ds -= np.einsum("ij,ij->i", scaled, seen.found).reshape(-1, SPAN, 1)
    ds *= seen.powers
    by_place = (np.ones(len(ds), ds.dtype) @ ds.reshape(len(ds), -1)).reshape(CAUSAL.shape)
    g["distance"] = np.bincount(DISTANCE[CAUSAL], by_place[CAUSAL], 2 * SPAN)
    places = space("places", len(batch), 2 * SPAN, WIDTH)
    np.matmul(seen.powers.transpose(0, 2, 1), windows, out=places)
    dv = batch.by_row(places, space("dv", *by_row.shape))
    embed = space("rows", len(by_row), 3 * WIDTH)[:, :WIDTH]
    g["through"] = embed.T @ dv
    from_value = np.matmul(dv, t.through.T, out=space("from value", *by_row.shape))
    np.matmul(ds.transpose(0, 2, 1), seen.queries, out=places)
    np.add(batch.by_row(places, space("dv", *by_row.shape)), from_value, out=by_row)
    dq = flat(np.matmul(ds, seen.keys, out=space("dq", len(ds), SPAN, WIDTH)))
    own = slice(SPAN, None)
    mine = embed[own] if batch.step == SPAN else seen.keys[:, own].reshape(-1, WIDTH)
    g["mix"] = mine.T @ dq
    dh += np.matmul(dq, t.mix.T, out=space("from query", n, WIDTH))
    if batch.step == SPAN:
        by_row[own] += dh
    else:
        by_row.reshape(-1, 2 * SPAN, WIDTH)[:, own] += dh.reshape(-1, SPAN, WIDTH)
    return loss, g


def unmixed(p: Params, g: Params) -> Params:
    """Gradients of the parameters from those of the products of ``Tables``."""
    scale = np.float32(1 / np.sqrt(WIDTH))
    mix, through = g.pop("mix") * scale, g.pop("through")
    return g | {
        "query": mix @ p["key"], "key": mix.T @ p["query"],
        "value": through @ p["out"].T, "out": p["value"].T @ through,
    }


def gradients(
    p: Params,
    seen: np.ndarray,
    there: np.ndarray,
    target: np.ndarray,
    counted: np.ndarray,
    prior: tuple[np.ndarray, np.ndarray],
) -> tuple[float, Params]:
    """Mean loss and its gradients. ``seen`` (n, 2 * SPAN) input tokens, ``there`` which of
    them exist, ``target`` (n, SPAN) classes, ``counted`` which of them are predicted,
    ``prior`` the log shares of both steps."""
    space, batch = Space(p["embed"].dtype), Batch.of(seen, there)
    rows = space("by row", len(batch.tokens), WIDTH)
    loss, g = gradient_sum(p, Tables(p), batch, target, counted, prior, space, rows)
    g["embed"] = added(rows, batch.tokens, len(p["embed"]))
    n = max(1, int(counted.sum()))
    return loss / n, {name: value / n for name, value in unmixed(p, g).items()}


def flat(array: np.ndarray) -> np.ndarray:
    return array.reshape(-1, array.shape[-1])


def added(rows: np.ndarray, tokens: np.ndarray, n_tokens: int) -> np.ndarray:
    """Sum of the rows of each token."""
    tokens = tokens.reshape(-1).astype(np.uint16)
    order = np.argsort(tokens, kind="stable")
    inside = tokens[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(inside) != 0]))
    result = np.zeros((n_tokens, rows.shape[-1]), rows.dtype)
    result[inside[starts]] = np.add.reduceat(rows.take(order, axis=0), starts, axis=0)
    return result


def gradient_sums(
    params: Params, inputs: np.ndarray, classes: np.ndarray, limits: np.ndarray,
    prior: tuple[np.ndarray, np.ndarray], batch: int = 256,
) -> tuple[int, Params]:
    """Targets of all windows of the texts within ``limits``, and sums of their gradients."""
    total, sums = 0, {}
    tables, space = Tables(params), Space(np.float32)
    embed = np.zeros(params["embed"].shape)
    # Many rows are added up at a time, for the sum of a token costs more than a row does.
    most = 16 * (batch + 1) * SPAN
    rows, tokens, held = space("by row", most, WIDTH), np.empty(most, np.uint16), 0
    for part, places, counted in batches_of_windows(inputs, limits, batch):
        if held + len(part.tokens) > most:
            embed += added(rows[:held], tokens[:held], len(embed))
            held = 0
        here = slice(held, held + len(part.tokens))
        held, tokens[here] = here.stop, part.tokens
        _, found = gradient_sum(params, tables, part, classes[places], counted, prior, space, rows[here])
        total += int(counted.sum())
        for name, g in found.items():
            sums[name] = sums.get(name, 0) + g.astype(np.float64)
    if held:
        embed += added(rows[:held], tokens[:held], len(embed))
    if not total:
        return 0, {name: np.zeros(value.shape) for name, value in params.items()}
    return total, unmixed(params, sums) | {"embed": embed}


class Adam:
    """Steps by Adam, of which the first tenth grow and the others shrink."""

    def __init__(self, params: Params, steps: int, rate: float = 0.06):
        self.params, self.steps, self.rate, self.step = params, steps, rate, 0
        self.first = {name: np.zeros_like(value) for name, value in params.items()}
        self.second = {name: np.zeros_like(value) for name, value in params.items()}

    def move(self, found: Params) -> None:
        self.step += 1
        step, first, second = self.step, self.first, self.second
        now = self.rate * min(1, 10 * step / self.steps) * (1 - 0.9 * step / self.steps)
        for name, g in found.items():
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            move = first[name] / (1 - 0.9**step)
            self.params[name] -= now * move / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)


# ---------------------------------------------------------------- scoring


class Predictor:
    """Log probabilities of classes; what a token alone decides is worked out beforehand."""

    def __init__(self, params: Params):
        self.p, self.tables, self.space = params, Tables(params), Space(np.float32)
        self.group_prior, self.class_prior = steps_of(params["prior"])

    def log_likely(self, seen: np.ndarray, there: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target (n, SPAN)."""
        return self.of_batch(Batch.of(seen, there), target)

    def of_batch(self, batch: Batch, target: np.ndarray) -> np.ndarray:
        p, t, space = self.p, self.tables, self.space
        state = Seen.of(t, batch, space).state
        order, group, ends = grouped(target.reshape(-1))
        goal, last = target.reshape(-1)[order], batch.last()[order]
        _, top = hidden_layer(p, taken(state, order, space("h", *state.shape)), space)
        found = log_share(group_scores(p, top, self.group_prior, last, space), group)
        inside = slice(ends[GROUPS])
        at = last[inside] * GROUPS + group[inside]
        scores = class_scores(t, top, ends, self.class_prior, at, space)
        found[inside] += log_share(scores, goal[inside] % GROUP)
        result = np.empty(target.shape, found.dtype)
        result.reshape(-1)[order] = found
        return result


def log_share(scores: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Log probability of one entry of each row of scores, which are changed."""
    np.clip(scores, -80, 80, out=scores)
    at = scores.reshape(-1)[np.arange(0, scores.size, scores.shape[1]) + right]
    return at - np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], scores.dtype))


def batches_of_windows(
    inputs: np.ndarray, limits: np.ndarray, batch: int
) -> Iterator[tuple[Batch, np.ndarray, np.ndarray]]:
    """Windows over texts whose tokens lie in turn within ``limits``, ``batch`` at a time: with
    the predicted places (n, SPAN), and which of them exist.

    A window's first half is the predicted half of the window before it, if that is of its text.
    Places behind the end of a text are seen from no place of it.
    """
    lengths = np.diff(limits)
    counts = -(-lengths // SPAN)
    owner = np.repeat(np.arange(len(lengths)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first, high = limits[:-1][owner] + within * SPAN, limits[1:][owner]
    for at in range(0, len(first), batch):
        part = slice(at, at + batch)
        before = first[max(0, at - 1) : at + batch] if at else np.concatenate([first[:1], first[part]])
        rows = np.minimum(before[:, None] + np.arange(SPAN), len(inputs) - 1)
        places = rows[1:]
        counted = first[part, None] + np.arange(SPAN) < high[part, None]
        tokens = inputs[rows]
        tokens[1:][~counted] = START
        yield Batch(tokens.reshape(-1), SPAN, None, np.flatnonzero(within[part] == 0)), places, counted


def log_scores(
    predictor: Predictor, inputs: np.ndarray, classes: np.ndarray, limits: np.ndarray, batch: int = 256
) -> np.ndarray:
    """Natural log probability of every token's class, each predicted once.

    ``inputs`` holds, at the place of a token, the token before it.
    """
    result = np.zeros(len(inputs))
    for part, places, counted in batches_of_windows(inputs, limits, batch):
        found = predictor.of_batch(part, classes[places])
        result[places[counted]] = found[counted]
    return result
