"""A small gated recurrent network over word ids, with a class-factored softmax, in numpy."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: parameters in the order in which they are flattened
NAMES = ("embed", "w_in", "b_in", "w_rec", "w_class", "b_class", "w_word", "b_word")


@dataclass(frozen=True)
class Shape:
    """Words are numbered so that the members of a class are neighbours; class k has ``bounds[k] : bounds[k + 1]``."""

    bounds: np.ndarray
    hidden: int = 24
    width: int = 16

    @property
    def words(self) -> int:
        return int(self.bounds[-1])

    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def sizes(self) -> list[tuple[int, ...]]:
        n, h, d, c = self.words, self.hidden, self.width, len(self.bounds) - 1
        return [(n, d), (d, 3 * h), (3 * h,), (h, 3 * h), (h, c), (c,), (n, h), (n,)]


def class_bounds(counts: np.ndarray, classes: int) -> np.ndarray:
    """Cut words, most frequent first, into classes of about equal sums of the root of their counts."""
    share = np.cumsum(np.sqrt(counts, dtype=float))
    inner = np.searchsorted(share, share[-1] * np.arange(1, classes) / classes) + 1 if len(counts) else []
    return np.unique(np.concatenate(([0], np.minimum(inner, len(counts)), [len(counts)]))).astype(np.int64)


def start(shape: Shape, counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Random weights; the biases give the words' and classes' own frequencies."""
    rng = np.random.default_rng(seed)
    model = {}
    for name, size in zip(NAMES, shape.sizes()):
        scale = 0 if name[0] == "b" else 0.3 if name == "embed" else 1 / np.sqrt(size[0] if name != "w_word" else size[1])
        model[name] = (rng.standard_normal(size) * scale * 0.5).astype(np.float32)
    log = np.log(np.maximum(counts, 0.1))
    model["b_word"][:] = log
    model["b_class"][:] = np.logaddexp.reduceat(log, shape.bounds[:-1])
    model["b_class"] -= model["b_class"].max()
    model["b_word"] -= model["b_word"].max()
    return model


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[n].ravel() for n in NAMES])


def unflat(values: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, low = {}, 0
    for name, size in zip(NAMES, shape.sizes()):
        n = int(np.prod(size))
        out[name] = values[low : low + n].reshape(size).astype(np.float32)
        low += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _step(h, gates, w_rec, size):
    """One step of all lanes from state ``h``; ``gates`` is the input's part.  A column is a lane."""
    rec = w_rec.T @ h
    zr = rec[: 2 * size]
    zr += gates[: 2 * size]
    _sigmoid(zr)
    z, r = zr[:size], zr[size:]
    n = r * rec[2 * size :]
    n += gates[2 * size :]
    n *= -2  # tanh x = 2 sigmoid(2 x) - 1, and exp is the faster of the two
    np.exp(n, out=n)
    n += 1
    np.reciprocal(n, out=n)
    n *= 2
    n -= 1
    new = h - n
    new *= z
    new += n
    return new, z, r, n, rec[2 * size :]


def _softmax_at(x: np.ndarray, place: np.ndarray, shares: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of one entry of each column of scores, and, if asked for, all probabilities; uses up ``x``."""
    x -= x.max(axis=0)
    at = x[place, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    if shares:
        x /= total
    return at - np.log(total), x if shares else None


def _order(numbers: np.ndarray, bound: int) -> np.ndarray:
    """A stable order of numbers below ``bound``; short ones are sorted by their digits."""
    return np.argsort(numbers.astype(np.int16) if bound < 1 << 15 else numbers, kind="stable")


def _output(states, targets, model, shape, class_of, grads=None):
    """Log-probability (natural) of each target; adds gradients of the loss, and returns that of the states."""
    own = class_of[targets]
    out, d = _softmax_at(model["w_class"].T @ states + model["b_class"][:, None], own, grads is not None)
    back = None
    if grads is not None:
        d[own, np.arange(len(targets))] -= 1
        grads["w_class"] += states @ d.T
        grads["b_class"] += d.sum(axis=1)
        back = model["w_class"] @ d
    order = _order(own, len(shape.bounds))
    cuts = np.searchsorted(own[order], np.arange(len(shape.bounds)))
    states, targets = np.take(states, order, axis=1), targets[order]
    word_out, word_back = np.zeros_like(out), np.zeros_like(states) if grads is not None else None
    for k in range(len(shape.bounds) - 1):
        low, high = shape.bounds[k], shape.bounds[k + 1]
        here = slice(cuts[k], cuts[k + 1])
        if high - low < 2 or cuts[k] == cuts[k + 1]:
            continue
        mine = states[:, here]
        place = targets[here] - low
        word_out[here], d = _softmax_at(
            model["w_word"][low:high] @ mine + model["b_word"][low:high, None], place, grads is not None
        )
        if grads is not None:
            d[place, np.arange(len(place))] -= 1
            grads["w_word"][low:high] += d @ mine.T
            grads["b_word"][low:high] += d.sum(axis=1)
            word_back[:, here] = model["w_word"][low:high].T @ d
    out[order] += word_out
    if grads is not None:
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        back += np.take(word_back, place, axis=1)
    return out, back


def train(tokens: np.ndarray, first: np.ndarray, model, shape, rate=0.004, lanes=256, window=24, state=None):
    """One pass of Adam over a stream of ids by backpropagation through windows; changes ``model``.

    ``first`` marks the first id of each document; the id before it, as input,
    is the end mark 0.  The stream is cut into ``lanes`` side by side, whose
    states go on from window to window; a lane that starts inside a document
    knows the id before it, but no state.  Every id is a target once: the last
    lane may be shorter, and what it lacks has no loss.
    """
    total = len(tokens)
    if not total:
        return state
    steps = -(-total // min(lanes, total))
    lanes = -(-total // steps)
    y = np.zeros(lanes * steps, np.int64)
    y[:total] = tokens
    y = y.reshape(lanes, steps).T
    begin = np.zeros(lanes * steps, bool)
    begin[:total] = first
    begin = begin.reshape(lanes, steps).T.copy()
    begin[0, 0] = True
    live = (np.arange(lanes * steps) < total).reshape(lanes, steps).T
    x = np.zeros_like(y)
    x[1:] = y[:-1]
    x[0, 1:] = y[-1, :-1]
    x[begin] = 0
    keep = (~begin).astype(np.float32)
    size, class_of = shape.hidden, shape.class_of()
    if state is None:
        state = {"t": 0, "m": {n: np.zeros_like(v) for n, v in model.items()}, "v": {n: np.zeros_like(v) for n, v in model.items()}}
    h = np.zeros((size, lanes), np.float32)
    for low in range(0, steps, window):
        ids = x[low : low + window].ravel()
        count = len(ids) // lanes
        targets = y[low : low + window].ravel()
        cuts = [slice(t * lanes, (t + 1) * lanes) for t in range(count)]  # a column is a lane at a step
        table = np.ascontiguousarray((model["embed"] @ model["w_in"] + model["b_in"]).T)
        gates = np.take(table, ids, axis=1)
        before, states, z, r, n, rec = (np.empty((size, len(ids)), np.float32) for _ in range(6))
        for t, cut in enumerate(cuts):
            h = h * keep[low + t]
            before[:, cut] = h
            h, z[:, cut], r[:, cut], n[:, cut], rec[:, cut] = _step(h, gates[:, cut], model["w_rec"], size)
            states[:, cut] = h
        grads = {name: np.zeros_like(v) for name, v in model.items()}
        here = live[low : low + window].ravel()
        if here.all():
            _, back = _output(states, targets, model, shape, class_of, grads)
        else:
            back = np.zeros_like(states)
            back[:, here] = _output(states[:, here], targets[here], model, shape, class_of, grads)[1]
        less = 1 - z
        by_z = before - n
        by_z *= z
        by_z *= less
        by_n = np.multiply(n, n, out=n)
        np.subtract(1, by_n, out=by_n)
        by_n *= less
        by_r = np.subtract(1, r, out=less)
        by_r *= r
        by_r *= rec
        # of each gate, the candidate's recurrent part first: rows to 3 size are the recurrent side, from size the input's
        d_gates = np.empty((4 * size, len(ids)), np.float32)
        w_back = np.concatenate((model["w_rec"][:, 2 * size :], model["w_rec"][:, : 2 * size]), axis=1)
        carry = np.zeros((size, lanes), np.float32)
        for t in range(count - 1, -1, -1):
            cut = cuts[t]
            carry += back[:, cut]
            step = d_gates[:, cut]
            own = np.multiply(carry, by_n[:, cut], out=step[3 * size :])
            np.multiply(carry, by_z[:, cut], out=step[size : 2 * size])
            np.multiply(own, by_r[:, cut], out=step[2 * size : 3 * size])
            np.multiply(own, r[:, cut], out=step[:size])
            carry *= z[:, cut]
            carry += w_back @ step[: 3 * size]
            carry *= keep[low + t]
        d_rec = before @ d_gates[: 3 * size].T
        grads["w_rec"] += np.concatenate((d_rec[:, size:], d_rec[:, :size]), axis=1)
        wide = d_gates[size:]
        grads["b_in"] += wide.sum(axis=1)
        order = _order(ids, shape.words)
        sorted_ids = ids[order]
        fresh = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
        # gradients of the inputs, which are shorter than those of the gates, are summed by word
        grads["w_in"] += np.take(np.ascontiguousarray(model["embed"].T), ids, axis=1) @ wide.T
        by_word = np.ascontiguousarray((model["w_in"] @ wide).T)[order]
        grads["embed"][sorted_ids[fresh]] = np.add.reduceat(by_word, fresh, axis=0)
        _adam(model, grads, state, rate, int(np.count_nonzero(here)))
    return state


def _adam(model, grads, state, rate, tokens, b1=0.9, b2=0.99):
    state["t"] += 1
    norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / tokens
    scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)) / tokens)
    step = rate * np.sqrt(1 - b2 ** state["t"]) / (1 - b1 ** state["t"])
    for name, value in model.items():
        g, m, v = grads[name] * scale, state["m"][name], state["v"][name]
        m *= np.float32(b1)
        m += np.float32(1 - b1) * g
        v *= np.float32(b2)
        v += np.float32(1 - b2) * g * g
        value -= np.float32(step) * m / (np.sqrt(v) + np.float32(1e-8))


def log_likelihoods(tokens: np.ndarray, at: np.ndarray, model, shape, lanes=384, window=24) -> np.ndarray:
    """Natural log-probability of each whole document ``tokens[at[d] : at[d + 1]]``.

    Documents follow each other in lanes, the longest dealt out first; a state
    is carried through all windows of a document and starts anew with the next.
    Tokens are put in the order of the steps at once, so a step looks nothing up.
    """
    n_docs = len(at) - 1
    total = np.zeros(n_docs)
    size = np.diff(at)
    lanes = max(1, min(lanes, int(np.count_nonzero(size))))
    heap = [(0, k) for k in range(lanes)]
    dealt: list[list[int]] = [[] for _ in range(lanes)]
    for d in np.argsort(-size, kind="stable").tolist():
        if size[d]:
            load, k = heap[0]
            heapq.heapreplace(heap, (load + int(size[d]), k))
            dealt[k].append(d)
    dealt.sort(key=lambda docs: -sum(int(size[d]) for d in docs))
    loads = np.array([sum(int(size[d]) for d in docs) for docs in dealt])
    table = np.ascontiguousarray((model["embed"] @ model["w_in"] + model["b_in"]).astype(np.float32).T)
    class_of = shape.class_of()
    if not lanes or not loads[0]:
        return total
    # tokens step by step: those of step t, one of each lane that goes on so long, are at[t] : at[t + 1] of ``to``
    live = np.searchsorted(-loads, -np.arange(loads[0]), "left")
    step_at = np.concatenate(([0], np.cumsum(live)))
    docs = np.array([d for lane in dealt for d in lane], np.int64)
    lens = size[docs]
    fresh = np.cumsum(lens) - lens  # where each document starts in the lanes one after the other
    owner = np.repeat(docs, lens)
    y = tokens[np.arange(len(owner)) + np.repeat(at[docs] - fresh, lens)]
    x = np.zeros_like(y)
    x[1:] = y[:-1]
    x[fresh] = 0
    lane = np.repeat(np.arange(lanes), loads)
    to = step_at[np.arange(len(owner)) - np.repeat(np.cumsum(loads) - loads, loads)] + lane
    begins, starting = np.sort(to[fresh]), lane[fresh[np.argsort(to[fresh])]]
    start_at = np.searchsorted(begins, step_at)
    stepped = [np.empty_like(v) for v in (x, y, owner)]
    for place, values in zip(stepped, (x, y, owner)):
        place[to] = values
    x, y, owner = stepped
    h = np.zeros((shape.hidden, lanes), np.float32)
    high = 0
    while high < len(live):
        # as many steps as hold the tokens of a window of all lanes: where few lanes are left it is longer
        low, high = high, max(high + 1, int(np.searchsorted(step_at, step_at[high] + lanes * window, "right")) - 1)
        here = slice(step_at[low], step_at[high])
        gates = np.take(table, x[here], axis=1)
        states = np.empty((shape.hidden, gates.shape[1]), np.float32)
        for t in range(low, high):
            if start_at[t] < start_at[t + 1]:
                h[:, starting[start_at[t] : start_at[t + 1]]] = 0
            cut = slice(step_at[t] - here.start, step_at[t + 1] - here.start)
            h = _step(h[:, : live[t]], gates[:, cut], model["w_rec"], shape.hidden)[0]
            states[:, cut] = h
        out, _ = _output(states, y[here].astype(np.int64), model, shape, class_of)
        total += np.bincount(owner[here], weights=out, minlength=n_docs)
    return total
