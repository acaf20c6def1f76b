"""A small gated recurrent language model in numpy, with a class-factored output.

Words of the vocabulary are grouped into classes of similar frequency. The model gives the probability
of the next word's class, and of the word within its class. All words outside the vocabulary are one
further class, whose words the caller tells apart.

Documents are read side by side, one in each lane, the longest first, so that the lanes still in use
are always the first ones. They are read in windows; the state is carried from one window to the
next, and gradients are cut there (truncated backpropagation through time).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EMBEDDING, HIDDEN = 16, 24
WINDOW = 16
#: Words outside the vocabulary are told apart on input by so many hash buckets.
BUCKETS = 256
RATE, CLIP = 0.08, 1.0
LANES = 256
#: Documents read side by side in scoring, and words whose outputs are worked out together. They decide no score.
SCORED_LANES, SCORED_WORDS = 512, 8192


def classes_of(counts: np.ndarray, wanted: int) -> np.ndarray:
    """First word of each class, and the end: classes of about equal sums of square-rooted counts.

    ``counts`` are in falling order, so frequent words share their class with few others.
    """
    if len(counts) == 0:
        return np.zeros(1, np.int64)
    filled = np.cumsum(np.sqrt(counts))
    edges = np.searchsorted(filled, filled[-1] * np.arange(1, wanted) / wanted) + 1
    return np.unique(np.concatenate([[0], np.minimum(edges, len(counts)), [len(counts)]]))


class Model:
    """Weights. ``edges`` are the class borders in the vocabulary."""

    NAMES = ("E", "Wx", "b", "U", "V", "Wc", "bc", "Ww", "bw")

    def __init__(self, words: int, edges: np.ndarray, seed: int = 3) -> None:
        random = np.random.default_rng(seed)
        self.words, self.edges = words, edges
        self.class_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        classes = len(edges)  # the last is that of all other words

        def drawn(*shape: int) -> np.ndarray:
            return (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.E = random.standard_normal((words + BUCKETS, EMBEDDING)).astype(np.float32) * np.float32(0.1)
        self.Wx, self.b = drawn(EMBEDDING, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
        self.U, self.V = drawn(HIDDEN, 2 * HIDDEN), drawn(HIDDEN, HIDDEN)
        self.Wc, self.bc = drawn(HIDDEN, classes) * np.float32(0.1), np.zeros(classes, np.float32)
        self.Ww, self.bw = np.zeros((words, HIDDEN), np.float32), np.zeros(words, np.float32)

    def start_from(self, counts: np.ndarray, others: int) -> None:
        """Set the biases so that the untrained model has the unigram probabilities."""
        sums = np.append(np.add.reduceat(counts, self.edges[:-1]) if len(counts) else [], others) + 0.5
        self.bc[:] = np.log(sums / sums.sum())
        self.bw[:] = np.log(counts + 0.5)

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).reshape(-1) for n in self.NAMES])

    def load(self, vector: np.ndarray) -> Model:
        at = 0
        for n in self.NAMES:
            own = getattr(self, n)
            setattr(self, n, vector[at : at + own.size].reshape(own.shape).astype(np.float32))
            at += own.size
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


class _Window:
    """The steps of a window: inputs and targets of the lanes in use, and what the way back needs."""

    def __init__(self, model: Model, inputs: list[np.ndarray], h: np.ndarray) -> None:
        self.ids = np.concatenate(inputs)
        self.X = model.E[self.ids]
        gates = self.X @ model.Wx + model.b
        self.states = np.empty((len(self.ids), HIDDEN), np.float32)
        self.saved: list[tuple] = []
        at = 0
        for ids in inputs:
            n = len(ids)
            before = h[:n].copy()
            g = gates[at : at + n]
            rz = _sigmoid(g[:, : 2 * HIDDEN] + before @ model.U)
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            reset = r * before
            c = np.tanh(g[:, 2 * HIDDEN :] + reset @ model.V)
            now = c + z * (before - c)
            self.states[at : at + n] = now
            self.saved.append((at, n, before, rz, reset, c))
            h[:n] = now
            at += n


def _outputs(model: Model, states: np.ndarray, targets: np.ndarray) -> Iterator[tuple]:
    """Log-probabilities of the classes, then of the words of each class, for the rows that need them."""
    classes = np.full(len(targets), len(model.edges) - 1)
    inside = targets < model.words
    classes[inside] = model.class_of[targets[inside]]
    yield slice(None), None, _log_softmax(states @ model.Wc + model.bc), classes
    order = np.argsort(classes, kind="stable")
    borders = np.searchsorted(classes[order], np.arange(len(model.edges)))
    for k in range(len(model.edges) - 1):
        rows = order[borders[k] : borders[k + 1]]
        first, end = model.edges[k], model.edges[k + 1]
        if len(rows) and end - first > 1:
            logs = _log_softmax(states[rows] @ model.Ww[first:end].T + model.bw[first:end])
            yield rows, (first, end), logs, targets[rows] - first


class Trainer:
    """Adagrad over windows."""

    def __init__(self, model: Model, rate: float = RATE) -> None:
        self.model, self.rate = model, rate
        self.squares = {n: np.full_like(getattr(model, n), 1e-6) for n in Model.NAMES}

    def window(self, inputs: list[np.ndarray], targets: np.ndarray, h: np.ndarray) -> float:
        """One step of descent; returns the sum of the natural log-probabilities."""
        m = self.model
        w = _Window(m, inputs, h)
        grads = {n: np.zeros_like(getattr(m, n)) for n in Model.NAMES}
        d_states = np.zeros_like(w.states)
        total = 0.0
        for rows, span, logs, wanted in _outputs(m, w.states, targets):
            places = np.arange(len(logs))
            total += float(logs[places, wanted].sum())
            d = np.exp(logs)
            d[places, wanted] -= 1
            if span is None:
                grads["Wc"] += w.states.T @ d
                grads["bc"] += d.sum(0)
                d_states += d @ m.Wc.T
            else:
                first, end = span
                grads["Ww"][first:end] += d.T @ w.states[rows]
                grads["bw"][first:end] += d.sum(0)
                d_states[rows] += d @ m.Ww[first:end]
        d_gates = np.empty((len(w.ids), 3 * HIDDEN), np.float32)
        later = np.zeros((len(inputs[0]), HIDDEN), np.float32)
        for at, n, before, rz, reset, c in reversed(w.saved):
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            d = d_states[at : at + n] + later[:n]
            d_c = d * (1 - z) * (1 - c * c)
            d_reset = d_c @ m.V.T
            d_rz = np.concatenate([d_reset * before, d * (before - c)], 1) * rz * (1 - rz)
            later[:n] = d * z + d_reset * r + d_rz @ m.U.T
            grads["V"] += reset.T @ d_c
            grads["U"] += before.T @ d_rz
            d_gates[at : at + n, : 2 * HIDDEN] = d_rz
            d_gates[at : at + n, 2 * HIDDEN :] = d_c
        grads["Wx"] += w.X.T @ d_gates
        grads["b"] += d_gates.sum(0)
        np.add.at(grads["E"], w.ids, d_gates @ m.Wx.T)
        self._step(grads, len(targets))
        return total

    def _step(self, grads: dict[str, np.ndarray], n: int) -> None:
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / n
        scale = np.float32(min(1.0, CLIP / max(norm, 1e-12)) / n)
        for name, g in grads.items():
            g *= scale
            squares = self.squares[name]
            squares += g * g
            getattr(self.model, name)[...] -= np.float32(self.rate) * g / np.sqrt(squares)


def _lanes(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the documents, longest first, all words one after the other, and their starts."""
    lengths = np.array([len(d) for d in docs])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([docs[k] for k in order])
    ends = np.cumsum(lengths[order])
    return order, flat, np.concatenate([[0], ends[:-1]]) if len(docs) else ends


def _windows(model: Model, docs: list[np.ndarray], end: int) -> Iterator[tuple]:
    """Inputs by step, targets and lanes of each window. Each document begins after an end."""
    order, flat, starts = _lanes(docs)
    lengths = np.array([len(docs[k]) for k in order])
    longest = int(lengths.max(initial=0))
    for t0 in range(0, longest, WINDOW):
        inputs, targets, lanes = [], [], []
        for t in range(t0, min(t0 + WINDOW, longest)):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # documents longer than t
            at = starts[:n] + t
            inputs.append(flat[at - 1] if t else np.full(n, end))
            targets.append(flat[at])
            lanes.append(order[:n])
        yield inputs, np.concatenate(targets), np.concatenate(lanes)


def train(trainer: Trainer, docs: list[np.ndarray], end: int, lanes: int = LANES) -> tuple[float, int]:
    """One pass over documents (arrays of word ids that finish with an end).

    Returns the sum of the log-probabilities and the number of words.
    """
    total, n = 0.0, 0
    by_length = sorted(range(len(docs)), key=lambda k: len(docs[k]))
    groups = [by_length[i : i + lanes] for i in range(0, len(by_length), lanes)]
    for k in np.random.default_rng(len(docs)).permutation(len(groups)):
        some = [docs[i] for i in groups[k]]
        h = np.zeros((len(some), HIDDEN), np.float32)
        for inputs, targets, _ in _windows(trainer.model, some, end):
            total += trainer.window(inputs, targets, h)
            n += len(targets)
    return total, n


class _Reader:
    """Reads words without keeping a way back; the weights of each gate lie by themselves."""

    def __init__(self, model: Model) -> None:
        self.model = model
        gates = [slice(k * HIDDEN, (k + 1) * HIDDEN) for k in range(3)]
        # What a word adds to each gate, worked out once for all words.
        self.given = [model.E @ np.ascontiguousarray(model.Wx[:, k]) + model.b[k] for k in gates]
        self.U = [np.ascontiguousarray(model.U[:, k]) for k in gates[:2]]

    def states(self, inputs: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        """The states after the inputs, step by step. ``h`` holds those before and is moved on."""
        ids = np.concatenate(inputs)
        gates = [given[ids] for given in self.given]
        out = np.empty((len(ids), HIDDEN), np.float32)
        at = 0
        for some in inputs:
            n = len(some)
            before = h[:n]
            r, z, c = (g[at : at + n] for g in gates)
            for gate, weights in ((r, self.U[0]), (z, self.U[1])):
                gate += before @ weights
                np.negative(gate, out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
            r *= before
            c += r @ self.model.V
            np.tanh(c, out=c)
            now = np.subtract(before, c, out=out[at : at + n])
            now *= z
            now += c
            before[:] = now
            at += n
        return out

    def logs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target, words outside the vocabulary as one class."""
        m = self.model
        last = len(m.edges) - 1
        classes = np.full(len(targets), last, np.int16)
        inside = targets < m.words
        classes[inside] = m.class_of[targets[inside]]
        order = np.argsort(classes, kind="stable")
        states, targets, classes = states[order], targets[order], classes[order]
        borders = np.searchsorted(classes, np.arange(last + 1))
        found = _picked(m.Wc.T, m.bc, states, classes)
        for k in range(last):
            rows, words = slice(borders[k], borders[k + 1]), slice(m.edges[k], m.edges[k + 1])
            if rows.start < rows.stop and words.stop - words.start > 1:
                found[rows] += _picked(m.Ww[words], m.bw[words], states[rows], targets[rows] - words.start)
        out = np.empty(len(targets))
        out[order] = found
        return out


def _picked(weights: np.ndarray, bias: np.ndarray, states: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Log-softmax of the wanted one of the outputs. A state is a column here, so sums run along memory."""
    x = weights @ states.T
    x += bias[:, None]
    x -= np.maximum.reduce(x, 0)
    logs = x[wanted, np.arange(len(wanted))].astype(np.float64)
    np.exp(x, out=x)
    logs -= np.log(np.add.reduce(x, 0))
    return logs


def log_likelihoods(model: Model, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-probability of each document, words outside the vocabulary as one class."""
    out = np.zeros(len(docs))
    reader = _Reader(model)
    by_length = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
    waiting, words = [], 0

    def settle() -> None:
        states, targets, lanes = (np.concatenate(x) for x in zip(*waiting, strict=True))
        out[:] += np.bincount(lanes, reader.logs(states, targets), len(docs))
        waiting.clear()

    for i in range(0, len(docs), SCORED_LANES):
        group = np.array(by_length[i : i + SCORED_LANES])
        h = np.zeros((len(group), HIDDEN), np.float32)
        for inputs, targets, lanes in _windows(model, [docs[k] for k in group], end):
            waiting.append((reader.states(inputs, h), targets, group[lanes]))
            words += len(targets)
            if words >= SCORED_WORDS:
                settle()
                words = 0
    if waiting:
        settle()
    return out
