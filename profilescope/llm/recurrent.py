"""A gated recurrent language model in numpy, with a class-factored output.

A token's input is a row of a table (the product of its one-hot vector and the gates' input weights). The
probability of the next token is P(class | state) * P(token | class, state); classes are runs of ``CLASS`` tokens in
order of frequency, so a token costs two short soft maxes. Training truncates back-propagation to windows of
``WINDOW`` tokens; the state, without its gradient, is carried from window to window until the document ends.
Weights are kept in fixed ranges, in which no exponential can overflow.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

HIDDEN, CLASS, WINDOW, STREAMS = 16, 64, 16, 64
RATE = 0.15
#: Documents that are scored in step.
ABREAST = 512
_LARGEST_WEIGHT, _LARGEST_BIAS = 2.0, 25.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.multiply(x, np.float32(0.5))
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


class GatedModel:
    """Tokens are 0 .. tokens-1 in order of frequency; ``shares`` are their smoothed corpus probabilities."""

    NAMES = ("table", "recurrent", "class_out", "class_bias", "token_out", "token_bias")

    def __init__(self, shares: np.ndarray, seed: int = 7) -> None:
        self.tokens = len(shares)
        self.classes = -(-self.tokens // CLASS)
        rng, h, width = np.random.default_rng(seed), HIDDEN, self.classes * CLASS
        padded = np.concatenate([shares, np.zeros(width - self.tokens)]).reshape(self.classes, CLASS)
        by_class = padded.sum(1)
        with np.errstate(divide="ignore"):
            inside = np.log(padded / by_class[:, None])
        self.table = rng.normal(0, 0.3, (width, 3 * h)).astype(np.float32)
        self.recurrent = rng.normal(0, 0.2, (h, 3 * h)).astype(np.float32)
        self.class_out = np.zeros((h, self.classes), np.float32)
        self.class_bias = np.log(by_class).astype(np.float32)
        self.token_out = np.zeros((self.classes, h, CLASS), np.float32)
        self.token_bias = np.maximum(inside, -80.0).astype(np.float32)
        self.real = padded > 0
        self.squares: dict[str, np.ndarray] = {}

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> GatedModel:
        at = 0
        for n in self.NAMES:
            a = getattr(self, n)
            setattr(self, n, flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return self

    def step(self, state: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self._after(state, self.table[ids])

    def _after(self, state: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The state after tokens whose rows of the table are ``x``."""
        h = HIDDEN
        u = state @ self.recurrent
        gates = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = r * u[:, 2 * h :]
        new += x[:, 2 * h :]
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((gates, new, u))
        after = state - new
        after *= z
        after += new
        return after

    def log_probabilities(self, states: np.ndarray, ids: np.ndarray, gradient: dict | None = None) -> np.ndarray:
        """Natural logarithm of each id's probability in its state; with ``gradient``, the gradients of their
        negative sum are put there, that of the states as "states"."""
        classes = ids // CLASS
        energy = np.exp(states @ self.class_out + self.class_bias)
        total = energy.sum(1)
        rows = np.arange(len(ids))
        result = np.log(energy[rows, classes] / total)
        if gradient is not None:
            energy /= total[:, None]
            energy[rows, classes] -= 1
            gradient["class_out"], gradient["class_bias"] = states.T @ energy, energy.sum(0)
            d_states = energy @ self.class_out.T
            d_out, d_bias = np.zeros_like(self.token_out), np.zeros_like(self.token_bias)
        # Ids of a class stand together: a matrix product per class, all else for all of them at once.
        order = np.argsort(classes, kind="stable")
        ends = np.searchsorted(classes[order], np.arange(self.classes + 1)).tolist()
        runs = [(c, ends[c], ends[c + 1]) for c in range(self.classes) if ends[c] < ends[c + 1]]
        some, inside = states[order], ids[order] % CLASS
        energy = np.empty((len(ids), CLASS), np.result_type(states, self.token_out))
        for c, i, j in runs:
            np.matmul(some[i:j], self.token_out[c], out=energy[i:j])
        energy += self.token_bias[classes[order]]
        np.exp(energy, out=energy)
        total = energy.sum(1)
        result[order] += np.log(energy[rows, inside] / total)
        if gradient is not None:
            energy /= total[:, None]
            energy[rows, inside] -= 1
            back = np.empty_like(some)
            for c, i, j in runs:
                np.matmul(some[i:j].T, energy[i:j], out=d_out[c])
                np.add.reduce(energy[i:j], axis=0, out=d_bias[c])
                np.matmul(energy[i:j], self.token_out[c].T, out=back[i:j])
            d_states[order] += back
        if gradient is not None:
            gradient["token_out"], gradient["token_bias"] = d_out, d_bias * self.real
            gradient["states"] = d_states
        return result

    def learn(self, window: np.ndarray, starts: np.ndarray, state: np.ndarray) -> np.ndarray:
        """One step on a window of (time, stream) ids; ``starts`` marks first tokens of documents.

        Returns the state to carry on.
        """
        h, (length, streams) = HIDDEN, window.shape
        kept: list = []
        before = np.empty((length, streams, h), np.float32)
        marked, inputs = starts.any(1).tolist(), self.table[window]
        for t in range(length):
            if marked[t]:
                state = np.where(starts[t][:, None], np.float32(0), state)
            before[t] = state
            state = self._after(state, inputs[t], kept)
        gradient: dict = {}
        self.log_probabilities(before.reshape(-1, h), window.ravel(), gradient)
        d_seen = gradient.pop("states").reshape(length, streams, h)
        d_state = np.zeros((streams, h), np.float32)
        d_table = np.empty((length, streams, 3 * h), np.float32)
        d_above = np.empty_like(d_table)
        d_recurrent = np.zeros_like(self.recurrent)
        new = np.stack([k[1] for k in kept])
        rest, slope, gap = 1 - np.stack([k[0] for k in kept]), 1 - new * new, before - new
        carried = [k[2][:, 2 * h :] for k in kept]
        for t in range(length - 1, -1, -1):
            gates, d_gates, d_u = kept[t][0], d_table[t], d_above[t]
            d_new = np.multiply(d_state, rest[t, :, :h], out=d_gates[:, 2 * h :])
            d_new *= slope[t]
            # Of both gates at once: what each scales, times the slope of its sigmoid.
            np.multiply(d_state, gap[t], out=d_u[:, :h])
            np.multiply(d_new, carried[t], out=d_u[:, h : 2 * h])
            d_u[:, : 2 * h] *= gates
            d_u[:, : 2 * h] *= rest[t]
            d_gates[:, : 2 * h] = d_u[:, : 2 * h]
            np.multiply(d_new, gates[:, h:], out=d_u[:, 2 * h :])
            d_recurrent += before[t].T @ d_u
            d_state = d_state * gates[:, :h]
            d_state += d_u @ self.recurrent.T
            d_state += d_seen[t]
            if marked[t]:
                d_state[starts[t]] = 0
        gradient["recurrent"] = d_recurrent
        ids = window.ravel()
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
        rows = np.add.reduceat(d_table.reshape(-1, 3 * h)[order], first)
        self._update("table", rows / streams, ids[order][first])
        for name, g in gradient.items():
            self._update(name, g / streams, None)
        return state

    def _update(self, name: str, g: np.ndarray, rows: np.ndarray | None) -> None:
        """AdaGrad on a whole parameter or on some of its rows."""
        value = getattr(self, name)
        if name not in self.squares:
            self.squares[name] = np.full(value.shape, 1e-3, np.float32)
        squares = self.squares[name]
        np.clip(g, -1, 1, out=g)
        if rows is None:
            squares += g * g
            now, seen = value, squares
        else:
            seen = squares[rows] + g * g
            squares[rows] = seen
            now = value[rows]
        g *= np.float32(RATE)
        g /= np.sqrt(seen)
        if name.endswith("bias"):
            changed = now - g
            now = np.where(now > -_LARGEST_BIAS, np.clip(changed, -_LARGEST_BIAS + 1, _LARGEST_BIAS), now)
        else:
            changed = np.subtract(now, g, out=g)
            now = np.clip(changed, -_LARGEST_WEIGHT, _LARGEST_WEIGHT, out=changed)
        value[slice(None) if rows is None else rows] = now

    def train(self, documents: Sequence[np.ndarray], streams: int = STREAMS) -> int:
        """One pass over documents laid end to end in ``streams`` rows; returns the number of tokens."""
        if not documents:
            return 0
        ids = np.concatenate(documents)
        starts = np.zeros(len(ids), dtype=bool)
        starts[np.cumsum([0, *map(len, documents[:-1])])] = True
        streams = max(1, min(streams, len(ids) // WINDOW))
        length = len(ids) // streams
        rows = ids[: streams * length].reshape(streams, length).T
        marks = starts[: streams * length].reshape(streams, length).T.copy()
        marks[0] = True
        state = np.zeros((streams, HIDDEN), np.float32)
        for t in range(0, length, WINDOW):
            state = self.learn(rows[t : t + WINDOW], marks[t : t + WINDOW], state)
        return streams * length

    def score(self, documents: Sequence[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of whole documents, the state carried through every window of each."""
        result = np.zeros(len(documents))
        by_length = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        for first in range(0, len(by_length), ABREAST):
            some = by_length[first : first + ABREAST]
            lengths = np.array([len(documents[i]) for i in some])
            state = np.zeros((len(some), HIDDEN), np.float32)
            scores = np.zeros(len(some))
            for t in range(0, int(lengths[0]), WINDOW):
                live = int(np.searchsorted(-lengths, -t, side="left"))  # lengths above t
                block = np.zeros((WINDOW, live), dtype=np.int64)
                for j in range(live):
                    part = documents[some[j]][t : t + WINDOW]
                    block[: len(part), j] = part
                inputs = self.table[block]
                states, ids, owner = [], [], []
                for s in range(min(WINDOW, int(lengths[0]) - t)):
                    n = int(np.searchsorted(-lengths, -(t + s), side="left"))
                    states.append(state[:n])
                    ids.append(block[s, :n])
                    owner.append(np.arange(n))
                    state = self._after(state[:n], inputs[s, :n])
                found = self.log_probabilities(np.concatenate(states), np.concatenate(ids))
                scores[:live] += np.bincount(np.concatenate(owner), weights=found, minlength=live)
            result[some] = scores
        return result
