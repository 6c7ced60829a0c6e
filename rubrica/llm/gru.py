"""A small bidirectional gated recurrent layer in numpy, with backpropagation through time.

Arrays are laid out (features, sequences) so that every gate is one contiguous block.
Sequences are rows of equal length; a mask marks what is padding.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def sum_rows(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` that share an index, as n rows."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        at = index[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[starts]] = np.add.reduceat(values[order], starts)
    return out


class Adam:
    """Adam over a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = {k: np.zeros_like(w) for k, w in weights.items()}
        self.square = {k: np.zeros_like(w) for k, w in weights.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            g = g * clip
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            self.weights[k] -= self.rate * fix * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)


def new_direction(inputs: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Weights of one direction: ``W`` (3 hidden, inputs), ``U`` (3 hidden, hidden), ``b``; gates z, r, n."""
    return {
        "W": rng.normal(0, 1 / np.sqrt(inputs), (3 * hidden, inputs)).astype(np.float32),
        "U": rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32),
        "b": np.zeros((3 * hidden, 1), np.float32),
    }


def forward(projected, U: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """States (steps, hidden, sequences) for ``projected(t)`` (3 hidden, sequences), which holds W x + b.

    A state passes over padding unchanged.  With ``keep`` also what the backward pass needs.
    """
    hidden = U.shape[1]
    gates, candidate = U[: 2 * hidden], U[2 * hidden :]
    states, kept, h = [], [], None
    steps = projected.steps
    # Most steps are padding for no sequence.
    whole = None if mask is None else mask.all(axis=1).tolist()
    for t in range(steps):
        a = projected(t)
        if h is None:
            h = np.zeros((hidden, a.shape[1]), np.float32)
        zr = a[: 2 * hidden] + gates @ h
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr[:hidden], zr[hidden:]
        rh = r * h
        n = candidate @ rh
        n += a[2 * hidden :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if mask is not None and not whole[t]:
            np.copyto(new, h, where=~mask[t])
        if keep:
            kept.append((h, zr, rh, n))
        h = new
        states.append(h)
    return (states, kept) if keep else states


def backward(d_states, kept, U: np.ndarray, mask: np.ndarray):
    """Gradients of U and of every step's projection, from those of the states."""
    hidden = U.shape[1]
    gates, candidate = U[: 2 * hidden], U[2 * hidden :]
    dU = np.zeros_like(U)
    d_projected = [None] * len(kept)
    dh = np.zeros_like(kept[0][0])
    for t in range(len(kept) - 1, -1, -1):
        h, zr, rh, n = kept[t]
        z, r = zr[:hidden], zr[hidden:]
        dh = dh + d_states[t]
        d_new = np.where(mask[t], dh, 0)
        passed = dh - d_new
        dz = d_new * (h - n) * z * (1 - z)
        dn = d_new * (1 - z) * (1 - n * n)
        drh = candidate.T @ dn
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr])
        dU[: 2 * hidden] += dzr @ h.T
        dU[2 * hidden :] += dn @ rh.T
        d_projected[t] = np.concatenate([dzr, dn])
        dh = passed + d_new * z + drh * r + gates.T @ dzr
    return dU, d_projected


class Lookup:
    """Projections by table: column ``codes[t]`` of a (3 hidden, symbols) table."""

    def __init__(self, by_symbol: np.ndarray, codes: np.ndarray, reverse: bool = False):
        self.by_symbol, self.codes, self.reverse, self.steps = by_symbol, codes, reverse, len(codes)

    def __call__(self, t: int) -> np.ndarray:
        return np.take(self.by_symbol, self.codes[self.steps - 1 - t if self.reverse else t], axis=1)
