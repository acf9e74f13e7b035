"""A small bidirectional GRU with attention pooling, in numpy: forward, backward and Adam.

Arrays are (features, steps * batch) with the steps outermost, so that every operation of a step runs over
contiguous rows of the whole batch.
"""
from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def init(words: int, chars: int, word_dim: int, char_dim: int, hidden: int, attention: int, seed: int) -> Params:
    rng = np.random.default_rng(seed)
    x = word_dim + char_dim

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {"word": draw(word_dim, words, scale=0.1), "char": draw(char_dim, chars, scale=0.3),
            "in": draw(6 * hidden, x, scale=x ** -0.5), "bias": np.zeros((6 * hidden, 1), np.float32),
            "fwd": draw(3 * hidden, hidden, scale=hidden ** -0.5), "bwd": draw(3 * hidden, hidden, scale=hidden ** -0.5),
            "att": draw(attention, 2 * hidden, scale=(2 * hidden) ** -0.5), "att_v": draw(1, attention, scale=0.5),
            "out": draw(1, 2 * hidden, scale=(2 * hidden) ** -0.5), "out_b": np.full((1, 1), -1.0, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.multiply(x, np.float32(0.5))
    np.tanh(x, out=x)
    x += 1
    x *= np.float32(0.5)
    return x


def _run(gates: np.ndarray, u: np.ndarray, steps: range, batch: int, mask: np.ndarray | None,
         out: np.ndarray, cache: list | None) -> None:
    """One direction. gates: (3h, steps * batch); out: (h, steps * batch) gets the states."""
    h = u.shape[1]
    state = np.zeros((h, batch), np.float32)
    for t in steps:
        at = slice(t * batch, (t + 1) * batch)
        g = gates[:, at]
        inner = u @ state
        zr = _sigmoid(g[:2 * h] + inner[:2 * h])
        z, r = zr[:h], zr[h:]
        n = np.multiply(r, inner[2 * h:])
        n += g[2 * h:]
        np.tanh(n, out=n)
        new = state - n
        new *= z
        new += n
        if mask is not None:
            new = state + mask[t] * (new - state)
        if cache is not None:
            cache.append((t, state, z, r, n, inner[2 * h:]))
        out[:, at] = new
        state = new


def forward(p: Params, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """x: (inputs, steps * batch); mask: (steps, batch), 1 where there is a word, at the front of each column. Returns
    the logit of every column, and with ``keep`` what backward() needs."""
    steps, batch = mask.shape
    h = p["fwd"].shape[1]
    gates = p["in"] @ x
    gates += p["bias"]
    full = None if mask.all() else mask
    states = np.empty((2 * h, steps * batch), np.float32)
    caches: tuple[list, list] | None = ([], []) if keep else None
    _run(gates[:3 * h], p["fwd"], range(steps), batch, full, states[:h], caches and caches[0])
    _run(gates[3 * h:], p["bwd"], range(steps - 1, -1, -1), batch, full, states[h:], caches and caches[1])
    hidden = np.tanh(p["att"] @ states)
    energy = (p["att_v"] @ hidden).reshape(steps, batch)
    energy = np.where(mask > 0, energy, np.float32(-1e9))
    weight = np.exp(energy - energy.max(0))
    weight /= weight.sum(0)
    pooled = (states * weight.reshape(1, -1)).reshape(2 * h, steps, batch).sum(1)
    logit = (p["out"] @ pooled + p["out_b"])[0]
    return (logit, (states, hidden, weight, pooled, caches)) if keep else logit


def backward(p: Params, x: np.ndarray, mask: np.ndarray, kept: tuple, d_logit: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the parameters other than the embeddings, and of x."""
    states, hidden, weight, pooled, caches = kept
    steps, batch = mask.shape
    h = p["fwd"].shape[1]
    grad: Params = {"out": d_logit[None] @ pooled.T, "out_b": np.array([[d_logit.sum()]], np.float32)}
    d_pooled = p["out"].T @ d_logit[None]
    spread = np.tile(d_pooled, (1, steps))
    d_states = spread * weight.reshape(1, -1)
    d_weight = (states * spread).sum(0).reshape(steps, batch)
    d_energy = weight * (d_weight - (weight * d_weight).sum(0))
    d_energy = d_energy.reshape(1, -1)
    grad["att_v"] = d_energy @ hidden.T
    d_hidden = (p["att_v"].T @ d_energy) * (1 - hidden * hidden)
    grad["att"] = d_hidden @ states.T
    d_states += p["att"].T @ d_hidden
    d_gates = np.empty((6 * h, steps * batch), np.float32)
    for half, (name, cache) in enumerate(zip(("fwd", "bwd"), caches, strict=True)):
        u = p[name]
        d_u = np.zeros_like(u)
        carried = np.zeros((h, batch), np.float32)
        for t, state, z, r, n, inner_n in reversed(cache):
            at = slice(t * batch, (t + 1) * batch)
            total = d_states[half * h:(half + 1) * h, at] + carried
            inside = total * mask[t]
            d_n = inside * (1 - z) * (1 - n * n)
            d_z = inside * (state - n) * z * (1 - z)
            d_r = d_n * inner_n * r * (1 - r)
            d_gates[half * 3 * h:half * 3 * h + h, at] = d_z
            d_gates[half * 3 * h + h:half * 3 * h + 2 * h, at] = d_r
            d_gates[half * 3 * h + 2 * h:half * 3 * h + 3 * h, at] = d_n
            d_inner = np.concatenate([d_z, d_r, d_n * r])
            d_u += d_inner @ state.T
            carried = total * (1 - mask[t]) + inside * z + u.T @ d_inner
        grad[name] = d_u
    grad["in"] = d_gates @ x.T
    grad["bias"] = d_gates.sum(1, keepdims=True)
    return grad, p["in"].T @ d_gates


class Adam:
    def __init__(self, p: Params, rate: float) -> None:
        self.p, self.rate, self.step = p, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in p.items()}
        self.square = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, grad: Params) -> None:
        self.step += 1
        rate = self.rate * (1 - 0.999 ** self.step) ** 0.5 / (1 - 0.9 ** self.step)
        for k, g in grad.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            self.p[k] -= (rate * self.mean[k] / (np.sqrt(self.square[k]) + 1e-7)).astype(np.float32)
