"""Small recurrent networks in numpy: bidirectional GRU and LSTM layers with their gradients, and Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def init_cell(rng: np.random.Generator, kind: str, inputs: int, hidden: int, name: str) -> dict[str, np.ndarray]:
    """Weights of one direction; ``kind`` is gru (update, reset, candidate) or lstm (input, forget, candidate, output)."""
    gates = {"gru": 3, "lstm": 4}[kind]
    draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    bias = np.zeros(gates * hidden, np.float32)
    if kind == "lstm":
        bias[hidden : 2 * hidden] = 1
    return {f"{name}x": draw(inputs, gates * hidden), f"{name}h": draw(hidden, gates * hidden), f"{name}b": bias}


def run(kind: str, ax: np.ndarray, wh: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (N, T, H) for projected inputs ``ax`` (N, T, G*H); a masked step leaves the state as it is. ``keep`` gathers what ``back`` needs."""
    n, t, g = ax.shape
    hidden = wh.shape[0]
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    out = np.empty((n, t, hidden), np.float32)
    for s in range(t):
        a, m = ax[:, s], mask[:, s, None]
        if kind == "gru":
            u = h @ wh
            zr = sigmoid(a[:, : 2 * hidden] + u[:, : 2 * hidden])
            z, r = zr[:, :hidden], zr[:, hidden:]
            cand = np.tanh(a[:, 2 * hidden :] + r * u[:, 2 * hidden :])
            new = cand + z * (h - cand)
            if keep is not None:
                keep.append((h, z, r, cand, u[:, 2 * hidden :]))
        else:
            u = a + h @ wh
            gates = sigmoid(u)
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 3 * hidden :]
            cand = np.tanh(u[:, 2 * hidden : 3 * hidden])
            cell = f * c + i * cand
            squashed = np.tanh(cell)
            new = o * squashed
            if keep is not None:
                keep.append((h, c, i, f, cand, o, squashed))
            c = c + m * (cell - c)
        h = h + m * (new - h)
        out[:, s] = h
    return out


def back(kind: str, dout: np.ndarray, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of (wx, wh, bias, x) for ``dout``, the gradient of the states."""
    n, t, hidden = dout.shape
    da = np.zeros((n, t, wh.shape[1]), np.float32)
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    for s in range(t - 1, -1, -1):
        m = mask[:, s, None]
        dh = dh + dout[:, s]
        dnew, stay = dh * m, dh * (1 - m)
        if kind == "gru":
            h, z, r, cand, u = kept[s]
            dcand = dnew * (1 - z) * (1 - cand * cand)
            dz = dnew * (h - cand) * z * (1 - z)
            dr = dcand * u * r * (1 - r)
            da[:, s] = np.concatenate([dz, dr, dcand], axis=1)
            du = np.concatenate([dz, dr, dcand * r], axis=1)
            dwh += h.T @ du
            dh = stay + dnew * z + du @ wh.T
        else:
            h, c, i, f, cand, o, squashed = kept[s]
            dcell = dc * m + dnew * o * (1 - squashed * squashed)
            du = np.concatenate([dcell * cand * i * (1 - i), dcell * c * f * (1 - f), dcell * i * (1 - cand * cand), dnew * squashed * o * (1 - o)], axis=1)
            da[:, s] = du
            dwh += h.T @ du
            dc = dc * (1 - m) + dcell * f
            dh = stay + du @ wh.T
    flat = da.reshape(n * t, -1)
    return x.reshape(n * t, -1).T @ flat, dwh, flat.sum(axis=0), da @ wx.T


def bidirectional(kind: str, w: dict, x: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """States of both directions, side by side (N, T, 2H)."""
    f = run(kind, x @ w["fx"] + w["fb"], w["fh"], mask, kept.setdefault("f", []) if kept is not None else None)
    r = run(kind, (x @ w["rx"] + w["rb"])[:, ::-1], w["rh"], mask[:, ::-1], kept.setdefault("r", []) if kept is not None else None)
    return np.concatenate([f, r[:, ::-1]], axis=2)


def bidirectional_back(kind: str, w: dict, dout: np.ndarray, x: np.ndarray, mask: np.ndarray, kept: dict) -> tuple[dict, np.ndarray]:
    """Gradients by name of weight, and that of the inputs."""
    hidden = w["fh"].shape[0]
    g = {}
    g["fx"], g["fh"], g["fb"], forward = back(kind, dout[:, :, :hidden], x, w["fx"], w["fh"], mask, kept["f"])
    g["rx"], g["rh"], g["rb"], reverse = back(kind, dout[:, ::-1, hidden:], x[:, ::-1], w["rx"], w["rh"], mask[:, ::-1], kept["r"])
    return g, forward + reverse[:, ::-1]


class Adam:
    def __init__(self, rate: float = 0.01):
        self.rate, self.step, self.m, self.v = rate, 0, {}, {}

    def update(self, w: dict, g: dict) -> None:
        self.step += 1
        for k, d in g.items():
            d = np.clip(d, -5, 5)
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * d
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * d * d
            w[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)).astype(w[k].dtype)
