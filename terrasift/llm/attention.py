"""A small causal self-attention model over subword classes, in numpy.

Weights of attention and of classes are (1 + z / 16) ** 16 in place of exp(z), which that is close to for small z: four
multiplications instead of an exponential. Normalised by their sum they are a distribution just as well, and training
uses the same function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

F32 = np.float32


@dataclass
class Shape:
    """classes: of the output; inputs: kinds of positions seen (as many as classes, if 0), and after them the start; window:
    positions seen at once; stride: of them, those scored (a text's first window scores all of its own), so that each has
    window - stride before it at least."""

    classes: int = 128
    inputs: int = 0
    dims: int = 16
    hidden: int = 32
    window: int = 32
    stride: int = 16


def start(shape: Shape) -> int:
    """The input that a text's first position follows."""
    return shape.inputs or shape.classes


def fresh(shape: Shape, prior: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Random parameters; the output starts at the classes' frequencies. Inputs are one more: the start."""
    rng, d = np.random.default_rng(seed), shape.dims
    p = {"embed": rng.normal(0, 0.5, (start(shape) + 1, d)), "place": rng.normal(0, 0.1, (shape.window, d)), "out": rng.normal(0, 0.02, (d, shape.classes)), "bias": 16 * (np.maximum(prior, 1e-12) ** (1 / 16) - 1)}
    p |= {"q": rng.normal(0, d**-0.5, (d, d)), "k": rng.normal(0, d**-0.5, (d, d)), "v": rng.normal(0, d**-0.5, (d, d))}
    p |= {"up": rng.normal(0, d**-0.5, (2 * d, shape.hidden)), "up_bias": np.zeros(shape.hidden), "down": rng.normal(0, 0.05, (shape.hidden, d))}
    return {k: x.astype(F32) for k, x in p.items()}


def bounded(base: np.ndarray) -> bool:
    """Keeps 1 + z / 16 from 0, in place; whether any was."""
    low = base.dtype.type(0.02)
    if base.size == 0 or base.min() > low:
        return False
    np.maximum(base, low, out=base)
    return True


def sixteenth(base: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """base ** 16."""
    out = np.multiply(base, base, out=out)
    for _ in range(3):
        out *= out
    return out


def steep(g: np.ndarray, base: np.ndarray, cut: bool) -> np.ndarray:
    """g times the derivative of the logarithm of (1 + z / 16) ** 16 by z, in place: 1 / base, and 0 where the base was kept from 0."""
    g /= base
    if cut:
        g[base <= base.dtype.type(0.02)] = 0
    return g


def forward(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False, first: int = 0):
    """Hidden states of windows of input classes, (windows, window - first, dims), of the positions from first on; with keep,
    what backward() needs."""
    b, w = x.shape
    e = p["embed"][x]
    e += p["place"][:w]
    d = e.shape[2]
    flat = e.reshape(b * w, d)
    # Queries come with the scale of the products and their sixteenth.
    small = p["q"] * p["q"].dtype.type(d**-0.5 / 16)
    if first:
        own = np.ascontiguousarray(e[:, first:]).reshape(b * (w - first), d)
        q = (own @ small).reshape(b, w - first, d)
        kv = (flat @ np.hstack((p["k"], p["v"]))).reshape(b, w, 2 * d)
        k, v = kv[:, :, :d], kv[:, :, d:]
    else:
        own = flat
        qkv = (flat @ np.hstack((small, p["k"], p["v"]))).reshape(b, w, 3 * d)
        q, k, v = qkv[:, :, :d], qkv[:, :, d : 2 * d], qkv[:, :, 2 * d :]
    base = q @ k.transpose(0, 2, 1)
    base += base.dtype.type(1)
    cut = bounded(base)
    a = sixteenth(base, None if keep else base)
    a *= np.tril(np.ones((w, w), a.dtype))[first:]
    a /= a.sum(axis=2, keepdims=True)
    both = np.concatenate((own, (a @ v).reshape(len(own), d)), axis=1)
    up = both @ p["up"]
    up += p["up_bias"]
    np.maximum(up, 0, out=up)
    h = up @ p["down"]
    h += both[:, :d]
    h += both[:, d:]
    return (h, (x, q, k, v, a, base, cut, both, up)) if keep else h


def log_probs(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Natural logs of the targets' class probabilities, from their hidden states, a few rows at a time: they stay in cache.
    As many each time, with rows of 0 after the last, so that a row's result is the same to the last bit beside any others."""
    kind = h.dtype.type
    out, weights, bias = np.empty(len(target)), p["out"] * kind(1 / 16), p["bias"] * kind(1 / 16) + kind(1)
    ones = np.ones(weights.shape[1], h.dtype)
    for a in range(0, len(target), rows):
        part, t = h[a : a + rows], target[a : a + rows]
        if len(t) < rows:
            part = np.concatenate((part, np.zeros((rows - len(t), part.shape[1]), part.dtype)))
        z = part @ weights
        z += bias
        bounded(z)
        sixteenth(z, z)
        out[a : a + rows] = np.log(z[np.arange(len(t)), t]) - np.log(z @ ones)[: len(t)]
    return out


def summed(x: np.ndarray, rows: np.ndarray, like: np.ndarray) -> np.ndarray:
    """As many rows as like has: each the sum of the rows that x names it for."""
    d = like.shape[1]
    at = x.astype(np.int64)[:, None] * d + np.arange(d)
    return np.bincount(at.ravel(), weights=rows.ravel(), minlength=like.size).reshape(like.shape).astype(like.dtype)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the real targets and its gradients."""
    h, (x, q, k, v, a, near, near_cut, both, up) = forward(p, x, keep=True)
    b, w = x.shape
    d, kind = h.shape[1], h.dtype.type
    base = h @ (p["out"] * kind(1 / 16))
    base += p["bias"] * kind(1 / 16) + kind(1)
    cut = bounded(base)
    dz = sixteenth(base)
    rows, t, n = np.arange(b * w), y.ravel(), max(1, int(real.sum()))
    total, weight = dz @ np.ones(dz.shape[1], dz.dtype), (real.ravel() / n).astype(dz.dtype)
    loss = -float((np.log(dz[rows, t] / total + 1e-20) * real.ravel()).sum()) / n
    dz *= (weight / total)[:, None]
    dz[rows, t] -= weight
    steep(dz, base, cut)
    g = {"out": h.T @ dz, "bias": np.ones(len(dz), dz.dtype) @ dz}
    dh = dz @ p["out"].T
    du = dh @ p["down"].T
    du *= up > 0
    g |= {"down": up.T @ dh, "up": both.T @ du, "up_bias": np.ones(len(du), du.dtype) @ du}
    dboth = du @ p["up"].T
    flat = both[:, :d]
    dflat = dh + dboth[:, :d]
    do = (dh + dboth[:, d:]).reshape(b, w, d)
    da, dv = do @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ do
    da -= np.einsum("bij,bij->bi", da, a)[:, :, None]
    da *= a
    steep(da, near, near_cut)
    # q was scaled by d ** -0.5 / 16: of the products' gradients what k takes lacks the 16, and what q takes the root.
    dq, dk = da @ k, da.transpose(0, 2, 1) @ q
    dq *= kind(d**-0.5)
    dk *= kind(16)
    for name, grad in (("q", dq), ("k", dk), ("v", dv)):
        grad = grad.reshape(b * w, d)
        g[name] = flat.T @ grad
        dflat += grad @ p[name].T
    g["embed"] = summed(x.ravel(), dflat, p["embed"])
    g["place"] = np.zeros_like(p["place"])
    g["place"][:w] = dflat.reshape(b, w, d).sum(axis=0)
    return loss, g


def train(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, real: np.ndarray, batch: int, rate: float, seed: int, steps: int = 1) -> dict[str, np.ndarray]:
    """Adam over shuffled windows, once over all, or so often that it makes `steps` steps at least."""
    p, rng = {k: v.copy() for k, v in p.items()}, np.random.default_rng(seed)
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    steps = max(steps, -(-len(x) // batch))
    order = np.concatenate([rng.permutation(len(x)) for _ in range(-(-steps * batch // len(x)))])
    for t in range(1, steps + 1):
        at = order[(t - 1) * batch : t * batch]
        _, g = gradients(p, x[at], y[at], real[at])
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        pace = rate * min(1, 1 / max(size, 1e-9)) if size > 1 else rate
        pace *= 1 - 0.9 * t / steps
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
            p[k] -= (pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(F32)
    return p


def windows(bounds: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of several texts start, in the row of their positions, and how many positions of each were scored
    before: bounds has where each text begins, and the end. A text's windows start `stride` apart."""
    size = np.diff(bounds)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - shape.window) // shape.stride)), 0)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(bounds[:-1], count) + number * shape.stride, np.where(number > 0, shape.window - shape.stride, 0)


def score(p: dict[str, np.ndarray], inputs: np.ndarray, classes: np.ndarray, bounds: np.ndarray, shape: Shape, batch: int = 128) -> np.ndarray:
    """Natural log of each position's class probability, every position once, given the inputs its window has before it."""
    out, none = np.zeros(len(classes), np.float64), start(shape)
    begin, scored = windows(bounds, shape)
    ends = bounds[np.searchsorted(bounds, begin, side="right")]
    before = np.r_[none, inputs, np.full(shape.window, none)]
    before[bounds[:-1][np.diff(bounds) > 0]] = none  # a text's first position follows the start
    step = np.arange(shape.window)
    # Positions that the window before has scored are looked at, but not worked out again.
    for first in np.unique(scored).tolist():
        of, own = np.flatnonzero(scored == first), step[first:]
        for a in range(0, len(of), batch):
            real = len(of[a : a + batch])
            n = of[np.minimum(np.arange(a, a + batch), len(of) - 1)]  # always as many, as in log_probs()
            at = begin[n, None] + own
            h = forward(p, before[begin[n, None] + step], first=first)
            take = at < ends[n, None]
            take[real:] = False
            take = take.ravel()
            place = at.ravel()[take]
            out[place] = log_probs(p, h if take.all() else h[take], classes[place])
    return out
