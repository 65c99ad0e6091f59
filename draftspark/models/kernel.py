"""RBF support vector machines over a Nyström feature map.

The kernel of all pairs of rows is replaced by the kernel with ``LANDMARKS`` rows:
``phi(x) = K(x, L) K(L, L)^(-1/2)``.  With no more training rows than landmarks
that is the exact kernel machine.  The primal problem

    |w|^2 / 2 + C * sum of positive parts

has one part a row for the hinge (``1 - y f(x)``) and two for the insensitive loss
(``|y - f(x)| - epsilon``).  The corner of the positive part is rounded over a
width that shrinks step by step, and each step is solved by Newton's method, whose
gradient and Hessian are sums over rows and so are exchanged between row shards.
Probabilities are Platt's: a sigmoid over decision values of held-out folds.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass

import numpy as np

from .lockstep import array_held
from .trees import Rows, sigmoid, uniform

LANDMARKS = 512
LEAST_WIDTH, NARROWER = 1e-3, 6.0  # of the rounded corner, and by how much a step shrinks it
_STEPS = 0.5 ** np.arange(12)
_BLOCK = 4096  # rows worked on at a time


@dataclass(frozen=True)
class Machine:
    """``kind``: hinge (classes 0 and 1) or insensitive.  ``gamma`` 0: one over
    (columns x variance of all values)."""

    kind: str = "hinge"
    c: float = 1.0
    epsilon: float = 0.1
    gamma: float = 0.0
    landmarks: int = LANDMARKS
    probability: bool = False
    seed: int = 42


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    far = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.exp(-gamma * np.maximum(far, 0.0))


def _newton(phi: np.ndarray, sign: np.ndarray, a: np.ndarray, weight: np.ndarray, c: float) -> Generator[np.ndarray, list, np.ndarray]:
    """Least ``|w|^2/2 + c * sum weight * max(0, a - sign * phi w)``, where ``sign``
    and ``a`` have a line for each part of a row; the last column of ``phi`` is the
    bias, which is free.  Newton steps are damped (where no row lies in the corner,
    nothing curves) until one gains."""
    d = phi.shape[1]
    free = np.ones(d)
    free[-1] = 0.0
    w = np.zeros(d)
    width = 2.0 * max(1.0, max(float(x[0]) for x in (yield np.array([np.abs(a).max(initial=0.0)]))))
    while width > LEAST_WIDTH:
        for _ in range(100):
            u = a - sign * (phi @ w)
            slope = np.clip(u / width, 0.0, 1.0)
            curved = ((u > 0) & (u < width)) / width
            gradient = -(phi.T @ (c * weight * (sign * slope).sum(0)))
            hessian, bends = np.zeros((d, d)), c * weight * curved.sum(0)
            for k in range(0, len(phi), _BLOCK):  # no second copy of phi
                bent = np.flatnonzero(bends[k:k + _BLOCK])
                if len(bent):
                    part = phi[k:k + _BLOCK][bent]
                    hessian += part.T @ (part * bends[k:k + _BLOCK][bent, None])
            every = np.sum((yield np.vstack([gradient[None], hessian])), axis=0)
            gradient = every[0] + free * w
            for damp in (1e-8, 1e-3, 1.0, 1e3):
                step = np.linalg.solve(every[1:] + np.diag(free + damp), -gradient)
                change = phi @ step
                values = np.array([_rounded(u - sign * t * change, width, weight).sum() for t in [*_STEPS, 0.0]])
                values = c * np.sum((yield values), axis=0) + np.array([(free * (w + t * step) ** 2).sum() / 2 for t in [*_STEPS, 0.0]])
                least = int(values[:-1].argmin())
                if values[least] < values[-1]:
                    break
            if values[least] >= values[-1]:
                break
            w = w + _STEPS[least] * step
            if values[-1] - values[least] <= 1e-7 * abs(values[-1]):
                break
        width /= NARROWER
    return w


def _rounded(u: np.ndarray, width: float, weight: np.ndarray) -> np.ndarray:
    return weight * np.where(u <= 0, 0.0, np.where(u < width, u * u / (2 * width), u - width / 2))


def fit(rows: Rows, target: int, m: Machine) -> Generator[np.ndarray, list, dict]:
    """The machine fitted on the training rows of all shards: {landmarks, alpha,
    bias, gamma, slope, offset}."""
    width = int(max(x[0] for x in (yield np.array([rows.width]))))
    y, train = rows.label(target), rows.train
    own = np.zeros(3)
    for k, x in rows.blocks(width, _BLOCK):
        x = x[train[k:k + _BLOCK]]
        own += (x.sum(), (x * x).sum(), x.size)
    sums = np.sum((yield own), axis=0)
    gamma = m.gamma
    if not gamma:
        variance = max(sums[1] / max(sums[2], 1) - (sums[0] / max(sums[2], 1)) ** 2, 0.0)
        gamma = 1.0 / (width * variance) if width and variance else 1.0
    # landmarks: the rows with the least draws, over all shards
    draw = uniform(rows.key, m.seed, 7)
    order = np.argsort(draw[train], kind="stable")[: m.landmarks]
    chosen = np.flatnonzero(train)[order]
    place = np.full(rows.n, -1)
    place[chosen] = np.arange(len(chosen))
    drawn = np.zeros((len(chosen), width))
    for k, x in rows.blocks(width, _BLOCK):
        at = place[k:k + _BLOCK]
        drawn[at[at >= 0]] = x[at >= 0]
    shards = yield np.column_stack([draw[chosen], drawn])
    every = np.concatenate(shards)
    landmarks = np.unique(every[np.argsort(every[:, 0], kind="stable")[: m.landmarks], 1:], axis=0)
    value, vector = np.linalg.eigh(kernel(landmarks, landmarks, gamma))
    keep = value > 1e-10 * max(value.max(initial=0.0), 1e-300)
    project = vector[:, keep] / np.sqrt(value[keep])
    # the map of the training rows; others are not worked on
    at = np.cumsum(train) - train
    n, y, key = int(train.sum()), y[train], rows.key[train]
    phi = array_held(n, project.shape[1] + 1)
    phi[:, -1] = 1.0
    for k, x in rows.blocks(width, _BLOCK):
        some = train[k:k + _BLOCK]
        if some.any():
            phi[at[k]:at[k] + int(some.sum()), :-1] = kernel(x[some], landmarks, gamma) @ project

    def solve(weight: np.ndarray) -> Generator:
        if m.kind == "hinge":
            sign = np.where(y > 0.5, 1.0, -1.0)
            return (yield from _newton(phi, sign[None], np.ones((1, n)), weight, m.c))
        return (yield from _newton(phi, np.array([[1.0], [-1.0]]), np.stack([y - m.epsilon, -y - m.epsilon]), weight, m.c))

    weight = np.ones(n)
    w = yield from solve(weight)
    slope, offset = -1.0, 0.0
    if m.probability:
        fold = (uniform(key, m.seed, 11) * 5).astype(np.int64)
        held = np.zeros(n)
        for k in range(5):
            part = yield from solve(weight * (fold != k))
            held[fold == k] = (phi @ part)[fold == k]
        slope, offset = yield from _platt(held, y > 0.5)
    return {"landmarks": landmarks, "alpha": project @ w[:-1], "bias": float(w[-1]), "gamma": float(gamma), "slope": float(slope), "offset": float(offset)}


def _platt(f: np.ndarray, y: np.ndarray) -> Generator[np.ndarray, list, tuple[float, float]]:
    """Slope and offset of P(y) = 1 / (1 + exp(slope f + offset))."""
    n = np.sum((yield np.array([y.sum(), (~y).sum()])), axis=0)
    t = np.where(y, (n[0] + 1) / (n[0] + 2), 1 / (n[1] + 2))
    a = np.array([0.0, np.log((n[1] + 1) / (n[0] + 1))])
    design = np.column_stack([f, np.ones(len(f))])
    for _ in range(100):
        p = sigmoid(-(design @ a))
        gradient = design.T @ (t - p)
        hessian = design.T @ (design * (p * (1 - p))[:, None])
        every = np.sum((yield np.vstack([gradient[None], hessian])), axis=0)
        step = np.linalg.solve(every[1:] + 1e-10 * np.eye(2), -every[0])

        def loss(b):
            z = design @ b
            return np.where(z >= 0, t * z + np.log1p(np.exp(-np.abs(z))), (t - 1) * z + np.log1p(np.exp(-np.abs(z)))).sum()

        values = np.sum((yield np.array([loss(a + s * step) for s in [*_STEPS, 0.0]])), axis=0)
        good = np.flatnonzero(values[:-1] < values[-1])
        if not len(good) or np.abs(every[0]).max() < 1e-6:
            break
        a = a + _STEPS[good[0]] * step
    return float(a[0]), float(a[1])


class KernelScorer:
    """Decision values, or probabilities if the machine has them, of dense rows."""

    def __init__(self, fitted: dict, probability: bool):
        self.f, self.probability = fitted, probability

    def __call__(self, x: np.ndarray) -> np.ndarray:
        f = self.f
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            out[a:a + 4096] = kernel(x[a:a + 4096], f["landmarks"], f["gamma"]) @ f["alpha"] + f["bias"]
        return sigmoid(-(f["slope"] * out + f["offset"])) if self.probability else out
