"""Reverse-mode differentiation of numpy expressions: each value knows its parents and how to pass a gradient back to them."""

from __future__ import annotations

import numpy as np


class Value:
    __slots__ = ("data", "grad", "parents")

    def __init__(self, data, parents=()):
        self.data, self.grad, self.parents = np.asarray(data, float), None, parents

    def __add__(self, other):
        other = lift(other)
        return Value(self.data + other.data, ((self, lambda g: fit(g, self.data.shape)), (other, lambda g: fit(g, other.data.shape))))

    def __mul__(self, other):
        other = lift(other)
        return Value(self.data * other.data, ((self, lambda g: fit(g * other.data, self.data.shape)), (other, lambda g: fit(g * self.data, other.data.shape))))

    def __sub__(self, other):
        return self + lift(other) * -1.0

    def __truediv__(self, other):
        other = lift(other)
        return Value(self.data / other.data, ((self, lambda g: fit(g / other.data, self.data.shape)), (other, lambda g: fit(-g * self.data / other.data**2, other.data.shape))))

    def __matmul__(self, other):
        return Value(self.data @ other.data, ((self, lambda g: g @ other.data.T), (other, lambda g: self.data.T @ g)))

    def backward(self) -> None:
        """Gradients of the sum of this value, in .grad of all that it was made from."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p, _ in v.parents]
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            for p, back in v.parents if v.grad is not None else ():
                g = back(v.grad)
                p.grad = g if p.grad is None else p.grad + g


def lift(x) -> Value:
    return x if isinstance(x, Value) else Value(x)


def fit(g: np.ndarray, shape: tuple) -> np.ndarray:
    """g summed over what broadcasting repeated."""
    g = g.sum(tuple(range(g.ndim - len(shape)))) if g.ndim > len(shape) else g
    wide = tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] != 1)
    return g.sum(wide, keepdims=True) if wide else g


def sigmoid(x: Value) -> Value:
    s = 1 / (1 + np.exp(-np.clip(x.data, -60, 60)))
    return Value(s, ((x, lambda g: g * s * (1 - s)),))


def silu(x: Value) -> Value:
    return x * sigmoid(x)


def softplus(x: Value) -> Value:
    return Value(np.logaddexp(0, x.data), ((x, lambda g: g / (1 + np.exp(-np.clip(x.data, -60, 60)))),))


def gather(x: Value, index: np.ndarray) -> Value:
    return Value(x.data[index], ((x, lambda g: summed(g, index, len(x.data))),))


def summed(rows: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *rows.shape[1:]))
    np.add.at(out, index, rows)
    return out


def scatter(x: Value, index: np.ndarray, n: int) -> Value:
    """The sum of the rows with each index from 0 to n - 1."""
    return Value(summed(x.data, index, n), ((x, lambda g: g[index]),))


def concat(parts: list[Value], axis: int = 1) -> Value:
    cuts = np.cumsum([p.data.shape[axis] for p in parts])[:-1]
    return Value(np.concatenate([p.data for p in parts], axis), tuple((p, lambda g, i=i: np.split(g, cuts, axis)[i]) for i, p in enumerate(parts)))


def layer_norm(x: Value, scale: Value, shift: Value, eps: float = 1e-5) -> Value:
    centered = x.data - x.data.mean(1, keepdims=True)
    inv = 1 / np.sqrt((centered**2).mean(1, keepdims=True) + eps)
    unit = centered * inv
    back = lambda g: inv * (g - g.mean(1, keepdims=True) - unit * (g * unit).mean(1, keepdims=True))
    return Value(unit, ((x, back),)) * scale + shift


def total(x: Value) -> Value:
    return Value(x.data.sum(), ((x, lambda g: np.broadcast_to(g, x.data.shape)),))
