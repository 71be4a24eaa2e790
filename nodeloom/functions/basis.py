"""Expansions of a scalar column in a basis, and schedules."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bessel(x: Column, start: float = 0.0, end: float = 1.0, count: int = 8, eps: float = 1e-5) -> Column:
    """sqrt(2 / c) * sin(n pi x / c) / x for n from 1 on, with x and c counted from start."""
    c, at = end - start, x - F.lit(start) + F.lit(eps)
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda n: F.lit(math.sqrt(2 / c)) * F.sin(n * F.lit(math.pi) * at / F.lit(c)) / at)


def gaussian(x: Column, start: float = 0.0, end: float = 1.0, count: int = 8) -> Column:
    """exp(-((x - center) / step)^2) / 1.12 for count evenly spaced centers."""
    step = (end - start) / (count - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda n: F.exp(-F.pow((x - F.lit(start) - n * F.lit(step)) / F.lit(step), F.lit(2.0))) / F.lit(1.12))


def expand(x: Column, start: float, end: float, count: int, basis: str = "gaussian") -> Column:
    if basis not in ("gaussian", "bessel"):
        raise ValueError(f"no such basis: {basis}")
    return (gaussian if basis == "gaussian" else bessel)(x, start, end, count)


def normal_numbers(count: int, seed: int) -> list[float]:
    """Normal numbers that any engine can repeat, from digests of "seed:place" by the polar formula."""
    share = lambda i: int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:12], 16)
    return [math.sqrt(-2 * math.log((share(2 * i) + 1) / (2.0**48 + 1))) * math.cos(2 * math.pi * (share(2 * i + 1) / 2.0**48)) for i in range(count)]


def random_fourier(x: Column, size: int, sigma: float = 1.0, seed: int = 0) -> Column:
    """[cos(2 pi x B), sin(2 pi x B)] with size / 2 fixed normal numbers B."""
    b = F.array(*(F.lit(sigma * v) for v in normal_numbers(size // 2, seed)))
    wave = lambda f: F.transform(b, lambda v: f(F.lit(2 * math.pi) * x * v))
    return F.concat(wave(F.cos), wave(F.sin))


def cosine_cutoff(d: Column, cutoff: float) -> Column:
    """(cos(pi d / cutoff) + 1) / 2 below the cutoff, 0 from there on."""
    return F.when(d < cutoff, 0.5 * (F.cos(F.lit(math.pi / cutoff) * d) + 1)).otherwise(0.0)


def decaying(index: Column, floor: float, scale: float, rate: float) -> Column:
    """max(floor, scale * exp(-rate * index)), a learning rate per epoch."""
    return F.greatest(F.lit(floor), F.lit(scale) * F.exp(F.lit(-rate) * index))


def linspace(start: float, end: float, count: int) -> Column:
    step = (end - start) / max(count - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(start) + i * F.lit(step))


def clip_low(x: Column, least: float = 0.0) -> Column:
    return F.greatest(F.lit(least), x)
