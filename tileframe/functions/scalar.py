"""Numeric column functions: activations, ensembles, channels, index maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Stable: the exponent is never positive."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def softmax(z: Column, temperature: float | Column = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    e = F.transform(z, lambda v: F.exp((v - F.array_max(z)) / t))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def mean_arrays(rows: Column) -> Column:
    """Element-wise mean of an array of arrays of one length."""
    total = F.aggregate(F.slice(rows, 2, F.size(rows)), F.element_at(rows, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.transform(total, lambda v: v / F.size(rows))


def ensemble(members: Column, temperature: float = 1.0) -> Column:
    """Mean of the members' softmaxes, each at the temperature."""
    return mean_arrays(F.transform(members, lambda z: softmax(z, temperature)))


def compose(loc: Column, classes: Column) -> Column:
    """[1 - loc, loc * c for each class]."""
    return F.concat(F.array(1.0 - loc), F.transform(classes, lambda c: loc * c))


def first_argmax(p: Column) -> Column:
    """Place of the greatest element, from 1; the first of equal ones."""
    return F.array_position(p, F.array_max(p)).cast("int")


def pixel_mode(p: Column, gate: Column) -> tuple[Column, Column]:
    """Class (0 outside the gate) and the probability of the chosen channel of a five-channel pixel."""
    cls = F.when(gate, first_argmax(F.slice(p, 2, 4))).otherwise(0)
    return cls, F.element_at(p, cls + 1)


def stretch(v: Column, low: Column, high: Column) -> Column:
    """Linear stretch to 0..255, truncated; a constant band is clipped only."""
    scaled = F.when(high > low, (v - low) / (high - low + 1e-6) * 255.0).otherwise(v)
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)).cast("int")


def imagenet(v: Column, mean: float, std: float) -> Column:
    return (v / 255.0 - mean) / std


def grey(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def reflect(i: Column, n: Column | int) -> Column:
    """Index of the mirror image about the last element, which isn't repeated."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)


#: The eight orientations: where (y, x) of an n x n tile goes.
def orient(k: int, y: Column, x: Column, n: int) -> tuple[Column, Column]:
    """k & 1 mirrors left and right, k & 2 top and bottom, k & 4 transposes before."""
    if k & 4:
        y, x = x, y
    return (n - 1 - y if k & 2 else y), (n - 1 - x if k & 1 else x)


def disorient(k: int, y: Column, x: Column, n: int) -> tuple[Column, Column]:
    y, x = (n - 1 - y if k & 2 else y), (n - 1 - x if k & 1 else x)
    return (x, y) if k & 4 else (y, x)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))
