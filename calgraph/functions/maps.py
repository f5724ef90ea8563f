"""Lookup in curves and maps held as arrays, in the engine's way: clamped, linear, x first and then y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _place(axis: Column, x: Column, quantum: float | None) -> tuple[Column, Column]:
    """Index (from 0) of the breakpoint below, and the fraction to the next."""
    n = F.size(axis)
    i = F.greatest(F.lit(0), F.least(F.size(F.filter(axis, lambda v: v <= x)) - 1, n - 2))
    lo, hi = F.get(axis, i), F.get(axis, i + 1)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0))))
    return i, F.floor(part / quantum) * quantum if quantum else part


def lookup_curve(xs: Column, ys: Column, x: Column, quantum: float | None = None) -> Column:
    """Linear between breakpoints, clamped; ``quantum`` cuts the fraction as the controller does (1/256)."""
    i, f = _place(xs, x, quantum)
    a = F.get(ys, i)
    return a + f * (F.coalesce(F.get(ys, i + 1), a) - a)


def lookup_map(xs: Column, ys: Column, z: Column, x: Column, y: Column, quantum: float | None = None) -> Column:
    """Bilinear in z[row of y][column of x]."""
    i, f = _place(xs, x, quantum)
    j, g = _place(ys, y, quantum)

    def row(r: Column) -> Column:
        a = F.get(r, i)
        return a + f * (F.coalesce(F.get(r, i + 1), a) - a)

    low, high = row(F.get(z, j)), row(F.coalesce(F.get(z, j + 1), F.get(z, j)))
    return low + g * (high - low)


def direct_index(ys: Column, i: Column, mask: int = 7) -> Column:
    return F.get(ys, i.bitwiseAND(F.lit(mask)).cast("int"))


def density_correction(px: Column, py: Column, p: Column, tx: Column, ty: Column, t: Column) -> Column:
    return lookup_curve(px, py, p) * lookup_curve(tx, ty, t)


def rescale_axis(xs: Column, k: float, quantum: float) -> Column:
    """Breakpoints times k, on raw steps of ``quantum``."""
    return F.transform(xs, lambda x: F.bround(x * k / quantum) * quantum)


def axis_monotonic(values: Column) -> Column:
    """All steps one way; null under four points."""
    steps = F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda b, a: b - a)
    return F.when(F.size(values) >= 4, F.forall(steps, lambda d: d >= 0) | F.forall(steps, lambda d: d <= 0))


def heat(v: Column, low: Column, high: Column) -> Column:
    """Place of a cell between the grid's least and greatest value; the middle where they are equal."""
    return F.coalesce(F.try_divide(v - low, high - low), F.lit(0.5))


def nearest_raw(target: Column, factor: float, add: float, bits: int, signed: bool) -> Column:
    """The storable raw value nearest to the target of value = raw * factor + add, the value it gives, and if the target is out of reach."""
    lo, hi = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    raw = F.greatest(F.lit(lo), F.least(F.lit(hi), F.rint((target - add) / factor).cast("long")))
    ends = sorted((lo * factor + add, hi * factor + add))
    return F.struct(raw.cast("long").alias("raw"), (raw * factor + add).alias("value"), (~target.between(*ends)).alias("outside"))


def implied_ratio(wheelbase: float, radius: Column, angle: Column) -> Column:
    """Steering ratio that a table's angle implies for a turning radius (bicycle model)."""
    return F.try_divide(angle, F.degrees(F.atan(F.try_divide(F.lit(wheelbase), radius))))
