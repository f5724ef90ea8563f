"""Recursive filters of the controller: each value depends on the rounded one before, so there is no window form.

A session is filtered in time order, in Arrow batches, by a small step function; its state is one number or a
few. Integer arithmetic with floor shifts, as the controller has it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import settled

#: Beyond any value.
FAR = 1 << 61


def pt1(y: int | None, x: int, k: int) -> int:
    """y += (k (x - y) + 128) >> 8, at least one step; k = 0 passes x through."""
    if y is None or k == 0:
        return x
    d = (k * (x - y) + 128) >> 8
    return y + (d or (x > y) - (x < y))


def iir(y: int | None, x: int, n: int) -> int:
    """y += (x - y) / n towards zero, at least one step."""
    if y is None:
        return x
    d = abs(x - y) // n * (1 if x > y else -1)
    return y + (d or (x > y) - (x < y))


def rate_limited(y: int | None, x: int, delta: int) -> int:
    return x if y is None else y + max(-delta, min(delta, x - y))


def integral(i: int | None, error: int, gain: int, low: int, high: int) -> int:
    """i += error * 64 * gain >> 16, at least one step, clamped; gain 0 freezes."""
    i = i or 0
    return max(low, min(high, i + integral_shift(error, gain))) if gain and error else i


def integral_shift(error: int, gain: int) -> int:
    return error * 64 * gain >> 16 or (1 if error > 0 else -1)


def recursive(samples: DataFrame, columns: list[str], step: Callable, out: str = "y", session: str = "session", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Adds ``out``: step(previous, *columns) along each session.

    Sessions are dealt to partitions and sorted there; a task carries the last value from one Arrow batch to the
    next, so a session of any length needs one batch of memory. A sample with a null leaves the value as it is.
    """
    dealt = samples.repartition(session).sortWithinPartitions(session, *order)
    schema = samples.selectExpr("*", f"cast(null as bigint) as `{out}`").schema

    def run(batches):
        here, y = object(), None
        for batch in batches:
            ys = []
            for name, *row in zip(*(batch.column(c).to_pylist() for c in (session, *columns)), strict=True):
                if name != here:
                    here, y = name, None
                if None not in row:
                    y = step(y, *row)
                ys.append(y)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ys, pa.int64())], names=[*batch.schema.names, out])

    return dealt.mapInArrow(run, schema)


def pt1_filter(samples: DataFrame, x: str, k: int, out: str = "y") -> DataFrame:
    return recursive(samples, [x], lambda y, v: pt1(y, v, k), out)


def iir_filter(samples: DataFrame, x: str, n: int, out: str = "y") -> DataFrame:
    return recursive(samples, [x], lambda y, v: iir(y, v, n), out)


def asymmetric_pt1(samples: DataFrame, x: str, k_up: str, k_down: str, out: str = "y") -> DataFrame:
    return recursive(samples, [x, k_up, k_down], lambda y, v, up, down: pt1(y, v, up if y is None or v > y else down), out)


def composed(samples: DataFrame, columns: list[str], step: Callable, move: Callable, out: str = "y", session: str = "session", order: tuple[str, ...] = ("ts", "seq"), each: int = 1 << 20) -> DataFrame:
    """``recursive`` for steps that shift a value and then clamp it: a long session is spread over tasks.

    move(*columns) is (shift, low, high), or None if the value stays. Two such steps in a row are one of the same form,
    so segments of a session (what a task has of it, ``each`` rows at most) are run from their first row: every row gets
    its step from the segment's begin, and the value it would have if the session began there. Segments' last rows then
    give their start values in order, some rows a task, and a row's value follows from its segment's.
    """
    dealt = samples.repartitionByRange(session, *order).sortWithinPartitions(session, *order)
    schema = samples.selectExpr("*", *(f"cast(null as bigint) as `__{c}`" for c in ("seg", "s", "l", "h", "y"))).schema

    def run(batches):
        here, n, seg = object(), 0, (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            rows = []
            for name, *row in zip(*(batch.column(c).to_pylist() for c in (session, *columns)), strict=True):
                if name != here or n >= each:
                    here, n, seg, s, low, high, y = name, 0, seg + 1, 0, -FAR, FAR, None
                n += 1
                if None not in row:
                    y = step(y, *row)
                    if to := move(*row):
                        d, a, b = to
                        s, low, high = s + d, max(a, min(b, low + d)), max(a, min(b, high + d))
                rows.append((seg, s, low, high, y))
            more = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [()] * 5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__seg", "__s", "__l", "__h", "__y"])

    rows = settled(dealt.mapInArrow(run, schema))
    at = F.struct(*order)
    ends = rows.groupBy("__seg").agg(F.max_by(F.struct(F.col(session).alias("k"), "__s", "__l", "__h", "__y"), at).alias("e")).select("__seg", "e.*")

    def starts(pdf):
        pdf, now, y = pdf.sort_values("__seg"), [], None
        for s, low, high, first in zip(*(pdf[c].tolist() for c in ("__s", "__l", "__h", "__y")), strict=True):
            now.append(y)
            y = max(low, min(high, y + s)) if y is not None else None if first != first or first is None else int(first)
        return pd.DataFrame({"__seg": pdf["__seg"], "__at": pd.array(now, "Int64")})

    begin = ends.groupBy("k").applyInPandas(starts, "__seg long, __at long")
    value = F.when(F.col("__at").isNull(), F.col("__y")).otherwise(F.greatest("__l", F.least("__h", F.col("__at") + F.col("__s"))))
    return rows.join(begin, "__seg").withColumn(out, value).select(*(f"`{c}`" for c in samples.columns), f"`{out}`")


def clamped_integral(samples: DataFrame, error: str, gain: str, low: int, high: int, out: str = "y", each: int = 1 << 20) -> DataFrame:
    def move(e, g):
        return (integral_shift(e, g), low, high) if e and g else None

    return composed(samples, [error, gain], lambda y, e, g: integral(y, e, g, low, high), move, out, each=each)


def ramp(samples: DataFrame, x: str, delta: int, out: str = "y") -> DataFrame:
    """y + max(-delta, min(delta, x - y)). Steps of this form do not join into one of the same form (each may add a level part), so a session is one task."""
    return recursive(samples, [x], lambda y, v: rate_limited(y, v, delta), out)
