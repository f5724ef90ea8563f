"""Reading calibration items out of flash images, and queries on the decoded grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import maps as M
from ..sources.io import settled

ITEM = "uid string, offset long, bits int, signed boolean, rows int, cols int, stride int"


def read_values(content: bytes, offset: int, bits: int, signed: bool, count: int, stride: int) -> np.ndarray | None:
    """``count`` big-endian numbers; None if they are not all in the image. A width of 0 means 16, a stride of 0 packed."""
    layout = places(pd.DataFrame([{"offset": offset, "bits": bits, "signed": signed, "rows": 1, "cols": count, "stride": stride}]))
    raw, ok = gathered(np.frombuffer(content, np.uint8), layout)
    return raw if ok.all() else None


def places(items: pd.DataFrame) -> dict[str, np.ndarray]:
    """Where every cell of the items stands in an image: one entry a cell, computed once for all images."""
    whole = lambda c, empty: pd.to_numeric(items[c], errors="coerce").fillna(empty).to_numpy(np.int64)
    bits, rows, cols = whole("bits", 0), np.maximum(whole("rows", 1), 1), np.maximum(whole("cols", 1), 1)
    bits = np.where(bits > 0, bits, 16)
    step, n = np.maximum(whole("stride", 0), bits) // 8, rows * cols
    item = np.repeat(np.arange(len(items)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.where(items["offset"].isna(), -1, whole("offset", -1))
    last = start + step * (n - 1) + bits // 8
    return {"item": item, "row": at // cols[item], "col": at % cols[item], "place": start[item] + step[item] * at, "width": (bits // 8)[item], "signed": items["signed"].fillna(False).to_numpy(bool)[item], "start": start[item], "last": last[item], "first": at == 0}


def gathered(image: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The number at each place, and whether its item lies in the image."""
    ok = (p["start"] >= 0) & (p["last"] <= len(image))
    out = np.zeros(len(ok), np.int64)
    if len(image):
        for i in range(int(p["width"].max(initial=0))):
            more = ok & (i < p["width"])
            out = np.where(more, out << 8 | image[np.where(more, p["place"] + i, 0)], out)
    top = np.left_shift(np.int64(1), p["width"] * 8 - 1)
    return np.where(p["signed"] & (out >= top), out - 2 * top, out), ok


def decode_items(images: DataFrame, items: DataFrame, most: int = 200_000) -> DataFrame:
    """(image, uid, row, col, raw, error) of every item in every image(image, content).

    One pass per image: the item table, checked to have at most ``most`` rows, travels to the images, so no
    image is copied per item. The places of all cells are computed once a task; an image is one gather.
    """
    rows = items.select("uid", "offset", "bits", "signed", "rows", "cols", "stride").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} items: decode them in parts")
    held = images.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        p, uid = places(held.value), pa.array(held.value["uid"], pa.string())
        for batch in batches:
            for image, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw, ok = gathered(np.frombuffer(content.as_buffer(), np.uint8) if content.is_valid else np.zeros(0, np.uint8), p)
                keep = ok | p["first"]
                of = p["item"][keep]
                numbers = pa.array(raw[keep], pa.int64(), mask=~ok[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([image] * len(of), pa.string()), uid.take(pa.array(of)), *(pa.array(p[c][keep].astype(np.int32)) for c in ("row", "col")), numbers, pa.array(np.where(ok[keep], None, "out of the image"), pa.string())],
                    names=["image", "uid", "row", "col", "raw", "error"],
                )

    return images.select("image", "content").mapInArrow(run, "image string, uid string, row int, col int, raw long, error string")


def grid(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells as one nested array per key, row by row."""
    rows = cells.groupBy(*key, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "z"))), lambda x: x["z"]).alias("r"))
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "r"))), lambda x: x["r"]).alias("z"))


def cells_long(grids: DataFrame, key: list[str], values: str, cols: int) -> DataFrame:
    """A flat array, row-major with ``cols`` columns, as (key, row, col, z)."""
    return grids.select(*key, F.posexplode(values).alias("at", "z")).select(*key, F.floor(F.col("at") / cols).cast("int").alias("row"), (F.col("at") % cols).alias("col"), "z")


def extent(cells: DataFrame, key: list[str]) -> DataFrame:
    """The least and greatest number of a grid, and its cells in all; grids without a number are left out."""
    number = F.when(~F.isnan("z"), F.col("z"))
    return cells.groupBy(*key).agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("n")).where("low is not null")


def with_extent(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells with the least and greatest number of their grid, by one shuffle; grids without a number are left out."""
    w, number = W.partitionBy(*key), F.when(~F.isnan("z"), F.col("z"))
    return cells.withColumns({"low": F.min(number).over(w), "high": F.max(number).over(w)}).where("low is not null")


def flat_tables(cells: DataFrame, key: list[str]) -> DataFrame:
    """Tables whose cells are all equal; zero tells that they are all zero."""
    out = cells.groupBy(*key).agg(F.min("z").alias("low"), F.max("z").alias("high"), F.count("*").alias("n"))
    return out.where("low = high and n > 1").withColumn("zero", F.col("low") == 0)


def rail_cells(cells: DataFrame) -> DataFrame:
    """Cells(raw, bits, signed) at the least or greatest number of their type."""
    low = F.when(F.col("signed"), -F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits") - 1)).otherwise(0)
    high = F.call_function("shiftleft", F.lit(1).cast("long"), F.when(F.col("signed"), F.col("bits") - 1).otherwise(F.col("bits"))) - 1
    return cells.where((F.col("raw") == low) | (F.col("raw") == high))


def nonzero_region(cells: DataFrame, key: list[str]) -> DataFrame:
    return cells.where("z != 0").groupBy(*key).agg(F.count("*").alias("n"), F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), F.min("col").alias("col_lo"), F.max("col").alias("col_hi"))


def image_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Cells that differ between two images, also those only one has."""
    x, y = a.select(*key, "row", "col", F.col("z").alias("z1")), b.select(*key, "row", "col", F.col("z").alias("z2"))
    return x.join(y, [*key, "row", "col"], "full").where(~F.col("z1").eqNullSafe(F.col("z2")))


def changed_blocks(a: DataFrame, b: DataFrame, size: int = 4096) -> DataFrame:
    """(image, blk, content1, content2): blocks of ``size`` bytes that differ between two versions a, b of images(image, content).

    First only digests of blocks are exchanged; the bytes of a block follow if its digests differ. A block that one
    version lacks is null there.
    """
    def blocks(df: DataFrame, i: int) -> DataFrame:
        places = F.sequence(F.lit(0), F.floor((F.length("content") - 1) / size).cast("int"))
        return df.where(F.length("content") > 0).select("image", F.explode(places).alias("blk"), "content").select("image", "blk", F.substring("content", F.col("blk") * size + 1, F.lit(size)).alias(f"content{i}"))

    x, y = blocks(a, 1), blocks(b, 2)
    digest = lambda df, i: df.select("image", "blk", F.sha2(f"content{i}", 256).alias(f"d{i}"))
    other = settled(digest(x, 1).join(digest(y, 2), ["image", "blk"], "full").where(~F.col("d1").eqNullSafe(F.col("d2"))).select("image", "blk"))
    return other.join(x, ["image", "blk"], "left").join(y, ["image", "blk"], "left")


def changed_words(blocks: DataFrame, size: int = 4096) -> DataFrame:
    """(image, at, raw1, raw2): the big-endian 16-bit words that differ in changed blocks, by their offset; null where a version has no whole word."""
    number = lambda c, i: F.when(F.length(c) >= i * 2 + 2, F.conv(F.hex(F.substring(c, i * 2 + 1, F.lit(2))), 16, 10).cast("int"))
    most = F.greatest(F.coalesce(F.length("content1"), F.lit(0)), F.coalesce(F.length("content2"), F.lit(0)))
    words = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((most - 1) / 2).cast("int"))))
    rows = words.select("image", (F.col("blk").cast("long") * size + F.col("i") * 2).alias("at"), number("content1", F.col("i")).alias("raw1"), number("content2", F.col("i")).alias("raw2"))
    return rows.where(~F.col("raw1").eqNullSafe(F.col("raw2")))


def mirror_check(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key, F.col("block").alias("b1")).join(b.select(key, F.col("block").alias("b2")), key).withColumn("equal", F.col("b1") == F.col("b2"))


def slopes(cells: DataFrame, key: list[str], y: str = "y") -> DataFrame:
    """dz/dy from the row above, per column."""
    w = W.partitionBy(*key, "col").orderBy(y)
    return cells.withColumn("slope", F.try_divide(F.col("z") - F.lag("z").over(w), F.col(y) - F.lag(y).over(w)))


def slope_faults(cells: DataFrame, key: list[str], y: str = "y") -> DataFrame:
    """Cells with a negative slope, or one that rises again after it fell."""
    w = W.partitionBy(*key, "col").orderBy(y)
    s = slopes(cells, key, y).withColumn("before", F.lag("slope").over(w))
    return s.withColumn("negative", F.col("slope") < 0).withColumn("bump", F.col("slope") > F.col("before")).where("negative or bump")


def gain_ratio(cells: DataFrame, key: list[str], split: float, y: str = "y") -> DataFrame:
    """Mean slope below the split over that above."""
    s = slopes(cells, key, y)
    return s.groupBy(*key).agg(F.try_divide(F.avg(F.when(F.col(y) <= split, F.col("slope"))), F.avg(F.when(F.col(y) > split, F.col("slope")))).alias("ratio"))


def adjacent_items(items: DataFrame, part: list[str]) -> DataFrame:
    """The next item by address, the gap in bytes, and whether the two overlap."""
    w = W.partitionBy(*part).orderBy("addr", "id")
    out = items.withColumn("next_id", F.lead("id").over(w)).withColumn("gap", F.lead("addr").over(w) - F.col("addr") - F.col("size"))
    return out.withColumn("overlap", F.col("gap") < 0)


def axis_outliers(points: DataFrame, key: str, value: str, most: float) -> DataFrame:
    """Points further from their group's median than ``most`` of it."""
    mid = points.groupBy(key).agg(F.median(value).alias("typical"))
    return points.join(mid, key).where(F.abs(F.col(value) - F.col("typical")) > most * F.abs("typical"))


def ratio_outliers(points: DataFrame, key: str, radius: str, angle: str, wheelbase: float, most: float, sketch: int | None = None) -> DataFrame:
    """Points whose steering ratio, as the bicycle model implies it, is further from their table's typical one than ``most`` of it.

    Adds ``ratio`` and ``typical``. The typical ratio is the exact median; with ``sketch`` it is that of a mergeable
    KLL sketch of this size, which holds a group of any length in bounded memory: its rank is off by some 2.3 / sketch
    of the group, and a group of at most ``sketch`` points gives its lower median. Points without a ratio are left out.
    """
    rated = points.withColumn("ratio", M.implied_ratio(wheelbase, F.col(radius), F.col(angle))).where("ratio is not null and not isnan(ratio)")
    mid = F.median("ratio") if sketch is None else F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("ratio", F.lit(sketch)), F.lit(0.5))
    return rated.join(rated.groupBy(key).agg(mid.alias("typical")), key).where(F.abs(F.col("ratio") - F.col("typical")) > most * F.abs("typical"))
