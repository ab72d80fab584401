"""Operators over grids: a frame is one row with its samples as an array, so that neighbour access
(filters, differences, tiles) is array arithmetic within the row and needs no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.keys import layouts


def at(cells: Column, i: Column) -> Column:
    """cells[i], or 0 where i is outside."""
    return F.coalesce(F.get(cells, i), F.lit(0))


def with_layout(frames: DataFrame, key: bytes, id_col: str, width: int, height: int, mode: str = "pixel", block: int = 0, name: str = "layout") -> DataFrame:
    """frames with the keyed layout of each, the id being its salt: a struct of `order`, the source index
    of each slot, and `back`, the slot of each source index."""

    @F.arrow_udf("struct<order:array<int>,back:array<int>>")
    def keyed(ids: pa.Array) -> pa.Array:
        orders = layouts(key, [int(i).to_bytes(8, "big") for i in ids.to_pylist()], width, height, mode, block)
        kind = pa.list_(pa.int32())
        both = [pa.array([o.astype("int32") for o in made], kind) for made in (orders, [np.argsort(o) for o in orders])]
        return pa.StructArray.from_arrays(both, ["order", "back"])

    return frames.withColumn(name, keyed(F.col(id_col)))


def moved(cells: Column, indices: Column) -> Column:
    """cells[i] of each index. Cells are bound first: within the inner function they would be made anew for each index."""
    return F.get(F.transform(F.array(cells), lambda bound: F.transform(indices, lambda i: F.get(bound, i))), F.lit(0))


def scrambled(cells: Column, layout: Column) -> Column:
    return moved(cells, layout["order"])


def restored(cells: Column, layout: Column) -> Column:
    """What scrambled() began with."""
    return moved(cells, layout["back"])


def rekeyed(cells: Column, old: Column, new: Column) -> Column:
    """Cells under another layout, in one step: the two are joined before a cell is moved."""
    return moved(cells, moved(old["back"], new["order"]))


def paeth(a: Column, b: Column, c: Column) -> Column:
    """The neighbour nearest to a + b - c; ties go to a, then b."""
    pa_, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    return F.when((pa_ <= pb) & (pa_ <= pc), a).when(pb <= pc, b).otherwise(c)


def filtered(cells: Column, kind: str, width: int) -> Column:
    """A PNG filter over rows of one byte a pixel: none, sub, up, average or paeth, modulo 256."""

    def f(v: Column, i: Column) -> Column:
        inner = i % width > 0
        a, b = F.when(inner, at(cells, i - 1)).otherwise(0), at(cells, i - width)
        c = F.when(inner, at(cells, i - width - 1)).otherwise(0)
        guess = {"none": F.lit(0), "sub": a, "up": b, "average": F.floor((a + b) / 2).cast("int"), "paeth": paeth(a, b, c)}[kind]
        return F.pmod(v - guess, F.lit(256)).cast("int")

    return F.transform(cells, f)


def listed(frames: DataFrame, cells: Column, *keys: str, name: str = "v") -> DataFrame:
    """One row per sample: keys, idx and the sample."""
    return frames.select(*keys, F.posexplode(cells).alias("idx", name))


