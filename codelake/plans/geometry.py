"""Tile, resolution, band, precinct and block rectangles, and packet order, as DataFrame plans without Python.

Every level explodes a ``sequence``: no shuffle, and the limits are checked on sizes before anything is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.columns import ceil_shift, floor_shift


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long") + b - 1, b.cast("long"))


def tiles(images: DataFrame) -> DataFrame:
    """Of images (…, x0, y0, x1, y1, tx0, ty0, tw, th): one row per tile with its rectangle clipped to the image."""
    wide, high = _div(F.col("x1") - F.col("tx0"), F.col("tw")), _div(F.col("y1") - F.col("ty0"), F.col("th"))
    rows = images.withColumn("_wide", wide).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), wide * high - 1)))
    c, r = F.col("tile") % F.col("_wide"), F.call_function("div", F.col("tile"), F.col("_wide"))
    left, top = F.col("tx0") + c * F.col("tw"), F.col("ty0") + r * F.col("th")
    rect = {"u0": F.greatest(left, F.col("x0")), "v0": F.greatest(top, F.col("y0")), "u1": F.least(left + F.col("tw"), F.col("x1")), "v1": F.least(top + F.col("th"), F.col("y1"))}
    return rows.withColumns({k: v.cast("long") for k, v in rect.items()}).drop("_wide").where("u1 > u0 and v1 > v0")


def resolutions(components: DataFrame) -> DataFrame:
    """Of tile components (…, u0, v0, u1, v1, dx, dy, levels, ppx, ppy): one row per resolution with its rectangle and
    numbers of precincts."""
    edge = {k: _div(F.col(k), F.col(d)) for k, d in (("u0", "dx"), ("v0", "dy"), ("u1", "dx"), ("v1", "dy"))}
    rows = components.withColumns({"_" + k: v for k, v in edge.items()}).withColumn("res", F.explode(F.sequence(F.lit(0), F.col("levels").cast("int"))))
    s = F.col("levels") - F.col("res")
    rows = rows.withColumns({"rx0": ceil_shift(F.col("_u0"), s), "ry0": ceil_shift(F.col("_v0"), s), "rx1": ceil_shift(F.col("_u1"), s), "ry1": ceil_shift(F.col("_v1"), s)})
    count = lambda a, b, p: F.when(F.col(b) > F.col(a), ceil_shift(F.col(b), F.col(p)) - floor_shift(F.col(a), F.col(p))).otherwise(F.lit(0).cast("long"))
    return rows.withColumns({"pwide": count("rx0", "rx1", "ppx"), "phigh": count("ry0", "ry1", "ppy")}).withColumnsRenamed({"_u0": "cx0", "_v0": "cy0", "_u1": "cx1", "_v1": "cy1"})


def bands(rows: DataFrame) -> DataFrame:
    """One row per band of resolutions: band, bx0, by0, bx1, by1; empty bands stay out."""
    kinds = F.when(F.col("res") == 0, F.array(F.struct(F.lit("LL").alias("band"), F.lit(0).alias("ox"), F.lit(0).alias("oy")))).otherwise(F.array(*[F.struct(F.lit(n).alias("band"), F.lit(x).alias("ox"), F.lit(y).alias("oy")) for n, x, y in (("HL", 1, 0), ("LH", 0, 1), ("HH", 1, 1))]))
    rows = rows.withColumn("_b", F.explode(kinds)).withColumn("_n", F.col("levels") - F.col("res") + (F.col("res") > 0).cast("int"))
    half = F.call_function("shiftright", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_n")), F.lit(1))
    cut = lambda v, o: ceil_shift(F.greatest(F.col(v) - half * F.col("_b")[o], F.lit(0).cast("long")), F.col("_n"))
    rows = rows.withColumns({"band": F.col("_b.band"), "bx0": cut("cx0", "ox"), "by0": cut("cy0", "oy"), "bx1": cut("cx1", "ox"), "by1": cut("cy1", "oy")})
    return rows.drop("_b", "_n").where("bx1 > bx0 and by1 > by0")


def _precincts(rows: DataFrame, xcb: Column, ycb: Column) -> DataFrame:
    cut = (F.col("res") > 0).cast("int")
    px, py = F.col("ppx") - cut, F.col("ppy") - cut
    rows = rows.withColumns({"_px": px, "_py": py, "_cw": F.least(xcb, px), "_ch": F.least(ycb, py)})
    rows = rows.withColumn("precinct", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pwide") * F.col("phigh") - 1)))
    i, j = F.col("precinct") % F.col("pwide"), F.call_function("div", F.col("precinct"), F.col("pwide"))
    shl = lambda v, s: F.call_function("shiftleft", v.cast("long"), s)
    left, top = floor_shift(F.col("rx0"), F.col("ppx")) + i, floor_shift(F.col("ry0"), F.col("ppy")) + j
    rows = rows.withColumns({"_qx0": F.greatest(shl(left, F.col("_px")), F.col("bx0")), "_qy0": F.greatest(shl(top, F.col("_py")), F.col("by0")), "_qx1": F.least(shl(left + 1, F.col("_px")), F.col("bx1")), "_qy1": F.least(shl(top + 1, F.col("_py")), F.col("by1"))})
    return rows


def precincts(rows: DataFrame, xcb: Column, ycb: Column) -> DataFrame:
    """One row per precinct of bands: precinct, n_blocks; an empty precinct has 0 blocks and keeps its row."""
    rows = _precincts(rows, xcb, ycb)
    wide = ceil_shift(F.col("_qx1"), F.col("_cw")) - floor_shift(F.col("_qx0"), F.col("_cw"))
    high = ceil_shift(F.col("_qy1"), F.col("_ch")) - floor_shift(F.col("_qy0"), F.col("_ch"))
    some = (F.col("_qx1") > F.col("_qx0")) & (F.col("_qy1") > F.col("_qy0"))
    return rows.withColumn("n_blocks", F.when(some, wide * high).otherwise(F.lit(0).cast("long"))).drop("_px", "_py", "_cw", "_ch", "_qx0", "_qy0", "_qx1", "_qy1")


def blocks(rows: DataFrame, xcb: Column, ycb: Column) -> DataFrame:
    """One row per code-block of bands: precinct, kx0, ky0, kx1, ky1. Empty precincts have none."""
    shl = lambda v, s: F.call_function("shiftleft", v.cast("long"), s)
    rows = _precincts(rows, xcb, ycb).where("_qx1 > _qx0 and _qy1 > _qy0")
    rows = rows.withColumn("_u", F.explode(F.sequence(floor_shift(F.col("_qx0"), F.col("_cw")), ceil_shift(F.col("_qx1"), F.col("_cw")) - 1)))
    rows = rows.withColumn("_v", F.explode(F.sequence(floor_shift(F.col("_qy0"), F.col("_ch")), ceil_shift(F.col("_qy1"), F.col("_ch")) - 1)))
    rows = rows.withColumns({"kx0": F.greatest(shl(F.col("_u"), F.col("_cw")), F.col("_qx0")), "ky0": F.greatest(shl(F.col("_v"), F.col("_ch")), F.col("_qy0")), "kx1": F.least(shl(F.col("_u") + 1, F.col("_cw")), F.col("_qx1")), "ky1": F.least(shl(F.col("_v") + 1, F.col("_ch")), F.col("_qy1"))})
    return rows.drop("_px", "_py", "_cw", "_ch", "_qx0", "_qy0", "_qx1", "_qy1", "_u", "_v")


def packet_order(rows: DataFrame, key: list[str], progression: str, layers: Column) -> DataFrame:
    """``ord`` of every (layer, res, comp, precinct) of the resolutions of a tile; ``key`` names the tile. Positions
    are clamped to the tile's edge, as the first row and column of precincts count there."""
    rows = rows.where("pwide * phigh > 0").withColumn("precinct", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pwide") * F.col("phigh") - 1))).withColumn("layer", F.explode(F.sequence(F.lit(0), layers.cast("int") - 1)))
    s = F.col("levels") - F.col("res")
    i, j = F.col("precinct") % F.col("pwide"), F.call_function("div", F.col("precinct"), F.col("pwide"))
    at = lambda r, p, k, d, edge: F.greatest(F.call_function("shiftleft", floor_shift(F.col(r), F.col(p)) + k, F.col(p) + s) * F.col(d), F.col(edge))
    rows = rows.withColumns({"_x": at("rx0", "ppx", i, "dx", "u0"), "_y": at("ry0", "ppy", j, "dy", "v0")})
    order = {"LRCP": ["layer", "res", "comp", "precinct"], "RLCP": ["res", "layer", "comp", "precinct"], "RPCL": ["res", "_y", "_x", "comp", "precinct", "layer"], "PCRL": ["_y", "_x", "comp", "res", "precinct", "layer"], "CPRL": ["comp", "_y", "_x", "res", "precinct", "layer"]}[progression]
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).drop("_x", "_y")
