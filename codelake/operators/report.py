"""Inventories and comparisons over decoded or header tables, as plain aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.columns import ends_segment


def option_histogram(headers: DataFrame) -> DataFrame:
    """(option, value, n) over header tables: how many files use each coding option."""
    s, text = F.col("tile_style"), lambda c: c.cast("string")
    distinct = lambda f: F.array_join(F.array_sort(F.array_distinct(F.transform("header.components", f))), "+")
    options = {
        "components": text(F.size("header.components")), "depths": distinct(lambda c: c["depth"].cast("string")), "sampling": distinct(lambda c: F.concat(c["dx"].cast("string"), F.lit("x"), c["dy"].cast("string"))), "progression": s["progression"], "layers": text(s["layers"]), "mct": text(s["mct"]), "levels": text(s["levels"]),
        "block": F.concat_ws("x", text(s["block_width"]), text(s["block_height"])), "transform": s["transform"], "quantisation": s["quant_style"], "tile_parts": text(F.size("tile_parts")), "markers": F.array_join(F.array_sort(F.array_distinct(F.transform("markers", lambda m: m["marker"]))), "+"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("option"), v.alias("value")) for k, v in options.items()])
    return headers.where("error is null").select(F.explode(pairs).alias("o")).groupBy("o.option", "o.value").agg(F.count(F.lit(1)).alias("n"))


def marker_histogram(headers: DataFrame, key: list[str]) -> DataFrame:
    return headers.select(*key, F.explode("markers").alias("m")).groupBy(*key, "m.marker").agg(F.count(F.lit(1)).alias("n"))


def reconcile_tile_parts(parts: DataFrame, key: list[str]) -> DataFrame:
    """(*key, declared, found) where the last non-zero declared count of a tile is not the found number."""
    told = F.max(F.when(F.col("declared") != 0, F.struct("seq", "declared")))["declared"]
    return parts.groupBy(*key).agg(told.alias("declared"), F.count(F.lit(1)).alias("found")).where("declared is not null and declared <> found")


def merge_segments(pieces: DataFrame, key: list[str]) -> DataFrame:
    """(*key, start, length, passes): consecutive contiguous pieces (seq, start, length, passes, style) joined unless
    the coder was terminated between them."""
    w = Window.partitionBy(*key).orderBy("seq")
    done = F.sum("passes").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lag(F.col("start") + F.col("length")).over(w)
    new = (after.isNull()) | (F.col("start") != after) | ends_segment(F.coalesce(done, F.lit(0)) - 1, F.col("style"))
    rows = pieces.withColumn("_new", new.cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "_run").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("passes").alias("passes")).drop("_run")


def verdicts(pairs: DataFrame, key: list[str], tolerance: int = 0, ours: str = "ours", theirs: str = "theirs") -> DataFrame:
    """Per key, over rows of two decoders' samples: worst, differing, total, verdict."""
    a, b = F.col(ours), F.col(theirs)
    worst = F.coalesce(F.max(F.abs(a - b)), F.lit(0))
    out = pairs.groupBy(*key).agg(worst.cast("long").alias("worst"), F.count_if(a != b).alias("differing"), F.count(F.lit(1)).alias("total"), F.count(a).alias("_ours"), F.count(b).alias("_theirs"))
    kind: Column = F.when(F.col("_theirs") == 0, "no-reference").when(F.col("_ours") == 0, "refused").when(F.col("_ours") != F.col("_theirs"), "shape").when(F.col("worst") == 0, "exact").when(F.col("worst") <= tolerance, "within-tolerance").otherwise("differs")
    return out.select(*key, "worst", "differing", "total", kind.alias("verdict"))


def tally(found: DataFrame) -> DataFrame:
    """(verdict, n, passed): how often each verdict was given, and whether all were good ones or had no reference."""
    each = found.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return each.crossJoin(F.broadcast(all_pass(each).select("passed")))  # one row


def all_pass(found: DataFrame) -> DataFrame:
    """(n, passed) of verdict rows; nothing to judge is passed."""
    return found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("verdict").isin("exact", "within-tolerance", "no-reference")), F.lit(True)).alias("passed"))


def descending(histogram: DataFrame, key: list[str] | None = None) -> DataFrame:
    """A histogram with the place of each row by falling ``n`` within ``key`` (equal counts share a place). One row a
    different value is ranked, not one a file; with a key, each key's rows are ranked on their own."""
    w = Window.partitionBy(*(key or [F.lit(0)])).orderBy(F.col("n").desc())
    return histogram.withColumn("place", F.rank().over(w).cast("long"))


def limits(images: DataFrame, max_samples: int) -> Column:
    """TooLarge where the components' samples exceed the ceiling, before anything is allocated."""
    total = F.aggregate("components", F.lit(0).cast("long"), lambda acc, c: acc + c["width"].cast("long") * c["height"])
    return F.when(total > max_samples, "TooLarge")


def unioned(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
