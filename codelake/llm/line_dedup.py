"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.store import BROADCAST_ROWS, written


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(pages: DataFrame, host: Column, text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 2) -> DataFrame:
    """(host, line_hash, n_pages, host_pages) of lines on more than ``max_ratio`` of a host's pages and at least
    ``min_pages`` of them (2: a line that stands on one page only is no boilerplate, however small its host). A page counts once for each of its distinct lines, so one aggregation with map-side
    combining does; a host or a line with a third of all rows shrinks to one row per task before the shuffle."""
    rows = pages.select(F.coalesce(host, F.lit("")).alias("host"), F.array_distinct(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), _key)).alias("_keys"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    counts = rows.select("host", F.explode("_keys").alias("line_hash")).groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    empty = F.xxhash64(F.lit(""))
    return counts.join(totals, "host").where((F.col("n_pages") > F.col("host_pages") * F.lit(max_ratio)) & (F.col("line_hash") != empty))


def drop_boilerplate(pages: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 2) -> DataFrame:
    """One row per page: doc_id, n_lines, n_dropped, text without its host's boilerplate lines.

    A host has at most (mean lines a page / max_ratio) such lines, so they fit one array per host; the join on host
    broadcasts these arrays while they are few and is otherwise a sort-merge join whose hot hosts AQE splits.

    Lines are compared without surrounding blanks; blank lines are never dropped. Nulls: a null text is one empty
    line and gives an empty text; null hosts form one host. Repeated rows count as pages each. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    found = written(boilerplate_lines(pages, host, text_col, max_ratio, min_pages).select("host", "line_hash"), "boilerplate")
    lists = found.groupBy("host").agg(F.collect_list("line_hash").alias("_drop")).withColumnRenamed("host", "_host")
    if found.count() <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    rows = pages.select(F.col(id_col).alias("doc_id"), F.coalesce(host, F.lit("")).alias("_h"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("_lines"))
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains(F.col("_drop"), _key(x))))
    return rows.join(lists, F.col("_h") == F.col("_host"), "left").select("doc_id", F.size("_lines").cast("long").alias("n_lines"), kept.alias("_kept"), (F.size("_lines")).alias("_n")).select("doc_id", "n_lines", (F.col("_n") - F.size("_kept")).cast("long").alias("n_dropped"), F.array_join("_kept", "\n").alias("text"))
