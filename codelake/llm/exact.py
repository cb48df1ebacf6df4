"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.store import BROADCAST_ROWS, written


HOT_SHARE = 1000  # a group of more than one in so many rows is a hot one; there are fewer than that


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, with_digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept (and text_sha256 if ``with_digest``).

    Rows are grouped by byte length, then, where a length has company, by the hash of their first ``prefix_chars``
    characters, and only rows whose length and head have company get a full SHA-256. Of equal texts the largest id
    stays. Counts are partially aggregated before they are shuffled. Tables of lengths, heads and groups are broadcast
    while they are small; beyond that, rows are joined to lengths and heads by a shuffle, and to their group's facts by a
    broadcast of the hot groups (fewer than a thousand) and a shuffle for the others, so no task gets a hot group.

    Nulls: a null text equals the empty text; a null id is never kept unless its whole group has null ids (keep_id
    is then null, kept false). Repeated rows (same id and text) count each in group_size and share ``kept``. Very long
    texts are hashed whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    digest = F.sha2("_t", 256)
    rows = base.select("doc_id", "_t", F.octet_length("_t").cast("long").alias("_len"), *([digest.alias("text_sha256")] if with_digest else []))
    narrow = rows.select("doc_id", "_t", "_len")

    def company(of: DataFrame, key: list[str], name: str) -> DataFrame:
        found = written(of.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key), name)
        return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found

    lengths = company(narrow, ["_len"], "exact-lengths")
    head = F.xxhash64(F.substring("_t", 1, prefix_chars)).alias("_head")
    heads = company(narrow.join(lengths, "_len", "left_semi").select("_len", head), ["_len", "_head"], "exact-heads")
    open_ = rows.select(*rows.columns, head).join(heads.withColumn("_open", F.lit(True)), ["_len", "_head"], "left")
    full = F.when(F.col("_open"), F.col("text_sha256") if with_digest else digest)
    keyed = written(open_.select("doc_id", "_len", "_head", full.alias("_full"), *(["text_sha256"] if with_digest else [])), "exact-rows")
    key = ["_len", "_head", "_full"]
    groups = keyed.where("_full is not null").groupBy(*key).agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    groups = written(groups.select(*[F.col(c).alias(f"g{c}") for c in key], "_keep", "_size"), "exact-groups")
    same = [F.col(c) == F.col(f"g{c}") for c in key]
    if groups.count() <= BROADCAST_ROWS:
        out = keyed.join(F.broadcast(groups), same, "left")
    else:
        hot = F.broadcast(groups.where(F.col("_size") * HOT_SHARE > F.lit(keyed.count())))
        rest = keyed.join(hot, same, "left_anti").join(groups, same, "left")
        out = keyed.join(hot, same).unionByName(rest)
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"), *(["text_sha256"] if with_digest else []))
