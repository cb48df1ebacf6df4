"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.store import BROADCAST_ROWS, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs between words; the class [^x00-x2F x3A-x60 x7B-x7F] after lower-casing, so A-Z belong to words here.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Array of the words of a text, A-Z lower-cased and nothing else; empty for null."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, GAP), "")


def item_windows(items: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(window array<string>, n, items array<string>): the distinct windows of all items."""
    words = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    cut = words.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, F.least(F.lit(width), F.size("w"))).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("window"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A window is ``width`` consecutive words of an item, or all words of a shorter one. A word inside any occurrence of
    a window is hit; contaminated means n_hit > 0 and 100 * n_hit >= percent * n_words.

    Set join with prefix filter: a window's words are ordered by their frequency in the corpus, rarest first. As whole
    containment is asked for, one prefix word is necessary and enough. Only occurrences of these words are joined;
    the word's place in the window gives the one possible alignment, which must lie within the document (length and
    position bounds), and the slice must equal the window. Windows with a word that the corpus lacks are left out at
    once. The window tables are broadcast while the benchmark is small. Otherwise occurrences of prefix words are found
    by a shuffle of (row, place, word) alone, and windows and whole word lists are joined to the candidates only.

    Nulls: a null text has no words; items with null id or without words are no items; a row with a null id gets its
    own result. Repeated rows get the same result each. Ties in rarity go to the smaller word, then the first place.
    Extra columns are ignored, whatever their names. Empty tables give an empty result or no hits.
    """
    tokens = written(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_d"), words_of(F.col(text_col)).alias("words")).withColumn("n_words", F.size("words").cast("long")), "words")
    windows = written(item_windows(items, width, item_col, item_text_col).withColumn("wid", F.xxhash64(F.concat_ws("\u0001", "window"))), "windows")
    small = windows.count() * width <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda x: x)

    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    frequency = tokens.select(F.explode("words").alias("word")).join(near(vocabulary), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    placed = windows.select("wid", "n", F.posexplode("window").alias("off", "word")).join(near(frequency), "word")
    anchors = placed.groupBy("wid", "n").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("df", "word", "off")).alias("a")).where("known = n").select("wid", F.col("a.word").alias("anchor"), F.col("a.off").alias("off"), "n")
    start = F.col("pos") - F.col("off")
    bounds = (F.col("word") == F.col("anchor")) & (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    if small:
        prefix = written(anchors.drop("n").join(windows, "wid").select("anchor", "off", "n", "window", "items"), "prefix")
        rows = tokens.select("doc_id", "_d", "words", "n_words", F.posexplode("words").alias("pos", "word"))
        whole = bounds & (F.slice("words", start + 1, F.col("n")) == F.col("window"))
        hits = rows.join(F.broadcast(prefix), whole).select("doc_id", "_d", start.alias("s"), (start + F.col("n")).alias("e"), "items")
    else:
        prefix = written(anchors.select("wid", "anchor", "off", "n"), "prefix")
        rows = tokens.select("doc_id", "_d", "n_words", F.posexplode("words").alias("pos", "word"))
        maybe = rows.join(prefix, bounds).select("doc_id", "_d", "wid", start.alias("s")).distinct().join(windows, "wid")
        texts = tokens.select(F.col("doc_id").alias("_i"), F.col("_d").alias("_h"), "words").dropDuplicates(["_i", "_h"])
        found = maybe.join(texts, F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("_d").eqNullSafe(F.col("_h")))
        hits = found.where(F.slice("words", F.col("s") + 1, F.col("n")) == F.col("window")).select("doc_id", "_d", "s", (F.col("s") + F.col("n")).alias("e"), "items")

    per_doc = hits.groupBy("doc_id", "_d").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_spans", begin, lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).cast("long").alias("n")))
    per_doc = per_doc.select(F.col("doc_id").alias("_i"), F.col("_d").alias("_h"), covered["n"].alias("n_hit"), "_items")
    found = written(per_doc, "hits")
    out = tokens.select("doc_id", "_d", "n_words").join(found, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_d") == F.col("_h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    named = F.coalesce("_items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(named).cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"), named.alias("items"))
