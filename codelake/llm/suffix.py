"""Suffix-array dedup with a sparse suffix array at content-selected minimiser positions.

A passage of at least ``least`` words that two documents share has the same minimisers in both, and from the first of
them at least ``least - window + 1`` words to its end. Suffixes are kept at these positions only. A first pass counts
the hashes of that many words; suffixes whose hash occurs once cannot be in a repeat. The others are sorted with some
context on both sides, and suffixes of one hash are compared under every split of the words that are still missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.store import forget, written
from codelake.llm.textkit import U, grams, mix, powers, slices, words
from codelake.session import ship

GRAM = 8  # words whose hash selects the minimisers
WINDOW = 20  # consecutive grams of which the smallest is selected
MAP_BITS = (20, 29)  # the map of repeated hashes has 2**20 to 2**29 bits: 64 MB at most
PAGE = 19  # bits (as a power of two) of one page of the map


def selected(hashes: np.ndarray, place: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(word position in the batch, text) of the minimisers from which a repeat's remaining words fit in the text."""
    span, need = GRAM + WINDOW - 1, least - WINDOW + 1
    g = grams(hashes, GRAM)
    owner = np.repeat(np.arange(len(place) - 1), np.diff(place))
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, at = g[:n].copy(), np.arange(n)
    for j in range(1, WINDOW):
        less = g[j : j + n] < low
        low[less] = g[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    at = at[owner[:n] == owner[span - 1 : span - 1 + n]]
    at = np.unique(at)
    doc = owner[at]
    ok = (at + need <= place[doc + 1]) & (place[doc + 1] - place[doc] >= least)
    return at[ok], doc[ok]


def run_hash(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on."""
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix((total[at + n] - total[at]) * down[at]).view(np.int64)


def _keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for s in slices(texts):
                hashes, place = words(texts[s], lower=False)
                at, _ = selected(hashes, place, least)
                yield pa.RecordBatch.from_arrays([pa.array(run_hash(hashes, at, least - WINDOW + 1))], ["h"])

    return run


def _suffixes(least: int, shared, bits: int):
    need, side = least - WINDOW + 1, WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for s in slices(texts):
                hashes, place = words(texts[s], lower=False)
                at, doc = selected(hashes, place, least)
                h = run_hash(hashes, at, need)
                slot = (h.view(U) >> U(64 - bits)).astype(np.int64)
                ok = (seen[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                at, doc, h = at[ok], doc[ok], h[ok]
                short = np.concatenate([np.zeros(side, np.uint32), hashes.astype(np.uint32) | np.uint32(1), np.zeros(side, np.uint32)])
                step = np.arange(side)
                right = at[:, None] + need + step
                right = np.where(right < place[doc + 1][:, None], short[np.minimum(right, len(hashes)) + side], 0)
                left = at[:, None] - 1 - step
                left = np.where(left >= place[doc][:, None], short[left + side], 0)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[s][doc].astype(np.int64)), pa.array((at - place[doc]).astype(np.int32)), _rows(right), _rows(left)], NAMES)

    return run


NAMES = ["h", "doc_id", "pos", "after", "before"]


def _rows(x: np.ndarray) -> pa.Array:
    """Rows of words as big-endian bytes, so that they sort as the words do."""
    raw = x.astype(">u4").tobytes()
    return pa.array([raw[i : i + 4 * x.shape[1]] for i in range(0, len(raw), 4 * x.shape[1])] if len(x) else [], pa.binary())


def _windows(t: pa.Table, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(split, suffixes that have them, hash) of the ``least`` words that take ``split`` words from a suffix's left."""
    n, extra = t.num_rows, WINDOW - 1
    after, before = (np.frombuffer(b"".join(t.column(c).to_pylist()), ">u4").reshape(n, WINDOW)[:, :extra].T.astype(np.uint32) for c in ("after", "before"))
    term = lambda side, i, salt: mix(side[i].astype(U) + (U(salt + i + 1) << U(32)))
    n_left, n_right = (before > 0).sum(0), (after > 0).sum(0)
    total = mix(t.column("h").to_numpy().view(U))
    for i in range(extra):
        total = total + term(after, i, extra)
    for j in range(WINDOW):
        if j:
            total = total + term(before, j - 1, 0) - term(after, extra - j, extra)
        row = np.flatnonzero((n_left >= j) & (n_right >= extra - j))
        if len(row):
            yield j, row, mix(total[row] + U(j)).view(np.int64)


def _certify(least: int, later: bool):
    """Over sorted suffixes: (doc_id, start, end) of stretches that other documents hold as well. Hashes that lie
    within a batch as a whole are settled there. For the first and last one of a batch, rows with a key follow: windows
    not settled yet (doc_id, start), and once a window of two documents and more (doc_id, other)."""
    kinds = ["doc_id", "start", "end", "key", "other"]

    def table(**cols) -> pa.Table:
        n = len(next(iter(cols.values())))
        return pa.table([pa.array(cols[k].astype(np.int64)) if k in cols else pa.nulls(n, pa.int64()) for k in kinds], names=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            h, doc, pos = (t.column(c).to_numpy() for c in ("h", "doc_id", "pos"))
            open_ = (h == h[0]) | (h == h[-1])
            most, fewest = np.full(len(h), -1), np.full(len(h), WINDOW)
            for j, row, key in _windows(t, least):
                by = np.argsort(key, kind="stable")
                row, key = row[by], key[by]
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                a, b = np.minimum.reduceat(doc[row], begin), np.maximum.reduceat(doc[row], begin)
                many = np.diff(np.append(begin, len(row)))
                sure = np.repeat(a, many) < doc[row] if later else np.repeat(a != b, many)
                most[row[sure]] = j
                fewest[row[sure]] = np.minimum(fewest[row[sure]], j)
                late, known = open_[row] & ~sure, open_[row[begin]] & (a != b)
                parts = table(doc_id=doc[row[late]], start=pos[row[late]] - j, key=key[late]), table(doc_id=a[known], key=key[begin[known]], other=b[known])
                yield from (x for part in parts for x in part.to_batches() if x.num_rows)
            ok = most >= 0
            yield from table(doc_id=doc[ok], start=pos[ok] - most[ok], end=pos[ok] - fewest[ok] + least).to_batches()

    return run


def repeated_passages(docs: DataFrame, least: int = 51, id_col: str = "doc_id", text_col: str = "text", later: bool = False) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the maximal stretches of a document, of at least ``least``
    words (runs of anything but x20, x09-x0D, compared exactly), that occur in other documents as well.

    Overlapping and touching stretches are one. Every document that holds a passage has its row. With ``later``, only
    what a document of a smaller id holds as well: when ``drop_passages`` cuts these, the copy of the smallest id stays.

    Suffixes are sorted by (hash, words after, words before) over range partitions: a passage on a third of all pages
    is cut by what surrounds it. Every stretch of ``least`` words holds a minimiser and splits at it into words to the
    left, the hash's words and words to the right; suffixes of one hash are compared under all splits, so no pair is
    missed. Hashes that go beyond a batch are settled by keys of their windows, aggregated per batch before the shuffle.

    Nulls: a null text has no words; rows with null ids take no part. Rows of one id are one document: repeats among
    them do not count. Very long texts are read whole. Ties sort by id and position. Extra columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    again = rows.select("text").mapInArrow(_keys(least), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    again = written(again, "repeated")
    bits = min(max(int(np.ceil(np.log2(16 * again.count() + 1))), MAP_BITS[0]), MAP_BITS[1])

    def page(key, pdf):
        import pandas as pd

        flags = np.zeros(1 << PAGE, np.uint8)
        flags[pdf["slot"].to_numpy()] = 1
        return pd.DataFrame({"page": [key[0]], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    slot = F.expr(f"shiftrightunsigned(h, {64 - bits})")
    pages = again.select(F.shiftright(slot, PAGE).alias("page"), slot.bitwiseAND((1 << PAGE) - 1).alias("slot")).distinct().groupBy("page").applyInPandas(page, "page long, bits binary").collect()
    seen = bytearray(1 << (bits - 3))
    for r in pages:
        seen[r["page"] << (PAGE - 3) : (r["page"] + 1) << (PAGE - 3)] = r["bits"]
    forget(again)
    shared = spark.sparkContext.broadcast(bytes(seen))
    suffixes = written(rows.mapInArrow(_suffixes(least, shared, bits), "h long, doc_id long, pos int, after binary, before binary"), "suffixes")
    order = ["h", "after", "before", "doc_id", "pos"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    near = written(near.mapInArrow(_certify(least, later), "doc_id long, start long, end long, key long, other long"), "spans")
    late = near.where("key is not null")
    several = late.groupBy("key").agg(F.min("doc_id").alias("a"), F.max(F.coalesce("other", "doc_id")).alias("b")).where("a < b").select(F.col("key").alias("_key"), "a")
    late = late.where("start is not null").join(several, (F.col("key") == F.col("_key")) & (F.col("doc_id") > F.col("a")) if later else F.col("key") == F.col("_key"), "left_semi")
    found = near.where("end is not null").select("doc_id", "start", "end").unionByName(late.select("doc_id", "start", (F.col("start") + least).alias("end")))
    per_doc = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    merged = F.aggregate("s", none, lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))))
    return per_doc.select("doc_id", F.explode(merged).alias("x")).select("doc_id", F.col("x.start").alias("start_word"), F.col("x.end").alias("end_word"), (F.col("x.end") - F.col("x.start")).alias("n_words"))


def drop_passages(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of ``spans`` (doc_id, start_word, end_word); other columns and rows stay.

    The spans of a document are gathered (as many as its length allows) and joined by id; a text is cut at word
    boundaries, and what stays keeps its own white space. Null texts stay null."""
    ship(docs.sparkSession)
    cuts = spans.groupBy(F.col("doc_id").alias("_cut_id")).agg(F.array_sort(F.collect_set(F.array("start_word", "end_word"))).alias("_cuts"))

    @F.pandas_udf("string")
    def cut(text, where):  # noqa: ANN001
        import re

        import pandas as pd

        def one(t, w):
            if t is None or w is None or len(w) == 0:
                return t
            at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            out, last = [], 0
            for a, b in w:
                out.append(t[last : at[int(a)][0]])
                last = at[int(b) - 1][1]
            return "".join(out) + t[last:]

        return pd.Series([one(t, w) for t, w in zip(text, where, strict=True)], dtype=object)

    return docs.join(cuts, docs[id_col] == F.col("_cut_id"), "left").withColumn(text_col, cut(F.col(text_col), F.col("_cuts"))).select(*docs.columns)
