"""Quality classifier: an interpolated modified Kneser-Ney model of the characters of trusted text.

Its n-grams are runs of ``ORDER`` Unicode code points of any script. One pass counts the different n-grams of all text
(summed per task, then by key), with how often trusted text holds each; the count tables of the lower orders come from
that one, and costs are joined to it order by order. A document's cost is the sum over its n-grams: the most frequent
costs are broadcast, the others joined by key, per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.store import BROADCAST_ROWS, forget, written
from codelake.llm.textkit import U, mix, returning_memory, slices
from codelake.session import ship

ORDER = 5  # 4 to 6: an n-gram is packed in two longs, 21 bits a code point
START = 0x1FFFFF  # before a text; no code point
POINTS = 0x110000  # code points: the uniform distribution below the lowest order
HOT = 1_000_000  # costs that are broadcast at most, 20 bytes each
BUCKET_BITS = 21
TASK_KEYS = 3_000_000  # different n-grams that a task sums up before it passes them on
_PLACE = np.random.default_rng(11).integers(1, 2**62, ORDER, dtype=np.int64).astype(U) * U(2) + U(1)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 STARTs; the places of the texts' own; the text of each of these."""
    pad = "\x00" * (ORDER - 1)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    owner = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(owner)) + (owner + 1) * (ORDER - 1)
    first = np.cumsum(size + ORDER - 1) - size
    for k in range(1, ORDER):
        points[first - k] = START
    return points, at, owner


def hashed(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the n-grams that end at the places."""
    wide = points.astype(U)
    total = np.zeros(len(points), U)
    for k in range(ORDER):
        total[k:] += wide[: len(wide) - k] * _PLACE[k]
    return mix(total[at])


def packed(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of the n-grams that end at the places: the last three code points are in lo."""
    hi, lo = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for k in range(ORDER - 1, -1, -1):
        c = points[at - k].astype(np.int64)
        if k < 3:
            lo = lo << 21 | c
        else:
            hi = hi << 21 | c
    return hi, lo


def hash_of(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hi), U)
    for k in range(ORDER):
        part = (lo >> (21 * k) if k < 3 else hi >> (21 * (k - 3))) & START
        total += part.astype(U) * _PLACE[k]
    return mix(total)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, fold): hi, lo and how often texts of fold 1, of fold 2 and all texts hold each n-gram."""
    held: list[tuple[np.ndarray, ...]] = []
    waiting = done = 0

    def merged() -> tuple[np.ndarray, ...]:
        key, hi, lo, *n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key)
        at = _runs(key[order])
        first = order[at]
        return key[first], hi[first], lo[first], *(np.add.reduceat(x[order], at) for x in n)

    def batch(t: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in t[1:]], ["hi", "lo", "n1", "n2", "m"])

    for b in batches:
        texts, fold = b.column(0).to_pylist(), b.column(1).to_pylist()
        for f in (0, 1, 2):
            chosen = [t for t, g in zip(texts, fold, strict=True) if t and g == f]
            for s in slices(chosen):
                points, at, _ = code_points(chosen[s])
                key = hashed(points, at)
                order = np.argsort(key)
                run = _runs(key[order])
                m = np.diff(np.append(run, len(key)))
                none = np.zeros_like(m)
                first = order[run]
                held.append((key[first], *packed(points, at[first]), m if f == 1 else none, m if f == 2 else none, m))
                waiting += len(first)
                if waiting > max(2 * done, 600_000):
                    held = [merged()]
                    waiting = done = len(held[0][0])
                    if done > TASK_KEYS:
                        yield batch(held[0])
                        held, waiting, done = [], 0, 0
    if held:
        yield batch(merged())


def _low(bits: int) -> int:
    return (1 << bits) - 1


def _suffix(k: int) -> tuple[Column, Column]:
    """The last k characters of n-grams (hi, lo)."""
    return F.col("hi").bitwiseAND(F.lit(_low(21 * max(k - 3, 0)))), F.col("lo").bitwiseAND(F.lit(_low(21 * min(k, 3))))


def _context() -> tuple[Column, Column]:
    """The n-grams (hi, lo) without their last character."""
    return F.shiftright("hi", 21), F.shiftleft(F.col("hi").bitwiseAND(F.lit(START)), 42).bitwiseOR(F.shiftright("lo", 21))


MODELS = ("n", "n1", "n2")  # counts of all trusted texts, and of each fold


def _discounts(table: DataFrame) -> dict[str, list[float]]:
    """The three discounts of counts 1, 2 and more of each model, from its counts of counts."""
    seen = table.agg(*(F.count_if(F.col(m) == i).alias(f"{m}_{i}") for m in MODELS for i in (1, 2, 3, 4))).first()
    out = {}
    for m in MODELS:
        n1, n2, n3, n4 = (seen[f"{m}_{i}"] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        out[m] = [min(max(v, 0.0), most) for v, most in ((1 - 2 * y * n2 / n1 if n1 else y, 1.0), (2 - 3 * y * n3 / n2 if n2 else 2 * y, 2.0), (3 - 4 * y * n4 / n3 if n3 else 3 * y, 3.0))]
    return out


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(hi, lo, m, cost, cost1, cost2) for all rows of ``counts`` (hi, lo, n1, n2, m), one row an n-gram: -ln p(last
    character | those before) in the models of the counts n1 + n2, n1 and n2.

    Interpolated modified Kneser-Ney: raw counts at the top order, numbers of different left neighbours below, three
    discounts an order from its counts of counts, and the uniform distribution over all code points at the bottom. Each
    order's probabilities are joined by key to those of the order above.
    """
    counts = counts.withColumn("n", F.col("n1") + F.col("n2"))
    levels, asked = [counts.where("n > 0").select("hi", "lo", *MODELS)], [counts]
    for k in range(ORDER - 1, 0, -1):
        hi, lo = _suffix(k)
        many = (F.count_if(F.col(m) > 0).alias(m) for m in MODELS)
        levels.append(written(levels[-1].groupBy(hi.alias("hi"), lo.alias("lo")).agg(*many), "kn-level"))
        asked.append(written(asked[-1].select(hi.alias("hi"), lo.alias("lo")).distinct(), "kn-asked"))
    p = None
    for k in range(1, ORDER + 1):
        table, out = levels[ORDER - k], asked[ORDER - k]
        d = _discounts(table)
        off = {m: F.when(F.col(m) == 0, 0.0).when(F.col(m) == 1, d[m][0]).when(F.col(m) == 2, d[m][1]).otherwise(d[m][2]) for m in MODELS}
        (hi, lo), (chi, clo) = _suffix(k - 1), _context()
        context = table.groupBy(chi.alias("_chi"), clo.alias("_clo")).agg(*(F.sum(m).alias(f"_all_{m}") for m in MODELS), *(F.sum(off[m]).alias(f"_off_{m}") for m in MODELS))
        if k < ORDER:
            out = out.join(table, ["hi", "lo"], "left")
        out = out.withColumns({"_c1": chi, "_c2": clo, "_s1": hi, "_s2": lo})
        out = out.join(context, (F.col("_c1") == F.col("_chi")) & (F.col("_c2") == F.col("_clo")), "left")
        if p is None:
            out = out.withColumns({f"_p_{m}": F.lit(1.0 / POINTS) for m in MODELS})
        else:
            lower = p.select(F.col("hi").alias("_phi"), F.col("lo").alias("_plo"), *(F.col(f"p_{m}").alias(f"_p_{m}") for m in MODELS))
            out = out.join(lower, (F.col("_s1") == F.col("_phi")) & (F.col("_s2") == F.col("_plo")))
        own = {m: F.when(F.col(f"_all_{m}") > 0, (F.coalesce(F.col(m) - off[m], F.lit(0.0)) + F.col(f"_off_{m}") * F.col(f"_p_{m}")) / F.col(f"_all_{m}")).otherwise(F.col(f"_p_{m}")) for m in MODELS}
        if k < ORDER:
            p = written(out.select("hi", "lo", *(own[m].alias(f"p_{m}") for m in MODELS)), "kn-p")
    return out.select("hi", "lo", "m", *((-F.log(F.greatest(own[m], F.lit(1e-300)))).alias(m.replace("n", "cost")) for m in MODELS))


class Costs:
    """The most frequent costs, found by the top bits of their n-grams' hashes. Row 0: of the whole model, for texts that
    are not trusted; rows 1 and 2: for trusted texts of that fold, of the model of the other one."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, cost: np.ndarray, cost1: np.ndarray, cost2: np.ndarray) -> None:
        key = hash_of(hi, lo)
        order = np.argsort(key)
        self.key, self.cost = key[order], np.stack([cost, cost2, cost1]).astype(np.float32)[:, order]
        edge = np.arange(1 << BUCKET_BITS, dtype=U) << U(64 - BUCKET_BITS)
        self.begin = np.append(np.searchsorted(self.key, edge), len(key)).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not among them."""
        bucket = (key >> U(64 - BUCKET_BITS)).astype(np.int32)
        at, end = self.begin[bucket], self.begin[bucket + 1]
        out = np.full(len(key), -1, np.int32)
        left = np.flatnonzero(at < end)
        at, end, key = at[left], end[left], key[left]
        while len(left):
            same = self.key[at] == key
            out[left[same]] = at[same]
            go = ~same & (at + 1 < end)
            left, at, end, key = left[go], at[go] + 1, end[go], key[go]
        return out


SCORE = (("row", "long"), ("doc_id", "long"), ("lang", "string"), ("fold", "int"), ("n_symbols", "long"), ("cost", "double"), ("hi", "long"), ("lo", "long"), ("times", "long"), ("text_hash", "long"))


def _score(hot):
    """Over (doc_id, lang, text, fold, text_hash): a row a text with the cost of its frequent n-grams, and a row for each
    of its other n-grams with how often it holds it."""
    names = [f for f, _ in SCORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, costs = TaskContext.get().partitionId() << 36, hot.value
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            fold = b.column(3).to_numpy()
            for s in slices(texts):
                m = s.stop - s.start
                points, at, owner = code_points(texts[s])
                key = hashed(points, at)
                place = costs.find(key)
                known, late = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
                total = np.bincount(owner[known], costs.cost[fold[s][owner[known]], place[known]], m).astype(np.float64)
                size = np.bincount(owner, minlength=m)
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(m)), b.column(0)[s], b.column(1)[s], b.column(3)[s], pa.array(size), pa.array(total), *[pa.nulls(m, pa.int64())] * 3, b.column(4)[s]], names)
                if len(late):
                    tag = mix(key[late] ^ mix(owner[late].astype(U)))
                    order = np.argsort(tag)
                    begin = _runs(tag[order])
                    first, times = late[order[begin]], np.diff(np.append(begin, len(order)))
                    hi, lo = packed(points, at[first])
                    k = len(first)
                    own = owner[first]
                    yield pa.RecordBatch.from_arrays([pa.array(row + own), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.array(fold[s][own]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.array(hi), pa.array(lo), pa.array(times.astype(np.int64)), pa.nulls(k, pa.int64())], names)
                row += m

    return run


def perplexities(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """(doc_id, lang, text_hash, fold, n_symbols, perplexity) of all rows of (doc_id, lang, text), by a model of all
    documents whose id is in ``trusted_ids`` (id). Trusted documents are in fold 1 or 2 by their text's hash and scored
    by a model of the other fold; all others (fold 0) by that of both."""
    spark = docs.sparkSession
    ship(spark)
    ids = trusted_ids.select(F.col("id").alias("_tid")).where("_tid is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    fold = F.when(F.col("_tid").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("text"), F.lit(2))).cast("int")
    rows = docs.join(ids, F.col("doc_id") == F.col("_tid"), "left").select("doc_id", "lang", "text", fold.alias("fold"), F.xxhash64("text").alias("text_hash"))
    counts = rows.select("text", "fold").mapInArrow(returning_memory(_counts), "hi long, lo long, n1 long, n2 long, m long")
    counts = written(counts.groupBy("hi", "lo").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "m"))), "grams")
    costs = written(kneser_ney(counts), "costs")
    least, size = 0, 0
    for r in costs.groupBy(F.least("m", F.lit(100_000)).alias("m")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("m").desc()).collect():
        if size + r["c"] > HOT:
            least = r["m"] + 1
            break
        size += r["c"]
    table = costs.where(F.col("m") >= least).select("hi", "lo", "cost", "cost1", "cost2").toArrow()
    hot = spark.sparkContext.broadcast(Costs(*(table.column(c).to_numpy() for c in table.column_names)))
    out = written(rows.mapInArrow(returning_memory(_score(hot)), ", ".join(f"{f} {kind}" for f, kind in SCORE)), "scores")
    found = out.where("hi is null").select("row", "doc_id", "lang", "text_hash", "fold", "n_symbols", "cost")
    if least:
        other = costs.where(F.col("m") < least).select("hi", "lo", F.col("cost").alias("_cost"), "cost1", "cost2")
        each = F.when(F.col("fold") == 1, F.col("cost2")).when(F.col("fold") == 2, F.col("cost1")).otherwise(F.col("_cost"))
        late = out.where("hi is not null").select("row", "fold", "hi", "lo", "times").join(other, ["hi", "lo"]).groupBy("row").agg(F.sum(F.col("times") * each).alias("_more"))
        found = found.join(late, "row", "left").withColumn("cost", F.col("cost") + F.coalesce("_more", F.lit(0.0)))
    forget(counts)
    return found.select("doc_id", "lang", "text_hash", "fold", "n_symbols", F.when(F.col("n_symbols") > 0, F.exp(F.col("cost") / F.col("n_symbols"))).alias("perplexity"))


def _evened(short: int) -> Column:
    """Perplexity over what a text of its length may exceed that of long texts by."""
    return F.col("perplexity") / (F.lit(1.0) + F.lit(float(short)) / F.greatest(F.col("n_symbols"), F.lit(1)))


def thresholds(scored: DataFrame, quantile: float, slack: float, short: int) -> DataFrame:
    """(lang, threshold): the quantile of trusted documents' evened perplexity in each language, times ``slack``. Only a
    language without any takes the quantile of all."""
    own = scored.where("fold > 0 and perplexity is not null")
    q = F.percentile_approx(_evened(short), quantile, 10_000) * slack
    by = own.groupBy("lang").agg(q.alias("_own"))
    total = own.agg(q.alias("_all"))
    return scored.select("lang").distinct().withColumnRenamed("lang", "_l").join(by, F.col("_l") == F.col("lang"), "left").crossJoin(F.broadcast(total)).select(F.col("_l").alias("lang"), F.coalesce("_own", "_all").alias("threshold"))


def judge(scored: DataFrame, limits: DataFrame, short: int) -> DataFrame:
    small = F.broadcast(limits.withColumnRenamed("lang", "_lang")) if limits.count() <= BROADCAST_ROWS else limits.withColumnRenamed("lang", "_lang")
    keep = F.coalesce((F.col("n_symbols") > 0) & (_evened(short) <= F.col("threshold")), F.lit(False))
    return scored.join(small, F.col("lang") == F.col("_lang"), "left").withColumn("keep", keep).drop("_lang")


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, slack: float = 1.05, short: int = 100, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_symbols, perplexity, threshold, keep.

    ``trusted_ids`` (id) names the trusted documents; all of them train the model. Each is scored by a model of the other
    half of them, as if it were unknown, and the ``quantile`` of these scores in each language, times ``slack``, is the
    threshold. A document stays if its perplexity (per character) is within its language's threshold. Both sides are
    divided by 1 + short/n_symbols, as the mean of a short text's costs varies more.

    Nulls: null or empty text has 0 symbols, a null perplexity and does not stay; a null language is the empty one; a
    null id is judged like any other. Repeated rows are judged alike. Very long texts are read whole. Extra columns
    are ignored, whatever their names. An empty table gives an empty result; without any trusted text nothing stays, as
    no threshold exists.
    """
    return _judged(docs, trusted_ids, quantile, slack, short, id_col, text_col, lang_col).select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "keep")


def _judged(docs: DataFrame, trusted_ids: DataFrame, quantile: float, slack: float, short: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    scored = written(perplexities(rows, trusted_ids), "perplexity")
    return judge(scored, written(thresholds(scored, quantile, slack, short), "limits"), short)


def keep_good(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, slack: float = 1.05, short: int = 100, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns, whatever their names: rows are named by id,
    language and a hash of the text, so repeated rows stay or go together. Nulls and empty tables are as in ``classify``."""
    good = _judged(docs, trusted_ids, quantile, slack, short, id_col, text_col, lang_col).where("keep").select("doc_id", "text_hash", "lang").distinct()
    good = written(good, "good")
    good = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    names = docs.columns
    inner = docs.select(F.struct("*").alias("r"), F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("h"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("l"))
    same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")) & (F.col("l") == F.col("lang"))
    return inner.join(good, same, "left_semi").select(*(F.col("r").getField(c).alias(c) for c in names))
