"""Mixing sources to target weights: hierarchical token budgets over a domain-language-source tree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.llm.store import written

BUCKET_HEX = 3  # 16**3 order buckets in each leaf


def n_words(text: Column) -> Column:
    """Words (runs of anything but x20, x09-x0D) of a text; 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))).cast("long")


def water_fill(budget: int, weights: Mapping[str, float], room: Mapping[str, int]) -> dict[str, int]:
    """Integer shares of ``budget`` by weight, none above its room; what one cannot take goes to the others by
    weight, round after round. What all of them together cannot take stays unspent (the caller's siblings get it)."""
    given, active = dict.fromkeys(room, 0), sorted(k for k in room if room[k] > 0 and weights.get(k, 0) > 0)
    left = min(budget, sum(room[k] for k in active))
    while left > 0 and active:
        total = sum(weights[k] for k in active)
        full = [k for k in active if left * weights[k] / total >= room[k] - given[k]]
        if full:
            for k in full:
                left -= room[k] - given[k]
                given[k] = room[k]
                active.remove(k)
            left = max(left, 0)
            continue
        exact = {k: left * weights[k] / total for k in active}
        whole = {k: int(exact[k]) for k in active}
        spare = left - sum(whole.values())
        for k in sorted(active, key=lambda k: (whole[k] - exact[k], k))[:spare]:
            whole[k] += 1
        for k in active:
            given[k] += whole[k]
        left = 0
    return given


def leaf_budgets(leaves: Mapping[tuple[str, ...], int], weights: Mapping[tuple[str, ...], float], budget: int, max_epochs: int) -> dict[tuple[str, ...], int]:
    """Budget of every leaf of a tree of any depth. ``leaves``: tokens by path; ``weights``: by path of any node (1 if
    not named). Each level is filled with the room of whole subtrees, so a leaf's shortage goes to its siblings first
    and reaches an ancestor's siblings only when the whole subtree is short."""
    out: dict[tuple[str, ...], int] = {}

    def down(path: tuple[str, ...], below: dict[tuple[str, ...], int], amount: int) -> None:
        if set(below) == {path}:
            out[path] = min(amount, below[path] * max_epochs)
            return
        parts: dict[str, dict[tuple[str, ...], int]] = {}
        for leaf, n in below.items():
            parts.setdefault(leaf[len(path)], {})[leaf] = n
        room = {k: sum(v.values()) * max_epochs for k, v in parts.items()}
        for k, share in water_fill(amount, {k: float(weights.get((*path, k), 1.0)) for k in parts}, room).items():
            down((*path, k), parts[k], share)

    if leaves:
        down((), dict(leaves), budget)
    return out


def mix_sources(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple[str, ...], float], share: float = 0.5, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *levels, n_tokens, epoch): the documents drawn for each leaf, once per epoch that has them.

    The budget is ``share`` of all tokens. A leaf with budget b and n tokens gives b // n whole epochs and then a
    prefix of one more: its documents in the order of md5(seed, epoch, id), as long as their running token sum stays
    within b % n. Prefix sums run in two steps: sums of 4,096 hash buckets a leaf, and rows only in the one bucket
    that holds the cut, so a leaf with a third of all rows never meets in one task. Only the leaf sums (one row per
    source) reach the driver.

    Nulls: null text has 0 tokens; null level values are the empty string; rows with a null id are not drawn. A
    document of 0 tokens is drawn with whole epochs and within the prefix. Repeated rows are drawn each.
    Ties in the order are broken by id. Extra columns are ignored. An empty table gives an empty result.
    """
    names = list(levels)
    base = docs.select(F.col(id_col).alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in levels.items()], n_words(F.col(text_col)).alias("n_tokens")).where("doc_id is not null")
    rows = written(base, "mix-rows")
    leaves = {tuple(r[k] for k in names): r["n"] for r in rows.groupBy(*names).agg(F.sum("n_tokens").alias("n")).collect()}
    budgets = leaf_budgets(leaves, weights, int(share * sum(leaves.values())), max_epochs)
    plan = [(*leaf, b // leaves[leaf] if leaves[leaf] else 0, b % leaves[leaf] if leaves[leaf] else 0) for leaf, b in sorted(budgets.items())]
    spark = docs.sparkSession
    schema = ", ".join([*(f"`{k}` string" for k in names), "_whole long", "_rest long"])
    drawn = rows.join(F.broadcast(spark.createDataFrame(plan, schema)) if len(plan) < 100_000 else spark.createDataFrame(plan, schema), names)
    whole = drawn.where("_whole > 0").select("doc_id", *names, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_whole").cast("int"))).alias("epoch"))
    part = drawn.where("_rest > 0").withColumn("epoch", (F.col("_whole") + 1).cast("int"))
    part = part.withColumn("_order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string")).cast("binary")))
    part = part.withColumn("_bucket", F.substring("_order", 1, BUCKET_HEX))
    from pyspark.sql import Window

    sums = part.groupBy(*names, "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_before"])
    placed = part.join(sums, [*names, "_bucket"]).where("_before <= _rest")
    sure = placed.where("_before + _sum <= _rest").select("doc_id", *names, "n_tokens", "epoch")
    at_cut = placed.where("_before + _sum > _rest")
    run = F.sum("n_tokens").over(Window.partitionBy(*names, "_bucket").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    cut = at_cut.withColumn("_run", F.col("_before") + run).where("_run <= _rest").select("doc_id", *names, "n_tokens", "epoch")
    return whole.unionByName(sure).unionByName(cut)
