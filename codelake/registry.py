"""Queries of the codestream operators and the SQL they are compared with.

The driver's tables hold no images: column operators run on integers of the tables, and decoding on rasters that are
written from table values and read back (which shows that writer and reader agree, not that others' files decode).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.functions import columns as col
from codelake.operators import decode as op
from codelake.operators import encode, report
from codelake.plans import geometry
from codelake.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by a key over all cores. A table of few bytes is read in few tasks, and what a row is turned into
    (its rectangles, a file) would be made in these alone."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


# --- arithmetic on columns


@query("select p_partkey, cast(s as int) as s, cast(ceil(p_partkey / pow(2, s)) as bigint) as v from part, (select unnest([0, 1, 3, 7, 31, 33]) as s)")
def ceil_shift(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(F.array(*map(F.lit, (0, 1, 3, 7, 31, 33)))).alias("s")).withColumn("v", col.ceil_shift(F.col("p_partkey"), F.col("s")))


_RCT = "l_orderkey, l_linenumber, cast(l_quantity as bigint) as y, cast(l_partkey % 511 - 255 as bigint) as u, cast(l_suppkey % 511 - 255 as bigint) as v"


@query(f"select y, u, v, v + g as r, g, u + g as b from (select *, y - cast(floor((u + v) / 4.0) as bigint) as g from (select {_RCT} from lineitem))")
def rct_inverse(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr(*[x.strip() for x in _RCT.split(",")]).select("y", "u", "v")
    return t.withColumns(col.rct_inverse(*map(F.col, "yuv")))


@query("select l_partkey % 256 as r, l_suppkey % 256 as g, cast(l_quantity as bigint) as b from lineitem")
def rct_round_trip(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_partkey % 256 as r", "l_suppkey % 256 as g", "cast(l_quantity as bigint) as b")
    return t.select(*[v.alias(k) for k, v in col.rct_forward(*map(F.col, "rgb")).items()]).select(*[v.alias(k) for k, v in col.rct_inverse(*map(F.col, "yuv")).items()])


@query("""select y, cb, cr, cast(round(cast(y as float) + cast(1.402 as float) * cast(cr as float)) as int) as r,
cast(round(cast(y as float) - cast(0.344136 as float) * cast(cb as float) - cast(0.714136 as float) * cast(cr as float)) as int) as g, cast(round(cast(y as float) + cast(1.772 as float) * cast(cb as float)) as int) as b
from (select cast(l_quantity as bigint) as y, l_partkey % 255 - 127 as cb, l_suppkey % 255 - 127 as cr from lineitem)""")
def ict_inverse(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("cast(l_quantity as bigint) as y", "l_partkey % 255 - 127 as cb", "l_suppkey % 255 - 127 as cr")
    return t.withColumns(col.ict_inverse(*map(F.col, ("y", "cb", "cr"))))


_DEPTH_COLUMNS = ("l_partkey - 100 as v", "cast(l_linenumber + 5 as int) as depth", "l_suppkey % 2 = 1 as signed")
_DEPTHS = f"select {', '.join(_DEPTH_COLUMNS)} from lineitem"


@query(f"select v, depth, signed, case when signed then least(greatest(v, -(1 << (depth - 1))), (1 << (depth - 1)) - 1) else least(greatest(v + (1 << (depth - 1)), 0), (1 << depth) - 1) end as c from ({_DEPTHS})")
def level_shift_clamp(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*_DEPTH_COLUMNS).withColumn("c", col.level_shift_clamp(F.col("v"), F.col("depth"), F.col("signed")))


@query(f"select v, depth, signed, least(greatest(v + case when signed then 1 << (depth - 1) else 0 end, 0), (1 << depth) - 1) * 255 // ((1 << depth) - 1) as c from ({_DEPTHS})")
def export_scale8(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*_DEPTH_COLUMNS).withColumn("c", col.export_scale8(F.col("v"), F.col("depth"), F.col("signed")))


@query("""select p_partkey, gain, cast(round(pow(2.0, 8 + gain - e) * (1 + m / 2048.0) * 4194304) as bigint) as step, cast(greatest(p_size % 8 + e - 1, 0) as int) as planes
from (select p_partkey, p_size, p_partkey % 20 as e, p_partkey % 2048 as m, unnest([0, 1, 2]) as gain from part)""")
def band_step_size(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 20).alias("e"), (F.col("p_partkey") % 2048).alias("m"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("gain"))
    return t.select("p_partkey", "gain", F.round(col.step_size(F.lit(8), F.col("gain"), F.col("e"), F.col("m")).cast("double") * 4194304).cast("long").alias("step"), col.planes(F.col("p_size") % 8, F.col("e")).cast("int").alias("planes"))


@query("select p_partkey, i, case i when 0 then p_size when 1 then p_partkey else p_partkey * 2 end as step, case when i < 2 then p_size * i else 0 end as inside from part, (select unnest([0, 1, 2, 5]) as i)")
def step_fallback(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, (0, 1, 2, 5)))).alias("i"))
    steps = F.array(F.col("p_size").cast("long"), F.col("p_partkey"), F.col("p_partkey") * 2)
    return t.select("p_partkey", "i", col.step_index(steps, F.col("i")).alias("step"), col.sample(F.array(F.lit(0), F.col("p_size")), F.col("i")).alias("inside"))


_PASSES = "select distinct p_size - 1 as i, style from part, (select unnest([0, 1, 4, 5]) as style)"


@query(f"""select i, style, case when i % 3 = 0 then 'cleanup' when i % 3 = 1 then 'significance' else 'refinement' end as kind,
style in (4, 5) or (style in (1, 5) and (i = 9 or (i > 9 and (i - 10) % 3 <> 0))) as ends from ({_PASSES})""")
def pass_rules(spark, sf):
    t = table(spark, sf, "part").select((F.col("p_size") - 1).alias("i")).distinct().select("i", F.explode(F.array(*map(F.lit, (0, 1, 4, 5)))).alias("style"))
    return t.select("i", "style", col.pass_kind(F.col("i")).alias("kind"), col.ends_segment(F.col("i"), F.col("style")).alias("ends"))


@query("select o_orderkey, case when o_custkey * 1000 * 3 > 1000000 then 'TooLarge' end as error from orders")
def limits_check(spark, sf):
    one = F.struct((F.col("o_custkey").cast("int")).alias("width"), F.lit(1000).alias("height"))
    return table(spark, sf, "orders").withColumn("components", F.array(one, one, one)).select("o_orderkey", report.limits(None, 1_000_000).alias("error"))


# --- tables of parts, segments, verdicts


@query("""select l_orderkey as tile, declared, found from (select l_orderkey, count(*) as found, (list(l_linenumber % 4 order by l_linenumber desc, l_linenumber % 4 desc) filter (where l_linenumber % 4 <> 0))[1] as declared from lineitem group by 1)
where declared is not null and declared <> found""")
def tile_part_reconcile(spark, sf):
    parts = table(spark, sf, "lineitem").selectExpr("l_orderkey as tile", "l_linenumber as seq", "l_linenumber % 4 as declared")
    return report.reconcile_tile_parts(parts, ["tile"])


_PIECES = """select user_id, event_id as seq, cast(event_id % 3 + 1 as bigint) as length, event_id % 4 + 1 as passes, case when user_id % 3 = 0 then 1 else 0 end as style,
coalesce(sum(event_id % 3 + 1 + case when event_id % 5 = 0 then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as start from events"""


@query(f"""with p as ({_PIECES}), d as (select *, lag(start + length) over w as after, coalesce(sum(passes) over (partition by user_id order by seq rows between unbounded preceding and 1 preceding), 0) - 1 as i from p window w as (partition by user_id order by seq)),
f as (select *, case when after is null or start <> after or (style = 1 and (i = 9 or (i > 9 and (i - 10) % 3 <> 0))) then 1 else 0 end as fresh from d),
r as (select *, sum(fresh) over (partition by user_id order by seq) as run from f)
select user_id, cast(min(start) as bigint) as start, cast(sum(length) as bigint) as length, cast(sum(passes) as bigint) as passes from r group by user_id, run""")
def segment_merge(spark, sf):
    return report.merge_segments(spark.sql(_PIECES.replace("from events", "from {events}"), events=table(spark, sf, "events")), ["user_id"])


@query("""select l_orderkey, worst, differing, total, case when worst = 0 then 'exact' when worst <= 3 then 'within-tolerance' else 'differs' end as verdict from
(select l_orderkey, max(abs(a - b)) as worst, count(*) filter (where a <> b) as differing, count(*) as total from (select l_orderkey, l_partkey % 100 as a, l_partkey % 100 + case when l_suppkey % 4 = 0 then l_linenumber else 0 end as b from lineitem) group by 1)""")
def comparison_verdicts(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey % 100 as ours", "l_partkey % 100 + case when l_suppkey % 4 = 0 then l_linenumber else 0 end as theirs")
    return report.verdicts(t, ["l_orderkey"], tolerance=3)


# --- geometry

_TILES = """img as (select p_partkey as img, p_partkey % 7 as x0, p_partkey % 5 as y0, p_partkey % 7 + 20 + p_size * 3 as x1, p_partkey % 5 + 16 + p_size * 2 as y1 from part),
grid as (select *, (x1 + 32) // 33 as wide, (y1 + 28) // 29 as high from img),
til as (select * from (select img, t as tile, greatest(t % wide * 33, x0) as u0, greatest(t // wide * 29, y0) as v0, least(t % wide * 33 + 33, x1) as u1, least(t // wide * 29 + 29, y1) as v1 from (select *, unnest(range(wide * high)) as t from grid)) where u1 > u0 and v1 > v0)"""
_RES = (
    _TILES
    + """, com as (select *, c as comp, c + 1 as dx, 4 + c as ppx, 5 as ppy, (u0 + c) // (c + 1) as cx0, v0 as cy0, (u1 + c) // (c + 1) as cx1, v1 as cy1 from til, (select unnest([0, 1]) as c)),
rs as (select *, cast(ceil(cx0 / pow(2, 2 - res)) as bigint) as rx0, cast(ceil(cy0 / pow(2, 2 - res)) as bigint) as ry0, cast(ceil(cx1 / pow(2, 2 - res)) as bigint) as rx1, cast(ceil(cy1 / pow(2, 2 - res)) as bigint) as ry1 from com, (select unnest([0, 1, 2]) as res)),
pc as (select *, case when rx1 > rx0 then cast(ceil(rx1 / pow(2, ppx)) - floor(rx0 / pow(2, ppx)) as bigint) else 0 end as pwide, case when ry1 > ry0 then cast(ceil(ry1 / pow(2, ppy)) - floor(ry0 / pow(2, ppy)) as bigint) else 0 end as phigh from rs)"""
)
_BANDS = (
    _RES
    + """, bk as (select *, case when res = 0 then 2 else 3 - res end as n from pc, (select unnest([0, 1, 2, 3]) as k) where (res = 0) = (k = 0)),
bn as (select *, ['LL', 'HL', 'LH', 'HH'][k + 1] as band, cast(ceil(greatest(cx0 - k % 2 * pow(2, n - 1), 0) / pow(2, n)) as bigint) as bx0, cast(ceil(greatest(cy0 - k // 2 * pow(2, n - 1), 0) / pow(2, n)) as bigint) as by0,
cast(ceil(greatest(cx1 - k % 2 * pow(2, n - 1), 0) / pow(2, n)) as bigint) as bx1, cast(ceil(greatest(cy1 - k // 2 * pow(2, n - 1), 0) / pow(2, n)) as bigint) as by1 from bk),
bd as (select * from bn where bx1 > bx0 and by1 > by0)"""
)


def _tiles(spark, sf):
    img = table(spark, sf, "part").selectExpr("p_partkey as img", "p_partkey % 7 as x0", "p_partkey % 5 as y0", "p_partkey % 7 + 20 + p_size * 3 as x1", "p_partkey % 5 + 16 + p_size * 2 as y1", "0L as tx0", "0L as ty0", "33L as tw", "29L as th")
    return geometry.tiles(spread(img, "img"))


def _resolutions(spark, sf):
    t = _tiles(spark, sf).withColumn("comp", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"dx": F.col("comp") + 1, "dy": F.lit(1), "levels": F.lit(2), "ppx": F.col("comp") + 4, "ppy": F.lit(5)})
    return geometry.resolutions(t)


@query(f"with {_TILES} select * from til")
def tile_grid(spark, sf):
    return _tiles(spark, sf).select("img", "tile", "u0", "v0", "u1", "v1")


@query(f"with {_RES} select img, tile, comp, res, rx0, ry0, rx1, ry1, pwide, phigh from pc")
def resolution_rects(spark, sf):
    return _resolutions(spark, sf).select("img", "tile", "comp", "res", "rx0", "ry0", "rx1", "ry1", "pwide", "phigh")


@query(f"with {_BANDS} select img, tile, comp, res, band, bx0, by0, bx1, by1 from bd")
def band_rects(spark, sf):
    return geometry.bands(_resolutions(spark, sf)).select("img", "tile", "comp", "res", "band", "bx0", "by0", "bx1", "by1")


@query(f"""with {_BANDS}, cut as (select *, case when res = 0 then ppx else ppx - 1 end as px, case when res = 0 then ppy else ppy - 1 end as py from bd),
q as (select *, greatest((rx0 // (1 << ppx) + p % pwide) * (1 << px), bx0) as qx0, greatest((ry0 // (1 << ppy) + p // pwide) * (1 << py), by0) as qy0, least((rx0 // (1 << ppx) + p % pwide + 1) * (1 << px), bx1) as qx1, least((ry0 // (1 << ppy) + p // pwide + 1) * (1 << py), by1) as qy1 from (select *, unnest(range(pwide * phigh)) as p from cut)),
g as (select *, 1 << least(3, px) as cw, 1 << least(2, py) as ch from q where qx1 > qx0 and qy1 > qy0),
x as (select *, unnest(range(qx0 // cw, (qx1 + cw - 1) // cw)) as u from g), y as (select *, unnest(range(qy0 // ch, (qy1 + ch - 1) // ch)) as v from x)
select img, tile, comp, res, band, p as precinct, greatest(u * cw, qx0) as kx0, greatest(v * ch, qy0) as ky0, least((u + 1) * cw, qx1) as kx1, least((v + 1) * ch, qy1) as ky1 from y""")
def block_grid(spark, sf):
    b = geometry.blocks(geometry.bands(_resolutions(spark, sf)), F.lit(3), F.lit(2))
    return b.select("img", "tile", "comp", "res", "band", "precinct", "kx0", "ky0", "kx1", "ky1")


def _order(progression: str, keys: str) -> None:
    sql = f"""with {_RES}, p as (select *, unnest(range(pwide * phigh)) as precinct from pc), o as (select *, greatest((rx0 // (1 << ppx) + precinct % pwide) * (1 << (ppx + 2 - res)) * dx, u0) as x, greatest((ry0 // (1 << ppy) + precinct // pwide) * (1 << (ppy + 2 - res)), v0) as y, unnest([0, 1]) as layer from p)
select img, tile, layer, res, comp, precinct, row_number() over (partition by img, tile order by {keys}) as ord from o"""

    def packet_order(spark, sf):
        return geometry.packet_order(_resolutions(spark, sf), ["img", "tile"], progression, F.lit(2)).select("img", "tile", "layer", "res", "comp", "precinct", F.col("ord").cast("long").alias("ord"))

    packet_order.__name__ = f"packet_order_{progression.lower()}"
    query(sql)(packet_order)


for _p, _k in {"LRCP": "layer, res, comp, precinct", "RLCP": "res, layer, comp, precinct", "RPCL": "res, y, x, comp, precinct, layer", "PCRL": "y, x, comp, res, precinct, layer", "CPRL": "comp, y, x, res, precinct, layer"}.items():
    _order(_p, _k)


# --- headers


def _header_files(spark, sf, declared: str = "null"):
    ship(spark)
    rows = spread(table(spark, sf, "part").selectExpr("p_partkey as img", "p_size as size", f"cast({declared} as int) as declared"), "img")

    @F.pandas_udf("binary")
    def made(i: pd.Series, s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([encode.header_only(8 + 8 * int(n % 3), 8, 1 + 2 * int(k % 2), int(n % 6), int(k % 5), 1 + int(k % 4), declared=None if pd.isna(x) else int(x)) for k, n, x in zip(i, s, d, strict=True)])

    return rows.select("img", "size", made("img", "size", "declared").alias("content"))


@query("""with h as (select p_partkey as k, p_size as s from part), o as (
select 'components' as option, cast(1 + 2 * (k % 2) as varchar) as value from h union all select 'depths', '8' from h union all select 'sampling', '1x1' from h
union all select 'progression', ['LRCP', 'RLCP', 'RPCL', 'PCRL', 'CPRL'][k % 5 + 1] from h union all select 'layers', cast(1 + k % 4 as varchar) from h union all select 'mct', 'true' from h
union all select 'levels', cast(s % 6 as varchar) from h union all select 'block', '64x64' from h union all select 'transform', '5/3' from h union all select 'quantisation', 'none' from h
union all select 'tile_parts', cast(1 + s % 3 as varchar) from h union all select 'markers', 'COD+EOC+QCD+SIZ+SOC+SOT' from h) select option, value, count(*) as n from o group by 1, 2""")
def option_histogram(spark, sf):
    return report.option_histogram(op.headers(_header_files(spark, sf), ["img"]))


@query("""select p_partkey as img, marker, cast(n as bigint) as n from part, lateral (select unnest([{'marker': 'SOC', 'n': 1}, {'marker': 'SIZ', 'n': 1}, {'marker': 'COD', 'n': 1}, {'marker': 'QCD', 'n': 1}, {'marker': 'SOT', 'n': 1 + p_size % 3}, {'marker': 'EOC', 'n': 1}], recursive := true))""")
def marker_histogram(spark, sf):
    return report.marker_histogram(op.headers(_header_files(spark, sf), ["img"], columns=["markers"]), ["img"])


@query("""select kind, depth, ord, count(*) as n, cast(sum(size) as bigint) as bytes from (select unnest([{'ord': 0, 'kind': 'jP  ', 'depth': 0, 'size': 4}, {'ord': 1, 'kind': 'ftyp', 'depth': 0, 'size': 12}, {'ord': 2, 'kind': 'jp2h', 'depth': 0, 'size': 37}, {'ord': 3, 'kind': 'ihdr', 'depth': 1, 'size': 14}, {'ord': 4, 'kind': 'colr', 'depth': 1, 'size': 7},
{'ord': 5, 'kind': 'jp2c', 'depth': 0, 'size': 2 + 40 + 3 * (1 + 2 * (p_partkey % 2)) + 14 + 6 + 3 * (p_size % 6) + 14 * (1 + p_size % 3) + 2}], recursive := true) from part) group by 1, 2, 3""")
def box_walk(spark, sf):
    @F.pandas_udf("binary")
    def wrapped(c: pd.Series) -> pd.Series:
        return c.map(lambda b: encode.wrap(bytes(b)))

    b = op.boxes(_header_files(spark, sf).withColumn("content", wrapped("content")), ["img"])
    return b.groupBy("kind", "depth", "ord").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


@query("""select p_partkey as img, case when p_partkey % 3 = 0 then 'MalformedMarkerSegment' end as strict_error, cast(null as varchar) as permissive_error, case when p_partkey % 3 = 0 then 1 + p_size % 3 else 0 end as repairs,
case when p_partkey % 3 = 0 then 9 end as declared, case when p_partkey % 3 = 0 then 1 end as found from part""")
def strict_vs_permissive(spark, sf):
    files = _header_files(spark, sf, "case when p_partkey % 3 = 0 then 9 end")
    a = op.headers(files, ["img", "content"], "strict", columns=["error"]).select("img", "content", F.col("error.kind").alias("strict_error"))
    b = op.headers(a, ["img", "strict_error"], "permissive", columns=["repairs", "error"])
    return b.select("img", "strict_error", F.col("error.kind").alias("permissive_error"), F.size("repairs").alias("repairs"), F.get("repairs", F.lit(0))["declared"].alias("declared"), F.get("repairs", F.lit(0))["found"].alias("found"))


@query("select p_partkey as img, true as agrees from part")
def part_counts_written(spark, sf):
    files = op.with_true_part_counts(_header_files(spark, sf, "case when p_partkey % 3 = 0 then 9 end"), ["img"])
    return op.headers(files, ["img"], "strict").select("img", F.col("error").isNull().alias("agrees"))


# --- transforms and whole images


@query("select event_id // 64 as signal, cast(row_number() over (partition by event_id // 64 order by event_id) - 1 as bigint) as pos, cast(round(value * 100) as bigint) as v from events")
def dwt53_inverse(spark, sf):
    from codelake.kernels import wavelet

    def trip(key, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("event_id")
        start = int(key[0]) % 3
        return pd.DataFrame({"signal": key[0], "pos": np.arange(len(p)), "v": wavelet.synthesise_53(wavelet.analyse_53(p["v"].to_numpy(), start), start)})

    ship(spark)
    rows = table(spark, sf, "events").select("event_id", F.call_function("div", F.col("event_id"), F.lit(64).cast("long")).alias("signal"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return rows.groupBy("signal").applyInPandas(trip, "signal long, pos long, v long")


@query("select n, s as start, 100 as lowest, 100 as highest from (select unnest(range(2, 40)) as n), (select unnest([0, 1]) as s)")
def dwt97_flat(spark, sf):
    from codelake.kernels import wavelet

    def flat(parts):
        for p in parts:
            v = [wavelet.synthesise_97(np.where((np.arange(n) + s) % 2 == 0, 100, 0), s) for n, s in zip(p["n"], p["start"], strict=True)]
            yield p.assign(lowest=[round(float(x.min())) for x in v], highest=[round(float(x.max())) for x in v])

    ship(spark)
    return spark.range(2, 40).select(F.col("id").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("start")).mapInPandas(flat, "n long, start int, lowest int, highest int")


_RASTER = {"r": "cast(floor(o_totalprice) as bigint) % 256", "g": "o_custkey % 256", "b": "o_orderkey * 7 % 256"}


#: Pictures whose blocks are coded together, however many an Arrow batch holds.
WRITTEN = 512


def _raster_files(spark, sf, planes: str, by_img: Callable[[int], dict] | None = None, **options):
    """16x16 pictures of 256 neighbouring order keys, written as codestreams; keys that are missing are black. ``by_img``:
    options of each picture. With ``sampling``, components hold every dx-th sample of every dy-th row."""

    def picture(img: int, pixels: pa.StructArray) -> tuple[list[np.ndarray], dict]:
        x = np.zeros((len(planes), 256), np.int64)
        x[:, pixels.field("pos").to_numpy()] = [pixels.field(c).to_numpy() for c in planes]
        each, more = list(x.reshape(-1, 16, 16)), by_img(img) if by_img else {}
        if "sampling" in options:
            more["size"] = (16, 16)
            each = [v[::dy, ::dx] for v, (dx, dy) in zip(each, options["sampling"], strict=True)]
        return each, {**options, **more}

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, WRITTEN):
                some = b.slice(at, WRITTEN)
                files = encode.encode_images([picture(i.as_py(), x.values) for i, x in zip(some.column(0), some.column(1), strict=True)])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([encode.wrap(f) for f in files], pa.binary())], ["img", "content"])

    ship(spark)
    rows = table(spark, sf, "orders").selectExpr("o_orderkey div 256 as img", "o_orderkey % 256 as pos", *[f"{_RASTER[c]} as {c}" for c in planes])
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16)
    return rows.repartition(n, "img").groupBy("img").agg(F.collect_list(F.struct("pos", *planes)).alias("pixels")).mapInArrow(made, "img long, content binary")


def _raster_sql(planes: str) -> str:
    parts = " union all ".join(f"select img, cast({i} as int) as component, cast(p as int) as pos, cast(coalesce({c}, 0) as int) as value from g" for i, c in enumerate(planes))
    return f"with o as (select o_orderkey // 256 as img, o_orderkey % 256 as p, {', '.join(f'{_RASTER[c]} as {c}' for c in planes)} from orders), g as (select i.img, x.p, {', '.join(planes)} from (select distinct img from o) i cross join (select unnest(range(256)) as p) x left join o on o.img = i.img and o.p = x.p) {parts}"


@query(_raster_sql("r"))
def decode_grey(spark, sf):
    return op.samples(op.decode(_raster_files(spark, sf, "r"), ["img"]), ["img"])


@query(_raster_sql("rgb"))
def decode_rgb(spark, sf):
    return op.samples(op.decode(_raster_files(spark, sf, "rgb", mct=True, levels=3, precincts=3, progression=2), ["img"], "permissive"), ["img"])


@query(_raster_sql("g"))
def decode_tiled(spark, sf):
    """Tile by tile, each its own row, put together by place."""
    tiles = op.decode_by_tile(_raster_files(spark, sf, "g", tile=8, progression=4, eph=True), ["img"])
    t = tiles.select("img", F.explode("planes").alias("p")).select("img", "p.*").select("img", "component", "x", "y", "width", F.posexplode("samples").alias("k", "value"))
    return t.select("img", "component", ((F.col("y") + F.call_function("div", F.col("k"), F.col("width")).cast("int")) * 16 + F.col("x") + F.col("k") % F.col("width")).alias("pos"), "value")


@query("""with recursive lcg(i, s) as (select 0, (99::bigint * 1103515245 + 12345) % 4294967296 union all select i + 1, (s * 1103515245 + 12345) % 4294967296 from lcg where i < 279),
p as (select i, i % 20 as x, i // 20 as y, (s >> 21) % 64 as n from lcg), v as (select i, unnest([0, 1, 2]) as c, [17 * x + 5 * y + n, x * x + 11 * y + n, 9 * xor(x, y) + n] as v from p)
select name, cast(c as int) as component, cast(i as int) as pos, cast(v[c + 1] % 256 as int) as value from v, (select unnest(['rgb', 'rgb-precincts', 'grey-tiled']) as name) where c = 0 or name <> 'grey-tiled'""")
def golden_pictures(spark, sf):
    rgb = encode.golden_picture()
    rows = [("rgb", encode.encode_image(rgb, mct=True, levels=5)), ("rgb-precincts", encode.encode_image(rgb, mct=True, levels=2, precincts=5, progression=2)), ("grey-tiled", encode.encode_image(rgb[:1], tile=8))]
    return op.samples(op.decode(spark.createDataFrame(rows, "name string, content binary"), ["name"]), ["name"])


def _damaged() -> list[tuple[str, bytes]]:
    whole = encode.wrap(encode.encode_image(encode.golden_picture(), mct=True, levels=3, tile=13))
    rows = [(f"cut-{n}", whole[:n]) for n in (1, 2, 8, 40, 60, 100, 200, 400, 800, len(whole) - 1)]
    return rows + [(f"byte-{i}-{m}", whole[:i] + bytes([whole[i] ^ m]) + whole[i + 1 :]) for i in range(0, len(whole), 7) for m in (0xFF, 0x01, 0x80)]


_DAMAGED_SIZE = 1186  # of the file that is damaged


@query(f"""select case_id, true as survived, false as both from (select 'cut-' || n as case_id from (select unnest([1, 2, 8, 40, 60, 100, 200, 400, 800, {_DAMAGED_SIZE - 1}]) as n)
union all select 'byte-' || i || '-' || m from (select unnest(range(0, {_DAMAGED_SIZE}, 7)) as i), (select unnest([255, 1, 128]) as m))""")
def damaged_inputs(spark, sf):
    """Truncated and altered files: each has an error, or all its planes; none has both or fails the job."""
    d = op.decode(spark.createDataFrame(_damaged(), "case_id string, content binary").repartition(16), ["case_id"], "permissive", max_samples=100_000)
    planes = F.col("components").isNotNull()
    return d.select("case_id", (F.col("error").isNotNull() | (planes & (F.size("components") == F.expr("aggregate(components, 0, (n, c) -> n + if(size(c.samples) = c.width * c.height, 1, 0))")))).alias("survived"), (F.col("error").isNotNull() & planes).alias("both"))


@query(_raster_sql("r").replace("select img, cast(0 as int) as component, cast(p as int) as pos", "select img, cast(p as int) as pos"))
def export_ppm(spark, sf):
    """P5 bytes by position."""
    files = op.export(op.decode(_raster_files(spark, sf, "r"), ["img"]), ["img"])
    return codec_queries._bytes_by_position(files.where("substring(file, 1, 13) = cast('P5\\n16 16\\n255\\n' as binary)"), 13)


from codelake import codec_queries  # noqa: E402  (registers its queries)
