"""The public DataFrame operators: decoding, headers, containers, export. Each takes a table with a BINARY column.

Filters that matter for cost (tiles, limits, mode) are arguments, because nothing is pushed below a Python node; and
``headers`` and ``boxes`` never decode samples.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Container, Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from codelake.operators import image
from codelake.session import ship
from codelake.sources import headers as h

ERROR = "error struct<offset:bigint,kind:string,value:int,message:string>"
REPAIRS = "repairs array<struct<kind:string,tile:int,component:int,declared:int,found:int,marker:int,message:string>>"
COMPONENTS = "components array<struct<width:int,height:int,dx:int,dy:int,depth:int,signed:boolean,samples:array<int>>>"
CONTAINER = "colour_space struct<name:string,code:bigint>, channel_definitions array<struct<cn:int,typ:int,asoc:int>>, palette array<array<int>>, component_map array<struct<cmp:int,mtyp:int,pcol:int>>"
STYLE = "tile_style struct<progression:string,layers:int,mct:boolean,sop:boolean,eph:boolean,levels:int,block_width:int,block_height:int,block_style:int,transform:string,precincts:array<struct<ppx:int,ppy:int>>,quant_style:string,guard_bits:int>"
COMPONENT_STYLES = "component_styles array<struct<tile:int,component:int,levels:int,block_style:int,transform:string,quant_style:string,roi_shift:int>>"
HEADER = f"start bigint, header struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint,tile_x0:bigint,tile_y0:bigint,tile_width:bigint,tile_height:bigint,components:array<struct<depth:int,signed:boolean,dx:int,dy:int>>>, {STYLE}, {COMPONENT_STYLES}, markers array<struct<marker:string,offset:bigint,length:int>>, tile_parts array<struct<seq:int,tile:int,part_index:int,declared:int,start:bigint,end:bigint,sot:bigint>>, {REPAIRS}, {ERROR}, {CONTAINER}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """Of lists of planes, the samples are joined as arrays, without an object a sample; of anything else, ``pa.array``."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type) and kind.value_type.get_field_index("samples") >= 0):
        return pa.array(values, kind)
    planes = [p for v in values for p in v or ()]
    ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    columns = []
    for f in kind.value_type:
        if f.name == "samples":
            samples = np.concatenate([np.zeros(0, np.int32), *(p["samples"] for p in planes)]).astype(np.int32, copy=False)
            columns.append(pa.ListArray.from_arrays(ends(len(p["samples"]) for p in planes), pa.array(samples), type=f.type))
        else:
            columns.append(pa.array([p[f.name] for p in planes], f.type))
    return pa.ListArray.from_arrays(ends(len(v or ()) for v in values), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind, mask=pa.array([v is None for v in values], pa.bool_()))


def _values(column: pa.Array) -> Iterator:
    """The column's values one at a time; planes' samples stay arrays."""
    kind = column.type
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type) and kind.value_type.get_field_index("samples") >= 0):
        yield from (v.as_py() for v in column)
        return
    others = [f.name for f in kind.value_type if f.name != "samples"]
    for v in column:
        if not v.is_valid:
            yield None
            continue
        rest = [v.values.field(n).to_pylist() for n in others]
        samples = [s.values.to_numpy(zero_copy_only=False) if s.is_valid else None for s in v.values.field("samples")]
        yield [{**dict(zip(others, r, strict=True)), "samples": s} for s, *r in zip(samples, *rest, strict=True)]


def _weight(row: dict) -> int:
    return 64 + sum(len(p["samples"]) for p in row.get("components") or row.get("planes") or ()) + sum(map(len, row.get("streams") or ())) + len(row.get("file") or b"") // 4


#: Samples, about, of the rows that a worker holds before it hands them on.
AT_ONCE = 1 << 20


def _mapped(df: DataFrame, key: list[str], content: str, schema: str | StructType, every: Callable[[Iterable[bytes | None]], Iterable[dict]], more: list[str] | None = None) -> DataFrame:
    """``key`` and the columns of ``schema`` from what ``every`` makes of the contents of an Arrow batch (or, with
    ``more``, of tuples of the contents and these columns), one after the other. Rows are handed on in groups of bounded
    size, so a worker holds no more of a batch of many files than of one of few."""
    ship(df.sparkSession)
    source = df.select(*[F.col(k) for k in key], F.col(content).alias("_content"), *[F.col(m).alias(f"_more_{i}") for i, m in enumerate(more or [])])
    kept = StructType(source.schema.fields[: len(key)])
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*key, *fields.names]

    def batch(b: pa.RecordBatch, at: int, found: list[dict]) -> pa.RecordBatch:
        made = [_array([r.get(n) for r in found], k) for n, k in zip(fields.names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*(b.column(i).slice(at, len(found)) for i in range(len(key))), *made], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [_values(b.column(i)) for i in range(len(key), b.num_columns)]
            at, size, found = 0, 0, []
            for row in every(zip(*columns, strict=True) if more else columns[0]):
                found.append(row)
                size += _weight(row)
                if size >= AT_ONCE:
                    yield batch(b, at, found)
                    at, size, found = at + len(found), 0, []
            if found:
                yield batch(b, at, found)

    return source.mapInArrow(run, StructType([*kept.fields, *fields.fields]))


def _one(f: Callable[[bytes | None], dict]) -> Callable[[Iterable[bytes | None]], Iterable[dict]]:
    return lambda contents: map(f, contents)


def decode(df: DataFrame, key: list[str], mode: str = "strict", content: str = "content", max_samples: int = h.MAX_SAMPLES, max_coefficients: int = h.MAX_COEFFICIENTS, tiles: list[int] | None = None) -> DataFrame:
    """(*key, width, height, components, repairs, error, container columns). ``mode``: strict or permissive. A file
    that cannot be decoded has an error and null components; no file fails the job. The files of an Arrow batch are
    decoded together, in groups of bounded size."""
    if mode not in ("strict", "permissive"):
        raise ValueError("mode is strict or permissive")
    every = lambda contents: image.decode_files(((b, tiles) for b in contents), mode == "permissive", max_samples, max_coefficients)
    return _mapped(df, key, content, f"width bigint, height bigint, {COMPONENTS}, {REPAIRS}, {ERROR}, {CONTAINER}", every)


def _header(b: bytes | None, permissive: bool, columns: Container[str]) -> dict:
    out: dict = {"repairs": [], "error": None, "markers": [], "tile_parts": [], "start": None}
    try:
        where = h.container(b or b"")
        out |= {k: where[k] for k in ("colour_space", "channel_definitions", "palette", "component_map", "start")}
        if where["start"] is None:
            raise h.CodestreamError("NotACodestream")
        s = h.parse(b, where["start"], where["end"], permissive)
        code, steps = s.style.blocks(-1), s.style.steps(-1)
        made = {
            "header": lambda: {k: s.header[k] for k in ("x0", "y0", "x1", "y1", "tile_x0", "tile_y0", "tile_width", "tile_height", "components")},
            "tile_style": lambda: {"progression": h.PROGRESSIONS[s.style.progression or 0], "layers": s.style.layers, "mct": s.style.mct, "sop": s.style.sop, "eph": s.style.eph, "levels": code.levels, "block_width": 1 << code.width, "block_height": 1 << code.height, "block_style": code.style, "transform": h.TRANSFORMS[code.reversible], "precincts": [{"ppx": x, "ppy": y} for x, y in code.precincts], "quant_style": h.QUANTISATIONS[steps.style], "guard_bits": steps.guard},
            "component_styles": lambda: [{"tile": t, "component": c, "levels": x.blocks(c).levels, "block_style": x.blocks(c).style, "transform": h.TRANSFORMS[x.blocks(c).reversible], "quant_style": h.QUANTISATIONS[x.steps(c).style], "roi_shift": x.shift(c)} for t, x in [(None, s.style), *sorted(s.tiles.items())] if t is None or x.cod or x.coc or x.qcd or x.qcc or x.rgn for c in range(len(s.header["components"]))],
            "markers": lambda: [{"marker": h.NAMES.get(m["marker"], f"{m['marker']:04X}"), "offset": m["offset"], "length": m["length"]} for m in s.markers], "tile_parts": lambda: s.parts, "repairs": lambda: s.repairs,
        }
        out |= {k: f() for k, f in made.items() if k in columns}
    except (h.CodestreamError, *image.DAMAGE) as e:
        out["error"] = image.error(e)
    return out


def headers(df: DataFrame, key: list[str], mode: str = "permissive", content: str = "content", columns: list[str] | None = None) -> DataFrame:
    """(*key, header, tile_style, component_styles, markers, tile_parts, repairs, error, container columns), without
    decoding. ``component_styles`` has what holds for every component by default (null tile) and in each tile whose
    headers say something else. ``columns``: only these are made."""
    kept = StructType([f for f in StructType.fromDDL(HEADER).fields if columns is None or f.name in columns])
    names = frozenset(kept.names)
    return _mapped(df, key, content, kept, _one(lambda b: _header(b, mode == "permissive", names)))


def boxes(df: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(*key, ord, kind, depth, start, end): one row per container box."""
    every = _mapped(df, key, content, "boxes array<struct<kind:string,depth:int,start:bigint,end:bigint>>", _one(lambda b: {"boxes": h.walk_boxes(b or b"")}))
    return every.select(*key, F.posexplode("boxes").alias("ord", "b")).select(*key, "ord", "b.*")


def document_images(df: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(*key, ord, content): wavelet-coded image streams embedded in document files."""
    every = _mapped(df, key, content, "streams array<binary>", _one(lambda b: {"streams": h.pdf_image_streams(b or b"")}))
    return every.select(*key, F.posexplode("streams").alias("ord", "content"))


def unwrap(df: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(*key, content): the codestream of each container; contents without one stay as they are, null stays null."""
    return _mapped(df, key, content, "content binary", _one(lambda b: {"content": None if b is None else h.unwrap(b)}))


def with_true_part_counts(df: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(*key, content) with the found number of tile-parts written into every tile-part header."""

    def one(b: bytes | None) -> dict:
        try:
            return {"content": h.write_part_counts(b)}
        except (h.CodestreamError, TypeError, *image.DAMAGE):
            return {"content": b}

    return _mapped(df, key, content, "content binary", _one(one))


def _tile_streams(b: bytes | None, permissive: bool) -> dict:
    """A codestream of its own for every tile: the main header, the tile's parts, the end."""
    try:
        where = h.container(b or b"")
        if where["start"] is None:
            raise h.CodestreamError("NotACodestream")
        s = h.parse(b, where["start"], where["end"], permissive)
        main = b[where["start"] : min((p["sot"] for p in s.parts), default=s.body)]
        body: dict[int, list[bytes]] = {t: [] for t in range(s.header["tiles_wide"] * s.header["tiles_high"])}
        for p in s.parts:
            body[p["tile"]].append(b[p["sot"] : p["end"]])
        return {"streams": [{"tile": t, "content": b"".join([main, *parts, b"\xff\xd9"]), "error": None} for t, parts in body.items()]}
    except (h.CodestreamError, *image.DAMAGE) as e:
        return {"streams": [{"tile": None, "content": None, "error": image.error(e)}]}


def decode_by_tile(df: DataFrame, key: list[str], mode: str = "strict", content: str = "content", max_samples: int = h.MAX_SAMPLES, max_coefficients: int = h.MAX_COEFFICIENTS, by_block: bool = False) -> DataFrame:
    """(*key, tile, planes, repairs, error): large images tile by tile, as rows of their own over the cluster.

    Every tile travels with the main header and its own parts only, so about one file's bytes are shuffled per file.
    ``planes`` has the tile's rectangle of each component (component, x, y, width, height, samples). ``max_samples``
    holds for the components of the whole image, ``max_coefficients`` for a tile's component. A file whose headers are
    wrong has one row with its error and a null tile; repairs of headers are those that ``headers`` lists.

    ``by_block`` is for tiles that are too large for one task: their packets are read first, code-blocks travel as rows
    of their own and are decoded in lanes anywhere, and their coefficients come back to the tile, which is then
    transformed as a whole."""
    if mode not in ("strict", "permissive"):
        raise ValueError("mode is strict or permissive")
    permissive = mode == "permissive"
    listed = _mapped(df, key, content, f"streams array<struct<tile:bigint,content:binary,{ERROR.replace('error struct', 'error:struct')}>>", _one(lambda b: _tile_streams(b, permissive)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = listed.select(*key, F.explode("streams").alias("_s")).select(*key, "_s.tile", "_s.content", F.col("_s.error").alias("_error")).repartition(n, *key, "tile")

    def every(found: Iterable[tuple]) -> Iterator[dict]:
        whole: deque[bool] = deque()  # rows read and not yet handed on: whether they hold a tile

        def given() -> Iterator[tuple]:
            for b, t, *known in found:
                whole.append(t is not None)
                if t is not None:
                    yield b, [t], *known

        if by_block:
            made = (image.finish_tile(*tile, permissive, max_samples, max_coefficients) for tile in given())
        else:
            made = image.decode_files(given(), permissive, max_samples, max_coefficients, whole=False)
        for out in made:
            while not whole.popleft():
                yield {"repairs": []}
            yield out | {"repairs": [r for r in out["repairs"] if r["kind"] in ("TileMissing", "PacketsRunPastTheirTile", "CodeBlockDamaged")]}
        yield from ({"repairs": []} for _ in whole)

    more = ["tile"]
    if by_block:
        rows, more = _with_coefficients(rows, key, n, lambda b, t: image.tile_jobs(b, t, permissive, max_samples, max_coefficients)), ["tile", "_coefficients"]
    out = _mapped(rows, [*key, "tile", "_error"], "content", f"planes array<struct<component:int,x:int,y:int,width:int,height:int,samples:array<int>>>, {REPAIRS}, {ERROR}", every, more)
    return out.select(*key, "tile", "planes", "repairs", F.coalesce("_error", "error").alias("error"))


def _with_coefficients(rows: DataFrame, key: list[str], n: int, jobs: Callable[[bytes, int], list[dict]]) -> DataFrame:
    """``rows`` (*key, tile, content) with the coefficients of each tile's blocks, decoded in rows of their own."""
    rows = rows.withColumn("_digest", F.xxhash64("content"))
    same = [*key, "tile", "_digest"]
    listed = _mapped(rows.where("tile is not null"), same, "content", "jobs array<struct<n:int,width:int,height:int,band:string,planes:int,style:int,segments:array<struct<passes:int,data:binary>>>>", lambda found: ({"jobs": jobs(b, t)} for b, t in found), ["tile"])
    blocks = listed.select(*same, F.explode("jobs").alias("_j")).select(*same, F.col("_j.n").alias("_n"), "_j").repartition(n, *same, F.call_function("div", F.col("_n"), F.lit(256)))

    def decoded(found: Iterable[dict]) -> Iterator[dict]:
        given = ((j["width"], j["height"], j["band"], j["planes"], j["style"], [(s["passes"], s["data"]) for s in j["segments"]]) for j in found)
        for some in batched(given, 1024):
            yield from ({"_values": x.astype("<i4").tobytes()} for x in image.decode_jobs(list(some)))

    found = _mapped(blocks, [*same, "_n"], "_j", "_values binary", decoded).groupBy(*same).agg(F.sort_array(F.collect_set(F.struct("_n", "_values"))).alias("_found"))
    found = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(same)], F.col("_found._values").alias("_coefficients"))
    join = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(same)]
    return rows.join(found, join, "left").select(*rows.columns, "_coefficients")


def samples(decoded: DataFrame, key: list[str]) -> DataFrame:
    """(*key, component, pos, value): one row per sample of decoded images; files with an error have none."""
    each = decoded.where("error is null").select(*key, F.posexplode("components").alias("component", "_c"))
    return each.select(*key, "component", F.posexplode("_c.samples").alias("pos", "value"))


def export(decoded: DataFrame, key: list[str], raw: bool = False) -> DataFrame:
    """(*key, file binary): 8-bit PGM or PPM files (or raw interleaved bytes) of decoded images; files with an error stay
    as rows with a null file."""

    def every(rows: Iterable[tuple]) -> Iterator[dict]:
        for c, w, hgt in rows:
            yield {"file": None if c is None else image.export_raster(c, w, hgt, raw)}

    return _mapped(decoded, key, "components", "file binary", every, ["width", "height"])


def error_kind(df: DataFrame) -> Column:
    return df["error"]["kind"]
