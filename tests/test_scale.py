"""Queries at sizes where a file of few bytes is few tasks, or an Arrow batch is many pictures."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelake import registry
from codelake.kernels import packets, wavelet
from codelake.operators import decode, encode, image

SF = "/root/testdata/sf0.001"


def tasks(rows) -> int:
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("name", ["precinct_blocks", "block_grid", "packet_order_lrcp"])
def test_rectangles_are_made_by_all_cores(spark, name):
    assert tasks(registry.QUERIES[name](spark, SF)) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["decode_limits", "pdf_streams"])
def test_files_of_parts_are_made_by_all_cores(spark, name):
    assert tasks(registry.QUERIES[name](spark, SF)) >= spark.sparkContext.defaultParallelism


def test_a_tile_without_packets_is_decoded_without_its_blocks(monkeypatch):
    def none(*_):
        raise AssertionError("a block was made, or zeros were transformed")

    monkeypatch.setattr(packets, "Block", none)
    monkeypatch.setattr(wavelet, "synthesise", none)
    found = image.decode_file(encode.header_only(24, 8, 3, 3))
    assert found["error"] is None and [(c["width"], c["height"], set(c["samples"].tolist())) for c in found["components"]] == [(24, 8, {128})] * 3


def test_headers_make_only_the_columns_asked_for(spark):
    rows = spark.createDataFrame([(1, bytearray(encode.header_only(24, 8, 3, 3, declared=9)))], "k int, content binary")
    some, every = decode.headers(rows, ["k"], columns=["repairs", "error"]), decode.headers(rows, ["k"])
    assert some.columns == ["k", "repairs", "error"] and some.collect() == every.select(*some.columns).collect()


def test_strict_and_permissive_headers_read_the_files_once_without_a_join(spark):
    plan = registry.QUERIES["strict_vs_permissive"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan parquet") == 1


def test_a_worker_hands_on_rows_before_it_has_read_a_batch_of_many_files(spark, monkeypatch):
    big = encode.header_only(2048, 2048, 1, 1, tile=2048)
    rows, run = spark.createDataFrame([(0, bytearray(big))], "k int, content binary"), []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, _: run.append(f) or self)
    decode.decode(rows, ["k"])
    found = list(run[0](iter([pa.RecordBatch.from_pydict({"k": list(range(4)), "_content": [big] * 4})])))
    assert [b.num_rows for b in found] == [1] * 4 and [b.column(0).to_pylist() for b in found] == [[0], [1], [2], [3]]


def test_rows_without_a_tile_keep_their_place_among_tiles(spark):
    good = encode.encode_image(encode.golden_picture(channels=1), tile=10)
    rows = spark.createDataFrame([(i, bytearray(b"nothing" if i % 3 else good)) for i in range(9)], "k int, content binary")
    for by_block in (False, True):
        found = decode.decode_by_tile(rows, ["k"], by_block=by_block).collect()
        assert sorted((r.k, r.tile) for r in found if r.planes) == [(i, t) for i in (0, 3, 6) for t in range(4)]
        assert sorted(r.k for r in found if r.error) == [1, 2, 4, 5, 7, 8] and not any(r.planes for r in found if r.error)


def test_streams_of_documents_are_found_once_without_a_join(spark):
    plan = registry.QUERIES["pdf_streams"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan parquet") == 1


def test_a_tile_alone_without_packets_makes_no_blocks(monkeypatch):
    monkeypatch.setattr(packets, "Block", None)
    found = list(image.decode_files([(encode.header_only(16, 8, 1, 3), [1])], whole=False))
    assert found[0]["error"] is None and [(p["x"], p["width"], set(p["samples"].tolist())) for p in found[0]["planes"]] == [(8, 8, {128})]


def test_markers_are_counted_from_their_column_alone(spark, monkeypatch):
    asked, headers = [], decode.headers
    monkeypatch.setattr(decode, "headers", lambda *a, **k: asked.append(k.get("columns")) or headers(*a, **k))
    assert tasks(registry.QUERIES["marker_histogram"](spark, SF)) and asked == [["markers"]]


@pytest.mark.parametrize("name", ["decode_overrides", "decode_layers", "decode_tiled"])
def test_pictures_of_a_large_batch_are_written_in_groups(spark, monkeypatch, name):
    run, real = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: run.append(f) or real(self, f, schema))
    monkeypatch.setattr(registry, "WRITTEN", 2, raising=False)
    registry.QUERIES[name](spark, SF)
    pixels = [[{"pos": 0, "r": 1, "g": 2, "b": 3}]] * 5
    found = list(run[0](iter([pa.RecordBatch.from_pydict({"img": list(range(5)), "pixels": pixels})])))
    assert [b.column(0).to_pylist() for b in found] == [[0, 1], [2, 3], [4]]
    assert [image.decode_file(f)["components"][0]["samples"][0] for f in found[2].column(1).to_pylist()] == [1 if name != "decode_layers" and name != "decode_tiled" else 2]
