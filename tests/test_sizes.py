"""What larger tables showed: values at the edge of a rounding, and steps whose cost a record is bounded."""

import time

import numpy as np
import pandas as pd
import pytest

from lodestream.functions import checksums
from lodestream.plans.queries import ORACLES, QUERIES


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over the given tables."""
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for k, t in tables.items():
        t.to_parquet(folder / f"{k}.parquet")
        duck.execute(f"CREATE VIEW {k} AS SELECT * FROM read_parquet('{folder / k}.parquet')")
    want = duck.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, str(folder)).toPandas()[list(want.columns)]
    return [sorted(map(tuple, f.astype(object).itertuples(index=False))) for f in (got, want)]


def test_planar_frames_where_single_and_double_products_differ(spark, tmp_path):
    x = (np.arange(0, 1000, dtype=np.float32) / np.float32(1000)).astype(np.float32)
    x = np.concatenate([x, np.nextafter(x, np.float32(1)), np.nextafter(x, np.float32(-1))])
    odd = x[np.floor(np.abs(x) * np.float32(1000)) != np.floor(np.abs(x.astype(np.float64)) * 1000)]
    assert len(odd) > 64
    got, want = both(spark, tmp_path, "q60_planar_frames", embeddings=pd.DataFrame({"vec_id": [1, 2], "embedding": [odd[:64], -odd[-64:]]}))
    assert got == want and len(got) == 128


def test_a_short_page_has_its_checksum_in_microseconds():
    pages = [bytes([k % 251]) * (20 + k % 60) for k in range(20_000)]
    began = time.perf_counter()
    found = [checksums.OGG.of(p) for p in pages]
    assert time.perf_counter() - began < 3  # 12 s by lanes of numpy
    assert found[:50] == [checksums._plain(checksums.OGG, p) for p in pages[:50]]
    for kind in (checksums.FLAC16, checksums.FLAC8):
        assert [kind.of(p) for p in pages[:50]] == [checksums._plain(kind, p) for p in pages[:50]]


def test_a_step_over_boxes_names_its_size_once(spark):
    from pyspark.sql import functions as F

    from lodestream.sources import boxtree, wavtree

    df = spark.createDataFrame([(bytearray(),)], "content binary")
    for walk, reads in ((boxtree.siblings, 3), (wavtree.chunks, 1)):  # a header of 64 bits is read by two more; 19 and 4 before
        made = df.select(walk(F.col("content"), F.lit(0).cast("bigint"), F.lit(8).cast("bigint"), ("ftyp",)).alias("w"))
        assert made._jdf.queryExecution().analyzed().toString().count("conv(") <= reads


def test_a_long_stream_of_packets_is_cut_into_pieces(spark):
    from pyspark.sql import functions as F

    from lodestream.streaming import pump

    packets = spark.range(6000).select(F.when(F.col("id") < 5500, "a").otherwise("b").alias("source_id"), F.when(F.col("id") < 5500, F.col("id")).otherwise(F.col("id") - 5500).alias("seq"), F.encode(F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")), "utf-8").alias("samples"))
    got = pump.pumped(packets, 16, 1)
    assert "_piece" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, pump.pumped(packets, 16, 1, large=None).collect()), key=repr)


def test_frames_of_many_lines_are_dealt_to_more_tasks(spark, monkeypatch):
    from lodestream.plans import queries

    monkeypatch.setattr(queries, "LINES_A_TASK", 500, raising=False)
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/lineitem.parquet").count() // 500
    got = queries.QUERIES["q31_adts_index"](spark, folder)
    assert n > 4 and f", {n})" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == n * 500 + spark.read.parquet(f"{folder}/lineitem.parquet").count() % 500


def test_the_probed_files_are_made_in_one_pass_over_the_lines(spark):
    from lodestream.plans import queries

    got = queries.QUERIES["q25_container_probe"](spark, "/root/testdata/sf0.001")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1  # a pass a kind before


def test_ima_blocks_of_many_lengths_advance_together(monkeypatch):
    from lodestream.functions import codecs

    rng = np.random.default_rng(7)
    blocks = [bytes([1, 2, 16, 0]) + rng.integers(0, 256, 4 * n, np.uint8).tobytes() for n in rng.integers(1, 256, 600)]
    began = time.perf_counter()
    found = codecs.ima_blocks(blocks, 1)
    assert time.perf_counter() - began < 0.8  # 2.5 s a length at a time
    assert all(np.array_equal(f, codecs.ima_block(b, 1)) for f, b in zip(found[:40], blocks, strict=False))


def test_a_frame_header_is_read_once(monkeypatch):
    from lodestream.sources import encode, flac

    data, calls, real = encode.flac([[k] for k in range(40)], block=2), [], flac.frame_header
    monkeypatch.setattr(flac, "frame_header", lambda *a: calls.append(a[1]) or real(*a))
    assert len(flac.flac_packets(data)) == 20 == len(calls)  # 39 before


def test_samples_of_a_source_are_gathered_by_frame(spark):
    from lodestream.plans import queries

    plan = queries.QUERIES["q30_flac_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("_bad")  # rows of samples come after the last window, not before it


def test_matroska_sources_are_read_without_windows_or_joins(spark):
    from pyspark.sql import functions as F

    from lodestream.sources import elements

    rows = elements.walked(spark.createDataFrame([("a", bytearray(b"x"))], "source_id string, content binary"))
    plan = elements.packets(rows, elements.inspected(rows)).withColumn("n", F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and "Join" not in plan  # two walks, a join and two windows before
