"""Hilbert order, the law of rows, and canonical licence digests."""

import hashlib
import itertools
import zlib

from pyspark.sql import functions as F

from lodestream.llm import hilbert, licenses

from .conftest import table_of


def test_curve_visits_every_cell_by_single_steps(spark):
    cells = list(itertools.product(range(8), repeat=3))
    df = spark.createDataFrame(cells, "a bigint, b bigint, c bigint")
    order = [tuple(r)[:3] for r in df.withColumn("h", hilbert.curve([F.col("a"), F.col("b"), F.col("c")], 3)).orderBy("h").collect()]
    assert sorted(order) == cells
    assert all(sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1 for a, b in itertools.pairwise(order))
    assert [r["h"] for r in df.select(hilbert.curve([F.col("a"), F.col("b"), F.col("c")], 3).alias("h")).orderBy("h").collect()] == list(range(512))


def law(got, rows, shards):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    counts = [len(by.get(k, [])) for k in range(shards)]
    assert set(by) <= set(range(shards)) and max(counts) - min(counts) <= 1
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    flat = [r["curve_index"] for k in range(shards) for r in sorted(by.get(k, []), key=lambda r: r["slot"])]
    assert flat == sorted(flat)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_shards(spark, docs, clashing, nothing, rows):
    for df in (docs, clashing):
        law(hilbert.hilbert_shards(df).collect(), rows, 40)
    law(hilbert.hilbert_shards(docs, shards=200).collect(), rows, 200)
    assert hilbert.hilbert_shards(nothing).count() == 0


def test_written_shards(spark, docs, tmp_path):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    bounds = hilbert.write_shards(some, str(tmp_path / "out"), 5)
    assert bounds.count() == 5 and {"min_source", "max_doc_id", "n_rows"} <= set(bounds.columns)
    assert spark.read.parquet(str(tmp_path / "out")).count() == some.count()


def test_licenses(spark, docs, clashing, nothing):
    mit = licenses.TEXTS["MIT"][0]
    cases = [
        (1, "Copyright (c) 2019 Some Body\n\n" + mit, "MIT"),
        (2, "  " + mit.upper().replace("LICENSE", "licence").replace(" ", "\n\t "), "MIT"),
        (3, mit + " and more", None),
        (4, "prose\nLicensed under CC BY-NC 4.0.\nAll rights reserved.\nReleased under the MIT Licence.", None),
        (5, None, None),
        (6, "", None),
        (7, "©  2001 x\n" + licenses.TEXTS["BSD-3-Clause"][1], "BSD-3-Clause"),
    ]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame([c[:2] for c in cases], "doc_id bigint, text string")).collect()}
    assert {k: r["license"] for k, r in got.items()} == {c[0]: c[2] for c in cases}
    assert got[4]["notices"] == "CC-BY-NC-4.0,MIT" and got[4]["n_notices"] == 2
    assert got[5]["digest"] == got[6]["digest"] == hashlib.sha256(b"").hexdigest()
    assert table_of(licenses.license_scan(docs), "doc_id", "digest") == table_of(licenses.license_scan(clashing), "doc_id", "digest")
    assert licenses.license_scan(docs).count() == docs.count() and licenses.license_scan(nothing).count() == 0


def test_native_plans(docs):
    for df in (hilbert.hilbert_shards(docs), licenses.license_scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_whole_texts_of_long_licenses(spark):
    """A document that is the entire text of a long licence is known, with its appendix or without, however it is wrapped."""
    names = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    cases = [(k, " ".join(t.split(" ")).replace("\n", "\n  ")) for k in names for t in licenses.TEXTS[k]] + [(None, licenses.TEXTS["GPL-3.0"][0] + "\nand more")]
    assert len(cases) == 3 * 4 + 3 + 1
    got = {r["doc_id"]: r["license"] for r in licenses.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id bigint, text string")).collect()}
    assert got == {i: k for i, (k, _) in enumerate(cases)}


def test_ids_of_the_whole_range(spark):
    ids = [1, 2**60, -(2**62), 2**62, 2**63 - 1, -(2**63), None, 0]
    rows = [(i, f"text {k}", "en", "s") for k, i in enumerate(ids)]
    law(hilbert.hilbert_shards(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), shards=3).collect(), rows, 3)


def test_an_outlier_does_not_fill_one_cell(spark):
    rows = [(k, "x" * (k % 50), "en", "s") for k in range(400)] + [(2**62, "y", "en", "s")]
    got = hilbert.hilbert_shards(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), shards=8).collect()
    assert len({r["curve_index"] for r in got}) > 300


def test_lists_under_c_stay(spark):
    mit = licenses.TEXTS["MIT"][0]
    cases = [
        (1, mit + "\n(c) You may not sell the Software.", None),
        (2, mit + "\n(c) 2020 Some Body", "MIT"),
        (3, "All rights reserved, and you may not sell this.\n" + mit, None),
        (4, "(C) Copyright 1999 X\nAll rights reserved.\n" + mit, "MIT"),
        (4, "(C) Copyright 1999 X\nAll rights reserved.\n" + mit, "MIT"),
    ]
    got = licenses.license_scan(spark.createDataFrame([c[:2] for c in cases], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(c[0], c[2]) for c in cases]
