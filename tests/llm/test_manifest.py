"""The Merkle manifest against a plain version in Python and against its SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lodestream.llm import manifest
from lodestream.llm.common import Scratch


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][k : k + 8])) for k in range(0, len(found[-1]), 8)])
    return found


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        at = i // 8 * 8
        out.append((i - at, nodes[at : at + 8]))
        i //= 8
    return out


def plain_version(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: levels([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in names}
    top = levels([built[k][-1][0] for k in names])
    out = []
    for at, name in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(trees[name], key=lambda x: x[:3])):
            steps = path(built[name], i) + path(top, at)
            proof = sha("".join(h for k, run in steps for j, h in enumerate(run) if j != k))
            low = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            now = leaf(r, r.text.translate({c: c + 32 for c in range(65, 91)})) if low else own
            for k, run in steps:
                now = sha("".join([*run[:k], now, *run[k + 1 :]]))
            out.append((r.doc_id, own, built[name][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in manifest.op12_event_manifest(spark, str(tmp_path)).collect()), key=repr)


def many(spark, counts):
    rows = [(k * 7919 % 100_003 if lang != "hot" else k, f"Text {k} Äé ABC", lang, None if k % 5 else f"s{k % 3}", None if k % 4 else k) for lang, n in counts.items() for k in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_fixture_against_plain_version(spark, tmp_path, docs):
    assert rows_of(spark, tmp_path, docs) == plain_version(docs.collect())


@pytest.mark.parametrize("parts", [1, 11])
def test_odd_sizes_against_plain_version(spark, tmp_path, parts, monkeypatch):
    # one leaf, full runs, one over, several blocks of 512, languages over one run
    monkeypatch.setattr(manifest, "BROADCAST_ROWS", 0 if parts == 11 else 100_000)
    docs = many(spark, {"hot": 1500, "a": 1, "b": 8, "c": 9, None: 64, "": 65, "zé": 513, **{f"l{k}": 1 + k for k in range(12)}}).repartition(parts)
    assert rows_of(spark, tmp_path, docs) == plain_version(docs.collect())


def test_one_tree_one_leaf_and_nothing(spark, tmp_path, nothing):
    for k, docs in enumerate((many(spark, {"en": 1}), many(spark, {"en": 20}), many(spark, {f"x{j}": 1 for j in range(70)}))):
        assert rows_of(spark, tmp_path / str(k), docs) == plain_version(docs.collect())
    assert rows_of(spark, tmp_path / "none", nothing) == []


def test_frontiers_are_small_and_reshuffled(spark):
    """Leaves in order: each partition hands on only children of parents over its borders."""
    leaves = spark.range(0, 5000, numPartitions=7).select(F.lit("t").alias("tree"), F.col("id").alias("idx"), F.lit(5000).cast("bigint").alias("size"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    first = leaves.withColumn("level", F.lit(0)).select("tree", "level", "idx", "size", "digest").mapInArrow(manifest.combined, manifest.FOUND)
    kinds = {r.kind: r["count"] for r in first.groupBy("kind").count().collect()}
    assert 0 < kinds[manifest.FRONTIER] <= 7 * 2 * 7 * 5 and kinds[manifest.LINK] > 5000 / 8
    scratch = Scratch(spark, "test")
    for order in (leaves, leaves.repartition(5, F.hash("idx"))):  # any dealing of the events gives the same root
        found = manifest.climbed(scratch, order, f"t{order.rdd.getNumPartitions()}").where(F.col("kind") == manifest.ROOT).collect()
        assert [bytes(r.digest).hex() for r in found] == levels([sha(str(k)) for k in range(5000)])[-1]
    scratch.close()


def test_proofs_fold_to_the_root(docs, clashing):
    found = manifest.merkle_manifest(docs, with_proofs=True).collect()
    for r in found:
        assert manifest.folded(bytes.fromhex(r.leaf), bytes(r.proof)).hex() == r.root == r.folded_root and r.verified
        assert sha(manifest.siblings(bytes(r.proof))) == r.proof_sha256
    same = manifest.merkle_manifest(clashing).select("doc_id", "root", "proof_sha256").collect()
    assert sorted(map(repr, same)) == sorted(repr(s) for s in manifest.merkle_manifest(docs).select("doc_id", "root", "proof_sha256").collect())


def test_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs = many(spark, {"hot": 700, None: 9, "b": 8, **{f"l{k}": 2 for k in range(9)}})
    got = rows_of(spark, tmp_path, docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = con.execute(manifest.ORACLE_SQL)
    names = [c[0] for c in cursor.description]
    order = [names.index(n.split(" ")[0]) for n in manifest.PROVED.split(", ")]
    assert sorted((tuple(r[k] for k in order) for r in cursor.fetchall()), key=repr) == got
