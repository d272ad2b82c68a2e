"""Line chunks against a plain version; exact round trips and parity of the tokenizer; the pipeline."""

import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import linechunks, sentencepieces

from .conftest import prose, table_of
from .test_near_duplicates import brute

needs_model = pytest.mark.skipif(not os.path.exists(sentencepieces.MODEL), reason="no model file")


def own_chunks(lines):
    """Two lines with words and what lies between them, or one of fifty words or more."""
    full = [k for k, x in enumerate(lines) if x.strip(b" \t\n\x0b\x0c\r")]
    found = [(i, j + 1) for i, j in zip(full, full[1:], strict=False)] + [(k, k + 1) for k in full if len(lines[k].split()) >= 50]
    return sorted(found, key=lambda c: (c[1], c[0]))


def plain_dedup(rows):
    """doc_id, text without repeated chunks: all occurrences but those of the smallest (id, position) go."""
    key = lambda d: 2**63 - 1 if d is None else d
    first = {}
    for d, t in rows:
        if t is not None:
            lines = t.encode().split(b"\n")
            for i, j in own_chunks(lines):
                body = b"\n".join(lines[i:j])
                first[body] = min(first.get(body, (2**64, 0)), (key(d), i))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None))
            continue
        lines, kept, at = t.encode().split(b"\n"), [], 0
        for i, j in own_chunks(lines):
            if first[b"\n".join(lines[i:j])] != (key(d), i):
                kept += lines[at:i]
                at = max(at, j)
        out.append((d, b"\n".join(kept + lines[at:]).decode()))
    return out


def test_line_chunks(spark, docs, clashing, nothing, rows):
    want = sorted(plain_dedup([r[:2] for r in rows]), key=repr)
    assert table_of(linechunks.dedup_lines(docs), "doc_id", "text") == want
    done = linechunks.dedup_lines(clashing)
    assert done.columns == clashing.columns and table_of(done, "doc_id", "text") == want
    assert sum(len(t or "") for _, t in want) < sum(len(r[1] or "") for r in rows) - 5000
    left = {r["doc_id"] for r in linechunks.drop_repeated_lines(docs).collect()}
    assert {7, 72, 73, 74, 75, None} <= left and not left & set(range(60, 72))
    assert linechunks.dedup_lines(nothing).count() == 0


def test_boundaries_resist_shifts():
    lines = [prose(k, 9).encode() for k in range(400)]
    cut = lambda x: {b"\n".join(x[i:j]) for i, j in linechunks.chunks(x)}
    before, after = cut(lines), cut(lines[:150] + [b"a new line"] + lines[150:])
    assert len(before - after) <= 4


@needs_model
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_parity_on_any_text(text):
    c = sentencepieces.codec(sentencepieces.MODEL, 1)
    ids = c.encode([text])
    assert ids[0].tolist() == c.reference.encode(text) and c.decode(ids) == [c.restored(text)]
    assert c.decode(ids) == c.whole.decode_batch([ids[0].tolist()], skip_special_tokens=False)


@needs_model
def test_decoding_equals_the_library_on_any_ids():
    c, rng = sentencepieces.codec(sentencepieces.MODEL, 1), np.random.default_rng(2)
    for _ in range(300):
        ids = rng.integers(0, 300 if rng.random() < 0.5 else len(c.model.pieces), rng.integers(0, 12)).astype(np.int32)
        assert c.decode([ids]) == [c.whole.decode(ids.tolist(), skip_special_tokens=False)]


@needs_model
def test_encode_and_decode(spark, docs, clashing, nothing, rows):
    done = sentencepieces.encoded(clashing)
    got = done.select("doc_id", "text", "n_tokens", "ids_crc32", "parity", "round_trip", "ids").collect()
    assert all(r["parity"] and r["round_trip"] and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes()) for r in got)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted((r[:2] for r in rows), key=repr)
    back = sentencepieces.decoded(done.select("doc_id", "ids"))
    assert table_of(back, "doc_id", "text") == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    assert sentencepieces.encoded(nothing).count() == 0


@needs_model
def test_unigram_models_are_rebuilt():
    """A model file written field by field: unigram scores, byte fallback, prefix and squeezing."""

    def field(n, kind, value):
        head = bytes([n << 3 | kind]) if n < 16 else bytes([(n << 3 | kind) & 0x7F | 0x80, n >> 4])
        if kind == 2:
            size, out = len(value), b""
            while True:
                out += bytes([size & 0x7F | (0x80 if size > 127 else 0)])
                size >>= 7
                if not size:
                    return head + out + value
        return head + value

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces += [("▁the", -2.0, 1), ("▁", -3.0, 1), ("the", -3.5, 1), ("ing", -3.0, 1), ("in", -4.0, 1), ("g", -5.0, 1), ("t", -5.0, 1), ("h", -5.0, 1), ("e", -5.0, 1), ("i", -6.0, 1), ("n", -6.0, 1)]
    body = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    body += field(2, 2, field(3, 0, b"\x01") + field(35, 0, b"\x01")) + field(3, 2, field(1, 2, b"identity"))
    m = sentencepieces.parse(body)
    assert m.kind == sentencepieces.UNIGRAM and m.byte_fallback and m.squeeze and len(m.pieces) == len(pieces)
    import sentencepiece

    t, reference = sentencepieces.rebuild(m), sentencepiece.SentencePieceProcessor(model_proto=body)
    for text in ("the thing", "  the   ing ", "thé", "xyz", "in the ingthe", "\nthe\n", "\tthe", "the\u3000", " \u2003the \n ", "\r\n the\x0b ", " ", "\n"):
        assert t.encode(text, add_special_tokens=False).ids == reference.encode(text), text


@needs_model
def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    given_rows = [r for r in rows if r[0] is not None and r[0] != 76]
    spark.createDataFrame(given_rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    bench = [(1, given_rows[20][1].split("\n")[3] + " " + given_rows[20][1].split("\n")[4])]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # brute force, stage by stage
    left = [r for r in given_rows if r[0] not in (72, 73, 74, 75)]
    cut = dict(plain_dedup([r[:2] for r in left]))
    left = [(d, cut[d]) for d, t, *_ in left if cut[d] == t or cut[d].split()]
    names = defaultdict(list)
    for d, _, c in brute(left):
        names[c].append(d)
    left = [(d, t) for d, t in left if d in names and d != 20]
    assert {d: r["text"] for d, r in got.items()} == dict(left)
    assert all(r["parity"] and r["round_trip"] for r in got.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "sentencepiece"]


def test_passages_between_other_lines_go(spark):
    """Repeated passages inside otherwise different documents go whole, and so do long single lines."""
    passages = [[prose(7000 + 10 * k + j, 20) for j in range(2 + k % 3)] for k in range(12)] + [[prose(7900 + k, 60)] for k in range(4)]
    around = lambda k: [prose(8000 + 10 * k + j, 9) for j in range(3)]
    texts = []
    for k, p in enumerate(passages):
        texts += [around(3 * k) + p + around(3 * k + 1), around(3 * k + 2)[: k % 3] + p + around(500 + k)]
    done = linechunks.dedup_lines(spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string"), mark=("had", "lost"))
    got = {r["doc_id"]: r for r in done.collect()}
    for k, p in enumerate(passages):
        assert got[2 * k]["text"] == "\n".join(texts[2 * k]) and got[2 * k]["lost"] == 0
        assert not set(got[2 * k + 1]["text"].split("\n")) & set(p) and got[2 * k + 1]["lost"] == len(p)
        assert got[2 * k + 1]["text"] == "\n".join(x for x in texts[2 * k + 1] if x not in p)


def test_texts_under_one_id_are_cut_by_their_own_lines(spark):
    """Null and repeated ids with different texts of many lines: each loses only what occurs elsewhere."""
    line = lambda k: prose(9500 + k, 12)
    shared = [line(1), line(2)]
    for one in (5, None):
        rows = [(1, "\n".join(shared)), (one, "\n".join([*shared, line(3), line(4)])), (one, "\n".join([line(5), line(6), line(7), line(8)])), (one, "\n".join([line(9), *shared]))]
        rows += [(one, "\n".join([line(10), line(11)]))] * 2
        got = linechunks.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
        want = [(1, rows[0][1]), (one, "\n".join([line(3), line(4)])), rows[2], (one, line(9)), rows[4], rows[5]]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@needs_model
def test_pipeline_of_odd_rows(spark, clashing, nothing, tmp_path):
    """Null ids and texts, repeated rows and ids, clashing columns; an empty table."""
    import corpus_pipeline

    other = "SELECT 76 doc_id, 'two different texts stand under one id here' text, 'en' lang, 'src0' source, 1L n_chars"
    more = clashing.unionByName(spark.sql(other), allowMissingColumns=True)
    for name, df in (("full", more), ("none", nothing)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "full"))
    assert set(clashing.columns) <= set(got.columns)
    rows = sorted((r["doc_id"], r["text"]) for r in got.where("doc_id = 76").collect())
    assert [t for _, t in rows] == ["One", "two different texts stand under one id here"]
    assert [r["text"] for r in got.where("doc_id is null").collect()] == ["no id here at all"]
    assert got.where("text is null or text = ''").count() == 0 and got.where("doc_id between 0 and 59").count() == 60
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@needs_model
def test_long_words_are_not_kept():
    c = sentencepieces.codec(sentencepieces.MODEL, 1)
    text = "ab" * 5000
    ids = c.encode([text, f"{text} {text}"])
    assert [x.tolist() for x in ids] == c.reference.encode([text, f"{text} {text}"]) and max(map(len, c.seen)) <= c.LONGEST
