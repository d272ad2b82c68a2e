"""Fill-in-the-middle against a plain version over lists of units, and texts that hold the delimiter, its escape and markers."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestream.llm import fim

ODD = ["", "\x01", "\x02", "\x021\x020\x01\x02", "\x020", "a\x01b\x02c", "<P", "x<S>y", "<P>", "<M><S>", "a<", "<<S", "naïve Ünïts\U0001f600z\n\t \\$0 $1", "ab12cd", "퟿￿", "ab" * 3000 + " é\U0001f600" * 2000]


def plain_version(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, text
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k * len(ODD) + j, t) for k in range(6) for j, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, *rows[:5], (None, "no id"), (None, None), (-7, None), (-(2**63), "least id"), (2**63 - 1, "one two")], "doc_id bigint, text string").repartition(3)


def test_against_plain_version(odd, docs):
    for frame in (odd, docs.select("doc_id", "text")):
        found = fim.fill_in_middle(frame).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
        assert len(found) == frame.count()
        for r in found:
            assert (r.n, r.form, r.prefix, r.middle, r.suffix, r.output) == plain_version(r.doc_id, r.text)
            assert r.back == (r.text or "")
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_query_digests(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in fim.op11_marker_injection(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for r in odd.collect():
        n, form, p, m, _, out = plain_version(r.doc_id, r.text)
        want.append((r.doc_id, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(r.text or "")))
    assert got == sorted(want, key=repr)


def test_escape_is_undone_and_frees_the_delimiter(odd):
    seen = odd.select("text", fim.escape(F.col("text")).alias("e"), fim.unescape(fim.escape(F.col("text"))).alias("back")).where("text is not null").collect()
    assert all(r.back == r.text and "\x01" not in r.e for r in seen)


def test_shares_clashes_and_empty_table(spark, nothing, clashing, docs):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    forms = {r.form: r["count"] for r in fim.fill_in_middle(ids).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 2000) < 200 and abs(forms["spm"] - 3600) < 300
    assert fim.fill_in_middle(ids, transformed=0).where("form <> 'plain'").isEmpty()
    assert fim.fill_in_middle(nothing).count() == 0
    named = clashing.withColumns({n: F.lit("x") for n in ("n", "form", "output", "prefix", "_fim_text")})
    found = fim.fill_in_middle(named)
    assert found.columns[: len(named.columns)] == named.columns and {"_n", "_form", "_output"} <= set(found.columns)
    assert sorted(map(str, (r["_output"] for r in found.collect()))) == sorted(str(plain_version(r.doc_id, r.text)[-1]) for r in docs.collect())


def test_plan_is_native_and_without_exchange(docs):
    plan = fim.fill_in_middle(docs.select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
