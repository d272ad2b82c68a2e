"""Small document tables for the corpus operators."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int, base: str = "en") -> str:
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "and", "tion", "er", "wh", "sh"], "de": ["der", "sch", "ung", "ein", "lich", "keit", "und"]}[base]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    found = []
    for k in range(60):
        lang = "en" if k % 3 else "de"
        lines = [prose(100 * k + j, 14, lang) for j in range(8)]
        found.append((k, "\n".join(lines), lang, f"src{k % 4}", None))
    found += [(k, found[7][1], "en", "hot", 1) for k in range(60, 72)]  # exact copies
    found += [(72, None, None, None, None), (73, "", "en", "src0", 0), (74, " \n\t ", None, "src1", 4), (75, "123 456 !!", "en", None, 10)]
    found += [(76, "One", "en", "src0", 3), (76, "One", "en", "src0", 3), (None, "no id here at all", "en", "src0", 17), (None, None, None, None, None)]
    found += [(77, prose(5, 30_000), "en", "long", 1), (78, "\n".join(["a b", "c d", "e f"] * 40), "en", "src2", 1)]
    return found


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same table with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["fp", "doc", "row", "word", "h", "_id", "_key", "_doc", "_gone", "_keep", "u", "shard", "rank", "part", "held_out", "score", "label", "size", "digest", "ids"]
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def table_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
