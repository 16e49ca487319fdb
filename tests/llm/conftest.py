"""Awkward inputs that every operator must take: nulls in any column, empty and very long texts, ties, repeated rows, empty
tables, extra columns whose names clash with those that operators make."""

import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard string, kept string, node string, n bigint, slot double"
CLASH = ["base", "lo", "hi", "bin", "pos", "row", "rank", "at", "n_good", "cut_symbols", "stratum", "__id", "__key", "__drop", "__row", "__copy", "text_key", "hits", "item", "target", "copies", "sid", "band"]
DOC += "".join(f", {c} string" for c in CLASH)
EXTRA = ("x", "y", "z", "w", 7, 0.5)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abdeimnorstu") for _ in range(r.randint(2, 8))) for _ in range(n))


def make(spark, rows):
    full = [(i, t, lang, src, None if t is None else len(t), *EXTRA[:1], *EXTRA[1:4], EXTRA[4], EXTRA[5], *CLASH) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOC).repartition(3)


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, words(i % 37, 60 + i % 50), "en" if i % 3 else "de", f"src{i % 5}") for i in range(100)]
    rows += [(100, None, "en", "src0"), (101, "", None, None), (102, " \t\n ", "en", None), (103, words(1, 30000), "en", "src1"), (104, "one two", "fr", "src2")]
    rows += [(105, words(5, 90), None, "src1")] * 3 + [(None, words(6, 80), "en", "src3"), (None, None, None, None), (106, "é ü 漢字 \U0001f600 ok", "en", "src1")]
    return make(spark, rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def table(spark):
    return lambda rows: make(spark, rows)
