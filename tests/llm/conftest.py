import random

import pytest

SCHEMA = "doc_id long, text string, source string, kept string, _in int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n)]


def corpus():
    """Documents with nulls, blanks, ties, repeated rows, long texts, near and exact copies, clashing names."""
    rng = random.Random(5)
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words(rng, rng.randrange(60, 160))), f"s{i % 3}", "x", i))
    base = rows[3][1].split(" ")
    for i in range(40, 46):  # near copies: one word changed
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"new{i}"
        rows.append((i, " ".join(copy), "s0", None, None))
    rows.append((50, rows[5][1].replace(" ", "\n"), "s1", "x", 1))  # equal without blanks
    rows.append((51, rows[5][1].upper(), "s1", "x", 1))
    rows += [(60, None, None, None, None), (61, "", "s2", "", 0), (62, " \n\t ", "s2", "", 0), (63, "a", "", "", 0)]
    rows += [(70, "same row twice " * 30, "s0", "k", 1)] * 2
    rows.append((None, "a text without a number " * 12, "s1", "x", 1))
    rows.append((80, " ".join(words(rng, 5000)), "s0", "x", 1))
    rows.append((81, "  two  blanks \n\n and é ß 漢字 😀 \\ <|im_end|> ▁ mark ", "s0", "x", 1))
    rows.append((82, "line one is here\nline two is there\nline one is here\n\nLINE TWO is there", "s0", "x", 1))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
