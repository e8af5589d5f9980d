import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, white space of all kinds, other alphabets."""
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "délta", "ép", "zeta9", "#x", "42", "日本", "😀", "|", "eta!!"]
    long = " ".join(r.choice(words) + str(r.randrange(400)) for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "one two three"), (7, long), (8, long), (9, long + " end"),
            (10, "a\x0bb\x0cc\rd\ne f g h i j k"), (11, "a a a a a a a a a a a a"), (None, "one two three"), (None, None),
            (12, "line one has words\nline one has words\n\n \nline one has words\nx"), (6, "one two three"), (13, "é" * 40), (14, "x" * 5000)]
    for i in range(60):
        rows.append((100 + i, " ".join(r.choice(words) for _ in range(r.randrange(1, 80)))))
    rows.append((500, rows[-1][1]))
    return [(d, t, (None, "en", "fr")[i % 3], (None, "src1", "src2", "src3")[i % 4], None if t is None else len(t)) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns whose names clash with those of results and of intermediate tables."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows, SCHEMA)
    names = ["fp", "label", "size", "shard", "slot", "n_words", "spans", "items", "domain", "n_tokens", "copies", "kept", "chunk", "blob", "law", "u", "v", "node", "kind"]
    return df.withColumns({n: F.lit("extra") for n in names}).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
