import random

import pytest

WORD = "alpha beta gamma delta omega sigma kappa theta".split()


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, astral, long, repeated."""
    rng = random.Random(5)
    long = " ".join(rng.choice(WORD) for _ in range(30_000))
    return [None, "", " \n\t ", "word", "😀 naïve \u0085 x", "z" * 60_000, long, "a b c d e f g h i j k l", "a b c d e f g h i j k l"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """These as documents with null and repeated keys, and columns whose names operators use themselves."""
    rows = [(k if k % 4 else None, t, ["en", None][k % 2], ["s", None, "t"][k % 3], k, k, "x", -1, "y") for k, t in enumerate(odd_texts)]
    rows += rows[-1:]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid long, label string, size int, spans string").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    """No rows, but partitions: an operator's tasks run on them."""
    none = odd_docs.sparkSession.createDataFrame(odd_docs.sparkSession.sparkContext.parallelize([], 3), odd_docs.schema)
    assert none.rdd.getNumPartitions() == 3
    return none


@pytest.fixture(scope="session")
def sparse_docs(spark, odd_docs):
    """Three rows in five partitions: a null text, a text without anything to find, one with a little of all."""
    texts = [None, "lorem ipsum", 'all rights reserved mail a@b.org or token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' * 3]
    rows = [(k, t, None, None, None, None, None, None, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), odd_docs.schema)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
