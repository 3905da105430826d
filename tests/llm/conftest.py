import random

import pytest

#: Rows that every operator must take: null and empty texts, white space, repeats, ties, a long one, odd characters.
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    texts = [None, "", " \n\t ", "one", "one two three", prose(1, 120), prose(1, 120), prose(2, 300), LONG, "<|endoftext|> é 日本 \x00 x", prose(3, 80) + "\n" + prose(3, 80)]
    rows = [(i, t, "extra", 1.5) for i, t in enumerate(texts)] + [(5, prose(1, 120), "extra", 1.5), (None, prose(9, 60), None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
