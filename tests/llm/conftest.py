import random

import pytest

SMALL = "/root/testdata/sf0.001"
#: Texts that every operator must take: null, empty, blank, one word, line breaks, other
#: scripts, control characters, special strings, and a very long text.
ODD = [None, "", "   \n\t ", "a", "x \n foo    bar\r\n", "日本語 テキスト　x 😀 é é", "\x1c\x1d a\x1e b", "foo<|endoftext|> bar <|startoftext|>",
       "don't I'LL they've", "12345 6789,0 ½²³", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "▁a ▁▁ b", "wort " * 30_000]


def prose(n, seed=0, words="the of and house river stone light window garden walked slowly under bright evening sky".split()):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(words) + rnd.choice(["", "", str(rnd.randrange(500))]) for _ in range(n))


@pytest.fixture
def docs(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)
    return make


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
